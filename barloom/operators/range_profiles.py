"""The profile of the last n bars at every bar, by classes of windows that share a range.

The buckets of a window follow from its highest high and lowest low. While both stay, the next window is the last one
with a bar more and a bar less, so its bucket sums are carried on; bars are spread over buckets once for each
class that they are in, not once for each window. Highest and lowest values slide in two passes of prefix and suffix
maxima. Blocks of a series with the n - 1 bars before them are groups of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.operators.blocks import SIZE, with_halo
from barloom.operators.profiles import _SIGMA, BUCKETS, MARGIN, spread_volume, value_areas
from barloom.schema import KEY

#: Bucket values that are held at a time (16 MB).
HELD = 1 << 21


def sliding_max(x: np.ndarray, n: int) -> np.ndarray:
    """Maxima of all windows of n: of each, the suffix of one stretch of n and the prefix of the next."""
    count = len(x) - n + 1
    if count <= 0:
        return np.zeros(0)
    padded = np.concatenate([x, np.full(-len(x) % n, -np.inf)]).reshape(-1, n)
    prefix = np.maximum.accumulate(padded, axis=1).ravel()
    suffix = np.maximum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(suffix[:count], prefix[n - 1 : n - 1 + count])


def _classes(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each stretch that shares a range."""
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(hi)))


def _sums(h, low, c, v, start, size, first, windows, n) -> np.ndarray:
    """Bucket sums of the windows of some classes, a row a window."""
    bars = windows + n - 1
    owner = np.repeat(np.arange(len(first)), bars)
    begin = np.cumsum(bars) - bars
    place = np.arange(len(owner)) - begin[owner]
    at = first[owner] + place
    ranged = (low[at] > 0) & (h[at] > low[at])
    sigma = np.where(ranged, np.log(np.where(ranged, h[at], 1.0) / np.where(ranged, low[at], 1.0)) / _SIGMA, 0.0)
    spread = spread_volume(start[owner], size[owner], (h[at] + low[at] + c[at]) / 3, sigma, v[at], h[at], low[at])
    out = np.zeros((int(windows.sum()), BUCKETS))
    row = np.cumsum(windows) - windows
    total = np.stack([spread[b : b + n].sum(axis=0) for b in begin])
    out[row] = total
    live = np.arange(len(first))
    for k in range(1, int(windows.max())):  # all classes that have a k-th window take one step
        live = live[windows[live] > k]
        total[live] += spread[begin[live] + n - 1 + k] - spread[begin[live] + k - 1]
        out[row[live] + k] = total[live]
    return np.round(np.maximum(out, 0.0), 8)


def profiles_by_ranges(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Point of control and value area of every window of n bars of a series (a row each)."""
    if len(h) < n:
        return np.zeros((0, 3))
    v = np.where(v > 0, v, 0.0)
    hi, lo = sliding_max(h, n), -sliding_max(-low, n)
    start = lo - (hi - lo) * MARGIN
    size = ((hi + (hi - lo) * MARGIN) - start) / BUCKETS
    traded = np.lib.stride_tricks.sliding_window_view(v, n).sum(axis=1)
    first, windows = _classes(hi, lo)
    most = max(1, HELD // BUCKETS - n)  # a class of very many windows is taken in parts
    pieces = -(-windows // most)
    owner = np.repeat(np.arange(len(first)), pieces)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, windows = first[owner] + part * most, np.minimum(windows[owner] - part * most, most)
    out = np.empty((len(hi), 3))
    group = (np.cumsum(windows + n - 1) * BUCKETS) // HELD
    for g in np.unique(group):
        of = np.flatnonzero(group == g)
        total = _sums(h, low, c, v, start[first[of]], size[first[of]], first[of], windows[of], n)
        own = slice(first[of[0]], first[of[-1]] + windows[of[-1]])
        poc = total.argmax(axis=1)
        a, b, _ = value_areas(total, poc, traded[own])
        centre = lambda i, own=own: start[own] + size[own] / 2 + i * size[own]
        out[own] = np.stack([centre(poc), centre(b) + size[own] / 2, centre(a) - size[own] / 2], axis=1)
    none, flat = traded <= 0, hi <= lo
    out[none] = np.stack([c[n - 1 :], hi, lo], axis=1)[none]
    out[flat] = np.stack([hi, hi, lo], axis=1)[flat]
    return out


def add_rolling_profile(bars: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """``profiles.add_rolling_profile`` by classes of ranges and blocks of a series: adds ``rvp_poc_{n}, rvp_vah_{n}, rvp_val_{n}``."""
    names = [f"rvp_{c}_{n}" for c in ("poc", "vah", "val")]
    own = bars.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos", kind="stable")
        columns = [rows[x].fillna(0).to_numpy(float) if x == "volume" else rows[x].to_numpy(float) for x in ("high", "low", "close", "volume")]
        out = np.full((len(rows), 3), np.nan)
        if len(rows) >= n:
            out[n - 1 :] = profiles_by_ranges(*columns, n)
        rows = rows.assign(**{k: out[:, j] for j, k in enumerate(names)})
        return rows.loc[rows["_own"], [*own, *names]]

    schema = T.StructType([*bars.schema.fields, *[T.StructField(k, T.DoubleType()) for k in names]])
    return with_halo(bars, n - 1, size).groupBy(*KEY, "_part").applyInPandas(run, schema)
