"""Rolling profiles by classes of ranges are those of whole windows."""

import datetime as dt
import time

import numpy as np
import pytest

from barloom.operators import profiles, range_profiles
from barloom.schema import BARS


def series(n, seed, tick=0.01):
    rng = np.random.default_rng(seed)
    c = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))) / tick) * tick
    h, low = c + tick * rng.integers(0, 60, n), c - tick * rng.integers(0, 60, n)
    v = rng.integers(0, 500, n).astype(float)
    v[rng.random(n) < 0.1] = 0
    return h, low, c, v


@pytest.mark.parametrize(("n", "length", "seed"), [(1, 50, 1), (2, 50, 2), (12, 400, 3), (50, 300, 4), (12, 12, 5), (12, 5, 6)])
def test_matches_whole_windows(n, length, seed, monkeypatch):
    h, low, c, v = series(length, seed)
    h[10:20] = low[10:20] = c[10:20] = 100.0  # bars and windows without a range
    v[30:45] = 0
    want = profiles.window_profiles(*(np.lib.stride_tricks.sliding_window_view(x, n) for x in (h, low, c, v))) if length >= n else np.zeros((0, 3))
    assert np.allclose(range_profiles.profiles_by_ranges(h, low, c, v, n), want, rtol=0, atol=1e-9)
    monkeypatch.setattr(range_profiles, "HELD", 100 * (n + 3))  # parts of classes
    assert np.allclose(range_profiles.profiles_by_ranges(h, low, c, v, n), want, rtol=0, atol=1e-9)


def test_sliding_max():
    x = np.random.default_rng(1).normal(size=101)
    for n in (1, 2, 7, 50, 101):
        assert np.array_equal(range_profiles.sliding_max(x, n), [x[i : i + n].max() for i in range(102 - n)])


def test_long_windows_cost_less():
    h, low, c, v = series(3000, 7)
    t = time.perf_counter()
    got = range_profiles.profiles_by_ranges(h, low, c, v, 400)
    fast = time.perf_counter() - t
    views = [np.lib.stride_tricks.sliding_window_view(x, 400) for x in (h, low, c, v)]
    t = time.perf_counter()
    want = np.concatenate([profiles.window_profiles(*(x[i : i + 50] for x in views)) for i in range(0, 600, 50)])
    whole = (time.perf_counter() - t) * 2601 / 600
    assert np.allclose(got[:600], want, rtol=0, atol=1e-9) and fast < whole / 3


def test_blocks_of_a_series(spark):
    rows = []
    for s, n in (("BIG", 300), ("small", 20), ("none", 3)):
        h, low, c, v = series(n, len(s))
        rows += [(s, "t", "1h", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i + (i // 50) * 100), float(c[i]), float(h[i]), float(low[i]), float(c[i]), int(v[i]) or None) for i in range(n)]
    bars = spark.createDataFrame(rows, BARS)
    key = lambda df: sorted(str(tuple(round(x, 8) if isinstance(x, float) else x for x in r)) for r in df.collect())
    assert key(range_profiles.add_rolling_profile(bars, 12, 40)) == key(profiles.add_rolling_profile(bars, 12))
    assert range_profiles.add_rolling_profile(bars.limit(0), 12).count() == 0
