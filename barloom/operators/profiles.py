"""Volume and time profiles over 100 price buckets: by session, by several sessions, by bars.

Bars explode into their buckets and sums run per group and bucket, so a group is never gathered;
only the 100 sums of a group form an array. A bar's weights by bucket, and the value areas of arrays,
are numpy over Arrow batches of many bars or groups at a time. The profile that ends at every bar
has a range of its own each time; it is computed per series, over many windows at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import KEY, ratio, session

BUCKETS, SHARE, MARGIN, OUTSIDE = 100, 0.68, 0.02, 0.1
_SIGMA = 2 * math.sqrt(math.log(2))


def spread_volume(start, size, tp, sigma, volume, high, low) -> np.ndarray:
    """Volume of bars (any shape) by bucket, as a further axis: normal around the typical price, a tenth of
    the density outside the bar's range. A bar without deviation puts all into the nearest bucket; where all
    densities vanish it adds nothing."""
    start, size, tp, sigma, volume, high, low = (np.asarray(x, float)[..., None] for x in (start, size, tp, sigma, volume, high, low))
    centre = start + size / 2 + np.arange(BUCKETS) * size
    z = (centre - tp) / np.where(sigma > 0, sigma, 1.0)
    weight = np.exp(-0.5 * z * z)
    weight *= np.where((centre + size / 2 < low) | (centre - size / 2 > high), OUTSIDE, 1.0)
    nearest = np.argmin(np.round(np.abs(centre - tp), 9), axis=-1)[..., None] == np.arange(BUCKETS)
    weight = np.where(sigma > 0, weight, nearest)
    total = weight.sum(axis=-1, keepdims=True)
    return np.where(total > 0, weight / np.where(total > 0, total, 1.0), 0.0) * np.where(volume > 0, volume, 0.0)


def value_areas(profiles: np.ndarray, poc: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inclusive first and last bucket, and sum, of the areas that grow from the points of control, all rows at
    once: down only where below holds more than above, until an area holds the share or all buckets."""
    row, lo, hi = np.arange(len(poc)), poc.copy(), poc.copy()
    padded = np.pad(profiles, ((0, 0), (1, 1)), constant_values=-1.0)
    got = profiles[row, poc]
    for _ in range(BUCKETS - 1):
        grows = (got < total * SHARE) & ((lo > 0) | (hi < BUCKETS - 1))
        if not grows.any():
            break
        below, above = padded[row, lo], padded[row, hi + 2]
        down = (below > above) | (hi == BUCKETS - 1)
        got = got + np.where(grows, np.where(down, below, above), 0.0)
        lo, hi = lo - (grows & down), hi + (grows & ~down)
    return lo, hi, got


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _volume_by_bucket(start: pd.Series, size: pd.Series, tp: pd.Series, sigma: pd.Series, volume: pd.Series, high: pd.Series, low: pd.Series) -> pd.Series:
    return pd.Series(list(spread_volume(start, size, tp, sigma, volume, high, low)), dtype=object)


@F.pandas_udf(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("sum", T.DoubleType())]))
def _value_area(profile: pd.Series, poc: pd.Series, total: pd.Series) -> pd.DataFrame:
    if not len(poc):
        return pd.DataFrame({"lo": [], "hi": [], "sum": []})
    lo, hi, got = value_areas(np.stack(profile.to_list()), poc.to_numpy(np.int64), total.to_numpy(float))
    return pd.DataFrame({"lo": lo, "hi": hi, "sum": got})


def _bucketed(bars: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    spread = F.col("_hi") - F.col("_lo")
    return (
        bars.withColumns({"_hi": F.max("high").over(w), "_lo": F.min("low").over(w)})
        .withColumn("_min", F.col("_lo") - spread * MARGIN)
        .withColumn("_size", ((F.col("_hi") + spread * MARGIN) - F.col("_min")) / BUCKETS)
    )


def _centre(i: Column) -> Column:
    return F.col("_min") + F.col("_size") / 2 + i * F.col("_size")


def _weights(df: DataFrame, price_sigma: bool) -> DataFrame:
    """Adds ``_part``: a bar's volume by bucket, normal around the typical price. The deviation is
    the bar's Parkinson log range (times the price with ``price_sigma``); a bar without range puts
    all into the nearest bucket; where all densities vanish it adds nothing."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    log_range = F.when((F.col("low") > 0) & (F.col("high") > F.col("low")), F.ln(F.col("high") / F.nullif(F.col("low"), F.lit(0.0))) / _SIGMA)
    df = df.withColumns({"_tp": tp, "_sigma": F.coalesce(log_range * (tp if price_sigma else 1.0), F.lit(0.0)), "_v": F.when(F.col("volume") > 0, F.col("volume").cast("double")).otherwise(0.0)})
    return df.withColumn("_part", _volume_by_bucket("_min", "_size", "_tp", "_sigma", "_v", "high", "low"))


def _touched(df: DataFrame) -> DataFrame:
    """Adds ``_part``: time units of a bar in each bucket that its range meets (two for bars of an hour or more)."""
    units = F.when(F.col("interval").isin("5min", "15min", "30min"), 1.0).otherwise(2.0)
    meets = lambda i: (_centre(i) + F.col("_size") / 2 >= F.col("low")) & (_centre(i) - F.col("_size") / 2 <= F.col("high"))
    return df.withColumn("_v", units).withColumn("_part", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.when(meets(i), F.col("_v")).otherwise(0.0)))


def profile(bars: DataFrame, keys: list[str], *, time: bool = False, price_sigma: bool = False) -> DataFrame:
    """``poc, vah, val, total, area, bucket_size, profile`` of each group of bars.

    Without range: all at the high (val: the low), total 0. Without volume: the last close, the
    highest high and the lowest low. Bucket sums are rounded to 8 places, so ties are ties.
    """
    df = _bucketed(bars, keys)
    df = _touched(df) if time else _weights(df, price_sigma)
    whole = [F.first(c).alias(c) for c in ("_hi", "_lo", "_min", "_size")] + [F.max_by("close", "ts").alias("_last"), F.sum("_v").alias("_total")]
    sums = (
        df.select(*keys, F.posexplode("_part").alias("_i", "_x"))
        .groupBy(*keys, "_i")
        .agg(F.round(F.sum("_x"), 8).alias("_x"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_a"))
        .select(*keys, F.transform("_a", lambda s: s["_x"]).alias("profile"))
    )
    out = df.groupBy(*keys).agg(*whole).join(sums, keys).withColumn("_poc", (F.array_position("profile", F.array_max("profile")) - 1).cast("int"))
    out = out.withColumn("_area", _value_area("profile", "_poc", "_total"))
    flat, none = F.col("_hi") <= F.col("_lo"), F.col("_total") <= 0
    edge = lambda side, sign: _centre(F.col(f"_area.{side}")) + sign * F.col("_size") / 2
    return out.select(
        *keys,
        F.when(flat, F.col("_hi")).when(none, F.col("_last")).otherwise(_centre(F.col("_poc"))).alias("poc"),
        F.when(flat | none, F.col("_hi")).otherwise(edge("hi", 1)).alias("vah"),
        F.when(flat | none, F.col("_lo")).otherwise(edge("lo", -1)).alias("val"),
        F.when(flat, 0.0).otherwise(F.col("_total")).alias("total"),
        F.when(flat | none, 0.0).otherwise(F.col("_area.sum")).alias("area"),
        F.when(flat, 0.0).otherwise(F.col("_size")).alias("bucket_size"),
        F.when(~flat & ~none, F.col("profile")).alias("profile"),
    )


def _by_day(bars: DataFrame) -> DataFrame:
    return bars.withColumn("day", session())


def session_profiles(bars: DataFrame, *, time: bool = False, price_sigma: bool = False) -> DataFrame:
    return profile(_by_day(bars), [*KEY, "day"], time=time, price_sigma=price_sigma)


def _onto(bars: DataFrame, days: DataFrame) -> DataFrame:
    return _by_day(bars).join(days, [*KEY, "day"], "left").drop("day")


def _named(p: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    return p.select(*KEY, "day", *[F.col(c).alias(f"{prefix}_{c}{suffix}") for c in ("poc", "vah", "val")])


def add_session_profile(bars: DataFrame, *, price_sigma: bool = False) -> DataFrame:
    """Adds ``vp_poc, vp_vah, vp_val``."""
    return _onto(bars, _named(session_profiles(bars, price_sigma=price_sigma), "vp"))


def add_time_profile(bars: DataFrame) -> DataFrame:
    """Adds ``mp_poc, mp_vah, mp_val``."""
    return _onto(bars, _named(session_profiles(bars, time=True), "mp"))


def add_median_profile(bars: DataFrame, n: int) -> DataFrame:
    """Adds ``vp_*_{n}d``: medians over the last n sessions, null before n; needs ``vp_*``."""
    w = Window.partitionBy(*KEY).orderBy("day").rowsBetween(-(n - 1), 0)
    days = _by_day(bars).groupBy(*KEY, "day").agg(*[F.max(f"vp_{c}").alias(c) for c in ("poc", "vah", "val")])
    median = lambda c: F.when(F.count(F.lit(1)).over(w) >= n, F.percentile(c, F.lit(0.5)).over(w)).alias(f"vp_{c}_{n}d")
    return _onto(bars, days.select(*KEY, "day", *map(median, ("poc", "vah", "val"))))


def add_composite_profile(bars: DataFrame, n: int) -> DataFrame:
    """Adds ``cvp_*_{n}d``: one profile over all bars of the last n sessions, null before n.

    Each bar goes to the n sessions that it counts in; no range join."""
    days = _by_day(bars).select(*KEY, "day").distinct().withColumn("_s", F.row_number().over(Window.partitionBy(*KEY).orderBy("day")))
    last = days.groupBy(*KEY).agg(F.max("_s").alias("_last"))
    rows = _by_day(bars).join(days, [*KEY, "day"]).join(last, list(KEY))
    rows = rows.withColumn("_t", F.explode(F.sequence("_s", F.least(F.col("_s") + n - 1, F.col("_last"))))).where(F.col("_t") >= n)
    p = profile(rows.drop("day", "_s", "_last"), [*KEY, "_t"]).join(days.withColumnRenamed("_s", "_t"), [*KEY, "_t"])
    return _onto(bars, _named(p, "cvp", f"_{n}d"))


def window_profiles(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Point of control and value area of windows of bars (a row each)."""
    hi, lo, v = h.max(axis=1), low.min(axis=1), np.where(v > 0, v, 0.0)
    start = lo - (hi - lo) * MARGIN
    size = ((hi + (hi - lo) * MARGIN) - start) / BUCKETS
    ranged = (low > 0) & (h > low)
    sigma = np.where(ranged, np.log(np.where(ranged, h, 1.0) / np.where(ranged, low, 1.0)) / _SIGMA, 0.0)
    total = np.round(spread_volume(*np.broadcast_arrays(start[:, None], size[:, None], (h + low + c) / 3), sigma, v, h, low).sum(axis=1), 8)
    poc, traded = total.argmax(axis=1), v.sum(axis=1)
    a, b, _ = value_areas(total, poc, traded)
    centre = lambda i: start + size / 2 + i * size
    out = np.stack([centre(poc), centre(b) + size / 2, centre(a) - size / 2], axis=1)
    out[traded <= 0] = np.stack([c[:, -1], hi, lo], axis=1)[traded <= 0]
    flat = hi <= lo
    out[flat] = np.stack([hi, hi, lo], axis=1)[flat]
    return out


def add_rolling_profile(bars: DataFrame, n: int) -> DataFrame:
    """Adds ``rvp_poc_{n}, rvp_vah_{n}, rvp_val_{n}``: the profile of the last n bars at every bar.

    A series is one group of a task; its windows are computed in blocks of bounded size."""
    names = [f"rvp_{c}_{n}" for c in ("poc", "vah", "val")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        columns = [rows[x].fillna(0).to_numpy(float) if x == "volume" else rows[x].to_numpy(float) for x in ("high", "low", "close", "volume")]
        out, step = np.full((len(rows), 3), np.nan), max(1, (1 << 21) // (n * BUCKETS))
        if len(rows) >= n:
            views = [np.lib.stride_tricks.sliding_window_view(x, n) for x in columns]
            for i in range(0, len(rows) - n + 1, step):
                block = window_profiles(*(x[i : i + step] for x in views))
                out[n - 1 + i : n - 1 + i + len(block)] = block
        return rows.assign(**{k: out[:, j] for j, k in enumerate(names)})

    schema = T.StructType([*bars.schema.fields, *[T.StructField(k, T.DoubleType()) for k in names]])
    return bars.groupBy(*KEY).applyInPandas(run, schema)


def add_profile_shape(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Adds ``profile_shape`` of the session: NORMAL, B_SHAPE, P_SHAPE, D_SHAPE or NEUTRAL.

    NEUTRAL where a series has under five sessions or under half the mean volume of up to 20
    earlier ones. Empty buckets are left out before places are compared, ends at 30 and 70 %."""
    w = Window.partitionBy(*KEY)
    days = session_profiles(bars)
    volume = _by_day(bars).groupBy(*KEY, "day").agg(F.sum("volume").cast("double").alias("_v"))
    days = days.join(volume, [*KEY, "day"]).withColumn("_sessions", F.count(F.lit(1)).over(w))
    days = days.withColumn("_mean", F.avg("_v").over(w.orderBy("day").rowsBetween(-lookback, -1)))
    days = days.withColumn("_a", F.filter("profile", lambda x: x > 0)).withColumn("_n", F.size("_a"))
    days = days.withColumn("_top", F.array_max("_a")).withColumn("_at", (F.array_position("_a", F.col("_top")) - 1).cast("int"))
    far = F.exists(
        F.transform("_a", lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: (s["i"] != F.col("_at")) & (F.abs(s["i"] - F.col("_at")) >= F.floor(F.col("_n") * 0.15)) & (s["x"] > F.col("_top") * 0.5),
    )
    place = ratio(F.col("_at"), F.col("_n") - 1)
    shape = (
        F.when(F.col("profile").isNull() | (F.col("_sessions") < 5) | (F.col("_n") < 10), "NEUTRAL")
        .when(F.coalesce((F.col("_mean") > 0) & (F.col("total") < F.col("_mean") * 0.5), F.lit(False)), "NEUTRAL")
        .when(far, "B_SHAPE").when(place < 0.3, "P_SHAPE").when(place > 0.7, "D_SHAPE").otherwise("NORMAL")
    )
    return _onto(bars, days.select(*KEY, "day", shape.alias("profile_shape")))
