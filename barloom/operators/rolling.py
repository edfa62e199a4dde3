"""Columns over a finite number of bars; each function adds its columns to a frame of bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import full, lag, ratio, series


def sma(n: int, source: str = "close") -> Column:
    return full(F.avg, F.col(source), n)


def bollinger(n: int, source: str = "close", width: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle and lower band; population deviation."""
    x = F.col(source)
    mid, sd = full(F.avg, x, n), full(F.stddev_pop, x, n)
    return mid + width * sd, mid, mid - width * sd


def rolling(kind: str, source: str, window: int, shift: int = 0) -> Column:
    """max, min, mean or std (sample) of a full window, of ``shift`` bars ago.

    The shift moves the frame, so one window does both."""
    agg = {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_samp}[kind]
    w = series().rowsBetween(-(window - 1) - shift, -shift)
    return F.when(F.count(F.col(source)).over(w) >= window, agg(F.col(source)).over(w))


def swing_high(n: int = 20, least: int = 5) -> Column:
    return full(F.max, F.col("high"), n, least)


def swing_low(n: int = 20, least: int = 5) -> Column:
    return full(F.min, F.col("low"), n, least)


def relative_volume(n: int = 20) -> Column:
    return ratio(F.col("volume"), full(F.avg, F.col("volume"), n))


def efficiency(bars: DataFrame, n: int = 10) -> DataFrame:
    """Adds ``ker``: net change over the sum of absolute changes of n bars."""
    c = F.col("close")
    moved = bars.withColumn("_d", F.abs(c - lag(c)))
    return moved.withColumn("ker", ratio(F.abs(c - lag(c, n)), full(F.sum, F.col("_d"), n))).drop("_d")


def yang_zhang(bars: DataFrame, n: int = 20) -> DataFrame:
    """Adds ``yang_zhang``: overnight, open-to-close and Rogers-Satchell variances of n bars, annualised."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    pos = (o > 0) & (h > 0) & (low > 0) & (c > 0)
    ln = lambda a, b: F.when(pos & (b > 0), F.ln(a / F.nullif(b, F.lit(0.0))))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    parts = bars.withColumns({"_o": ln(o, lag(c)), "_c": ln(c, o), "_r": ln(h, c) * ln(h, o) + ln(low, c) * ln(low, o)})
    var = full(F.var_samp, F.col("_o"), n) + k * full(F.var_samp, F.col("_c"), n) + (1 - k) * full(F.avg, F.col("_r"), n)
    return parts.withColumn("yang_zhang", F.sqrt(F.greatest(var, F.lit(0.0))) * math.sqrt(252)).drop("_o", "_c", "_r")


def true_range() -> Column:
    """The first bar's previous close is its own."""
    h, low, p = F.col("high"), F.col("low"), F.coalesce(lag("close"), F.col("close"))
    return F.greatest(h - low, F.abs(h - p), F.abs(low - p))


def cumulative_vwap() -> Column:
    """Volume-weighted price since the start of the series."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("volume")
    p = (F.col("high") + F.col("low") + F.col("close")) / 3
    return ratio(F.sum(p * v).over(w), F.sum(v).over(w))
