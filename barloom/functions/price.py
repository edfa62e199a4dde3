"""Expressions over one bar."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schema import ratio



def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def typical_price() -> Column:
    h, low, c = _c("high", "low", "close")
    return (h + low + c) / 3


def ohlc4() -> Column:
    o, h, low, c = _c("open", "high", "low", "close")
    return (o + h + low + c) / 4


def ibs() -> Column:
    """Place of the close in the bar's range; null on a zero range."""
    h, low, c = _c("high", "low", "close")
    return ratio(c - low, h - low)


def ibs_or_half() -> Column:
    h, low, c = _c("high", "low", "close")
    return F.when(h - low > 0, (c - low) / F.nullif(h - low, F.lit(0.0))).otherwise(0.5)


def body_share() -> Column:
    o, h, low, c = _c("open", "high", "low", "close")
    return ratio(F.abs(c - o), h - low)


def range_share() -> Column:
    h, low, c = _c("high", "low", "close")
    return ratio(h - low, c)


def _ln(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / F.nullif(b, F.lit(0.0))))


def parkinson() -> Column:
    """Variance ln(H/L)^2 / (4 ln 2); 0 where a price is not positive."""
    h, low = _c("high", "low")
    return F.coalesce(F.pow(_ln(h, low), 2) / (4 * math.log(2)), F.lit(0.0))


def garman_klass() -> Column:
    o, h, low, c = _c("open", "high", "low", "close")
    return F.coalesce(0.5 * F.pow(_ln(h, low), 2) - (2 * math.log(2) - 1) * F.pow(_ln(c, o), 2), F.lit(0.0))


def rogers_satchell() -> Column:
    o, h, low, c = _c("open", "high", "low", "close")
    return F.coalesce(_ln(h, c) * _ln(h, o) + _ln(low, c) * _ln(low, o), F.lit(0.0))


def expected_move(atr: Column) -> Column:
    return 0.8 * atr


def implied_volatility(atr: Column) -> Column:
    """ATR over close, annualised over 252 days; 0 where the close is not positive."""
    c = F.col("close")
    return F.when(c > 0, atr / F.nullif(c, F.lit(0.0)) * math.sqrt(252)).otherwise(0.0)


def open_buffer(atr: Column, sign: int) -> Column:
    return F.col("open") + sign * 0.1 * F.coalesce(atr, F.lit(0.0))


def round_number(price: Column) -> Column:
    """Nearest round price by size of the price (half goes to even)."""
    step = F.when(price < 10, 1.0).when(price < 50, 5.0).when(price < 100, 10.0).when(price < 500, 25.0).otherwise(50.0)
    return F.bround(price / step, 0) * step


def slippage(size: Column, average_volume: Column) -> Column:
    """min(sqrt(size / average volume) / 10, 5 %), 1 % without volume."""
    return F.when(average_volume > 0, F.least(F.sqrt(size / F.nullif(average_volume, F.lit(0.0))) * 0.1, F.lit(0.05))).otherwise(0.01)


def relative_volume(volume: Column, average: Column) -> Column:
    return F.when(average > 0, volume / F.nullif(average, F.lit(0.0))).otherwise(1.0)
