"""Schemas and the windows that every bar operator shares."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A series: one symbol of one source at one interval.
KEY = ("symbol", "source", "interval")

BARS = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in KEY],
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("volume", T.LongType()),
    ]
)
DERIVATIVES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("funding_rate", "open_interest", "open_interest_usd", "cvd", "long_short_ratio", "liquidations_long", "liquidations_short", "basis", "mark_price", "index_price")]
)
SYMBOLS = "symbol string, name string, sector string, market_cap double"

#: Interval lengths in seconds; other intervals count as closed at once in as-of joins.
SECONDS = {"5min": 300, "30min": 1800, "1h": 3600, "1d": 86400, "1w": 604800}


def series() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("ts")


def last_n(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def before_n(n: int) -> WindowSpec:
    return series().rowsBetween(-n, -1)


def full(agg, x: Column, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n bars, null until ``least`` (n) of them have a value."""
    return F.when(F.count(x).over(last_n(n)) >= (least or n), agg(x).over(last_n(n)))


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(series())


def flag(x: Column) -> Column:
    """A condition that is false where it is null."""
    return F.coalesce(x, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def session() -> Column:
    return F.to_date("ts")
