"""Backward as-of joins of slower timeframes, without look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import SECONDS

PRICES = ("open", "high", "low", "close", "volume")


def _seconds(interval: str) -> Column:
    return F.expr(f"INTERVAL '{SECONDS.get(interval, 0)}' SECOND")


def asof_join(primary: DataFrame, slow: DataFrame, interval: str, columns: list[str] | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ``{column}_{interval}`` of the newest slow bar that has closed at each primary bar.

    A slow bar counts from ``ts`` plus its interval on, that moment included. Of several with one
    time the last wins, rows without any value are skipped, a null cell of the chosen row stays
    null. One shuffle and one sort by series: both sides are united and the last slow row is
    carried forward by a window, so no pair of rows is ever formed.
    """
    columns = columns or [c for c in slow.columns if c not in (*by, "source", "interval", "ts", *PRICES)]
    some = F.coalesce(*[F.col(c).cast("string") for c in columns])
    info = slow.where(some.isNotNull()).groupBy(*by, (F.col("ts") + _seconds(interval)).alias("ts")).agg(F.max_by(F.struct(*columns), "ts").alias("_slow"))
    rows = primary.withColumns({"_slow": F.lit(None).cast(info.schema["_slow"].dataType), "_own": F.lit(1)}).unionByName(info.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("ts", "_own").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_slow", F.last("_slow", ignorenulls=True).over(w)).where("_own = 1")
    return found.select(*primary.columns, *[F.col(f"_slow.{c}").alias(f"{c}_{interval}") for c in columns])


def asof_chain(primary: DataFrame, slower: list[tuple[DataFrame, str]], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One as-of join after the other; at most three slower timeframes."""
    if len(slower) > 3:
        raise ValueError("at most three slower timeframes")
    for frame, interval in slower:
        primary = asof_join(primary, frame, interval, by=by)
    return primary


#: Blocks of members that the grid of ``spine_fill`` is made from.
BLOCKS = 64


def spine_fill(series: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """Every time of any member for every member: its value then, else its last earlier one, else 0.

    The result itself has times x members rows; it is made by an equal join of times with blocks of members."""
    member = series.select(by).distinct().withColumn("_block", F.pmod(F.xxhash64(by), F.lit(BLOCKS)))
    members = member.groupBy("_block").agg(F.collect_list(by).alias("_members"))
    times = series.select("ts").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    grid = times.join(members, "_block").select("ts", F.explode("_members").alias(by))
    rows = grid.join(series.select(by, "ts", value), [by, "ts"], "left")
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0.0)))
