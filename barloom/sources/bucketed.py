"""Bars in a bucketed table: windows over a series and joins of series need no shuffle.

The table is bucketed and sorted by the key of a series, so a scan already stands where a window, a grouped pass or
a join by series wants it. The number of buckets is a property of the table: choose it for its final size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.schema import KEY


def write_bucketed(bars: DataFrame, name: str, buckets: int, *, path: str | None = None) -> None:
    """Writes the bars as table ``name``, one file a bucket (the series of a bucket meet in one task once, here)."""
    writer = bars.repartition(buckets, *KEY).write.mode("overwrite").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY, "ts")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def shuffles(df: DataFrame) -> int:
    """Exchanges of the physical plan, broadcasts aside."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum(1 for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line and "ReusedExchange" not in line)
