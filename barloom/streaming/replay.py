"""Stored rows as a stream: slices of time as files, and a query over them run to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.shared import new_folder
from barloom.streaming.kernel import PROVIDER


def slices(rows: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """A stream of ``rows`` in about ``n`` slices of time, written one after the other in that order."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "slices")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if ends.a is None:
        rows.write.parquet(folder)
        return spark.readStream.schema(rows.schema).parquet(folder)
    width = (ends.b - ends.a) // n + 1
    part = new_folder(spark, "parts")
    rows.withColumn("_slice", F.floor((at - ends.a) / width)).repartition("_slice").write.partitionBy("_slice").parquet(part)
    for k in range(n):  # the file source takes files by their time of writing
        spark.read.parquet(part).where(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def to_end(stream: DataFrame, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs a streaming query over all that is there, and gives the rows that it wrote."""
    spark = stream.sparkSession
    out, marks = new_folder(spark, "stream-out"), new_folder(spark, "stream-marks")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        result = change(stream)
        query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(result.schema).parquet(out)
