"""Ticks to bars as a structured stream, and upserts of its batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import SECONDS
from barloom.sources.bars import upsert


def stream_bars(ticks: DataFrame, interval: str, *, symbol: str = "symbol", price: str = "price", ts: str = "ts", late: str = "1 hour", source: str = "stream") -> DataFrame:
    """Bars of closed windows from a stream of ticks; ticks later than ``late`` are left out.

    ``ts`` is a timestamp with zone (watermarks need one)."""
    bars = ticks.withWatermark(ts, late).groupBy(F.window(ts, f"{SECONDS[interval]} seconds").alias("w"), F.upper(symbol).alias("symbol"))
    out = bars.agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select("symbol", F.lit(source).alias("source"), F.lit(interval).alias("interval"), F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def upsert_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each batch is merged with the newest version before it and written as one of
    its own number. A batch that is run again writes the same version again; numbers may have gaps."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        done = [int(n[1:]) for n in names if n[1:].isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        before = max((n for n in done if n < number), default=None)
        rows = batch if before is None else upsert(spark.read.parquet(f"{folder}/v{before}"), batch)
        rows.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return run
