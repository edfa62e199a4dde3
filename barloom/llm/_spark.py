"""Small Spark helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the whole subpackage: everything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch in the pipeline.
BATCH = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches hold ``BATCH`` bytes at most, or less where the session says so.

    A batch stands in the JVM's memory beside the heap, and several times over in its Python worker; workers
    keep what they once took from stage to stage. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}.get(unit[:1], 40)
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; unset, a temporary one on a single machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or tempfile.mkdtemp(prefix="barloom-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the checkpoint folder that the cluster names.

    Spark keeps the files of a plan's shuffles until its garbage collector finds the plan gone; a
    collection after each cut keeps no more than one round of them on disk.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    sc._jvm.System.gc()  # Spark drops shuffle files of plans that nothing refers to any more
    return out


def marked(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """Adds the boolean ``name``: whether the long ``key`` may be among the one column of ``wanted``.

    2^26 bits by hash, as at most 2,048 broadcast rows of 4 KB: no match is missed, some others are marked."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << 26))
    at = place(wanted.columns[0])
    sets = wanted.groupBy(F.shiftright(at, 15).alias("_bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("_bits"))
    inside = place(key).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), inside.bitwiseAND(F.lit(7)))).cast("int").bitwiseAND(F.lit(1))
    found = rows.join(F.broadcast(sets), F.shiftright(place(key), 15) == F.col("_bucket"), "left")
    return found.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bits")


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows that ``marked`` marks, to spare a shuffle rows that can't match."""
    return marked(rows, key, wanted, "_maybe").where("_maybe").drop("_maybe")


class Tables:
    """Tables of one job in the shared folder, compressed; ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        gc.collect()
        self.spark._jvm.System.gc()  # the shuffles of the plans that wrote them go too


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` would fold other scripts too."""
    return F.translate(text, UPPER, UPPER.lower())
