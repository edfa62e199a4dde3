"""Artifacts and results as Parquet folders, keyed by what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import KEY
from barloom.sources.bars import describe, page


def content_key(**inputs: Any) -> str:
    """SHA-256 over all inputs; order of names in lists of indicators doesn't matter."""
    inputs = {k: sorted(v) if k == "indicators" else v for k, v in inputs.items()}
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)


class Store:
    """A folder with ``bars``, ``artifacts/<key>``, ``results`` and documents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write_bars(self, bars: DataFrame) -> None:
        """Partitioned by source and interval, symbols together; only the partitions written change."""
        bars.repartition("source", "interval", "symbol").sortWithinPartitions(*KEY, "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "interval").parquet(f"{self.folder}/bars")

    def bars(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/bars")

    def save_artifact(self, frame: DataFrame, **inputs: Any) -> str:
        """Writes the frame unless one of the same inputs is there; returns its key."""
        key = content_key(**inputs)
        path = f"{self.folder}/artifacts/{key}"
        if self._deleted("artifacts").where(F.col("gone") == key).count():
            key = content_key(again=str(uuid.uuid4()), **inputs)
            path = f"{self.folder}/artifacts/{key}"
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            frame.write.mode("overwrite").parquet(path)
            meta = self.spark.createDataFrame([(key, json.dumps(inputs, sort_keys=True, default=str))], "key string, inputs string")
            meta.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/artifact_list")
        return key

    def artifact(self, key: str, *, start: Any = None, end: Any = None, columns: list[str] | None = None, number: int | None = None, size: int | None = None) -> DataFrame:
        """A frame, or part of it: times from ``start`` to ``end`` (both included), ``columns`` beside the keys, and a
        page of each series where ``size`` is given (counted from 1; without ``number`` the last one)."""
        df = self.spark.read.parquet(f"{self.folder}/artifacts/{key}")
        for bound, keep in ((start, lambda t: F.col("ts") >= t), (end, lambda t: F.col("ts") <= t)):
            if bound is not None:
                df = df.where(keep(F.lit(bound).cast("timestamp_ntz")))
        if columns is not None:
            own = [c for c in (*KEY, "ts") if c in df.columns]
            df = df.select(*own, *[c for c in dict.fromkeys(columns) if c not in own])
        return df if size is None else page(df, number, size, keys=tuple(c for c in KEY if c in df.columns))

    def artifacts(self) -> DataFrame:
        """Newest first; those that were deleted are not among them."""
        gone = self._deleted("artifacts")
        return self.spark.read.parquet(f"{self.folder}/artifact_list").join(gone, F.col("key") == F.col("gone"), "left_anti").orderBy(F.col("created_at").desc())

    def describe_artifact(self, key: str) -> DataFrame:
        return describe(self.artifact(key))

    def _deleted(self, kind: str) -> DataFrame:
        path = f"{self.folder}/deleted_{kind}"
        return self.spark.read.parquet(path).select("gone").distinct() if _exists(self.spark, path) else self.spark.createDataFrame([], "gone string")

    def _mark_deleted(self, kind: str, names: list[str]) -> None:
        """Lists are appended to alone, so a reader never finds one half rewritten."""
        self.spark.createDataFrame([(n,) for n in names], "gone string").withColumn("deleted_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/deleted_{kind}")

    def delete_artifact(self, key: str) -> None:
        """Its frame, and its place in the list. The same inputs may be saved again under a new list entry."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/artifacts/{key}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._mark_deleted("artifacts", [key])

    def delete_expired(self, seconds: int) -> list[str]:
        """Deletes artifacts older than so many seconds; their keys."""
        keys = [r["key"] for r in self.expired(seconds).select("key").collect()]  # a row an artifact
        for key in keys:
            self.delete_artifact(key)
        return keys

    def expired(self, seconds: int) -> DataFrame:
        """Artifacts older than so many seconds."""
        return self.artifacts().where(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created_at") > seconds)

    def save_result(self, rows: DataFrame, name: str) -> str:
        """Kernel rows under a new id."""
        key = f"bt_{uuid.uuid4().hex[:12]}"
        rows.withColumns({"result_id": F.lit(key), "name": F.lit(name)}).write.mode("append").partitionBy("result_id").parquet(f"{self.folder}/results")
        return key

    def result(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results").where(F.col("result_id") == key)

    def delete_result(self, key: str) -> None:
        self._mark_deleted("results", [key])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/results/result_id={key}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results").groupBy("result_id", "name").agg(F.count_if(F.col("kind") == "trade").alias("trades"))

    def save_document(self, name: str, document: str, tags: list[str] | None = None) -> None:
        """A later document of a name stands for earlier ones."""
        self.spark.createDataFrame([(name, document, tags or [])], "name string, document string, tags array<string>").withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/documents")

    def delete_document(self, name: str) -> None:
        """Marked by an empty document; one saved later under the name counts again."""
        self.spark.createDataFrame([(name, None, [])], "name string, document string, tags array<string>").withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/documents")

    def documents(self) -> DataFrame:
        d = self.spark.read.parquet(f"{self.folder}/documents")
        last = d.groupBy("name").agg(F.max_by(F.struct("document", "tags", "saved_at"), "saved_at").alias("x"), F.min("saved_at").alias("created_at"))
        return last.where("x.document IS NOT NULL").select("name", "x.document", "x.tags", "created_at")

    def missing_columns(self, key: str, required: list[str]) -> list[str]:
        """Required columns that an artifact doesn't have, in their order."""
        have = set(self.artifact(key).columns)
        return [c for c in dict.fromkeys(required) if c not in have]
