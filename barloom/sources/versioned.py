"""A table of bars with versions: a log of manifests over immutable files.

Bars lie in buckets by hash of their series. A version is one small manifest that lists the live folders of each
bucket; it is committed by a rename that fails where the version exists, so of two writers one starts over from
the newer version. An upsert writes only its own bars, a folder of changes for each bucket it touches; readers take
the last bar of a key over the folders of its bucket. Compaction rewrites buckets with many folders, a deletion the
buckets of its series, and ``clean`` deletes files that no kept version lists. Readers of an older version are never disturbed.

    table = BarTable(spark, folder)
    table.upsert(bars); table.upsert(more, batch=("ticks", 7)); table.compact(); table.read(symbol="BTC")
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import BARS, KEY
from barloom.sources.bars import delete as without
from barloom.sources.bars import scan

BUCKETS = 32


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Manifest:
    """One version: the live folders of each bucket, oldest first, and the last batch of each stream."""

    version: int = -1
    buckets: int = BUCKETS
    live: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class BarTable:
    """A folder with ``log/<version>.json`` and ``data/<write>/bucket=<n>``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # ------------------------------------------------------------ the log
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        files, path = self._files(), self._path(name)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the newest without a number; an empty one where there is none yet."""
        known = self.versions()
        if version is None:
            if not known:
                return Manifest(buckets=self.buckets)
            version = known[-1]
        if version not in known:
            raise KeyError(f"no version {version}")
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/log/{version:08}.json").collect())  # one small file
        return Manifest(**json.loads(text))

    def _commit(self, before: Manifest, live: dict[str, list[str]], batch: tuple[str, int] | None = None) -> Manifest:
        """The next version, by a rename that fails where it is there already."""
        made = Manifest(before.version + 1, before.buckets, {k: v for k, v in live.items() if v}, before.batches | ({batch[0]: batch[1]} if batch else {}))
        files, held, final = self._files(), self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{made.version:08}.json")
        files.mkdirs(self._path("log"))
        out = files.create(held, True)
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        if files.exists(final) or not files.rename(held, final):
            files.delete(held, False)
            raise Conflict(f"version {made.version} is there already")
        return made

    def _again(self, change: Callable[[Manifest], Manifest], tries: int = 10) -> Manifest:
        for k in range(tries):
            try:
                return change(self.manifest())
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    # ------------------------------------------------------------ writing
    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.hash(*[F.upper(k) if k == "symbol" else F.col(k) for k in KEY]), F.lit(buckets))

    def _write(self, bars: DataFrame, buckets: int) -> dict[str, str]:
        """A new folder of changes; the bucket folders that it has. One task writes one bucket's bars."""
        name = uuid.uuid4().hex
        rows = bars.withColumn("symbol", F.upper("symbol")).withColumn("bucket", self._bucket(buckets))
        rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", *KEY, "ts").write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
        return {n.removeprefix("bucket="): f"{name}/{n}" for n in self._names(f"data/{name}") if n.startswith("bucket=")}

    def upsert(self, bars: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Bars in the place of stored ones by key; of one key in ``bars`` any wins. ``batch`` (stream, number): a batch
        that is not newer than the stream's last one changes nothing, so batches may be run again. The version."""
        bars = bars.select(*BARS.names)
        first = self.manifest()
        if batch and first.batches.get(batch[0], -1) >= batch[1]:
            return first.version
        made = self._write(bars, first.buckets)

        def change(m: Manifest) -> Manifest:
            if batch and m.batches.get(batch[0], -1) >= batch[1]:
                return m
            return self._commit(m, {k: m.live.get(k, []) + ([made[k]] if k in made else []) for k in {*m.live, *made}}, batch)

        return self._again(change).version

    def _rewritten(self, m: Manifest, buckets: list[str], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Manifest:
        made = self._write(keep(self._rows(m, buckets)), m.buckets)
        return self._commit(m, {k: ([made[k]] if k in made else []) if k in buckets else v for k, v in m.live.items()})

    def delete(self, symbol: str, source: str | None = None, interval: str | None = None, before=None) -> int:
        """A version without the bars of a symbol (of a source, interval, before a time): only buckets that hold some are rewritten."""

        def change(m: Manifest) -> Manifest:
            rows = self._rows(m, sorted(m.live))
            stay = without(rows, symbol, source, interval, before)
            hit = rows.join(stay.select(*KEY, "ts"), [*KEY, "ts"], "left_anti").select(self._bucket(m.buckets).alias("b")).distinct().collect() if m.live else []  # at most as many as buckets
            return self._rewritten(m, [str(r.b) for r in hit], lambda df: without(df, symbol, source, interval, before)) if hit else m

        return self._again(change).version

    def compact(self, most: int = 4) -> int:
        """A version in which buckets with more than ``most`` folders have one."""

        def change(m: Manifest) -> Manifest:
            many = [k for k, v in m.live.items() if len(v) > most]
            return self._rewritten(m, many) if many else m

        return self._again(change).version

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last ``keep``, and the folders that none of these lists; writes that are under
        way have no manifest yet, so no other writer may be at work. The names of what went."""
        known, files, gone = self.versions(), self._files(), []
        needed = {p for v in known[-keep:] for own in self.manifest(v).live.values() for p in own}
        for v in known[:-keep]:
            files.delete(self._path(f"log/{v:08}.json"), False)
        for name in self._names("data"):
            for part in [n for n in self._names(f"data/{name}") if n.startswith("bucket=")]:
                if f"{name}/{part}" not in needed:
                    files.delete(self._path(f"data/{name}/{part}"), True)
                    gone.append(f"{name}/{part}")
            if not any(p.startswith(f"{name}/") for p in needed):
                files.delete(self._path(f"data/{name}"), True)
        return sorted(gone)

    # ------------------------------------------------------------ reading
    def _rows(self, m: Manifest, buckets: list[str]) -> DataFrame:
        """The last bar of each key: buckets with one folder are read as they are, others by an aggregate."""
        folder = lambda p: f"{self.folder}/data/{p}"
        one = [m.live[b][0] for b in buckets if len(m.live[b]) == 1]
        many = [(n, p) for b in buckets if len(m.live[b]) > 1 for n, p in enumerate(m.live[b])]
        read = lambda paths: self.spark.read.schema(BARS).parquet(*map(folder, paths))
        parts = [read(one)] if one else []
        if many:
            by_age: dict[int, list[str]] = {}
            for n, p in many:
                by_age.setdefault(n, []).append(p)
            aged = [read(paths).withColumn("_age", F.lit(n)) for n, paths in sorted(by_age.items())]
            rows = aged[0]
            for more in aged[1:]:
                rows = rows.unionByName(more)
            rest = [c for c in BARS.names if c not in (*KEY, "ts")]
            last = rows.groupBy(*KEY, "ts").agg(F.max_by(F.struct(*rest), "_age").alias("_row"))
            parts.append(last.select(*KEY, "ts", *[F.col(f"_row.{c}").alias(c) for c in rest]))
        if not parts:
            return self.spark.createDataFrame([], BARS)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, version: int | None = None, symbol: str | None = None, source: str | None = None, interval: str | None = None, start=None, end=None) -> DataFrame:
        """Bars of a version (the newest), of a series and between two times, both included. Where the whole key is
        given, one bucket's folders are listed and read; conditions reach the Parquet scan."""
        m = self.manifest(version)
        buckets = sorted(m.live)
        if symbol is not None and source is not None and interval is not None:
            key = self.spark.createDataFrame([(symbol, source, interval)], ", ".join(f"{k} string" for k in KEY))
            own = str(key.select(self._bucket(m.buckets).alias("b")).first().b)
            buckets = [b for b in buckets if b == own]
        return scan(self._rows(m, buckets), symbol, source, interval, start, end)


def into_table(table: BarTable, stream: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: upserts of batches, each committed once though it may be run again."""
    return lambda batch, number: table.upsert(batch, (stream, number)) and None
