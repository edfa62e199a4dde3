"""Candle archives as a data source of Spark: one partition for each chunk, pruned before anything is read.

An archive holds the answers of an exchange, a folder for each chunk of a series:
``{folder}/symbol=S/interval=I/chunk={first}_{end}/*`` with one candle object ``{t, o, h, l, c, v}`` a line
(times in milliseconds). Listing the folders plans the scan: conditions on symbol, interval, source and time
reach the planner, and chunks that can't hold a wanted bar are no partitions at all.

    spark.dataSource.register(CandleSource)
    spark.read.format("candles").option("path", folder).load().where("symbol = 'BTC' AND ts >= '2024-01-03'")
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from barloom.schema import BARS, SECONDS

#: Bars of a chunk.
CHUNK = 5000
_ARROW = pa.schema([("symbol", pa.string()), ("source", pa.string()), ("interval", pa.string()), ("ts", pa.timestamp("us")), *[(c, pa.float64()) for c in ("open", "high", "low", "close")], ("volume", pa.int64())])
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass
class Chunk(InputPartition):
    """A stretch of a series, half open, in milliseconds, and its files."""

    symbol: str
    interval: str
    first: int
    end: int
    files: tuple[str, ...]


def _millis(value: dt.datetime | str) -> int:
    at = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    if at.tzinfo is not None:
        at = at.astimezone(dt.UTC).replace(tzinfo=None)
    return (at - _EPOCH) // dt.timedelta(milliseconds=1)


def _files(path: str):
    """File system of a folder (local, or any that Arrow reaches by its address) and the folder's name in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[Chunk]:
    """All chunks of an archive, by symbol, interval and time."""
    from pyarrow import fs

    system, folder = _files(path)
    found: dict[tuple, list[str]] = {}
    for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
        parts = dict(x.split("=", 1) for x in info.path.split("/") if "=" in x)
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")) and {"symbol", "interval", "chunk"} <= set(parts):
            first, _, end = parts["chunk"].partition("_")
            found.setdefault((unquote(parts["symbol"]), unquote(parts["interval"]), int(first), int(end)), []).append(info.path)
    return [Chunk(*k, tuple(sorted(v))) for k, v in sorted(found.items())]


def history(chunks: list[Chunk], most: int | None = None) -> list[Chunk]:
    """Of each series the chunks back from the newest one up to the first gap, ``most`` of them at most."""
    kept: dict[tuple, list[Chunk]] = {}
    for c in sorted(chunks, key=lambda c: -c.first):
        own = kept.setdefault((c.symbol, c.interval), [])
        if not own or own[-1] is not None and c.end >= own[-1].first:
            own.append(c)
        elif own[-1] is not None:
            own.append(None)  # the gap: nothing before it counts
    return sorted((c for own in kept.values() for c in [x for x in own if x][:most]), key=lambda c: (c.symbol, c.interval, c.first))


class CandleReader(DataSourceReader):
    """Plans chunks from the folder names, and parses one chunk a task."""

    def __init__(self, options: dict):
        self.path, self.source = options["path"], options.get("source", "candles")
        self.backwards, self.most = options.get("history", "false").lower() == "true", options.get("chunks")
        self.since = _millis(options["start"]) if "start" in options else None
        self.until = _millis(options["end"]) if "end" in options else None  # half open
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("symbol", "interval", "source") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed.get(name, values) & values
                continue  # answered here in full
            if name == "ts" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, dt.datetime):
                at = _millis(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.since = max(at, self.since) if self.since is not None else at
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.until = min(at + 1, self.until) if self.until is not None else at + 1
            yield f  # Spark looks at each bar once more

    def partitions(self) -> list[Chunk]:
        chunks = listed(self.path)
        if self.backwards:
            chunks = history(chunks, int(self.most) if self.most else None)
        if self.source not in self.allowed.get("source", {self.source}):
            return []
        return [
            c for c in chunks
            if c.symbol.upper() in self.allowed.get("symbol", {c.symbol.upper()}) and c.interval in self.allowed.get("interval", {c.interval})
            and (self.since is None or c.end > self.since) and (self.until is None or c.first < self.until)
        ]

    def read(self, chunk: Chunk | None) -> Iterator[pa.RecordBatch]:
        if chunk is None:  # no chunk is left
            return
        system, _ = _files(self.path)
        rows = []
        for name in chunk.files:
            with system.open_input_stream(name) as lines:
                rows += [bar for line in lines.read().splitlines() if (bar := parsed(line)) and chunk.first <= bar[0] < chunk.end]
        rows = [r for r in rows if (self.since is None or r[0] >= self.since) and (self.until is None or r[0] < self.until)]
        if rows:
            n = len(rows)
            at, *prices, volume = zip(*sorted(rows, key=lambda r: r[0]), strict=True)
            columns = [[chunk.symbol.upper()] * n, [self.source] * n, [chunk.interval] * n, [t * 1000 for t in at], *prices, volume]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()).cast(t) if pa.types.is_timestamp(t) else pa.array(x, t) for x, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def parsed(line: bytes) -> tuple | None:
    """Time, prices and volume of a candle object; None where it is malformed."""
    try:
        x = json.loads(line)
        volume = x.get("v")
        return int(x["t"]), float(x["o"]), float(x["h"]), float(x["l"]), float(x["c"]), None if volume is None else int(float(volume))
    except (ValueError, TypeError, KeyError, AttributeError, OverflowError):
        return None


class CandleSource(DataSource):
    """Format ``candles``. Options: ``path``; ``source`` (name in the rows); ``start`` and ``end`` (half open); ``history``
    (true: back from the newest chunk to the first gap) with ``chunks`` (at most so many of a series)."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self):
        return BARS

    def reader(self, schema) -> CandleReader:
        return CandleReader(self.options)


def write_archive(bars: DataFrame, folder: str, per_chunk: int = CHUNK) -> None:
    """Bars as an archive: chunks of ``per_chunk`` intervals, each written by one task."""
    length = F.lit(3600)
    for name, seconds in SECONDS.items():
        length = F.when(F.col("interval") == name, seconds).otherwise(length)
    width, at = length * (1000 * per_chunk), F.unix_millis(F.col("ts").cast("timestamp"))
    first = F.floor(at / width) * width
    text = lambda c: F.col(c).cast("string")
    candle = F.to_json(F.struct(at.alias("t"), *[text(c).alias(c[0]) for c in ("open", "high", "low", "close", "volume")]))
    rows = bars.select("symbol", "interval", F.concat_ws("_", first, first + width).alias("chunk"), candle.alias("value"))
    rows.repartition("symbol", "interval", "chunk").write.mode("append").partitionBy("symbol", "interval", "chunk").text(folder)


def read_archive(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The bars of an archive, with conditions pushed into the planning of its chunks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CandleSource)
    reader = spark.read.format("candles").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
