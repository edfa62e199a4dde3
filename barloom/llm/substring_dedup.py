"""Removal of repeated long substrings by distributed prefix doubling over chosen positions.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Ranks of equal
strings are content hashes, so a rank means the same in every task, and the rank of a longer
string is the pair of ranks of its parts at growing offsets (2, 4, ... 64 bytes, then the parts
that make up LENGTH). Spark groups the pairs of all documents; what is unique leaves after each
round, the rest is ranked again at the next offset until strings of LENGTH bytes are told apart:

1. Each window of LENGTH bytes picks the least rank among its 32-byte prefixes. Equal windows pick
   the same place, so only picked places, one of about 35 positions, need to be sorted: a window that
   repeats has a picked place that repeats. Places whose 32-byte rank is unique leave.
2. Units are runs of windows around their place: all windows of the place, then blocks of 8 windows,
   then single windows. A unit's rank pair is the string that all its windows share (``core``) and
   the pair of its first and last window, which is all that it covers (``cover``). Spark groups the
   pairs: units after the first of an equal pair are repeats as a whole. A core that has several
   covers may repeat in part, so its first units go to the next round in smaller runs; units whose
   core has one cover alone leave. In the last round core and cover are the window itself.

A byte of the table is known by one long, the number of its text in the order of ids and its offset in
that text, so that the first of equal units is a plain minimum. Texts of which no unit is asked for
stay out of a round.

Every size of input takes this one plan. No round gathers a group: counts and first places are
aggregates, joins back are ones that Spark can split. Bit sets, sized by what they hold
(``BITS`` bits at most), keep rows that cannot matter out of a shuffle; they never decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._spark import Tables, marked, maybe_in, table
from barloom.llm._text import _BYTE, U, mix, slices, stream

LENGTH = 100
#: Bits of a broadcast set: 8 for each value, at least the first and at most the second number (128 MB).
BITS = (1 << 20, 1 << 30)
#: Windows of a unit in each round; 0 means all windows of a place.
ROUNDS = (0, 8, 1)
#: The id that stands for none.
LEAST = -(2**63)
#: Bytes whose positions are ranked at a time (their ranks stay in the processor's cache).
CHUNK = 1 << 16
_FACTORS = stream(64, 21) | U(1)


def _ranks(data: np.ndarray, upto: int) -> list[np.ndarray]:
    """Ranks of the 1, 2, 4, ... byte strings at every position, by doubling."""
    return _doubled([_BYTE[data]], upto)


def _doubled(levels: list[np.ndarray], upto: int) -> list[np.ndarray]:
    """Adds the ranks of longer strings, up to ``upto`` bytes."""
    k = 1 << (len(levels) - 1)
    while 2 * k <= upto:
        h = levels[-1]
        x = h[: max(0, len(h) - k)] * _FACTORS[len(levels)]
        x += h[k:]
        x ^= x >> U(32)
        levels.append(x)
        k *= 2
    return levels


def _rank_of(levels: list[np.ndarray], length: int, at: np.ndarray) -> np.ndarray:
    """Ranks of the strings of ``length`` bytes at the positions ``at``, from those of its binary parts."""
    out, done = np.full(len(at), length, U), 0
    for k in reversed(range(len(levels))):
        while length - done >= 1 << k:
            out *= _FACTORS[32 + k]
            out += levels[k][at + done]
            out ^= out >> U(29)
            done += 1 << k
    return out


class Places:
    """Picked places of a stretch of texts, each with its run of windows [lo, lo + n)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int):
        gram = 1 << ((length // 3).bit_length() - 1)
        self.levels, self.length = _ranks(data, gram), length
        n = len(data) - length + 1
        self.lo = self.n = self.row = np.zeros(0, np.int64)
        self.g, self.place = np.zeros(0, U), self.lo
        if n <= 0:
            return
        short = self.levels[gram.bit_length() - 1]
        low = U((1 << 24) - 1)
        least = (short & ~low) | np.arange(len(short), dtype=U)
        span, have = length - gram + 1, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        place = (least[:n] & low).astype(np.int64)
        ends = np.repeat(at[1:], np.diff(at))[:n]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
        p = np.flatnonzero(np.arange(n) + length <= ends)  # windows inside one text
        if not len(p):
            return
        new = np.ones(len(p), bool)
        new[1:] = (place[p[1:]] != place[p[:-1]]) | (row[p[1:]] != row[p[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        lo, hi = p[first], p[last]
        self.lo, self.n, self.row, self.place = lo, hi - lo + 1, row[lo], place[lo]
        self.g = mix(short[self.place])

    def units(self, size: int, wanted: list[Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> tuple[np.ndarray, ...]:
        """Owner (place number), first window, number of windows, core and cover of units of up to
        ``size`` windows (0: all of a place). ``wanted`` says of owners and first windows which units
        of the rounds before go on; it filters after each round."""
        own, lo, n = np.arange(len(self.lo)), self.lo, self.n
        for k, keep in enumerate(wanted):
            if k:
                own, lo, n = self._cut(own, lo, n, ROUNDS[k])
            at = np.flatnonzero(keep(own, lo))
            own, lo, n = own[at], lo[at], n[at]
        if size:
            own, lo, n = self._cut(own, lo, n, size)
        _doubled(self.levels, self.length)
        place = self.place[own]
        if size:
            b = (place - lo - n + 1) // size
            core = mix(_rank_of(self.levels, self.length - size + 1, place - size * b) * U(0x9E3779B97F4A7C15) + b.astype(U))
        else:
            core = self.g[own]
        first, last = _rank_of(self.levels, self.length, lo), _rank_of(self.levels, self.length, lo + n - 1)
        cover = mix(mix(first + U(3)) * U(0x9E3779B97F4A7C15) + last + (n * 1024 + place - lo).astype(U))
        return own, lo, n, core, cover

    def _cut(self, own: np.ndarray, lo: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows cut where their distance to the place is a multiple of ``size``."""
        hi, at = lo + n - 1, self.place[own]
        nearest, farthest = (at - hi) // size, (at - lo) // size
        count = farthest - nearest + 1
        owner = np.repeat(np.arange(len(own)), count)
        b = np.repeat(nearest, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        core = at[owner] - size * b
        first, last = np.maximum(lo[owner], core - size + 1), np.minimum(hi[owner], core)
        return own[owner], first, last - first + 1


def _stretches(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, Places]]:
    """``(first row, row after the last, bytes before, places)``; a long text comes in several parts
    whose windows don't overlap."""
    for i, j, data, at in slices(column, CHUNK):
        for s in range(0, max(1, len(data)), CHUNK if j == i + 1 else max(1, len(data))):
            if j == i + 1:
                part = data[s : s + CHUNK + length - 1]
                yield i, j, s, Places(part, np.array([0, len(part)]), length)
            else:
                yield i, j, 0, Places(data, at, length)


def _starts(column: pa.Array, i: int, j: int) -> np.ndarray:
    """Offsets of rows i to j from row i, in bytes."""
    size = pc.fill_null(pc.binary_length(column.slice(i, j - i)), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(size))


class BitSet:
    """A set of 64-bit values as bits: no value is missed, some others are let through."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, U(8 * len(bits) - 1)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = x & self.mask
        return (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def bit_set(values: DataFrame) -> BitSet:
    """From the one long column of ``values``; tasks build parts of 32,768 bits."""
    size = BITS[0]
    n = 8 * values.count()
    while size < min(n, BITS[1]):
        size *= 2
    at = F.col(values.columns[0]).bitwiseAND(F.lit(size - 1))
    parts = values.groupBy(F.shiftright(at, 15).alias("k")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros((size >> 15, 4096), np.uint8)
    for r in parts.toLocalIterator():
        bits[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return BitSet(bits.reshape(-1))


def _picked(length: int):
    """32-byte ranks ``g`` of the picked places of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, places in _stretches(batch.column(0), length):
                yield pa.RecordBatch.from_arrays([pa.array(places.g.view(np.int64))], names=["g"])

    return run


def _ranked(length: int, size: int, twice: Callable[[], BitSet], asked: list[Callable[[], BitSet]]):
    """Units ``first, n, core, cover`` of texts ``at, text``, those that the sets let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i, j, s, places in _stretches(batch.column(1), length):
                base = at[i:j] - (_starts(batch.column(1), i, j)[:-1] - s)  # what makes an offset here a place in the table
                within = lambda which, places=places, base=base: lambda own, lo: which().has(mix((base[places.row[own]] + lo).view(U)))
                first = lambda own, lo, places=places: twice().has(places.g[own])
                both = (lambda own, lo, a=first, b=within(asked[0]): a(own, lo) & b(own, lo)) if asked else first
                own, lo, n, core, cover = places.units(size, [both, *map(within, asked[1:])])
                first = base[places.row[own]] + lo
                for t in range(0, len(own), 50_000):
                    k = slice(t, t + 50_000)
                    columns = [pa.array(first[k]), pa.array(n[k].astype(np.int32)), pa.array(core[k].view(np.int64)), pa.array(cover[k].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["first", "n", "core", "cover"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        first = x.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(mix(first.view(U)).view(np.int64))], names=["first", "x"])


def numbered(texts: DataFrame, tables: Tables) -> tuple[DataFrame, int]:
    """``at, id, text`` of texts ``id, text``, and the bits that an offset takes: ``at`` is the place of a text's
    first byte, its number in the order of id and, where an id has several texts, of a hash of the text.

    The id itself gives the number; where ids are too far apart or have several texts, ids and texts are counted."""
    h = F.xxhash64("text")
    each = texts.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b"), F.max(F.octet_length("text")).alias("n"))
    real = F.when(F.col("id") != LEAST, F.col("id"))
    low, high, n, several = each.agg(F.min(real), F.max(real), F.max("n"), F.bool_or(F.col("a") != F.col("b"))).first()
    bits = int(n or 0).bit_length()
    if not several and (high or 0) - (low or 0) + 2 <= 1 << (63 - bits):
        number = F.when(F.col("id") == LEAST, F.lit(0)).otherwise(F.col("id") - F.lit(low or 0) + 1).cast("long")
        return texts.select(F.shiftleft(number, bits).alias("at"), "id", "text"), bits
    keys = texts.select("id", h.alias("h")).distinct().orderBy("id", "h").withColumn("k", F.monotonically_increasing_id())
    keys = tables.write(keys, "keys")  # k: partition << 33 + place in it
    counts = dict(keys.groupBy(F.shiftright("k", 33)).count().collect())
    before = np.append(0, np.cumsum([counts.get(i, 0) for i in range(max(counts) + 1)]))
    number = F.get(F.array(*[F.lit(int(x)).cast("long") for x in before]), F.shiftright("k", 33).cast("int")) + F.col("k").bitwiseAND(F.lit((1 << 33) - 1))
    found = texts.withColumn("h", h).join(keys.select("id", "h", F.shiftleft(number, bits).alias("at")), ["id", "h"])
    found = tables.write(found.select("at", "id", "text"), "texts")
    tables.drop("keys")
    return found, bits


def repeated_runs(texts: DataFrame, bits: int, tables: Tables, length: int = LENGTH) -> DataFrame:
    """``at, start, stop``: byte runs of ``texts (at, text)`` that an earlier place repeats; they may overlap.

    Each round's units are written to the shared folder and deleted after it."""
    sc = texts.sparkSession.sparkContext
    ranks = texts.select("text").mapInArrow(_picked(length), "g long")
    seen = sc.broadcast(bit_set(tables.write(ranks.groupBy("g").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("g"), "ranks")))
    tables.drop("ranks")
    offset = F.lit((1 << bits) - 1).cast("long")
    text_of = lambda c: (F.col(c) - F.col(c).bitwiseAND(offset)).alias("at")
    asked, runs, some = [], [], texts.select("at", "text")
    for size in ROUNDS:
        sets = [lambda a=a: a.value for a in asked]
        units = tables.write(some.mapInArrow(_ranked(length, size, lambda: seen.value, sets), "first long, n int, core long, cover long"), "units")
        firsts = tables.write(units.groupBy("core", "cover").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("times")), "firsts")
        later = units.join(firsts.where("times > 1").select("core", "cover", "least"), ["core", "cover"]).where("first <> least")
        start = F.col("first").bitwiseAND(offset)
        runs.append(tables.write(later.select(text_of("first"), start.alias("start"), (start + F.col("n") + (length - 1)).alias("stop")), f"runs-{size}"))
        if size != ROUNDS[-1]:
            split = firsts.groupBy("core").agg(F.count(F.lit(1)).alias("covers")).where("covers > 1").select("core")
            left = tables.write(firsts.join(split, "core").select("least").mapInArrow(_hashed, "first long, x long"), f"left-{size}")
            asked.append(sc.broadcast(bit_set(left.select("x"))))
            some = maybe_in(texts.select("at", "text"), "at", left.select(text_of("first")))
        tables.drop("units", "firsts")
    tables.drop(*[f"left-{size}" for size in ROUNDS[:-1]])
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    return out


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text in order, those that meet made one."""
    for batch in batches:
        out = [_union(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
        lists = [pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["at", "start", "stop"])


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    head = np.flatnonzero(new)
    return a[head], b[np.append(head[1:], len(b)) - 1]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
        kept, removed, spans = [], [], []
        for text, starts, stops in zip(texts, batch.column(2), batch.column(3), strict=True):
            if not starts.is_valid or not len(starts):
                kept.append(text), removed.append(0), spans.append([])
                continue
            a, b = np.minimum(starts.values.to_numpy(), len(text)), np.minimum(stops.values.to_numpy(), len(text))
            pieces = [text[x:y] for x, y in zip(np.append(0, b), np.append(a, len(text)), strict=True)]
            kept.append(b"".join(pieces)), removed.append(int((b - a).sum())), spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary()),
            ],
            names=["id", "n_bytes", "n_removed", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept``: every text without the bytes that repeat.

    A byte goes if a string of ``length`` bytes over it also starts earlier (smaller id, or same
    document and earlier start); strings are judged on the input and never cross documents.
    ``kept`` are the remaining bytes (a cut may split a character), ``spans`` the maximal removed
    runs. Null and empty texts lose nothing. A document is an id with a text: a repeated row loses
    the same bytes and doesn't count against itself; different texts of one id are documents of
    their own, in the order of a hash of the text. Null ids count as the smallest. An empty table
    gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tables = Tables(docs.sparkSession)
    texts, bits = numbered(texts, tables)
    runs = repeated_runs(texts, bits, tables, length)
    lists = runs.groupBy("at").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))  # at most as long as the text
    lists = lists.select("at", "runs.start", "runs.stop").mapInArrow(_united, "at long, start array<long>, stop array<long>")
    some = marked(texts, "at", runs.select("at"), "some")  # texts without a run skip the join
    found = some.where("some").join(lists, "at", "left").select("id", "text", "start", "stop")
    none = F.lit(None).cast("array<long>")
    found = found.union(some.where("NOT some").select("id", "text", none, none))
    out = found.mapInArrow(_cut_out, "id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumn("id", F.nullif("id", F.lit(LEAST)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: All windows of 100 bytes as hex; fine for tables of some megabytes.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200),
m AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::BIGINT, 200)) AS x FROM w),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM m) WHERE k > 1),
n AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS fresh FROM s),
g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
k AS (SELECT p.doc_id, count(*) AS spans, sum(b - a) AS removed, max(b) AS stop, string_agg(substr(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN spans > 0 THEN head || substr(h, (2 * stop + 1)::BIGINT) ELSE h END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES = {"op1_substring_dedup": ORACLE}
