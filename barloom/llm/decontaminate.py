"""Benchmark decontamination by winnowing.

1. Fingerprints: of every run of ``w`` neighbouring k-grams of words the one with the least hash is kept
   (the last of equals). Two texts that share a span of w + k - 1 words keep the same fingerprint inside it,
   so with w + k - 1 no more than a window's words every shared window holds a fingerprint of both. Windows
   of fewer than ``GRAM`` words are whole items and are their own fingerprint.
2. The benchmark's fingerprints are one bit each in a broadcast set of at most ``BITS`` bits (16 MB), which
   spares the shuffle nearly all fingerprints of clean text and decides nothing. Documents with the same
   words are one text from here on. What passes joins the benchmark's fingerprints.
3. A hit is extended: all windows around it, by the lengths that items have, join the benchmark's windows by
   128-bit hash, exactly one row for each window of a text, whatever number of items share it.
4. Covered words are a running maximum over a text's windows. Windows that stand in the same items form a
   class, texts with the same classes share one list of items; classes and lists are told by sums and xors
   of hashes, so no list of items is gathered but to digest it, one distinct list at a time and row by row.

Words are compared by 64-bit hashes of their bytes, windows by 128 bits over those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm._spark import Tables, table
from barloom.llm._text import U, mix, slices, words

#: Words of a gram, and bits of the broadcast set: 256 for each fingerprint, at least the first and at most the second number.
GRAM, BITS = 5, (1 << 16, 1 << 27)
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_ITEMS = "item_id long, m int, windows array<struct<h1:long,h2:long>>"
_TEXTS = "doc_id long, k1 long, k2 long, n long, hits array<struct<print:long,windows:array<struct<s:int,l:int,h1:long,h2:long>>>>"


def _run_hash(h: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    """64-bit hashes of the n words from each place ``at``; ``kind`` 0 and 1 are independent."""
    out = np.full(len(at), n + 1, U)
    for k in range(n):
        out = mix(out * _ODD[kind] + h[at + k] + U(kind))
    return out


def _prints(h: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of texts whose words start at ``first``."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(len(h))  # words from here to the end of the text
    gram = np.flatnonzero(left >= k)
    hashes = np.zeros(len(h), U)
    hashes[gram] = _run_hash(h, gram, k, 0)
    if w == 1:
        return gram, hashes[gram]
    begin = np.flatnonzero(left >= k + w - 1)
    best = begin.copy()
    for s in range(1, w):
        best = np.where(hashes[begin + s] <= hashes[best], begin + s, best)
    best = np.unique(best)
    return best, hashes[best]


class Plan:
    """What is searched for: the lengths of windows, and the grams and runs that find them."""

    def __init__(self, lengths: list[int], length: int):
        self.lengths = sorted(lengths)
        long = [m for m in self.lengths if m >= min(GRAM, length)]
        self.kinds = [(m, 1, [m]) for m in self.lengths if m < min(GRAM, length)]
        if long:
            k = min(GRAM, length)
            self.kinds.append((k, long[0] - k + 1, long))


def _items(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows and length class of each item."""
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                h, first = words(data, at, signs=True)
                m = np.minimum(np.diff(first), length).astype(np.int32)
                windows = []
                for r, size in enumerate(m.tolist()):
                    places = np.arange(first[r], first[r + 1] - size + 1) if size else np.zeros(0, np.int64)
                    h1, h2 = (_run_hash(h, places, size, kind).view(np.int64).tolist() for kind in (0, 1))
                    windows.append([{"h1": x, "h2": y} for x, y in zip(h1, h2, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(m), pa.array(windows, pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])))], names=["item_id", "m", "windows"])

    return run


def _item_prints(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of each item, by the kind that its length asks for."""
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                h, first = words(data, at, signs=True)
                n = np.diff(first)
                for k, w, lengths in plan.kinds:
                    own = (n >= lengths[0]) & ((n <= lengths[-1]) | (lengths[-1] == plan.lengths[-1]))
                    place, prints = _prints(h, first, k, w)
                    row = np.searchsorted(first, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(prints[own[row]]).view(np.int64))], names=["print"])

    return run


def _text_hits(plan: Plan, bits, n_bits: int):
    shape = pa.list_(pa.struct([("print", pa.int64()), ("windows", pa.list_(pa.struct([("s", pa.int32()), ("l", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                h, first = words(data, at, signs=True)
                n = np.diff(first)
                where = np.arange(len(h)) - np.repeat(first[:-1], n)
                keys = [np.zeros(len(n), U) for _ in range(2)]
                full = np.flatnonzero(n)
                for x in range(2):
                    if len(full):
                        keys[x][full] = np.add.reduceat(mix(h * _ODD[x] + mix(where.astype(U) + U(x + 1))), first[:-1][full])
                lists: list[list | None] = [None] * len(n)
                for k, w, lengths in plan.kinds:
                    place, prints = _prints(h, first, k, w)
                    b = prints & U(n_bits - 1)
                    keep = (known[(b >> U(3)).astype(np.int64)] >> (b & U(7)).astype(np.uint8)) & 1 > 0
                    place, prints = place[keep], prints[keep]
                    if not len(place):
                        continue
                    row = np.searchsorted(first, place, "right") - 1
                    owner, start, size = [], [], []
                    for m in lengths:
                        for back in range(m - k + 1):
                            s = place - back
                            ok = (s >= first[row]) & (s + m <= first[row + 1])
                            owner.append(np.flatnonzero(ok)), start.append(s[ok]), size.append(np.full(ok.sum(), m))
                    owner, start, size = np.concatenate(owner), np.concatenate(start), np.concatenate(size)
                    h1, h2 = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
                    for m in lengths:
                        of = np.flatnonzero(size == m)
                        h1[of], h2[of] = _run_hash(h, start[of], m, 0).view(np.int64), _run_hash(h, start[of], m, 1).view(np.int64)
                    order = np.argsort(owner, kind="stable")
                    cuts = np.searchsorted(owner[order], np.arange(len(place) + 1))
                    for x in range(len(place)):
                        of = order[cuts[x] : cuts[x + 1]]
                        r = int(row[x])
                        windows = [{"s": int(a - first[r]), "l": int(m), "h1": int(p), "h2": int(q)} for a, m, p, q in zip(start[of], size[of], h1[of], h2[of], strict=True)]
                        lists[r] = (lists[r] or []) + [{"print": int(prints[x : x + 1].view(np.int64)[0]), "windows": windows}]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(lists, shape)],
                    names=["doc_id", "k1", "k2", "n", "hits"],
                )

    return run


def _set_of(*columns: str) -> list[Column]:
    """An order-free 128-bit fingerprint of the distinct rows of a group, and their number."""
    h = [F.xxhash64(*columns, F.lit(k)) for k in (1, 2)]
    return [F.count(F.lit(1)).alias("n_of"), F.bit_xor(h[0]).alias("x1"), F.bit_xor(h[1]).alias("x2")]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and digest of the items of each set, from rows ``set, name`` sorted by both: row by row, whatever the length of a list."""
    at, count, state = None, 0, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    out.append((at, count, state.hexdigest()))
                at, count, state = key, 0, hashlib.sha256()
            if name is not None:
                state.update(("," if count else "").encode() + name.encode())
                count += 1
        yield _list_rows(out)
    if at is not None:
        yield _list_rows([(at, count, state.hexdigest())])


def _list_rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["set", "n_items", "items_sha256"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    Words are runs of digits, a-z after folding A-Z, and everything beyond ASCII. A window is ``length``
    neighbouring words of an item; an item with fewer words, but not none, is one window. Words inside any
    occurrence of a window are hit; ``n_items`` counts the items with occurring windows, ``items_sha256``
    digests their ids, sorted as strings and joined by commas. Null texts have no words. An item without an
    id hits words but is in no list; items of one id count once, each text with its own windows. Rows decide:
    texts of one id, and rows without an id, get their own result; repeated rows repeat. Empty tables give an
    empty result or clean documents; other columns are ignored.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    cut = tables.write(items.mapInArrow(_items(length), _ITEMS), "items")
    plan = Plan([r.m for r in cut.select("m").where("m > 0").distinct().collect()], length)  # at most ``length`` numbers
    prints = tables.write(items.select("text").mapInArrow(_item_prints(plan), "print long").distinct(), "prints")
    n_bits = min(BITS[1], max(BITS[0], 1 << (256 * prints.count()).bit_length()))
    place = F.col("print").bitwiseAND(F.lit(n_bits - 1))
    marked = prints.groupBy(F.shiftright(place, 15).cast("int").alias("b")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")).collect()  # at most 4,096 rows of 4 KB
    known = bytearray(n_bits // 8)
    for r in marked:
        known[r.b * 4096 : r.b * 4096 + 4096] = r.bits[: n_bits // 8]
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    texts = tables.write(source.mapInArrow(_text_hits(plan, spark.sparkContext.broadcast(bytes(known)), n_bits), _TEXTS), "texts")

    # windows of the benchmark, each with the class of those that stand in the same items
    member = cut.select("item_id", "m", F.explode("windows").alias("w")).select("m", "w.h1", "w.h2", "item_id").distinct()
    window = tables.write(member.groupBy("m", "h1", "h2").agg(*_set_of("item_id")), "windows")
    classes = window.groupBy("n_of", "x1", "x2").agg(F.min(F.struct("m", "h1", "h2")).alias("w"))
    in_class = member.join(classes.select("w.*", "n_of", "x1", "x2"), ["m", "h1", "h2"]).select("n_of", "x1", "x2", F.col("item_id").cast("string").alias("name"))

    # texts, not documents: copies count once
    text = texts.where("hits IS NOT NULL").groupBy("k1", "k2").agg(F.first("hits").alias("hits"))
    hit = text.select("k1", "k2", F.explode("hits").alias("hit")).select("k1", "k2", "hit.print", "hit.windows").join(prints, "print", "left_semi")
    around = hit.select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.*").distinct()
    occurs = around.withColumnRenamed("l", "m").join(window, ["m", "h1", "h2"]).select("k1", "k2", "s", "m", "n_of", "x1", "x2")
    occurs = tables.write(occurs, "occurs")
    before = F.max(F.col("s") + F.col("m")).over(Window.partitionBy("k1", "k2").orderBy("s", "m").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("s") + F.col("m") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0))))
    covered = occurs.select("k1", "k2", fresh.alias("fresh")).groupBy("k1", "k2").agg(F.sum("fresh").cast("long").alias("n_hit"))

    held = occurs.select("k1", "k2", "n_of", "x1", "x2").distinct()
    sets = held.groupBy("k1", "k2").agg(*[c.alias(a) for c, a in zip(_set_of("n_of", "x1", "x2"), ("set_n", "set_1", "set_2"), strict=True)])
    sets = tables.write(sets.select("k1", "k2", F.concat_ws(":", "set_n", "set_1", "set_2").alias("set")), "sets")
    one = sets.groupBy("set").agg(F.min(F.struct("k1", "k2")).alias("t")).select("set", "t.k1", "t.k2")
    named = held.join(one, ["k1", "k2"]).select("set", "n_of", "x1", "x2").join(in_class, ["n_of", "x1", "x2"]).select("set", "name").distinct()
    lists = named.repartition("set").sortWithinPartitions("set", "name").mapInArrow(_lists, "set string, n_items long, items_sha256 string")

    found = covered.join(sets.join(lists, "set"), ["k1", "k2"]).select("k1", "k2", "n_hit", "n_items", "items_sha256")
    clean = texts.where("hits IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    dirty = texts.where("hits IS NOT NULL").select("doc_id", "n", "k1", "k2").join(found, ["k1", "k2"], "left").drop("k1", "k2")
    none = hashlib.sha256(b"").hexdigest()
    return clean.unionByName(dirty).select(
        "doc_id", F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS MATERIALIZED (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.s = dw.s),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, i, m, unnest(range(i, i + m)) AS x FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  coalesce(n.items, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN n ON n.r = d.r
"""

QUERIES = {"op12_decontaminate": op12_decontaminate}
ORACLES = {"op12_decontaminate": ORACLE}
