"""Near-duplicate detection by MinHash with banding.

1. One pass over the texts gives each row the size and a 128-bit hash of its shingle set, a
   signature of universal hash minima and the band keys. Rows with the same set form a class.
2. Classes that share a band key are candidates. Buckets of up to ``SMALL`` classes give their
   pairs (at most SMALL - 1 a row); a larger bucket gives one pair for each class, with its hub (the
   least class), so a family of near copies is one star. Signatures drop pairs far under the threshold.
3. Links are confirmed on the whole shingle sets of both texts; components follow by alternating
   large-star and small-star.
4. What is in another component than its bucket's hub may still be linked with members of the bucket.
   Buckets whose hubs are in one component form a group; only its classes outside that component are
   dealt into blocks that meet one block of the component, and what that leaves outside it all blocks
   of the group. Each pair of blocks is one unit of work that compares whole shingle sets by matrix products and returns a
   spanning forest of the links it finds. Nothing is capped: pairs that are left out are in one
   component already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._spark import cut, maybe_in, table
from barloom.llm._text import U, grams, mix, slices, stream, words
from barloom.llm.components import connected_components, with_links

#: Rows of a band, and the chance at most that all bands miss a pair at the threshold.
ROWS, MISS = 6, 2e-5
#: Buckets with more classes than this become stars; classes and shingles of a block at most.
SMALL, BLOCK, SHINGLES = 16, 128, 1 << 18
_BASE = "id long, x long, n long, s1 long, s2 long, keys array<long>, signature binary"


def bands(percent: int) -> int:
    """Bands that keep the chance of a miss at the threshold under ``MISS``: 23 at 0.85, 36 at 0.80."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles sorted by row, and how many each row has."""
    g, row = grams(*words(data, at), size)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.bincount(row[new], minlength=len(at) - 1)


def _signed(size: int, percent: int):
    n_bands = bands(percent)
    hashes = n_bands * ROWS
    factors, shifts = stream(hashes, 11) | U(1), stream(hashes, 12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column(2)):
                g, n = _sets(data, at, size)
                full = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[full]
                minima = np.empty((hashes, len(full)), U)
                s1, s2 = np.zeros(len(n), U), np.zeros(len(n), U)
                if len(full):
                    for k in range(hashes):
                        h = g * factors[k]
                        h += shifts[k]
                        minima[k] = np.minimum.reduceat(h, begin)
                    s1[full], s2[full] = np.add.reduceat(mix(g + U(77)), begin), np.add.reduceat(mix(g ^ U(0xABCDEF0123456789)), begin)
                keys = np.zeros((n_bands, len(full)), U)
                for k in range(hashes):
                    keys[k // ROWS] = mix(keys[k // ROWS] * U(31) + minima[k] + U(k))
                lists, marks = [None] * len(n), [None] * len(n)
                keys, low = keys.T.astype(np.int64), np.ascontiguousarray((minima >> U(40)).astype(np.uint16).T)
                for x, r in enumerate(full):
                    lists[r], marks[r] = keys[x], low[x].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["id", "x", "n", "s1", "s2", "keys", "signature"],
                )

    return run


def _plausible(least: float):
    """Keep pairs whose signatures agree in a share of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
                batch = batch.filter(pa.array((a == b).mean(axis=1) >= least))
            yield batch.select([0, 1])

    return run


def _linked(size: int, percent: int):
    """Keep pairs of texts whose whole shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            k = 0
            for (_, _, d1, a1), (_, _, d2, a2) in zip(_each(batch.column(2)), _each(batch.column(3)), strict=True):
                x, y = _sets(d1, a1, size)[0], _sets(d2, a2, size)[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                found[k] = 100 * both >= percent * (len(x) + len(y) - both) > 0
                k += 1
            yield batch.select([0, 1]).filter(pa.array(found))

    return run


def _each(column: pa.Array):
    return slices(column, 0)


def _forest(size: int, percent: int):
    """Links of two blocks of texts as a spanning forest, from products of 0/1 shingle matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                mine, other = (batch.column(k)[r] for k in (0, 1))
                rows = list(dict(zip([x["id"].as_py() for x in (*mine, *(other if other.is_valid else ()))], (x["text"].as_py() or "" for x in (*mine, *(other if other.is_valid else ()))), strict=True)).items())
                ids = np.array([x for x, _ in rows], np.int64)
                raw = [t.encode() for _, t in rows]
                at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                g, n = _sets(np.frombuffer(b"".join(raw), np.uint8), at, size)
                who = np.repeat(np.arange(len(ids)), n)
                _, code, times = np.unique(g, return_inverse=True, return_counts=True)
                order = np.argsort(code, kind="stable")
                order = order[times[code[order]] > 1]  # a shingle of one text is in no intersection
                who, code = who[order], code[order]
                both = np.zeros((len(ids), len(ids)), np.float32)
                for c in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
                    lo, hi = np.searchsorted(code, [c, c + 4096])
                    if lo < hi:
                        m = np.zeros((len(ids), 4096), np.float32)
                        m[who[lo:hi], code[lo:hi] - c] = 1
                        both += m @ m.T
                union = n[:, None] + n[None, :] - both
                link = 100 * both.astype(np.int64) >= percent * union.astype(np.int64)
                root = np.arange(len(ids))
                out = []
                for a in range(len(ids)):  # labels of what a is linked with become one
                    near = np.flatnonzero(link[a] & (root != root[a]))
                    if len(near):
                        labels, first = np.unique(root[near], return_index=True)
                        out += [(int(ids[a]), int(ids[near[f]])) for f in first]
                        root[np.isin(root, labels)] = root[a]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components: ``doc_id, n_shingles, component_id, kept``, a row per document.

    Words are split at space and U+0009 to U+000D after folding A-Z. Documents link when
    100 * intersection >= percent * union of their sets of ``size``-word shingles; a text with
    fewer words has its whole sequence as one shingle; a null or empty text has none and links
    with nothing. ``component_id`` is the smallest id reachable; ties and repeated rows fall into
    one component. Rows decide, not ids: different texts of one id link as they are. Rows with a
    null id are left out of links and keep a null component; an empty table gives an empty result;
    other columns are ignored.
    """
    return _found(docs, id_col, text_col, size, percent).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("found", "id")).alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("found", "id")).alias("kept"),
    )


def _found(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``id, x, n, c, component, found`` of every row: hash of the text, size and key of its set, component and its least id."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("x", F.xxhash64("text"))
    base = cut(texts.select("id", "x", "text").mapInArrow(_signed(size, percent), _BASE).withColumn("c", F.xxhash64("s1", "s2", "n")))
    full = base.where("n > 0 AND id IS NOT NULL")
    classes = cut(full.groupBy("c").agg(F.min(F.struct("id", "x")).alias("rep"), F.min("n").alias("n")).select("c", "rep.id", "rep.x", "n"))
    signed = full.join(classes, ["c", "id", "x"]).groupBy("c").agg(F.min("keys").alias("keys"), F.min("signature").alias("signature"))
    signed = cut(signed)
    member = signed.select("c", F.posexplode("keys").alias("band", "key")).select("c", F.xxhash64("band", "key").alias("key"))
    crowded = member.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("hub")).where("m > 1")
    member = cut(member.join(crowded, "key"))

    few, many = member.where(F.col("m") <= SMALL), member.where(F.col("m") > SMALL)
    pairs = few.select("key", F.col("c").alias("a")).join(few.select("key", F.col("c").alias("b")), "key").where("a < b").select("a", "b")
    pairs = pairs.union(many.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"))).distinct()
    mark = lambda name: signed.select(F.col("c").alias(name), F.col("signature").alias(f"sig_{name}"))
    slack = 5 * (percent / 100 * (1 - percent / 100) / (bands(percent) * ROWS)) ** 0.5  # five standard errors under the threshold
    pairs = cut(pairs.join(mark("a"), "a").join(mark("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_plausible(percent / 100 - slack), "a long, b long"))

    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    text_of = lambda some: maybe_in(texts, "x", some.select("x")).join(some, ["id", "x"]).select("c", "text").dropDuplicates(["c"])
    whole = cut(text_of(classes.join(wanted, "c")))
    text = lambda name: whole.select(F.col("c").alias(name), F.col("text").alias(f"text_{name}"))
    links = cut(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked(size, percent), "a long, b long"))
    comps = cut(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    for narrow in (True, False) if not many.isEmpty() else ():
        comp = lambda of, name: comps.select(F.col("node").alias(of), F.col("component").alias(name))
        placed = many.join(comp("c", "own"), "c", "left").join(comp("hub", "hubs"), "hub", "left")
        # buckets of all bands whose hubs are in one component are one group, so a class is in it once
        group, rest = F.coalesce("hubs", "hub"), F.coalesce("own", "c") != F.coalesce("hubs", "hub")
        placed = cut(placed.select(group.alias("key"), "c", rest.alias("rest")).distinct())
        open_keys = cut(placed.where("rest").select("key").distinct())
        if open_keys.isEmpty():
            break
        sized = placed.join(open_keys, "key").join(classes, "c")  # a group all in its hubs' component is done
        blocks = sized.groupBy("key", "rest").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
        dealt = sized.join(blocks, ["key", "rest"]).withColumn("block", F.pmod(F.xxhash64("c", "key"), F.col("blocks")).cast("int"))
        if narrow:  # first one block of each group's component alone, which leaves little to meet all blocks
            dealt = dealt.where("rest OR block = 0")
        dealt = cut(dealt)
        own = cut(text_of(dealt.select("c", "id", "x").distinct()))
        packed = dealt.join(own, "c").groupBy("key", "rest", "block").agg(F.collect_list(F.struct(F.col("c").alias("id"), "text")).alias("rows"))
        met_by = packed.where("NOT rest") if narrow else packed
        left = packed.where("rest").select("key", F.col("block").alias("mine"), "rows")
        right = met_by.select("key", "rest", "block", F.col("rows").alias("others"))
        met = left.join(right, "key").where("NOT rest OR block >= mine").select("rows", F.when(~(F.col("rest") & (F.col("block") == F.col("mine"))), F.col("others")).alias("others"))
        found = cut(met.mapInArrow(_forest(size, percent), "u long, v long"))
        comps = cut(with_links(comps, found))

    found = classes.join(comps, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("component", "c").alias("component"))
    least = found.groupBy("component").agg(F.min("id").alias("found"))
    found = found.join(least, "component").select("c", "component", "found")
    return base.select("id", "x", "n", "c").join(found, "c", "left")


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay (one of each component), all columns. Rows without words or without
    an id all stay; of a component the least id stays with the least set, and a repeated row repeats."""
    found = _found(docs, id_col, text_col, size, percent)
    no_class = F.col("n").eqNullSafe(0) | F.col("id").isNull()
    best = found.where(~no_class).groupBy("component").agg(F.min(F.when(F.col("id") == F.col("found"), F.struct("id", "c", "x"))).alias("best"))
    stay = best.select("best.id", "best.x").union(found.where(no_class).select("id", "x")).distinct()
    stay = stay.select(F.xxhash64("id", "x").alias("_row"))
    own = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    return docs.withColumn("_row", own).join(stay.distinct(), "_row").drop("_row")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
ORACLES = {"op5_minhash_near_dedup": ORACLE}
