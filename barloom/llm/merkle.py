"""Merkle manifest of a dataset: a tree for each group, a tree over the groups, a proof for each row.

1. Every row becomes a leaf digest (built-in SHA-256 over the row's fields) and gets its place in its
   group: rows are dealt by range of (group, id, leaf) and counted inside a part; of each part only the
   rows of groups that began in earlier parts need an offset, so a group that holds all rows is sorted by
   all tasks and at most one offset a part is broadcast.
2. Distributed reduction: a block of ``BLOCK`` neighbouring leaves is an aligned subtree, which one task
   reduces to its root; every row keeps the siblings of its levels as its path.
3. The roots of the blocks are the small top of the trees. Up to ``TOP`` nodes the driver builds it and
   broadcasts each block's suffix path; more nodes are reduced by blocks once more, as often as it takes,
   and their paths are joined instead. The roots of the groups, in order of the groups, are one more tree
   that is built the same way.
4. Executors put both paths together, digest the siblings (the proof) and fold each row's leaf, or the leaf
   of the row as it was tampered with, up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm._spark import Tables, table

#: Leaves of a block (a power of 2), and nodes that the driver takes at most (with paths of about 1 KB: 16 MB).
BLOCK, TOP = 1 << 12, 1 << 14
#: A step of a path: a byte (0: no sibling, 1: it stands to the left, 2: to the right) and the sibling's digest.
STEP = 33
_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(columns: list[Column]) -> Column:
    """SHA-256 over the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part and the place of each row among its part's rows of the group in the first column."""
    part, last, held = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group = batch.column(0)
        code = pa.concat_arrays([pa.array(last, group.type), group]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        same = code[1:] == code[:-1]
        if not last:
            same = np.append(False, same)
        place = np.arange(n)
        place = place - np.maximum.accumulate(np.where(same, 0, place))
        place[: n if same.all() else int(np.argmin(same))] += held  # rows in front that go on with the last batch's group
        last, held = [group[n - 1].as_py()], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "part", "place"])


def _ranked(rows: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Adds ``pos``, the place of each row among the rows of its group ``g``; columns from the second on give the order.

    The rows are dealt by range over all columns, so equal keys alone share a part; the last column tells rows apart."""
    order = [F.col(c).asc_nulls_first() for c in rows.columns]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    numbered = tables.write(dealt.mapInArrow(_numbered, f"{kinds}, part int, place long"), name)
    counts = numbered.groupBy("part", "g").agg((F.max("place") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("part").alias("_part"), F.col("g").alias("_g"), before.alias("_before")).where("_before > 0")
    met = numbered.join(F.broadcast(offsets), (F.col("part") == F.col("_part")) & F.col("g").eqNullSafe(F.col("_g")), "left")  # one row a part at most
    return met.withColumn("pos", F.col("place") + F.coalesce("_before", F.lit(0))).drop("part", "place", "_part", "_g", "_before")


def _reduced(nodes: np.ndarray, whole: bool, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths of neighbouring nodes (n x 32 bytes) and the root: of a whole tree when one node is left, else after ``levels``."""
    at, steps = np.arange(len(nodes)), []
    while len(nodes) > 1 or not whole and len(steps) < levels:
        step, other = np.zeros((len(at), STEP), np.uint8), at ^ 1
        there = other < len(nodes)
        step[there, 0] = np.where(other < at, 1, 2)[there]
        step[there, 1:] = nodes[other[there]]
        steps.append(step)
        text = [x.tobytes().hex() for x in nodes]
        up = [sha256("".join(text[i : i + 2]).encode()).digest() for i in range(0, len(text), 2)]
        nodes, at = np.frombuffer(b"".join(up), np.uint8).reshape(-1, 32), at >> 1
    return np.stack(steps, 1).reshape(len(at), -1) if steps else np.zeros((len(at), 0), np.uint8), nodes[0]


def _block(size: int):
    def run(rows: pa.Table) -> pa.Table:
        """Of one block: each row's path in it, and in its first row the block's root."""
        rows = rows.sort_by("pos")
        n, block = rows.num_rows, rows["pos"][0].as_py() // size
        nodes = np.frombuffer(b"".join(rows["node"].to_pylist()), np.uint8).reshape(n, 32)
        paths, root = _reduced(nodes, block == 0 and n < size, size.bit_length() - 1)
        return rows.append_column("path", pa.array([p.tobytes() for p in paths], pa.binary())).append_column("up", pa.array([root.tobytes()] + [None] * (n - 1), pa.binary()))

    return run


def _lower(nodes: DataFrame, tables: Tables, name: str) -> DataFrame:
    """One round: rows ``g, pos, node, ...`` with their ``block``, ``path`` in it and, in its first row, its root ``up``."""
    size = BLOCK
    rows = nodes.withColumn("block", F.floor(F.col("pos") / size))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return tables.write(rows.groupBy("g", "block").applyInArrow(_block(size), f"{kinds}, path binary, up binary"), name)


def _joined(rows: DataFrame, paths: DataFrame, small: bool) -> DataFrame:
    """Adds the path and top of each row's block."""
    upper = paths.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), "top")
    return rows.join(F.broadcast(upper) if small else upper, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_pos")))


def _climb(nodes: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, bool]:
    """``g, pos, path, top`` of nodes ``g, pos, node``: path to and digest of the root of their group; whether they are ``TOP`` at most."""
    if len(few := nodes.limit(TOP + 1).toPandas()) <= TOP:
        out = []
        for group, own in few.sort_values("pos").groupby("g", dropna=False, sort=False):
            paths, root = _reduced(np.frombuffer(b"".join(own["node"]), np.uint8).reshape(-1, 32), True, 0)
            out += [(group if isinstance(group, str) else None, int(pos), bytearray(path.tobytes()), bytearray(root.tobytes())) for pos, path in zip(own["pos"], paths, strict=True)]
        return nodes.sparkSession.createDataFrame(out, "g string, pos long, path binary, top binary"), True
    if nodes.where("pos > 0").isEmpty():  # each is its group's root
        return nodes.select("g", "pos", F.lit(b"").alias("path"), F.col("node").alias("top")), False
    lower = _lower(nodes.select("g", "pos", "node"), tables, name)
    paths, small = _climb(lower.where("up IS NOT NULL").select("g", F.col("block").alias("pos"), F.col("up").alias("node")), tables, f"{name}-up")
    met = _joined(lower, paths, small).select("g", "pos", F.concat("path", "_path").alias("path"), "top")
    return tables.write(met, f"{name}-paths"), False


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs and folds of rows ``id, node, start, path, subroot, root``."""
    for batch in batches:
        out: list[list] = [[], []]
        for start, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            at, siblings = start.hex(), []
            for k in range(0, len(path), STEP):
                if side := path[k]:
                    siblings.append(other := path[k + 1 : k + STEP].hex())
                    at = sha256((other + at if side == 1 else at + other).encode()).hexdigest()
                else:
                    at = sha256(at.encode()).hexdigest()
            out[0].append(sha256("".join(siblings).encode()).hexdigest())
            out[1].append(at)
        leaf, subroot, root = ([x.hex() for x in batch.column(k).to_pylist()] for k in (1, 4, 5))
        same = [a == b for a, b in zip(out[1], root, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in (leaf, subroot, root, *out)], pa.array(same, pa.bool_())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: Column | None = None, changes: dict[str, Column] | None = None,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Leaves of a group ascend by id, null ids first; rows of one id come in order of their leaf digests, so
    the trees don't depend on the order of the rows, and rows alike in all fields are leaves of their own
    whose places don't matter. Groups are ordered as UTF-8 bytes, null first. Where ``tampered`` holds (null:
    no) the fold starts from the leaf of the row with ``changes`` in place of its columns; leaf, roots and
    proofs are of the rows as they are. An empty table gives an empty result; other columns are ignored.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    leaf = digest([F.col(c) for c in fields])
    other = digest([(changes or {}).get(c, F.col(c)) for c in fields])
    start = F.when(F.coalesce(tampered, F.lit(False)), other) if tampered is not None else F.lit(None).cast("binary")
    rows = docs.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).cast("long").alias("id"), leaf.alias("node"), start.alias("start"), F.monotonically_increasing_id().alias("tie"))
    leaves = tables.write(rows, "leaves")
    if leaves.isEmpty():
        return spark.createDataFrame([], _SCHEMA)
    placed = _ranked(leaves, tables, "numbered")
    lower = _lower(placed.select("g", "id", "node", "start", "pos"), tables, "blocks")
    tables.drop("leaves", "numbered")
    paths, small = _climb(lower.where("up IS NOT NULL").select("g", F.col("block").alias("pos"), F.col("up").alias("node")), tables, "tops")

    subroots = paths.where("pos = 0").select("g", F.col("top").alias("node"))
    order = _ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), tables, "groups").withColumnRenamed("name", "block")
    tops, few = _climb(order.select("g", "pos", "node"), tables, "root")
    tops = order.select("pos", F.col("block").alias("_name")).join(F.broadcast(tops) if few else tops, "pos").select("_name", F.col("path").alias("_to_root"), F.col("top").alias("root"))
    met = paths.withColumnRenamed("top", "subroot").join(F.broadcast(tops) if few else tops, F.col("g").eqNullSafe(F.col("_name")))
    suffix = met.select("g", "pos", F.concat("path", "_to_root").alias("path"), F.struct("subroot", "root").alias("top"))
    found = _joined(lower, tables.write(suffix, "suffix"), small)
    found = found.select("id", "node", F.coalesce("start", "node").alias("start"), F.concat("path", "_path").alias("path"), "top.subroot", "top.root")
    return found.mapInArrow(_finished, _SCHEMA)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # beyond the largest long too
    return manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changes={"n_chars": more.cast("decimal(20,0)")})


_CRC = """crc AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc)"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE = f"""
WITH RECURSIVE {_CRC},
d AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars::HUGEINT + 1)")} AS other,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crcs.t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crcs),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (
  SELECT lang, 0 AS lev, pos, leaf AS h FROM p UNION ALL
  SELECT lang, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM t) WHERE n > 1 GROUP BY lang, lev, pos // 2),
s AS MATERIALIZED (SELECT lang, max(lev) AS top, arg_max(h, lev) AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM t GROUP BY lang),
u AS (
  SELECT 0 AS lev, pos, subroot AS h FROM s UNION ALL
  SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lev, pos // 2),
r AS MATERIALIZED (SELECT arg_max(h, lev) AS root, max(lev) AS top FROM u),
way AS MATERIALIZED (
  SELECT p.lang, p.pos, t.lev, p.pos >> t.lev AS at, n.h FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT lang, lev FROM t) t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lev < s.top
    LEFT JOIN t n ON n.lang IS NOT DISTINCT FROM p.lang AND n.lev = t.lev AND n.pos = xor(p.pos >> t.lev, 1)
  UNION ALL
  SELECT p.lang, p.pos, s.top + v.lev, s.pos >> v.lev, n.h FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT lev FROM u) v ON v.lev < (SELECT top FROM r)
    LEFT JOIN u n ON n.lev = v.lev AND n.pos = xor(s.pos >> v.lev, 1)),
proof AS (SELECT lang, pos, sha256(coalesce(string_agg(h, '' ORDER BY lev), '')) AS proof FROM way GROUP BY lang, pos),
f AS (
  SELECT lang, pos, 0 AS lev, CASE WHEN tampered THEN other ELSE leaf END AS h FROM p UNION ALL
  SELECT f.lang, f.pos, f.lev + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN w.at % 2 = 1 THEN w.h || f.h ELSE f.h || w.h END)
  FROM f JOIN way w ON w.lang IS NOT DISTINCT FROM f.lang AND w.pos = f.pos AND w.lev = f.lev),
g AS (SELECT lang, pos, arg_max(h, lev) AS folded FROM f GROUP BY lang, pos)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(q.proof, sha256('')) AS proof_sha256, g.folded AS folded_root, g.folded = r.root AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN g ON g.lang IS NOT DISTINCT FROM p.lang AND g.pos = p.pos
  LEFT JOIN proof q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos CROSS JOIN r
"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": ORACLE}
