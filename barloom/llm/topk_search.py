"""Exact top-k search by tiled matrix products.

Queries are packed into blocks of bounded size and broadcast, as many as fit ``PASS`` bytes at a time; the
candidates stay where they are and are read once for each pass, so tiles are never shuffled against
each other. A task multiplies a tile of its candidates with a block of queries at a time, keeps the k
best of each query (partial selection) and merges them with those of its other tiles. The lists of a
block are merged up a tree, ``FAN`` tasks at a time, so a query's lists never come together in one task
but at the top, where few are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._spark import Tables, table

#: Rows of a tile of candidates and of a block of queries, queries that are multiplied at a time, lists merged
#: at a time, tasks that candidates are dealt to at most, and bytes of queries that are broadcast at a time.
SHARD_ROWS, BLOCK_ROWS, STEP, FAN, TASKS, PASS = 4096, 8192, 512, 16, 10_000, 1 << 25
_LISTS = "dim int, block int, shard int, q_ids binary, ids binary, scores binary"


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, q, dim``: whole-number vectors; those null or with a null or non-finite part are out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & finite & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("q"), F.size(x).alias("dim")
    )


def _packed(rows: DataFrame, per_tile: int, name: str) -> tuple[DataFrame, int]:
    """Tiles ``dim, name, ids, data`` (32-bit integers where they fit, else 64-bit), and their number: rows are
    dealt by hash, not by value."""
    tiles = max(1, -(-rows.count() // per_tile))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["id"].to_numpy(np.int64)
        data = np.stack([np.asarray(v, np.int64) for v in part["q"]]) if int(part["dim"].iloc[0]) else np.zeros((len(ids), 0), np.int64)
        if not data.size or np.abs(data).max() < 2**31:
            data = data.astype(np.int32)
        return pd.DataFrame({"dim": [int(part["dim"].iloc[0])], name: [int(part[name].iloc[0])], "ids": [ids.tobytes()], "data": [data.tobytes()]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    return dealt.groupBy("dim", name).applyInPandas(pack, f"dim int, {name} int, ids binary, data binary"), tiles


def _unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.int32 if len(data) == 4 * len(own) * dim else np.int64
    return own, np.frombuffer(data, kind).reshape(len(own), dim)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest scores, then smallest ids; sorted so."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], score[place < k]


def _pair_top(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and scores of the k best candidates of a tile for each query of a block."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, c)]
    exact = largest[0] * largest[1] * max(q.shape[1], 1) < 2**53  # then float64 products and sums are whole numbers without rounding
    kind = np.float64 if exact else np.int64
    right, found = c.T.astype(kind), []
    for i in range(0, len(qi), step):
        score = q[i : i + step].astype(kind) @ right
        same = qi[i : i + step, None] == ci[None, :]
        least = score.min(initial=0) - 1 if exact else np.iinfo(np.int64).min
        score[same] = least
        if len(ci) > k:  # all that reach the k-th score
            near = score >= np.partition(score, len(ci) - k, axis=1)[:, len(ci) - k, None]
        else:
            near = np.ones(score.shape, bool)
        row, at = np.nonzero(near & ~same)
        found.append(_best(row + i, ci[at], score[row, at].astype(np.int64), k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tile_top(k: int, rows: int, step: int, tasks: int, blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query among a task's rows ``id, q, dim``."""
        held: dict[tuple[int, int], tuple] = {}  # the lists of a pass's blocks so far, k for each query
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                tile = batch.slice(i, rows)
                dims = tile.column(2).to_numpy()
                for dim in np.unique(dims):
                    own = tile.filter(pa.array(dims == dim))
                    ci, c = own.column(0).to_numpy(), own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dim)
                    for block, q_ids, q_data in blocks.value.get(int(dim), ()):
                        qi, q = _unpacked(q_ids, q_data, int(dim))
                        row, ids, score = _pair_top(qi, q, ci, c, k, step)
                        new, key = (qi[row], ids, score), (int(dim), block)
                        held[key] = _best(*(np.concatenate(x) for x in zip(held[key], new, strict=True)), k) if key in held else new
        task = TaskContext.get().partitionId() % tasks
        for (dim, block), lists in held.items():
            values = [dim, block, task, *[x.astype(np.int64).tobytes() for x in lists]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32()] * 3 + [pa.binary()] * 3, strict=True)], names=["dim", "block", "shard", "q_ids", "ids", "scores"])

    return run


def _merged(k: int):
    def run(lists: pd.DataFrame) -> pd.DataFrame:
        query, ids, score = (np.concatenate([np.frombuffer(x, np.int64) for x in lists[c]]) for c in ("q_ids", "ids", "scores"))
        query, ids, score = _best(query, ids, score, k)
        return pd.DataFrame({"dim": lists["dim"].iloc[:1], "block": lists["block"].iloc[:1], "shard": lists["shard"].iloc[:1], "q_ids": [query.tobytes()], "ids": [ids.tobytes()], "scores": [score.tobytes()]})

    return run


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for lists in batches:
        for q_ids, ids, scores in zip(lists["q_ids"], lists["ids"], lists["scores"], strict=True):
            query = np.frombuffer(q_ids, np.int64)
            rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
            yield pd.DataFrame({"query_id": query, "rank": rank.astype(np.int32), "vec_id": np.frombuffer(ids, np.int64), "score": np.frombuffer(scores, np.int64)})


def top_k(queries: DataFrame, candidates: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates with the highest integer inner product.

    Components become floor(scale * x). A row is no candidate of a query with its own id; ties go
    to the smaller id; vectors null or with a null or non-finite component take no part, and
    vectors meet only vectors of their length. Ids null take no part. Scores are 64-bit: components
    whose products leave that range wrap around as longs do. Fewer than k candidates give all; empty
    tables give an empty result. A candidate row that repeats counts as often as it stands there;
    queries of one id are one query each, and share its list of k.
    """
    spark, tables = candidates.sparkSession, Tables(candidates.sparkSession)
    rows = _quantised(candidates, id_col, vector_col, scale)
    tasks = max(1, min(-(-rows.count() // SHARD_ROWS), TASKS))
    # a fixed number of tasks, as adaptive execution would put small inputs with long products into one
    rows = rows.repartition(tasks)
    blocks, n_blocks = _packed(_quantised(queries, id_col, vector_col, scale).dropDuplicates(["id", "dim"]), BLOCK_ROWS, "block")
    blocks = tables.write(blocks, "blocks")
    largest = blocks.groupBy("block").agg(F.sum(F.length("data") + F.length("ids")).alias("n")).agg(F.max("n")).first()[0] or 1
    passes = -(-n_blocks // max(1, PASS // largest))
    rows = tables.write(rows, "candidates") if passes > 1 else rows
    out = None
    for p in range(passes):
        few: dict[int, list] = {}
        for r in blocks.where(F.col("block") % passes == p).toLocalIterator():  # PASS bytes, or one block
            few.setdefault(r["dim"], []).append((r["block"], bytes(r["ids"]), bytes(r["data"])))
        held, left = spark.sparkContext.broadcast(few), TASKS if passes > 1 else tasks
        lists = rows.mapInArrow(_tile_top(k, SHARD_ROWS, STEP, left, held), _LISTS)
        while left > 1:
            left = -(-left // FAN)
            lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")).groupBy("dim", "block", "shard").applyInPandas(_merged(k), _LISTS)
        lists = lists.mapInPandas(_spread, "query_id long, rank int, vec_id long, score long")
        if passes > 1:
            lists = tables.write(lists, f"lists-{p}")
            held.destroy()
        out = lists if out is None else out.unionByName(lists)
    return out


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op10_topk_search": op10_topk_search}
ORACLES = {"op10_topk_search": ORACLE}
