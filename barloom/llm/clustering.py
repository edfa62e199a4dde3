"""Centroid clustering with Drake's adaptive bounds.

Vectors are quantised to whole numbers and packed into blocks of rows; a block carries, for each of its
vectors, the assigned centroid, an upper bound of the distance to it, lower bounds of the distances to the
``b`` next centroids in order, and one remainder bound for all others. After the centroids have moved,
every bound moves by their drift. The first place of the ordered list from which all lower bounds, and
the remainder, stay above the upper bound certifies the rest: only the centroids before that place are measured
again, exactly, and put in order; where not even the remainder is above, all centroids are. ``b`` adapts:
the next round keeps as many bounds as the last one had use for, down to a floor.

Measured distances are exact whole numbers and bounds are widened by rounding, so the assignment is that
of full comparisons, ties to the smaller number included. A round is one pass over the blocks without a
shuffle of vectors: a block gives what its moved vectors add to the sums of the clusters, Spark adds these up
(k times components numbers reach the driver), and the blocks are written to the shared folder for the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._spark import Tables, table

#: Vectors of a block, and the relative widening of a bound.
ROWS, WIDEN = 4096, 1e-12
#: Components up to which squared distances are exact in 64 bits (for up to 2^10 components); larger ones are compared as Python's whole numbers.
LARGE = 1 << 25
_BLOCK = "ids array<long>, data binary, kind string, near binary, low binary, used int, full long, moved array<struct<cluster:int,n:long,sums:array<decimal(25,0)>>>"
LONGEST = (1 << 63) - 1


class State:
    """Bounds of the vectors of a block: ``near[:, 0]`` is the assigned centroid and ``low[:, 0]`` its upper bound,
    then come the next centroids with their lower bounds; the last of ``low`` is the remainder's."""

    def __init__(self, near: np.ndarray, low: np.ndarray):
        self.near, self.low = near, low

    @classmethod
    def read(cls, near: bytes, low: bytes, n: int) -> State:
        return cls(np.frombuffer(near, np.int32).reshape(n, -1).copy(), np.frombuffer(low, np.float64).reshape(n, -1).copy())


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to the centroids c (all, or ``c[i]`` of row i)."""
    if max(np.abs(x.astype(float)).max(initial=0), np.abs(c.astype(float)).max(initial=0)) > LARGE:
        x, c = x.astype(object), c.astype(object)
    if c.ndim == 2:
        return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    return ((x[:, None, :] - c) ** 2).sum(axis=2)


def _roots(d: np.ndarray, sign: int) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + sign * WIDEN)


def _ordered(d: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places of each row's distances in order, ties by the centroid's number."""
    by_number = np.argsort(number, axis=1, kind="stable")
    order = np.argsort(np.take_along_axis(d, by_number, 1), axis=1, kind="stable")
    return np.take_along_axis(by_number, order, 1)


def measured(x: np.ndarray, centroids: np.ndarray, b: int) -> State:
    """All centroids measured: the nearest, the ``b`` next ones and the remainder."""
    d = _squared(x, centroids)
    order = _ordered(d, np.broadcast_to(np.arange(len(centroids)), d.shape))
    d = np.take_along_axis(d, order, 1)
    b = min(b, len(centroids) - 1)
    low = np.full((len(x), b + 2), np.inf)
    low[:, : b + 1] = _roots(d[:, : b + 1], -1)
    low[:, 0] = _roots(d[:, 0], 1)
    if b + 1 < len(centroids):
        low[:, b + 1] = _roots(d[:, b + 1], -1)
    return State(order[:, : b + 1].astype(np.int32), low)


def moved_on(x: np.ndarray, state: State, centroids: np.ndarray, drift: np.ndarray, b: int) -> tuple[int, int]:
    """One round in place: bounds move, what they can't certify is measured again.

    Returns the largest number of listed bounds that were of use, and the number of vectors that met all centroids."""
    near, low = state.near, state.low
    low[:, 0] = (low[:, 0] + drift[near[:, 0]]) * (1 + WIDEN)
    low[:, 1:-1] -= drift[near[:, 1:]]
    low[:, -1] -= drift.max(initial=0)
    low[:, 1:] *= np.where(low[:, 1:] > 0, 1 - WIDEN, 1 + WIDEN)
    rest = np.minimum.accumulate(low[:, :0:-1], axis=1)[:, ::-1]  # the least lower bound from each place on
    open_ = np.flatnonzero(~(low[:, 0] < rest[:, 0]))
    if len(open_):  # the upper bound made exact certifies some more
        low[open_, 0] = _roots(_squared(x[open_], centroids[near[open_, :1]])[:, 0], 1)
        open_ = open_[~(low[open_, 0] < rest[open_, 0])]
    certified = low[open_, :1] < rest[open_]
    place = np.where(certified.any(axis=1), certified.argmax(axis=1), rest.shape[1])  # the first certified place of the list
    width, used = near.shape[1], 0
    for p in np.unique(place[place < rest.shape[1]]):
        of, used = open_[place == p], max(used, int(p))
        number = near[of, : p + 1]
        d = _squared(x[of], centroids[number])
        order = _ordered(d, number)
        d = np.take_along_axis(d, order, 1)
        near[of, : p + 1] = np.take_along_axis(number, order, 1)
        low[of, : p + 1] = _roots(d, -1)
        low[of, 0] = _roots(d[:, 0], 1)
    full = open_[place == rest.shape[1]]
    if len(full):
        fresh = measured(x[full], centroids, width - 1)
        near[full], low[full] = fresh.near, fresh.low
    if b + 1 < width:  # fewer bounds from here on: what is dropped goes to the remainder
        state.near, state.low = near[:, : b + 1].copy(), np.concatenate([low[:, : b + 1], low[:, b + 1 :].min(axis=1, keepdims=True)], axis=1)
    return (width - 1 if len(full) else used), len(full)


def _sums(x: np.ndarray, clusters: np.ndarray, sign: int) -> dict[int, tuple[int, list[int]]]:
    if np.abs(x.astype(float)).max(initial=0) > 1 << 40:  # else sums of a block stay under 2^63
        x = x.astype(object)
    return {int(c): (sign * int((clusters == c).sum()), [sign * int(v) for v in x[clusters == c].sum(axis=0)]) for c in np.unique(clusters)}


def _written(ids: list, x: np.ndarray, state: State, used: int, full: int, moved: list) -> pa.RecordBatch:
    small = np.abs(x.astype(float)).max(initial=0) < 1 << 31
    values = [[ids], [(x.astype(np.int32) if small else x).tobytes()], ["i4" if small else "i8"], [state.near.tobytes()], [state.low.tobytes()], [used], [full], [moved]]
    whole = pa.decimal128(25, 0)
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(whole))]))]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["ids", "data", "kind", "near", "low", "used", "full", "moved"])


def _changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> list[dict]:
    """What moved vectors add to the sums of clusters."""
    changed = slice(None) if old is None else np.flatnonzero(old != new)
    out = {} if old is None else _sums(x[changed], old[changed], -1)
    for c, (n, sums) in _sums(x[changed], new[changed], 1).items():
        before = out.get(c, (0, [0] * len(sums)))
        out[c] = (n + before[0], [a + b for a, b in zip(sums, before[1], strict=True)])
    return [{"cluster": c, "n": n, "sums": sums} for c, (n, sums) in out.items()]


def _first(centroids: np.ndarray, b: int, dim: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                state = measured(x, centroids, b)
                yield _written(part.column(0).to_pylist(), x, state, state.near.shape[1] - 1, len(x), _changes(x, None, state.near[:, 0]))

    return run


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[list, np.ndarray, State]]:
    for ids, data, kind, near, low in zip(*[batch.column(k) for k in range(5)], strict=True):
        ids = ids.as_py()
        yield ids, np.frombuffer(data.as_py(), kind.as_py()).reshape(len(ids), dim).astype(np.int64), State.read(near.as_py(), low.as_py(), len(ids))


def _next(centroids: np.ndarray, drift: np.ndarray, b: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, state in _unpacked(batch, dim):
                old = state.near[:, 0].copy()
                used, full = moved_on(x, state, centroids, drift, b)
                yield _written(ids, x, state, used, full, _changes(x, old, state.near[:, 0]))

    return run


def _assigned(centroids: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, state in _unpacked(batch, dim):
                cluster = state.near[:, 0]
                distance = [min(int(v), LONGEST) for v in _squared(x, centroids[state.near[:, :1]])[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return run


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.array([float(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 for x, y in zip(old, new, strict=True)]) * (1 + WIDEN)


def kmeans(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", bounds: int | None = None
) -> tuple[DataFrame, list[list[int]], list[dict]]:
    """Assignments ``id, cluster, distance`` (squared), the final centroids, and of each round its bounds and full scans.

    Vectors with exactly ``dim`` components, none null or non-finite, become floor(scale * x) (held in 64 bits).
    Centroids start as the k vectors whose SHA-256 of ``seed:id`` is least (ties: smaller vector; rows without an
    id come last), fewer where there are fewer rows; after each of ``rounds`` assignments a centroid
    becomes the floor of its vectors' mean, an empty one stays; one more assignment follows. Ties go to the smaller
    number. Distances over 2^63 - 1 are given as that. Repeated rows count each; an id may be null; no vectors give
    no rows; other columns are ignored.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(x.isNotNull() & (F.size(x) == dim) & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("q"))
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "q").limit(k).collect()  # k rows
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not first:
        return spark.createDataFrame([], schema), [], []
    centroids = np.array([r.q for r in first], np.int64)
    k = len(centroids)
    least, b, trace = max(1, -(-k // 8)), min(k - 1, bounds or max(3, -(-k // 4))), []
    blocks = tables.write(rows.mapInArrow(_first(centroids, b, dim, ROWS), _BLOCK), "round-0")
    totals = {c: (0, [0] * dim) for c in range(k)}
    for r in range(1, rounds + 1):
        told = blocks.agg(F.max("used").alias("used"), F.sum("full").alias("full")).first()
        trace.append({"bounds": b, "used": told.used, "full": told.full})
        part = blocks.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("place", "v"))
        summed = part.groupBy("cluster", "place").agg(F.sum("v").cast("decimal(38,0)").alias("v"), F.sum("n").alias("n")).collect()  # k x dim rows
        for row in summed:
            n, sums = totals[row.cluster]
            sums[row.place] += int(row.v)
            totals[row.cluster] = (n + row.n if row.place == 0 else n, sums)
        moved = np.array([[s // n for s in sums] if n else centroids[c].tolist() for c, (n, sums) in sorted(totals.items())], np.int64)
        drift, centroids = _drift(centroids, moved), moved
        b = max(min(b, least), min(b, told.used)) if r > 1 else b
        blocks = tables.write(blocks.select("ids", "data", "kind", "near", "low").mapInArrow(_next(centroids, drift, b, dim), _BLOCK), f"round-{r}")
        tables.drop(f"round-{r - 1}")
    found = blocks.select("ids", "data", "kind", "near", "low").mapInArrow(_assigned(centroids, dim), schema)
    return tables.write(found, "assigned"), centroids.tolist(), trace


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia, inertia, centroid_sha256``: a row a cluster is broadcast."""
    if not centroids:
        return found.select("id", "cluster", "distance", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    total = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    held = lambda v: min(int(v), LONGEST)
    every = held(sum(r.d for r in total))
    rows = [(r.cluster, held(r.d), every, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in total]
    sums = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = kmeans(table(spark, sf_dir, "embeddings"))
    return with_inertia(found, centroids).withColumnRenamed("id", "vec_id")


def _oracle(k: int = 8, rounds: int = 10) -> str:
    """Full comparisons, round by round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))",
    ]
    near = (
        "a{0} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{0} c) GROUP BY r)"
    )
    for i in range(rounds + 1):
        steps.append(near.format(i))
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
    SELECT c, list(floor_mean ORDER BY place) AS q FROM (
      SELECT c, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
      FROM (SELECT a.c, unnest(range(1, 65)) AS place, unnest(v.q) AS x FROM v JOIN a{i} a ON a.r = v.r) GROUP BY c, place) GROUP BY c) m ON m.c = c.c)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON a.r = v.r JOIN c{rounds} c ON c.c = a.c"""


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLES = {"op11_centroid_clustering": _oracle()}
