"""Correlations of many members by products of matrices.

Values of members stand in blocks of ``TIMES`` places in time by ``MEMBERS`` members. Two blocks of one stretch
of time give the sums of all their pairs by five matrix products (values, squares, places where both are), and
the sums of a pair are added up over the stretches, first inside each task. No row of one member ever meets
a row of another one: instead of members^2 x bars rows there are members^2 sums a stretch of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import blocks

#: Places in time and members of a block (a block of values is 1 MB).
TIMES, MEMBERS = 1024, 128
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
_PAIRS = "cut long, a long, b long, " + ", ".join(f"{s} double" for s in SUMS)


def _places(series: DataFrame, value: str, member: str) -> tuple[DataFrame, DataFrame]:
    """``m`` (number of the member), ``i`` (place in time from 0), ``x``; and the names of the numbers with their lengths."""
    rows = series.select(F.col(member).alias("_member"), "ts", F.lit("1h").alias("interval"), F.col(value).cast("double").alias("x"))
    placed = blocks.numbered(rows, by=("_member",)).select("_member", F.col("_pos").alias("i"), "x")
    known = placed.groupBy("_member").agg(F.count(F.lit(1)).alias("length"), F.avg("x").alias("_centre"))
    names = known.withColumn("m", F.row_number().over(Window.orderBy("_member")) - 1).select("m", "_member", "length", "_centre")  # a row a member
    return placed.join(names, "_member").select(F.col("m").cast("long"), "i", (F.col("x") - F.col("_centre")).alias("x")), names


def _packed(rows: DataFrame) -> DataFrame:
    """``cut, t, g, data``: blocks of values by cut, stretch of time and group of members."""
    times, members = TIMES, MEMBERS

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        data = np.full((times, members), np.nan)
        data[table["i"].to_numpy() % times, table["m"].to_numpy() % members] = table["x"].to_numpy()
        return pa.table({"cut": [key[0].as_py()], "t": [key[1].as_py()], "g": [key[2].as_py()], "data": [data.tobytes()]})

    dealt = rows.withColumns({"t": F.floor(F.col("i") / times), "g": F.floor(F.col("m") / members)})
    return dealt.groupBy("cut", "t", "g").applyInArrow(pack, "cut long, t long, g long, data binary")


def _products(times: int, members: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of all pairs of two blocks; the second group is never before the first."""
        for batch in batches:
            for cut, g, h, left, right in zip(*[batch.column(k) for k in range(5)], strict=True):
                a, b = (np.frombuffer(x.as_py(), np.float64).reshape(times, members) for x in (left, right))
                (ma, a), (mb, b) = ((~np.isnan(x), np.nan_to_num(x)) for x in (a, b))
                fa, fb = ma.astype(float), mb.astype(float)
                sums = [fa.T @ fb, a.T @ fb, fa.T @ b, (a * a).T @ fb, fa.T @ (b * b), a.T @ b]
                i, j = np.nonzero((sums[0] > 0) & ((g.as_py() < h.as_py()) | (np.arange(members)[:, None] <= np.arange(members))))
                columns = [np.full(len(i), cut.as_py()), i + g.as_py() * members, j + h.as_py() * members, *[s[i, j] for s in sums]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cut", "a", "b", *SUMS])

    return run


def pair_sums(rows: DataFrame) -> DataFrame:
    """Sums over the places where both have a value, of each pair of members (a <= b) of rows ``cut, m, i, x``."""
    packed = _packed(rows)
    right = packed.select("cut", "t", F.col("g").alias("h"), F.col("data").alias("other"))
    met = packed.join(right, ["cut", "t"]).where("g <= h").select("cut", "g", "h", "data", "other")
    return met.mapInArrow(_products(TIMES, MEMBERS), _PAIRS).groupBy("cut", "a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])


def correlations(series: DataFrame, value: str, member: str = "symbol", *, spearman: bool = False) -> DataFrame:
    """``metrics.correlations`` by matrix products: ``a, b, correlation`` of all pairs, both ways.

    Values meet by place in time, the longer series is cut; 0 without variance. Places of a series are counted by
    blocks of it. Ranks are those of the common stretch, so a member is ranked once for each shorter length that
    another one has (once in all where all are equally long); ties get the mean of their ranks."""
    rows, names = _places(series, value, member)
    if not spearman:
        rows = rows.withColumn("cut", F.lit(0).cast("long"))
    else:
        cuts = names.select(F.col("length").alias("cut")).distinct()
        own = names.select(F.col("m").cast("long").alias("m"), "length")
        wanted = own.join(cuts, F.col("cut") <= F.col("length")).select("m", "cut")  # members x lengths
        rows = rows.join(wanted, "m").where("i < cut")
        w = Window.partitionBy("cut", "m")
        ties = F.count(F.lit(1)).over(Window.partitionBy("cut", "m", "x"))
        rows = rows.select("cut", "m", "i", (F.rank().over(w.orderBy("x")) + (ties - 1) / 2 - F.col("cut") / 2).alias("x"))
    sums = pair_sums(rows)
    length = lambda side: names.select(F.col("m").cast("long").alias(side), F.col("_member").alias(f"_{side}"), F.col("length").alias(f"_n{side}"))
    met = sums.join(length("a"), "a").join(length("b"), "b")
    if spearman:
        met = met.where(F.col("cut") == F.least("_na", "_nb"))
    n = F.col("n")
    va, vb = F.col("saa") / n - F.pow(F.col("sa") / n, F.lit(2.0)), F.col("sbb") / n - F.pow(F.col("sb") / n, F.lit(2.0))
    flat = (F.sqrt(F.greatest(va, F.lit(0.0))) <= 1e-12) | (F.sqrt(F.greatest(vb, F.lit(0.0))) <= 1e-12)
    found = F.when(flat, 0.0).otherwise(F.coalesce((F.col("sab") / n - F.col("sa") / n * F.col("sb") / n) / F.nullif(F.sqrt(va * vb), F.lit(0.0)), F.lit(0.0)))
    out = met.select(F.col("_a").alias("a"), F.col("_b").alias("b"), found.alias("correlation"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return out.select(F.explode(both).alias("p"), "correlation").select("p.a", "p.b", "correlation")
