"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._spark import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked with the node's least neighbour, or with the node if that is less.

    ``edges`` and the result have u > v. The least neighbour is an aggregate, never a gathered list;
    the join back on a node with many neighbours is one that Spark can split."""
    ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = ends.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below it are linked with the least of those; u > v again."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node below it and none to any above, or only the latter: no step would change that."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    open_nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least")).where("below > 1 OR below = 1 AND least = 0")
    return not open_nodes.agg(F.count(F.lit(1))).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (u, v)``: the least node that it reaches.

    Loops and repeated edges are allowed; nulls take no part; no edges give no rows. Each round
    is written to the checkpoint folder, so lost executors cost no earlier round. The number of
    rounds grows with the logarithm of the node count; edges that are stars need none.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    while not _stars(edges):
        edges = cut(_small_star(_large_star(edges)))
    rows = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    return edges.select(F.explode(rows).alias("e")).select("e.node", "e.component").distinct()


def with_links(components: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` after more ``edges (u, v)``: only those between two components are searched, as edges of these."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    named = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v"))
    more = connected_components(named)
    moved = components.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return moved.select("node", F.coalesce("to", "component").alias("component")).union(more).distinct()
