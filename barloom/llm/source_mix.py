"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source has a target in words. Whole epochs of the source come first; what is left of the
target is filled by weighted sampling without replacement: a row with quality weight w gets the
key u^(1/w), rows are taken in falling key order, and a prefix sum of sizes stops at the budget.
u comes from a hash of id and text, so reruns agree, and different rows without an id have keys of their own.

The prefix sum runs over 65,536 key ranges per source in two levels of 256 (range totals are
aggregated before the shuffle), so no task ever holds one source: a source with a third of all
rows is dealt over all its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm._spark import WORD, cut, table

FAN = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def uniform(ident: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 by what the row holds: 52 bits of a hash of seed, id and text."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def sampling_key(u: Column, quality: Column) -> Column:
    """u^(1/w) with w = 4 for quality 1, 1 for quality 0 and 2 where it is unknown (roots are exact)."""
    return F.when(quality == 1, F.sqrt(F.sqrt(u))).when(quality == 0, u).otherwise(F.sqrt(u))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of sources (``source, source_size``, a row each): water-filling by one ordered scan.

    A source is at its limit when the water level of all that are not smaller in limit over weight
    reaches that ratio; the rest share what is left by weight. The table has one row per source.
    """
    every = Window.partitionBy()
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    placed = sizes.withColumn("place", F.row_number().over(rank) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    levelled = (
        placed.withColumn("w", weight)
        .withColumn("top", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("top") / F.col("w"))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("words", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("full", F.col("top") * (F.col("all_w") - F.coalesce(F.sum("w").over(before), none)) <= F.col("w") * (F.col("words") - F.coalesce(F.sum("top").over(before), none)))
    )
    left = F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(every), none)
    open_w = F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), none)
    return levelled.withColumn("target", F.when(F.col("full"), F.col("top")).otherwise(F.col("w") * (left / F.nullif(open_w, none)))).select(
        "source", "source_size", "place", "target"
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    whole: bool = False,
    row_col: str | None = None,
) -> DataFrame:
    """Words that the mix takes of every row: ``doc_id, size, source_size, target, taken, copies``
    (and ``row``, where ``row_col`` names a key of the row).

    ``quality`` (``doc_id, quality``) scales the sampling weights; a missing or null mark weighs 2.
    ``taken`` is epochs * size plus the part of the last epoch; the row on which the budget ends is
    taken in part, so a source's words meet its target to the word. With ``whole`` that row counts
    whole if at least half of it fits. Null sources form one source, null or empty texts have size
    0 and take 0, ties in the key go by id. An empty table gives an empty result; other columns
    are ignored, and rows are never dropped.
    """
    own = F.col(row_col) if row_col else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), own.alias("row"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"))
    if quality is None:
        rows = rows.withColumn("q", F.lit(None).cast("int"))
    else:
        marks = quality.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("q"))
        rows = rows.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = cut(rows.withColumn("v", sampling_key(F.col("u"), F.col("q"))).drop("q", "u"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most)
    part = F.floor((1 - F.col("v")) * (FAN * FAN)).cast("int")
    placed = rows.join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source").withColumn("part", F.least(part, F.lit(FAN * FAN - 1)))

    leaves = placed.groupBy("place", "part").agg(F.sum("size").alias("words")).withColumn("upper", F.floor(F.col("part") / FAN).cast("int"))
    uppers = leaves.groupBy("place", "upper").agg(F.sum("words").alias("words"))
    upto = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    uppers = uppers.select("place", "upper", F.coalesce(F.sum("words").over(upto("place", by="upper")), zero).alias("upper_before"))
    starts = leaves.withColumn("in_upper", F.coalesce(F.sum("words").over(upto("place", "upper", by="part")), zero)).join(uppers, ["place", "upper"])
    starts = starts.select("place", "part", (F.col("upper_before") + F.col("in_upper")).alias("start"))

    in_leaf = Window.partitionBy("place", "part").orderBy(F.col("v").desc(), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("in_leaf", F.coalesce(F.sum("size").over(in_leaf), zero))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))), zero)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    before = F.col("start") + F.col("in_leaf")
    last = (
        F.when(before + F.col("size") / 2 <= rest, F.col("size")).otherwise(zero)
        if whole
        else F.greatest(zero, F.least(F.col("size"), F.floor(rest) - before))
    )
    return (
        local.join(starts, ["place", "part"])
        .withColumn("epochs", epochs)
        .withColumn("taken", F.when(F.col("size") > 0, F.col("epochs") * F.col("size") + last).otherwise(zero).cast("long"))
        .select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "taken", F.ceil(F.col("taken") / F.nullif(F.col("size"), zero)).alias("copies"), *(["row"] if row_col else []))
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole documents only, all columns.

    Rows decide, not ids: each is taken as often as a row of its id, source and text is; rows alike in
    all three share their copies evenly, the first ones by chance one more."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(source_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col).cast("string"), F.lit("null"))))
    keyed = docs.withColumn("_row", F.unhex(key))
    taken = mix_sources(keyed, id_col=id_col, text_col=text_col, source_col=source_col, whole=True, row_col="_row", **how).where("copies > 0")
    times = taken.groupBy(F.col("row").alias("_row")).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_taken"))
    one = keyed.join(times, "_row")
    same = F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(1)))  # rows alike, nearly always one
    copies = F.when(same <= F.col("_taken"), F.floor(F.col("_all") / F.col("_taken")) + (same <= F.col("_all") % F.col("_taken")).cast("int")).otherwise(0).cast("int")
    one = one.withColumn("_copies", copies).where("_copies > 0")
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_row", "_all", "_taken", "_copies", "_copy")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return mix_sources(table(spark, sf_dir, "documents"), quality=labels).drop("copies")


ORACLE = r"""
WITH marks AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, q,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents LEFT JOIN marks USING (doc_id)),
r AS (SELECT *, CASE WHEN q = 1 THEN sqrt(sqrt(u)) WHEN q = 0 THEN u ELSE sqrt(u) END AS v FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM r GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(place % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS top FROM s),
l AS (SELECT *, sum(w) OVER () AS all_w, sum(source_size) OVER () * 1.5::DOUBLE AS words,
         coalesce(sum(w) OVER b, 0) AS w_before, coalesce(sum(top) OVER b, 0) AS top_before
      FROM w WINDOW b AS (ORDER BY top / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, top * (all_w - w_before) <= w * (words - top_before) AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN top ELSE w * (
         (words - coalesce(sum(CASE WHEN is_full THEN top END) OVER (), 0)) / nullif(all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0), 0)) END AS target FROM f),
p AS (SELECT doc_id, size, source_size, coalesce(target, 0) AS target, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY v DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)) ELSE 0 END::BIGINT AS taken
FROM p
"""

QUERIES = {"op2_source_mix": op2_source_mix}
ORACLES = {"op2_source_mix": ORACLE}
