"""Exact deduplication by 128-bit content hash.

Rows group by a 128-bit hash of the normalised text. Inside a hash group Spark's aggregation
compares the texts byte by byte (the text is a grouping key), so a hash collision splits into
its own groups. Partial aggregation collapses copies before the shuffle; a group of copies that
holds a third of all rows therefore leaves each map task as one row. All of it is DataFrame
functions: no Arrow batches of texts are held beside the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._spark import UPPER, ascii_lower, table


def _row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and raw text: rows alike in both are one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("null:")))))


def _groups(docs: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """Rows, and the groups of equal texts with the row that stays: least or largest id, then row key; null ids last."""
    known = F.col("id").isNotNull()
    best = F.min(F.struct(~known, "id", "row")) if keep == "smallest" else F.max(F.struct(known, "id", "row"))
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(_row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.select("*", F.unhex(F.md5("text")).alias("h"), F.sha2("text", 256).alias("sha"))
    groups = rows.groupBy("h", "sha", "text").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows, groups.select("h", "sha", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Say of every row which row of its group of equal texts stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Returns one row
    per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Rows repeated with the same
    id count in ``group_size`` and carry the same decision. A null id stays only where its group
    has no other. An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    rows, groups = _groups(docs, id_col, text_col, keep)
    return rows.select("id", "h", "sha").join(groups, ["h", "sha"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of ``docs`` for each text, all columns. Rows decide, not ids: different texts of one id, or of
    null ids, all stay; of rows alike in id and text one stays."""
    _, groups = _groups(docs, id_col, text_col, keep)
    return docs.withColumn("_row", _row_key(id_col, text_col)).join(groups.select(F.col("keep_row").alias("_row")), "_row").dropDuplicates(["_row"]).drop("_row")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": ORACLE}
