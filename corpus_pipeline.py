"""Corpus pipeline: quality filter, exact and near deduplication, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
folder that the cluster shares and read again as the next stage's docs. All but the last stage
return the columns of documents, of the rows that stay (a row comes twice where the mix takes it
twice). Stages that run Python bound the bytes of Arrow batches first: executors keep their heap and
their Python workers from stage to stage, so what one stage took stands beside the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, exact_dedup, near_dedup, quality, source_mix
from barloom.llm._spark import Tables, small_batches, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 4)."""
    small_batches(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays (operator 9)."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, five words and 0.8 (operator 5)."""
    small_batches(spark)
    return near_dedup.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them (operator 2)."""
    return source_mix.mixed_documents(docs, quality=table(spark, sf_dir, "labels").select("doc_id", "quality"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with counts and digests of ids and decoded text (operator 8)."""
    small_batches(spark)
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix),
    ("bpe", tokenise),
]

#: The classifier, the sampler's whole documents and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read back."""
    tables, docs, before = Tables(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)  # the stage that read it is written
        before = name
    return docs
