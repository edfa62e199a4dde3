"""Licence scans with a trained paragraph classifier, in DataFrame functions and Spark ML.

Every paragraph of every text is judged: each line, and each block of lines that belong together
(a line that ends in no stop goes on in the next), so that wrapped notices are seen whole. Sparse
word n-grams (one and two words of the training notices) feed a multinomial logistic regression over
licence families and an unknown class. It is trained on windows of the templates and, for the unknown
class, on all ordinary paragraphs of the table plus licence talk that names no family: paragraphs with
the same n-grams are one row that counts as often as they occur. The probability limit is calibrated on
all ordinary paragraphs that were held out, a quarter. A prediction is confirmed when the paragraph also
holds enough of a template of that family, and no more of any other's.

The weights tell which paragraphs can't be notices: as long as the words of ``evidence`` are missing,
all other n-grams together don't lift a family over the limit. Texts and paragraphs without such a
word are thus left out by one pattern, before any n-gram is made, and no result changes.
"""

from __future__ import annotations

import math

import numpy as np
import regex
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm._spark import Tables, cut, table
from barloom.llm.license_texts import GENERAL, TEMPLATES

UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES))
#: A block of lines ends at a blank line or at a line that ends in a stop.
BLOCK_END = r"(?<=[.!?:;])[ \t\r]*\n|\n[ \t\r]*\n"
#: In the fit, ordinary paragraphs count as so many together at most, however many there are; a notice's window counts as one.
ORDINARY = 1500.0
#: Share of the held-out ordinary paragraphs that stays under the limit, which is a multiple of 1 / ``STEPS``.
UNDER, STEPS = 0.999, 10_000
#: A word; dots inside it stay (2.0), dots after it go.
_WORD = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"


def _words(text: str) -> list[str]:
    return regex.findall(_WORD, text.lower())


def word_pairs(text: str) -> list[str]:
    """Distinct word pairs of a template, split as the scanned paragraphs are."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


#: Words and word pairs of the training notices: the features of the model.
VOCABULARY = sorted({g for t in (*(t for _, t in TEMPLATES), *GENERAL) for g in (*_words(t), *word_pairs(t))})


def features(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``pairs`` (word pairs) and ``features`` (which of ``VOCABULARY`` are there)."""
    df = df.withColumn("_words", F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(_WORD), F.lit(0)))
    df = NGram(n=2, inputCol="_words", outputCol="pairs").transform(df).withColumn("_grams", F.concat("_words", "pairs"))
    known = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="_grams", outputCol="features", binary=True)
    return known.transform(df).drop("_words", "_grams")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, kind, paragraph, text``: lines (kind ``line``) and blocks of several lines (``block``), each
    numbered from 0 in its text; those without a letter or digit are left out."""
    text = F.col(text_col).cast("string")
    numbered = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("paragraph"), x.alias("text"))
    lines, blocks = F.transform(F.split(text, "\n"), numbered("line")), F.transform(F.split(text, BLOCK_END), numbered("block"))
    blocks = F.filter(blocks, lambda x: F.contains(F.btrim(x["text"]), F.lit("\n")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.concat(lines, blocks)).alias("p"))
    return rows.select("doc_id", "p.kind", "p.paragraph", "p.text").where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def agreements(pairs: Column) -> Column:
    """For each template ``family`` and the ``share`` of its word pairs that are among ``pairs``."""
    known = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, word_pairs(t))).alias("pairs")) for f, t in TEMPLATES if word_pairs(t)])
    return F.transform(known, lambda t: F.struct(t["family"].alias("family"), (F.size(F.array_intersect(t["pairs"], pairs)) / F.size(t["pairs"])).alias("share")))


def alike(places: Column) -> Column:
    """Whether ``places`` of ``VOCABULARY``, each once, have a fifth of any template's word pairs."""
    place = {g: i for i, g in enumerate(VOCABULARY)}
    pairs = [p for p in (word_pairs(t) for _, t in TEMPLATES) if p]
    within: list[list[int]] = [[] for _ in VOCABULARY]
    for k, ps in enumerate(pairs):
        for g in ps:
            within[place[g]].append(k)
    templates = F.array(*[F.array(*map(F.lit, ks)).cast("array<int>") for ks in within])
    enough = F.array(*[F.lit(math.ceil(len(ps) / 5)) for ps in pairs])
    held = F.array_sort(F.flatten(F.transform(places, lambda i: F.get(templates, i))))  # each template once per pair of it
    return F.size(F.filter(F.transform(held, lambda k, i: F.get(held, i + F.get(enough, k) - 1) == k), lambda same: same)) > 0


def ordinary_paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``features, n``: n-grams of all paragraphs but those that hold a fifth of a template's word pairs, and how many have them.

    The table is written to the shared folder, where a vector's places can be read as an array."""
    sets = features(paragraphs(docs, id_col, text_col), "text").groupBy("features").agg(F.count(F.lit(1)).alias("n"))
    tables = Tables(docs.sparkSession)
    tables.write(sets.select("features", F.col("features").alias("sparse"), "n"), "sets")
    plain = StructType([StructField("features", VectorUDT()), StructField("sparse", VectorUDT.sqlType()), StructField("n", LongType())])
    sets = docs.sparkSession.read.schema(plain).parquet(f"{tables.folder}/sets")
    return sets.where(~alike(F.col("sparse.indices"))).select("features", "n")


def evidence(model: LogisticRegressionModel, limit: float, common: dict[str, float]) -> list[str]:
    """Words of which a paragraph needs one to be a notice; ``[]`` where none can be left out.

    A family's probability reaches ``limit`` only where its score leads that of the unknown class by
    log(limit / (1 - limit)). Words are picked, those first that weigh most and are in few ordinary
    paragraphs (``common``), until all positive leads of n-grams without a picked word, and the
    intercept, stay under that for every family. The table is that of the model: ``VOCABULARY`` x families.
    """
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    lead = np.maximum(weights[1:] - weights[0], 0.0)
    room = math.log(limit / (1 - limit)) - (start[1:] - start[0]) - 1e-6
    if (room <= 0).any():
        return []
    words = sorted({w for g in VOCABULARY for w in g.split(" ")})
    place = {w: i for i, w in enumerate(words)}
    holds = np.zeros((len(words), len(VOCABULARY)))
    for j, g in enumerate(VOCABULARY):
        holds[[place[w] for w in g.split(" ")], j] = 1.0
    rare = 1.0 / np.array([1.0 + common.get(w, 0) for w in words])
    picked: list[str] = []
    while (over := lead.sum(axis=1) >= room).any():
        best = int(np.argmax((holds @ lead[over].sum(axis=0)) * rare))
        picked.append(words[best])
        lead[:, holds[best] > 0] = 0.0
    return sorted(picked)


def pattern(words: list[str]) -> str:
    """A pattern that finds any of the words as a whole one in lower-case text, by first characters."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:].replace(".", r"\."))
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in heads.items()) + r")(?![\p{L}\p{N}])"


def train(spark: SparkSession, ordinary: DataFrame) -> tuple[LogisticRegressionModel, float, list[str]]:
    """The fitted model, the calibrated probability limit and the words of ``evidence``. ``ordinary`` is that of ``ordinary_paragraphs``."""
    notes = spark.createDataFrame([(f, t) for f, t in TEMPLATES] + [(UNKNOWN, t) for t in GENERAL], "family string, text string")
    w = F.split("text", " ")
    windows = notes.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 5), F.lit(2))))
    windows = windows.select("family", F.array_join(F.slice(w, F.col("i"), 12), " ").alias("text")).union(notes)
    label = (F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1).cast("double")
    windows = cut(features(windows.coalesce(2), "text").select("features", label.alias("label"), F.lit(1.0).alias("weight")))
    sets = ordinary.withColumn("held", F.pmod(F.xxhash64("features"), F.lit(4)) == 0)
    n = sets.where("NOT held").agg(F.sum("n")).first()[0] or 0
    part = min(1.0, ORDINARY / max(1, n))
    rows = windows.union(sets.where("NOT held").select("features", F.lit(0.0).alias("label"), F.col("n") * part))
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60, weightCol="weight").fit(rows)
    p = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
    steps = model.transform(sets.where("held")).groupBy(F.ceil(p * STEPS).cast("int").alias("step")).agg(F.sum("n").alias("n")).collect()  # STEPS rows at most
    limit = min(0.99, max(0.5, quantile([(r["step"], r["n"]) for r in steps], UNDER) / STEPS))
    seen = sets.select("features", "n").union(windows.where("label = 0").select("features", F.lit(1).cast("long")))
    total = seen.select(Summarizer.metrics("sum").summary(F.col("features"), F.col("n").cast("double"))["sum"].alias("s")).first()["s"]
    return model, limit, evidence(model, limit, dict(zip(VOCABULARY, total.toArray(), strict=True)))


def quantile(counts: list[tuple[int, int]], share: float) -> int:
    """The least value that ``share`` of the counted ones don't exceed; 0 without any."""
    need, have = share * sum(n for _, n in counts), 0
    for value, n in sorted(counts):
        have += n
        if have >= need:
            return value
    return 0


def scored(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Adds the most probable ``family`` but the unknown class, its ``probability``, and ``pairs``."""
    found = model.transform(features(rows, "text")).select(*rows.columns, "pairs", F.slice(vector_to_array("probability"), 2, len(FAMILIES)).alias("p"))
    best = F.array_max("p")
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("p", best).cast("int") + 1)
    return found.select(*rows.columns, "pairs", family.alias("family"), best.alias("probability"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", agree: float = 0.7, trained: tuple[LogisticRegressionModel, float, list[str]] | None = None) -> DataFrame:
    """``doc_id, kind, paragraph, family, probability, agreement`` of every licence notice.

    Every line, and every block of several lines, is judged; a notice is one whose most probable
    family reaches the calibrated limit. ``family`` is that one where the paragraph holds at least
    ``agree`` of the word pairs of one of its templates and of no other family's template more, else
    ``unknown`` (licence talk that no template confirms). A line and the block around it may both be
    notices. Null and empty texts have none; long texts are scanned whole; repeated rows repeat; of
    equally probable families the first in ``FAMILIES`` counts. An empty table gives an empty result;
    other columns are ignored. ``trained`` is what ``train`` gave for another table; without it, the
    model is trained with all ordinary paragraphs of ``docs``.
    """
    model, limit, needed = trained or train(docs.sparkSession, ordinary_paragraphs(docs, id_col, text_col))
    may_be = lambda text: F.lower(text.cast("string")).rlike(pattern(needed)) if needed else F.lit(True)
    rows = paragraphs(docs.where(may_be(F.col(text_col))), id_col, text_col).where(may_be(F.col("text")))
    rows = scored(model, rows).where(F.col("probability") >= limit).withColumn("_shares", agreements(F.col("pairs")))
    own = F.array_max(F.transform(F.filter("_shares", lambda t: t["family"] == F.col("family")), lambda t: t["share"]))
    most = F.array_max(F.transform("_shares", lambda t: t["share"]))
    rows = rows.withColumn("agreement", own).withColumn("_sure", (F.col("agreement") >= agree) & (F.col("agreement") >= most))
    return rows.select("doc_id", "kind", "paragraph", F.when(F.col("_sure"), F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "agreement")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES: dict = {}
