"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded
(shares of byte classes, word lengths, repetition); a hidden layer and gated attention weigh the
passages, and the weighted representation gives the document's score. Only document labels are
learned from, on a bounded sample of labelled rows (``SAMPLE`` rows, ``CHARACTERS`` of text); scoring is one pass over all
texts without a shuffle, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._spark import table
from barloom.llm._text import slices, words

#: Words of a passage, labelled rows and characters of their texts that the fit sees at most, hidden and attention units.
PASSAGE, SAMPLE, CHARACTERS, HIDDEN, GATES = 64, 3000, 1 << 26, 24, 12

#: Byte classes: every ASCII sign by itself, then digits, capitals, small letters, spaces, line
#: ends, other control bytes, first and further bytes of other letters.
_CLASS = np.full(256, 37, np.int64)
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = np.arange(32)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[32], _CLASS[10] = 32, 33, 34, 35, 36
_CLASS[128:192], _CLASS[192:] = 38, 39
CLASSES = 40
WIDTH = CLASSES + 5


def encode_passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features of all passages, and the text of each; a text without words is one passage."""
    rows = len(at) - 1
    h, first = words(data, at)
    counts = np.diff(first)
    per = np.maximum(1, -(-counts // PASSAGE))
    owner = np.repeat(np.arange(rows), per)
    base = np.cumsum(per) - per
    # the passage of each word, then of each byte by the words that start before it
    row = np.repeat(np.arange(rows), counts)
    place = np.arange(len(h)) - first[:-1][row]
    passage = base[row] + place // PASSAGE
    space = np.isin(data, np.array([32, 9, 10, 11, 12, 13], np.uint8))
    head = ~space
    head[1:] &= space[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    head[heads] = ~space[heads]
    text_of = np.repeat(np.arange(rows), np.diff(at))
    seen = np.cumsum(head) - 1
    byte_passage = base[text_of]
    if len(h):
        in_text = (seen >= 0) & (row[np.maximum(seen, 0)] == text_of)
        byte_passage = np.where(in_text, passage[np.maximum(seen, 0)], byte_passage)
    n = len(owner)
    x = np.zeros((n, WIDTH))
    size = np.maximum(np.bincount(byte_passage, minlength=n), 1)
    x[:, :CLASSES] = np.sqrt(np.bincount(byte_passage * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None])
    if len(h):
        n_words = np.bincount(passage, minlength=n)
        per_word = np.maximum(n_words, 1)
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        group = np.cumsum(new) - 1
        often = np.empty(len(h), np.int64)
        often[order] = np.bincount(group)[group]
        pair = np.zeros(len(h), bool)
        pair[1:] = h[1:] == h[:-1]
        length = np.bincount(seen[(seen >= 0) & ~space], minlength=len(h))[: len(h)]
        for k, v in enumerate((length / 8.0, (length / 8.0) ** 2, (often > 1).astype(float), np.log1p(often), pair.astype(float))):
            x[:, CLASSES + k] = np.bincount(passage, v, n) / per_word
    return x, owner


class Model:
    """Gated attention over a hidden layer; parameters are plain arrays."""

    def __init__(self, width: int = WIDTH, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"w": g(width, HIDDEN), "b": np.zeros(HIDDEN), "v": g(HIDDEN, GATES), "u": g(HIDDEN, GATES), "a": g(GATES, 1)[:, 0], "o": g(HIDDEN, 1)[:, 0], "c": np.zeros(1)}
        self.centre, self.spread = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, owner: np.ndarray) -> dict:
        """x: features of passages sorted by owner; every owner from 0 on has one at least."""
        p = self.p
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        h = np.tanh(z @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        e = np.exp(e - np.maximum.reduceat(e, begin)[owner])
        weight = e / np.add.reduceat(e, begin)[owner]
        bag = np.add.reduceat(h * weight[:, None], begin)
        score = 1 / (1 + np.exp(-np.clip(bag @ p["o"] + p["c"], -30, 30)))
        return {"z": z, "h": h, "t": t, "s": s, "weight": weight, "bag": bag, "score": score, "begin": begin}

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.02, decay: float = 1e-3) -> None:
        self.centre, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        p, m, q = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for i in range(1, rounds + 1):
            f = self.forward(x, owner)
            d = (f["score"] - y) / len(y)
            bag = d[:, None] * p["o"]
            dw = (f["h"] * bag[owner]).sum(axis=1)
            de = f["weight"] * (dw - np.add.reduceat(dw * f["weight"], f["begin"])[owner])
            gate = de[:, None] * p["a"]
            dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
            dh = f["weight"][:, None] * bag[owner] + dt @ p["v"].T + ds @ p["u"].T
            dz = dh * (1 - f["h"] ** 2)
            grad = {"w": f["z"].T @ dz, "b": dz.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "o": f["bag"].T @ d, "c": np.array([d.sum()])}
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k], q[k] = 0.9 * m[k] + 0.1 * g, 0.999 * q[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(q[k] / (1 - 0.999**i)) + 1e-8)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, at in slices(batch.column(0)):
            x, owner = encode_passages(data, at)
            begin = np.searchsorted(owner, np.arange(len(at)))
            out += [x[a:b].astype(np.float32).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["x", "y"])


def _scores(texts: pa.Array, model: Model | float) -> np.ndarray:
    scores = [np.zeros(0)]
    for _, _, data, at in slices(texts):
        scores.append(model.forward(*encode_passages(data, at))["score"] if isinstance(model, Model) else np.full(len(at) - 1, model))
    return np.concatenate(scores)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, folds: int, held_fold: int) -> Model | float:
    """The fitted model; without labels of both classes, the share of good ones (0.5 without any)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % folds != held_fold)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("double").alias("_y"))
    few = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))  # at most SAMPLE rows
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(few, "_id")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(SAMPLE)  # rows of ids that repeat are at most as many
    sizes = rows.select("_id", F.length("_text").alias("n")).toPandas().fillna(0).sort_values(["_id", "n"])  # at most SAMPLE ids
    fits = sizes.loc[sizes["n"].cumsum() <= CHARACTERS, "_id"]  # whole texts, until they fill the bound
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(fits)], "_id long"))
    sample = rows.join(chosen, "_id").select("_text", "_y", "_id").orderBy("_id").select("_text", "_y").mapInArrow(_encoded, "x binary, y double").toPandas()
    y = sample["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in sample["x"]]
    model = Model()
    model.fit(np.concatenate(bags).astype(float), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0, limit: float = 0.3
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row (score: label 1 likelier when higher).

    ``labels`` (``doc_id, quality``) of rows with crc32(id as text) mod ``folds`` = ``held_fold``
    are never read; the score uses the text alone. A null or empty text is one passage without
    words and gets that passage's score. Repeated rows repeat; a null id counts as an empty one
    and has no label. An empty table gives an empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_fold=held_fold))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(batch.column(1), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), (fold == held_fold))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def kept_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 0, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns: scored and filtered in one pass
    without a shuffle, row by row, so two texts of one id are judged each by itself."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_fold=held_fold))
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), model.value) >= limit))

    return docs.mapInArrow(kept, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict = {}
