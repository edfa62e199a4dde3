"""BPE encoding and decoding with a public tokenizer, by tree concatenation.

A text of up to ``LEAF`` characters is encoded in one piece. A longer one is cut into halves until
pieces fit, the pieces are rows of their own and are encoded by any tasks, and neighbours are then
joined pairwise up a tree. At a join the ends of both pieces may be tokenised wrongly, so a window
around it is encoded again and grows until it agrees with the left piece on a token left of the
join and with the right piece on a token right of it; tokens between those are the window's. Each
pair of neighbouring tokens then stands in a correct encoding, which makes the whole correct.

Within a piece, runs of ASCII space are cuts that no token crosses (the tokenizer drops them),
so words are encoded once per batch and reused.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._spark import cut, table

VOCABULARY = "word_bpe_49k.json"
#: Characters of a piece, of the first window on each side of a join, and words a task remembers.
LEAF, WINDOW, REMEMBERED = 1 << 16, 64, 150_000
#: Tasks that pieces are dealt to at most.
TASKS = 2048
#: Characters at either end of a window in which no agreement counts: more than a special token has.
GUARD = 16
#: Stops after an ASCII letter start a token; they are no part of one with letters.
_STOPS = re.compile(rb"(.*[A-Za-z])([.,;:!?]+)", re.DOTALL)
#: Words that the tokenizer's normaliser and splitter leave as they are: only its merges apply to them.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """Letters of two bytes as the vocabulary writes them: bytes of Latin-1 signs as these, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


_BYTES = _byte_letters()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _parts(word: bytes) -> tuple[bytes, ...]:
    """Pieces whose ids together are the word's: stops after an ASCII letter are tokens of their own, and
    capitals of an ASCII piece don't matter to the tokenizer, so that fewer pieces need to be encoded."""
    if b"<|" in word:
        return (word,)
    m = _STOPS.fullmatch(word)
    head = m[1] if m else word
    head = head.lower() if head.isascii() else head
    return (head, m[2]) if m else (head,)


class Encoder:
    """Encodes texts by words, remembering a bounded number of them."""

    def __init__(self, path: str):
        self.tokens, self.known = tokenizer(path), {}
        self.model = self.tokens.model

    def learn(self, texts: list[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {w: _parts(w) for w in {w for t in texts for w in t.split()} - known.keys()}
        rest = []
        for p in {p for parts in new.values() for p in parts} - known.keys():
            text = p.decode()
            if _LETTERS.fullmatch(text):
                known[p] = np.array([t.id for t in self.model.tokenize(text.translate(_BYTES))], np.uint32).tobytes()
            else:
                rest.append(p)
        made = self.tokens.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)
        known.update(zip(rest, (np.array(e.ids, np.uint32).tobytes() for e in made), strict=True))
        known.update((w, b"".join(map(known.__getitem__, parts))) for w, parts in new.items())

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ``learn`` has seen the text."""
        return b"".join(map(self.known.__getitem__, text.split()))


class Piece:
    """A stretch of text with its ids and the character at which each token starts."""

    def __init__(self, text: str, ids: np.ndarray, starts: np.ndarray):
        self.text, self.ids, self.starts = text, ids, starts


def piece(path: str, text: str) -> Piece:
    made = tokenizer(path).encode(text, add_special_tokens=False)
    return Piece(text, np.array(made.ids, np.uint32), np.array([a for a, _ in made.offsets], np.int64))


def join(path: str, left: Piece, right: Piece) -> Piece:
    """The encoding of both texts together, from theirs."""
    n, width = len(left.text), WINDOW
    text = left.text + right.text
    while True:
        lo, hi = max(0, n - width), min(len(text), n + width)
        mid = piece(path, text[lo:hi])
        at = mid.starts + lo
        a = _agree(left.ids, left.starts, mid.ids, at, lo + max(GUARD, width // 4), n - GUARD) if lo else (0, 0)
        b = _agree(mid.ids, at, right.ids, right.starts + n, n + GUARD, hi - max(GUARD, width // 4)) if hi < len(text) else (len(mid.ids), len(right.ids))
        if a and b and a[1] <= b[0]:
            ids = np.concatenate([left.ids[: a[0]], mid.ids[a[1] : b[0]], right.ids[b[1] :]])
            return Piece(text, ids, np.concatenate([left.starts[: a[0]], at[a[1] : b[0]], right.starts[b[1] :] + n]))
        width *= 2


def _agree(x_ids, x_at, y_ids, y_at, lo: int, hi: int) -> tuple[int, int] | None:
    """Places after a token that both have between lo and hi, followed in both by one at the same character."""
    if len(x_at) < 2 or len(y_at) < 2:
        return None
    both, i, j = np.intersect1d(x_at, y_at, return_indices=True)
    # the last of several tokens of one character carries no cut; only single starts count
    single = (np.searchsorted(x_at, both, "right") - np.searchsorted(x_at, both) == 1) & (np.searchsorted(y_at, both, "right") - np.searchsorted(y_at, both) == 1)
    both, i, j = both[single], i[single], j[single]
    ok = np.flatnonzero((both[:-1] >= lo) & (both[1:] < hi) & (np.diff(i) == 1) & (np.diff(j) == 1) & (x_ids[i[:-1]] == y_ids[j[:-1]]))
    if not len(ok):
        return None
    k = ok[len(ok) // 2]
    return int(i[k + 1]), int(j[k + 1])


def tree(path: str, pieces: list[Piece]) -> np.ndarray:
    while len(pieces) > 1:
        pieces = [join(path, pieces[i], pieces[i + 1]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0].ids


def halves(text: str, depth: int) -> list[str]:
    """2^depth pieces of nearly equal length."""
    if not depth:
        return [text]
    m = len(text) // 2
    return halves(text[:m], depth - 1) + halves(text[m:], depth - 1)


def _digest(ids: bytes, path: str) -> tuple[int, str, str]:
    text = tokenizer(path).decode(np.frombuffer(ids, np.uint32).tolist(), skip_special_tokens=False)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _short(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = path or vocabulary_path()
        coder = Encoder(own)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
                coder.learn(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(coder.encode, texts), pa.binary())], names=["id", "ids"])
            pa.default_memory_pool().release_unused()

    return run


def _leaves(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = path or vocabulary_path()
        for batch in batches:
            made = [piece(own, t) for t in batch["leaf"]]
            yield batch.assign(ids=[p.ids.tobytes() for p in made], starts=[p.starts.astype(np.int32).tobytes() for p in made])

    return run


def _cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for ident, key, times, depth, text in batch.itertuples(index=False, name=None):
            parts = halves(text, depth)
            yield pd.DataFrame({"id": pd.Series([ident] * len(parts), dtype="Int64"), "key": key, "times": times, "depth": depth, "place": range(len(parts)), "leaf": parts})


_PIECE = "id long, key long, times long, depth int, place int, leaf string, ids binary, starts binary"


def _joined(path: str | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        pieces = [Piece(t, np.frombuffer(i, np.uint32), np.frombuffer(s, np.int32).astype(np.int64)) for t, i, s in zip(rows["leaf"], rows["ids"], rows["starts"], strict=True)]
        made = join(path or vocabulary_path(), *pieces)
        out = rows.iloc[:1].drop(columns="pair").astype({"id": "Int64"})
        return out.assign(depth=out["depth"] - 1, place=out["place"] // 2, leaf=[made.text], ids=[made.ids.tobytes()], starts=[made.starts.astype(np.int32).tobytes()])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers) of every whole text.

    Equals the library's own encoding without special tokens added. A null or empty text has no
    ids. Rows may repeat and ids may be null; an empty table gives an empty result; other columns
    are ignored. Pieces of long texts are rows, and so is every join of two neighbours, so the joins
    of one level of the tree run side by side; a text of two levels less rests until its turn.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > leaf
    short = rows.where(~long).mapInArrow(_short(path), "id long, ids binary")
    whole = rows.where(long).groupBy("id", F.xxhash64("text").alias("key"), "text").agg(F.count(F.lit(1)).alias("times"))
    depth = F.ceil(F.log2(F.length("text") / leaf)).cast("int")
    whole = cut(whole.select("id", "key", "times", depth.alias("depth"), "text"))
    levels, n = whole.agg(F.max("depth"), F.sum(F.pow(F.lit(2.0), F.col("depth")))).first()
    if not levels:
        return short.select(F.col("id").alias("doc_id"), "ids")
    tasks = int(min(n, TASKS))
    cut_up = whole.mapInPandas(_cut_up, "id long, key long, times long, depth int, place int, leaf string")
    # dealt one by one, not by a hash of few keys; a fixed number that adaptive execution doesn't merge
    made = cut(cut_up.repartition(tasks).mapInPandas(_leaves(path), _PIECE))
    for level in range(levels, 0, -1):
        two = made.where(F.col("depth") == level).withColumn("pair", F.shiftright("place", 1)).repartition(max(1, tasks // 2), "id", "key", "pair")
        joined = two.groupBy("id", "key", "pair").applyInPandas(_joined(path), _PIECE)
        made = cut(joined.union(made.where(F.col("depth") < level)))
    repeated = made.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("id", "ids")
    return short.union(repeated).select(F.col("id").alias("doc_id"), "ids")


def decode(encoded: DataFrame, *, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text of every id list, special tokens kept; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        t = tokenizer(path or vocabulary_path())
        return pd.Series([t.decode(np.frombuffer(x or b"", np.uint32).tolist(), skip_special_tokens=False) for x in ids], dtype=object)

    return encoded.withColumn(out, text(F.col(ids_col)))


def digests(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = path or vocabulary_path()
        for batch in batches:
            made = [_digest(x, own) for x in batch.column(1).to_pylist()]
            n, a, b = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict = {}
