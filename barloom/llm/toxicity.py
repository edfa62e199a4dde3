"""Toxicity from class-conditional Kneser-Ney bigram models.

A pass over all labelled texts counts, for every word and every pair of neighbouring words, the
toxic and the ordinary documents that hold it. Each class has a bigram model: a pair's count is
discounted and interpolated with the class's word model, and that one with a distribution that
both classes share, the continuation counts (distinct left neighbours of a word over both classes).
Words whose class counts don't differ beyond chance (likelihood ratio under ``WORD``, or fewer than ``RARE``
documents), and unseen ones, back off to one distribution that both classes share: they spread what the
other words leave of a class's mass, alike in both, so each of them counts the same log ratio of these two
shares, never nothing. Pairs under ``PAIR`` or ``RARE`` back off to the word models, and the weight of
a context's backoff is what its pairs that are left don't use, so both models are normalised. (Words
of few documents with ratios of their own learn the labelled texts by heart: see the README for what that
costs.) The log-likelihood ratios stay a DataFrame that the words,
contexts and pairs of the texts are joined to; the ``HOT`` most frequent ones, whose rows would fill
one task each, are looked up from a broadcast instead, and a bit set of fixed size keeps most others
out of the shuffle. A text's score is the difference of its log-likelihoods under both models,
normalised by its length, calibrated by a logistic fit on a bounded sample of labelled rows
(``SAMPLE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._spark import Tables, cut, maybe_in, table
from barloom.llm._text import U, mix, slices, words

#: Most frequent entries that skip the join, and rows that the calibration sees at most.
HOT, SAMPLE = 1 << 18, 4000
#: Least documents of a word or pair with a probability of its own, and least likelihood ratios (2 log LR) of its two
#: counts: 0.1 % of words without a difference pass; pairs, being many more, pass less than once in ten million.
RARE, WORD, PAIR = 3, 10.83, 30.0
#: Values of ``u`` that are no left neighbour: the word itself, the start of a text, the word as a context.
_ITSELF, _START, _CONTEXT = 0, 1, 2
#: Parts of a word's neighbours that are counted by tasks of their own.
PARTS = 4


def _neighbours(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts (48 bits), the left neighbour and the text of each."""
    h, first = words(data, at, signs=True)
    h = np.maximum(h >> U(16), U(3))
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    left = np.full(len(h), _START, U)
    left[1:] = h[:-1]
    left[first[:-1][first[:-1] < first[1:]]] = _START
    return h, left, row


def _pair_key(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(left * U(0x9E3779B97F4A7C15) + word)


def _context_key(word: np.ndarray) -> np.ndarray:
    return mix(word ^ U(0xABCDEF0123456789))


def _word_key(word: np.ndarray) -> np.ndarray:
    return mix(word ^ U(0x123456789ABCDEF1))


def _merged(parts: list[tuple]) -> tuple:
    w, u, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((u, w))
    w, u = w[order], u[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
    begin = np.flatnonzero(new)
    return w[begin], u[begin], *(np.add.reduceat(x[order], begin) if len(begin) else x for x in counts)


_COUNTS = "w long, part int, us array<long>, cs array<long>, ct long, co long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of words (``u`` 0) and pairs (``u`` the left neighbour), merged in the task while they fit and sent
    on when they grow: a row for each word and part of its neighbours, with lists of ``u`` and counts (toxic documents
    times 2^32 plus ordinary ones), and the pairs of the word with the next one (``ct, co``)."""

    def out(rows):
        w, u, t, o, ct, co = rows
        part = (u % U(PARTS)).astype(np.int32)
        order = np.lexsort((part, w))
        w, u, part, c, ct, co = w[order], u[order], part[order], ((t << 32) + o)[order], ct[order], co[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (part[1:] != part[:-1])
        begin = np.append(np.flatnonzero(new), len(w))
        for i in range(0, len(begin) - 1, 10_000):
            at = begin[i : i + 10_001]
            all_of, first = slice(at[0], at[-1]), at[:-1]
            lists = [pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(x[all_of].astype(np.int64))) for x in (u, c)]
            sums = [pa.array(np.add.reduceat(x[all_of], first - at[0])) for x in (ct, co)]
            yield pa.RecordBatch.from_arrays([pa.array(w[first].astype(np.int64)), pa.array(part[first]), *lists, *sums], names=["w", "part", "us", "cs", "ct", "co"])

    parts, held = [], 0
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, data, at in slices(batch.column(0)):
            w, left, row = _neighbours(data, at)
            each = mix(row.astype(U) + U(1))
            once = np.unique(_word_key(w) ^ each, return_index=True)[1]
            pair = np.unique(_pair_key(left, w) ^ each, return_index=True)[1]
            t1, t2 = toxic[i:j][row[once]], toxic[i:j][row[pair]]
            n1, n2 = np.zeros(len(once), np.int64), np.zeros(len(pair), np.int64)
            itself = np.full(len(w), _ITSELF, U)
            parts.append(_merged([(w[once], itself[once], t1, 1 - t1, n1, n1), (w[pair], left[pair], t2, 1 - t2, n2, n2), (left[pair], itself[pair], n2, n2, t2, 1 - t2)]))
            held += len(parts[-1][0])
            if held > 3_000_000:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > 1_500_000:
                    yield from out(parts[0])
                    parts, held = [], 0
    if parts:
        yield from out(_merged(parts))


def likelihood_ratio(t: Column, o: Column, share: Column) -> Column:
    """2 log LR of toxic and ordinary counts against an expected share of toxic ones."""
    n = t + o
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (part(t, n * share) + part(o, n * (1 - share)))


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the rows ``w, u, f, value``: a word's (u 0), a context's (u 2) or a pair's."""
    for batch in batches:
        w, u = (batch.column(k).to_numpy().view(U) for k in (0, 1))
        key = np.where(u == _ITSELF, _word_key(w), np.where(u == _CONTEXT, _context_key(w), _pair_key(u, w)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], names=["k", "f", "value"])


def model_terms(counts: DataFrame) -> tuple[DataFrame, float]:
    """``w, u, f, value``: log-likelihood ratio of every word (u 0) with probabilities of its own beyond that of all
    other words, the ratio of the backoff weights of contexts (u 2), and what a pair (u the left neighbour) adds
    to both; and the log-likelihood ratio that all other words have."""
    # dealt by word and parts of its neighbours: a word with very many of them is no task of its own
    sums = [F.sum(c).alias(c) for c in ("t", "o", "ct", "co")]
    each = counts.repartition("w", "part").select("w", "part", F.explode(F.arrays_zip("us", "cs")).alias("x"), "ct", "co").select("w", "part", F.col("x.us").alias("u"), F.col("x.cs").alias("c"), "ct", "co")
    own = lambda c: F.when(F.col("u") == _ITSELF, F.col(c)).otherwise(F.lit(0)).alias(c)
    each = each.select("w", "part", "u", F.shiftright("c", 32).alias("t"), F.col("c").bitwiseAND(F.lit(2**32 - 1)).alias("o"), own("ct"), own("co"))
    pairs = each.groupBy("w", "part", "u").agg(*sums)
    is_pair = F.col("u") != _ITSELF
    # one pass gives a row to every pair of RARE documents, and one to every word for all else of it
    own = F.when(is_pair & (F.col("u") != _START) & (F.col("t") + F.col("o") >= RARE), F.col("u"))
    of = lambda c, where, name: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).alias(name)
    ones = [F.count_if(is_pair & (F.col(c) == k)).alias(f"{c}{k}") for c in ("t", "o") for k in (1, 2)]
    rows = pairs.withColumn("pair", own).groupBy("w", "pair").agg(of("t", ~is_pair, "t"), of("o", ~is_pair, "o"), *sums[2:], of("t", is_pair, "pt"), of("o", is_pair, "po"), F.count_if(is_pair).alias("lefts"), *ones)
    tables = Tables(counts.sparkSession)
    rows = tables.write(rows, "counts")
    single = lambda c, k: F.count_if(F.col(c) == k)
    total = rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "o", "lefts")], *[F.count_if(F.col(c) > 0) for c in ("t", "o")],
        *[single(c, k) for c in ("t", "o") for k in (1, 2)], *[F.coalesce(F.sum(f"{c}{k}"), F.lit(0)) for c in ("t", "o") for k in (1, 2)],
    ).first()
    n, p = list(total[:9]), list(total[9:])
    if not n[0] or not n[1]:
        return rows.select("w", F.col("pair").alias("u"), F.col("t").alias("f"), F.lit(0.0).alias("value")).limit(0), 0.0
    cut_off = lambda one, two: one / (one + 2 * two) if one else 0.5
    d, d2 = {"t": cut_off(*n[5:7]), "o": cut_off(*n[7:9])}, {"t": cut_off(*p[:2]), "o": cut_off(*p[2:])}
    size, types, all_t = {"t": n[0], "o": n[1]}, {"t": n[3], "o": n[4]}, n[0] / (n[0] + n[1])
    own = lambda c, off: F.greatest(F.col(c) - off[c], F.lit(0.0))
    shared = F.col("lefts") / n[2]
    p1 = {c: (own(c, d) + d[c] * types[c] * shared) / size[c] for c in ("t", "o")}
    often = rows.where("pair IS NOT NULL").select("w", F.col("pair").alias("u"), F.col("pt").alias("t"), F.col("po").alias("o"))
    word = rows.where(F.col("pair").isNull() & (F.col("t") + F.col("o") >= RARE)).drop("pt", "po")
    word = word.join(often.groupBy("w").agg(F.count(F.lit(1)).alias("more")), "w", "left").withColumn("lefts", F.col("lefts") + F.coalesce("more", F.lit(0)))
    word = word.select("w", (F.col("t") + F.col("o")).alias("f"), "t", "o", "ct", "co", p1["t"].alias("pt"), p1["o"].alias("po"))
    differs = likelihood_ratio(F.col("t"), F.col("o"), F.lit(all_t)) >= WORD
    taken = word.where(differs).agg(F.coalesce(F.sum("pt"), F.lit(0.0)), F.coalesce(F.sum("po"), F.lit(0.0))).first()
    rest = {c: max(1 - k, 0.5 / size[c]) for c, k in zip(("t", "o"), taken, strict=True)}
    others = float(np.log(rest["t"]) - np.log(rest["o"]))
    # a word without probabilities of its own has its part of the shared distribution, in each class by that class's rest
    alike = (all_t * F.col("pt") + (1 - all_t) * F.col("po")) / (all_t * rest["t"] + (1 - all_t) * rest["o"])
    word = word.withColumns({"pt": F.when(differs, F.col("pt")).otherwise(alike * rest["t"]), "po": F.when(differs, F.col("po")).otherwise(alike * rest["o"]), "differs": differs})
    word = word.withColumn("value", F.log("pt") - F.log("po"))
    head = word.select("w", "pt", "po", F.col("value").alias("alone"), ((F.col("t") + all_t) / (F.col("f") + 1)).alias("share"))
    left = word.select(F.col("w").alias("u"), "ct", "co", F.col("f").alias("uf"))
    kept = often.join(head, "w")
    kept = cut(kept.where(likelihood_ratio(F.col("t"), F.col("o"), F.col("share")) >= PAIR).drop("share").join(left, "u"))
    use = {c: own(c, d2) / F.greatest(F.col(f"c{c}"), F.lit(1)) for c in ("t", "o")}
    context = kept.groupBy("u", "uf").agg(*[(1 - F.sum(use[c])).alias(f"rest_{c}") for c in ("t", "o")])
    context = context.withColumn("context", F.log("rest_t") - F.log("rest_o"))
    full = {c: use[c] + F.col(f"rest_{c}") * F.col(f"p{c}") for c in ("t", "o")}
    joined = kept.join(context.drop("uf"), "u")
    terms = cut(
        word.where("differs").select("w", F.lit(_ITSELF).cast("long").alias("u"), "f", (F.col("value") - others).alias("value"))
        .union(context.select(F.col("u").alias("w"), F.lit(_CONTEXT).cast("long").alias("u"), F.col("uf").alias("f"), F.col("context").alias("value")))
        .union(joined.select("w", "u", (F.col("t") + F.col("o")).alias("f"), (F.log(full["t"]) - F.log(full["o"]) - F.col("context") - F.col("alone")).alias("value")))
    )
    tables.drop()  # terms are a table of their own
    return terms, others


def _looked_up(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``HOT`` most frequent entries, sorted, their values, and 2^26 bits that say which keys may have one."""
    hot = table.orderBy(F.desc("f"), "k").limit(HOT).toPandas()
    keys, value = hot["k"].to_numpy(np.int64).view(U), hot["value"].to_numpy(float)
    order = np.argsort(keys)
    bits = np.zeros((2048, 4096), np.uint8)
    place = F.shiftrightunsigned("k", 38)
    parts = table.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    for r in parts.toLocalIterator():
        bits[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return keys[order], value[order], bits.reshape(-1)


def ratios(rows: DataFrame, table: DataFrame, model, others: float) -> DataFrame:
    """``id, mark, n, s``: of every row of ``id, text, mark`` its words and the difference of its log-likelihoods."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, value, bits = model.value
        for batch in batches:
            for i, j, data, at in slices(batch.column(2)):
                w, left, row = _neighbours(data, at)
                total, per, asked = np.zeros(j - i), np.zeros(j - i, np.int64), []
                for key in (_word_key(w), _context_key(left), _pair_key(left, w)):
                    place = (key >> U(38)).astype(np.int64)
                    maybe = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    k, at_row = key[maybe], row[maybe]
                    if not len(k):
                        continue
                    where = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    known = keys[where] == k
                    total += np.bincount(at_row[known], value[where[known]], j - i)
                    asked.append((at_row[~known], k[~known]))
                at_row, k = (np.concatenate(x) for x in zip(*asked, strict=True)) if asked else (np.zeros(0, np.int64), np.zeros(0, U))
                order = np.argsort(at_row, kind="stable")
                per = np.bincount(at_row, minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], batch.column(1)[i:j], batch.column(3)[i:j], pa.array(np.bincount(row, minlength=j - i)), pa.array(total),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.array(k[order].view(np.int64))),
                    ],
                    names=["r", "id", "mark", "n", "s", "asked"],
                )

    texts = rows.select(F.monotonically_increasing_id().alias("r"), "id", "text", "mark").mapInArrow(words_of, "r long, id long, mark long, n long, s double, asked array<long>")
    # one row per text, spread by a hash, and one per key that needs the join
    own = F.struct("id", "mark", "n", "s").alias("own")
    asked = texts.select("r", own, F.explode(F.concat(F.array(F.lit(None).cast("long")), "asked")).alias("a"))
    asked = asked.select("r", F.when(F.col("a").isNull(), F.col("own")).alias("own"), F.col("a").isNotNull().alias("is_word"), F.coalesce("a", F.xxhash64("r")).alias("a"))
    joined = asked.join(table.select("k", "value").hint("merge"), (F.col("a") == F.col("k")) & F.col("is_word"), "left")
    one = joined.groupBy("r").agg(F.max("own").alias("own"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"))
    return one.select("own.id", "own.mark", "own.n", (F.col("own.s") + F.col("s") + F.col("own.n") * others).alias("s"))


def described(rows: DataFrame, table: DataFrame, model, others: float) -> DataFrame:
    """``id, mark, x``: the difference of log-likelihoods over the length and over the root of the length, both
    on a scale that flattens far from 0."""
    n, s = F.greatest(F.col("n"), F.lit(1)), F.col("s")
    return ratios(rows, table, model, others).select("id", "mark", F.array(F.asinh(100 * s / n), F.asinh(3 * s / F.sqrt(n))).alias("x"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps of a ridge logistic regression, the last weight being the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.append(w[:-1], 0)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1, limit: float = 0.7
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    ``labels`` (``doc_id, toxic``) of rows with crc32(id as text) mod ``folds`` = ``held_fold`` are
    never read. The score uses the text alone. Null and empty texts get the score of a text with
    no words; repeated rows repeat; a null id counts as an empty one and has no label. Without
    labels of both classes the score is the share of toxic ones among them (0 without any). An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (fold == held_fold).alias("held"))
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % folds != held_fold)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("long").alias("toxic"))
    labelled = maybe_in(rows.select("id", "text"), "id", marks.select("id")).join(marks.hint("merge"), "id").select("text", "toxic")  # one plan at every size
    terms, others = model_terms(labelled.mapInArrow(_counted, _COUNTS))
    terms = terms.mapInArrow(_pair_keys, "k long, f long, value double")
    model = spark.sparkContext.broadcast(_looked_up(terms))

    few = F.broadcast(marks.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # at most SAMPLE rows
    few = rows.join(few, "id").select("id", "text", F.col("toxic").alias("mark")).orderBy(F.xxhash64("id", "text"), "id").limit(SAMPLE)  # of ids that repeat too
    sample = described(few, terms, model, others).toPandas()
    y = sample["mark"].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        x = np.stack(sample["x"])
        centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        weights = _logistic((x - centre) / spread, y)
    else:
        centre, spread, weights = np.zeros(2), np.ones(2), np.append(np.zeros(2), -30.0 if not len(y) or not y.mean() else 30.0)

    z = F.lit(float(weights[-1]))
    for k in range(2):
        z += (F.col("x")[k] - float(centre[k])) / float(spread[k]) * float(weights[k])
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    found = described(rows.select("id", "text", F.col("held").cast("long").alias("mark")), terms, model, others)
    found = found.select(F.col("id").alias("doc_id"), (F.col("mark") == 1).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict = {}
