import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import bpe, toxicity
from barloom.llm.quality import score_quality
from barloom.llm.toxicity import score_toxicity

DATA = "/root/testdata/sf0.01"


def measured(rows, labels, column, want):
    marks = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    return [p for p, y in held if y == want]


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = score_quality(docs, labels).collect()
    good, bad = measured(rows, labels, "quality", 1), measured(rows, labels, "quality", 0)
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = score_toxicity(docs, labels).collect()
    toxic, clean = measured(rows, labels, "toxic", 1), measured(rows, labels, "toxic", 0)
    assert np.mean(toxic) >= 0.7 and np.mean(clean) < 0.02


def test_toxicity_on_more_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    rows = score_toxicity(docs, labels).collect()
    assert np.mean(measured(rows, labels, "toxic", 1)) >= 0.9 and np.mean(measured(rows, labels, "toxic", 0)) < 0.005


def test_toxicity_of_rare_words_beside_many(spark, monkeypatch):
    """Words of a few documents count however many other words there are, looked up or joined."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    rng = random.Random(2)
    text = lambda own: " ".join([*(f"w{rng.randrange(400)}" for _ in range(30)), *own])
    docs = [(i, text([f"slur{i % 20}", f"slur{(i + 7) % 20}"] if i % 2 else [f"fine{i % 20}"]), i % 2) for i in range(600)]
    rows, marks = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    scores = []
    for hot in (4, 1 << 13):
        monkeypatch.setattr(toxicity, "HOT", hot)
        got = {r.doc_id: r for r in score_toxicity(rows, marks).collect()}
        assert [i for i, _, y in docs if fold(i) == 1 and got[i].predicted != y] == []
        scores.append([got[i].score for i in range(600)])
    assert np.allclose(*scores)


def test_terms_match_brute_force(spark, monkeypatch):
    """Counts, continuation counts, pruning and ratios of words, contexts and pairs; whole texts by hand."""
    rng = random.Random(3)
    texts = []
    for i in range(400):
        w = [f"w{rng.randrange(60)}" for _ in range(40)]
        if i % 4 == 0:  # toxic: a word of its own, and an expression of two ordinary words
            w[7], w[20:22] = "slur", ["w1", "w2"]
        texts.append((" ".join(w), int(i % 4 == 0)))
    rows = spark.createDataFrame(texts, "text string, toxic long").mapInArrow(toxicity._counted, toxicity._COUNTS)
    terms, others = toxicity.model_terms(rows)
    got = sorted((0 if r.u == 0 else 2 if r.u == 2 else 1, r.f, round(r.value, 6)) for r in terms.collect())
    c = collections.Counter
    word, pair, left, lefts = [c(), c()], [c(), c()], [c(), c()], set()
    for text, y in texts:
        w = text.split()
        seen = set(zip(["", *w], w))
        lefts |= seen
        word[y].update(set(w)), pair[y].update(seen), left[y].update(u for u, _ in seen if u)
    o, t = word
    n, types = [sum(x.values()) for x in word], [len(x) for x in word]
    off = lambda x: (lambda one, two: one / (one + 2 * two) if one else 0.5)(sum(v == 1 for v in x.values()), sum(v == 2 for v in x.values()))
    cont = c(w for _, w in lefts)
    p1 = lambda y, w: (max(word[y][w] - off(word[y]), 0) + off(word[y]) * types[y] * cont[w] / len(lefts)) / n[y]
    g = lambda t, o, e: 2 * sum(x * np.log(x / y) if x else 0 for x, y in ((t, (t + o) * e), (o, (t + o) * (1 - e))))
    share = n[1] / sum(n)
    value = {w: np.log(p1(1, w)) - np.log(p1(0, w)) for w in cont if t[w] + o[w] >= 3 and g(t[w], o[w], share) >= toxicity.WORD}
    out = [max(1 - sum(p1(y, w) for w in value), 0.5 / n[y]) for y in (0, 1)]
    assert abs(others - np.log(out[1] / out[0])) < 1e-9 and others != 0
    alike = lambda w: (share * p1(1, w) + (1 - share) * p1(0, w)) / (share * out[1] + (1 - share) * out[0])
    p = lambda y, w: p1(y, w) if w in value else out[y] * alike(w)
    want = [(0, t[w] + o[w], v - others) for w, v in value.items()]
    kept = [(u, w) for u, w in lefts if u and pair[1][u, w] + pair[0][u, w] >= 3]
    kept = [k for k in kept if g(pair[1][k], pair[0][k], (t[k[1]] + share) / (t[k[1]] + o[k[1]] + 1)) >= toxicity.PAIR]
    assert ("w1", "w2") in kept and "slur" in value
    use = lambda y, u, w: max(pair[y][u, w] - off(pair[y]), 0) / max(left[y][u], 1)
    rest = {u: [1 - sum(use(y, *k) for k in kept if k[0] == u) for y in (0, 1)] for u, _ in kept}
    context = {u: np.log(r[1]) - np.log(r[0]) for u, r in rest.items()}
    want += [(2, t[u] + o[u], v) for u, v in context.items()]
    for u, w in kept:
        p2 = [use(y, u, w) + rest[u][y] * p(y, w) for y in (0, 1)]
        want.append((1, pair[1][u, w] + pair[0][u, w], np.log(p2[1]) - np.log(p2[0]) - context[u] - np.log(p(1, w) / p(0, w))))
    assert got == sorted((k, f, round(float(v), 6)) for k, f, v in want)

    def by_hand(text):
        """Difference of a text's log-likelihoods under both models, word by word; unseen words have equal parts of what is left."""
        total, w = 0.0, text.split()
        for u, x in zip(["", *w], w):
            ratio = np.log(out[1] / out[0]) if x not in cont or x not in value else value[x]
            if (u, x) in kept:
                q = [use(y, u, x) + rest[u][y] * p(y, x) for y in (0, 1)]
                ratio = np.log(q[1] / q[0])
            elif u in rest:
                ratio += context[u]
            total += ratio
        return total

    asked = ["slur slur never", "never seen words", "w1 w2 w3", "w2 w1", "", "w5 slur w1 w2 w1 w2", texts[4][0], texts[5][0]]
    keyed = terms.mapInArrow(toxicity._pair_keys, "k long, f long, value double")
    for hot in (2, 1 << 13):
        monkeypatch.setattr(toxicity, "HOT", hot)
        model = spark.sparkContext.broadcast(toxicity._looked_up(keyed))
        docs = spark.createDataFrame([(i, x, 0) for i, x in enumerate(asked)], "id long, text string, mark long")
        found = {r.id: r.s for r in toxicity.ratios(docs, keyed, model, others).collect()}
        assert np.allclose([found[i] for i in range(len(asked))], [by_hand(x) for x in asked])


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_edges(nasty, none, labels, score):
    rows = score(nasty, labels).collect()
    assert len(rows) == nasty.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert score(nasty, labels.limit(0)).count() == nasty.count() and score(none, labels).count() == 0


@pytest.fixture(scope="module")
def library():
    return bpe.tokenizer(bpe.vocabulary_path())


def test_encoding_equals_the_library(spark, nasty, none, library):
    for leaf in (1 << 16, 300):
        rows = bpe.digests(bpe.encode(nasty, leaf=leaf)).collect()
        texts = sorted((t or "") for _, t in [(r.doc_id, r.text) for r in nasty.collect()])
        want = []
        for t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.digests(bpe.encode(none)).count() == 0


def test_tree_joins_unsplit_text(library):
    path, rng = bpe.vocabulary_path(), random.Random(4)
    parts = ["a", "the", "ing", "é", "é", "'s", "''", "!?", "7", "日本", "<|endoftext|>", "İ", "ß", " ", " ", "\x1c"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 900)))
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.tree(path, [bpe.piece(path, x) for x in bpe.halves(text, rng.choice([1, 2, 4]))]).tolist() == want
        coder = bpe.Encoder(path)
        coder.learn([text.encode()])
        assert np.frombuffer(coder.encode(text.encode()), np.uint32).tolist() == want


def test_decode(spark, library):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs)).collect()}
    assert got == {1: library.decode(library.encode("Hello there", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}
