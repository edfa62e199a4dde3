"""Clustering, decontamination and manifest against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import clustering, merkle
from barloom.llm.decontaminate import decontaminate


def lloyd(rows, k=8, rounds=10, scale=1024):
    """Full comparisons in whole numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [list(v) for _, v in order]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, one)) for one in c] for _, v in kept]
        at = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(kept, at) if a == j]
                c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    return sorted((i, a, row[a]) for (i, _), a, row in zip(kept, at, d)), c


@pytest.mark.parametrize(("n", "k", "spread", "rows"), [(400, 8, 3.0, 64), (300, 24, 0.02, 4096), (5, 8, 1.0, 4096), (200, 8, 0.002, 16)])
def test_clusters_match_full_comparisons(spark, monkeypatch, n, k, spread, rows):
    """Clear groups, groups that overlap, fewer vectors than centroids, and a coarse grid full of ties."""
    monkeypatch.setattr(clustering, "ROWS", rows)
    rng = np.random.default_rng(n)
    hubs = rng.normal(size=(6, 4)) * spread
    data = [(i, [float(np.float32(x)) for x in hubs[i % 6] + rng.normal(size=4) * 0.01]) for i in range(n)]
    data += [(1000, None), (1001, [0.0, None, 0.0, 0.0]), (1002, [0.0] * 3), (1003, [float("nan"), 0.0, 0.0, 0.0]), (1004, [float("inf"), 0.0, 0.0, 0.0]), (3, data[3][1]), (3, data[3][1])]
    found, centroids, trace = clustering.kmeans(spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, cluster string"), dim=4, k=k)
    want, c = lloyd(data, k)
    assert sorted(tuple(r) for r in found.collect()) == want and centroids == c
    assert len(trace) == 10 and all(t["full"] <= len(want) for t in trace)
    if spread == 3.0:  # bounds spare most vectors the full comparison, and fewer are kept
        assert sum(t["full"] for t in trace[4:]) < len(want) and trace[-1]["bounds"] < trace[0]["bounds"]


def test_clusters_of_hard_rows(spark):
    schema = "vec_id long, embedding array<double>"
    found, c, _ = clustering.kmeans(spark.createDataFrame([], schema), dim=4)
    assert clustering.with_inertia(found, c).count() == 0
    big = [(None, [1e15, -1e15, 1.0, 0.0]), (1, [1e15, -1e15, 1.0, 0.0]), (2, [1e300, 0.0, 0.0, 0.0]), (3, [0.5] * 4), (4, [0.5] * 4)]
    found, c, _ = clustering.kmeans(spark.createDataFrame(big, schema), dim=4, k=2, rounds=3)
    rows = clustering.with_inertia(found, c).collect()
    assert len(rows) == 5 and {r.distance >= 0 for r in rows} == {True} and len({r.inertia for r in rows}) == 1


def words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def cover(docs, items, n=10):
    out = []
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(len(w), n)
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    lengths = {len(w) for w in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[x]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shortest", [1, 4, 7, 10])
def test_decontamination_matches_brute_force(spark, shortest):
    rng = random.Random(shortest)
    phrase = lambda n, of=300: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    head = phrase(14)
    items = [(i, phrase(rng.randrange(shortest, 40))) for i in range(40)] + [(i, f"{head}, {phrase(12)}") for i in range(50, 60)]
    items += [(100, None), (101, "-- !"), (None, phrase(30)), (7, phrase(20)), (7, phrase(20)), (61, "a " * 25)]
    items += [(70 + m, phrase(m)) for m in range(shortest, 10)]
    docs = []
    for i in range(120):
        w = [phrase(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            x = words(rng.choice(items)[1])
            a = rng.randrange(len(x) + 1)
            w += [" ".join(x[a : a + rng.randrange(25)]).upper(), phrase(rng.randrange(5))]
        docs.append((i, (" . " if i % 2 else "\n").join(w)))
    docs += [(200, None), (201, ""), (202, "é ü ... "), (203, "a " * 400), (5, docs[4][1]), (5, docs[4][1]), (None, items[0][1]), (None, head), (204, phrase(20, 10**6) * 300 + head)]
    rows = decontaminate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit long"), spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, source string"))
    assert sorted((tuple(r) for r in rows.collect()), key=str) == cover(docs, items)


def test_decontamination_of_empty_tables(spark, nasty, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, empty).count() == 0
    rows = decontaminate(nasty, empty).collect()
    assert len(rows) == nasty.count() and not any(r.contaminated for r in rows)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, size=2):
    """Root, and of each node its siblings as (before, after) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + size] for i in range(0, len(nodes), size)]
        for k, a in enumerate(at):
            run, own = runs[a // size], a % size
            ways[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[k] = a // size
        nodes = [H(*run) for run in runs]
    return nodes[0], ways


def by_hand(rows):
    leaf = lambda r, n: H(*[field(v) for v in (r[0], r[2], r[3], n, r[1])])
    langs = sorted({r[3] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[3] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for g in langs}
    trees = {g: tree([leaf(r, r[4]) for r in own[g]]) for g in langs}
    root, up = tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for r, way in zip(own[g], trees[g][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf(r, r[4] + 1 if bad else r[4])
            way = way + up[k]
            for a, b in way:
                h = H(a, h, b)
            out.append((r[0], leaf(r, r[4]), trees[g][0], root, H(*[a + b for a, b in way]), h, h == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", leaf string")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    got = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changes={"n_chars": more})
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("block", "top"), [(1 << 12, 1 << 14), (4, 1 << 14), (4, 3), (2, 1)])
def test_manifest_matches_by_hand(spark, monkeypatch, block, top):
    """Blocks under a top on the driver, and more rounds of blocks where the top is larger than that."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "TOP", top)
    rng = random.Random(block)
    rows = [(i, f"text {i}", rng.choice(["a", None, "é"]), rng.choice(["en", "en", "en", "de", None, "", "日", "z\U0001f600"]), rng.choice([None, i, 2**63 - 1])) for i in range(150)]
    rows += [(None, "x", None, "en", 1), (None, None, None, None, None), (3, "other text", "a", "en", 5), (8, "twin", "a", "de", 1), (8, "twin", "a", "de", 1), (500, "lone", "s", "fr", 9), (-7, "", "", "en", 0)]
    got = manifest(spark, rows)
    assert got == by_hand(rows)
    assert any(not r[-1] for r in got)


def test_manifest_of_small_tables(spark):
    assert manifest(spark, []) == []
    one = [(1, "a", "s", "en", 1)]
    assert manifest(spark, one) == by_hand(one)
    two = [(1, "a", "s", "en", 1), (2, "b", None, None, None)]
    assert manifest(spark, two) == by_hand(two)
