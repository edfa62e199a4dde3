import hashlib
import itertools
import random

import pytest

from barloom.llm import near_dedup, substring_dedup
from barloom.llm.components import connected_components, with_links
from barloom.llm.exact_dedup import exact_dedup, kept_documents
from barloom.llm.near_dedup import near_duplicates
from barloom.llm.substring_dedup import remove_repeats


def test_exact(spark, nasty, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(nasty, keep="largest").collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (6, 7, 2, False), (9, 9, 2, True), (None, None, 1, True)} <= got
    assert exact_dedup(nasty).count() == nasty.count() and exact_dedup(none).count() == 0
    assert sorted(r.doc_id or 0 for r in kept_documents(nasty).select("doc_id").collect()) == [0, 1, 3, 5, 6, 8, 9, 10, 11]
    one = exact_dedup(nasty).where("doc_id = 6").first()
    assert one.text_sha256 == hashlib.sha256(b"one").hexdigest()


def sets(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, percent):
    root = {d: d for d, _ in docs}
    s = {d: sets(t) for d, t in docs}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(s, 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s[d]), find(d)) for d in s}


def near_texts(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("small", [16, 4])
def test_near_matches_brute_force(spark, monkeypatch, small):
    """With a small limit the group of copies goes through blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    docs = near_texts(70) + [(100, None), (101, ""), (102, "a b"), (103, "A B"), (104, "b a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()}
    assert got == brute(docs, 85)


def test_near_decides_on_rows(spark):
    """Two texts of one id, a repeated row and rows without an id; chains reach past the hub of a large bucket."""
    base = " ".join(f"k{i}" for i in range(100))
    rows = [(1, base), (1, "other " + " ".join(f"m{i}" for i in range(50))), (2, base.upper()), (None, base), (None, "x y"), (4, base), (4, base), (5, None)]
    kept = near_dedup.kept_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in kept) == [(0, "k0 k"), (0, "x y"), (1, "k0 k"), (1, "othe"), (5, "")]


def test_near_edges(nasty, none):
    rows = near_duplicates(nasty).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == nasty.count()
    assert got[2][1] == 1 and got[9][1] == 8 and got[3] == (0, 3, True) and got[5] == (0, 5, True) and got[7] == (1, 6, False)
    assert near_duplicates(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 200)]
    got = dict(connected_components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[200] == 0 and got[101] == got[100] == 100
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def tasks_of(spark, name, run):
    """What ``run`` returns, and how many tasks Spark ran for it."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    told = spark.sparkContext.statusTracker()
    stages = {s for job in told.getJobIdsForGroup(name) for s in told.getJobInfo(job).stageIds}
    return out, sum(told.getStageInfo(s).numCompletedTasks for s in stages)


def test_components_of_stars_need_no_round(spark):
    """The driver keeps a record of every task, so edges that are settled run few, over however many partitions."""
    stars = [(100 * (i // 10), i + 1000) for i in range(60)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got, tasks = tasks_of(spark, "stars", lambda: dict(connected_components(spark.createDataFrame(stars, "u long, v long").coalesce(1)).collect()))
    finally:
        spark.conf.unset(key)
    assert got == {n: c for c, x in stars for n in (c, x)}
    assert tasks <= 50


def test_components_after_more_links(spark):
    """Links inside components, between them, to and among new nodes give what all links together give."""
    rng = random.Random(5)
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    first = connected_components(frame(some)).localCheckpoint()
    for more in ([], some[:9], [(rng.randrange(600), rng.randrange(600)) for _ in range(120)]):
        assert sorted(with_links(first, frame(more)).collect()) == sorted(connected_components(frame(some + more)).collect())


def cut_by_hand(docs, length):
    seen, out = set(), {}
    for d, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[d] = bytes(c for c, g in zip(b, gone) if not g)
    return out


def test_substrings_match_brute_force(spark, nasty, none):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    docs = [(i, " ".join(f"q{rng.randrange(10**4)}" for _ in range(rng.randrange(30))) + passage[rng.randrange(50) : 100 + rng.randrange(100)] + str(i)) for i in range(60)]
    docs += [(100, "ab" * 300), (101, "é" * 200), (102, None), (103, ""), (104, "z" * 99)]
    got = {r.id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == cut_by_hand(docs, 100)
    assert remove_repeats(nasty).count() == nasty.count() and remove_repeats(none).count() == 0


@pytest.mark.parametrize("bits", [(1 << 15, 1 << 15), (1 << 20, 1 << 30)])
def test_substrings_of_null_and_repeated_ids(spark, monkeypatch, bits):
    """Rows without an id and texts of one id are documents of their own; bit sets far too small change nothing."""
    monkeypatch.setattr(substring_dedup, "BITS", bits)
    rng = random.Random(8)
    words = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    shared = words(40)
    docs = [(None, "a " + shared), (None, "b " + shared + " end"), (5, "c " + words(50)), (5, "d " + shared), (5, "d " + shared), (None, None), (7, words(60))]
    docs += [(i, words(3) + shared[i % 60 : 130 + i % 60] + words(2)) for i in range(20, 60)]
    rows = remove_repeats(spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, v long, start string")).collect()
    assert len(rows) == len(docs) and sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t in docs)
    whole = [r for r in rows if shared.encode() in bytes(r.kept)]
    assert len(whole) == 1 and whole[0].id is None  # one of the two texts without an id is the first
    by_id = {r.id: bytes(r.kept) for r in rows}
    order = [(0 if d is None else d, t) for d, t in docs if d != 5 and t] + [(5, docs[3][1])]
    want = cut_by_hand([(k, t) for k, (_, t) in enumerate(sorted(order, key=lambda x: x[0]))], 100)
    assert all(by_id[d] == want[k] for k, (d, _) in enumerate(sorted(order, key=lambda x: x[0])) if d >= 7)
    assert len({bytes(r.kept) for r in rows if r.id == 5}) == 2  # the repeated row loses what the other one loses


@pytest.mark.parametrize("step, twice", [(1, False), (2**57, False), (1, True)])
def test_substrings_by_places_of_one_long(spark, monkeypatch, step, twice):
    """Ids near each other, far apart, and one of two texts: firsts are found by hash aggregates."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    shared = words(60)
    docs = [((i - 30) * step, (words(5) + shared[i % 90 : 120 + i % 90] + words(5)) if i % 3 else words(40)) for i in range(60)] + [(31 * step, None), (32 * step, "")]
    plans, texts = {}, {}
    write = substring_dedup.Tables.write

    def record(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name)

    ranked = substring_dedup.numbered
    monkeypatch.setattr(substring_dedup.Tables, "write", record)
    monkeypatch.setattr(substring_dedup, "numbered", lambda *a: texts.setdefault("rows", ranked(*a)))
    more = [(docs[0][0], words(50))] if twice else []
    df = spark.createDataFrame(docs + more + docs[:2], "doc_id long, text string")  # repeated rows don't count against themselves
    rows = remove_repeats(df).collect()
    assert len(rows) == len(docs) + len(more) + 2
    want = cut_by_hand(docs, 100)  # the one more text shares nothing
    assert {r.id: bytes(r.kept) for r in rows if r.n_bytes != len((more or [(0, "")])[0][1])}.items() >= {k: v for k, v in want.items() if k < 31 * step}.items()
    placed, bits = texts["rows"]
    at = placed.select("id", "text", "at").distinct().orderBy("at").collect()
    assert [r.id for r in at] == sorted(r.id for r in at) and len({r.at for r in at}) == len(docs) + len(more)
    assert all(r.at % (1 << bits) == 0 and len(r.text.encode()) < 1 << bits for r in at)
    assert ("texts" in plans) == (step > 1 or twice)
    assert "SortAggregate" not in plans["firsts"] and "HashAggregate" in plans["firsts"]
