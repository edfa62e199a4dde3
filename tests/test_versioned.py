"""The versioned table of bars against a dictionary, and its log under two writers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.schema import BARS
from barloom.sources.shared import new_folder
from barloom.sources.versioned import BarTable, Conflict, into_table
from barloom.streaming import replay

T0 = dt.datetime(2024, 1, 1)


def bar(symbol, hour, close, source="s", interval="1h"):
    return (symbol, source, interval, T0 + dt.timedelta(hours=hour), 1.0, 9.0, 0.5, float(close), 1)


def content(df):
    return {(r.symbol, r.source, r.interval, r.ts): r.close for r in df.collect()}


def test_versions_against_a_dictionary(spark, tmp_path):
    rng, table, want, kept = random.Random(2), BarTable(spark, str(tmp_path / "t"), 4), {}, []
    assert table.read().count() == 0 and table.versions() == []
    for k in range(6):
        rows = {(s, h): bar(s, h, 100 * k + h, rng.choice(["s", "t"])) for s, h in ((rng.choice("abcdefgh"), rng.randrange(20)) for _ in range(25))}
        assert table.upsert(spark.createDataFrame(list(rows.values()), BARS)) == k
        want |= {(r[0].upper(), *r[1:4]): r[7] for r in rows.values()}
        kept.append(dict(want))
    assert content(table.read()) == want and content(table.read(3)) == kept[3]
    assert max(map(len, table.manifest().live.values())) > 2
    version = table.compact(1)
    assert {len(v) for v in table.manifest().live.values()} == {1} and table.compact(1) == version and content(table.read()) == want
    version = table.delete("a", "s", before=T0 + dt.timedelta(hours=10))
    want = {k: v for k, v in want.items() if not (k[0] == "A" and k[1] == "s" and k[3] < T0 + dt.timedelta(hours=10))}
    assert content(table.read()) == want and table.delete("zzz") == version
    assert content(table.read(2)) == kept[2]
    gone = table.clean(1)
    assert gone and table.versions() == [version] and content(table.read()) == want and table.clean(1) == []
    with pytest.raises(KeyError):
        table.read(2)


def test_writes_touch_their_buckets_alone(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "t"), 8)
    table.upsert(spark.createDataFrame([bar(s, h, h) for s in "abcdefghij" for h in range(3)], BARS))
    before = table.manifest().live
    table.upsert(spark.createDataFrame([bar("a", 1, 77)], BARS))
    after = table.manifest().live
    assert sum(before[b] != after[b] for b in before) == 1
    one = table.read(symbol="a", source="s", interval="1h", start=T0 + dt.timedelta(hours=1))
    assert sorted(r.close for r in one.collect()) == [2.0, 77.0]
    assert len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    other = next(r for r in "bcdefghij" if len(table.read(symbol=r, source="s", interval="1h").inputFiles()) == 1)
    assert "Exchange" not in table.read(symbol=other, source="s", interval="1h")._jdf.queryExecution().executedPlan().toString()  # a bucket with one folder is a plain scan


def test_two_writers(spark, tmp_path, monkeypatch):
    """A version is committed once; the writer that comes second starts over and loses nothing."""
    a, b = BarTable(spark, str(tmp_path / "t"), 4), BarTable(spark, str(tmp_path / "t"), 4)
    a.upsert(spark.createDataFrame([bar("x", 0, 1)], BARS))
    stale = a.manifest()
    b.upsert(spark.createDataFrame([bar("x", 0, 2), bar("y", 0, 2)], BARS))
    with pytest.raises(Conflict):
        a._commit(stale, stale.live)
    fresh, asked = a.manifest, []
    monkeypatch.setattr(a, "manifest", lambda *v: stale if len(asked.append(1) or asked) <= 2 else fresh(*v))
    assert a.upsert(spark.createDataFrame([bar("x", 0, 3)], BARS)) == 2
    assert {k[0]: v for k, v in content(b.read()).items()} == {"X": 3.0, "Y": 2.0}


def test_batches_are_committed_once(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "t"), 4)
    rows = [bar("a", h, h) for h in range(30)]
    stream = replay.slices(spark.createDataFrame(rows, BARS), 3)
    query = stream.writeStream.foreachBatch(into_table(table, "replay")).option("checkpointLocation", new_folder(spark, "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert table.read().count() == 30 and table.manifest().batches == {"replay": 2}
    version = table.versions()[-1]
    assert table.upsert(spark.createDataFrame([bar("a", 0, 999)], BARS), ("replay", 2)) == version  # the batch that ran is run again
    assert table.upsert(spark.createDataFrame([bar("a", 0, 999)], BARS), ("other", 0)) == version + 1
    assert table.read().where(F.col("close") == 999).count() == 1
