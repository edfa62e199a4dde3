import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators.asof import asof_join
from barloom.plans.registry import add_indicators, resolve
from barloom.schema import BARS
from barloom.sources import bars as B
from barloom.sources.store import Store
from barloom.streaming.ticks import stream_bars, upsert_batches


def make(spark, prices, symbol="A", interval="1d", start=dt.datetime(2024, 1, 1), step=dt.timedelta(days=1), volume=10):
    rows = [(symbol, "t", interval, start + i * step, *map(float, p), volume) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, BARS)


def test_invalid_bars_are_told(spark):
    df = make(spark, [(1, 2, 1, 1), (1, 0.5, 1, 1), (0, 2, 0, 1), (1, 2, 1, 0)])
    assert B.valid(df).count() == 1
    assert {r.reason for r in B.rejected(df).collect()} == {"high_below_low", "open_not_positive", "close_not_positive"}


def test_upsert_last_write_wins(spark):
    old = make(spark, [(1, 1, 1, 1), (2, 2, 2, 2)])
    new = make(spark, [(9, 9, 9, 9)], symbol="a")
    got = {r.ts.day: r.close for r in B.upsert(old, new).collect()}
    assert got == {1: 9.0, 2: 2.0}


def test_pages(spark):
    df = make(spark, [(i, i, i, i) for i in range(1, 12)])
    assert [r.close for r in B.page(df, 2, 4).orderBy("ts").collect()] == [5, 6, 7, 8]
    assert [r.close for r in B.page(df, size=4).orderBy("ts").collect()] == [9, 10, 11]
    assert B.page(df, 99, 5000).count() == 11


def test_candles_skip_malformed(spark):
    lines = spark.createDataFrame([('{"s":"btc","t":0,"o":"1","h":"2","l":"0.5","c":"1.5","v":"3"}',), ('{"s":"btc","t":0,"o":"x"}',), ("nonsense",)], "json string")
    rows = B.parse_candles(lines, "x", "1h").collect()
    assert [(r.symbol, r.high, r.volume) for r in rows] == [("BTC", 2.0, 3)]


def test_indicators_resolve_needs_in_any_order(spark):
    assert [b.gives[0] for b in resolve(["breakout_quality"], [])][-1] == "breakout_quality"
    df = make(spark, [(10 + i, 12 + i, 9 + i, 11 + i) for i in range(30)])
    out = add_indicators(df, ["trend_status", "bb_upper_5", "ema_5", "ibs"]).orderBy("ts").collect()
    assert out[0].bb_upper_5 is None and out[10].bb_upper_5 > out[10].close - 2
    assert out[3].ema_5 is None and out[4].ema_5 is not None
    assert abs(out[0].ibs - 2 / 3) < 1e-12
    with pytest.raises(KeyError):
        resolve(["no_such"], [])


def test_asof_has_no_look_ahead(spark):
    hour = make(spark, [(1, 1, 1, 1)] * 3, interval="1h", start=dt.datetime(2024, 1, 2, 23), step=dt.timedelta(hours=1))
    day = make(spark, [(1, 1, 1, 1)], start=dt.datetime(2024, 1, 2)).withColumn("level", F.lit(7.0))
    assert [r.level_1d for r in asof_join(hour, day, "1d").orderBy("ts").collect()] == [None, 7.0, 7.0]


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = make(spark, [(1, 1, 1, 1), (2, 2, 2, 2)])
    store.write_bars(df)
    assert store.bars().count() == 2
    key = store.save_artifact(df, symbol="A", indicators=["b", "a"])
    assert key == store.save_artifact(df, symbol="A", indicators=["a", "b"])
    assert store.artifacts().count() == 1 and store.artifact(key).count() == 2
    store.save_document("s", "one")
    store.save_document("s", "two")
    assert [r.document for r in store.documents().collect()] == ["two"]


def test_stream_of_ticks(spark, tmp_path):
    ticks = [("a", float(i), dt.datetime(2024, 1, 1, 0, i, tzinfo=dt.timezone.utc)) for i in range(0, 50, 10)] + [("a", 1.0, dt.datetime(2024, 1, 1, 9, tzinfo=dt.timezone.utc))]
    spark.createDataFrame(ticks, "symbol string, price double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, price double, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_bars(stream, "30min", late="10 minutes").writeStream.outputMode("append").foreachBatch(upsert_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = sorted(p.name for p in (tmp_path / "out").iterdir())[-1]
    rows = spark.read.parquet(str(tmp_path / "out" / last)).orderBy("ts").collect()
    assert [(r.open, r.close, r.volume) for r in rows] == [(0.0, 20.0, 3), (30.0, 40.0, 2)]
