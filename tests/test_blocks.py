"""Blocks of series give the rows of the operators that hold a whole series, whatever their size."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import asof, blocks
from barloom.plans.registry import add_indicators

SCHEMA = "symbol string, source string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bars(spark, n, symbols=("BIG", "small", "one"), hole=0, seed=1):
    """The first symbol has most rows; ``hole`` leaves out stretches, so that blocks are sparse or empty."""
    rng, rows = random.Random(seed), []
    for k, s in enumerate(symbols):
        price, at = 100.0, dt.datetime(2024, 1, 1)
        for _ in range(n if k == 0 else 1 if s == "one" else n // 10):
            at += dt.timedelta(hours=1 + (rng.randrange(200) if hole and rng.random() < hole else 0))
            o, price = price, price * (1 + rng.uniform(-0.02, 0.02))
            rows.append((s, "t", "1h", at, o, max(o, price) * 1.01, min(o, price) * 0.99, price, rng.randrange(1, 500)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b, names, tolerance=1e-9):
    x, y = (df.select("symbol", "ts", *names).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for df in (a, b))
    assert len(x) == len(y)
    for n in names:
        p, q = x[n].to_numpy(float), y[n].to_numpy(float)
        assert np.array_equal(np.isnan(p), np.isnan(q)), n
        assert np.allclose(p[~np.isnan(p)], q[~np.isnan(q)], rtol=tolerance, atol=1e-9), n


@pytest.mark.parametrize(("size", "hole"), [(16, 0.0), (7, 0.2), (4096, 0.1)])
def test_halo_windows_and_scans(spark, size, hole):
    df = bars(spark, 600, hole=hole).cache()
    names = ["sma_10", "sma_200", "bb_upper", "bb_lower", "swing_high_20", "swing_low_20", "rvol", "ker"]
    same(blocks.rolling_halo(df, size), add_indicators(df, names), names)
    same(blocks.vwap_blocks(df, size), add_indicators(df, ["vwap"]), ["vwap"])
    names = ["ema_12", "ema_26", "rsi_14", "atr", "adx", "macd", "macd_signal", "macd_hist", "kama"]
    same(blocks.recursive_blocks(df, size), add_indicators(df, names), names)


def test_blocks_are_bounded_and_complete(spark):
    df = bars(spark, 1000, hole=0.1)
    rows = blocks.with_halo(df, 10, 32)
    per = rows.groupBy("symbol", "_part").agg(F.count(F.lit(1)).alias("n"), F.count_if("_own").alias("own")).collect()
    assert max(r.n for r in per) <= 42 and sum(r.own for r in per) == df.count() and len(per) > 30
    assert blocks.with_halo(df, 100, 32).where("_own").count() == df.count()  # a reach over several blocks
    assert blocks.rolling_halo(df.limit(0)).count() == 0 and blocks.recursive_blocks(df.limit(0)).count() == 0


def test_prefix_of_maps_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    a, b, new = rng.uniform(-1, 1, 500), rng.normal(size=500), rng.random(500) < 0.05
    new[0] = True
    x, y = blocks._by_group(a, b, new)
    for i in range(500):
        p, q = (a[i], b[i]) if new[i] else (a[i] * p, a[i] * q + b[i])
        assert abs(x[i] - p) < 1e-9 and abs(y[i] - q) < 1e-9


def test_scan_carries_over_arrow_batches(spark):
    """A block that comes in many batches of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = bars(spark, 300, symbols=("A", "B"))
        one = F.lit(1.0)
        got = blocks.affine_scan(df, {"n": (one, one), "v": (one, F.col("volume"))}, size=50)
        want = df.selectExpr("symbol", "ts", "cast(count(1) over (partition by symbol order by ts) as double) n", "cast(sum(volume) over (partition by symbol order by ts) as double) v")
        same(got, want, ["n", "v"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("size", [1, 16, 4096])
def test_blocked_asof(spark, size):
    """A slow series with nulls, repeated times and none at all for one symbol, next to a skewed primary series."""
    primary = bars(spark, 500, hole=0.1)
    slow = bars(spark, 40, symbols=("BIG", "small"), seed=5, hole=0.5).withColumn("interval", F.lit("1d")).withColumn("level", F.when(F.col("volume") % 3 != 0, F.col("close"))).withColumn("other", F.col("volume").cast("string"))
    slow = slow.unionByName(slow.where("volume % 2 = 0").withColumn("level", F.lit(1.0)).dropDuplicates(["symbol", "ts"]).limit(1))
    key = lambda df: sorted(map(str, df.select("symbol", "ts", "close", "level_1d", "other_1d").collect()))
    assert key(blocks.asof_blocks(primary, slow, "1d", ["level", "other"], size=size)) == key(asof.asof_join(primary, slow, "1d", ["level", "other"]))
    none = blocks.asof_blocks(primary, slow.limit(0), "1d", ["level"], size=size)
    assert none.count() == primary.count() and none.where("level_1d IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        blocks.chain_blocks(primary, [(slow, "1d")] * 4)
