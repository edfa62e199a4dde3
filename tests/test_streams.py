"""Stateful streams give the rows of the batch operators, however their input is cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest
from barloom.plans import strategy
from barloom.plans.registry import add_indicators
from barloom.queries_more import CROSSING
from barloom.schema import BARS
from barloom.sources.shared import new_folder
from barloom.streaming import indicators, kernel, replay


def walk(n, symbols=("A", "B"), seed=1):
    rng, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for i in range(n):
            o, price = price, price * (1 + rng.uniform(-0.03, 0.03))
            rows.append((s, "t", "1h", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), o, max(o, price) * 1.01, min(o, price) * 0.99, price, rng.randrange(1, 500)))
    return rows


def batches(spark, rows, schema, cuts):
    """A stream whose batches are the given lists of rows."""
    folder = new_folder(spark, "batches")
    for cut in cuts:
        spark.createDataFrame([rows[i] for i in cut], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def text(df):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.collect())


HOW = backtest.Execution(commission_pct=0.001, slippage_pct=0.0005, leverage=2.0, borrow_fee_annual_pct=0.1)


@pytest.mark.parametrize("seed", [1, 2])
def test_kernel_in_any_cut(spark, seed):
    s = strategy.parse(CROSSING)
    prepared = strategy.prepare(s, spark.createDataFrame(walk(160, ("A", "B", "C"), seed=seed), BARS))
    rows = sorted((tuple(r) for r in prepared.collect()), key=lambda r: (r[3], r[0]))
    rng = random.Random(seed)
    ends = sorted({0, len(rows), *[2 * rng.randrange(len(rows) // 2) for _ in range(3)]})
    cuts = [rng.sample(range(a, b), b - a) for a, b in zip(ends, ends[1:])]
    got = kernel.settled(replay.to_end(batches(spark, rows, prepared.schema, cuts), lambda x: kernel.run_stream(s, x, HOW)))
    want = backtest.run(s, prepared, HOW)
    assert want.where("kind = 'trade'").count() >= 3
    for kind in (backtest.trades, backtest.equity, backtest.notes):
        assert text(kind(got)) == text(kind(want))


def test_kernel_refuses_late_bars(spark):
    s = strategy.parse(CROSSING)
    prepared = strategy.prepare(s, spark.createDataFrame(walk(60, ("A",)), BARS))
    rows = sorted((tuple(r) for r in prepared.collect()), key=lambda r: r[3])
    stream = batches(spark, rows, prepared.schema, [range(40), [5, 39, *range(40, 50)], range(50, 60)])
    got = kernel.settled(replay.to_end(stream, lambda x: kernel.run_stream(s, x)))
    assert [r.ts.hour for r in backtest.notes(got).where("code = 'late_bar'").orderBy("ts").collect()] == [5, 15]
    assert text(backtest.trades(got)) == text(backtest.trades(backtest.run(s, prepared)))


def test_indicators_as_bars_close(spark):
    """Rows out of order within the delay, and one too late, over several batches."""
    rows = walk(60)
    order = sorted(range(len(rows)), key=lambda i: rows[i][3])
    for a in range(0, len(order) - 6, 5):  # disorder of a few hours, also over the ends of batches
        order[a : a + 6] = random.Random(a).sample(order[a : a + 6], 6)
    cuts = [order[:50], order[50:90], order[90:]]
    end = [("A", "t", "1h", dt.datetime(2024, 3, 1), 1.0, 1.0, 1.0, 1.0, 1), ("A", "t", "1h", dt.datetime(2024, 1, 1, 2), 9.0, 9.0, 9.0, 9.0, 9)]
    stream = batches(spark, rows + end, BARS, [*cuts, [len(rows)], [len(rows) + 1]])
    got = replay.to_end(stream, lambda x: indicators.indicator_stream(x, "12 hours")).where("ts < '2024-02-01'")
    bars = spark.createDataFrame(rows, BARS)
    want = add_indicators(bars, list(indicators.COLUMNS))
    names = ["symbol", "ts", "close", *indicators.COLUMNS]
    assert text(got.select(*names)) == text(want.select(*names))


def test_silent_series_are_forgotten(spark):
    rows = walk(20, ("A",)) + [("A", "t", "1h", dt.datetime(2024, 2, 1) + dt.timedelta(hours=h), 5.0, 6.0, 4.0, 5.0, 1) for h in range(3)] + [("B", "t", "1h", dt.datetime(2024, 1, 20), 1.0, 1.0, 1.0, 1.0, 1), ("B", "t", "1h", dt.datetime(2024, 3, 1), 1.0, 1.0, 1.0, 1.0, 1)]
    stream = batches(spark, rows, BARS, [range(20), [23], [20, 21, 22], [24]])
    got = replay.to_end(stream, lambda x: indicators.indicator_stream(x, "0 seconds", dt.timedelta(days=10))).where("symbol = 'A'")
    by = {r.ts: r for r in got.collect()}
    assert len(by) == 23 and by[dt.datetime(2024, 1, 1, 19)].atr is not None
    assert by[dt.datetime(2024, 2, 1, 2)].ema_12 is None  # 23 bars in all, but only three since the silence


def test_empty_slices(spark):
    empty = replay.to_end(replay.slices(spark.createDataFrame([], BARS), 3), lambda x: x.where(F.lit(True)))
    assert empty.count() == 0 and empty.columns == BARS.names
