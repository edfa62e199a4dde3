"""Fills with known prices: cash 10 000, size 10, entry signal on bar 1, daily bars."""

import datetime as dt
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import queries_more
from barloom.operators import backtest, metrics, search
from barloom.operators.asof import spine_fill
from barloom.operators.backtest import Execution, simulate
from barloom.operators.search import folds, grid, sample
from barloom.plans import strategy
from barloom.schema import BARS

FLAT = (100, 100, 100, 100)


def run(bars, side="long", stop=0.0, target=0.0, **how):
    df = pd.DataFrame([(*map(float, b),) for b in bars], columns=["open", "high", "low", "close"])
    df["ts"] = pd.date_range("2024-01-01", periods=len(df))
    df[f"{side}_stop"], df[f"{side}_target"] = stop, target
    how = {"size": 10.0, **how}
    return simulate(df, {side: (lambda i, m: i == 0, None)}, Execution(**how))


@pytest.mark.parametrize(
    ("side", "stop", "target", "second", "third", "entry", "exit_", "pnl", "reason", "final"),
    [
        ("long", 0, 0, (101,) * 4, (102, 110, 102, 110), 101, 110, 90, "end_of_backtest", 10090),
        ("short", 0, 0, FLAT, (90,) * 4, 100, 90, 100, "end_of_backtest", 10100),
        ("long", 95, 0, FLAT, (100, 100, 94, 96), 100, 95, -50, "stop_loss", 9950),
        ("long", 95, 0, FLAT, (90, 91, 89, 90), 100, 90, -100, "stop_loss_gap", 9900),
        ("short", 105, 0, FLAT, (100, 106, 100, 104), 100, 105, -50, "stop_loss", 9950),
        ("long", 0, 110, FLAT, (115, 116, 115, 115), 100, 115, 150, "take_profit_gap", 10150),
        ("long", 95, 110, FLAT, (100, 115, 90, 100), 100, 95, -50, "stop_loss", 9950),
    ],
)
def test_golden(side, stop, target, second, third, entry, exit_, pnl, reason, final):
    account, equity = run([FLAT, second, third], side, stop, target)
    (t,) = account.trades
    assert (t["entry_price"], t["exit_price"], t["pnl"], t["exit_reason"]) == (entry, exit_, pnl, reason)
    assert equity["value"].iloc[-1] == final


def test_entry_gap_under_stop_is_dropped():
    account, equity = run([FLAT, (90, 90, 90, 90), FLAT], stop=95)
    assert not account.trades and equity["value"].iloc[-1] == 10_000


def test_size_at_fill_and_leverage():
    account, _ = run([FLAT, (200,) * 4, (200,) * 4], stop=90, size=None)
    assert account.trades[0]["size"] == pytest.approx(200 / 110)
    bars = [FLAT, FLAT, (90, 90, 90, 90)]
    account, equity = run(bars, stop=90, size=None, leverage=3.0)
    assert (account.trades[0]["size"], equity["value"].iloc[-1]) == (20, 9800)
    account, equity = run(bars, stop=90, size=None, leverage=3.0, scale_risk=True)
    assert (account.trades[0]["size"], equity["value"].iloc[-1]) == (60, 9400)


def test_costs():
    account, equity = run([FLAT, FLAT, FLAT], size=100.0, slippage_pct=0.01)
    assert (account.trades[0]["entry_price"], account.trades[0]["exit_price"]) == (101, 99)
    assert account.slippage == pytest.approx(198.02, abs=0.005) and account.notes[0][1] == "affordability_cap"
    assert equity["value"].iloc[-1] == pytest.approx(9801.98, abs=0.005)
    account, _ = run([FLAT, FLAT, (90,) * 4], "short", borrow_fee_annual_pct=0.05)
    assert account.trades[0]["borrow_cost"] > 0 and account.trades[0]["pnl"] < 100


def test_oversize():
    account, _ = run([FLAT] * 3, size=500.0, reject_oversized=True)
    assert not account.trades and account.notes[0][1] == "explicit_size_rejected"
    account, _ = run([FLAT] * 3, size=500.0, allow_negative_cash=True)
    assert account.trades[0]["size"] == 500 and not account.notes


def test_grid_and_folds():
    assert len(grid({"a": {"min": 1, "max": 3, "step": 1}, "b": {"values": [1, 2]}})) == 6
    with pytest.raises(ValueError):
        grid({"a": {"min": 1, "max": 200, "step": 1}})
    assert len(sample({"a": {"min": 1, "max": 3}}, 10, seed=1)) == 3
    f = folds(300, 3)
    assert f[0] == {"train_start": 0, "train_end": 70, "test_start": 70, "test_end": 170}
    assert all(x["train_end"] == x["test_start"] for x in f)
    assert [x["train_end"] for x in folds(300, 3, anchored=True)] == [100, 200]


def test_folds_cover_every_bar_of_each_series(spark):
    """Two series of different lengths: each has folds from its own number of bars, up to its last one."""
    bars = queries_more.B.event_bars(spark, "/root/testdata/sf0.1")
    symbols = sorted(r.symbol for r in bars.select("symbol").distinct().collect())
    bars = bars.where((F.col("symbol") != symbols[0]) | (F.col("ts") < F.lit(bars.agg(F.expr("min(ts) + interval 10 days")).first()[0]))).persist()
    ends = lambda df: {r.symbol: (r.n, r.first, r.last) for r in df.groupBy("symbol").agg(F.countDistinct("ts").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).collect()}
    want = ends(bars)
    assert len(want) > 1 and ends(search.fold_bars(bars, lambda n: folds(n, 3))) == want


def test_one_preparation_equals_one_by_one(spark):
    """All combinations in one plan give what each gives alone; one that is no valid strategy is a row."""
    bars = queries_more.B.event_bars(spark, "/root/testdata/sf0.001").persist()
    combos = [*grid({"fast": {"values": [5, 8]}, "slow": {"values": [20]}}), {"fast": -1, "slow": 20}]
    together = search.run_combinations(queries_more.CROSSING, bars, combos)
    for i, c in enumerate(combos[:2]):
        s = strategy.parse(queries_more.CROSSING, c)
        alone = backtest.run(s, strategy.prepare(s, bars))
        key = lambda df: sorted(map(str, df.collect()))
        assert key(together.where(F.col("combo") == i).drop("combo")) == key(alone)
    found = search.grid_search(queries_more.CROSSING, bars, combos, 1638.0).collect()
    assert [r.combo for r in found if r.error] == [2] and {r.combo for r in found if not r.error} == {0, 1}


def test_portfolio_curve_matches_the_grid(spark):
    rows = [("a", 1, 10.0), ("a", 3, 0.0), ("b", 2, 5.0), ("b", 90_000, None), ("b", 200_000, 1.5), ("c", 3, 7.25)]
    df = spark.createDataFrame(rows, "symbol string, at long, value double").select("symbol", F.timestamp_seconds("at").alias("ts"), "value")
    got = [(r.value, round(r.drawdown, 9)) for r in queries_more.portfolio.portfolio_equity(df, 4.0).orderBy("ts").collect()]
    want, peak = [], 4.0
    sums = [r.v for r in spine_fill(df, "value").groupBy("ts").agg(F.sum("value").alias("v")).orderBy("ts").collect()]
    for v in (v or 4.0 for v in sums):
        want.append((v, round(max((peak - v) / peak, 0), 9)))
        peak = max(peak, v)
    assert got == want


def test_portfolio_runs_every_symbol(spark, monkeypatch):
    seen = []

    def run(s, prepared, weights, how):
        seen.extend(weights)
        raise StopIteration

    monkeypatch.setattr(queries_more.portfolio, "run_portfolio", run)
    with pytest.raises(StopIteration):
        queries_more.portfolio_run(spark, "/root/testdata/sf0.001")
    assert sorted(seen) == ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]


def test_slippage_and_liquidation(spark):
    """A short of 2x leverage is liquidated half above its entry, pays for what it borrows, and the report tells slippage."""
    day = lambda d, o, h, low, c: ("A", "s", "1d", dt.datetime(2024, 1, d), o, h, low, c, 1)
    rows = [day(1, 10.0, 10.0, 9.0, 9.0), day(2, 10.0, 11.0, 9.0, 10.0), day(3, 10.0, 14.0, 9.0, 10.0), day(4, 10.0, 15.5, 9.0, 12.0), day(5, 12.0, 12.0, 12.0, 12.0)]
    s = strategy.parse({"schema_version": "2.0", "name": "x", "sides": {"short": {"entry": {"condition": {"left": "close", "operator": "<", "right": "open"}}}}})
    how = backtest.Execution(cash=1e6, leverage=2.0, size=3.0, borrow_fee_annual_pct=0.365, slippage_pct=0.01)
    result = backtest.run(s, strategy.prepare(s, spark.createDataFrame(rows, BARS)), how)
    (t,) = backtest.trades(result).collect()
    entry, leave = 10 * 0.99, 10 * 0.99 * 1.5 * 1.01
    assert (t.exit_reason, t.exit_ts.day, t.duration_bars) == ("liquidation", 4, 3)
    assert abs(t.entry_price - entry) < 1e-8 and abs(t.exit_price - leave) < 1e-8 and t.borrow_cost == round(3 * entry * 0.365 * 2 / 365, 2)
    r = metrics.report(backtest.equity(result), backtest.trades(result), backtest.notes(result), 252.0, slippage_pct=0.01).first()
    assert abs(r.slippage - 3 * (10 * 0.01 + entry * 1.5 * 0.01)) < 1e-6 and r.reconciles


def test_searches_share_their_plan(spark):
    """Indicators of all combinations come from one grouped pass, and equal rules are one column whatever their names."""
    from barloom.queries_scale import EMAS

    rows = [("A", "s", "1h", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 10.0 + h % 7, 12.0 + h % 7, 9.0, 10.0 + (h * 5) % 11, h) for h in range(60)]
    bars = spark.createDataFrame(rows, BARS)
    tries = [{"fast": f, "slow": s, "stop": p} for f in (3, 5) for s in (8, 9) for p in (0.1, 0.2, 0.3)]
    rows, trees, failed = search.prepared_runs(EMAS, bars, tries)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1 and not failed
    text = rows._jdf.queryExecution().analyzed().toString()
    shared = {x for x in re.findall(r"_shared[0-9]+", text)}
    assert len(shared) < len(tries) * 11 / 2  # 11 columns a run
    for i in (0, 7):
        alone = search.run_combinations(EMAS, bars, [tries[i]])
        both = search.run_combinations(EMAS, bars, tries).where(f"combo = {i}").drop("combo")
        key = lambda d: sorted(map(str, d.collect()))
        assert key(both) == key(alone.drop("combo"))
    a = strategy.parse(EMAS, {"fast": 3, "slow": 8})
    b = strategy.parse({**EMAS, "indicators": [{**x, "name": x["name"]} for x in EMAS["indicators"]]}, {"fast": 3, "slow": 9})
    assert a.meaning(["fast_sma"]) == b.meaning(["fast_sma"]) and a.meaning(["slow_sma"]) != b.meaning(["slow_sma"]) and a.meaning(["gap"]) != b.meaning(["gap"])
