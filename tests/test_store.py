"""Store, streams, and helpers of metrics and searches that have no query of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, metrics, recursive, search
from barloom.schema import KEY
from barloom.sources import bars as B
from barloom.sources.store import Store
from barloom.streaming.ticks import upsert_batches

T0 = dt.datetime(2024, 1, 1)
COLUMNS = "symbol string, source string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def hourly(spark):
    rows = [("A", "x", "1h", T0 + dt.timedelta(hours=i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 5) for i in range(6)]
    return spark.createDataFrame(rows, COLUMNS).persist()


def test_artifacts(spark, tmp_path, hourly):
    store = Store(spark, str(tmp_path))
    key = store.save_artifact(hourly.withColumn("sma_2", F.col("close")), indicators=["sma_2"], symbol="A")
    assert store.save_artifact(hourly, indicators=["sma_2"], symbol="A") == key
    part = store.artifact(key, start=T0 + dt.timedelta(hours=1), end=T0 + dt.timedelta(hours=4), columns=["sma_2"])
    assert part.columns == [*KEY, "ts", "sma_2"] and part.count() == 4
    assert [r.close for r in store.artifact(key, size=4, number=2).orderBy("ts").collect()] == [15.0, 16.0]
    assert store.missing_columns(key, ["close", "rsi_14", "sma_2", "atr", "atr"]) == ["rsi_14", "atr"]
    assert store.expired(3600).count() == 0 and {r.column: r.nulls for r in store.describe_artifact(key).collect()}["sma_2"] == 0
    other = store.save_artifact(hourly, indicators=[], symbol="B")
    store.delete_artifact(key)
    assert [r.key for r in store.artifacts().collect()] == [other]
    again = store.save_artifact(hourly, indicators=["sma_2"], symbol="A")
    assert again != key and store.artifact(again).count() == 6
    assert set(store.delete_expired(-1)) == {other, again} and store.artifacts().count() == 0


def test_results_and_documents(spark, tmp_path, hourly):
    store = Store(spark, str(tmp_path))
    rows = hourly.select(*KEY, "ts", F.lit("trade").alias("kind"))
    one, two = store.save_result(rows, "first"), store.save_result(rows.where("ts = '2024-01-01'"), "second")
    assert store.result(one).count() == 6 and {r.name: r.trades for r in store.results().collect()} == {"first": 6, "second": 1}
    store.delete_result(one)
    assert [r.result_id for r in store.results().collect()] == [two]
    store.save_document("s", "{}", ["t"])
    store.save_document("s", "{1}")
    assert [(r.name, r.document) for r in store.documents().collect()] == [("s", "{1}")]
    store.delete_document("s")
    assert store.documents().count() == 0
    store.save_document("s", "{2}")
    assert store.documents().first().document == "{2}"


def test_batches_may_repeat_and_skip(spark, tmp_path, hourly):
    run = upsert_batches(str(tmp_path / "bars"))
    later = hourly.where("ts > '2024-01-01 03:00:00'").withColumn("close", F.lit(99.0))
    run(hourly.where("ts <= '2024-01-01 04:00:00'"), 0)
    run(later, 5)
    run(later, 5)
    got = spark.read.parquet(str(tmp_path / "bars/v5"))
    assert got.count() == 6 and got.where("close = 99").count() == 2


def test_quotes_info_and_derivatives(spark, hourly):
    raw = spark.createDataFrame([("a", "2024-01-02 09:30:00", 1.0, 2.0, 0.5, 1.5, None), ("b", "2024-07-02 09:30:00", 1.0, 2.0, 0.5, 1.5, 7)], "Symbol string, Datetime string, Open double, High double, Low double, Close double, Volume long")
    quotes = {r.symbol: r for r in B.normalise_quotes(raw, "shop", "1h", "America/New_York").collect()}
    assert tuple(quotes["A"]) == ("A", "shop", "1h", dt.datetime(2024, 1, 2, 14, 30), 1.0, 2.0, 0.5, 1.5, None)  # winter time
    assert (quotes["B"].ts, quotes["B"].volume) == (dt.datetime(2024, 7, 2, 13, 30), 7)  # summer time
    daily = raw.withColumnRenamed("Datetime", "Date")
    assert B.normalise_quotes(daily, "shop", "1d", "UTC").where("symbol = 'A'").first().ts == dt.datetime(2024, 1, 2, 9, 30)
    assert B.symbol_info(hourly, spark.createDataFrame([("A", "Alpha")], "symbol string, name string")).first().name == "Alpha"
    rows = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), 0.0001) for i in range(3)], "symbol string, ts timestamp_ntz, funding_rate double")
    assert B.derivatives_between(rows, "a", T0, T0 + dt.timedelta(hours=2)).count() == 2
    assert B.with_annual_funding(rows).first().funding_rate_annualised == pytest.approx(0.0001 * 1095)



def test_metric_helpers(spark, hourly):
    assert metrics.annual_factor("1d") == (252.0, "") and metrics.annual_factor("1h", "crypto_24_7")[0] == 8760.0 and metrics.annual_factor("7q")[1]
    curve = hourly.select(*KEY, "ts", "close", F.col("close").alias("value"), F.lit(0.5).alias("position"))
    assert {r.exposure for r in metrics.exposure(curve).collect()} == {0.5}
    trades = spark.createDataFrame([("A", "x", "1h", T0, T0, 4.0, 0.1, 0.1, 0.0), ("A", "x", "1h", T0 + dt.timedelta(1), T0 + dt.timedelta(1), 1.0, 0.1, 0.1, 0.0)], "symbol string, source string, interval string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, pnl double, entry_commission double, exit_commission double, borrow_cost double")
    r = metrics.reconcile(curve, trades).first()
    assert (r.net, r.difference) == (5.0, 0.0) and r.fees == pytest.approx(0.4)
    assert [x.pnl for x in metrics.sort_trades(trades, "pnl").collect()] == [1.0, 4.0]
    both = recursive.add_recursive(hourly, ["proxy_atr", "atr_14"]).toPandas()
    assert both["proxy_atr"].equals(both["atr_14"])


def test_fold_summary_and_stability(spark):
    shown = ("total_return", "sharpe", "max_drawdown", "win_rate", "trades")
    rows = [("A", "x", "1h", i, *[float(v)] * 5, *[float(w)] * 5) for i, (v, w) in enumerate(((1, 1), (2, 5), (3, 30)))]
    walked = spark.createDataFrame(rows, "symbol string, source string, interval string, fold int, " + ", ".join(f"{p}_{c} double" for p in ("is", "oos") for c in shown))
    s = search.fold_summary(walked).first()
    assert s.folds == 3 and s.oos_total_return == pytest.approx(2 * 6 * 31 - 1) and s.is_oos_rank_correlation == pytest.approx(1.0) and 0.8 < s.is_oos_correlation < 1
    chosen = spark.createDataFrame([("A", "x", "1h", "p", v) for v in (10.0, 11.0, 30.0)], "symbol string, source string, interval string, param string, value double")
    assert search.stability(chosen).first().stability == 0.0
    assert search.stability(chosen.where("value < 20")).first().stability == 1.0


def test_custom_strategies(hourly):
    class Buyer:
        """Buys at the close of the second bar with a stop, leaves two bars later."""

        def on_bar(self, i, frame, memory):
            if i == 1:
                memory["in"] = i
                return "long", frame["close"][i] - 5, 0.0
            return "exit" if memory.get("in") == i - 2 else None

    rows = backtest.run_custom(Buyer, hourly, backtest.Execution(size=10.0))
    (t,) = backtest.trades(rows).collect()
    assert (t.entry_ts, t.exit_ts, t.entry_price, t.exit_price, t.exit_reason) == (T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=4), 12.0, 14.0, "signal")
