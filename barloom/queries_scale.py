"""Queries of the operators for long series, streams and stored tables; each gives the rows of a simpler one."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from barloom import queries, queries_more
from barloom.operators import backtest, blocks, gram, range_profiles, search
from barloom.plans import strategy
from barloom.plans.registry import add_indicators
from barloom.queries import BARS_1H, ID, IDS, SQL, W, out, over, query, r, rounded
from barloom.sources import bars as B
from barloom.sources import bucketed, candles, versioned
from barloom.sources.shared import new_folder
from barloom.streaming import indicators, kernel, replay

#: Bars of a block in these queries: the series of the tables have some hundred bars, so that each is several blocks.
SIZE = 64


@query(SQL["rolling_columns"])
def rolling_halo(spark, d):
    names = [*[f"sma_{n}" for n in (10, 20, 30, 50, 200)], "bb_upper", "bb_middle", "bb_lower", "swing_high_20", "swing_low_20", "rvol", "ker", "vwap"]
    return out(blocks.vwap_blocks(blocks.rolling_halo(B.event_bars(spark, d), SIZE), SIZE), *names)


@query(SQL["recursive_columns"])
def recursive_blocks(spark, d):
    names = ["ema_12", "ema_26", "rsi_14", "atr", "adx", "macd", "macd_signal", "macd_hist", "kama"]
    df = blocks.recursive_blocks(B.event_bars(spark, d), SIZE)
    return df.select(*ID, *[F.round(n, 4 if n in ("rsi_14", "adx") else 6).alias(n) for n in names])


@query(SQL["asof_chain"])
def asof_blocks(spark, d):
    level = lambda interval: B.event_bars(spark, d, interval).withColumn("level", F.col("close"))
    return blocks.chain_blocks(B.event_bars(spark, d), [(level("1d"), "1d"), (level("1w"), "1w")], size=SIZE).select(*ID, "level_1d", "level_1w")


@query(f"WITH {BARS_1H} SELECT {IDS}, open, high, low, close, volume FROM bars WHERE symbol IN ('CLICK', 'VIEW') AND ts >= '2024-01-03' AND ts < '2024-01-20 12:00:00'")
def candles_scan(spark, d):
    """Bars out to an archive of candle chunks and back in, with conditions on series and time."""
    folder = new_folder(spark, "candles")
    candles.write_archive(B.event_bars(spark, d), folder, 48)
    bars = candles.read_archive(spark, folder, source="events")
    return bars.where("symbol IN ('CLICK', 'VIEW') AND ts >= timestamp_ntz '2024-01-03' AND ts < timestamp_ntz '2024-01-20 12:00:00'").select(*ID, "open", "high", "low", "close", "volume")


def _streamed(spark, d, how, n=5):
    s = strategy.parse(queries_more.CROSSING)
    prepared = strategy.prepare(s, B.event_bars(spark, d))
    return kernel.settled(replay.to_end(replay.slices(prepared, n), lambda rows: kernel.run_stream(s, rows, how)))


_COSTS = backtest.Execution(commission_pct=0.001, slippage_pct=0.0005)


@query(SQL["backtest_trades"])
def backtest_stream_trades(spark, d):
    return rounded(backtest.trades(_streamed(spark, d, _COSTS)))


@query(SQL["backtest_equity"])
def backtest_stream_equity(spark, d):
    return rounded(backtest.equity(_streamed(spark, d, _COSTS, 3)))


@query(
    f"""{queries._FOLDS}, p AS (SELECT *, CAST(ts AS DATE) AS day, (high + low + close) / 3 AS p FROM bars),
    v AS (SELECT symbol, ts, sum(p * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vw, first_value(high) OVER w AS ih, first_value(low) OVER w AS il FROM p WINDOW w AS (PARTITION BY symbol, day ORDER BY ts))
    SELECT {IDS}, {r("CASE WHEN i >= 12 THEN e12 END", "ema_12")}, {r("CASE WHEN i >= 26 THEN e26 END", "ema_26")}, {r("CASE WHEN i >= 26 THEN e12 - e26 END", "macd")}, {r("CASE WHEN i >= 14 THEN 100 * g / nullif(g + l, 0) END", "rsi_14", 4)},
    {r("CASE WHEN i >= 14 THEN a END", "atr")}, {r(f"vw + {queries.OFF_TIES}", "vwap_session", 4)}, {r("ih", "ib_high")}, {r("il", "ib_low")} FROM x JOIN v USING (symbol, ts)"""
)
def stream_indicators(spark, d):
    """Bars as a stream in slices of time; each row comes once its bar is older than the watermark, here after a bar that ends the stream."""
    bars = B.event_bars(spark, d)
    ends = bars.groupBy("source", "interval").agg(F.max("ts").alias("ts")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    end = ends.select(F.lit("~end").alias("symbol"), "source", "interval", "ts", *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"))
    rows = replay.to_end(replay.slices(bars.unionByName(end), 4), lambda x: indicators.indicator_stream(x, "1 hour", dt.timedelta(days=3650))).where("symbol <> '~end'")
    digits = {"rsi_14": 4, "vwap_session": 4}
    return rows.select(*ID, *[F.round(F.col(c) + (queries.OFF_TIES if c == "vwap_session" else 0.0), digits.get(c, 6)).alias(c) for c in indicators.COLUMNS])


@query(SQL["correlation_pearson"])
def correlation_gram(spark, d):
    return rounded(gram.correlations(B.event_bars(spark, d, "1d"), "close"))


@query(SQL["correlation_spearman"])
def correlation_gram_ranks(spark, d):
    return rounded(gram.correlations(B.event_bars(spark, d, "1d"), "close", spearman=True))


SOURCED = {
    "schema_version": "2.0", "name": "sourced",
    "indicators": [{"name": "top", "type": "sma", "period": 10, "source": "high"}, {"name": "floor", "type": "bb_lower", "period": 20, "source": "low"}, {"name": "fast", "type": "ema", "period": 10, "source": "ohlc4"}],
    "sides": {
        "long": {"entry": {"condition": {"left": "close", "operator": ">", "right": "top"}}, "exit": {"condition": {"left": "close", "operator": "<", "right": "floor"}}, "entry_confidence": 0.9},
        "short": {"entry": {"condition": {"left": "close", "operator": "<", "right": "fast"}}, "exit_confidence": 0.2},
    },
}


@query(
    f"""WITH RECURSIVE {BARS_1H}, n AS (SELECT *, row_number() OVER ({W}) AS i, (open + high + low + close) / 4 AS p FROM bars),
    e AS (SELECT symbol, i, p AS v FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, v + (p - v) * 2 / 11 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
    s AS (SELECT n.*, {over("avg(high)", 10, x="high")} AS top, {over("avg(low)", 20, x="low")} - 2 * {over("stddev_pop(low)", 20, x="low")} AS floor FROM n),
    a AS (SELECT s.*, CASE WHEN s.i >= 10 THEN v END AS fast FROM s JOIN e USING (symbol, i)),
    x AS (SELECT *, 'long' AS direction, 'entry' AS action, 0.9 AS confidence FROM a WHERE close > top UNION ALL SELECT *, 'long', 'exit', 0.7 FROM a WHERE close < floor UNION ALL SELECT *, 'short', 'entry', 0.7 FROM a WHERE close < fast)
    SELECT {IDS}, direction, action, confidence::DOUBLE AS confidence FROM x"""
)
def rule_signals(spark, d):
    """Rules on indicators of other prices than the close, with how sure each signal is."""
    s = strategy.parse(SOURCED)
    return strategy.signals(s, strategy.prepare(s, B.event_bars(spark, d)))


LEVERED = {
    "schema_version": "2.0", "name": "levered",
    "sides": {"short": {"entry": {"condition": {"left": "close", "operator": "<", "right": "open"}}, "exit": {"condition": {"left": "volume", "operator": "<", "right": 2}}}},
}


@query(
    f"""WITH RECURSIVE {BARS_1H}, n AS (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM bars),
    k AS (
      SELECT symbol, 0::BIGINT AS i, false AS pend, false AS leave, NULL::DOUBLE AS p, NULL::TIMESTAMP AS since, 0::BIGINT AS held, NULL::DOUBLE AS x, NULL::VARCHAR AS why, NULL::DOUBLE AS ep, NULL::TIMESTAMP AS es, 0::BIGINT AS eh FROM (SELECT DISTINCT symbol FROM bars)
      UNION ALL
      SELECT symbol, i, p2 IS NULL AND close < open, p2 IS NOT NULL AND volume < 2, CASE WHEN i = m THEN NULL ELSE p2 END, since1, held1,
        CASE WHEN out0 THEN open WHEN hit THEN liq WHEN i = m AND p2 IS NOT NULL THEN close END, CASE WHEN out0 THEN 'signal' WHEN hit THEN 'liquidation' WHEN i = m AND p2 IS NOT NULL THEN 'end_of_backtest' END,
        CASE WHEN out0 THEN p ELSE p1 END, CASE WHEN out0 THEN since ELSE since1 END, CASE WHEN out0 THEN held ELSE held1 END
      FROM (SELECT *, CASE WHEN hit THEN NULL ELSE p1 END AS p2 FROM (SELECT *, coalesce(p1 IS NOT NULL AND high >= liq, false) AS hit FROM (SELECT *, p1 * 1.5 AS liq, CASE WHEN pend AND p0 IS NULL THEN 1 ELSE held + 1 END AS held1, CASE WHEN pend AND p0 IS NULL THEN ts ELSE since END AS since1 FROM (
        SELECT *, CASE WHEN p0 IS NULL AND pend THEN open ELSE p0 END AS p1 FROM (SELECT n.*, k.pend, k.leave, k.p, k.since, k.held, k.leave AND k.p IS NOT NULL AS out0, CASE WHEN k.leave THEN NULL ELSE k.p END AS p0 FROM k JOIN n ON n.symbol = k.symbol AND n.i = k.i + 1)))))
    )
    SELECT n.symbol, n.source, n."interval", k.es AS entry_ts, n.ts AS exit_ts, {r("k.ep", "entry_price")}, {r("k.x", "exit_price")}, {r("2 * k.ep * 0.3 * date_diff('day', CAST(k.es AS DATE), CAST(n.ts AS DATE)) / 365.0", "borrow_cost", 2)},
      {r("2 * (k.ep - k.x) - 2 * k.ep * 0.3 * date_diff('day', CAST(k.es AS DATE), CAST(n.ts AS DATE)) / 365.0", "pnl", 2)}, k.eh AS duration_bars, k.why AS exit_reason
    FROM k JOIN n ON n.symbol = k.symbol AND n.i = k.i WHERE k.x IS NOT NULL"""
)
def backtest_liquidation(spark, d):
    """Short runs that pay for what they borrow and are liquidated at 1.5 times the entry price."""
    s = strategy.parse(LEVERED)
    how = backtest.Execution(cash=1e9, leverage=2.0, size=2.0, borrow_fee_annual_pct=0.3)
    rows = backtest.trades(backtest.run(s, strategy.prepare(s, B.event_bars(spark, d)), how))
    return rounded(rows.select("symbol", "source", "interval", "entry_ts", "exit_ts", "entry_price", "exit_price", F.round("borrow_cost", 2).alias("borrow_cost"), F.round("pnl", 2).alias("pnl"), "duration_bars", "exit_reason"))


@query(
    f"""WITH {BARS_1H}, n AS (SELECT * REPLACE (CASE WHEN volume % 3 = 0 THEN close * 2 ELSE close END AS close) FROM bars WHERE NOT (symbol = 'VIEW' AND ts < '2024-01-10'))
    SELECT {IDS}, open, high, low, close, volume FROM n"""
)
def bars_versioned(spark, d):
    """Bars in three upserts, one of them changes, a compaction and a deletion: the newest version of the table."""
    bars = B.event_bars(spark, d)
    table = versioned.BarTable(spark, new_folder(spark, "bar-table"), 8)
    table.upsert(bars.where("volume % 2 = 0"), ("load", 0))
    table.upsert(bars.where("volume % 2 = 1"), ("load", 1))
    table.upsert(bars.where("volume % 3 = 0").withColumn("close", F.col("close") * 2), ("load", 2))
    table.upsert(bars.where("volume % 3 = 0"), ("load", 2))  # the batch comes again and changes nothing
    table.compact(2)
    table.delete("view", before="2024-01-10")
    return table.read().select(*ID, "open", "high", "low", "close", "volume")


@query(f"WITH {BARS_1H} SELECT {IDS}, close, {r(over('avg(close)', 20), 'sma_20')}, {r(over('max(high)', 20, 5, 'high'), 'swing_high_20')} FROM bars")
def bars_bucketed(spark, d):
    """Bars stored in buckets by series, and windows over them without a shuffle."""
    name = f"bars_{uuid.uuid4().hex}"
    bucketed.write_bucketed(B.event_bars(spark, d), name, 8, path=new_folder(spark, "bucketed"))
    return out(add_indicators(bucketed.read_bucketed(spark, name), ["sma_20", "swing_high_20"]), "close", "sma_20", "swing_high_20")


EMAS = {**queries_more.CROSSING, "name": "emas", "indicators": [{**i, "type": "ema"} for i in queries_more.CROSSING["indicators"]]}
_TRIES = [{"fast": f, "slow": s, "stop": p} for f in (5, 10) for s in (20, 30) for p in (0.2, 0.4)]


def _ema_grid() -> str:
    periods = sorted({c[k] for c in _TRIES for k in ("fast", "slow")})
    runs = [
        f"""SELECT {g} AS g, {IDS}, open, high, low, close, CASE WHEN i >= {c["fast"]} THEN e{c["fast"]} END AS f, CASE WHEN i >= {c["slow"]} THEN e{c["slow"]} END AS s,
        {c["stop"]}::DOUBLE AS stop_pct, 10000.0::DOUBLE AS cash0, 0.0::DOUBLE AS comm, 0.0::DOUBLE AS slip FROM b""" for g, c in enumerate(_TRIES)
    ]
    return f"""{BARS_1H}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM bars),
    e AS (SELECT symbol, i, {", ".join(f"close AS e{p}" for p in periods)} FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, {", ".join(f"e{p} + (close - e{p}) * 2 / {p + 1}" for p in periods)} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
    b AS (SELECT n.*, e.* EXCLUDE (symbol, i) FROM n JOIN e USING (symbol, i)), k AS ({" UNION ALL ".join(runs)})"""


@query(
    f"""WITH RECURSIVE {queries_more.kernel_sql(_ema_grid())}, {queries_more.measures_sql(1638.0, 'g, symbol, source, "interval"')}
    SELECT symbol, source, "interval", g AS combo, {r("total_return", "total_return")}, {r("sharpe", "sharpe", 5)}, {r("max_drawdown", "max_drawdown")}, trades, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, g)::INT AS rank FROM ms"""
)
def search_shared(spark, d):
    """Eight combinations on recursive indicators: one pass for all indicators, each rule and stop once."""
    found = search.grid_search(EMAS, B.event_bars(spark, d), _TRIES, 1638.0)
    return found.select("symbol", "source", "interval", "combo", F.round("total_return", 6).alias("total_return"), F.round("sharpe", 5).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"), "trades", "rank")


@query(SQL["profile_rolling"])
def profile_rolling_ranges(spark, d):
    names = ["rvp_poc_12", "rvp_vah_12", "rvp_val_12"]
    return out(range_profiles.add_rolling_profile(B.event_bars(spark, d), 12, SIZE), *names)


_FUNDING = """f AS (SELECT upper(event_type) AS symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(value) / 1e6 AS funding_rate, sum(value) AS open_interest, count(*) AS n FROM events GROUP BY 1, 2)"""


@query(
    f"""WITH {_FUNDING} SELECT symbol, ts, {r("CASE WHEN n % 2 = 0 THEN funding_rate * 3 ELSE funding_rate END", "funding_rate", 9)}, {r("open_interest", "open_interest", 4)},
    {r("CASE WHEN n % 2 = 0 THEN funding_rate * 3 ELSE funding_rate END * 1095", "funding_rate_annualised")} FROM f WHERE symbol = 'VIEW' AND ts >= '2024-01-05' AND ts < '2024-01-20'"""
)
def derivatives_upsert(spark, d):
    """Derivatives by symbol and time alone: a second load replaces some rows; the range is half open."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.upper("event_type").alias("symbol"), day.alias("ts")).agg((F.avg("value") / 1e6).alias("funding_rate"), F.sum("value").alias("open_interest"), F.count(F.lit(1)).alias("n"))
    changed = rows.where("n % 2 = 0").withColumn("funding_rate", F.col("funding_rate") * 3)
    found = B.with_annual_funding(B.derivatives_between(B.upsert(rows, changed, ("symbol", "ts")), "view", "2024-01-05", "2024-01-20"))
    return found.select("symbol", "ts", F.round("funding_rate", 9).alias("funding_rate"), F.round("open_interest", 4).alias("open_interest"), F.round("funding_rate_annualised", 6).alias("funding_rate_annualised"))
