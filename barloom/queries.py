"""Queries of the bar engine and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import price
from barloom.operators import asof, classify, rolling
from barloom.plans.registry import add_indicators
from barloom.schema import KEY
from barloom.sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ID = ["symbol", "source", "interval", "ts"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def out(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rounded(df.select(*ID, *columns), digits)


def raw_bars(unit: str, interval: str) -> str:
    return f"""SELECT upper(event_type) AS symbol, 'events' AS source, '{interval}' AS "interval", CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts,
      arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2, 3, 4"""


#: Added before rounding where exact ties occur, in both engines.
OFF_TIES = 3e-7
VALID = "high >= low AND open > 0 AND close > 0 AND volume >= 0"
BARS_1H = f"bars AS (SELECT * FROM ({raw_bars('hour', '1h')}) WHERE {VALID})"
BARS_1D = f"days AS (SELECT * FROM ({raw_bars('day', '1d')}) WHERE {VALID})"
IDS = 'symbol, source, "interval", ts'
W = "PARTITION BY symbol ORDER BY ts"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


def over(expr: str, n: int, least: int | None = None, x: str = "close") -> str:
    w = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least or n} THEN {expr} {w} END"


# ---------------------------------------------------------------- sources
@query(f"WITH {BARS_1H} SELECT {IDS}, open, high, low, close, volume FROM bars")
def bars_hourly(spark, d):
    return B.event_bars(spark, d)


@query(f"WITH {BARS_1D} SELECT {IDS}, open, high, low, close, volume FROM days")
def bars_daily(spark, d):
    return B.event_bars(spark, d, "1d")


@query(
    """SELECT o_orderpriority AS symbol, 'orders' AS source, '1w' AS "interval", CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts,
    arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume
    FROM orders GROUP BY 1, 4"""
)
def bars_weekly_orders(spark, d):
    return B.order_bars(spark, d)


@query(
    f"""SELECT *, CASE WHEN NOT high >= low THEN 'high_below_low' WHEN NOT open > 0 THEN 'open_not_positive' WHEN NOT close > 0 THEN 'close_not_positive' END AS reason
    FROM ({raw_bars("hour", "1h")}) WHERE NOT ({VALID})"""
)
def bars_rejected(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return B.rejected(B.ticks_to_bars(events, "event_type", "value", "ts", "hour", "1h", "events"))


@query(
    f"""WITH {BARS_1H}, n AS (SELECT * REPLACE (close * 2 AS close) FROM bars WHERE volume % 2 = 0)
    SELECT upper(symbol) AS symbol, source, "interval", ts, b.open, b.high, b.low, coalesce(n.close, b.close) AS close, b.volume FROM bars b LEFT JOIN n USING (symbol, source, "interval", ts)"""
)
def bars_upsert(spark, d):
    bars = B.event_bars(spark, d)
    return B.upsert(bars, bars.where("volume % 2 = 0").withColumn("close", F.col("close") * 2))


@query(f"WITH {BARS_1H} SELECT {IDS}, open, high, low, close, volume FROM bars WHERE symbol = (SELECT min(symbol) FROM bars) AND ts >= '2024-01-03' AND ts <= '2024-01-20 12:00:00'")
def bars_scan(spark, d):
    bars = B.event_bars(spark, d)
    least = bars.select(F.min("symbol").alias("_s"))
    return B.scan(bars, interval="1h", start="2024-01-03", end="2024-01-20 12:00:00").join(F.broadcast(least), F.col("symbol") == F.col("_s")).drop("_s")  # one row


@query(f"WITH {BARS_1H} SELECT {IDS}, open, high, low, close, volume FROM bars WHERE NOT (symbol = 'CLICK' AND ts < '2024-01-10')")
def bars_delete(spark, d):
    return B.delete(B.event_bars(spark, d), "click", "events", before="2024-01-10")


@query(f"WITH {BARS_1H} SELECT DISTINCT symbol FROM bars")
def bars_symbols(spark, d):
    return B.symbols(B.event_bars(spark, d), "events")


@query(f'WITH {BARS_1H} SELECT symbol, source, "interval", max(ts) AS ts, arg_max(open, ts) AS open, arg_max(high, ts) AS high, arg_max(low, ts) AS low, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM bars GROUP BY 1, 2, 3')
def bars_latest(spark, d):
    return B.latest(B.event_bars(spark, d))


_PAGED = f"p AS (SELECT *, row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY symbol) AS m FROM bars)"


@query(f"WITH {BARS_1H}, {_PAGED} SELECT {IDS}, close FROM p WHERE n > 50 AND n <= 100")
def bars_page(spark, d):
    return B.page(B.event_bars(spark, d), 2, 50).select(*ID, "close")


@query(f"WITH {BARS_1H}, {_PAGED} SELECT {IDS}, close FROM p WHERE n > (ceil(m / 50.0) - 1) * 50")
def bars_last_page(spark, d):
    return B.page(B.event_bars(spark, d), size=50).select(*ID, "close")


@query(f"WITH {BARS_1H}, {_PAGED} SELECT {IDS}, close FROM p WHERE n > m - 10")
def bars_tail(spark, d):
    return B.tail(B.event_bars(spark, d), 10).select(*ID, "close")


@query(f'WITH {BARS_1H} SELECT symbol, source, "interval", count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1, 2, 3')
def bars_metadata(spark, d):
    return B.metadata(B.event_bars(spark, d))


@query(f"""WITH {BARS_1H}, s AS (SELECT {over("avg(close)", 20)} AS sma_20, close FROM bars)
    SELECT 'close' AS "column", count(*) FILTER (close IS NULL) AS nulls FROM s UNION ALL SELECT 'sma_20', count(*) FILTER (sma_20 IS NULL) FROM s""")
def artifact_describe(spark, d):
    return B.describe(add_indicators(B.event_bars(spark, d), ["sma_20"]).select("close", "sma_20"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) LIKE '%12%' OR lower(p_brand) LIKE '%12%'")
def symbol_search(spark, d):
    return B.search(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand"), "12", ("p_name", "p_brand"))


@query(f"""WITH {BARS_1H} SELECT symbol, source, '1d' AS "interval", CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume
    FROM bars GROUP BY 1, 2, 4""")
def bars_resample(spark, d):
    return B.resample(B.event_bars(spark, d), "1d", "day")


# ---------------------------------------------------------------- one bar
_LN = {"hl": "ln(high / nullif(low, 0))", "co": "ln(close / open)", "hc": "ln(high / close)", "ho": "ln(high / open)", "lc": "ln(nullif(low, 0) / close)", "lo": "ln(nullif(low, 0) / open)"}


@query(
    f"""WITH {BARS_1H} SELECT {IDS}, {r("(high + low + close) / 3", "typical_price")}, {r("(open + high + low + close) / 4", "ohlc4")},
    {r("CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END", "proxy_ibs")}, {r("(close - low) / nullif(high - low, 0)", "ibs")},
    {r(f"coalesce(pow(CASE WHEN low > 0 THEN {_LN['hl']} END, 2) / (4 * ln(2)), 0)", "proxy_parkinson")},
    {r(f"coalesce(CASE WHEN low > 0 THEN 0.5 * pow({_LN['hl']}, 2) - (2 * ln(2) - 1) * pow({_LN['co']}, 2) END, 0)", "proxy_garman_klass")},
    {r(f"coalesce(CASE WHEN low > 0 THEN {_LN['hc']} * {_LN['ho']} + {_LN['lc']} * {_LN['lo']} END, 0)", "proxy_rogers_satchell")},
    {r("abs(close - open) / nullif(high - low, 0)", "body_pct")}, {r("(high - low) / close", "range_pct")}
    FROM bars"""
)
def price_columns(spark, d):
    names = ["typical_price", "ohlc4", "proxy_ibs", "ibs", "proxy_parkinson", "proxy_garman_klass", "proxy_rogers_satchell", "body_pct", "range_pct"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


_STEP = "CASE WHEN close < 10 THEN 1.0 WHEN close < 50 THEN 5.0 WHEN close < 100 THEN 10.0 WHEN close < 500 THEN 25.0 ELSE 50.0 END"


@query(
    f"""WITH {BARS_1H}, s AS (SELECT *, {_STEP} AS step, {over("avg(volume)", 20, x="volume")} AS av FROM bars)
    SELECT {IDS}, {r("round_even(close / step, 0) * step", "round_number")}, {r("abs(close - round_even(close / step, 0) * step)", "round_distance")},
    {r("CASE WHEN av > 0 THEN least(sqrt(100 / av) * 0.1, 0.05) ELSE 0.01 END", "slippage")}, {r("CASE WHEN av > 0 THEN volume / av ELSE 1.0 END", "rvol_scalar")} FROM s"""
)
def price_estimates(spark, d):
    df = B.event_bars(spark, d).withColumn("av", classify.full(F.avg, F.col("volume"), 20))
    df = df.withColumn("round_number", price.round_number(F.col("close"))).withColumns(
        {"round_distance": F.abs(F.col("close") - F.col("round_number")), "slippage": price.slippage(F.lit(100.0), F.col("av")), "rvol_scalar": price.relative_volume(F.col("volume"), F.col("av"))}
    )
    return out(df, "round_number", "round_distance", "slippage", "rvol_scalar")


# ---------------------------------------------------------------- finite windows
@query(
    f"""WITH {BARS_1H}, e AS (SELECT *, abs(close - lag(close) OVER ({W})) AS dc FROM bars)
    SELECT {IDS}, {", ".join(r(over("avg(close)", n), f"sma_{n}") for n in (10, 20, 30, 50, 200))},
    {r(over("avg(close)", 20) + " + 2 * " + over("stddev_pop(close)", 20), "bb_upper")}, {r(over("avg(close)", 20), "bb_middle")}, {r(over("avg(close)", 20) + " - 2 * " + over("stddev_pop(close)", 20), "bb_lower")},
    {r(over("max(high)", 20, 5, "high"), "swing_high_20")}, {r(over("min(low)", 20, 5, "low"), "swing_low_20")}, {r("volume / nullif(" + over("avg(volume)", 20, x="volume") + ", 0)", "rvol")},
    {r(f"abs(close - lag(close, 10) OVER ({W})) / nullif({over('sum(dc)', 10, x='dc')}, 0)", "ker")},
    {r(f"sum((high + low + close) / 3 * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0)", "vwap")} FROM e"""
)
def rolling_columns(spark, d):
    names = [*[f"sma_{n}" for n in (10, 20, 30, 50, 200)], "bb_upper", "bb_middle", "bb_lower", "swing_high_20", "swing_low_20", "rvol", "ker", "vwap"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


def _lagged(agg: str, n: int, k: int) -> str:
    w = f"OVER ({W} ROWS BETWEEN {n - 1 + k} PRECEDING AND {k} PRECEDING)"
    return f"CASE WHEN count(close) {w} >= {n} THEN {agg}(close) {w} END"


@query(
    f"""WITH {BARS_1H} SELECT {IDS}, {r(_lagged("max", 10, 1), "max_10")}, {r(_lagged("min", 10, 1), "min_10")}, {r(_lagged("avg", 5, 2), "mean_5")}, {r(_lagged("stddev_samp", 10, 0), "std_10")},
    lag(close, 3) OVER ({W}) AS shift_3 FROM bars"""
)
def rolling_features(spark, d):
    df = B.event_bars(spark, d).withColumns(
        {"max_10": rolling.rolling("max", "close", 10, 1), "min_10": rolling.rolling("min", "close", 10, 1), "mean_5": rolling.rolling("mean", "close", 5, 2), "std_10": rolling.rolling("std", "close", 10), "shift_3": classify.lag("close", 3)}
    )
    return out(df, "max_10", "min_10", "mean_5", "std_10", "shift_3")


@query(
    f"""WITH {BARS_1H}, p AS (SELECT *, lag(close) OVER ({W}) AS pc, low > 0 AS ok FROM bars),
    q AS (SELECT *, CASE WHEN ok THEN ln(open / pc) END AS o, CASE WHEN ok THEN {_LN['co']} END AS c, CASE WHEN ok THEN {_LN['hc']} * {_LN['ho']} + {_LN['lc']} * {_LN['lo']} END AS rs FROM p)
    SELECT {IDS}, {r(f"sqrt(greatest({over('var_samp(o)', 20, x='o')} + {0.34 / (1.34 + 21 / 19)} * {over('var_samp(c)', 20, x='c')} + {1 - 0.34 / (1.34 + 21 / 19)} * {over('avg(rs)', 20, x='rs')}, 0)) * sqrt(252)", "yang_zhang", 5)} FROM q"""
)
def yang_zhang(spark, d):
    return out(add_indicators(B.event_bars(spark, d), ["yang_zhang"]), "yang_zhang", digits=5)


# ---------------------------------------------------------------- recursive
_FOLDS = f"""WITH RECURSIVE {BARS_1H},
  n AS (SELECT *, row_number() OVER ({W}) AS i, coalesce(close - lag(close) OVER ({W}), 0) AS dc, coalesce(lag(close) OVER ({W}), close) AS pc,
          coalesce(high - lag(high) OVER ({W}), 0) AS uh, coalesce(lag(low) OVER ({W}) - low, 0) AS dl FROM bars),
  s AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN uh > dl AND uh > 0 THEN uh ELSE 0 END AS pdm, CASE WHEN dl > uh AND dl > 0 THEN dl ELSE 0 END AS mdm,
          abs(close - lag(close, 10) OVER ({W})) / nullif(sum(abs(dc)) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS er FROM n),
  f AS (
    SELECT symbol, i, close AS e12, close AS e26, greatest(dc, 0) AS g, greatest(-dc, 0) AS l, tr AS a, pdm AS p, mdm AS m, 0.0::DOUBLE AS sig, NULL::DOUBLE AS k FROM s WHERE i = 1
    UNION ALL
    SELECT s.symbol, s.i, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27, g + (greatest(dc, 0) - g) / 14, l + (greatest(-dc, 0) - l) / 14, a + (tr - a) / 14, p + (pdm - p) / 14, m + (mdm - m) / 14,
      sig + (((e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27)) - sig) * 2 / 10,
      CASE WHEN s.i < 10 THEN NULL WHEN s.i = 10 THEN close ELSE k + pow(coalesce(er, 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (close - k) END
    FROM f JOIN s ON s.symbol = f.symbol AND s.i = f.i + 1),
  x AS (SELECT s.symbol, s.source, s."interval", s.ts, s.i, f.*  EXCLUDE (symbol, i), coalesce(100 * p / nullif(a, 0), 0) AS pd, coalesce(100 * m / nullif(a, 0), 0) AS md FROM f JOIN s USING (symbol, i)),
  y AS (SELECT *, coalesce(100 * abs(pd - md) / nullif(pd + md, 0), 0) AS dx FROM x),
  z AS (SELECT symbol, i, dx AS adx FROM y WHERE i = 1 UNION ALL SELECT y.symbol, y.i, adx + (dx - adx) / 14 FROM z JOIN y ON y.symbol = z.symbol AND y.i = z.i + 1)
"""


@query(
    f"""{_FOLDS} SELECT {IDS}, {r("CASE WHEN i >= 12 THEN e12 END", "ema_12")}, {r("CASE WHEN i >= 26 THEN e26 END", "ema_26")}, {r("CASE WHEN i >= 14 THEN 100 * g / nullif(g + l, 0) END", "rsi_14", 4)},
    {r("CASE WHEN i >= 14 THEN a END", "atr")}, {r("CASE WHEN i >= 28 THEN adx END", "adx", 4)}, {r("CASE WHEN i >= 26 THEN e12 - e26 END", "macd")}, {r("CASE WHEN i >= 34 THEN sig END", "macd_signal")},
    {r("CASE WHEN i >= 34 THEN e12 - e26 - sig END", "macd_hist")}, {r("k", "kama")} FROM y JOIN z USING (symbol, i)"""
)
def recursive_columns(spark, d):
    names = ["ema_12", "ema_26", "rsi_14", "atr", "adx", "macd", "macd_signal", "macd_hist", "kama"]
    df = add_indicators(B.event_bars(spark, d), names)
    return df.select(*ID, *[F.round(n, 4 if n in ("rsi_14", "adx") else 6).alias(n) for n in names])


_ATR = f"""WITH RECURSIVE {BARS_1H}, n AS (SELECT *, row_number() OVER ({W}) AS i, coalesce(lag(close) OVER ({W}), close) AS pc FROM bars),
  s AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM n),
  f AS (SELECT symbol, i, tr AS a FROM s WHERE i = 1 UNION ALL SELECT s.symbol, s.i, a + (tr - a) / 14 FROM f JOIN s ON s.symbol = f.symbol AND s.i = f.i + 1),
  b AS (SELECT s.*, CASE WHEN f.i >= 14 THEN a END AS atr FROM s JOIN f USING (symbol, i))
"""


@query(
    f"""{_ATR} SELECT {IDS}, {r("open + 0.1 * coalesce(atr, 0)", "proxy_ib_high")}, {r("open - 0.1 * coalesce(atr, 0)", "proxy_ib_low")}, {r("0.8 * atr", "proxy_expected_move")},
    {r("atr / close * sqrt(252)", "proxy_iv", 5)}, {r("open + 0.1 * atr", "vol_buffer_high")}, {r("open - 0.1 * atr", "vol_buffer_low")} FROM b"""
)
def atr_columns(spark, d):
    names = ["proxy_ib_high", "proxy_ib_low", "proxy_expected_move", "proxy_iv", "vol_buffer_high", "vol_buffer_low"]
    return add_indicators(B.event_bars(spark, d), names).select(*ID, *[F.round(n, 5 if n == "proxy_iv" else 6).alias(n) for n in names])


# ---------------------------------------------------------------- sessions
@query(
    f"""WITH {BARS_1H}, p AS (SELECT *, CAST(ts AS DATE) AS day, (high + low + close) / 3 AS p FROM bars),
    q AS (SELECT *, sum(p * volume) OVER w / nullif(sum(volume) OVER w, 0) AS v, avg(p) OVER w AS mp, avg(p * p) OVER w AS mpp, count(*) OVER (PARTITION BY symbol, day) AS n FROM p WINDOW w AS (PARTITION BY symbol, day ORDER BY ts)),
    s AS (SELECT *, sqrt(greatest(mpp - 2 * v * mp + v * v, 0)) AS sd FROM q)
    SELECT {IDS}, {", ".join(r(f"CASE WHEN n = 1 THEN p ELSE v + {k} * sd END + {OFF_TIES}", name, 4) for name, k in (("vwap_session", 0), ("vwap_upper_1", 1), ("vwap_lower_1", -1), ("vwap_upper_2", 2), ("vwap_lower_2", -2)))} FROM s"""
)
def session_vwap(spark, d):
    names = ["vwap_session", "vwap_upper_1", "vwap_lower_1", "vwap_upper_2", "vwap_lower_2"]
    return out(add_indicators(B.event_bars(spark, d), names).withColumns({n: F.col(n) + OFF_TIES for n in names}), *names, digits=4)


@query(
    f"""WITH {BARS_1H}, q AS (SELECT *, first_value(high) OVER w AS h, first_value(low) OVER w AS l FROM bars WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts))
    SELECT {IDS}, {r("h", "ib_high")}, {r("l", "ib_low")}, {r("h - l", "ib_range")}, {r("(h + l) / 2", "ib_midpoint")} FROM q"""
)
def session_opening_range(spark, d):
    names = ["ib_high", "ib_low", "ib_range", "ib_midpoint"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


# ---------------------------------------------------------------- classifiers
_CLASS = f"""c AS (SELECT *, (close - low) / nullif(high - low, 0) AS ibs, volume / nullif({over("avg(volume)", 20, x="volume")}, 0) AS rvol, {over("avg(close)", 20)} AS s20, {over("avg(close)", 50)} AS s50, {over("avg(close)", 200)} AS s200,
    {over("avg(close)", 20)} + 2 * {over("stddev_pop(close)", 20)} AS bu, {over("max(high)", 20, 5, "high")} AS sh, {over("min(low)", 20, 5, "low")} AS sl FROM bars),
  l AS (SELECT *, CASE WHEN max(CASE WHEN bu IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) = 1 THEN coalesce(bu, sh) ELSE sh END AS lv,
    CASE WHEN max(CASE WHEN bu IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) = 1 THEN 'bb_upper' ELSE 'swing_high' END AS lt FROM c),
  k AS (SELECT *, CASE WHEN close < sl THEN 'DOWN' WHEN close > lv THEN 'UP' ELSE 'NONE' END AS sg FROM l)"""


@query(
    f"""WITH {BARS_1H}, {_CLASS} SELECT {IDS}, CASE WHEN close > s20 THEN 'ABOVE' WHEN close < s20 THEN 'BELOW' ELSE 'AT' END AS price_vs_sma20,
    CASE WHEN s20 > s50 AND s50 > s200 AND close > s20 THEN 'BULLISH' WHEN s20 < s50 AND s50 < s200 AND close < s20 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_direction,
    {r("lv", "breakout_level")}, lt AS breakout_level_type, sg AS breakout_signal, coalesce(abs(sh - bu) / nullif(sh, 0) <= 0.005, false) AS is_power_zone,
    CASE WHEN sg = 'UP' AND rvol > 1.5 AND ibs > 0.7 THEN 'HIGH' WHEN sg = 'UP' AND rvol > 1 AND ibs > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS breakout_quality FROM k"""
)
def classifiers(spark, d):
    names = ["price_vs_sma20", "trend_direction", "breakout_level", "breakout_level_type", "breakout_signal", "is_power_zone", "breakout_quality"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


@query(
    f"""WITH {BARS_1H}, {_CLASS} SELECT {IDS}, close, {r("s20", "sma_20")}, {r("rvol", "rvol")}, {r("ibs", "ibs")}, {r("sh", "swing_high_20")}, {r("sl", "swing_low_20")}, sg AS breakout_signal FROM k"""
)
def breakout_screen(spark, d):
    """The flagship: hourly bars, trend, volume, place in the range, swings and the breakout signal."""
    names = ["sma_20", "rvol", "ibs", "swing_high_20", "swing_low_20", "breakout_signal"]
    return out(add_indicators(B.event_bars(spark, d), names), "close", *names)


# ---------------------------------------------------------------- joins
@query(
    f"""WITH {BARS_1H}, {BARS_1D}, s AS (SELECT symbol, ts + INTERVAL 1 DAY AS at, {over("avg(close)", 5)} AS sma_5 FROM days), g AS (SELECT * FROM s WHERE sma_5 IS NOT NULL)
    SELECT b.symbol, b.source, b."interval", b.ts, b.close, {r("g.sma_5", "sma_5_1d")} FROM bars b ASOF LEFT JOIN g ON b.symbol = g.symbol AND b.ts >= g.at"""
)
def asof_daily(spark, d):
    days = B.event_bars(spark, d, "1d").withColumn("sma_5", rolling.sma(5))
    return out(asof.asof_join(B.event_bars(spark, d), days, "1d"), "close", "sma_5_1d")


@query(
    f"""WITH {BARS_1H}, {BARS_1D}, g AS (SELECT symbol, ts + INTERVAL 1 DAY AS at, close AS hi FROM days), wk AS (SELECT * FROM ({raw_bars("week", "1w")}) WHERE {VALID}), h AS (SELECT symbol, ts + INTERVAL 7 DAY AS at, close AS wc FROM wk)
    SELECT b.symbol, b.source, b."interval", b.ts, g.hi AS level_1d, h.wc AS level_1w FROM bars b ASOF LEFT JOIN g ON b.symbol = g.symbol AND b.ts >= g.at ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.at"""
)
def asof_chain(spark, d):
    level = lambda interval: B.event_bars(spark, d, interval).withColumn("level", F.col("close"))
    return asof.asof_chain(B.event_bars(spark, d), [(level("1d"), "1d"), (level("1w"), "1w")]).select(*ID, "level_1d", "level_1w")


@query(
    f"""WITH {BARS_1H}, t AS (SELECT DISTINCT ts FROM bars), s AS (SELECT DISTINCT symbol FROM bars)
    SELECT t.ts, s.symbol, coalesce(b.close, 0) AS close FROM t CROSS JOIN s ASOF LEFT JOIN bars b ON b.symbol = s.symbol AND t.ts >= b.ts"""
)
def outer_fill(spark, d):
    return asof.spine_fill(B.event_bars(spark, d), "close").select("ts", "symbol", "close")


from barloom import queries_more  # noqa: E402, F401  (registers the other queries)

__all__ = ["KEY", "QUERIES", "SQL"]
