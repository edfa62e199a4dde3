"""Queries over profiles, auction states, rules, runs, metrics and searches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.operators import backtest, classify, metrics, portfolio, search
from barloom.plans import formula, strategy
from barloom.plans.registry import add_indicators
from barloom.queries import _ATR, BARS_1D, BARS_1H, ID, IDS, W, out, over, query, r, rounded
from barloom.sources import bars as B

_SIGMA = repr(2 * math.sqrt(math.log(2)))


def profile_sql(rows: str, keys: str, time: bool = False) -> str:
    """CTEs that end in ``prof (keys, poc, vah, val, total, arr)`` from rows of bars with keys."""
    if time:
        weight = "CASE WHEN ctr + size / 2 >= low AND ctr - size / 2 <= high THEN 2.0 ELSE 0.0 END"
        units = "2.0"
    else:
        weight = "CASE WHEN sigma > 0 THEN CASE WHEN sp > 0 THEN pdf / sp * volume ELSE 0 END WHEN rn = 1 THEN volume ELSE 0 END"
        units = "volume"
    on = " AND ".join(f"a.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    return f"""
g0 AS (SELECT *, max(high) OVER k AS hi, min(low) OVER k AS lo FROM {rows} WINDOW k AS (PARTITION BY {keys})),
g1 AS (SELECT *, lo - (hi - lo) * 0.02 AS pmin, ((hi + (hi - lo) * 0.02) - (lo - (hi - lo) * 0.02)) / 100 AS size, (high + low + close) / 3 AS tp,
  CASE WHEN low > 0 AND high > low THEN ln(high / low) / {_SIGMA} ELSE 0 END AS sigma FROM g0),
g2 AS (SELECT g1.*, i, pmin + size / 2 + i * size AS ctr FROM g1, range(100) t(i)),
g3 AS (SELECT *, CASE WHEN sigma > 0 THEN exp(-0.5 * ((ctr - tp) / sigma) * ((ctr - tp) / sigma)) * CASE WHEN ctr + size / 2 < low OR ctr - size / 2 > high THEN 0.1 ELSE 1.0 END END AS pdf, round(abs(ctr - tp), 9) AS dist FROM g2),
g4 AS (SELECT *, sum(pdf) OVER (PARTITION BY {keys}, ts) AS sp, row_number() OVER (PARTITION BY {keys}, ts ORDER BY dist, i) AS rn FROM g3),
g5 AS (SELECT {keys}, i, round(sum({weight}), 8) AS x FROM g4 GROUP BY {keys}, i),
g6 AS (SELECT {keys}, list(x ORDER BY i) AS arr FROM g5 GROUP BY {keys}),
g7 AS (SELECT {keys}, max(hi) AS hi, min(lo) AS lo, max(pmin) AS pmin, max(size) AS size, sum({units}) AS total, arg_max(close, ts) AS lastc FROM g1 GROUP BY {keys}),
g8 AS (SELECT a.*, t.* EXCLUDE ({keys}), list_position(arr, list_max(arr)) - 1 AS p FROM g6 a JOIN g7 t ON {on}),
va AS (SELECT {keys}, arr, total, p AS l, p AS h, arr[p + 1] AS s, 0 AS n FROM g8
  UNION ALL SELECT {keys}, arr, total, CASE WHEN down THEN l - 1 ELSE l END, CASE WHEN down THEN h ELSE h + 1 END, s + CASE WHEN down THEN below ELSE above END, n + 1
  FROM (SELECT *, (below > above OR h = 99) AS down FROM (SELECT *, CASE WHEN l > 0 THEN arr[l] ELSE -1 END AS below, CASE WHEN h < 99 THEN arr[h + 2] ELSE -1 END AS above FROM va WHERE s < total * 0.68 AND (l > 0 OR h < 99)))),
vb AS (SELECT {keys}, arg_max(l, n) AS l, arg_max(h, n) AS h FROM va GROUP BY {keys}),
prof AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, arr, CASE WHEN hi <= lo THEN 0 ELSE total END AS total,
  CASE WHEN hi <= lo THEN hi WHEN total <= 0 THEN lastc ELSE pmin + size / 2 + p * size END AS poc,
  CASE WHEN hi <= lo OR total <= 0 THEN hi ELSE pmin + size / 2 + h * size + size / 2 END AS vah,
  CASE WHEN hi <= lo OR total <= 0 THEN lo ELSE pmin + size / 2 + l * size - size / 2 END AS val, hi > lo AND total > 0 AS has FROM g8 a JOIN vb t ON {on})"""


_SESS = f"{BARS_1H}, s AS (SELECT *, CAST(ts AS DATE) AS day FROM bars)"


def _three(prefix: str, suffix: str = "", source: str = "prof") -> str:
    return ", ".join(r(f"{source}.{c}", f"{prefix}_{c}{suffix}") for c in ("poc", "vah", "val"))


@query(f"WITH RECURSIVE {_SESS}, {profile_sql('s', 'symbol, day')} SELECT s.symbol, s.source, s.\"interval\", s.ts, {_three('vp')} FROM s JOIN prof ON prof.symbol = s.symbol AND prof.day = s.day")
def profile_session(spark, d):
    names = ["vp_poc", "vp_vah", "vp_val"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


@query(f"WITH RECURSIVE {_SESS}, {profile_sql('s', 'symbol, day', True)} SELECT s.symbol, s.source, s.\"interval\", s.ts, {_three('mp')} FROM s JOIN prof ON prof.symbol = s.symbol AND prof.day = s.day")
def profile_time(spark, d):
    names = ["mp_poc", "mp_vah", "mp_val"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


@query(
    f"""WITH RECURSIVE {_SESS}, {profile_sql("s", "symbol, day")}, m AS (SELECT symbol, day, {", ".join(f"CASE WHEN count(*) OVER w >= 5 THEN quantile_cont({c}, 0.5) OVER w END AS {c}" for c in ("poc", "vah", "val"))} FROM prof
    WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT s.symbol, s.source, s."interval", s.ts, {_three("vp", "_5d", "m")} FROM s JOIN m ON m.symbol = s.symbol AND m.day = s.day"""
)
def profile_median(spark, d):
    names = ["vp_poc_5d", "vp_vah_5d", "vp_val_5d"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


@query(
    f"""WITH RECURSIVE {_SESS}, ds AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM (SELECT DISTINCT symbol, day FROM s)),
    e AS (SELECT s.* EXCLUDE (day), t.n AS target FROM s JOIN ds ON ds.symbol = s.symbol AND ds.day = s.day JOIN ds t ON t.symbol = ds.symbol AND t.n >= 5 AND ds.n BETWEEN t.n - 4 AND t.n),
    {profile_sql("e", "symbol, target")}
    SELECT s.symbol, s.source, s."interval", s.ts, {_three("cvp", "_5d")} FROM s JOIN ds ON ds.symbol = s.symbol AND ds.day = s.day LEFT JOIN prof ON prof.symbol = s.symbol AND prof.target = ds.n"""
)
def profile_composite(spark, d):
    names = ["cvp_poc_5d", "cvp_vah_5d", "cvp_val_5d"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


@query(
    f"""WITH RECURSIVE {BARS_1H}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM bars), e AS (SELECT b.* EXCLUDE (i), a.i AS target FROM n a JOIN n b ON a.symbol = b.symbol AND a.i >= 12 AND b.i BETWEEN a.i - 11 AND a.i),
    {profile_sql("e", "symbol, target")}
    SELECT n.symbol, n.source, n."interval", n.ts, {_three("rvp", "_12")} FROM n LEFT JOIN prof ON prof.symbol = n.symbol AND prof.target = n.i"""
)
def profile_rolling(spark, d):
    names = ["rvp_poc_12", "rvp_vah_12", "rvp_val_12"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


_SHAPE = """sv AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(volume)::DOUBLE AS v FROM bars GROUP BY 1, 2),
sh0 AS (SELECT p.symbol, p.day, p.poc, p.vah, p.val, p.total, p.has, list_filter(p.arr, lambda x: x > 0) AS a, avg(v) OVER (PARTITION BY p.symbol ORDER BY p.day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mv, count(*) OVER (PARTITION BY p.symbol) AS ns
  FROM prof p JOIN sv ON sv.symbol = p.symbol AND sv.day = p.day),
sh1 AS (SELECT *, list_position(a, list_max(a)) - 1 AS t, len(a) AS n FROM sh0),
sh AS (SELECT symbol, day, poc, vah, val, CASE WHEN NOT has OR ns < 5 OR n < 10 OR coalesce(mv > 0 AND total < mv * 0.5, false) THEN 'NEUTRAL'
  WHEN len(list_filter(range(n), lambda i: i <> t AND abs(i - t) >= floor(n * 0.15) AND a[i + 1] > a[t + 1] * 0.5)) > 0 THEN 'B_SHAPE' WHEN t / (n - 1) < 0.3 THEN 'P_SHAPE' WHEN t / (n - 1) > 0.7 THEN 'D_SHAPE' ELSE 'NORMAL' END AS shape FROM sh1)"""


@query(f"WITH RECURSIVE {_SESS}, {profile_sql('s', 'symbol, day')}, {_SHAPE} SELECT s.symbol, s.source, s.\"interval\", s.ts, shape AS profile_shape, " + ", ".join(f"shape = '{v}' AS {k}" for k, v in classify.SHAPE_FLAGS.items()) + " FROM s JOIN sh ON sh.symbol = s.symbol AND sh.day = s.day")
def profile_shapes(spark, d):
    names = ["profile_shape", *classify.SHAPE_FLAGS]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


_SLOPES = "pd AS (SELECT symbol, day, poc, lag(poc) OVER w AS p1, lag(poc, 5) OVER w AS p5, lag(poc, 20) OVER w AS p20 FROM prof WINDOW w AS (PARTITION BY symbol ORDER BY day))"


@query(
    f"""WITH RECURSIVE {_SESS}, {profile_sql("s", "symbol, day")}, {_SLOPES} SELECT s.symbol, s.source, s."interval", s.ts, {r("coalesce((poc - p5) / nullif(p5, 0) * 100, 0)", "poc_slope_5")}, {r("coalesce((poc - p20) / nullif(p20, 0) * 100, 0)", "poc_slope_20")},
    CASE WHEN poc > p1 THEN 'HIGHER' WHEN poc < p1 THEN 'LOWER' ELSE 'STABLE' END AS value_area_migration FROM s JOIN pd ON pd.symbol = s.symbol AND pd.day = s.day"""
)
def profile_slopes(spark, d):
    names = ["poc_slope_5", "poc_slope_20", "value_area_migration"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


_AUCTION = f"""{_ATR}, sx AS (SELECT *, CAST(ts AS DATE) AS day FROM bars), {profile_sql("sx", "symbol, day")},
q0 AS (SELECT b.symbol, b.source, b."interval", b.ts, b.high, b.low, b.close, b.volume, b.atr, prof.poc, prof.vah, prof.val, (b.close - b.low) / nullif(b.high - b.low, 0) AS ibs, CAST(b.ts AS DATE) AS day FROM b JOIN prof ON prof.symbol = b.symbol AND prof.day = CAST(b.ts AS DATE)),
q AS (SELECT *, close >= val AND close <= vah AS ins, close > vah AS abv, close < val AS bel, abs(close - poc) <= (vah - val) * 0.02 AS atp, abs(close - vah) <= (vah - val) * 0.1 AS nvh, abs(close - val) <= (vah - val) * 0.1 AS nvl,
  lag(close) OVER ({W}) AS pc, lag(vah) OVER ({W}) AS pvh, lag(val) OVER ({W}) AS pvl, close - lag(close, 5) OVER ({W}) AS d5, volume / nullif({over("avg(volume)", 20, x="volume")}, 0) AS rvol,
  CASE WHEN vah > 0 THEN (vah - val) / vah * 100 ELSE 0 END AS wid FROM q0),
u AS (SELECT *, CASE WHEN ins AND coalesce(vah - val > atr * 1.5, false) AND d5 < 0 THEN 'IMBALANCED_DOWN' WHEN ins AND coalesce(vah - val > atr * 1.5, false) AND d5 > 0 THEN 'IMBALANCED_UP' WHEN bel THEN 'IMBALANCED_DOWN' WHEN abv THEN 'IMBALANCED_UP' ELSE 'BALANCED' END AS bal,
  coalesce(sign(close - pc) = sign(poc - pc) AND abs(close - pc) > atr * 0.5, false) AS tow, close - pc AS dc, nvh OR nvl AS edge FROM q)"""


@query(
    f"""{_AUCTION} SELECT {IDS}, ins AS inside_value, abv AS above_value, bel AS below_value, atp AS at_poc, nvh AS near_vah, nvl AS near_val, {r("CASE WHEN vah > 0 THEN (vah - close) / vah * 100 ELSE 0 END", "distance_to_vah_pct", 5)},
    {r("CASE WHEN close > 0 THEN (close - val) / close * 100 ELSE 0 END", "distance_to_val_pct", 5)}, {r("wid", "value_area_width_pct", 5)}, bal AS balance_status FROM u"""
)
def auction_states(spark, d):
    names = ["inside_value", "above_value", "below_value", "at_poc", "near_vah", "near_val", "distance_to_vah_pct", "distance_to_val_pct", "value_area_width_pct", "balance_status"]
    return out(add_indicators(B.event_bars(spark, d), names), *names, digits=5)


@query(
    f"""{_AUCTION} SELECT {IDS}, coalesce(pc > pvh OR pc < pvl, false) AND ins AS acceptance_into_value, coalesce(nvh AND ibs < 0.3, false) OR coalesce(nvl AND ibs > 0.7, false) AS rejection_from_edge,
    coalesce(lag(ins) OVER ({W}), false) AND (abv OR bel) AS acceptance_outside_value,
    atp AND coalesce(lag(tow) OVER ({W}), false) AND CASE WHEN coalesce(lag(dc) OVER ({W}) > 0, false) THEN coalesce(ibs < 0.3, false) ELSE coalesce(ibs > 0.7, false) END AS poc_rejection,
    edge AND coalesce(lag(edge) OVER ({W}), false) AND coalesce(rvol > 1, false) AS edge_volume_building FROM u"""
)
def auction_rules(spark, d):
    names = ["acceptance_into_value", "rejection_from_edge", "acceptance_outside_value", "poc_rejection", "edge_volume_building"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


_BACK20 = f"OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(
    f"""{_AUCTION}, k AS (SELECT *, list(wid) {_BACK20} AS ws, quantile_cont(wid, 0.2) {_BACK20} AS p20, row_number() OVER ({W}) AS i FROM u),
    k2 AS (SELECT *, i > 20 AND coalesce(len(list_filter(ws, lambda x: x < wid)) / 20.0 * 100 < 20, false) AND (ins OR atp) AS coiled FROM k)
    SELECT {IDS}, coiled AS is_coiled, {r("CASE WHEN coiled AND p20 > 0 THEN greatest(0, least(100, (1 - wid / nullif(p20, 0)) * 100)) ELSE 0 END", "coil_intensity", 4)} FROM k2"""
)
def coils(spark, d):
    return out(add_indicators(B.event_bars(spark, d), ["is_coiled", "coil_intensity"]), "is_coiled", "coil_intensity", digits=4)


@query(
    f"""{_AUCTION}, {_SHAPE}, {_SLOPES}, k AS (SELECT u.*, sh.shape, coalesce((pd.poc - p20) / nullif(p20, 0) * 100, 0) AS sl FROM u JOIN sh ON sh.symbol = u.symbol AND sh.day = u.day JOIN pd ON pd.symbol = u.symbol AND pd.day = u.day),
    k2 AS (SELECT *, wid - lag(wid, 5) OVER ({W}) AS dw, {over("avg(wid)", 20, 5, "wid")} AS mw FROM k),
    k3 AS (SELECT *, CASE WHEN abs(sl) < 1 AND dw > 0 AND wid > mw AND rvol > 1 AND shape IN ('D_SHAPE', 'NORMAL') THEN 'DISTRIBUTION' WHEN abs(sl) < 0.2 AND dw < 0 AND bal = 'BALANCED' AND shape IN ('NORMAL', 'B_SHAPE') AND rvol < 1 THEN 'ACCUMULATION'
      WHEN sl < -0.5 AND bal = 'IMBALANCED_DOWN' THEN 'MARKDOWN' WHEN sl > 0.5 AND bal = 'IMBALANCED_UP' THEN 'MARKUP' ELSE 'NEUTRAL' END AS ph FROM k2)
    SELECT {IDS}, ph AS wyckoff_phase, {", ".join(f"ph = '{v}' AS {k}" for k, v in classify.PHASE_FLAGS.items())} FROM k3"""
)
def wyckoff_phases(spark, d):
    names = ["wyckoff_phase", *classify.PHASE_FLAGS]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


from barloom.queries import _CLASS, _FOLDS  # noqa: E402

_SIGNALS = f"""{_FOLDS}, {_CLASS},
o AS (SELECT k.*, CASE WHEN z.i >= 28 THEN adx END AS adx, CASE WHEN z.i >= 14 THEN a END AS atr, CASE WHEN z.i >= 14 THEN 100 * g / nullif(g + y.l, 0) END AS rsi, {over("avg(k.close)", 20, x="k.close").replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY k.symbol ORDER BY k.ts")} - 2 * {over("stddev_pop(k.close)", 20, x="k.close").replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY k.symbol ORDER BY k.ts")} AS bl
  FROM k JOIN y ON y.symbol = k.symbol AND y.ts = k.ts JOIN z ON z.symbol = y.symbol AND z.i = y.i),
o2 AS (SELECT *, CASE WHEN s20 > s50 AND s50 > s200 AND close > s20 THEN 'BULLISH' WHEN s20 < s50 AND s50 < s200 AND close < s20 THEN 'BEARISH' ELSE 'NEUTRAL' END AS dir, coalesce(abs(sh - bu) / nullif(sh, 0) <= 0.005, false) AS pz,
  CASE WHEN rsi < 20 THEN 'EXTREME_OVERSOLD' WHEN rsi < 30 THEN 'OVERSOLD' WHEN rsi <= 70 THEN 'NEUTRAL' WHEN rsi <= 80 THEN 'OVERBOUGHT' ELSE 'EXTREME_OVERBOUGHT' END AS zone FROM o)"""


@query(
    f"""{_SIGNALS} SELECT {IDS}, zone AS rsi_zone, CASE WHEN adx < 15 THEN 20 WHEN adx < 20 THEN 35 WHEN adx < 25 THEN 50 WHEN adx < 35 THEN 70 WHEN adx < 50 THEN 85 ELSE 95 END::INT AS adx_conviction,
    zone = 'EXTREME_OVERSOLD' AS is_extreme_oversold, zone = 'EXTREME_OVERBOUGHT' AS is_extreme_overbought, zone IN ('EXTREME_OVERSOLD', 'EXTREME_OVERBOUGHT') AS is_overextended, coalesce(adx < 20, false) AS is_weak_trend, coalesce(rvol < 0.5, false) AS is_low_volume,
    coalesce((bu - bl) / nullif(close, 0) < 0.03 AND adx < 20, false) AS is_squeeze, coalesce(abs(close - sh) < atr * 0.5 AND atr > 0 AND sh > 0, false) AS near_resistance, coalesce(abs(close - sl) < atr * 0.5 AND atr > 0 AND sl > 0, false) AS near_support,
    (35 + CASE WHEN adx > 25 AND dir <> 'NEUTRAL' THEN 10 ELSE 0 END + CASE WHEN rvol >= 3 THEN 12 WHEN rvol >= 2 THEN 8 WHEN rvol >= 1.5 THEN 5 ELSE 0 END + CASE WHEN pz THEN 4 ELSE 0 END - CASE WHEN rsi > 80 OR (rsi < 20 AND rsi <> 0) THEN 4 ELSE 0 END)::DOUBLE AS confidence_score,
    CASE WHEN adx > 25 THEN 'STRONG' WHEN adx < 20 THEN 'WEAK' ELSE 'MODERATE' END AS trend_strength, CASE WHEN coalesce(adx < 20, false) OR dir = 'NEUTRAL' THEN 'RANGING' WHEN adx > 25 THEN 'TRENDING' ELSE 'TRANSITION' END AS trend_status FROM o2"""
)
def signals(spark, d):
    names = ["rsi_zone", "adx_conviction", "is_extreme_oversold", "is_extreme_overbought", "is_overextended", "is_weak_trend", "is_low_volume", "is_squeeze", "near_resistance", "near_support", "confidence_score", "trend_strength", "trend_status"]
    return out(add_indicators(B.event_bars(spark, d), names), *names)


# ---------------------------------------------------------------- rules
CROSSING = {
    "schema_version": "2.0", "name": "crossing", "parameters": {"fast": {"type": "int", "default": 10, "minimum": 2, "maximum": 50}, "slow": {"type": "int", "default": 30, "minimum": 5, "maximum": 200}, "stop": {"type": "float", "default": 0.2, "minimum": 0.01, "maximum": 0.9}},
    "indicators": [{"name": "fast_sma", "type": "sma", "period": "{{ fast }}"}, {"name": "slow_sma", "type": "sma", "period": "{{ slow }}"}],
    "features": [{"name": "up", "type": "formula", "expr": {"op": ">", "left": "close", "right": "open"}}, {"name": "body", "type": "body_pct"}, {"name": "gap", "type": "formula", "expr": {"op": "/", "left": {"op": "-", "left": "fast_sma", "right": "slow_sma"}, "right": "slow_sma"}}],
    "sides": {
        "long": {"entry": {"condition": {"left": "fast_sma", "operator": "crosses_above", "right": "slow_sma"}}, "exit": {"condition": {"left": "fast_sma", "operator": "crosses_below", "right": "slow_sma"}}},
        "short": {"entry": {"condition": {"all": [{"left": "gap", "operator": "<", "right": -0.1}, {"not": {"left": "up", "operator": "is_true"}}, {"left": "body", "operator": "between", "right": [0.2, 1.0]}]}}, "exit": {"condition": {"any": [{"left": "gap", "operator": ">=", "right": 0}, {"left": "slow_sma", "operator": "missing"}]}}},
    },
    "risk": {"stop_loss": {"type": "fixed_pct", "pct": "{{ stop }}"}, "take_profit": {"type": "risk_reward", "ratio": 2.0}},
}
_MA = f"m0 AS (SELECT *, {over('avg(close)', 10)} AS f, {over('avg(close)', 30)} AS s FROM bars), m AS (SELECT *, (f - s) / nullif(s, 0) AS gap, coalesce(close > open, false) AS up, abs(close - open) / nullif(high - low, 0) AS body, lag(f) OVER ({W}) AS pf, lag(s) OVER ({W}) AS ps FROM m0)"


@query(
    f"""WITH {BARS_1H}, {_MA} SELECT {IDS}, coalesce(pf <= ps AND f > s, false) AS long_entry, coalesce(pf >= ps AND f < s, false) AS long_exit,
    coalesce(gap < -0.1, false) AND NOT up AND coalesce(body >= 0.2 AND body <= 1, false) AS short_entry, coalesce(gap >= 0, false) OR s IS NULL AS short_exit FROM m"""
)
def rule_screen(spark, d):
    s = strategy.parse(CROSSING)
    return strategy.screen(s, strategy.prepare(s, B.event_bars(spark, d))).select(*ID, "long_entry", "long_exit", "short_entry", "short_exit")


@query(
    f"""WITH {BARS_1H} SELECT {IDS}, {r("(close - open) / nullif(high - low, 0)", "share")}, NOT coalesce(close > open, false) AS not_up, coalesce(close <> volume, true) AS differs, {r("abs(open - close)", "move")},
    (coalesce(close > open, false) OR volume > 3) AND low < 100 AS mixed FROM bars"""
)
def formulas(spark, d):
    df = B.event_bars(spark, d)
    types = strategy.types_of(df)
    up = {"op": ">", "left": "close", "right": "open"}
    made = {
        "share": {"op": "/", "left": {"op": "-", "left": "close", "right": "open"}, "right": {"op": "-", "left": "high", "right": "low"}}, "not_up": {"op": "not", "operand": up}, "differs": {"op": "!=", "left": "close", "right": "volume"},
        "move": {"op": "abs", "operand": {"op": "-", "left": "open", "right": "close"}}, "mixed": {"op": "and", "children": [{"op": "or", "children": [up, {"op": ">", "left": "volume", "right": 3}]}, {"op": "<", "left": "low", "right": 100}]},
    }
    return out(df.withColumns({k: formula.formula(v, types)[0] for k, v in made.items()}), *made)


@query(
    f"""WITH {BARS_1H}, {_MA} SELECT symbol, source, "interval", count(*) AS bars, CASE WHEN count(*) FILTER (least(open, high, low, close) <= 0) > 0 THEN 'not_positive' WHEN count(*) FILTER (high < greatest(open, low, close) OR low > least(open, high, close)) > 0 THEN 'high_low_not_enclosing' END AS fault,
    min(i) FILTER (ready) - 1 AS warm_up_bars, count(*) - min(i) FILTER (ready) + 1 - count(*) FILTER (ready) AS gaps_after
    FROM (SELECT *, row_number() OVER ({W}) AS i, f IS NOT NULL AND s IS NOT NULL AND body IS NOT NULL AS ready FROM m) GROUP BY 1, 2, 3"""
)
def frame_validation(spark, d):
    s = strategy.parse(CROSSING)
    df = strategy.prepare(s, B.event_bars(spark, d))
    return backtest.validate(df, ["fast_sma", "slow_sma", "body"])


# ---------------------------------------------------------------- runs
def sig(expr: str, name: str) -> str:
    """Seven significant digits, for values of any size."""
    return f"printf('%.6e', ({expr})::DOUBLE)::DOUBLE AS {name}"


def significant(df, *columns):
    return df.withColumns({c: F.format_string("%.6e", F.col(c)).cast("double") for c in columns})


def kernel_sql(source: str) -> str:
    """CTEs that end in ``bt``, a row a bar of each run of CROSSING: cash, position and the trade that ended there.

    ``source`` gives ``k (g, symbol, source, interval, ts, open, high, low, close, f, s, stop_pct, cash0, comm, slip)``,
    bars of run ``g`` with both means. A recursion walks over the bars: the exit and then the entry that are
    pending fill at the open, the position may end inside the bar, rules are looked at at the close."""
    return f"""{source},
k1 AS (SELECT *, row_number() OVER (PARTITION BY g, symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY g, symbol) AS n,
  coalesce((f - s) / nullif(s, 0) < -0.1 AND NOT coalesce(close > open, false) AND abs(close - open) / nullif(high - low, 0) BETWEEN 0.2 AND 1.0, false) AS down, coalesce((f - s) / nullif(s, 0) >= 0, false) AS done,
  round(close * (1 - stop_pct), 2) AS stop_l, round(close + abs(close - close * (1 - stop_pct)) * 2.0, 2) AS target_l, round(close * (1 + stop_pct), 2) AS stop_s, round(close - abs(close - close * (1 + stop_pct)) * 2.0, 2) AS target_s
  FROM (SELECT *, min(CASE WHEN f IS NOT NULL AND s IS NOT NULL AND high > low THEN ts END) OVER (PARTITION BY g, symbol) AS ready FROM k) WHERE ts >= ready),
bt AS (
  SELECT g, symbol, 0::BIGINT AS i, any_value(cash0)::DOUBLE AS cash, 0::DOUBLE AS size, 0::DOUBLE AS price, NULL::TIMESTAMP AS since, 0::DOUBLE AS stop, 0::DOUBLE AS target, 0::DOUBLE AS fee, 0::BIGINT AS held,
    false AS leave, 0 AS ent, 0::DOUBLE AS ps, 0::DOUBLE AS pt, NULL::DOUBLE AS ax, NULL::DOUBLE AS ay, NULL::DOUBLE AS bx, NULL::DOUBLE AS bz,
    NULL::DOUBLE AS t_exit, NULL::DOUBLE AS t_entry, NULL::TIMESTAMP AS t_since, NULL::DOUBLE AS t_size, NULL::DOUBLE AS t_fee, NULL::DOUBLE AS t_fee2, NULL::BIGINT AS t_held, NULL::VARCHAR AS t_why
  FROM k1 GROUP BY g, symbol
  UNION ALL
  SELECT g, symbol, i, CASE WHEN ends THEN cash3 + (sg * abs(size3) * px5 - abs(size3) * px5 * comm) ELSE cash3 END, CASE WHEN ends THEN 0 ELSE size3 END, price2, since2, stop2, target2, fee2, held3,
    CASE WHEN size3 > 0 THEN coalesce(bx >= bz AND f < s, false) WHEN size3 < 0 THEN done ELSE false END,
    CASE WHEN size3 <> 0 THEN 0 WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END, CASE WHEN up THEN stop_l ELSE stop_s END, CASE WHEN up THEN target_l ELSE target_s END,
    CASE WHEN size3 = 0 THEN f ELSE ax END, CASE WHEN size3 = 0 THEN s ELSE ay END, CASE WHEN size3 > 0 THEN f ELSE bx END, CASE WHEN size3 > 0 THEN s ELSE bz END,
    CASE WHEN c1 THEN px1 WHEN hit IS NOT NULL THEN px3 WHEN ends THEN px5 END, CASE WHEN c1 THEN price ELSE price2 END, CASE WHEN c1 THEN since ELSE since2 END, CASE WHEN c1 THEN size ELSE size2 END, CASE WHEN c1 THEN fee ELSE fee2 END,
    CASE WHEN c1 THEN fee1 WHEN hit IS NOT NULL THEN fee3 WHEN ends THEN abs(size3) * px5 * comm END, CASE WHEN c1 THEN held ELSE held3 END, CASE WHEN c1 THEN 'signal' WHEN hit IS NOT NULL THEN why WHEN ends THEN 'end_of_backtest' END
  FROM (SELECT *, bi = n AND size3 <> 0 AS ends, close * (1 - sg * slip) AS px5, size3 = 0 AND coalesce(ax <= ay AND f > s, false) AS up
  FROM (SELECT *, CASE WHEN hit IS NULL THEN cash2 ELSE cash2 + (sg * abs(size2) * px3 - fee3) END AS cash3, CASE WHEN hit IS NULL THEN size2 ELSE 0 END AS size3
  FROM (SELECT *, hit * (1 - sg * slip) AS px3, abs(size2) * (hit * (1 - sg * slip)) * comm AS fee3
  FROM (SELECT *, CASE WHEN size2 = 0 THEN NULL WHEN stop2 > 0 AND sg * (open - stop2) <= 0 THEN open WHEN target2 > 0 AND sg * (open - target2) >= 0 THEN open
      WHEN stop2 > 0 AND sg * (worst - stop2) <= 0 THEN stop2 WHEN target2 > 0 AND sg * (best - target2) >= 0 THEN target2 END AS hit,
    CASE WHEN stop2 > 0 AND sg * (open - stop2) <= 0 THEN 'stop_loss_gap' WHEN target2 > 0 AND sg * (open - target2) >= 0 THEN 'take_profit_gap' WHEN stop2 > 0 AND sg * (worst - stop2) <= 0 THEN 'stop_loss' ELSE 'take_profit' END AS why
  FROM (SELECT *, sign(size2) AS sg, CASE WHEN size2 > 0 THEN low ELSE high END AS worst, CASE WHEN size2 > 0 THEN high ELSE low END AS best, CASE WHEN size2 <> 0 THEN held2 + 1 ELSE held2 END AS held3
  FROM (SELECT *, CASE WHEN qty > 0 THEN cash1 - (ent * qty * ep + qty * ep * comm) ELSE cash1 END AS cash2, CASE WHEN qty > 0 THEN ent * qty ELSE size1 END AS size2, CASE WHEN qty > 0 THEN ep ELSE price END AS price2, CASE WHEN qty > 0 THEN bts ELSE since END AS since2,
    CASE WHEN qty > 0 THEN ps ELSE stop END AS stop2, CASE WHEN qty > 0 THEN pt ELSE target END AS target2, CASE WHEN qty > 0 THEN qty * ep * comm ELSE fee END AS fee2, CASE WHEN qty > 0 THEN 0 ELSE held END AS held2
  FROM (SELECT *, CASE WHEN ent = 0 OR size1 <> 0 OR (ps > 0 AND ent * (ep - ps) <= 0) THEN 0 ELSE least(CASE WHEN ps > 0 AND abs(ep - ps) > 0.001 THEN cash1 * 0.02 * 1.0 / abs(ep - ps) ELSE 100 END, greatest(0, cash1 / (ep * (1 + comm)))) END AS qty
  FROM (SELECT *, open * (1 + ent * slip) AS ep, CASE WHEN c1 THEN cash + (sign(size) * abs(size) * px1 - fee1) ELSE cash END AS cash1, CASE WHEN c1 THEN 0 ELSE size END AS size1
  FROM (SELECT *, abs(size) * px1 * comm AS fee1
  FROM (SELECT bt.* EXCLUDE (i), b.i AS i, b.i AS bi, b.n, b.ts AS bts, b.open, b.high, b.low, b.close, b.f, b.s, b.down, b.done, b.stop_l, b.target_l, b.stop_s, b.target_s, b.comm, b.slip, bt.leave AND bt.size <> 0 AS c1, b.open * (1 - sign(bt.size) * b.slip) AS px1
    FROM bt JOIN k1 b ON b.g = bt.g AND b.symbol = bt.symbol AND b.i = bt.i + 1))))))))))),
eq AS (SELECT k1.g, k1.symbol, k1.source, k1."interval", k1.ts, k1.close, bt.cash + bt.size * k1.close AS value, bt.size AS position, k1.cash0 FROM bt JOIN k1 USING (g, symbol, i)),
tr AS (SELECT k1.g, k1.symbol, k1.source, k1."interval", t_since AS entry_ts, k1.ts AS exit_ts, t_entry, t_exit, abs(t_size) AS size, sign(t_size) * (t_exit - t_entry) * abs(t_size) AS gross, sign(t_size) * (t_exit - t_entry) * abs(t_size) - t_fee - t_fee2 AS net, t_fee, t_fee2, t_held,
  CASE WHEN t_size > 0 THEN 'long' ELSE 'short' END AS direction, t_why FROM bt JOIN k1 USING (g, symbol, i) WHERE t_exit IS NOT NULL)"""


def _means(fast: int, slow: int, group: int = 0, *, cash: str = "10000.0", comm: float = 0.0, slip: float = 0.0) -> str:
    return f"""SELECT {group} AS g, {IDS}, open, high, low, close, {over("avg(close)", fast)} AS f, {over("avg(close)", slow)} AS s, 0.2::DOUBLE AS stop_pct, ({cash})::DOUBLE AS cash0, {comm}::DOUBLE AS comm, {slip}::DOUBLE AS slip FROM bars"""


_COSTS = kernel_sql(f"{BARS_1H}, k AS ({_means(10, 30, comm=0.001, slip=0.0005)})")


def _run(spark, d):
    s = strategy.parse(CROSSING)
    return backtest.run(s, strategy.prepare(s, B.event_bars(spark, d)), backtest.Execution(commission_pct=0.001, slippage_pct=0.0005))


@query(
    f"""WITH RECURSIVE {_COSTS} SELECT symbol, source, "interval", entry_ts, exit_ts, {r("t_entry", "entry_price")}, {r("t_exit", "exit_price")}, {r("size", "size")}, {r("gross", "gross_pnl", 2)}, {r("net", "pnl", 2)}, {r("t_fee", "entry_commission", 2)}, {r("t_fee2", "exit_commission", 2)},
    0::DOUBLE AS borrow_cost, {r("net / (t_entry * size)", "pnl_pct", 4)}, t_held AS duration_bars, direction, t_why AS exit_reason FROM tr"""
)
def backtest_trades(spark, d):
    return rounded(backtest.trades(_run(spark, d)))


@query(
    f"""WITH RECURSIVE {_COSTS} SELECT {IDS}, close, {r("value", "value")}, {r("(peak - value) / peak", "drawdown")}, {r("position", "position")} FROM (SELECT *, greatest(cash0, max(value) OVER ({W})) AS peak FROM eq)"""
)
def backtest_equity(spark, d):
    return rounded(backtest.equity(_run(spark, d)))


LEVEL = {
    "schema_version": "2.0", "name": "level", "indicators": [{"name": "mid", "type": "sma", "period": 20}],
    "sides": {"long": {"entry": {"condition": {"left": "close", "operator": ">", "right": "mid"}}, "exit": {"condition": {"left": "close", "operator": "<=", "right": "mid"}}}},
}


@query(
    f"""WITH {BARS_1H}, a AS (SELECT *, {over("avg(close)", 20)} AS mid FROM bars), b AS (SELECT *, close > mid AS above, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM a WHERE mid IS NOT NULL),
    c AS (SELECT *, coalesce(lag(above) OVER ({W}), false) AS was, coalesce(lag(above, 2) OVER ({W}), false) AS was2 FROM b),
    e AS (SELECT symbol, source, "interval", ts, open, i, row_number() OVER ({W}) AS k FROM c WHERE was AND NOT was2),
    x AS (SELECT symbol, ts, open AS price, i, n, 'signal' AS why, row_number() OVER ({W}) AS k FROM c WHERE was2 AND NOT was),
    z AS (SELECT symbol, ts, close, i FROM b WHERE i = n)
    SELECT e.symbol, e.source, e."interval", e.ts AS entry_ts, coalesce(x.ts, z.ts) AS exit_ts, e.open AS entry_price, coalesce(x.price, z.close) AS exit_price, coalesce(x.i - e.i, z.i - e.i + 1)::BIGINT AS duration_bars, coalesce(why, 'end_of_backtest') AS exit_reason
    FROM e LEFT JOIN x ON x.symbol = e.symbol AND x.k = e.k JOIN z ON z.symbol = e.symbol"""
)
def backtest_level(spark, d):
    """A rule without stops, whose fills plain windows can tell: in after a close over the mean, out after one under it."""
    s = strategy.parse(LEVEL)
    rows = backtest.run(s, strategy.prepare(s, B.event_bars(spark, d)), backtest.Execution(cash=1e9, size=10.0))
    return backtest.trades(rows).select("symbol", "source", "interval", "entry_ts", "exit_ts", "entry_price", "exit_price", "duration_bars", "exit_reason")


# ---------------------------------------------------------------- metrics over daily closes
def _curve(spark, d):
    return B.event_bars(spark, d, "1d").select(*ID, "close").withColumns({"value": F.col("close"), "position": F.lit(1.0)})


_RET = f"{BARS_1D}, c AS (SELECT *, close AS value, (close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) AS ret, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM days)"
_K = 'symbol, source, "interval"'


@query(
    f"""WITH {_RET}, a AS (SELECT {_K}, arg_min(value, ts) AS v0, arg_max(value, ts) AS v1, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(CASE WHEN ret < 0 THEN ret * ret END) AS down, max((peak - value) / peak) AS dd FROM c GROUP BY {_K}),
    b AS (SELECT *, (v1 - v0) / v0 AS t FROM a), e AS (SELECT *, pow(1 + t, 252.0 / n) - 1 AS y FROM b)
    SELECT {_K}, {r("t", "total_return")}, {sig("y", "annualised_return")}, {sig("CASE WHEN dd > 0 THEN y / dd ELSE 0 END", "calmar")}, {r("mean / sd * sqrt(252)", "sharpe")}, {r("mean / sqrt(down) * sqrt(252)", "sortino")}, {r("dd", "max_drawdown")} FROM e"""
)
def equity_metrics(spark, d):
    m = significant(metrics.equity_metrics(_curve(spark, d), 252.0), "annualised_return", "calmar")
    return m.withColumns({c: F.round(c, 6) for c in ("total_return", "sharpe", "sortino", "max_drawdown")})


@query(
    f"""WITH {_RET} SELECT {IDS}, {r(f"CASE WHEN count(ret) OVER w >= 10 THEN avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) END", "rolling_sharpe", 4)}, {"0 - round((peak - value) / peak, 4) AS rolling_drawdown"}, {r("coalesce(value - lag(value) OVER (PARTITION BY symbol ORDER BY ts), 0)", "rolling_pnl")}
    FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def rolling_metrics(spark, d):
    df = metrics.rolling_drawdown(metrics.rolling_sharpe(_curve(spark, d), 10))
    return out(df, "rolling_sharpe", "rolling_drawdown", "rolling_pnl")


_ORDER_WEEKS = """wk AS (SELECT o_orderpriority AS symbol, 'orders' AS source, '1w' AS "interval", CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY 1, 4)"""
_MONTHS = f"""{_ORDER_WEEKS}, mo AS (SELECT {_K}, strftime(ts, '%Y-%m') AS month, round((arg_max(value, ts) - arg_min(value, ts)) / arg_min(value, ts), 4) AS ret FROM wk GROUP BY {_K}, 4)"""


def _weeks(spark, d):
    return B.order_bars(spark, d).select(*ID, "close").withColumn("value", F.col("close"))


@query(f"WITH {_MONTHS} SELECT * FROM mo")
def monthly_returns(spark, d):
    return metrics.monthly_returns(_weeks(spark, d))


@query(f"WITH {_MONTHS}, y AS (SELECT {_K}, substr(month, 1, 4) AS year, product(1 + ret) - 1 AS ret FROM mo GROUP BY {_K}, 4) SELECT {_K}, year, round(ret, 4) AS ret FROM y")
def yearly_returns(spark, d):
    return metrics.yearly_returns(_weeks(spark, d))


_DIFF = f"{BARS_1H}, t AS (SELECT {IDS}, close - open AS pnl, row_number() OVER ({W}) % 7 AS duration_bars, ts AS entry_ts, ts AS exit_ts FROM bars)"


def _trades(spark, d):
    from barloom.schema import series

    df = B.event_bars(spark, d).withColumns({"pnl": F.col("close") - F.col("open"), "duration_bars": F.row_number().over(series()) % 7, "entry_ts": F.col("ts"), "exit_ts": F.col("ts")})
    return df.select(*ID, "pnl", "duration_bars", "entry_ts", "exit_ts", *[F.lit(0.0).alias(c) for c in ("entry_commission", "exit_commission", "borrow_cost")])


@query(
    f"""WITH {_DIFF} SELECT {_K}, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, {r("sum(pnl)", "net", 4)}, {r("avg(CASE WHEN pnl > 0 THEN pnl END)", "avg_win", 4)}, {r("avg(CASE WHEN pnl <= 0 THEN pnl END)", "avg_loss", 4)},
    {r("avg(duration_bars)", "avg_duration", 4)}, {r("count(*) FILTER (pnl > 0) / count(*)", "win_rate", 4)}, {r("sum(CASE WHEN pnl > 0 THEN pnl END) / sum(CASE WHEN pnl < 0 THEN -pnl END)", "profit_factor", 4)} FROM t GROUP BY {_K}"""
)
def trade_metrics(spark, d):
    return rounded(metrics.trade_metrics(_trades(spark, d)), 4)


@query(
    f"""WITH {_DIFF}, m AS (SELECT *, min(duration_bars) OVER k AS lo, (max(duration_bars) OVER k - min(duration_bars) OVER k) / 8.0 AS step FROM t WINDOW k AS (PARTITION BY symbol))
    SELECT {_K}, CASE WHEN step > 0 THEN least(floor((duration_bars - lo) / step), 7) ELSE 0 END::INT AS bin, round(lo + bin * step, 2) AS low, round(lo + bin * step + CASE WHEN step > 0 THEN step ELSE 1 END, 2) AS high, count(*) AS count FROM m GROUP BY {_K}, lo, step, 4"""
)
def trade_distribution(spark, d):
    return metrics.distribution(_trades(spark, d), "duration_bars", 8)


@query(
    f"""WITH {_DIFF}, m AS (SELECT {_K}, list(pnl ORDER BY pnl) AS l, count(*) AS n FROM t GROUP BY {_K}) SELECT {_K}, {", ".join(f"round(l[(least(floor(n * {p} / 100.0), n - 1) + 1)::INT], 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99))} FROM m"""
)
def trade_percentiles(spark, d):
    return rounded(metrics.index_percentiles(_trades(spark, d), "pnl"))


@query(
    f"""WITH {_DIFF}, m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, ts)::INT AS best, row_number() OVER (PARTITION BY symbol ORDER BY pnl, ts)::INT AS worst FROM t) SELECT {IDS}, {r("pnl", "pnl")}, best, worst FROM m WHERE best <= 5 OR worst <= 5"""
)
def top_trades(spark, d):
    return out(metrics.top_trades(_trades(spark, d)), "pnl", "best", "worst")


@query(
    f"""WITH {_DIFF}, e AS (SELECT {IDS}, close AS value, row_number() OVER ({W}) - 1 AS i FROM bars), x AS (SELECT e.*, count(t.ts) OVER w AS n, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER w AS wins FROM e JOIN t USING (symbol, source, "interval", ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT {IDS}, {r("CASE WHEN i >= 60 AND n > 0 THEN wins / n END", "rolling_win_rate", 4)} FROM x"""
)
def rolling_win_rate(spark, d):
    e = B.event_bars(spark, d).select(*ID, F.col("close").alias("value"))
    return metrics.rolling_win_rate(e, _trades(spark, d)).select(*ID, "rolling_win_rate")


@query(f"""WITH {BARS_1H} SELECT {_K}, max(ts) AS ts, arg_max(close, ts) AS value FROM bars GROUP BY {_K}, date_trunc('week', ts)""")
def equity_weekly(spark, d):
    return metrics.downsample(B.event_bars(spark, d).select(*ID, F.col("close").alias("value")), "week")


@query(
    f"""WITH {BARS_1H}, p AS (SELECT *, (max(close) OVER ({W}) - close) / max(close) OVER ({W}) AS dd FROM bars) SELECT {_K}, CAST(ts AS DATE) AS day, {r("max(dd)", "dd")}, arg_min(ts, (-dd, ts)) AS ts FROM p WHERE dd > 0 GROUP BY {_K}, 4"""
)
def drawdown_events(spark, d):
    return rounded(metrics.drawdown_events(B.event_bars(spark, d).select(*ID, F.col("close").alias("value"))))


_PAIRS = f"{BARS_1D}, n AS (SELECT symbol, row_number() OVER ({W}) AS i, close AS x FROM days), p AS (SELECT a.symbol AS a, b.symbol AS b, a.i, a.x AS xa, b.x AS xb FROM n a JOIN n b USING (i))"


@query(f"WITH {_PAIRS} SELECT a, b, {r('corr(xa, xb)', 'correlation')} FROM p GROUP BY a, b")
def correlation_pearson(spark, d):
    return rounded(metrics.correlations(B.event_bars(spark, d, "1d"), "close"))


@query(
    f"""WITH {_PAIRS}, k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa DESC) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY xb DESC) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0 AS rb FROM p)
    SELECT a, b, {r("corr(ra, rb)", "correlation")} FROM k GROUP BY a, b"""
)
def correlation_spearman(spark, d):
    return rounded(metrics.correlations(B.event_bars(spark, d, "1d"), "close", spearman=True))


@query(
    f"""WITH {BARS_1H}, t AS (SELECT DISTINCT ts FROM bars), s AS (SELECT DISTINCT symbol FROM bars), f AS (SELECT t.ts, coalesce(b.close, 0) AS v FROM t CROSS JOIN s ASOF LEFT JOIN bars b ON b.symbol = s.symbol AND t.ts >= b.ts),
    p AS (SELECT ts, CASE WHEN sum(v) = 0 THEN 100 ELSE sum(v) END AS value FROM f GROUP BY ts), q AS (SELECT *, greatest(coalesce(max(value) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100), 100) AS peak FROM p)
    SELECT ts, {r("value", "value")}, {r("greatest((peak - value) / peak, 0)", "drawdown")} FROM q"""
)
def portfolio_equity(spark, d):
    return rounded(portfolio.portfolio_equity(B.event_bars(spark, d), 100.0, "close"))


_SHARES = kernel_sql(
    f"""{BARS_1H}, w AS (SELECT symbol AS sym, CASE WHEN symbol = 'CLICK' THEN 2.0 ELSE 1.0 END AS w FROM (SELECT DISTINCT symbol FROM bars)), shares AS (SELECT sym, 100000.0 * w / sum(w) OVER () AS c FROM w),
    k AS ({_means(10, 30, cash="(SELECT any_value(c) FROM shares WHERE sym = bars.symbol)")})"""
)


@query(
    f"""WITH RECURSIVE {_SHARES}, t AS (SELECT DISTINCT ts FROM eq), z AS (SELECT DISTINCT symbol FROM eq), v AS (SELECT t.ts, coalesce(e.value, 0) AS v FROM t CROSS JOIN z ASOF LEFT JOIN eq e ON e.symbol = z.symbol AND t.ts >= e.ts),
    p AS (SELECT ts, CASE WHEN sum(v) = 0 THEN 100000 ELSE sum(v) END AS value FROM v GROUP BY ts), q AS (SELECT *, greatest(coalesce(max(value) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000), 100000) AS peak FROM p)
    SELECT ts, {r("value", "value", 4)}, {r("greatest((peak - value) / peak, 0)", "drawdown")} FROM q"""
)
def portfolio_run(spark, d):
    s = strategy.parse(CROSSING)
    bars = B.event_bars(spark, d)
    weights = {"CLICK": 2.0} | {r.symbol: 1.0 for r in bars.where("symbol != 'CLICK'").select("symbol").distinct().orderBy("symbol").collect()}
    rows = portfolio.run_portfolio(s, strategy.prepare(s, bars), weights, backtest.Execution(cash=100_000.0))
    return portfolio.portfolio_equity(backtest.equity(rows), 100_000.0).select("ts", F.round("value", 4).alias("value"), F.round("drawdown", 6).alias("drawdown"))


_RANGES = {"fast": {"min": 5, "max": 10, "step": 5}, "slow": {"min": 20, "max": 30, "step": 10}}


def measures_sql(factor: float, keys: str) -> str:
    """CTEs that end in ``ms``: metrics of each run of ``eq`` and ``tr`` by keys."""
    return f"""e1 AS (SELECT *, lag(value) OVER k AS pv, max(value) OVER k AS peak FROM eq WINDOW k AS (PARTITION BY {keys} ORDER BY ts)),
e2 AS (SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN pv > 0 THEN (value - pv) / pv ELSE 0 END AS ret, CASE WHEN peak > 0 THEN (peak - value) / peak ELSE 0 END AS dd FROM e1),
e3 AS (SELECT {keys}, arg_min(value, ts) AS v0, arg_max(value, ts) AS v1, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(CASE WHEN ret < 0 THEN ret * ret END) AS down, max(dd) AS max_drawdown FROM e2 GROUP BY {keys}),
e4 AS (SELECT *, CASE WHEN v0 > 0 THEN (v1 - v0) / v0 ELSE 0 END AS total_return FROM e3),
e5 AS (SELECT *, CASE WHEN n > 0 AND total_return > -1 THEN pow(1 + total_return, {factor} / n) - 1 ELSE 0 END AS annualised_return FROM e4),
t1 AS (SELECT {keys}, count(*) AS trades, count(*) FILTER (round(net, 2) > 0) / count(*) AS win_rate, sum(CASE WHEN round(net, 2) > 0 THEN round(net, 2) ELSE 0 END) AS up, sum(CASE WHEN round(net, 2) < 0 THEN -round(net, 2) ELSE 0 END) AS lost FROM tr GROUP BY {keys}),
ms AS (SELECT e5.*, CASE WHEN n >= 2 AND sd >= 1e-12 THEN mean / sd * sqrt({factor}) ELSE 0 END AS sharpe, CASE WHEN n >= 2 AND down > 0 THEN mean / sqrt(down) * sqrt({factor}) ELSE 0 END AS sortino, CASE WHEN max_drawdown > 0 THEN annualised_return / max_drawdown ELSE 0 END AS calmar,
  coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate, CASE WHEN lost > 0 THEN up / lost WHEN up > 0 THEN NULL WHEN trades > 0 THEN 0 END AS profit_factor FROM e5 LEFT JOIN t1 USING ({keys}))"""


@query(
    f"""WITH RECURSIVE {_COSTS}, {measures_sql(1638.0, 'g, symbol, source, "interval"')}, fe AS (SELECT symbol, sum(round(t_fee, 2) + round(t_fee2, 2)) AS fees, sum(round(net, 2)) AS net FROM tr GROUP BY symbol)
    SELECT symbol, source, "interval", {r("total_return", "total_return")}, {r("sharpe", "sharpe", 5)}, {r("max_drawdown", "max_drawdown")}, trades, {r("win_rate", "win_rate")}, {r("coalesce(net, 0)", "net", 2)}, {r("coalesce(fees, 0)", "fees", 2)},
    trades < 30 AS few_trades, abs(v1 - v0 - coalesce(net, 0)) <= 0.01 * greatest(trades, 1) AS reconciles FROM ms LEFT JOIN fe USING (symbol)"""
)
def run_report(spark, d):
    rows = _run(spark, d)
    m = metrics.report(backtest.equity(rows), backtest.trades(rows), backtest.notes(rows), 1638.0)
    m = m.withColumns({c: F.round(c, n) for c, n in {"total_return": 6, "sharpe": 5, "max_drawdown": 6, "win_rate": 6, "net": 2, "fees": 2}.items()})
    return m.select("symbol", "source", "interval", "total_return", "sharpe", "max_drawdown", "trades", "win_rate", "net", "fees", "few_trades", "reconciles")


_COMBOS = search.grid(_RANGES)
_GRID = kernel_sql(f"{BARS_1H}, k AS ({' UNION ALL '.join(_means(c['fast'], c['slow'], i) for i, c in enumerate(_COMBOS))})") + ", " + measures_sql(1638.0, 'g, symbol, source, "interval"')


@query(
    f"""WITH RECURSIVE {_GRID} SELECT symbol, source, "interval", g AS combo, {r("total_return", "total_return")}, {sig("annualised_return", "annualised_return")}, {sig("calmar", "calmar")}, {r("sharpe", "sharpe", 5)}, {r("sortino", "sortino", 5)}, {r("max_drawdown", "max_drawdown")},
    trades, {r("win_rate", "win_rate")}, {r("profit_factor", "profit_factor", 4)}, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, g)::INT AS rank, NULL::VARCHAR AS error FROM ms"""
)
def grid_search(spark, d):
    found = search.grid_search(CROSSING, B.event_bars(spark, d), _COMBOS, 1638.0)
    digits = {"sharpe": 5, "sortino": 5, "profit_factor": 4, "total_return": 6, "max_drawdown": 6, "win_rate": 6}
    return significant(found, "annualised_return", "calmar").withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    f"""WITH RECURSIVE {_GRID}, c AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', {float(v)})" for i, x in enumerate(_COMBOS) for k, v in x.items())}) t(g, param, x)), m AS (SELECT param, x, avg(sharpe) AS m FROM ms JOIN c USING (g) GROUP BY param, x),
    d AS (SELECT param, max(m) - min(m) AS d FROM m GROUP BY param) SELECT param, {r("CASE WHEN sum(d) OVER () > 0 THEN d / sum(d) OVER () ELSE 0 END", "sensitivity", 5)} FROM d"""
)
def parameter_sensitivity(spark, d):
    found = search.sensitivity(search.results(search.run_combinations(CROSSING, B.event_bars(spark, d), _COMBOS), 1638.0), _COMBOS)
    return found.select("param", F.round("sensitivity", 5).alias("sensitivity"))


_WALK = search.grid({"fast": {"values": [5, 10]}, "slow": {"values": [30]}})
_FOLDS = kernel_sql(
    f"""{BARS_1H}, cs AS ({" UNION ALL ".join(_means(c["fast"], c["slow"], i) for i, c in enumerate(_WALK))}), nr AS (SELECT *, row_number() OVER (PARTITION BY g, symbol ORDER BY ts) - 1 AS nth FROM cs),
    z0 AS (SELECT symbol, count(*) AS n, count(*) // 3 AS z, floor((count(*) // 3) * 0.7::DOUBLE)::BIGINT AS tr FROM bars GROUP BY symbol), z1 AS (SELECT *, z // 2 + tr AS b1 FROM z0),
    fd AS (SELECT symbol, 0 AS fold, 0 AS a, tr AS b, least(tr + z, n) AS c FROM z1 UNION ALL SELECT symbol, 1, z // 2, b1, least(b1 + z, n) FROM z1 UNION ALL SELECT symbol, 2, greatest(0, b1 - z), b1, least(b1 + 2 * z, n) FROM z1 WHERE b1 + z < n),
    k AS (SELECT g * 100 + fold * 10 + CASE WHEN nth < b THEN 0 ELSE 1 END AS g, nr.* EXCLUDE (g, nth) FROM nr JOIN fd USING (symbol) WHERE nth >= a AND nth < c AND b - a >= 20 AND c - b >= 1)"""
) + ", " + measures_sql(1638.0, 'g, symbol, source, "interval"')
_SHOWN = ("total_return", "sharpe", "max_drawdown", "win_rate", "trades")


@query(
    f"""WITH RECURSIVE {_FOLDS}, tn AS (SELECT *, row_number() OVER (PARTITION BY symbol, g // 10 % 10 ORDER BY sharpe DESC, g) AS place FROM ms WHERE g % 10 = 0)
    SELECT tn.symbol, tn.source, tn."interval", (tn.g // 10 % 10)::INT AS fold, (tn.g // 100)::INT AS combo, {", ".join(r(f"{t}.{c}", f"{n}_{c}", 5) if c != "trades" else f"{t}.{c} AS {n}_{c}" for t, n in (("tn", "is"), ("o", "oos")) for c in _SHOWN)}
    FROM tn JOIN ms o ON o.symbol = tn.symbol AND o.g = tn.g + 1 WHERE place = 1"""
)
def walk_forward(spark, d):
    return rounded(search.walk_forward(CROSSING, B.event_bars(spark, d), _WALK, lambda n: search.folds(n, 3), 1638.0), 5)


from barloom import queries_scale  # noqa: E402, F401  (registers the queries that give the same rows another way)
