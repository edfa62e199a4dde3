"""Performance metrics as aggregates over equity curves and trades; groups in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import KEY

# Bars a year by interval and calendar.
_DAY = {"1d": 1.0, "1w": None, "1h": 6.5, "4h": 1.625, "1m": 390.0, "1min": 390.0, "5m": 78.0, "5min": 78.0, "15m": 26.0, "15min": 26.0, "30m": 13.0, "30min": 13.0}
_ROUND_CLOCK = {"1d": 1.0, "1w": 1 / 7, "1h": 24.0, "4h": 6.0, "1m": 1440.0, "1min": 1440.0, "5m": 288.0, "5min": 288.0, "15m": 96.0, "15min": 96.0, "30m": 48.0, "30min": 48.0}


def annual_factor(interval: str, calendar: str = "equity_regular_hours") -> tuple[float, str]:
    """Bars a year, and a warning where the daily factor stands in."""
    if calendar == "crypto_24_7":
        table = {k: 365.0 * v for k, v in _ROUND_CLOCK.items()}
    else:
        table = {k: 52.0 if v is None else 252.0 * v for k, v in _DAY.items()}
    key = (interval or "").lower().strip()
    return (table[key], "") if key in table else (table["1d"], f"interval {interval!r} is unknown; daily bars are assumed")


def _w(by) -> Window:
    return Window.partitionBy(*by).orderBy("ts")


def with_returns(equity: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Adds ``ret``: change over the bar before, 0 where that isn't positive; null on the first bar."""
    prev = F.lag("value").over(_w(by))
    return equity.withColumn("ret", F.when(prev.isNotNull(), F.when(prev > 0, (F.col("value") - prev) / F.nullif(prev, F.lit(0.0))).otherwise(0.0)))


def with_drawdown(equity: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Adds ``dd``: share under the running peak, positive."""
    peak = F.max("value").over(_w(by).rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("dd", F.when(peak > 0, (peak - F.col("value")) / F.nullif(peak, F.lit(0.0))).otherwise(0.0))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(0.0)


def equity_metrics(equity: DataFrame, factor: float, by: tuple[str, ...] = KEY) -> DataFrame:
    """Total and annualised return, Sharpe, Sortino, largest drawdown and Calmar of each curve."""
    df = with_drawdown(with_returns(equity, by), by)
    r = F.col("ret")
    a = df.groupBy(*by).agg(
        F.min_by("value", "ts").alias("_first"), F.max_by("value", "ts").alias("_last"), F.count("ret").alias("_n"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"),
        F.avg(F.when(r < 0, r * r)).alias("_down"), F.max("dd").alias("max_drawdown"),
    )
    total = _safe(F.col("_last") - F.col("_first"), F.col("_first"))
    a = a.withColumn("total_return", total)
    year = F.when((F.col("_n") > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), F.lit(factor) / F.nullif(F.col("_n").cast("double"), F.lit(0.0))) - 1).otherwise(0.0)
    root = factor**0.5
    return a.withColumn("annualised_return", year).select(
        *by, "total_return", "annualised_return",
        F.when((F.col("_n") >= 2) & (F.col("_sd") >= 1e-12), F.col("_mean") / F.nullif("_sd", F.lit(0.0)) * root).otherwise(0.0).alias("sharpe"),
        F.when((F.col("_n") >= 2) & (F.col("_down") > 0), F.col("_mean") / F.sqrt(F.nullif("_down", F.lit(0.0))) * root).otherwise(0.0).alias("sortino"),
        "max_drawdown", _safe(F.col("annualised_return"), F.col("max_drawdown")).alias("calmar"),
    )


def trade_metrics(trades: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Counts, win rate, profit factor (null without losses), averages and costs of each group's trades."""
    p = F.col("pnl")
    a = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p <= 0).alias("losses"), F.sum("pnl").alias("net"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p <= 0, p)).alias("avg_loss"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("_up"), F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0)).alias("_down"), F.avg("duration_bars").alias("avg_duration"),
    )
    return a.withColumns({"win_rate": _safe(F.col("wins"), F.col("trades")), "profit_factor": F.when(F.col("_down") > 0, F.col("_up") / F.nullif("_down", F.lit(0.0))).when(F.col("_up") > 0, F.lit(None)).otherwise(0.0)}).drop("_up", "_down")


def reconcile(equity: DataFrame, trades: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """What the curve's change and the trades' sum differ by."""
    e = equity.groupBy(*by).agg(F.max_by("value", "ts").alias("final"), F.min_by("value", "ts").alias("initial"))
    t = trades.groupBy(*by).agg(F.sum("pnl").alias("net"), F.sum(F.col("entry_commission") + F.col("exit_commission")).alias("fees"), F.sum("borrow_cost").alias("borrow"))
    return e.join(t, list(by), "left").withColumn("difference", F.col("final") - F.col("initial") - F.coalesce("net", F.lit(0.0)))


def slippage_cost(trades: DataFrame, pct: float, by: tuple[str, ...] = KEY) -> DataFrame:
    """``slippage`` of each run: fills stand ``pct`` off the price they were made from, to the trader's cost."""
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    off = lambda price, s: F.abs(F.col(price) - F.col(price) / (1 + s * pct)) * F.col("size")
    return trades.groupBy(*by).agg(F.sum(off("entry_price", sign) + off("exit_price", -sign)).alias("slippage"))


def report(equity: DataFrame, trades: DataFrame, notes: DataFrame, factor: float, by: tuple[str, ...] = KEY, *, few: int = 30, slippage_pct: float = 0.0) -> DataFrame:
    """One row a run: metrics of its curve and trades, what both differ by, counts of notes by code, what ``slippage_pct``
    of each fill cost, and whether to trust it (``few_trades``: under ``few``; ``reconciles``: curve and trades agree to a cent a trade)."""
    t = trade_metrics(trades, by).join(slippage_cost(trades, slippage_pct, by), list(by), "left")
    codes = notes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "_n")))).alias("notes"))
    e = equity_metrics(equity, factor, by).join(reconcile(equity, trades, by).select(*by, "initial", "final", "fees", "borrow", "difference"), list(by))
    out = e.join(t, list(by), "left").join(codes, list(by), "left").fillna(0, ["trades", "wins", "losses", "net", "fees", "borrow", "win_rate", "slippage"])
    return out.withColumns({"few_trades": F.col("trades") < few, "reconciles": F.abs("difference") <= 0.01 * F.greatest(F.col("trades"), F.lit(1))})


def rolling_sharpe(equity: DataFrame, n: int = 60, by: tuple[str, ...] = KEY) -> DataFrame:
    """Adds ``rolling_sharpe``: mean over sample deviation of n returns, 0 without variance, null before."""
    w = _w(by).rowsBetween(-(n - 1), 0)
    df = with_returns(equity, by).withColumns({"_m": F.avg("ret").over(w), "_s": F.stddev_samp("ret").over(w), "_n": F.count("ret").over(w)})
    return df.withColumn("rolling_sharpe", F.when(F.col("_n") >= n, F.when(F.col("_s") > 0, F.round(F.col("_m") / F.nullif("_s", F.lit(0.0)), 4)).otherwise(0.0))).drop("_m", "_s", "_n", "ret")


def rolling_win_rate(equity: DataFrame, trades: DataFrame, n: int = 60, by: tuple[str, ...] = KEY) -> DataFrame:
    """Adds ``rolling_win_rate`` of trades that ended in the last n bars; null before bar n and without trades.

    Trades are counted per bar before they meet the curve, so no range join is needed."""
    ended = trades.groupBy(*by, F.col("exit_ts").alias("ts")).agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("pnl") > 0).alias("_w"))
    w = _w(by).rowsBetween(-(n - 1), 0)
    df = equity.join(ended, [*by, "ts"], "left").withColumns({"_t": F.sum("_t").over(w), "_w": F.sum("_w").over(w), "_i": F.row_number().over(_w(by)) - 1})
    return df.withColumn("rolling_win_rate", F.when((F.col("_i") >= n) & (F.col("_t") > 0), F.round(F.col("_w") / F.nullif(F.col("_t").cast("double"), F.lit(0.0)), 4))).drop("_t", "_w", "_i")


def rolling_drawdown(equity: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Adds ``rolling_drawdown``, negative, and ``rolling_pnl``, the change over a bar."""
    df = with_drawdown(equity, by)
    return df.withColumns({"rolling_drawdown": F.lit(0.0) - F.round("dd", 4), "rolling_pnl": F.coalesce(F.col("value") - F.lag("value").over(_w(by)), F.lit(0.0))}).drop("dd")


def monthly_returns(equity: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Last over first value inside each month, less 1."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    a = equity.groupBy(*by, month).agg(F.min_by("value", "ts").alias("_a"), F.max_by("value", "ts").alias("_b"))
    return a.select(*by, "month", F.round(_safe(F.col("_b") - F.col("_a"), F.col("_a")), 4).alias("ret"))


def yearly_returns(equity: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Monthly returns compounded by year."""
    return monthly_returns(equity, by).groupBy(*by, F.substring("month", 1, 4).alias("year")).agg(F.round(F.product(1 + F.col("ret")) - 1, 4).alias("ret"))


def exposure(equity: DataFrame) -> DataFrame:
    return equity.withColumn("exposure", F.least(_safe(F.abs("position") * F.col("close"), F.col("value")), F.lit(1.0)))


def distribution(frame: DataFrame, value: str, bins: int, by: tuple[str, ...] = KEY) -> DataFrame:
    """``bin, low, high, count``: equal widths, the highest value in the last bin; one bin if all are equal."""
    w = Window.partitionBy(*by)
    df = frame.withColumns({"_lo": F.min(value).over(w), "_hi": F.max(value).over(w)}).withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)
    at = F.when(F.col("_step") > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif("_step", F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    a = df.where(F.col(value).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.first("_lo").alias("_lo"), F.first("_step").alias("_step"), F.count(F.lit(1)).alias("count"))
    low = F.col("_lo") + F.col("bin") * F.col("_step")
    return a.select(*by, "bin", F.round(low, 2).alias("low"), F.round(low + F.when(F.col("_step") > 0, F.col("_step")).otherwise(1.0), 2).alias("high"), "count")


def index_percentiles(frame: DataFrame, value: str, points: tuple[int, ...] = (25, 50, 75, 90, 95, 99), by: tuple[str, ...] = KEY) -> DataFrame:
    """Values at place int(n * p / 100) of the sorted group, without interpolation; no group is gathered."""
    w = Window.partitionBy(*by)
    df = frame.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return df.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1), F.col(value))).alias(f"p{p}") for p in points])


def top_trades(trades: DataFrame, k: int = 5, by: tuple[str, ...] = KEY) -> DataFrame:
    """The k best and worst trades of each group with ``rank`` from either end."""
    w = Window.partitionBy(*by)
    best, worst = w.orderBy(F.col("pnl").desc(), "entry_ts", "exit_ts"), w.orderBy("pnl", "entry_ts", "exit_ts")
    df = trades.withColumns({"best": F.row_number().over(best), "worst": F.row_number().over(worst)})
    return df.where((F.col("best") <= k) | (F.col("worst") <= k))


def downsample(equity: DataFrame, unit: str, by: tuple[str, ...] = KEY) -> DataFrame:
    """The last point of each day or week."""
    rest = [c for c in equity.columns if c not in by]
    a = equity.groupBy(*by, F.date_trunc(unit, "ts").alias("_t")).agg(F.max_by(F.struct(*rest), "ts").alias("_r"))
    return a.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def drawdown_events(equity: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """The deepest point of each day on which the curve is under its peak."""
    df = with_drawdown(equity, by).where("dd > 0")
    return df.groupBy(*by, F.to_date("ts").alias("day")).agg(F.max("dd").alias("dd"), F.min_by("ts", F.struct(-F.col("dd"), "ts")).alias("ts"))


def sort_trades(trades: DataFrame, field: str = "entry_ts", descending: bool = False) -> DataFrame:
    """Trades in order of one of their fields, nulls last."""
    c = F.col(field)
    return trades.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "entry_ts", "exit_ts")


def correlations(series: DataFrame, value: str, member: str = "symbol", *, spearman: bool = False) -> DataFrame:
    """``a, b, correlation`` of all pairs of members: values meet by place in time, the longer series is cut;
    0 without variance. Each pair is computed once and given both ways."""
    w = Window.partitionBy(member).orderBy("ts")
    rows = series.select(F.col(member).alias("m"), F.row_number().over(w).alias("i"), F.col(value).alias("x"))
    pairs = rows.select(F.col("m").alias("a"), "i", F.col("x").alias("xa")).join(rows.select(F.col("m").alias("b"), "i", F.col("x").alias("xb")), "i").where("a <= b")
    if spearman:
        p = Window.partitionBy("a", "b")
        average = lambda c: F.rank().over(p.orderBy(F.col(c).desc())) + (F.count(F.lit(1)).over(Window.partitionBy("a", "b", c)) - 1) / 2
        pairs = pairs.select("a", "b", average("xa").alias("xa"), average("xb").alias("xb"))
    flat = (F.stddev_pop("xa") <= 1e-12) | (F.stddev_pop("xb") <= 1e-12)
    found = pairs.groupBy("a", "b").agg(F.when(flat, 0.0).otherwise(F.coalesce(F.corr("xa", "xb"), F.lit(0.0))).alias("correlation"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return found.select(F.explode(both).alias("p"), "correlation").select("p.a", "p.b", "correlation")
