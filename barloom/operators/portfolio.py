"""Portfolios: one run per symbol with its share of the cash, then one curve."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import backtest
from barloom.plans.strategy import Strategy


def run_portfolio(strategy: Strategy, prepared: DataFrame, weights: dict[str, float], how: backtest.Execution) -> DataFrame:
    """Kernel rows of all weighted symbols; cash goes by weight."""
    total = sum(weights.values())
    own = {s: replace(how, cash=how.cash * w / total) for s, w in weights.items()}
    return backtest.run(strategy, prepared.where(F.col("symbol").isin(list(weights))), own)


def portfolio_equity(equity: DataFrame, cash: float, value: str = "value") -> DataFrame:
    """``ts, value, drawdown`` of the sum of all curves: the last value of each counts on, 0 before its
    first; a sum of 0 is the cash; the drawdown is against the peak before.

    Curves become changes, which add up by time without a grid of times and members. Sums and peaks run
    within days, after those of the days before, so that no task holds the whole curve; changes are
    decimals of 12 places, whose sums have no drift."""
    exact = "decimal(38,12)"
    own = Window.partitionBy("symbol").orderBy("ts")
    held = equity.select("symbol", "ts", F.coalesce(F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).cast(exact).alias("v"))
    steps = held.withColumn("d", F.col("v") - F.coalesce(F.lag("v").over(own), F.lit(0).cast(exact)))
    steps = steps.groupBy("ts").agg(F.sum("d").cast(exact).alias("d")).withColumn("_day", F.to_date("ts"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # over a row a day
    in_day = Window.partitionBy("_day").orderBy("ts")
    days = steps.groupBy("_day").agg(F.sum("d").cast(exact).alias("s")).select("_day", F.coalesce(F.sum("s").over(earlier), F.lit(0)).cast(exact).alias("start"))
    summed = steps.join(days, "_day").withColumn("_v", (F.col("start") + F.sum("d").over(in_day.rowsBetween(Window.unboundedPreceding, 0))).cast("double"))
    total = summed.select("_day", "ts", F.when(F.col("_v") == 0, cash).otherwise(F.col("_v")).alias("value"))
    tops = total.groupBy("_day").agg(F.max("value").alias("m")).select("_day", F.max("m").over(earlier).alias("top"))
    before = F.max("value").over(in_day.rowsBetween(Window.unboundedPreceding, -1))
    peak = F.greatest(F.coalesce("top", F.lit(cash)), F.coalesce(before, F.lit(cash)), F.lit(cash))
    out = total.join(tops, "_day").withColumn("_peak", peak)
    return out.select("ts", "value", F.greatest((F.col("_peak") - F.col("value")) / F.col("_peak"), F.lit(0.0)).alias("drawdown"))
