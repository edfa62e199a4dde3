"""Columns by calendar day of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.price import typical_price
from barloom.schema import KEY, ratio, session

#: Bars of the opening range by interval; other intervals take 2.
OPENING_BARS = {"5min": 12, "15min": 4, "30min": 2, "1h": 1}


def vwap_bands(bars: DataFrame) -> DataFrame:
    """Adds ``vwap_session`` and bands at one and two deviations (unweighted means), running by day."""
    day = Window.partitionBy(*KEY, session())
    run = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    p, v = typical_price(), F.col("volume")
    df = bars.withColumns({"_v": F.sum(v).over(run), "_pv": F.sum(p * v).over(run), "_p": F.avg(p).over(run), "_pp": F.avg(p * p).over(run), "_n": F.count(F.lit(1)).over(day)})
    df = df.withColumn("_w", F.when(F.col("_v") > 0, F.col("_pv") / F.nullif(F.col("_v").cast("double"), F.lit(0.0))))
    df = df.withColumn("_s", F.sqrt(F.greatest(F.col("_pp") - 2 * F.col("_w") * F.col("_p") + F.col("_w") * F.col("_w"), F.lit(0.0))))
    alone = F.col("_n") == 1
    out = {"vwap_session": F.when(alone, p).otherwise(F.col("_w"))}
    for k in (1, 2):
        out[f"vwap_upper_{k}"] = F.when(alone, p).otherwise(F.col("_w") + k * F.col("_s"))
        out[f"vwap_lower_{k}"] = F.when(alone, p).otherwise(F.col("_w") - k * F.col("_s"))
    return df.withColumns(out).drop("_v", "_pv", "_p", "_pp", "_n", "_w", "_s")


def opening_range(bars: DataFrame) -> DataFrame:
    """Adds ``ib_high, ib_low, ib_range, ib_midpoint`` of the day's first bars; null if the day is shorter."""
    day = Window.partitionBy(*KEY, session())
    n = F.lit(2)
    for interval, k in OPENING_BARS.items():
        n = F.when(F.col("interval") == interval, k).otherwise(n)
    df = bars.withColumn("_i", F.row_number().over(day.orderBy("ts"))).withColumn("_n", n)
    opening = F.col("_i") <= F.col("_n")
    enough = F.count(F.lit(1)).over(day) >= F.col("_n")
    high, low = (F.when(enough, agg(F.when(opening, F.col(c))).over(day)) for agg, c in ((F.max, "high"), (F.min, "low")))
    df = df.withColumns({"ib_high": high, "ib_low": low}).drop("_i", "_n")
    return df.withColumns({"ib_range": F.col("ib_high") - F.col("ib_low"), "ib_midpoint": (F.col("ib_high") + F.col("ib_low")) / 2})


def poc_by_session(bars: DataFrame) -> DataFrame:
    """Adds ``poc_slope_5, poc_slope_20`` (percent over sessions, 0 before) and ``value_area_migration``
    (against the previous session); needs ``vp_poc``."""
    w = Window.partitionBy(*KEY).orderBy("day")
    days = bars.groupBy(*KEY, session().alias("day")).agg(F.max("vp_poc").alias("_poc"))
    slope = lambda k: F.coalesce(ratio(F.col("_poc") - F.lag("_poc", k).over(w), F.lag("_poc", k).over(w)) * 100, F.lit(0.0))
    prev = F.lag("_poc").over(w)
    move = F.when(F.col("_poc") > prev, "HIGHER").when(F.col("_poc") < prev, "LOWER").otherwise("STABLE")
    days = days.select(*KEY, "day", slope(5).alias("poc_slope_5"), slope(20).alias("poc_slope_20"), move.alias("value_area_migration"))
    return bars.withColumn("day", session()).join(days, [*KEY, "day"]).drop("day")
