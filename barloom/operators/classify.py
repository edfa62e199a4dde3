"""Classifiers, auction states, coils, phases and signals as columns of a frame of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import KEY, before_n, flag, full, lag, ratio


def c(name: str) -> Column:
    return F.col(name)


def price_vs_sma20() -> Column:
    return F.when(c("close") > c("sma_20"), "ABOVE").when(c("close") < c("sma_20"), "BELOW").otherwise("AT")


def trend_direction() -> Column:
    up = (c("sma_20") > c("sma_50")) & (c("sma_50") > c("sma_200")) & (c("close") > c("sma_20"))
    down = (c("sma_20") < c("sma_50")) & (c("sma_50") < c("sma_200")) & (c("close") < c("sma_20"))
    return F.when(up, "BULLISH").when(down, "BEARISH").otherwise("NEUTRAL")


def trend_strength() -> Column:
    return F.when(c("adx") > 25, "STRONG").when(c("adx") < 20, "WEAK").otherwise("MODERATE")


def trend_status() -> Column:
    ranging = flag(c("adx") < 20) | (c("trend_direction") == "NEUTRAL")
    return F.when(ranging, "RANGING").when(c("adx") > 25, "TRENDING").otherwise("TRANSITION")


def breakout_level(df: DataFrame) -> DataFrame:
    """Adds the level and its kind; the band counts if the series has it anywhere."""
    band = F.max(c("bb_upper").isNotNull()).over(Window.partitionBy(*KEY)) if "bb_upper" in df.columns else F.lit(False)
    upper = c("bb_upper") if "bb_upper" in df.columns else F.lit(None).cast("double")
    return df.withColumns(
        {"breakout_level": F.when(band, F.coalesce(upper, c("swing_high_20"))).otherwise(c("swing_high_20")), "breakout_level_type": F.when(band, "bb_upper").otherwise("swing_high")}
    )


def breakout_signal() -> Column:
    return F.when(c("close") < c("swing_low_20"), "DOWN").when(c("close") > c("breakout_level"), "UP").otherwise("NONE")


def is_power_zone() -> Column:
    return flag(ratio(F.abs(c("swing_high_20") - c("bb_upper")), c("swing_high_20")) <= 0.005)


def breakout_quality() -> Column:
    up = c("breakout_signal") == "UP"
    return F.when(up & (c("rvol") > 1.5) & (c("ibs") > 0.7), "HIGH").when(up & (c("rvol") > 1.0) & (c("ibs") > 0.5), "MEDIUM").otherwise("LOW")


def auction_state(df: DataFrame) -> DataFrame:
    """Needs ``vp_poc, vp_vah, vp_val, atr``; adds place, nearness, distances and ``balance_status``."""
    close, poc, vah, val, width = c("close"), c("vp_poc"), c("vp_vah"), c("vp_val"), c("vp_vah") - c("vp_val")
    share = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0)) * 100).otherwise(0.0)
    df = df.withColumns({
        "inside_value": flag((close >= val) & (close <= vah)), "above_value": flag(close > vah), "below_value": flag(close < val),
        "at_poc": flag(F.abs(close - poc) <= width * 0.02), "near_vah": flag(F.abs(close - vah) <= width * 0.1), "near_val": flag(F.abs(close - val) <= width * 0.1),
        "distance_to_vah_pct": share(vah - close, vah), "distance_to_val_pct": share(close - val, close), "value_area_width_pct": share(width, vah), "_c5": lag("close", 5),
    })
    wide, move = c("inside_value") & flag(width > c("atr") * 1.5), close - c("_c5")
    balance = F.when(wide & (move < 0), "IMBALANCED_DOWN").when(wide & (move > 0), "IMBALANCED_UP").when(c("below_value"), "IMBALANCED_DOWN").when(c("above_value"), "IMBALANCED_UP").otherwise("BALANCED")
    return df.withColumn("balance_status", balance).drop("_c5")


def auction_signals(df: DataFrame) -> DataFrame:
    """Needs ``auction_state``, ``ibs``, ``atr``, ``rvol``; adds the five rule signals."""
    close, prev = c("close"), lag("close")
    df = df.withColumns({
        "acceptance_into_value": flag((prev > lag("vp_vah")) | (prev < lag("vp_val"))) & c("inside_value"),
        "rejection_from_edge": flag(c("near_vah") & (c("ibs") < 0.3)) | flag(c("near_val") & (c("ibs") > 0.7)),
        "acceptance_outside_value": F.lag("inside_value", 1, False).over(_w()) & (c("above_value") | c("below_value")),
        "_edge": c("near_vah") | c("near_val"), "_d": close - prev,
        "_toward": flag((F.signum(close - prev) == F.signum(c("vp_poc") - prev)) & (F.abs(close - prev) > c("atr") * 0.5)),
    })
    below = flag(lag("_d") > 0)
    turned = (below & flag(c("ibs") < 0.3)) | (~below & flag(c("ibs") > 0.7))
    return df.withColumns({
        "poc_rejection": c("at_poc") & F.lag("_toward", 1, False).over(_w()) & turned,
        "edge_volume_building": c("_edge") & F.lag("_edge", 1, False).over(_w()) & flag(c("rvol") > 1),
    }).drop("_edge", "_d", "_toward")


def _w():
    return Window.partitionBy(*KEY).orderBy("ts")


def coil(df: DataFrame, n: int = 20, percent: float = 20.0) -> DataFrame:
    """Adds ``is_coiled, coil_intensity``: width in the lowest fifth of the last 20 bars, price inside value or at its point of control."""
    w = c("value_area_width_pct")
    df = df.withColumns({"_ws": F.collect_list(w).over(before_n(n)), "_p": F.percentile(w, F.lit(percent / 100)).over(before_n(n)), "_i": F.row_number().over(_w())})
    rank = F.size(F.filter("_ws", lambda x: x < w)) / n * 100
    coiled = (c("_i") > n) & flag(rank < percent) & w.isNotNull() & (c("inside_value") | c("at_poc"))
    intensity = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - w / F.nullif("_p", F.lit(0.0))) * 100))
    return df.withColumn("is_coiled", coiled).withColumn("coil_intensity", F.when(c("is_coiled") & (c("_p") > 0), intensity).otherwise(0.0)).drop("_ws", "_p", "_i")


def wyckoff(df: DataFrame) -> DataFrame:
    """Adds ``wyckoff_phase``; later assignments win: distribution, accumulation, markdown, markup."""
    w, slope, rvol = c("value_area_width_pct"), c("poc_slope_20"), c("rvol")
    df = df.withColumns({"_dw": w - lag(w, 5), "_mw": full(F.avg, w, 20, 5)})
    spread = (F.abs(slope) < 1.0) & (c("_dw") > 0) & (w > c("_mw")) & (rvol > 1.0) & c("profile_shape").isin("D_SHAPE", "NORMAL")
    gather = (F.abs(slope) < 0.2) & (c("_dw") < 0) & (c("balance_status") == "BALANCED") & c("profile_shape").isin("NORMAL", "B_SHAPE") & (rvol < 1.0)
    phase = (
        F.when(spread, "DISTRIBUTION").when(gather, "ACCUMULATION")
        .when((slope < -0.5) & (c("balance_status") == "IMBALANCED_DOWN"), "MARKDOWN").when((slope > 0.5) & (c("balance_status") == "IMBALANCED_UP"), "MARKUP").otherwise("NEUTRAL")
    )
    return df.withColumn("wyckoff_phase", phase).drop("_dw", "_mw")


#: Flags that say one value of a category.
PHASE_FLAGS = {"is_accumulation": "ACCUMULATION", "is_markup": "MARKUP", "is_distribution": "DISTRIBUTION", "is_markdown": "MARKDOWN", "is_wyckoff_neutral": "NEUTRAL"}
SHAPE_FLAGS = {"is_normal_shape": "NORMAL", "is_b_shape": "B_SHAPE", "is_p_shape": "P_SHAPE", "is_d_shape": "D_SHAPE", "is_neutral_shape": "NEUTRAL"}


def category_flags(source: str, flags: dict[str, str]) -> dict[str, Column]:
    return {name: flag(c(source) == value) for name, value in flags.items()}


def rsi_zone() -> Column:
    """A null RSI falls through to the last zone."""
    r = c("rsi_14")
    return F.when(r < 20, "EXTREME_OVERSOLD").when(r < 30, "OVERSOLD").when(r <= 70, "NEUTRAL").when(r <= 80, "OVERBOUGHT").otherwise("EXTREME_OVERBOUGHT")


def adx_conviction() -> Column:
    out = F.lit(95)
    for limit, value in reversed(((15, 20), (20, 35), (25, 50), (35, 70), (50, 85))):
        out = F.when(c("adx") < limit, value).otherwise(out)
    return out


def signals(df: DataFrame) -> DataFrame:
    """Needs ``rsi_14, adx, rvol, atr``, 20-bar bands and swings, ``trend_direction, is_power_zone``; adds zones, risk flags and the confidence score."""
    near = lambda swing: flag((F.abs(c("close") - c(swing)) < c("atr") * 0.5) & (c("atr") > 0) & (c(swing) > 0))
    df = df.withColumns({
        "rsi_zone": rsi_zone(), "adx_conviction": adx_conviction(), "is_weak_trend": flag(c("adx") < 20), "is_low_volume": flag(c("rvol") < 0.5),
        "is_squeeze": flag((ratio(c("bb_upper_20") - c("bb_lower_20"), c("close")) < 0.03) & (c("adx") < 20)),
        "near_resistance": near("swing_high_20"), "near_support": near("swing_low_20"),
    })
    df = df.withColumns({"is_extreme_oversold": c("rsi_zone") == "EXTREME_OVERSOLD", "is_extreme_overbought": c("rsi_zone") == "EXTREME_OVERBOUGHT"})
    df = df.withColumn("is_overextended", c("is_extreme_oversold") | c("is_extreme_overbought"))
    trend = F.when((c("adx") > 25) & (c("trend_direction") != "NEUTRAL"), 10).otherwise(0)
    volume = F.when(c("rvol") >= 3, 12).when(c("rvol") >= 2, 8).when(c("rvol") >= 1.5, 5).otherwise(0)
    zone, strained = F.when(c("is_power_zone"), 4).otherwise(0), F.when(flag((c("rsi_14") > 80) | ((c("rsi_14") < 20) & (c("rsi_14") != 0))), 4).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(35) + trend + volume + zone - strained))
    return df.withColumn("confidence_score", score.cast("double"))
