"""Indicator names, what they need, and how they are added.

``add_indicators`` resolves names with all they depend on, whatever their order, and adds them in
few steps: names that one builder gives are added together, recursive columns in one grouped pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from barloom.functions import price
from barloom.operators import classify, profiles, recursive, rolling, session
from barloom.schema import flag


@dataclass(frozen=True)
class Builder:
    """Adds its columns to a frame that has ``needs``."""

    gives: tuple[str, ...]
    needs: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame] = field(compare=False)


_BUILDERS: dict[str, Builder] = {}


def register(gives: tuple[str, ...] | str, needs: tuple[str, ...], build: Callable[[DataFrame], DataFrame]) -> None:
    """Makes names known; a name of one's own may be registered too."""
    b = Builder((gives,) if isinstance(gives, str) else gives, needs, build)
    _BUILDERS.update(dict.fromkeys(b.gives, b))


def _column(name: str, needs: tuple[str, ...], make: Callable[[], Column]) -> None:
    register(name, needs, lambda df: df.withColumn(name, make()))


def _bands(upper: str, middle: str, lower: str, n: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(dict(zip((upper, middle, lower), rolling.bollinger(n), strict=True)))


for _n in (10, 20, 30, 50, 200):
    _column(f"sma_{_n}", (), lambda n=_n: rolling.sma(n))
register(("bb_upper", "bb_middle", "bb_lower"), (), _bands("bb_upper", "bb_middle", "bb_lower", 20))
_column("ibs", (), price.ibs)
_column("rvol", (), rolling.relative_volume)
register("ker", (), rolling.efficiency)
_column("vwap", (), rolling.cumulative_vwap)
register("yang_zhang", (), rolling.yang_zhang)
_column("swing_high_20", (), rolling.swing_high)
_column("swing_low_20", (), rolling.swing_low)
_column("price_vs_sma20", ("sma_20",), classify.price_vs_sma20)
_column("trend_direction", ("sma_20", "sma_50", "sma_200"), classify.trend_direction)
_column("trend_strength", ("adx",), classify.trend_strength)
_column("trend_status", ("adx", "trend_direction"), classify.trend_status)
register(("breakout_level", "breakout_level_type"), ("swing_high_20", "bb_upper"), classify.breakout_level)
_column("breakout_signal", ("breakout_level", "swing_low_20"), classify.breakout_signal)
_column("is_power_zone", ("swing_high_20", "bb_upper"), classify.is_power_zone)
_column("breakout_quality", ("breakout_signal", "ibs", "rvol"), classify.breakout_quality)
_column("vol_buffer_high", ("atr",), lambda: classify.c("open") + 0.1 * classify.c("atr"))
_column("vol_buffer_low", ("atr",), lambda: classify.c("open") - 0.1 * classify.c("atr"))
register(("ib_high", "ib_low", "ib_range", "ib_midpoint"), (), session.opening_range)
register(("vwap_session", "vwap_upper_1", "vwap_lower_1", "vwap_upper_2", "vwap_lower_2"), (), session.vwap_bands)
register(("vp_poc", "vp_vah", "vp_val"), (), profiles.add_session_profile)
register(("mp_poc", "mp_vah", "mp_val"), (), profiles.add_time_profile)
register("profile_shape", (), profiles.add_profile_shape)
register(("poc_slope_5", "poc_slope_20", "value_area_migration"), ("vp_poc",), session.poc_by_session)
_STATES = ("inside_value", "above_value", "below_value", "at_poc", "near_vah", "near_val", "distance_to_vah_pct", "distance_to_val_pct", "value_area_width_pct", "balance_status")
register(_STATES, ("vp_poc", "vp_vah", "vp_val", "atr"), classify.auction_state)
register(("acceptance_into_value", "rejection_from_edge", "acceptance_outside_value", "poc_rejection", "edge_volume_building"), ("inside_value", "ibs", "atr", "rvol"), classify.auction_signals)
register(("is_coiled", "coil_intensity"), ("value_area_width_pct",), classify.coil)
register("wyckoff_phase", ("value_area_width_pct", "poc_slope_20", "rvol", "profile_shape"), classify.wyckoff)
for _name, _value in classify.PHASE_FLAGS.items():
    _column(_name, ("wyckoff_phase",), lambda v=_value: flag(classify.c("wyckoff_phase") == v))
for _name, _value in classify.SHAPE_FLAGS.items():
    _column(_name, ("profile_shape",), lambda v=_value: flag(classify.c("profile_shape") == v))
SIGNALS = (
    "rsi_zone", "adx_conviction", "is_extreme_oversold", "is_extreme_overbought", "is_overextended", "is_weak_trend", "is_low_volume", "is_squeeze",
    "near_resistance", "near_support", "confidence_score",
)
register(SIGNALS, ("rsi_14", "adx", "rvol", "atr", "bb_upper_20", "swing_high_20", "swing_low_20", "trend_direction", "is_power_zone"), classify.signals)
for _name, _make in {
    "proxy_typical_price": price.typical_price, "proxy_vwap": price.typical_price, "proxy_ohlc4": price.ohlc4, "proxy_ibs": price.ibs_or_half, "proxy_parkinson": price.parkinson,
    "proxy_garman_klass": price.garman_klass, "proxy_rogers_satchell": price.rogers_satchell, "typical_price": price.typical_price, "ohlc4": price.ohlc4, "body_pct": price.body_share, "range_pct": price.range_share,
}.items():
    _column(_name, (), _make)
_column("proxy_ib_high", ("atr",), lambda: price.open_buffer(classify.c("atr"), 1))
_column("proxy_ib_low", ("atr",), lambda: price.open_buffer(classify.c("atr"), -1))
_column("proxy_expected_move", ("atr",), lambda: price.expected_move(classify.c("atr")))
_column("proxy_iv", ("atr",), lambda: price.implied_volatility(classify.c("atr")))

#: Ranges of the periods of names made from a period.
PERIODS = {"sma": (2, 500), "ema": (2, 500), "rsi": (2, 100), "atr": (2, 200), "bb_upper": (2, 200), "bb_middle": (2, 200), "bb_lower": (2, 200), "adx": (2, 100)}


#: What a mean, a band, an EMA or an RSI may be taken of, and the kinds that take it.
SOURCES = ("open", "high", "low", "close", "volume", "typical_price", "ohlc4")
SOURCED = ("sma", "ema", "rsi", "bb_upper", "bb_middle", "bb_lower")


def _of(kind: str, n: int, source: str) -> Builder:
    """Means and bands of another price than the close."""
    needs = (source,) if source in ("typical_price", "ohlc4") else ()
    if kind == "sma":
        return Builder((f"sma_{n}_of_{source}",), needs, lambda df: df.withColumn(f"sma_{n}_of_{source}", rolling.sma(n, source)))
    names = tuple(f"bb_{k}_{n}_of_{source}" for k in ("upper", "middle", "lower"))
    return Builder(names, needs, lambda df: df.withColumns(dict(zip(names, rolling.bollinger(n, source), strict=True))))


def find(name: str) -> Builder:
    """The builder of a name, registered or made from a period."""
    if name in _BUILDERS:
        return _BUILDERS[name]
    if recursive.NAMES.match(name):
        return Builder((name,), (), lambda df: recursive.add_recursive(df, [name]))
    if m := re.fullmatch(r"sma_(\d+)", name):
        return Builder((name,), (), lambda df: df.withColumn(name, rolling.sma(int(m[1]))))
    if m := re.fullmatch(r"bb_(?:upper|middle|lower)_(\d+)", name):
        names = tuple(f"bb_{k}_{m[1]}" for k in ("upper", "middle", "lower"))
        return Builder(names, (), _bands(*names, int(m[1])))
    if m := re.fullmatch(rf"(sma|bb_(?:upper|middle|lower))_(\d+)_of_({'|'.join(SOURCES)})", name):
        return _of(m[1], int(m[2]), m[3])
    for pattern, prefix, needs, build in (
        (r"vp_(?:poc|vah|val)_(\d+)d", "vp_{}_{}d", ("vp_poc",), profiles.add_median_profile),
        (r"cvp_(?:poc|vah|val)_(\d+)d", "cvp_{}_{}d", (), profiles.add_composite_profile),
        (r"rvp_(?:poc|vah|val)_(\d+)", "rvp_{}_{}", (), profiles.add_rolling_profile),
    ):
        if (m := re.fullmatch(pattern, name)) and int(m[1]) >= 1:
            return Builder(tuple(prefix.format(k, m[1]) for k in ("poc", "vah", "val")), needs, lambda df, b=build, n=int(m[1]): b(df, n))
    raise KeyError(f"unknown indicator: {name}")


def names() -> list[str]:
    return sorted(_BUILDERS) + ["atr", "adx", "ema_12", "ema_26", "kama", "macd", "macd_hist", "macd_signal", "proxy_atr", "rsi_14", "rsi_7"]


def resolve(wanted: list[str], have: list[str]) -> list[Builder]:
    """Builders in an order in which each finds what it needs; a cycle is an error."""
    out: list[Builder] = []
    done, open_ = set(have), set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise ValueError(f"circular need of {name}")
        open_.add(name)
        b = find(name)
        for n in b.needs:
            visit(n)
        done.update(b.gives)
        out.append(b)

    for name in wanted:
        visit(name)
    return out


def add_indicators(bars: DataFrame, wanted: list[str], *, keep_needed: bool = False) -> DataFrame:
    """The bars with the wanted columns (and those they need, with ``keep_needed``)."""
    builders = resolve(wanted, bars.columns)
    folded = [b.gives[0] for b in builders if recursive.NAMES.match(b.gives[0]) and b.gives[0] not in _BUILDERS]
    df = recursive.add_recursive(bars, folded) if folded else bars
    for b in builders:
        if not set(b.gives) <= set(df.columns):
            df = b.build(df)
    return df if keep_needed else df.select(*bars.columns, *[w for w in dict.fromkeys(wanted) if w not in bars.columns])
