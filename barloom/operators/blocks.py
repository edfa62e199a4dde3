"""Work on blocks of a series, so that a long series is many tasks.

A series is cut into time blocks of about ``size`` bars. What a block needs from before it is carried by
its summary, a row a block: counts, last rows, composed recurrences. Summaries of a series are ``size``
times fewer than its bars, and only they meet in one window. The bars are shuffled by series and block,
so a series that holds a third of all bars is dealt over all its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.operators.asof import PRICES, _seconds
from barloom.schema import KEY, SECONDS

#: Bars of a block, about; a block has no more than one for each time that its stretch holds.
SIZE = 4096


def time_block(size: int = SIZE, ts: str = "ts") -> Column:
    """The number of the stretch of ``size`` intervals that a time is in; unknown intervals count as hours."""
    length = F.lit(3600)
    for name, seconds in SECONDS.items():
        length = F.when(F.col("interval") == name, seconds).otherwise(length)
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (length * size))


def _before(by: tuple[str, ...], order: str = "_block") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def numbered(bars: DataFrame, size: int = SIZE, by: tuple[str, ...] = KEY) -> DataFrame:
    """Adds ``_pos``, the place of a bar in its series from 0, without ever sorting a whole series.

    Places in a block are a window over the block; where a block starts is a running sum over counts."""
    rows = bars.withColumn("_block", time_block(size))
    starts = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(_before(by)), F.lit(0))).drop("_n")
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_block").orderBy("ts")) - 1)
    return placed.join(starts, [*by, "_block"]).withColumn("_pos", F.col("_start") + F.col("_at")).drop("_start", "_at", "_block")


def with_halo(bars: DataFrame, reach: int, size: int = SIZE, by: tuple[str, ...] = KEY) -> DataFrame:
    """Rows by blocks of exactly ``size`` places, with copies of the ``reach`` rows before each block.

    Adds ``_pos``, ``_part`` (the block) and ``_own`` (not a copy). A row is copied to as many blocks as it
    reaches into: one, unless ``reach`` is longer than a block. At most reach / size copies of a row are made."""
    rows = numbered(bars, size, by).withColumn("_home", F.floor(F.col("_pos") / size))
    far = F.floor((F.col("_pos") + reach) / size)
    last = rows.groupBy(*by).agg(F.max("_home").alias("_last"))  # a row a series
    spread = rows.join(last, list(by)).withColumn("_part", F.explode(F.sequence("_home", F.least(far, F.col("_last")))))
    return spread.withColumn("_own", F.col("_part") == F.col("_home")).drop("_home", "_last")


def halo_windows(bars: DataFrame, make: Callable[[Callable[[int, int], WindowSpec]], dict[str, Column]], reach: int, size: int = SIZE, by: tuple[str, ...] = KEY) -> DataFrame:
    """Columns over windows of at most ``reach`` rows back, block by block.

    ``make`` gets a function of the first and last offset (as in ``rowsBetween``) that gives the window, and
    gives the columns. One shuffle by series and block serves all of them; a null price or a repeated time
    counts as a row, as in the windows over whole series."""
    rows = with_halo(bars, reach, size, by)
    order = Window.partitionBy(*by, "_part").orderBy("_pos")
    found = rows.withColumns(make(lambda a, b: order.rowsBetween(a, b)))
    return found.where("_own").drop("_pos", "_part", "_own")


def rolling_halo(bars: DataFrame, size: int = SIZE) -> DataFrame:
    """The columns of ``rolling``: means, bands, swings, relative volume and efficiency, by blocks with a halo."""
    c, v = F.col("close"), F.col("volume")

    def make(w: Callable[[int, int], WindowSpec]) -> dict[str, Column]:
        over = lambda agg, x, n, least=None: F.when(F.count(x).over(w(1 - n, 0)) >= (least or n), agg(x).over(w(1 - n, 0)))
        ago = lambda x, k: F.first(x).over(w(-k, -k))
        mid, sd = over(F.avg, c, 20), over(F.stddev_pop, c, 20)
        out = {f"sma_{n}": over(F.avg, c, n) for n in (10, 20, 30, 50, 200)}
        out |= {"bb_upper": mid + 2 * sd, "bb_middle": mid, "bb_lower": mid - 2 * sd}
        out |= {"swing_high_20": over(F.max, F.col("high"), 20, 5), "swing_low_20": over(F.min, F.col("low"), 20, 5)}
        out |= {"rvol": v / F.nullif(over(F.avg, v, 20), F.lit(0.0)), "_moved": F.abs(c - ago(c, 1)), "_net": F.abs(c - ago(c, 10))}
        return out

    moved = with_halo(bars, 210, size)
    order = Window.partitionBy(*KEY, "_part").orderBy("_pos")
    first = moved.withColumns(make(lambda a, b: order.rowsBetween(a, b)))
    last10 = order.rowsBetween(-9, 0)
    path = F.when(F.count("_moved").over(last10) >= 10, F.sum("_moved").over(last10))
    return first.withColumn("ker", F.col("_net") / F.nullif(path, F.lit(0.0))).where("_own").drop("_pos", "_part", "_own", "_moved", "_net")


# ---------------------------------------------------------------- linear recurrences
def _scanned(names: list[str], keys: int):
    """Adds composed maps to rows sorted by group and time: ``_a_name``, ``_b_name`` become those from the group's first row on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[float, float]] = {}
        last: list | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in range(keys):
                column = batch.column(k)
                code = (column if pa.types.is_integer(column.type) else column.dictionary_encode(null_encoding="encode").indices).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = [batch.column(k)[0].as_py() for k in range(keys)]
            goes_on = first == last
            new[0] = not goes_on
            last = [batch.column(k)[n - 1].as_py() for k in range(keys)]
            group = np.cumsum(new)
            out = {}
            for name in names:
                a, b = (batch.column(batch.schema.get_field_index(f"_{x}_{name}")).to_numpy(zero_copy_only=False).astype(float) for x in "ab")
                a0, b0 = (held[name] if goes_on else (1.0, 0.0))
                whole_a, whole_b = _by_group(a, b, new)
                if goes_on:
                    mine = group == 0
                    whole_a[mine], whole_b[mine] = whole_a[mine] * a0, whole_a[mine] * b0 + whole_b[mine]
                held[name] = float(whole_a[-1]), float(whole_b[-1])
                out |= {f"_a_{name}": pa.array(whole_a), f"_b_{name}": pa.array(whole_b)}
            yield pa.RecordBatch.from_arrays([out.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return run


def _by_group(a: np.ndarray, b: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of the maps y -> a * y + b from each group's first row on, by doubling: maps are
    associative, so after k steps a row holds the composition of the last 2^k rows of its group."""
    a, b, step = a.copy(), b.copy(), 1
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    longest = int(place.max(initial=0)) + 1
    while step < longest:
        reach = np.flatnonzero(place >= step)
        left_a, left_b = a[reach - step].copy(), b[reach - step].copy()
        b[reach] += a[reach] * left_b
        a[reach] *= left_a
        step *= 2
    return a, b


def affine_scan(rows: DataFrame, maps: dict[str, tuple[Column, Column]], by: tuple[str, ...] = KEY, size: int = SIZE) -> DataFrame:
    """Adds each ``name``: y = a * y_before + b down the series, from y = 0 before its first row.

    Blocks compose their maps alone and in parallel (a vectorised prefix scan); a block's last row is its
    map as a whole. The maps of a series' blocks, a row each, are scanned the same way and give the
    value that enters each block; every row is then finished by one product. Null maps keep y as it is."""
    names = list(maps)
    made = {f"_{x}_{n}": F.coalesce(m.cast("double"), F.lit(1.0 if x == "a" else 0.0)) for n, pair in maps.items() for x, m in zip("ab", pair, strict=True)}
    rest = [c for c in rows.columns if c not in by and c != "_block"]
    blocked = (rows if "_block" in rows.columns else rows.withColumn("_block", time_block(size))).withColumns(made).select(*by, "_block", *rest, *made)
    scanned = blocked.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "ts").mapInArrow(_scanned(names, len(by) + 1), blocked.schema)
    ends = scanned.groupBy(*by, "_block").agg(F.max_by(F.struct(*made), "ts").alias("_end")).select(*by, F.col("_block").alias("ts"), *[F.col(f"_end.{m}").alias(m) for m in made])
    whole = ends.repartition(*by).sortWithinPartitions(*by, "ts").mapInArrow(_scanned(names, len(by)), ends.schema)
    enter = whole.select(*by, F.col("ts").alias("_block"), *[F.coalesce(F.lag(f"_b_{n}").over(Window.partitionBy(*by).orderBy("ts")), F.lit(0.0)).alias(f"_y_{n}") for n in names])
    met = scanned.join(enter, [*by, "_block"])
    return met.withColumns({n: F.col(f"_a_{n}") * F.col(f"_y_{n}") + F.col(f"_b_{n}") for n in names}).drop(*made, *[f"_y_{n}" for n in names])


def vwap_blocks(bars: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``vwap`` from the start of the series: two running sums, which are maps with a = 1."""
    price, one = (F.col("high") + F.col("low") + F.col("close")) / 3, F.lit(1.0)
    rows = affine_scan(bars, {"_traded": (one, price * F.col("volume")), "_volume": (one, F.col("volume"))}, size=size)
    return rows.withColumn("vwap", F.col("_traded") / F.nullif(F.col("_volume"), F.lit(0.0))).drop("_traded", "_volume", "_block")


def mean_map(x: Column, weight: float, first: Column) -> tuple[Column, Column]:
    """The map of an exponential mean that starts at its first value."""
    return F.when(first, 0.0).otherwise(1 - weight), F.when(first, x).otherwise(x * weight)


def recursive_blocks(bars: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``ema_12, ema_26, rsi_14, atr, adx, macd, macd_signal, macd_hist, kama`` by three scans of blocks.

    The same contract as ``recursive``: means start at the first value, columns are null before bar n."""
    rows = with_halo(bars, 10, size)
    order = Window.partitionBy(*KEY, "_part").orderBy("_pos")
    ago = lambda x, k=1: F.first(x).over(order.rowsBetween(-k, -k))
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    rows = rows.withColumns({"_pc": F.coalesce(ago("close"), c), "_up": F.coalesce(h - ago("high"), F.lit(0.0)), "_down": F.coalesce(ago("low") - low, F.lit(0.0)), "_c10": ago("close", 10)})
    rows = rows.withColumn("_step", F.abs(c - F.col("_pc")))
    rows = rows.withColumn("_path", F.sum("_step").over(order.rowsBetween(-9, 0))).where("_own")
    i, first = F.col("_pos") + 1, F.col("_pos") == 0
    d, up, down = c - F.col("_pc"), F.col("_up"), F.col("_down")
    tr = F.greatest(h - low, F.abs(h - F.col("_pc")), F.abs(low - F.col("_pc")))
    pick = F.coalesce(F.abs(c - F.col("_c10")) / F.nullif(F.col("_path"), F.lit(0.0)), F.lit(0.0))
    smooth = F.pow(pick * (2 / 3 - 2 / 31) + 2 / 31, F.lit(2.0))
    wilder = lambda x: mean_map(x, 1 / 14, first)
    maps = {
        "_e12": mean_map(c, 2 / 13, first), "_e26": mean_map(c, 2 / 27, first), "_gain": wilder(F.greatest(d, F.lit(0.0))), "_loss": wilder(F.greatest(-d, F.lit(0.0))), "_tr": wilder(tr),
        "_plus": wilder(F.when((up > down) & (up > 0), up).otherwise(0.0)), "_minus": wilder(F.when((down > up) & (down > 0), down).otherwise(0.0)),
        "_kama": (F.when(i < 10, 0.0).when(i == 10, 0.0).otherwise(1 - smooth), F.when(i < 10, 0.0).when(i == 10, c).otherwise(smooth * c)),
    }
    own = bars.columns
    rows = affine_scan(rows.select(*own, "_pos", "_pc", "_up", "_down", "_c10", "_path"), maps, size=size)
    share = lambda x: F.coalesce(100 * F.col(x) / F.nullif(F.col("_tr"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({"_p": share("_plus"), "_m": share("_minus"), "_macd": F.col("_e12") - F.col("_e26")})
    dx = F.coalesce(100 * F.abs(F.col("_p") - F.col("_m")) / F.nullif(F.col("_p") + F.col("_m"), F.lit(0.0)), F.lit(0.0))
    rows = affine_scan(rows.withColumn("_dx", dx), {"_adx": mean_map(F.col("_dx"), 1 / 14, first), "_signal": mean_map(F.col("_macd"), 2 / 10, first)}, size=size)
    since = lambda n, x: F.when(i >= n, x)
    return rows.select(
        *own, since(12, F.col("_e12")).alias("ema_12"), since(26, F.col("_e26")).alias("ema_26"), since(14, 100 * F.col("_gain") / F.nullif(F.col("_gain") + F.col("_loss"), F.lit(0.0))).alias("rsi_14"),
        since(14, F.col("_tr")).alias("atr"), since(28, F.col("_adx")).alias("adx"), since(26, F.col("_macd")).alias("macd"), since(34, F.col("_signal")).alias("macd_signal"),
        since(34, F.col("_macd") - F.col("_signal")).alias("macd_hist"), since(10, F.col("_kama")).alias("kama"),
    )


# ---------------------------------------------------------------- as-of joins
def asof_blocks(primary: DataFrame, slow: DataFrame, interval: str, columns: list[str] | None = None, by: tuple[str, ...] = ("symbol",), size: int = SIZE) -> DataFrame:
    """``asof.asof_join`` by time blocks: the same rows, but no task sorts a whole series.

    Both sides fall into blocks of time. Inside a block the last slow row is carried forward by a window; what
    stands before a block is the last slow row of the blocks before it, found over one row a block."""
    columns = columns or [c for c in slow.columns if c not in (*by, "source", "interval", "ts", *PRICES)]
    some = F.coalesce(*[F.col(c).cast("string") for c in columns])
    block = time_block(size)
    info = slow.where(some.isNotNull()).groupBy(*by, (F.col("ts") + _seconds(interval)).alias("ts")).agg(F.max_by(F.struct(*columns), "ts").alias("_slow"))
    primary_rows = primary.withColumns({"_slow": F.lit(None).cast(info.schema["_slow"].dataType), "_own": F.lit(1)})
    length = primary.select("interval").limit(1).collect()  # the blocks of both sides are those of the primary interval
    info = info.withColumn("interval", F.lit(length[0][0] if length else "1h")).withColumn("_own", F.lit(0))
    rows = primary_rows.unionByName(info, allowMissingColumns=True).withColumn("_block", block)
    ends = info.withColumn("_block", block).groupBy(*by, "_block").agg(F.max_by("_slow", "ts").alias("_end"))
    every = rows.select(*by, "_block").distinct().join(ends, [*by, "_block"], "left")
    carry = every.select(*by, "_block", F.last("_end", ignorenulls=True).over(_before(by)).alias("_carry"))
    inside = Window.partitionBy(*by, "_block").orderBy("ts", "_own").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_slow", F.last("_slow", ignorenulls=True).over(inside)).where("_own = 1").join(carry, [*by, "_block"])
    value = F.coalesce("_slow", "_carry")
    return found.withColumn("_slow", value).select(*primary.columns, *[F.col(f"_slow.{c}").alias(f"{c}_{interval}") for c in columns])


def chain_blocks(primary: DataFrame, slower: list[tuple[DataFrame, str]], by: tuple[str, ...] = ("symbol",), size: int = SIZE) -> DataFrame:
    """One blocked as-of join after the other; at most three slower timeframes."""
    if len(slower) > 3:
        raise ValueError("at most three slower timeframes")
    for frame, interval in slower:
        primary = asof_blocks(primary, frame, interval, by=by, size=size)
    return primary
