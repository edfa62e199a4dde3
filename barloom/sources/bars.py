"""Bars as DataFrames: sources, validity, upserts, scans and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.schema import KEY

#: Most rows of a page, and the usual number.
PAGE_MOST, PAGE_USUAL = 1000, 500


def ticks_to_bars(ticks: DataFrame, symbol: str, price: str, ts: str, unit: str, interval: str, source: str) -> DataFrame:
    """Bars of ``unit`` (hour, day, week) from ticks; partial aggregation runs before the shuffle."""
    t = F.col(ts)
    return (
        ticks.groupBy(F.upper(symbol).alias("symbol"), F.date_trunc(unit, t).cast("timestamp_ntz").alias("ts"))
        .agg(
            F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("volume"),
        )
        .select("symbol", F.lit(source).alias("source"), F.lit(interval).alias("interval"), "ts", "open", "high", "low", "close", "volume")
    )


def event_bars(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    """Bars of event values by event type, invalid ones left out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    return valid(ticks_to_bars(events, "event_type", "value", "ts", {"1h": "hour", "1d": "day", "1w": "week"}[interval], interval, "events"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of order totals by priority; equal times are ordered by key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    key = F.struct("o_orderdate", "o_orderkey")
    bars = orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("o_totalprice", key).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", key).alias("close"), F.count(F.lit(1)).alias("volume"),
    )
    return valid(bars.select("symbol", F.lit("orders").alias("source"), F.lit("1w").alias("interval"), "ts", "open", "high", "low", "close", "volume"))


def is_valid() -> Column:
    """High not under low, open and close positive, volume not negative (null passes)."""
    return (F.col("high") >= F.col("low")) & (F.col("open") > 0) & (F.col("close") > 0) & F.coalesce(F.col("volume") >= 0, F.lit(True))


def valid(bars: DataFrame) -> DataFrame:
    return bars.where(is_valid())


def rejected(bars: DataFrame) -> DataFrame:
    """Invalid bars with the first reason."""
    reason = (
        F.when(~F.coalesce(F.col("high") >= F.col("low"), F.lit(False)), "high_below_low")
        .when(~F.coalesce(F.col("open") > 0, F.lit(False)), "open_not_positive")
        .when(~F.coalesce(F.col("close") > 0, F.lit(False)), "close_not_positive")
        .when(F.col("volume") < 0, "volume_negative")
    )
    return bars.withColumn("reason", reason).where("reason IS NOT NULL")


def parse_candles(lines: DataFrame, source: str, interval: str, *, json_col: str = "json") -> DataFrame:
    """Bars from candle objects ``{s, t, o, h, l, c, v}`` (t in milliseconds); malformed ones are left out."""
    x = F.from_json(json_col, "s string, t long, o string, h string, l string, c string, v string")
    price = lambda k: F.expr(f"try_cast(x.{k} AS double)")
    return (
        lines.select(x.alias("x"))
        .select(
            F.upper("x.s").alias("symbol"), F.lit(source).alias("source"), F.lit(interval).alias("interval"), F.timestamp_millis("x.t").cast("timestamp_ntz").alias("ts"),
            price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), price("v").cast("long").alias("volume"),
        )
        .where("symbol IS NOT NULL AND ts IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    )


def normalise_quotes(raw: DataFrame, source: str, interval: str, zone: str) -> DataFrame:
    """Equity quotes with capitalised columns and local times as bars in UTC; a missing volume stays null."""
    c = {x.lower(): x for x in raw.columns}
    ts = F.to_utc_timestamp(F.col(c["date" if "date" in c else "datetime"]).cast("timestamp"), zone).cast("timestamp_ntz")
    return raw.select(
        F.upper(F.col(c["symbol"])).alias("symbol"), F.lit(source).alias("source"), F.lit(interval).alias("interval"), ts.alias("ts"),
        *[F.col(c[k]).cast("double").alias(k) for k in ("open", "high", "low", "close")], F.col(c["volume"]).cast("long").alias("volume"),
    )


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = (*KEY, "ts"), order: str | None = None) -> DataFrame:
    """Stored rows with new ones in their place by key; symbols in upper case; of several new rows
    of a key the one with the highest ``order`` wins. The newest row is an aggregate, not a sort."""
    mark = lambda df, k: df.withColumn("symbol", F.upper("symbol")).withColumn("_at", F.struct(F.lit(k).alias("k"), (F.col(order) if order else F.lit(0)).alias("o")))
    cols = stored.columns
    rows = mark(stored.withColumn(order, F.lit(None).cast(dict(new.dtypes)[order])) if order and order not in cols else stored, 0).unionByName(mark(new, 1), allowMissingColumns=True)
    rest = [c for c in cols if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_at")).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in cols])


def scan(bars: DataFrame, symbol: str | None = None, source: str | None = None, interval: str | None = None, start=None, end=None) -> DataFrame:
    """Bars of a series between two times, both included; every condition reaches the Parquet scan."""
    for column, value in (("symbol", symbol and symbol.upper()), ("source", source), ("interval", interval)):
        if value is not None:
            bars = bars.where(F.col(column) == value)
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return bars


def delete(bars: DataFrame, symbol: str, source: str | None = None, interval: str | None = None, before=None) -> DataFrame:
    """What stays when the bars of a symbol (of a source, interval, before a time) go."""
    gone = F.col("symbol") == symbol.upper()
    for column, value in (("source", source), ("interval", interval)):
        if value is not None:
            gone &= F.col(column) == value
    if before is not None:
        gone &= F.col("ts") < F.lit(before).cast("timestamp_ntz")
    return bars.where(~F.coalesce(gone, F.lit(False)))


def symbols(bars: DataFrame, source: str | None = None) -> DataFrame:
    return (bars.where(F.col("source") == source) if source else bars).select("symbol").distinct().orderBy("symbol")


def latest(bars: DataFrame) -> DataFrame:
    """The newest bar of each series."""
    rest = [c for c in bars.columns if c not in KEY]
    return bars.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "ts").alias("_row")).select(*KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])


def page(bars: DataFrame, number: int | None = None, size: int = PAGE_USUAL, *, order: str = "ts", keys: tuple[str, ...] = KEY) -> DataFrame:
    """A page of each series, counted from 1; without a number the last one. Sizes are held in 1..1000."""
    size = max(1, min(PAGE_MOST, size))
    w = Window.partitionBy(*keys)
    rows = bars.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("_all", F.count(F.lit(1)).over(w))
    pages = F.greatest(F.ceil(F.col("_all") / size), F.lit(1))
    at = pages if number is None else F.least(F.lit(max(1, number)), pages)
    return rows.where((F.col("_n") > (at - 1) * size) & (F.col("_n") <= at * size)).drop("_n", "_all")


def tail(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(F.col("ts").desc())
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def metadata(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEY).agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def describe(frame: DataFrame) -> DataFrame:
    """Null counts of all columns as ``column, nulls``, in one aggregate."""
    counts = frame.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in frame.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in frame.columns])
    return counts.select(F.explode(pairs).alias("x")).select("x.column", "x.nulls")


def search(frame: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows in which one of the columns holds the text, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return frame.where(hit)


def symbol_info(bars: DataFrame, info: DataFrame) -> DataFrame:
    """The newest bar of each series with what is known of its symbol."""
    return latest(bars).join(info, "symbol", "left")


def derivatives_between(rows: DataFrame, symbol: str, start, end) -> DataFrame:
    """Half open, unlike bars: from ``start`` up to but without ``end``."""
    return rows.where((F.col("symbol") == symbol.upper()) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def with_annual_funding(rows: DataFrame, per_day: int = 3) -> DataFrame:
    return rows.withColumn("funding_rate_annualised", F.col("funding_rate") * (per_day * 365))


def resample(bars: DataFrame, interval: str, unit: str) -> DataFrame:
    """Bars of a longer interval from shorter ones."""
    return (
        bars.groupBy("symbol", "source", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("at"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", "source", F.lit(interval).alias("interval"), F.col("at").alias("ts"), "open", "high", "low", "close", "volume")
    )


