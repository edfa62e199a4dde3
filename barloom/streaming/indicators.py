"""Indicators of a stream of bars as they close, with timers by watermark.

Bars may come late and out of order within the watermark's delay: each waits in the state, by its time, until a
timer says that nothing before it can come any more, and is then folded into the series' means and session sums.
What a series needs from its past is a few numbers, whatever its length; a series without bars for ``idle``
is forgotten by the same kind of timer and starts anew.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.schema import BARS, KEY

COLUMNS = ("ema_12", "ema_26", "macd", "rsi_14", "atr", "vwap_session", "ib_high", "ib_low")


@dataclass
class Past:
    """All that a series carries from bar to bar."""

    bars: int = 0
    last: int = 0
    close: float = 0.0
    e12: float = 0.0
    e26: float = 0.0
    gain: float = 0.0
    loss: float = 0.0
    tr: float = 0.0
    day: int = -1
    traded: float = 0.0
    volume: float = 0.0
    ib_high: float = 0.0
    ib_low: float = 0.0

    def step(self, day: int, h: float, low: float, c: float, v: float) -> tuple:
        """Takes one bar in and gives its columns (null before bar n, as in the batch columns)."""
        first, before = self.bars == 0, c if self.bars == 0 else self.close
        tr, d = max(h - low, abs(h - before), abs(low - before)), c - before
        mean = lambda old, x, a: x if first else old + (x - old) * a
        self.e12, self.e26 = mean(self.e12, c, 2 / 13), mean(self.e26, c, 2 / 27)
        self.gain, self.loss, self.tr = mean(self.gain, max(d, 0.0), 1 / 14), mean(self.loss, max(-d, 0.0), 1 / 14), mean(self.tr, tr, 1 / 14)
        if day != self.day:
            self.day, self.traded, self.volume, self.ib_high, self.ib_low = day, 0.0, 0.0, h, low
        self.bars, self.close = self.bars + 1, c
        self.traded, self.volume = self.traded + (h + low + c) / 3 * v, self.volume + v
        since = lambda n, x: x if self.bars >= n else None
        moved = self.gain + self.loss
        return (
            since(12, self.e12), since(26, self.e26), since(26, self.e12 - self.e26), since(14, 100 * self.gain / moved if moved else None), since(14, self.tr),
            self.traded / self.volume if self.volume else None, self.ib_high, self.ib_low,
        )


_KINDS = {int: T.LongType(), float: T.DoubleType()}
_PAST = T.StructType([T.StructField(k, _KINDS[type(v)]) for k, v in asdict(Past()).items()])
_BAR = T.StructType([T.StructField("bar", T.ArrayType(T.DoubleType()))])
_AT = T.StructType([T.StructField("at", T.LongType())])
OUT = T.StructType([*BARS.fields, *[T.StructField(c, T.DoubleType()) for c in COLUMNS]])


class IndicatorProcessor(StatefulProcessor):
    """States of a series: its past, the bars that wait by time (microseconds), and when it was last heard of."""

    def __init__(self, idle: dt.timedelta):
        self.idle = int(idle / dt.timedelta(milliseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", _PAST)
        self.waiting = handle.getMapState("waiting", _AT, _BAR)
        self.heard = handle.getValueState("heard", _AT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, first = self.heard.get()[0] if self.heard.exists() else 0, None
        for part in rows:
            for at, *bar in zip(part["at"], *[part[c] for c in ("open", "high", "low", "close", "volume")], strict=True):
                self.waiting.updateValue((int(at),), ([float(x) for x in bar],))  # a bar that comes again replaces the one that waits
                last, first = max(last, int(at) // 1000), int(at) // 1000 if first is None else min(first, int(at) // 1000)
        self.heard.update((last,))
        self.handle.registerTimer(first - 1)  # a timer fires once the watermark is beyond it
        self.handle.registerTimer(last + self.idle)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Folds the bars whose time has come, in order, and forgets a series that has been silent."""
        now = timerValues.getCurrentWatermarkInMs()
        all_ = sorted(at for (at,) in self.waiting.keys())
        ready = [at for at in all_ if at // 1000 <= now]
        if len(ready) < len(all_):
            self.handle.registerTimer(all_[len(ready)] // 1000 - 1)
        past, out = Past(*self.past.get()) if self.past.exists() else Past(), []
        for at in ready:
            bar = list(self.waiting.getValue((at,))[0])
            if past.bars and at // 1000 - past.last >= self.idle:  # the silence counts, whether a batch came in it or not
                past = Past()
            past.last = at // 1000
            out.append((*key, at, *bar, *past.step(at // 86_400_000_000, *bar[1:])))
            self.waiting.removeKey((at,))
        if ready:
            self.past.update(tuple(asdict(past).values()))
        elif not all_ and self.heard.exists() and self.heard.get()[0] + self.idle <= now:
            for state in (self.past, self.waiting, self.heard):
                state.clear()
        frame = pd.DataFrame(out, columns=OUT.names)
        frame["ts"] = pd.to_datetime(frame["ts"], unit="us").astype("datetime64[us]")
        yield frame.astype({"volume": "Int64"} | dict.fromkeys(COLUMNS, "float64"))

    def close(self) -> None:
        pass


def indicator_stream(bars: DataFrame, late: str = "0 seconds", idle: dt.timedelta = dt.timedelta(days=365)) -> DataFrame:
    """``COLUMNS`` of a stream of bars, each row once its bar is older than the watermark (``late`` behind the newest).

    A bar that comes later than that is left out by the watermark. A missing volume counts as 0. The columns
    are those of the batch operators; the session needs the RocksDB state store."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = bars.select(*KEY, "open", "high", "low", "close", F.coalesce("volume", F.lit(0)).alias("volume"), at.alias("at"), F.col("ts").cast("timestamp").alias("moment"))
    return rows.withWatermark("moment", late).groupBy(*KEY).transformWithStateInPandas(IndicatorProcessor(idle), OUT, "Append", "EventTime")
