"""The trade kernel on a stream: a keyed state for each series of each run.

A series' account, open position, pending orders, the memory of its crossing rules and its peak are one state
in Spark's state store. Bars come in batches cut in any way; each batch goes on where the last one of that
series stopped, so the trades are those of the batch kernel over all bars. What can't be known in a stream, which bar
is the last, is told with every batch: rows of kind ``open`` and ``close`` say what closing at that batch's last bar gives.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.operators import backtest
from barloom.operators.backtest import Execution, Run, result_rows, result_schema, rule
from barloom.plans.strategy import Strategy
from barloom.schema import KEY

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TradeProcessor(StatefulProcessor):
    """Goes on with each series' run; the state is the pickled run and the time of its last bar."""

    def __init__(self, sides: dict, how: Execution | dict[str, Execution], by: tuple[str, ...], columns: list[str], skip_warm_up: bool, schema: T.StructType):
        self.sides, self.how, self.by, self.columns, self.skip, self.schema = sides, how, by, columns, skip_warm_up, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", T.StructType([T.StructField("run", T.BinaryType()), T.StructField("last", T.TimestampNTZType()), T.StructField("started", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        keys = dict(zip(self.by, key, strict=True))
        frame = pd.concat(list(rows), ignore_index=True).set_axis(self.columns, axis=1)  # names with a leading _ don't reach here; a batch's bars of one series
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        own = self.how.get(keys.get("symbol"), Execution()) if isinstance(self.how, dict) else self.how
        run, last, started = Run(own), None, not self.skip
        if self.state.exists():
            held = self.state.get()
            run, last, started = pickle.loads(bytes(held[0])), held[1], held[2]
        late = frame[frame["ts"] <= pd.Timestamp(last)] if last is not None else frame.iloc[:0]
        frame = frame.iloc[len(late) :].reset_index(drop=True)
        newest = frame["ts"].iloc[-1].to_pydatetime() if len(frame) else last
        if not started and len(frame):
            ready = frame["_ready"].to_numpy(bool)
            started = bool(ready.any())
            frame = frame.iloc[int(ready.argmax()) if started else len(frame) :].reset_index(drop=True)
        sides = {s: (rule(a, frame), rule(b, frame) if b else None) for s, (a, b) in self.sides.items()}
        parts = {"equity": run.bars(frame, sides, False), "trade": pd.DataFrame(run.account.trades)}
        notes = [*run.account.notes, *[(t, "late_bar") for t in late["ts"]]]
        parts["note"] = pd.DataFrame(notes, columns=["ts", "code"])
        run.account.trades, run.account.notes = [], []
        if len(frame):
            end = copy.deepcopy(run.account)
            if end.at.size:
                end.leave(float(frame["close"].iloc[-1]), frame["ts"].iloc[-1], "end_of_backtest")
            value = end.value(float(frame["close"].iloc[-1]))
            parts["close"] = parts["equity"].tail(1).assign(value=value, drawdown=(max(run.peak, value) - value) / max(run.peak, value) if max(run.peak, value) > 0 else 0.0, position=0.0)
            parts["open"] = pd.DataFrame(end.trades)
        if newest is not None:
            self.state.update((pickle.dumps(run), newest, started))
        yield result_rows(parts, keys, self.schema)

    def close(self) -> None:
        pass


def run_stream(strategy: Strategy, prepared: DataFrame, how: Execution | dict[str, Execution] = Execution(), *, by: tuple[str, ...] = KEY, skip_warm_up: bool = True) -> DataFrame:  # noqa: B008
    """``backtest.run`` over a stream of prepared bars: rows of kinds equity, trade and note as they come, and with each
    batch of a series ``close`` and ``open`` rows, which hold if no bar follows.

    Bars of a series must come in order from batch to batch, in any order inside one; a bar that is not later than
    the last one handled is left out with the note ``late_bar``. The session needs the RocksDB state store."""
    sides, columns = backtest.signals(strategy, prepared)
    rows = prepared.withColumns(columns).select(*by, "ts", "open", "high", "low", "close", *columns)
    schema = result_schema(rows, by)
    return rows.groupBy(*by).transformWithStateInPandas(TradeProcessor(sides, how, by, rows.columns, skip_warm_up, schema), schema, "Append", "None")


def settled(result: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """The stored rows of a stream as those of ``backtest.run``: positions that are open after the last bar are closed at it."""
    w = Window.partitionBy(*by)
    moment = F.when(F.col("kind") == "open", F.col("exit_ts")).otherwise(F.col("ts"))
    rows = result.withColumn("_at", moment).withColumn("_end", F.max(F.when(F.col("kind") == "close", F.col("ts"))).over(w))
    last = F.col("_at") == F.col("_end")
    rows = rows.where(F.when(F.col("kind").isin("open", "close"), last).when(F.col("kind") == "equity", ~last).otherwise(F.lit(True)))
    named = F.when(F.col("kind") == "open", "trade").when(F.col("kind") == "close", "equity").otherwise(F.col("kind"))
    return rows.withColumn("kind", named).drop("_at", "_end")
