"""Trade simulation: one ordered pass over a series, many series and runs in parallel.

Conditions without memory, stop and target prices are columns that Catalyst computes. The kernel
keeps what depends on the position: pending orders, fills, exits inside a bar, cash, and crossing
rules, whose memory holds the last pair that was looked at. A group is one series of one run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans import formula
from barloom.plans.strategy import Strategy, risk_prices, types_of
from barloom.schema import KEY

USUAL_SIZE = 100.0


@dataclass(frozen=True)
class Execution:
    """How orders fill and what they cost."""

    cash: float = 10_000.0
    commission_pct: float = 0.0
    slippage_pct: float = 0.0
    leverage: float = 1.0
    risk_per_trade: float = 0.02
    scale_risk: bool = False
    cap_explicit_size: bool = True
    reject_oversized: bool = False
    allow_negative_cash: bool = False
    borrow_fee_annual_pct: float = 0.0
    size: float | None = None


@dataclass
class Position:
    size: float = 0.0
    price: float = 0.0
    since: Any = None
    stop: float = 0.0
    target: float = 0.0
    fee: float = 0.0
    held: int = 0


class Account:
    """Cash, the open position, and what has been traded."""

    def __init__(self, how: Execution):
        self.how, self.cash, self.at = how, how.cash, Position()
        self.trades: list[dict] = []
        self.notes: list[tuple] = []
        self.slippage = self.commission = self.borrow = 0.0

    def liquidation(self, price: float, sign: int) -> float:
        return price * (1 - sign / self.how.leverage)

    def enter(self, sign: int, raw: float, stop: float, target: float, ts: Any) -> None:
        how = self.how
        price = raw * (1 + sign * how.slippage_pct)
        if stop > 0 and (sign * (price - stop) <= 0 or (how.leverage > 1 and sign * (stop - self.liquidation(price, sign)) <= 0)):
            self.notes.append((ts, "stop_beyond_entry"))
            return
        size, note = self._sized(price, stop)
        if note:
            self.notes.append((ts, note))
        if not size:
            return
        fee = size * price * how.commission_pct
        self.commission += fee
        self.slippage += abs(price - raw) * size
        self.cash -= sign * size * price + fee
        self.at = Position(sign * size, price, ts, stop, target, fee)

    def _sized(self, price: float, stop: float) -> tuple[float, str | None]:
        """Units to trade, 0 for none, and a note where cash or the order's own size limits them."""
        how, risk = self.how, abs(price - stop)
        wanted = how.size if (how.size or 0.0) > 0 else None
        if wanted is None:
            factor = max(how.leverage, 1.0) if how.scale_risk else 1.0
            wanted = self.cash * how.risk_per_trade * factor / risk if stop > 0 and risk > 0.001 else USUAL_SIZE
        if how.allow_negative_cash or price <= 0:
            return wanted, None
        unit_cost = price * (1 + max(how.commission_pct, 0.0))
        affordable = max(0.0, self.cash * how.leverage / unit_cost)
        if not affordable:
            return 0.0, "insufficient_cash"
        if wanted <= affordable:
            return wanted, None
        fixed = bool(how.size) and (how.reject_oversized or not how.cap_explicit_size)
        return (0.0, "explicit_size_rejected") if fixed else (affordable, "affordability_cap")

    def leave(self, raw: float, ts: Any, reason: str) -> None:
        p, how = self.at, self.how
        sign, n = (1 if p.size > 0 else -1), abs(p.size)
        price = raw * (1 - sign * how.slippage_pct)
        fee = n * price * how.commission_pct
        days = max(0, (pd.Timestamp(ts).date() - pd.Timestamp(p.since).date()).days)
        borrow = n * p.price * how.borrow_fee_annual_pct * days / 365.0 if sign < 0 else 0.0
        gross = sign * (price - p.price) * n
        net = gross - p.fee - fee - borrow
        self.commission += fee
        self.slippage += abs(price - raw) * n
        self.borrow += borrow
        self.cash += sign * n * price - fee - borrow
        self.trades.append({
            "entry_ts": p.since, "exit_ts": ts, "entry_price": round(p.price, 8), "exit_price": round(price, 8), "size": n, "gross_pnl": round(gross, 2), "pnl": round(net, 2),
            "entry_commission": round(p.fee, 2), "exit_commission": round(fee, 2), "borrow_cost": round(borrow, 2), "pnl_pct": round(net / (p.price * n), 4) if p.price > 0 and n > 0 else 0.0,
            "duration_bars": p.held, "direction": "long" if sign > 0 else "short", "exit_reason": reason,
        })
        self.at = Position()

    def inside(self, o: float, h: float, low: float) -> tuple[float, str] | None:
        """What ends the position inside a bar: liquidation, gaps, stop, target, in that order."""
        p = self.at
        sign = 1 if p.size > 0 else -1
        worst, best = (low, h) if sign > 0 else (h, low)
        if self.how.leverage > 1 and sign * (worst - (liq := self.liquidation(p.price, sign))) <= 0:
            return liq, "liquidation"
        if p.stop > 0 and sign * (o - p.stop) <= 0:
            return o, "stop_loss_gap"
        if p.target > 0 and sign * (o - p.target) >= 0:
            return o, "take_profit_gap"
        if p.stop > 0 and sign * (worst - p.stop) <= 0:
            return p.stop, "stop_loss"
        if p.target > 0 and sign * (best - p.target) >= 0:
            return p.target, "take_profit"
        return None

    def value(self, close: float) -> float:
        return self.cash + self.at.size * close


Rule = Callable[[int, dict], bool]


def rule(tree: Any, frame: pd.DataFrame) -> Rule:
    """A function of the bar's number and the memory of crossings. All members of a group are looked at."""
    kind, what = tree
    if kind == "custom":
        return _asked(frame, *what)
    if kind == "column":
        flags = frame[what].to_numpy(bool)
        return lambda i, memory: bool(flags[i])
    if kind == "cross":
        key, left, right, above = what
        x, y = frame[left].to_numpy(float), frame[right].to_numpy(float)

        def crossed(i: int, memory: dict) -> bool:
            if np.isnan(x[i]) or np.isnan(y[i]):
                return False
            before, memory[key] = memory.get(key), (x[i], y[i])
            if before is None:
                return False
            return bool(before[0] <= before[1] and x[i] > y[i]) if above else bool(before[0] >= before[1] and x[i] < y[i])

        return crossed
    parts = [rule(t, frame) for t in what]
    if kind == "not":
        return lambda i, memory: not parts[0](i, memory)
    join = all if kind == "all" else any
    return lambda i, memory: join([p(i, memory) for p in parts])


def _asked(frame: pd.DataFrame, make: Callable[[], Any], want: str) -> Rule:
    """A rule that asks a strategy object; its answer of a bar is kept for the other rules of that bar."""

    def look(i: int, memory: dict) -> bool:
        if "strategy" not in memory:
            memory["strategy"], memory["own"] = make(), {}
        if memory.get("asked") != i:
            memory["asked"], memory["answer"] = i, memory["strategy"].on_bar(i, frame, memory["own"])
        answer = memory["answer"]
        if want == "exit" or answer in (None, "exit"):
            return want == "exit" and answer == "exit"
        side, stop, target = answer
        if side == want:
            memory["levels"] = float(stop or 0.0), float(target or 0.0)
        return side == want

    return look


class Run:
    """A run that can go on: account, pending orders, the memory of crossings and the peak so far."""

    def __init__(self, how: Execution):
        self.account, self.memory, self.peak = Account(how), {}, how.cash
        self.leaving, self.entry = False, None

    def bars(self, frame: pd.DataFrame, sides: dict[str, tuple], last: bool) -> pd.DataFrame:
        """The next bars of the series, sorted by time; with ``last`` an open position ends at the last close.

        Within a bar: a pending exit, then a pending entry at the open; exits inside the bar; the rules
        at the close, whose orders fill at the next open; the mark at the close."""
        account, memory, how = self.account, self.memory, self.account.how
        memory.pop("asked", None)
        o, h, low, c = (frame[x].to_numpy(float) for x in ("open", "high", "low", "close"))
        ts = frame["ts"].to_list()
        risk = {s: (frame[f"{s}_stop"].to_numpy(float), frame[f"{s}_target"].to_numpy(float)) for s in sides}
        leave, enter = self.leaving, self.entry
        values, sizes = np.empty(len(c)), np.empty(len(c))
        for i in range(len(c)):
            if leave and account.at.size:
                account.leave(o[i], ts[i], "signal")
            leave = False
            if enter and not account.at.size:
                account.enter(*enter[:1], o[i], *enter[1:], ts[i])
            enter = None
            if account.at.size:
                account.at.held += 1
                if hit := account.inside(o[i], h[i], low[i]):
                    account.leave(hit[0], ts[i], hit[1])
            if account.at.size:
                own = sides.get("long" if account.at.size > 0 else "short")
                leave = bool(own and own[1] and own[1](i, memory))
            else:
                for side in ("long", "short"):
                    if side in sides and sides[side][0](i, memory):
                        stop, target = memory.pop("levels", None) or (float(np.nan_to_num(x[i])) for x in risk[side])
                        enter = (1 if side == "long" else -1, stop, target)
                        break
            if last and i == len(c) - 1 and account.at.size:
                account.leave(c[i], ts[i], "end_of_backtest")
            values[i], sizes[i] = account.value(c[i]), account.at.size
        self.leaving, self.entry = leave, enter
        peak = np.maximum.accumulate(np.maximum(values, self.peak)) if len(values) else values
        if len(peak):
            self.peak = float(peak[-1])
        return pd.DataFrame({"ts": ts, "close": c, "value": values, "drawdown": np.where(peak > 0, (peak - values) / peak, 0.0), "position": sizes})


def simulate(frame: pd.DataFrame, sides: dict[str, tuple], how: Execution) -> tuple[Account, pd.DataFrame]:
    """One run over a whole series sorted by time. ``sides``: direction -> (entry rule, exit rule or None);
    the frame has ``{side}_stop`` and ``{side}_target`` of each bar."""
    run = Run(how)
    return run.account, run.bars(frame, sides, True)


TRADE = [
    ("entry_ts", T.TimestampNTZType()), ("exit_ts", T.TimestampNTZType()), *[(n, T.DoubleType()) for n in ("entry_price", "exit_price", "size", "gross_pnl", "pnl", "entry_commission", "exit_commission", "borrow_cost", "pnl_pct")],
    ("duration_bars", T.LongType()), ("direction", T.StringType()), ("exit_reason", T.StringType()),
]
EQUITY = [("ts", T.TimestampNTZType()), ("close", T.DoubleType()), ("value", T.DoubleType()), ("drawdown", T.DoubleType()), ("position", T.DoubleType())]


def _tree(cond: dict, types: dict[str, str], columns: dict, keys: dict, say: Callable[[Any], str]) -> tuple:
    """The kernel's tree of a condition: parts without crossings become one column each. ``keys``: what each column is."""
    if not any(x["operator"] in formula.CROSSES for x in formula.leaves(cond)):
        name = f"_rule{len(columns)}"
        columns[name], keys[name] = formula.condition(cond, types), say(cond)
        return "column", name
    for key in ("all", "any"):
        if key in cond:
            plain = [x for x in cond[key] if not any(y["operator"] in formula.CROSSES for y in formula.leaves(x))]
            rest = [x for x in cond[key] if x not in plain]
            return key, ([_tree({key: plain}, types, columns, keys, say)] if plain else []) + [_tree(x, types, columns, keys, say) for x in rest]
    if "not" in cond:
        return "not", [_tree(cond["not"], types, columns, keys, say)]
    names = []
    for side in ("left", "right"):
        names.append(name := f"_rule{len(columns)}")
        columns[name], keys[name] = formula.operand(cond[side], types)[0].cast("double"), say([cond[side]])
    return "cross", (f"{cond['left']}:{cond['right']}:{cond['operator']}", *names, cond["operator"] == "crosses_above")


def signals(strategy: Strategy, prepared: DataFrame) -> tuple[dict[str, tuple], dict]:
    """Rule trees of each side, and the columns that they and the kernel read (stops, targets, ``_ready``)."""
    sides, columns, _ = keyed_signals(strategy, prepared)
    return sides, columns


def keyed_signals(strategy: Strategy, prepared: DataFrame) -> tuple[dict[str, tuple], dict, dict[str, str]]:
    """``signals`` and, of each column, a text that says what it is: columns of two runs with one text are the same."""
    types, columns, keys, say = types_of(prepared), {}, {}, strategy.meaning
    tree = lambda c: _tree(c, types, columns, keys, say)
    sides = {s: (tree(x["entry"]), tree(x["exit"]) if x.get("exit") else None) for s, x in strategy.sides.items()}
    for s in sides:
        columns[f"{s}_stop"], columns[f"{s}_target"] = risk_prices(strategy, s)
        keys[f"{s}_stop"] = say([s, "stop", strategy.risk["stop_loss"]])
        keys[f"{s}_target"] = say([s, "target", strategy.risk["take_profit"], strategy.risk["stop_loss"]])
    columns["_ready"] = F.lit(True)
    needed = [n for n in strategy.required() if n in prepared.columns]
    for n in needed:
        columns["_ready"] &= F.col(n).isNotNull()
    keys["_ready"] = say(["ready", *needed])
    return sides, columns, keys


def run(strategy: Strategy, prepared: DataFrame, how: Execution | dict[str, Execution] = Execution(), *, by: tuple[str, ...] = KEY, skip_warm_up: bool = True) -> DataFrame:  # noqa: B008
    """Rows ``kind`` = equity, trade or note of every group of ``prepared`` (``plans.strategy.prepare``).

    With ``skip_warm_up`` a run starts at the first bar on which all required columns have a value.
    ``how`` may differ by symbol."""
    sides, columns = signals(strategy, prepared)
    rows = prepared.withColumns(columns).select(*by, "ts", "open", "high", "low", "close", *columns)
    return run_rows(rows, lambda keys: sides, how, by=by, skip_warm_up=skip_warm_up)


def result_schema(rows: DataFrame, by: tuple[str, ...]) -> T.StructType:
    return T.StructType([*[rows.schema[k] for k in by], T.StructField("kind", T.StringType()), *[T.StructField(n, t) for n, t in EQUITY + TRADE], T.StructField("code", T.StringType())])


def result_rows(parts: dict[str, pd.DataFrame], keys: dict, schema: T.StructType) -> pd.DataFrame:
    """Rows of a result by kind; kinds without rows are left out."""
    out = pd.concat([p.assign(kind=k) for k, p in parts.items() if len(p) or k == "equity"], ignore_index=True).assign(**keys).reindex(columns=schema.names)
    kinds = {f.name: object if isinstance(f.dataType, T.StringType) else "datetime64[us]" for f in schema.fields if isinstance(f.dataType, (T.StringType, T.TimestampNTZType))}
    return out.astype(kinds)


def run_rows(rows: DataFrame, sides_of: Callable[[dict], dict[str, tuple]], how: Execution | dict[str, Execution], *, by: tuple[str, ...], skip_warm_up: bool = True) -> DataFrame:
    """``run`` over rows that hold the columns of ``signals``; ``sides_of`` gives the rule trees of a group's keys.

    A group is one series of one run and is held by one task: some hundred bytes a bar, so a million bars fit."""
    schema = result_schema(rows, by)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        keys = {k: frame[k].iloc[0] for k in by}
        if skip_warm_up:
            good = np.flatnonzero(frame["_ready"].to_numpy(bool))
            frame = frame.iloc[good[0] :].reset_index(drop=True) if len(good) else frame.iloc[:0]
        own = how.get(keys.get("symbol"), Execution()) if isinstance(how, dict) else how
        account, equity = simulate(frame, {s: (rule(a, frame), rule(b, frame) if b else None) for s, (a, b) in sides_of(keys).items()}, own)
        return result_rows({"equity": equity, "trade": pd.DataFrame(account.trades), "note": pd.DataFrame(account.notes, columns=["ts", "code"])}, keys, schema)

    return rows.groupBy(*by).applyInPandas(kernel, schema)


def run_custom(make: Callable[[], Any], prepared: DataFrame, how: Execution = Execution(), *, by: tuple[str, ...] = KEY) -> DataFrame:  # noqa: B008
    """``run`` for a strategy that is an object: ``make()`` gives one for each group, with ``on_bar(i, frame, memory)``
    that returns ``None``, ``"exit"`` or ``(side, stop, target)`` at the close of bar i. Orders fill at the next open."""
    rows = prepared.withColumns({"_ready": F.lit(True), **{f"{s}_{p}": F.lit(0.0) for s in ("long", "short") for p in ("stop", "target")}})
    sides = {side: (("custom", (make, side)), ("custom", (make, "exit"))) for side in ("long", "short")}
    return run_rows(rows, lambda keys: sides, how, by=by, skip_warm_up=False)


def equity(result: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    return result.where("kind = 'equity'").select(*by, *[n for n, _ in EQUITY])


def trades(result: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    return result.where("kind = 'trade'").select(*by, *[n for n, _ in TRADE])


def notes(result: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    return result.where("kind = 'note'").select(*by, "ts", "code")


def validate(bars: DataFrame, columns: list[str]) -> DataFrame:
    """One pass over each series: the first fault, and its warm-up (first bar with all ``columns``, gaps after it)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("ts")
    complete = F.lit(True)
    for n in columns:
        complete &= F.col(n).isNotNull()
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rows = bars.withColumns({"_i": F.row_number().over(w), "_again": F.coalesce(F.lag("ts").over(w) == F.col("ts"), F.lit(False)), "_full": complete})
    first = F.min(F.when(F.col("_full"), F.col("_i")))
    out = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(o.isNull() | h.isNull() | low.isNull() | c.isNull()).alias("missing"), F.count_if("_again").alias("repeated"),
        F.count_if(F.least(o, h, low, c) <= 0).alias("not_positive"), F.count_if((h < F.greatest(o, low, c)) | (low > F.least(o, h, c))).alias("not_enclosing"),
        first.alias("first_ready"), F.count_if(F.col("_full")).alias("ready"),
    )
    fault = F.when(F.col("missing") > 0, "missing_prices").when(F.col("repeated") > 0, "repeated_times").when(F.col("not_positive") > 0, "not_positive").when(F.col("not_enclosing") > 0, "high_low_not_enclosing")
    return out.select(*KEY, "bars", fault.alias("fault"), (F.col("first_ready") - 1).alias("warm_up_bars"), (F.col("bars") - F.col("first_ready") + 1 - F.col("ready")).alias("gaps_after"))
