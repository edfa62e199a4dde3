"""Strategy documents (JSON or YAML): parsing, checks, and their place in a plan."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import price
from barloom.operators.asof import PRICES, asof_join
from barloom.operators.rolling import rolling
from barloom.plans import formula, registry
from barloom.schema import SECONDS, lag

#: Most parameters, indicators, features, depth of conditions and slower timeframes.
LIMITS = {"parameters": 20, "indicators": 20, "features": 20}
DEPTH, INFORMATIVE = 5, 3
#: How sure a signal is where the document doesn't say.
CONFIDENCE = 0.7
FEATURES = ("rolling_max", "rolling_min", "rolling_mean", "rolling_std", "body_pct", "range_pct", "typical_price", "ohlc4", "shift", "formula")
STOPS, TARGETS = ("none", "atr", "fixed_pct"), ("none", "atr", "fixed_pct", "risk_reward")
_SLOT = re.compile(r"^\s*\{\{\s*(\w+)\s*\}\}\s*$")
_TYPES = {"int": int, "float": (int, float), "bool": bool, "string": str}


class StrategyError(ValueError):
    """All faults of a document as (path, message)."""

    def __init__(self, errors: list[tuple[str, str]]):
        super().__init__("; ".join(f"{p}: {m}" for p, m in errors))
        self.errors = errors


@dataclass(frozen=True)
class Strategy:
    name: str
    description: str
    parameters: dict[str, Any]
    primary: str | None
    informative: dict[str, str]
    indicators: list[dict]
    features: list[dict]
    sides: dict[str, dict]
    risk: dict[str, dict]
    metadata: dict
    warnings: list[str] = field(default_factory=list)
    declared: dict[str, dict] = field(default_factory=dict)
    confidence: dict[str, dict[str, float]] = field(default_factory=dict)

    def columns(self) -> dict[str, str | list[str]]:
        """Alias of each indicator: its column, or the columns that stand in for each other."""
        return {i["name"]: i["columns"] for i in self.indicators}

    def required(self) -> list[str]:
        """Columns that rules, formulas and risk read; all else may be pruned."""
        feature = {f["name"]: f for f in self.features}
        need: list[str] = ["open", "high", "low", "close"]

        def name(n: str) -> None:
            if n in feature:
                if n not in need:
                    need.append(n)
                    walk(feature[n].get("expr", feature[n].get("source")))
            else:
                need.extend(self.columns().get(n, [n]))

        def walk(x: Any) -> None:
            if isinstance(x, str):
                name(x)
            elif isinstance(x, dict):
                for k, v in x.items():
                    if k not in ("op", "operator", "label", "kind"):
                        walk(v)
            elif isinstance(x, list):
                for v in x:
                    walk(v)

        for side in self.sides.values():
            for part in ("entry", "exit"):
                for c in formula.leaves(side[part]) if side.get(part) else ():
                    walk({k: c[k] for k in ("left", "right") if k in c})
        for part in self.risk.values():
            if part["type"] == "atr":
                name(part["indicator"])
        return list(dict.fromkeys(need))

    def meaning(self, x: Any) -> str:
        """A text of a condition, operand or risk in which names stand for what they are, whatever they are called."""
        feature, columns = {f["name"]: f for f in self.features}, self.columns()

        def walk(x: Any, at: tuple[str, ...] = ()) -> Any:
            if isinstance(x, str):
                if x in feature and x not in at:
                    own = {"source": "close", "shift": 0} | {k: v for k, v in feature[x].items() if k != "name"}
                    return {"feature": {k: v if k == "type" else walk(v, (*at, x)) for k, v in own.items()}}
                return {"first_of": columns[x]} if x in columns and columns[x] != [x] else x
            if isinstance(x, dict):
                return {k: v if k in ("op", "operator", "type") else walk(v, at) for k, v in x.items()}
            return [walk(v, at) for v in x] if isinstance(x, list) else x

        return json.dumps(walk(x), sort_keys=True, default=str)

    def normalised(self) -> dict:
        return {
            "schema_version": "2.0", "name": self.name, "description": self.description, "parameters": {n: {**self.declared.get(n, {}), "default": v} for n, v in self.parameters.items()},
            "timeframes": {"primary": self.primary, "informative": [{"alias": a, "interval": i} for a, i in self.informative.items()]},
            "indicators": self.indicators, "features": self.features, "risk": self.risk, "metadata": self.metadata,
            "sides": {s: {k: {"condition": c} for k, c in x.items() if c} | {f"{k}_confidence": v for k, v in self.confidence.get(s, {}).items()} for s, x in self.sides.items()},
        }

    def key(self, **inputs: Any) -> str:
        """SHA-256 of the document and of all inputs of a run."""
        return hashlib.sha256(json.dumps({"strategy": self.normalised(), **inputs}, sort_keys=True, default=str).encode()).hexdigest()


def _resolve(x: Any, values: dict[str, Any]) -> Any:
    if isinstance(x, str) and (m := _SLOT.match(x)):
        return values.get(m[1], x)
    if isinstance(x, dict):
        return {k: _resolve(v, values) for k, v in x.items()}
    return [_resolve(v, values) for v in x] if isinstance(x, list) else x


def _depth(c: Any) -> int:
    if not isinstance(c, dict):
        return 0
    return 1 + max((_depth(x) for k in ("all", "any") for x in c.get(k, [])), default=0) if "all" in c or "any" in c else 1 + _depth(c["not"]) if "not" in c else 1


def load(document: str | dict) -> dict:
    """A document from JSON, else YAML."""
    if isinstance(document, dict):
        return document
    try:
        return json.loads(document)
    except ValueError:
        import yaml

        made = yaml.safe_load(document)
        if not isinstance(made, dict):
            raise StrategyError([("$", "the document is no object")]) from None
        return made


def parse(document: str | dict, overrides: dict[str, Any] | None = None) -> Strategy:
    """The strategy, parameters put in; raises ``StrategyError`` with all faults found."""
    raw, errors = load(document), []
    bad = lambda path, message: errors.append((path, message))
    if raw.get("schema_version") != "2.0":
        bad("$.schema_version", "must be 2.0")
    if not str(raw.get("name") or "").strip():
        bad("$.name", "is missing")
    for key, most in LIMITS.items():
        if len(raw.get(key) or ()) > most:
            bad(f"$.{key}", f"more than {most}")

    values: dict[str, Any] = {}
    declared = dict(raw.get("parameters") or {})
    for name, p in declared.items():
        value = (overrides or {}).get(name, p.get("default"))
        kind = _TYPES.get(p.get("type"))
        if kind is None or not isinstance(value, kind) or (isinstance(value, bool) and p["type"] != "bool"):
            bad(f"$.parameters.{name}", f"{value!r} is no {p.get('type')}")
        elif p["type"] in ("int", "float") and not (p.get("minimum", value) <= value <= p.get("maximum", value)):
            bad(f"$.parameters.{name}", f"{value} is out of bounds")
        values[name] = value
    for name in set(overrides or {}) - set(values):
        bad(f"$.parameters.{name}", "is not declared")
    raw = _resolve({k: v for k, v in raw.items() if k != "parameters"}, values)

    frames = raw.get("timeframes") or {}
    slow = {x.get("alias"): x.get("interval") for x in frames.get("informative") or ()}
    if len(frames.get("informative") or ()) > INFORMATIVE:
        bad("$.timeframes.informative", f"more than {INFORMATIVE}")
    if len(slow) < len(frames.get("informative") or ()) or len(set(slow.values())) < len(slow) or frames.get("primary") in slow.values():
        bad("$.timeframes", "aliases and intervals must differ")
    for interval in [*slow.values(), *([frames["primary"]] if frames.get("primary") else [])]:
        if interval not in SECONDS:
            bad("$.timeframes", f"unknown interval {interval!r}")

    indicators, used = [], set()
    for i, x in enumerate(raw.get("indicators") or ()):
        path, name, kind, frame = f"$.indicators[{i}]", str(x.get("name") or "").strip(), str(x.get("type") or "").lower(), x.get("timeframe", "primary")
        if not name or name in used:
            bad(f"{path}.name", "missing or taken")
        used.add(name)
        if frame != "primary" and frame not in slow:
            bad(f"{path}.timeframe", f"unknown timeframe {frame!r}")
        suffix = f"_{slow[frame]}" if frame in slow else ""
        if kind == "fallback":
            columns = list(x.get("sources") or ())
            if len(columns) < 2:
                bad(f"{path}.sources", "needs two at least")
        else:
            period = x.get("period")
            column = kind if period is None else f"{kind}_{period}"
            source = x.get("source", "close")
            if source != "close":
                if period is None or kind not in registry.SOURCED or source not in registry.SOURCES:
                    bad(f"{path}.source", f"no {kind} of {source!r}")
                column = f"{column}_of_{source}"
            low, high = registry.PERIODS.get(kind, (None, None))
            if period is not None and (low is None or not isinstance(period, int) or not low <= period <= high):
                bad(f"{path}.period", f"no period {period!r} for {kind}")
            else:
                try:
                    registry.find(column)
                except KeyError as e:
                    bad(f"{path}.type", str(e.args[0]))
            columns = [column + suffix]
        indicators.append({**x, "name": name, "type": kind, "timeframe": frame, "columns": columns})

    features = []
    for i, x in enumerate(raw.get("features") or ()):
        path, name = f"$.features[{i}]", str(x.get("name") or "").strip()
        if not name or name in used:
            bad(f"{path}.name", "missing or taken")
        used.add(name)
        if x.get("type") not in FEATURES:
            bad(f"{path}.type", f"unknown feature {x.get('type')!r}")
        if x.get("type", "").startswith("rolling_") and (not isinstance(x.get("window"), int) or x["window"] < 1):
            bad(f"{path}.window", "must be 1 or more")
        if not isinstance(x.get("shift", 0), int) or x.get("shift", 0) < 0:
            bad(f"{path}.shift", "must be 0 or more")
        if x.get("type") == "formula" and not isinstance(x.get("expr"), dict):
            bad(f"{path}.expr", "is missing")
        features.append({**x, "name": name})

    known = used | {*PRICES}

    def check(c: Any, path: str) -> None:
        if not isinstance(c, dict):
            return bad(path, "must be an object")
        for key in ("all", "any"):
            if key in c:
                if not c[key]:
                    bad(f"{path}.{key}", "is empty")
                return [check(x, f"{path}.{key}[{k}]") for k, x in enumerate(c[key])]
        if "not" in c:
            return check(c["not"], f"{path}.not")
        op = c.get("operator")
        if op not in formula.OPERATORS:
            return bad(f"{path}.operator", f"unknown operator {op!r}")
        if op in ("between", "not_between") and not (isinstance(c.get("right"), list) and len(c["right"]) == 2):
            bad(f"{path}.right", "must be two numbers")
        sides = ["left"] if op in ("is_true", "is_false", "exists", "missing", "between", "not_between") else ["left", "right"]
        for side in sides:
            x = c.get(side)
            if x is None:
                bad(f"{path}.{side}", "is missing")
            elif isinstance(x, str) and x not in known:
                try:
                    registry.find(x)
                except KeyError:
                    bad(f"{path}.{side}", f"unknown operand {x!r}")
        return None

    sides, warnings, confidence = {}, [], {}
    for side, x in (raw.get("sides") or {}).items():
        if side not in ("long", "short"):
            bad(f"$.sides.{side}", "must be long or short")
            continue
        parts = {k: (x.get(k) or {}).get("condition") for k in ("entry", "exit")}
        if parts["entry"] is None:
            bad(f"$.sides.{side}.entry", "is missing")
        for k, c in parts.items():
            if c is not None:
                check(c, f"$.sides.{side}.{k}.condition")
                if _depth(c) > DEPTH:
                    bad(f"$.sides.{side}.{k}", f"deeper than {DEPTH}")
        if parts["exit"] is None:
            warnings.append(f"{side} has no exit")
        sides[side] = parts
        confidence[side] = {k: x.get(f"{k}_confidence", CONFIDENCE) for k in ("entry", "exit")}
        for k, v in confidence[side].items():
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1:
                bad(f"$.sides.{side}.{k}_confidence", "must be from 0 to 1")
    if not sides:
        bad("$.sides", "is missing")

    risk = {}
    for part, kinds in (("stop_loss", STOPS), ("take_profit", TARGETS)):
        x = {"type": "none", **((raw.get("risk") or {}).get(part) or {})}
        need = {"atr": "multiplier", "fixed_pct": "pct", "risk_reward": "ratio"}.get(x["type"])
        if x["type"] not in kinds:
            bad(f"$.risk.{part}.type", f"unknown type {x['type']!r}")
        elif need and not (isinstance(x.get(need), (int, float)) and x[need] > 0):
            bad(f"$.risk.{part}.{need}", "must be positive")
        if x["type"] == "atr":
            x.setdefault("indicator", "atr")
        risk[part] = x
    if risk["take_profit"]["type"] == "risk_reward" and risk["stop_loss"]["type"] == "none":
        bad("$.risk.take_profit", "risk_reward needs a stop")
    if risk["stop_loss"]["type"] == "none":
        warnings.append("no stop-loss")
    if errors:
        raise StrategyError(errors)
    return Strategy(str(raw["name"]), str(raw.get("description") or ""), values, frames.get("primary"), slow, indicators, features, sides, risk, raw.get("metadata") or {}, warnings, declared, confidence)


def explain(s: Strategy) -> str:
    """The strategy in words."""

    def say(c: dict) -> str:
        for key, word in (("all", " and "), ("any", " or ")):
            if key in c:
                return "(" + word.join(map(say, c[key])) + ")"
        return f"not {say(c['not'])}" if "not" in c else " ".join(str(c[k]) for k in ("left", "operator", "right") if k in c)

    lines = [f"{s.name}: {s.description}".rstrip(": ")]
    lines += [f"indicator {i['name']} = {' or '.join(i['columns'])}" for i in s.indicators] + [f"feature {f['name']} ({f['type']})" for f in s.features]
    lines += [f"{side} {part}: {say(c)}" for side, x in s.sides.items() for part, c in x.items() if c]
    lines += [f"{part}: {x['type']}" for part, x in s.risk.items()] + [f"warning: {w}" for w in s.warnings]
    return "\n".join(lines)


def capabilities() -> dict:
    """What documents may use."""
    return {"indicators": registry.names(), "periods": registry.PERIODS, "features": list(FEATURES), "operators": sorted(formula.OPERATORS), "sources": list(registry.SOURCES), "sourced": list(registry.SOURCED), "stops": list(STOPS), "targets": list(TARGETS), "intervals": list(SECONDS), "limits": {**LIMITS, "depth": DEPTH, "informative": INFORMATIVE}}


def json_schema() -> dict:
    """JSON Schema of a document: parameters, timeframes, indicators, features, nested conditions and risk."""
    text, whole, number = {"type": "string", "minLength": 1}, {"type": "integer"}, {"type": "number"}
    slot = {"type": "string", "pattern": _SLOT.pattern}
    or_slot = lambda x: {"anyOf": [x, slot]}
    thing = lambda required=(), **properties: {"type": "object", "required": list(required), "properties": properties}
    many = lambda items, **limits: {"type": "array", "items": items, **limits}
    operand = {"anyOf": [text, number, {"type": "boolean"}, {"type": "object"}]}
    condition = {
        "anyOf": [
            *[thing([k], **{k: many({"$ref": "#/$defs/condition"}, minItems=1)}) for k in ("all", "any")],
            thing(["not"], **{"not": {"$ref": "#/$defs/condition"}}),
            thing(["left", "operator"], left=operand, operator={"enum": sorted(formula.OPERATORS)}, right={"anyOf": [operand, many(or_slot(number), minItems=2, maxItems=2)]}),
        ]
    }
    rule = thing(["condition"], condition={"$ref": "#/$defs/condition"})
    share = or_slot({"type": "number", "minimum": 0, "maximum": 1})
    side = thing(["entry"], entry=rule, exit=rule, entry_confidence=share, exit_confidence=share)
    positive = or_slot({"type": "number", "exclusiveMinimum": 0})
    risk = lambda kinds: thing(["type"], type={"enum": list(kinds)}, multiplier=positive, pct=positive, ratio=positive, indicator=text)
    parameter = thing(["type", "default"], type={"enum": list(_TYPES)}, minimum=number, maximum=number, description={"type": "string"})
    interval = {"enum": list(SECONDS)}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["schema_version", "name", "sides"], "$defs": {"condition": condition},
        "properties": {
            "schema_version": {"const": "2.0"}, "name": text, "description": {"type": "string"},
            "parameters": {"type": "object", "maxProperties": LIMITS["parameters"], "additionalProperties": parameter},
            "timeframes": thing(primary=interval, informative=many(thing(["alias", "interval"], alias=text, interval=interval), maxItems=INFORMATIVE)),
            "indicators": many(thing(["name", "type"], name=text, type=text, period=or_slot(whole), timeframe=text, source={"enum": list(registry.SOURCES)}, sources=many(text, minItems=2)), maxItems=LIMITS["indicators"]),
            "features": many(thing(["name", "type"], name=text, type={"enum": list(FEATURES)}, source=text, window=or_slot({"type": "integer", "minimum": 1}), shift=or_slot({"type": "integer", "minimum": 0}), expr={"type": "object"}), maxItems=LIMITS["features"]),
            "sides": {**thing(long=side, short=side), "minProperties": 1, "additionalProperties": False},
            "risk": thing(stop_loss=risk(STOPS), take_profit=risk(TARGETS)), "metadata": {"type": "object"},
        },
    }


def add_features(df: DataFrame, features: list[dict]) -> DataFrame:
    """Features in order, formulas after all others."""
    simple = {"body_pct": price.body_share, "range_pct": price.range_share, "typical_price": price.typical_price, "ohlc4": price.ohlc4}
    for f in sorted(features, key=lambda x: x["type"] == "formula"):
        kind, source = f["type"], f.get("source", "close")
        if kind == "formula":
            types = {n: ("boolean" if t == "boolean" else "string" if t == "string" else "double") for n, t in df.dtypes}
            column = formula.formula(f["expr"], types)[0]
        elif kind == "shift":
            column = lag(source, f.get("shift", 1))
        else:
            column = rolling(kind.removeprefix("rolling_"), source, f["window"], f.get("shift", 0)) if kind.startswith("rolling_") else simple[kind]()
        df = df.withColumn(f["name"], column)
    return df


def indicators(s: Strategy) -> list[str]:
    """Registered columns of the primary bars that a strategy reads."""
    wanted = [c for i in s.indicators if i["timeframe"] == "primary" and i["type"] != "fallback" for c in i["columns"]]
    extra = [n for n in s.required() if n not in {*PRICES} and n not in {f["name"] for f in s.features} and n not in wanted and not any(n.endswith(f"_{i}") for i in s.informative.values()) and n not in s.columns()]
    return list(dict.fromkeys(wanted + [n for n in extra if _known(n)]))


def prepare(s: Strategy, bars: DataFrame, slower: dict[str, DataFrame] | None = None) -> DataFrame:
    """Bars with all that the rules read: indicators, as-of columns of slower timeframes (bars by
    alias), aliases and features."""
    df = registry.add_indicators(bars, indicators(s))
    for alias, interval in s.informative.items():
        names = list(dict.fromkeys(c.removesuffix(f"_{interval}") for i in s.indicators if i["timeframe"] == alias for c in i["columns"]))
        if names:
            frame = registry.add_indicators((slower or {})[alias], names).select("symbol", "ts", *names)
            df = asof_join(df, frame, interval, names)
    for i in s.indicators:
        if i["columns"] != [i["name"]]:
            df = df.withColumn(i["name"], F.coalesce(*[F.col(c) for c in i["columns"]]))
    return add_features(df, s.features)


def _known(name: str) -> bool:
    try:
        registry.find(name)
    except KeyError:
        return False
    return True


def types_of(df: DataFrame) -> dict[str, str]:
    return {n: ("boolean" if t == "boolean" else "string" if t == "string" else "double") for n, t in df.dtypes}


def screen(s: Strategy, prepared: DataFrame) -> DataFrame:
    """Adds ``{side}_entry`` and ``{side}_exit`` of every bar, without regard to positions."""
    types = types_of(prepared)
    return prepared.withColumns({f"{side}_{part}": formula.condition(c, types) for side, x in s.sides.items() for part, c in x.items() if c})


def signals(s: Strategy, prepared: DataFrame) -> DataFrame:
    """Rows ``keys, ts, direction, action, confidence`` of bars on which a rule holds, without regard to positions."""
    found = screen(s, prepared)
    said = [
        F.when(F.col(f"{side}_{part}"), F.struct(F.lit(side).alias("direction"), F.lit(part).alias("action"), F.lit(float(s.confidence[side][part])).alias("confidence")))
        for side, x in s.sides.items() for part, c in x.items() if c
    ]
    keys = [c for c in ("symbol", "source", "interval", "ts") if c in found.columns]
    return found.select(*keys, F.explode(F.array_compact(F.array(*said))).alias("x")).select(*keys, "x.*")


def risk_prices(s: Strategy, side: str) -> tuple:
    """Stop and target columns of an entry signalled at this bar's close, to cents (half to even); 0 is none."""
    close, sign = F.col("close"), 1 if side == "long" else -1
    stop_of, target_of = s.risk["stop_loss"], s.risk["take_profit"]
    atr = lambda x: F.coalesce(F.col(s.columns().get(x["indicator"], [x["indicator"]])[0]).cast("double"), F.lit(0.0))
    none = F.lit(0.0)
    stop = {"none": lambda x: none, "atr": lambda x: F.when(atr(x) > 0, close - sign * atr(x) * x["multiplier"]).otherwise(0.0), "fixed_pct": lambda x: close * (1 - sign * x["pct"])}[stop_of["type"]](stop_of)
    target = {
        "none": lambda x: none, "atr": lambda x: F.when(atr(x) > 0, close + sign * atr(x) * x["multiplier"]).otherwise(0.0), "fixed_pct": lambda x: close * (1 + sign * x["pct"]),
        "risk_reward": lambda x: F.when(stop > 0, close + sign * F.abs(close - stop) * x["ratio"]).otherwise(0.0),
    }[target_of["type"]](target_of)
    return F.bround(stop, 2), F.bround(target, 2)
