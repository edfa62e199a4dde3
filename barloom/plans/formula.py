"""Formula and condition trees compiled to columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schema import flag, lag

COMPARE, ARITHMETIC, LOGICAL, UNARY = {">", "<", ">=", "<=", "==", "!="}, {"+", "-", "*", "/"}, {"and", "or"}, {"not", "abs", "neg"}
OPERATORS = {"<", ">", "<=", ">=", "==", "!=", "between", "not_between", "is_true", "is_false", "exists", "missing", "crosses_above", "crosses_below"}
CROSSES = {"crosses_above", "crosses_below"}


def _truth(x: Column, kind: str) -> Column:
    """Of a number: not zero, and true where it is null; of a flag: false where it is null."""
    return F.coalesce(x, F.lit(False)) if kind == "boolean" else F.coalesce(x.cast("double") != 0, F.lit(True))


def formula(node: Any, types: dict[str, str]) -> tuple[Column, str]:
    """The column of a formula and its type (boolean or double); a name unknown to ``types`` is null.

    Operators nest freely. Division by zero gives null; a comparison with null is false, ``!=``
    with null is true."""
    if isinstance(node, bool):
        return F.lit(node), "boolean"
    if isinstance(node, (int, float)):
        return F.lit(float(node)), "double"
    if isinstance(node, str):
        kind = types.get(node)
        return (F.lit(None).cast("double"), "double") if kind is None else (F.col(node), "boolean") if kind == "boolean" else (F.col(node).cast("double"), "double")
    if not isinstance(node, dict) or "op" not in node:
        return formula(node.get("value", node.get("indicator", node.get("field"))) if isinstance(node, dict) else 0.0, types)
    op = node["op"]
    parts = node.get("children") or node.get("operands") or [node[k] for k in ("left", "right") if k in node] or [node.get("operand")]
    made = [formula(p, types) for p in parts]
    number = lambda x: x[0].cast("double") if x[1] == "double" else x[0].cast("int").cast("double")
    if op in LOGICAL:
        result = _truth(*made[0])
        for x in made[1:]:
            result = (result & _truth(*x)) if op == "and" else (result | _truth(*x))
        return result, "boolean"
    if op == "not":
        return ~_truth(*made[0]), "boolean"
    if op in UNARY:
        return (F.abs(number(made[0])) if op == "abs" else -number(made[0])), "double"
    left, right = number(made[0]), number(made[1])
    if op in COMPARE:
        test = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right, "==": left == right, "!=": left != right}[op]
        return F.coalesce(test, F.lit(op == "!=")), "boolean"
    if op in ARITHMETIC:
        return {"+": left + right, "-": left - right, "*": left * right, "/": left / F.nullif(right, F.lit(0.0))}[op], "double"
    raise ValueError(f"unknown formula operator: {op}")


def operand(x: Any, types: dict[str, str]) -> tuple[Column, str]:
    """A literal, a column, or the first of several columns that has a value (``sources``)."""
    if isinstance(x, dict):
        names = [n for n in [x.get("value"), *x.get("sources", [])] if n is not None]
        made = [operand(n, types) for n in names]
        return F.coalesce(*[m[0] for m in made]), made[0][1]
    if isinstance(x, bool):
        return F.lit(x), "boolean"
    if isinstance(x, (int, float)):
        return F.lit(float(x)), "double"
    kind = types[x]
    return F.col(x), "boolean" if kind == "boolean" else "string" if kind == "string" else "double"


def leaf(cond: dict, types: dict[str, str]) -> Column:
    """A test of one bar; crosses look at the bar before (screening, not backtests)."""
    op = cond["operator"]
    left, kind = operand(cond["left"], types)
    if op in ("exists", "missing"):
        return left.isNotNull() if op == "exists" else left.isNull()
    if op in ("is_true", "is_false"):
        truth = F.coalesce(left if kind == "boolean" else left.cast("double") != 0, F.lit(False))
        return truth if op == "is_true" else ~truth
    number = (lambda c, k: c.cast("double") if k == "double" else F.lit(None).cast("double"))(left, kind)
    if op in ("between", "not_between"):
        lo, hi = cond["right"]
        inside = flag((number >= float(lo)) & (number <= float(hi)))
        return inside if op == "between" else ~inside
    right, right_kind = operand(cond["right"], types)
    other = right.cast("double") if right_kind == "double" else F.lit(None).cast("double")
    if op in CROSSES:
        before, now = (lag(number) <= lag(other), number > other) if op == "crosses_above" else (lag(number) >= lag(other), number < other)
        return flag(before & now)
    if op in ("==", "!="):
        same = F.abs(number - other) < 1e-9
        return flag(same) if op == "==" else flag(~same)
    return flag({"<": number < other, ">": number > other, "<=": number <= other, ">=": number >= other}[op])


def condition(cond: dict, types: dict[str, str]) -> Column:
    for key, start in (("all", True), ("any", False)):
        if key in cond:
            result = F.lit(start)
            for c in cond[key]:
                result = (result & condition(c, types)) if start else (result | condition(c, types))
            return result
    return ~condition(cond["not"], types) if "not" in cond else leaf(cond, types)


def leaves(cond: dict) -> list[dict]:
    if "not" in cond:
        return leaves(cond["not"])
    for key in ("all", "any"):
        if key in cond:
            return [x for c in cond[key] for x in leaves(c)]
    return [cond]
