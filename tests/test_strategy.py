import copy
import datetime as dt
import json

import pytest

from barloom.plans import strategy
from barloom.plans.providers import Chain, Documents
from barloom.queries_more import CROSSING
from barloom.schema import BARS
from barloom.sources.store import Store


def test_parse_and_override():
    s = strategy.parse(json.dumps(CROSSING), {"fast": 7})
    assert s.columns()["fast_sma"] == ["sma_7"] and s.risk["stop_loss"]["pct"] == 0.2
    assert "sma_7" in s.required() and "close" in s.required()
    assert "crossing" in strategy.explain(s)
    assert s.key(x=1) != s.key(x=2)


def test_yaml():
    doc = "schema_version: '2.0'\nname: y\nindicators:\n- {name: m, type: sma, period: 5}\nsides:\n  long:\n    entry:\n      condition: {left: close, operator: '>', right: m}\n"
    s = strategy.parse(doc)
    assert s.warnings == ["long has no exit", "no stop-loss"]


@pytest.mark.parametrize(
    ("change", "path"),
    [
        (lambda d: d.update(schema_version="1"), "$.schema_version"),
        (lambda d: d["indicators"][0].update(period=1000), "$.indicators[0].period"),
        (lambda d: d["indicators"][0].update(type="nothing"), "$.indicators[0].period"),
        (lambda d: d["features"][0].update(type="x"), "$.features[0].type"),
        (lambda d: d["sides"]["long"]["entry"]["condition"].update(operator="?"), "$.sides.long.entry.condition.operator"),
        (lambda d: d["sides"]["long"]["entry"]["condition"].update(left="unheard"), "$.sides.long.entry.condition.left"),
        (lambda d: d["risk"]["stop_loss"].update(pct=-1), "$.risk.stop_loss.pct"),
        (lambda d: d["parameters"]["fast"].update(default=99), "$.parameters.fast"),
    ],
)
def test_faults_have_paths(change, path):
    d = copy.deepcopy(CROSSING)
    change(d)
    with pytest.raises(strategy.StrategyError) as e:
        strategy.parse(d)
    assert path in [p for p, _ in e.value.errors]


def test_schema_and_capabilities():
    assert strategy.json_schema()["required"] == ["schema_version", "name", "sides"]
    assert "vp_poc" in strategy.capabilities()["indicators"]


def test_normal_form_is_a_document_again():
    s = strategy.parse(CROSSING, {"fast": 7})
    n = s.normalised()
    assert n["parameters"]["fast"] == {"type": "int", "default": 7, "minimum": 2, "maximum": 50}
    again = strategy.parse({k: v for k, v in n.items() if v is not None and k != "timeframes"})
    assert again.parameters == s.parameters and again.sides.keys() == s.sides.keys()


def test_schema_covers_conditions_and_risk():
    schema = strategy.json_schema()
    assert {tuple(x["required"]) for x in schema["$defs"]["condition"]["anyOf"]} == {("all",), ("any",), ("not",), ("left", "operator")}
    assert schema["properties"]["risk"]["properties"]["stop_loss"]["properties"]["type"]["enum"] and json.dumps(schema)


def test_sources_of_indicators(spark):
    """A mean of highs is not one of closes; kinds without a source and unknown prices are refused."""
    bars = spark.createDataFrame([("A", "s", "1h", dt.datetime(2024, 1, 1, h), 1.0 + h, 10.0 + h * h, 0.5, 2.0 + h, h) for h in range(12)], BARS)
    doc = {"schema_version": "2.0", "name": "x", "indicators": [{"name": n, "type": t, "period": 3, "source": s} for n, t, s in (("a", "sma", "high"), ("b", "ema", "typical_price"), ("c", "bb_upper", "volume"), ("d", "rsi", "open"), ("e", "sma", "close"))]}
    doc["sides"] = {"long": {"entry": {"condition": {"all": [{"left": x, "operator": ">", "right": 0} for x in "abcde"]}}}}
    s = strategy.parse(doc)
    last = strategy.prepare(s, bars).orderBy("ts").collect()[-1]
    assert last.a == sum(10.0 + h * h for h in (9, 10, 11)) / 3 and last.e == sum(2.0 + h for h in (9, 10, 11)) / 3
    e = None
    for h in range(12):
        p = (10.0 + h * h + 0.5 + 2.0 + h) / 3
        e = p if e is None else e + (p - e) / 2
    assert abs(last.b - e) < 1e-9 and abs(last.c - (10 + 2 * (2 / 3) ** 0.5)) < 1e-9 and last.d == 100.0
    for wrong in ({"type": "atr", "period": 14, "source": "high"}, {"type": "sma", "period": 5, "source": "mid"}, {"type": "vwap", "source": "high"}):
        with pytest.raises(strategy.StrategyError, match="source"):
            strategy.parse(doc | {"indicators": [{"name": "a", **wrong}], "sides": {"long": {"entry": {"condition": {"left": "a", "operator": ">", "right": 0}}}}})


def test_confidence_and_signals(spark):
    bars = spark.createDataFrame([("A", "s", "1h", dt.datetime(2024, 1, 1, h), 1.0, 2.0, 0.5, float(h + 1), h) for h in range(3)], BARS)
    above = {"condition": {"left": "close", "operator": ">", "right": 2}}
    doc = {"schema_version": "2.0", "name": "x", "sides": {"long": {"entry": above, "exit": above, "entry_confidence": 0.25}, "short": {"entry": {"condition": {"left": "close", "operator": "<=", "right": 1}}}}}
    s = strategy.parse(doc)
    got = sorted((r.ts.hour, r.direction, r.action, r.confidence) for r in strategy.signals(s, strategy.prepare(s, bars)).collect())
    assert got == [(0, "short", "entry", 0.7), (2, "long", "entry", 0.25), (2, "long", "exit", 0.7)]
    assert strategy.parse(s.normalised()).confidence == s.confidence
    assert {"entry_confidence", "exit_confidence"} <= set(strategy.json_schema()["properties"]["sides"]["properties"]["long"]["properties"])
    for v in (-0.1, 1.5, "high", True):
        with pytest.raises(strategy.StrategyError, match="entry_confidence"):
            strategy.parse(doc | {"sides": {"long": {"entry": above, "entry_confidence": v}}})


def test_providers_in_order(spark, tmp_path):
    rule = {"sides": {"long": {"entry": {"condition": {"left": "close", "operator": ">", "right": 1}}}}}
    store = Store(spark, str(tmp_path))
    store.save_document("b", json.dumps({"schema_version": "2.0", "name": "stored", "description": "kept", **rule}))
    chain = Chain([Documents({"a": {"schema_version": "2.0", "name": "own", "parameters": {"n": {"type": "int", "default": 3, "minimum": 1, "maximum": 9}}, **rule}}), Documents.of_store(store), Documents({"a": {"schema_version": "2.0", "name": "other", **rule}})])
    assert chain.create("a", {"n": 5}).parameters == {"n": 5} and chain.create("a").name == "own" and chain.create("b").name == "stored" and chain.create("c") is None
    assert [x["name"] for x in chain.listed()] == ["a", "b"] and chain.listed()[1]["description"] == "kept" and chain.exists("b") and not chain.exists("c")
