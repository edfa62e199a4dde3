"""Parameter search and walk-forward: every combination and fold is a group of its own.

All combinations share one preparation; rows are replicated only with the columns that rules read, and
all runs of all combinations, folds and symbols are groups of a grouped pass.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import backtest, metrics
from barloom.plans import registry
from barloom.plans import strategy as plan
from barloom.schema import KEY

MOST = 100


def grid(ranges: dict[str, dict]) -> list[dict[str, Any]]:
    """All combinations of ``min, max, step`` (or ``values``); more than 100 are refused."""
    axes = []
    for name, r in ranges.items():
        if "values" in r:
            axes.append([(name, v) for v in r["values"]])
            continue
        n = int((r["max"] - r["min"]) / r["step"] + 1e-9) + 1
        whole = all(isinstance(r[k], int) for k in ("min", "max", "step"))
        axes.append([(name, v if whole else round(v, 10)) for v in (r["min"] + i * r["step"] for i in range(n))])
    out = [dict(c) for c in itertools.product(*axes)]
    if len(out) > MOST:
        raise ValueError(f"{len(out)} combinations; at most {MOST}")
    return out


def sample(ranges: dict[str, dict], n: int, seed: int) -> list[dict[str, Any]]:
    """Up to n different random combinations; integers stay integers, other numbers get 2 places."""
    rng, out = random.Random(seed), []
    for _ in range(50 * n):
        c = {k: rng.randint(r["min"], r["max"]) if isinstance(r["min"], int) and isinstance(r["max"], int) else round(rng.uniform(r["min"], r["max"]), 2) for k, r in ranges.items()}
        if c not in out:
            out.append(c)
        if len(out) == min(n, MOST):
            break
    return out


def folds(total: int, n: int, train_ratio: float = 0.7, *, anchored: bool = False, min_train: int = 20, min_test: int = 1) -> list[dict[str, int]]:
    """Bar ranges of train and test, ends not included; too short ones are left out.

    A fold is a train start and the cut where its test part begins, which is one n-th of the bars long.
    Anchored folds train from the start and cut at every n-th. Rolling ones start half an n-th apart,
    train on ``train_ratio`` of one, and where bars are left a last fold, cut where the one before is
    cut, tests on two n-ths."""
    if total < 3 or n < 2:
        return []
    size = total // n
    starts = [0] * n if anchored else [k * (size // 2) for k in range(n - 1)]
    trained = [size * (k + 1) for k in range(n)] if anchored else [int(size * train_ratio)] * len(starts)
    spans = [(start, start + train, size) for start, train in zip(starts, trained, strict=True)]
    _, cut, _ = spans[-1]
    if not anchored and cut + size < total:
        spans.append((max(0, cut - size), cut, 2 * size))
    ranges = [(start, cut, min(cut + length, total)) for start, cut, length in spans]
    names = ("train_start", "train_end", "test_start", "test_end")
    return [dict(zip(names, (a, b, b, c), strict=True)) for a, b, c in ranges if b - a >= min_train and c - b >= min_test]


def prepared_runs(document: str | dict, bars: DataFrame, combinations: list[dict]) -> tuple[DataFrame, Callable[[dict], dict], list[tuple[int, str]]]:
    """Rows of all bars for every combination (``combo``), the rule trees by keys, and the combinations that fail.

    What combinations share is in the plan once: first all distinct indicators of all of them (recursive ones
    in one grouped pass), then every distinct rule, operand, stop and target, known by what it is and not by its
    name. A combination is a struct of references to these, and rows are replicated with that struct alone."""
    parsed, failed = {}, []
    for i, c in enumerate(combinations):
        try:
            parsed[i] = plan.parse(document, c)
        except plan.StrategyError as e:
            failed.append((i, str(e)))
    names = list(dict.fromkeys(n for s in parsed.values() for n in plan.indicators(s)))
    df, trees, runs, read, shared = registry.add_indicators(bars, names), {}, [], {}, {}
    for i, s in parsed.items():
        own = plan.prepare(s, df)
        trees[i], columns, keys = backtest.keyed_signals(s, own)
        kept = [c for c in own.columns if c not in {x["name"] for x in (*s.indicators, *s.features)}]
        new = {}
        for name, column in columns.items():
            if keys[name] not in shared:
                shared[keys[name]] = f"_shared{len(shared)}"
                new[shared[keys[name]]] = column
        read[i] = {name: shared[keys[name]] for name in columns}
        df = own.withColumns(new).select(*kept, *new) if new else df
    names = list(dict.fromkeys(n for columns in read.values() for n in columns))
    kind = {n: next(df.schema[columns[n]].dataType for columns in read.values() if n in columns) for n in names}
    for i, columns in read.items():
        runs.append(F.struct(F.lit(i).alias("combo"), *[(F.col(columns[n]) if n in columns else F.lit(None)).cast(kind[n]).alias(n) for n in names]))
    if not runs:
        raise ValueError(f"no combination is valid: {failed[0][1] if failed else 'none given'}")
    rows = df.select(*KEY, "ts", "open", "high", "low", "close", F.explode(F.array(*runs)).alias("_run")).select(*KEY, "ts", "open", "high", "low", "close", "_run.*")
    return rows, lambda keys: trees[int(keys["combo"])], failed


def run_combinations(document: str | dict, bars: DataFrame, combinations: list[dict], how: backtest.Execution = backtest.Execution()) -> DataFrame:  # noqa: B008
    """Kernel rows of all combinations that are valid, with ``combo``: one plan, one grouped pass."""
    rows, trees, _ = prepared_runs(document, bars, combinations)
    return backtest.run_rows(rows, trees, how, by=(*KEY, "combo"))


def grid_search(document: str | dict, bars: DataFrame, combinations: list[dict], factor: float, metric: str = "sharpe", how: backtest.Execution = backtest.Execution()) -> DataFrame:  # noqa: B008
    """Ranked results of all combinations; one that fails is a row without results, with its ``error``."""
    rows, trees, failed = prepared_runs(document, bars, combinations)
    found = ranked(results(backtest.run_rows(rows, trees, how, by=(*KEY, "combo")), factor), metric).withColumn("error", F.lit(None).cast("string"))
    if failed:
        found = found.unionByName(bars.sparkSession.createDataFrame(failed, "combo int, error string"), allowMissingColumns=True)
    return found


def results(rows: DataFrame, factor: float, by: tuple[str, ...] = (*KEY, "combo")) -> DataFrame:
    """Metrics of each run; runs without trades have zeros."""
    e = metrics.equity_metrics(backtest.equity(rows, by), factor, by)
    t = metrics.trade_metrics(backtest.trades(rows, by), by).select(*by, "trades", "win_rate", "profit_factor")
    return e.join(t, list(by), "left").fillna(0, ["trades", "win_rate"])


def ranked(found: DataFrame, metric: str = "sharpe", by: tuple[str, ...] = KEY) -> DataFrame:
    """Rank 1 for the best; ties go by combination."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), "combo")))


def best(found: DataFrame, metric: str = "sharpe", by: tuple[str, ...] = KEY) -> DataFrame:
    return ranked(found, metric, by).where("rank = 1")


def fold_bars(bars: DataFrame, ranges: Callable[[int], list[dict[str, int]]] | list[dict[str, int]]) -> DataFrame:
    """Keys and ``ts`` of all bars with each ``fold`` and ``part`` (train, test) they are in."""
    of = ranges if callable(ranges) else lambda n: ranges
    spans = F.udf(lambda n: [(i, p, f[f"{p}_start"], f[f"{p}_end"]) for i, f in enumerate(of(n)) for p in ("train", "test")], "array<struct<fold:int,part:string,a:int,b:int>>")
    series = Window.partitionBy(*KEY)
    counts = bars.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.count(F.lit(1)).alias("_n")).select(*[f"_{k}" for k in KEY], spans("_n").alias("_spans"))  # a row a series
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    placed = bars.select(*KEY, "ts", (F.row_number().over(series.orderBy("ts")) - 1).alias("_i")).join(counts, same)
    placed = placed.withColumn("_s", F.explode(F.filter("_spans", lambda x: (x["a"] <= F.col("_i")) & (F.col("_i") < x["b"]))))
    return placed.select(*KEY, "ts", F.col("_s.fold").alias("fold"), F.col("_s.part").alias("part"))


def walk_forward(document: str | dict, bars: DataFrame, combinations: list[dict], ranges: Callable[[int], list[dict[str, int]]] | list[dict[str, int]], factor: float, metric: str = "sharpe", how: backtest.Execution = backtest.Execution()) -> DataFrame:  # noqa: B008
    """``fold`` by series: the best combination on train bars, its metrics there (``is_``) and on test bars (``oos_``).

    ``ranges`` gives the folds of a series from its number of bars; a list holds for all series alike.
    Indicators see all earlier bars (they look back alone). Train parts of all folds and combinations are
    groups of one grouped pass; only the best combination of a fold runs on its test bars."""
    by = (*KEY, "combo", "fold")
    placed = fold_bars(bars, ranges).select(*[F.col(k).alias(f"_{k}") for k in (*KEY, "ts")], "fold", "part")
    rows, trees, _ = prepared_runs(document, bars, combinations)
    rows = rows.join(placed, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*KEY, "ts")])).drop(*[f"_{k}" for k in (*KEY, "ts")])
    measured = lambda part: results(backtest.run_rows(part.drop("part"), trees, how, by=by), factor, by)
    shown = ("total_return", "sharpe", "max_drawdown", "win_rate", "trades")
    train = best(measured(rows.where("part = 'train'")), metric, (*KEY, "fold")).select(*by, *[F.col(c).alias(f"is_{c}") for c in shown])
    test = measured(rows.where("part = 'test'").join(train.select(*by), list(by))).select(*by, *[F.col(c).alias(f"oos_{c}") for c in shown])
    return train.join(test, list(by)).select(*KEY, "fold", "combo", *[f"is_{c}" for c in shown], *[f"oos_{c}" for c in shown])


def fold_summary(walked: DataFrame) -> DataFrame:
    """Compound return, means, and correlations of in- and out-of-sample values over folds, of values and of their
    ranks (ties share their mean rank); 0 where one side doesn't vary."""
    both = lambda x, y: F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).otherwise(0.0)
    of = Window.partitionBy(*KEY)
    place = lambda c: F.rank().over(of.orderBy(c)) + (F.count(F.lit(1)).over(of.partitionBy(*KEY, c)) - 1) / 2
    walked = walked.withColumns({"_is": place("is_sharpe"), "_oos": place("oos_sharpe")})
    r = both("is_sharpe", "oos_sharpe")
    return walked.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("folds"), (F.product(1 + F.col("oos_total_return")) - 1).alias("oos_total_return"), F.avg("oos_sharpe").alias("oos_sharpe"),
        F.avg("oos_max_drawdown").alias("oos_max_drawdown"), F.avg("oos_win_rate").alias("oos_win_rate"), F.sum("oos_trades").alias("oos_trades"), r.alias("is_oos_correlation"), both("_is", "_oos").alias("is_oos_rank_correlation"),
    )


def stability(chosen: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Share of chosen values (``param, value``) within 20 % of their mean over folds."""
    w = Window.partitionBy(*by, "param")
    near = (F.col("_m") == 0) | (F.abs(F.col("value") - F.col("_m")) <= 0.2 * F.abs("_m"))
    return chosen.withColumn("_m", F.avg("value").over(w)).groupBy(*by).agg(F.avg(F.when(near, 1.0).otherwise(0.0)).alias("stability"))


def sensitivity(found: DataFrame, combinations: list[dict], metric: str = "sharpe") -> DataFrame:
    """``param, sensitivity``: range of the metric's mean over a parameter's values, shares of 1; empty under two parameters."""
    names = sorted({k for c in combinations for k in c})
    spark = found.sparkSession
    rows = spark.createDataFrame([(i, k, float(v)) for i, c in enumerate(combinations) for k, v in c.items()], "combo int, param string, value double")
    if len(names) < 2 or len(combinations) < 2:
        return spark.createDataFrame([], "param string, sensitivity double")
    means = found.select("combo", metric).join(rows, "combo").groupBy("param", "value").agg(F.avg(metric).alias("_m"))
    spread = means.groupBy("param").agg((F.max("_m") - F.min("_m")).alias("_r"))
    total = F.sum("_r").over(Window.partitionBy())
    return spread.select("param", F.when(total > 0, F.col("_r") / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias("sensitivity"))
