"""Correlations by matrix products against numpy, with many members, unequal lengths and blocks of any size."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import gram, metrics


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(len(x))
    for v in np.unique(x):
        out[x == v] = out[x == v].mean()
    return out


def frame(spark, series):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(i) * (1 + len(k) % 3)), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


@pytest.mark.parametrize(("spearman", "times", "members"), [(False, 1024, 128), (False, 16, 4), (True, 16, 4)])
def test_matches_numpy(spark, monkeypatch, spearman, times, members):
    monkeypatch.setattr(gram, "TIMES", times)
    monkeypatch.setattr(gram, "MEMBERS", members)
    rng = np.random.default_rng(4)
    base = rng.normal(size=90)
    series = {f"m{k:02}": 1e6 + np.round(base[: 90 - 7 * (k % 4)] * (k % 3 - 1) + rng.normal(size=90 - 7 * (k % 4)), 1) for k in range(11)} | {"flat": np.full(50, 3.0), "one": np.array([2.0])}
    got = {(r.a, r.b): r.correlation for r in gram.correlations(frame(spark, series), "close", spearman=spearman).collect()}
    assert len(got) == len(series) ** 2
    for (a, b), v in got.items():
        n = min(len(series[a]), len(series[b]))
        x, y = series[a][:n], series[b][:n]
        if spearman:
            x, y = ranks(x), ranks(y)
        want = 0.0 if x.std() <= 1e-12 or y.std() <= 1e-12 else np.corrcoef(x, y)[0, 1]
        assert abs(v - want) < 1e-9, (a, b)


def test_five_hundred_members(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 500)).cumsum(axis=0)
    got = gram.correlations(frame(spark, {f"s{k:03}": x[:, k] for k in range(500)}), "close").toPandas()
    assert len(got) == 500 * 500
    m = got.pivot(index="a", columns="b", values="correlation").to_numpy()
    assert np.allclose(m, np.corrcoef(x.T), atol=1e-9)


def test_empty_and_as_before(spark):
    empty = spark.createDataFrame([], "symbol string, ts timestamp_ntz, close double")
    assert gram.correlations(empty, "close").count() == 0 and gram.correlations(empty, "close", spearman=True).count() == 0
    df = frame(spark, {"a": np.arange(9.0), "b": np.arange(9.0)[::-1] ** 2, "c": np.array([1.0, 5, 2])})
    key = lambda d: sorted((r.a, r.b, round(r.correlation, 9)) for r in d.collect())
    for spearman in (False, True):
        assert key(gram.correlations(df, "close", spearman=spearman)) == key(metrics.correlations(df, "close", spearman=spearman))
