"""Trends against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens.operators import trend


def lowess_numpy(x, y, frac, passes):
    """Cleveland's procedure point by point."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    k = int(frac * n + 1e-10)
    weights = np.ones(n)
    fit = np.zeros(n)
    for step in range(passes + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            w = (np.clip(1 - (d / h) ** 3, 0, None) ** 3 if h > 0 else (d == 0).astype(float)) * weights
            if w.sum() <= 0:
                fit[i] = y[x == x[i]].mean()
                continue
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            var = np.average((x - mx) ** 2, weights=w)
            slope = np.average((x - mx) * (y - my), weights=w) / var if h > 0 and var / h**2 > 1e-12 else 0.0
            fit[i] = my + slope * (x[i] - mx)
        r = np.abs(y - fit)
        s = 6 * np.median(r)
        u = r / s if s > 0 else (r > 0).astype(float)
        weights = np.where(u < 1, (1 - u**2) ** 2, 0)
    return fit


def cloud(spark, distinct):
    rng = np.random.default_rng(3)
    x = rng.integers(0, distinct, 240)
    y = np.sin(x / distinct * 6) + rng.normal(0, 0.3, 240) + (rng.random(240) < 0.05) * 8
    rows = [(int(a), float(b)) for a, b in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "x int, y double")


@pytest.mark.parametrize("distinct, passes, block, limit", [(12, 0, 1024, 10**6), (90, 3, 7, 10**6), (90, 1, 16, 20)])
def test_lowess(spark, distinct, passes, block, limit):
    x, y, df = cloud(spark, distinct)
    want = dict(zip(x.tolist(), lowess_numpy(x, y, 0.2, passes)))
    got = trend.lowess(df, "x", "y", frac=0.2, passes=passes, block=block, limit=limit).collect()
    assert {int(r["x"]): r["rows"] for r in got} == {int(v): int((x == v).sum()) for v in set(x)}
    for r in got:
        assert r["fit"] == pytest.approx(want[int(r["x"])], abs=1e-8)


def test_lowess_with_a_third_of_rows_at_one_x(spark):
    x, y, df = cloud(spark, 40)
    x = np.where(np.arange(240) % 3 == 0, 5, x)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y)], "x int, y double")
    want = dict(zip(x.tolist(), lowess_numpy(x, y, 0.2, 2)))
    for r in trend.lowess(df, "x", "y", passes=2, block=8).collect():
        assert r["fit"] == pytest.approx(want[int(r["x"])], abs=1e-8)


def fit_at(x, y, target, frac):
    """One point of the first pass, x distinct and in order."""
    k = int(frac * len(x) + 1e-10)
    d = np.abs(x - x[target])
    h = np.partition(d, k - 1)[k - 1]
    w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    slope = np.average((x - mx) * (y - my), weights=w) / np.average((x - mx) ** 2, weights=w)
    return my + slope * (x[target] - mx)


@pytest.mark.parametrize("spread", ["even", "crowded", "gap"])
def test_lowess_over_many_blocks(spark, spread):
    rng = np.random.default_rng(5)
    x = np.unique(rng.random(20_000) * 1000)
    if spread == "crowded":
        x = np.unique(np.exp(x / 80))
    if spread == "gap":
        x[len(x) // 3 :] += 1e6
    y = np.sin(x / x[-1] * 9) * 5 + rng.normal(0, 1, len(x))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    fit = {r["x"]: r["fit"] for r in trend.lowess(df, "x", "y", frac=0.1, passes=0, block=64).collect()}
    assert len(fit) == len(x)
    for i in [0, 1, 63, 64, *rng.integers(0, len(x), 150).tolist(), len(x) - 1]:
        assert fit[x[i]] == pytest.approx(fit_at(x, y, i, 0.1), rel=1e-9, abs=1e-9)


def test_lowess_sends_rows_in_proportion(spark, monkeypatch):
    """Twice the points give a little more than twice the requests for nodes, and twice those for blocks."""
    sizes = {}
    real = trend.keep
    for n in (4000, 8000):

        def spy(df, tag, n=n):
            kept = real(df, tag)
            if tag == "lowess-asked":
                sizes[n] = kept.count()
            if tag == "lowess-targets":
                borders = kept.selectExpr("sum(max_from_block - min_from_block + max_to_block - min_to_block + 3) as n")
                sizes[n, "borders"] = borders.first()["n"]
            return kept

        monkeypatch.setattr(trend, "keep", spy)
        df = spark.range(n).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as y")
        trend.lowess(df, "x", "y", passes=0, block=32).count()
    assert sizes[8000] < 3 * sizes[4000]
    assert sizes[8000, "borders"] < 2.2 * sizes[4000, "borders"]


def test_fence(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (100.0,)], "s double")
    assert [r["s"] for r in trend.inside_fence(df, "s").collect()] == [1.0] * 4
    assert trend.inside_fence(df.limit(0), "s").count() == 0


def test_density(spark):
    values = [1.0, 2.0, 2.5, 4.0, 8.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("one", 1.0), ("flat", 2.0), ("flat", 2.0)], "g string, v double")
    got = trend.density(df, ["g"], "v").orderBy("i").collect()
    assert {r["g"] for r in got} == {"a"}
    bw = np.std(values, ddof=1) * 5**-0.2
    grid = np.linspace(1, 8, 100)
    want = np.exp(-0.5 * ((grid[:, None] - np.array(values)) / bw) ** 2).sum(1) / (5 * bw * np.sqrt(2 * np.pi))
    assert [r["density"] for r in got] == pytest.approx(want.tolist())
    overall = trend.density(df.filter("g = 'a'"), [], "v").orderBy("i").collect()
    assert [r["density"] for r in overall] == pytest.approx(want.tolist())


def test_profile_and_means(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "d int, s double")
    rows = {r["d"]: r for r in trend.group_profile(df, "d", "s").collect()}
    assert (rows[1]["rows"], rows[1]["median"], rows[1]["overall_high"]) == (2, 1.5, 5.0)
    assert {r["d"]: r["avg_s"] for r in trend.mean_by(df, "d", "s").collect()} == {1: 1.5, 2: 5.0}
    assert trend.mean_by(df, "d", "s").filter(F.col("d") == 3).isEmpty()
