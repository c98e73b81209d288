"""Coordinate descent on Gram statistics, leave-one-out in the eigenbasis, ANOVA moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import models as M
from gridframe.operators import prep as P

X = ["x0", "x1", "x2", "x3"]


def frame(spark, n=120, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 1]
    x[:, 3] = x[:, 0] * 0.9 + rng.normal(size=n) * 0.1
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=n) + 30
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "x0 double, x1 double, x2 double, x3 double, y double")
    return df, x, y


@pytest.mark.parametrize("ratio", [1.0, 0.5, 0.0])
def test_penalised_path_is_optimal(spark, ratio):
    df, x, y = frame(spark)
    alphas = [0.05, 3.0, 0.4, 0.4, 100.0]
    path = P.penalised_path(P.gram(df, X, "y"), alphas, ratio)
    assert [p[0] for p in path] == alphas
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)

    def cost(b, a):
        return ((yc - xc @ b) ** 2).sum() / (2 * n) + a * ratio * np.abs(b).sum() + a * (1 - ratio) / 2 * (b * b).sum()

    rng = np.random.default_rng(1)
    for a, b, icpt, violation in path:
        assert violation < 1e-8 and abs(icpt - (y.mean() - x.mean(0) @ b)) < 1e-9
        slope = xc.T @ (yc - xc @ b) / n - a * (1 - ratio) * b
        assert all(abs(s - a * ratio * np.sign(c)) < 1e-8 if c else abs(s) <= a * ratio + 1e-8 for s, c in zip(slope, b))
        assert all(cost(b, a) <= cost(b + rng.normal(size=4) * 0.01, a) + 1e-12 for _ in range(200))
    assert ratio == 0.0 or not path[-1][1].any()


def test_loo_equals_refits(spark):
    df, x, y = frame(spark, 25)
    alphas = [1e-6, 0.3, 5.0, 1e9]
    got = M.ridge_loo(df, X, "y", alphas).collect()
    want = []
    for a in alphas:
        e = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            xm, ym = x[keep].mean(0), y[keep].mean()
            b = np.linalg.solve((x[keep] - xm).T @ (x[keep] - xm) + a * np.eye(4), (x[keep] - xm).T @ (y[keep] - ym))
            e.append((y[i] - ym - (x[i] - xm) @ b) ** 2)
        want.append(np.mean(e))
    assert np.allclose([r["loo_mse"] for r in got], want, rtol=1e-6)
    assert [r["chosen"] for r in got] == [i == int(np.argmin(want)) for i in range(4)]
    assert M.ridge_loo(df.limit(0), X, "y", alphas).collect() == []
    same = df.withColumn("x4", F.lit(1.0))  # a column without variance changes nothing
    assert np.allclose([r["loo_mse"] for r in M.ridge_loo(same, [*X, "x4"], "y", alphas).collect()], want, rtol=1e-6)


def test_anova_with_a_class_for_most_rows(spark):
    """As many classes as distinct prices: numpy's F, and no list in the plan."""
    rng = np.random.default_rng(5)
    n = 150_000
    label = rng.integers(0, 100_000, n)
    x = np.column_stack([rng.normal(size=n) + label % 7, 1e6 + rng.normal(size=n)])
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"k": label, "a": x[:, 0], "b": x[:, 1]}))
    got = {r["feature"]: r["f_score"] for r in P.anova_f(df, ["a", "b"], "k").collect()}
    _, inverse, counts = np.unique(label, return_inverse=True, return_counts=True)
    for j, c in enumerate("ab"):
        v = x[:, j] - x[:, j].mean()
        mean = np.bincount(inverse, v) / counts
        ssb, ssw = (counts * mean**2).sum(), ((v - mean[inverse]) ** 2).sum()
        want = (ssb / (len(counts) - 1)) / (ssw / (n - len(counts)))
        assert abs(got[c] - want) < 1e-8 * want
    plan = P.anova_f(df, ["a", "b"], "k")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_anova_nulls_and_few_classes(spark):
    rows = [("p", 1.0, None), ("p", 2.0, 3.0), ("q", 4.0, 5.0), ("q", None, 9.0), (None, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["feature"]: r["f_score"] for r in P.anova_f(df, ["a", "b"], "k").collect()}
    assert abs(got["a"] - (6.25 * 2 / 3) / (0.5 / 1)) < 1e-9  # class means 1.5 (two rows) and 4 (one)
    assert abs(got["b"] - (2 * (7 - 17 / 3) ** 2 + (3 - 17 / 3) ** 2) / 8) < 1e-9
    assert all(r["f_score"] is None for r in P.anova_f(df.where("k = 'p'"), ["a"], "k").collect())
