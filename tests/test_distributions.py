"""KS by branch and bound, three-parameter Weibull and truncated KDE against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import aggregates as A
from gridframe.operators import stats as ST


def brute_ks(x, cdf):
    x = np.sort(x)
    f, i, n = cdf(x), np.arange(1, len(x) + 1), len(x)
    return max((i / n - f).max(), (f - (i - 1) / n).max())


@pytest.mark.parametrize("rows,bins", [(1 << 16, 16), (64, 2), (0, 1)])
def test_ks_equals_brute_force(spark, rows, bins, monkeypatch):
    monkeypatch.setattr(ST, "KS_ROWS", rows)
    monkeypatch.setattr(ST, "KS_BINS", bins)
    rng = np.random.default_rng(2)
    cols = {"a": rng.normal(5, 2, 3000), "b": np.round(rng.normal(0, 1, 3000), 1), "c": rng.exponential(1e-3, 3000), "d": np.repeat(7.0, 3000)}
    data = [tuple(None if k == "c" and i % 10 == 0 else float(v[i]) for k, v in cols.items()) for i in range(3000)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(4)
    clean = {k: np.array([r[j] for r in data if r[j] is not None]) for j, k in enumerate(cols)}
    cdfs = {k: ST.normal_cdf(float(v.mean()), float(v.std(ddof=1)) or 1.0) for k, v in clean.items()}
    got = ST.ks_statistics(df, list(cols), cdfs)
    for k, v in clean.items():
        assert got[k][1] == len(v) and abs(got[k][0] - brute_ks(v, cdfs[k])) < 1e-12, k


def test_ks_refines_few_bins_and_does_not_sort(spark):
    rng = np.random.default_rng(4)
    v = rng.gamma(3.0, 2.0, 200_000)
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    cdf = ST.normal_cdf(6.0, 3.5)
    assert abs(ST.ks_statistics(df, ["x"], {"x": cdf})["x"][0] - brute_ks(v, cdf)) < 1e-12


def test_ks_p_values():
    # published critical values of D_n: P(D_n >= d) = 0.05
    for n, d in ((5, 0.56328), (10, 0.40925), (20, 0.29408), (40, 0.21012)):
        assert abs(ST.ks_p_value(d, n) - 0.05) < 5e-5
    assert abs(ST.ks_p_value(1.3581 / math.sqrt(10**6), 10**6) - 0.05) < 1e-3
    assert ST.ks_p_value(0.0, 9) == 1.0 and ST.ks_p_value(1.0, 9) == 0.0
    assert abs(ST.ks_p_value(0.06, 140) - ST.ks_p_value(0.06, 141)) < 0.02


def test_ks_normal_edges(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (2.0, None, 3.0), (4.0, None, 3.0)], "a double, b double, c double")
    got = {r["column"]: r for r in ST.test_ks_normal(df, ["a", "b", "c"]).collect()}
    assert got["a"]["normal"] and got["b"]["statistic"] is None and got["c"]["statistic"] is None


def loglik(x, k, loc, lam):
    z = x - loc
    return len(x) * (math.log(k) - k * math.log(lam)) + (k - 1) * np.log(z).sum() - ((z / lam) ** k).sum()


def test_weibull3_recovers_and_is_a_maximum(spark):
    rng = np.random.default_rng(3)
    for shape, loc, scale in ((2.2, 50.0, 8.0), (3.5, -20.0, 300.0)):
        x = loc + scale * rng.weibull(shape, 4000)
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        fit = ST.fit_weibull3(df, "x")
        assert abs(fit["shape"] - shape) < 0.15 * shape and abs(fit["location"] - loc) < 0.06 * scale and abs(fit["scale"] - scale) < 0.07 * scale
        assert fit["n"] == 4000 and not fit["edge"]
        best = loglik(x, fit["shape"], fit["location"], fit["scale"])
        assert abs(best - fit["loglik"]) < 1e-6 * abs(best)
        for _ in range(300):  # no nearby point is better
            k, a, b = fit["shape"] * (1 + rng.normal() * 0.02), fit["location"] + rng.normal() * 0.02 * scale, fit["scale"] * (1 + rng.normal() * 0.02)
            if a < x.min():
                assert loglik(x, k, a, b) <= best + 1e-5
        row = ST.fit_weibull_ks(df, ["x"]).first()
        assert abs(row["ks_stat"] - brute_ks(x, ST.weibull_cdf(fit["shape"], fit["location"], fit["scale"]))) < 1e-9


def test_weibull3_at_the_unbounded_edge(spark):
    rng = np.random.default_rng(8)
    x = 10 + rng.weibull(0.6, 1000)  # the likelihood grows without bound towards the minimum
    fit = ST.fit_weibull3(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")
    assert fit["edge"] and fit["location"] < x.min() and math.isfinite(fit["loglik"])
    for bad in ([], [(2.0,), (2.0,)], [(float("inf"),), (1.0,)]):
        with pytest.raises(ValueError):
            ST.fit_weibull3(spark.createDataFrame(bad, "x double"), "x")


def test_kde_equals_the_full_sum_and_reaches_few_points(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.exponential(1.0, 4000), [60.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = A.agg_kde(df, "v", 200).orderBy("grid").collect()
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.array([r["x"] for r in got])
    want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert len(got) == 200 and np.abs(np.array([r["density"] for r in got]) - want).max() < 1e-15
    pts = df.where("v is not null").select(F.col("v").alias("__x"), F.lit(1.0).alias("__w"))
    terms = A.kernel_terms(pts, float(x[0]), float(x[1] - x[0]), 200, h).count()
    assert terms < 0.2 * 200 * len(v)


def test_weibull_sums_are_added_up_in_tasks(spark, monkeypatch):
    y = np.random.default_rng(8).uniform(0, 1, 5000)
    base = spark.createDataFrame([(float(v),) for v in y], "__y double").repartition(3)
    points = [(1e-3, 0.7), (0.5, 2.0), (100.0, 300.0)]
    # a row of the data is not expanded into a row per point
    monkeypatch.setattr(ST.F, "posexplode", None)
    got = ST._located_sums(base, points)
    for j, (d, k) in enumerate(points):
        ln = np.log((y + d) / (1 + d))
        power = np.exp(k * ln)
        assert got[j][0] == 5000
        assert np.allclose(got[j][1:], [ln.sum(), power.sum(), (power * ln).sum(), (power * ln * ln).sum()], rtol=1e-11)
