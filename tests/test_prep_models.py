import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import models as M
from gridframe.operators import prep as P
from gridframe.operators import stats as ST


def _frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = 3 * x1 - 2 * x2 + 0.5 * x3 + rng.normal(scale=0.3, size=n) + 10
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a), float(b), float(c), float(t))
            for i, (a, b, c, t) in enumerate(zip(x1, x2, x3, y))]
    return spark.createDataFrame(rows, "d date, x1 double, x2 double, x3 double, y double"), np.c_[x1, x2, x3], y


def test_split_chrono_int_truncation(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    out = P.split_chrono(df, ["k"]).groupBy("split").count().collect()
    counts = {r.split: r["count"] for r in out}
    assert counts == {"train": 64, "validation": 16, "test": 21}


def test_fold_assign_like_kfold(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    folds = [r.fold for r in P.fold_assign(df, ["k"], 5).orderBy("k").collect()]
    assert folds == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_scaler_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (5.0, 5.0, None)], "a double, b double, c double")
    out, st = P.scale(df, ["a", "b", "c"], "standard")
    rows = out.collect()
    assert [r.b for r in rows] == [0.0, 0.0, 0.0] and all(r.c is None for r in rows)
    assert math.isclose(rows[0].a, -1.224744871391589)
    mm, _ = P.scale(df, ["a", "b"], "minmax")
    assert [r.b for r in mm.collect()] == [0.0, 0.0, 0.0]


def test_impute_strategies_and_invalid(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "a double")
    assert P.impute(df, ["a"], "mean").collect()[3].a == 2.0
    assert P.impute(df, ["a"], "median").collect()[3].a == 1.0
    assert P.impute(df, ["a"], "most_frequent").collect()[3].a == 1.0
    allnull = spark.createDataFrame([(None,), (None,)], "a double")
    assert P.impute(allnull, ["a"], "mean").collect()[0].a is None
    try:
        P.impute(df, ["a"], "bogus")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_outliers(spark):
    df = spark.createDataFrame([(float(x), None if x == 3 else float(x)) for x in range(100)] + [(1000.0, 1.0)],
                               "t double, u double")
    q = P.outlier_quantile(df, "t", 0.01).count()
    assert q == 97  # strictly inside (1.0, 99.0), the linear 1% and 99% quantiles
    kept = P.outlier_iqr(df, ["t", "u"])
    assert kept.where("t = 1000").count() == 0 and kept.where("u is null").count() == 1


def _yj_np(x, lam):
    out = np.empty_like(x)
    p = x >= 0
    out[p] = np.log1p(x[p]) if abs(lam) < 1e-12 else ((x[p] + 1) ** lam - 1) / lam
    out[~p] = -np.log1p(-x[~p]) if abs(lam - 2) < 1e-12 else -((-x[~p] + 1) ** (2 - lam) - 1) / (2 - lam)
    return out


def test_yeo_johnson_mle_matches_bruteforce(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=400) - 0.5
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = P.fit_yeo_johnson(df, ["x"])["x"]
    grid = np.linspace(-2, 2, 4001)
    ll = [-len(x) / 2 * np.log(_yj_np(x, g).var()) + (g - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x))) for g in grid]
    assert abs(lam - grid[int(np.argmax(ll))]) < 0.01


def test_ridge_penalty_mapping_matches_closed_form(spark):
    df, X, y = _frame(spark)
    alpha = 5.0
    m = M.fit_linear(df, ["x1", "x2", "x3"], "y", "ridge", alpha=alpha)
    Xc, yc = X - X.mean(0), y - y.mean()
    coef = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), coef, atol=1e-4)
    g = P.gram(df, ["x1", "x2", "x3"], "y")
    c2, _ = P.solve_ridge(g, alpha)
    assert np.allclose(c2, coef, atol=1e-8)


def test_ols_matches_numpy(spark):
    df, X, y = _frame(spark)
    m = M.fit_linear(df, ["x1", "x2", "x3"], "y", "ols")
    A_ = np.c_[X, np.ones(len(y))]
    sol = np.linalg.lstsq(A_, y, rcond=None)[0]
    assert np.allclose(m.coefficients.toArray(), sol[:3], atol=1e-6) and abs(m.intercept - sol[3]) < 1e-6


def test_ridge_loo_and_cv_match_bruteforce(spark):
    df, X, y = _frame(spark, n=60)
    alphas = [0.1, 10.0]
    loo = {r.alpha: r.loo_mse for r in M.ridge_loo(df, ["x1", "x2", "x3"], "y", alphas).collect()}
    for a in alphas:
        errs = []
        for i in range(len(y)):
            mask = np.arange(len(y)) != i
            Xt, yt = X[mask], y[mask]
            mx, my = Xt.mean(0), yt.mean()
            b = np.linalg.solve((Xt - mx).T @ (Xt - mx) + a * np.eye(3), (Xt - mx).T @ (yt - my))
            errs.append((y[i] - (my + (X[i] - mx) @ b)) ** 2)
        assert abs(loo[a] - np.mean(errs)) < 1e-6 * max(1, np.mean(errs))
    f = P.fold_assign(df, ["d"], 5)
    cv = {r.alpha: r.mean_mse for r in M.ridge_cv_gram(f, ["x1", "x2", "x3"], "y", alphas).collect()}
    idx = np.array_split(np.arange(len(y)), 5)
    for a in alphas:
        sc = []
        for te in idx:
            tr = np.setdiff1d(np.arange(len(y)), te)
            mx, my = X[tr].mean(0), y[tr].mean()
            b = np.linalg.solve((X[tr] - mx).T @ (X[tr] - mx) + a * np.eye(3), (X[tr] - mx).T @ (y[tr] - my))
            sc.append(np.mean((y[te] - my - (X[te] - mx) @ b) ** 2))
        assert abs(cv[a] - np.mean(sc)) < 1e-6


def test_rfe_drops_weakest(spark):
    df, X, y = _frame(spark)
    rk = {r.feature: (r.ranking, r.selected) for r in P.feat_rfe_linear(df, ["x1", "x2", "x3"], "y", 2).collect()}
    assert rk["x3"] == (2, False) and rk["x1"][1] and rk["x2"][1]


def test_anova_f_matches_numpy(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 7.0), ("c", 2.0), ("c", 2.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    f = P.anova_f(df, ["x"], "g").first().f_score
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    allx = np.array([x for _, x in rows])
    ssb = sum(len(v) * (np.mean(v) - allx.mean()) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    assert math.isclose(f, (ssb / 2) / (ssw / 4), rel_tol=1e-12)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0), (4.0, 5.0)], "y double, p double")
    r = M.eval_metrics(df, "y", "p", n_features=1).first()
    e = np.array([-0.5, 0.0, 1.0, -1.0])
    assert math.isclose(r.mse, np.mean(e ** 2)) and math.isclose(r.mae, np.mean(np.abs(e)))
    assert math.isclose(r.r2, 1 - np.mean(e ** 2) / np.var([1, 2, 3, 4]))


def test_weibull_fit_recovers_parameters(spark):
    rng = np.random.default_rng(3)
    x = 7.0 * rng.weibull(2.5, size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    k, lam, n = ST.fit_weibull(df, "x")
    lx = np.log(x)
    g = lambda kk: np.sum(x ** kk * lx) / np.sum(x ** kk) - 1 / kk - lx.mean()
    assert abs(g(k)) < 1e-4 and n == 3000
    assert abs(lam - np.mean(x ** k) ** (1 / k)) < 1e-3


def test_normality_moments_and_ks(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v), float(w)) for v, w in zip(rng.normal(size=2000), rng.exponential(size=2000))],
                               "a double, b double")
    jb = {r.column: r.normal for r in ST.test_normality_moments(df, ["a", "b"]).collect()}
    assert jb == {"a": True, "b": False}
    ks = {r.column: r.normal for r in ST.test_ks_normal(df, ["a", "b"]).collect()}
    assert ks["b"] is False


def test_hash_split_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = P.split_random(df, "k").orderBy("k").collect()
    b = P.split_random(df, "k").orderBy("k").collect()
    assert a == b
    u = spark.createDataFrame([("1",)], "k string").select(P.hash_unit("k")).first()[0]
    assert u == 3301589560 / 2 ** 32
    assert F is not None


def _enet_cd(X, y, alpha, l1_ratio, iters=5000):
    """sklearn ElasticNet objective by coordinate descent (intercept unpenalised)."""
    n, p = X.shape
    Xc, yc = X - X.mean(0), y - y.mean()
    b = np.zeros(p)
    z = (Xc ** 2).sum(0) / n
    for _ in range(iters):
        for j in range(p):
            r = yc - Xc @ b + Xc[:, j] * b[j]
            rho = Xc[:, j] @ r / n
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (z[j] + alpha * (1 - l1_ratio))
    return b


def test_lasso_and_elastic_net_mapping(spark):
    df, X, y = _frame(spark, n=400, seed=4)
    for kind, alpha, r in [("lasso", 0.3, 1.0), ("elastic_net", 0.3, 0.5)]:
        m = M.fit_linear(df, ["x1", "x2", "x3"], "y", kind, alpha=alpha, l1_ratio=r)
        want = _enet_cd(X, y, alpha, r)
        assert np.allclose(m.coefficients.toArray(), want, atol=2e-3), (kind, m.coefficients, want)


def test_scale_per_split(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("test", 10.0), ("test", 10.0)], "split string, a double")
    out = {(r.split, r.a) for r in P.scale_per_split(df, ["a"]).collect()}
    assert out == {("train", -1.0), ("train", 1.0), ("test", 0.0)}


def test_ridge_normal_solver_closed_form(spark):
    df, X, y = _frame(spark, n=200, seed=7)
    alpha = 3.0
    m = M.fit_linear(df, ["x1", "x2", "x3"], "y", "ridge", alpha=alpha, solver="normal")
    Xc, yc = X - X.mean(0), y - y.mean()
    coef = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), coef, atol=1e-9)
    assert abs(m.intercept - (y.mean() - X.mean(0) @ coef)) < 1e-9


def test_quantile_bucket_and_anova_on_buckets(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(100)] + [(None, 1.0)], "y double, x double")
    b = P.quantile_bucket(df, "y", 4, "cls")
    counts = {r.cls: r["count"] for r in b.groupBy("cls").count().collect()}
    assert counts == {0: 25, 1: 25, 2: 25, 3: 25, None: 1}
    f = P.feat_select_kbest_f(b.where("cls is not null"), ["x", "y"], "cls", 1).first()
    assert f.feature == "y"


def test_cv_score_matches_numpy(spark):
    df, X, y = _frame(spark, n=100, seed=9)
    f = P.fold_assign(df, ["d"], 5)
    fit = lambda a, b, c: M.fit_linear(a, b, c, "ridge", alpha=1.0, solver="normal")
    got = {r.fold: r.mae for r in M.cv_score(f, ["x1", "x2", "x3"], "y", fit).collect()}
    scores = []
    for te in np.array_split(np.arange(len(y)), 5):
        tr = np.setdiff1d(np.arange(len(y)), te)
        mx, my = X[tr].mean(0), y[tr].mean()
        b = np.linalg.solve((X[tr] - mx).T @ (X[tr] - mx) + np.eye(3), (X[tr] - mx).T @ (y[tr] - my))
        scores.append(np.mean(np.abs(y[te] - my - (X[te] - mx) @ b)))
    assert np.allclose([got[k] for k in range(5)], scores, atol=1e-8)
    assert abs(got[-1] - np.mean(scores)) < 1e-8


def test_gbt_depth_over_limit_raises(spark):
    with pytest.raises(ValueError):
        M.fit_gbt(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), ["x"], "y", maxDepth=31)
