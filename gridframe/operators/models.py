"""Regression models, cross-validation, metrics and explainers on MLlib.

scikit-learn penalties are mapped to MLlib's parameterisation (n rows, s the
sample std of y, ``standardization=False``):
ridge α -> regParam = α·s/n, elasticNetParam 0; lasso α -> regParam = α,
elasticNetParam 1; ElasticNet(α, r) -> λ = α·r + α·(1−r)·s, ε = α·r/λ.
Ridge CV and leave-one-out use Gram statistics from one distributed pass and
solve every α on the driver (p x p systems), instead of refitting on the data.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prep

PRED = "prediction"


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def assemble(df: DataFrame, features: Sequence[str], out: str = "features", invalid: str = "skip") -> DataFrame:
    """Feature vectors; ``invalid`` is what becomes of rows with NULL or NaN
    features (``skip``, ``error``, or ``keep`` as NaN)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=invalid).transform(df)


def _label_stats(df: DataFrame, label: str, population: bool = False) -> tuple[int, float]:
    sd = F.stddev_pop if population else F.stddev_samp
    r = df.agg(F.count(_c(label)).alias("n"), sd(_c(label)).alias("s")).first()
    return int(r["n"]), float(r["s"] or 0.0)


def linear_model(kind: str = "ols", alpha: float = 0.0, l1_ratio: float = 0.5,
                 n: int | None = None, y_std: float | None = None, label: str = "label",
                 max_iter: int = 1000, tol: float = 1e-10, solver: str | None = None):
    """An unfitted MLlib ``LinearRegression`` with sklearn-equivalent penalty.

    ``y_std`` is the sample std of the label for the iterative solver and the
    population std for ``solver='normal'`` (ridge only: an exact Cholesky solve
    of the normal equations)."""
    from pyspark.ml.regression import LinearRegression
    if kind == "ols":
        reg, en = 0.0, 0.0
    elif kind == "ridge":
        reg, en = alpha * y_std / n, 0.0
    elif kind == "lasso":
        reg, en = alpha, 1.0
    elif kind == "elastic_net":
        reg = alpha * l1_ratio + alpha * (1 - l1_ratio) * y_std
        en = alpha * l1_ratio / reg if reg else 0.0
    else:
        raise ValueError(kind)
    return LinearRegression(featuresCol="features", labelCol=label, predictionCol=PRED,
                            regParam=reg, elasticNetParam=en, standardization=False,
                            solver=solver or ("l-bfgs" if reg else "auto"), maxIter=max_iter, tol=tol)


def fit_linear(df: DataFrame, features: Sequence[str], label: str, kind: str = "ols",
               alpha: float = 0.0, l1_ratio: float = 0.5, solver: str | None = None):
    if solver == "normal" and kind not in ("ols", "ridge"):
        raise ValueError("the normal-equation solver handles OLS and ridge only")
    data = assemble(df, features).where(_c(label).isNotNull())
    n, s = _label_stats(data, label, population=(solver == "normal"))
    return linear_model(kind, alpha, l1_ratio, n, s, label, solver=solver).fit(data)


def fit_random_forest(df: DataFrame, features: Sequence[str], label: str, **params):
    from pyspark.ml.regression import RandomForestRegressor
    data = assemble(df, features).where(_c(label).isNotNull())
    params.setdefault("seed", 42)
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol=PRED,
                                 **params).fit(data)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, **params):
    """Gradient-boosted trees (the XGBoost settings re-aimed).  MLlib's trees end
    at depth 30; a greater ``maxDepth`` is an error."""
    from pyspark.ml.regression import GBTRegressor
    if params.get("maxDepth", 5) > 30:
        raise ValueError(f"maxDepth {params['maxDepth']} is more than MLlib's 30")
    data = assemble(df, features).where(_c(label).isNotNull())
    params.setdefault("seed", 42)
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol=PRED, **params).fit(data)


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every row with its prediction; NULL where a feature is NULL or NaN."""
    whole = reduce(and_, [_c(c).isNotNull() & ~F.isnan(_c(c).cast("double")) for c in features], F.lit(True))
    scored = model.transform(assemble(df, features, invalid="keep")).drop("features")
    return scored.withColumn(PRED, F.when(whole, F.col(PRED)))


# ----------------------------------------------------------------- metrics ---

def eval_metrics(df: DataFrame, label: str, pred: str = PRED, n_features: int | None = None,
                 group: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R², explained variance and adjusted R² in one aggregate."""
    y, p = _c(label).cast("double"), _c(pred).cast("double")
    e = y - p
    base = df.where(y.isNotNull() & p.isNotNull())
    agg = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("__vy"), F.var_pop(e).alias("__ve"))
    # try_divide: a constant target (zero variance) gives NULL, not an ANSI error
    r2 = 1 - F.try_divide(F.col("mse"), F.col("__vy"))
    out = agg.select(*group, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"),
                     (1 - F.try_divide(F.col("__ve"), F.col("__vy"))).alias("explained_variance"))
    if n_features is not None:
        n = F.col("n").cast("double")
        out = out.withColumn("adj_r2", 1 - F.try_divide((1 - F.col("r2")) * (n - 1), n - F.lit(n_features) - 1))
    return out


def eval_actual_vs_pred(df: DataFrame, date: str, label: str, pred: str = PRED,
                        long: bool = False) -> DataFrame:
    wide = df.select(_c(date).alias(date), _c(label).alias("actual"), _c(pred).alias("predicted"))
    if not long:
        return wide
    return wide.unpivot([date], ["actual", "predicted"], "series", "value")


def eval_horizon(df: DataFrame, date: str, label: str, pred: str = PRED) -> DataFrame:
    """Metrics on the first 7 / 30 rows, the last 10 rows and the last 2 months."""
    from .timeseries import head_rows, tail_months, tail_rows
    parts = [("first_7", head_rows(df, [date], 7)), ("first_30", head_rows(df, [date], 30)),
             ("last_10", tail_rows(df, [date], 10)), ("last_2_months", tail_months(df, date, 2))]
    out = None
    for name, part in parts:
        m = eval_metrics(part, label, pred).withColumn("horizon", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


# ------------------------------------------------------------ explainers ----

def explain_coefficients(spark, features: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    rows = [(f, float(c), abs(float(c))) for f, c in zip(features, coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double") \
                .orderBy(F.col("abs_coefficient").desc(), "feature")


def explain_tree_importance(model, features: Sequence[str], scratch: str, top: int = 10) -> DataFrame:
    """Gain-style importance (``featureImportances``) and split counts per
    feature, read from the model's saved node table (inner nodes have
    ``leftChild >= 0``)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(scratch)
    nodes = spark.read.parquet(f"{scratch}/data")
    nd = nodes.select("nodeData.*") if "nodeData" in nodes.columns else nodes
    splits = (nd.where(F.col("leftChild") >= 0)
                .groupBy(F.col("split.featureIndex").alias("idx")).agg(F.count(F.lit(1)).alias("splits")))
    imp = model.featureImportances.toArray()
    base = spark.createDataFrame([(i, f, float(imp[i])) for i, f in enumerate(features)],
                                 "idx int, feature string, gain double")
    return (base.join(splits, "idx", "left").fillna(0, ["splits"])
                .orderBy(F.col("gain").desc(), "feature").limit(top).drop("idx"))


# ------------------------------------------------------ cross-validation ----

def ridge_cv_gram(df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float],
                  fold_col: str = "fold", scoring: str = "mse") -> DataFrame:
    """k-fold ridge CV from per-fold Gram statistics (one grouped pass):
    each α and fold is a p x p solve on the driver; the held-out error uses
    the held-out fold's own Gram statistics (Σ(y − a − xb)² expands into
    them).  ``scoring='mse'`` or ``'r2'`` (sklearn's default scorer); ``chosen``
    marks the best α (ties: the first)."""
    cols = list(features)
    per = prep.gram_by(df, cols, label, fold_col)
    folds = sorted(per)
    rows = []
    for a in alphas:
        scores = []
        for f in folds:
            tr = _sum_gram([per[g] for g in folds if g != f])
            coef, icpt = prep.solve_ridge(tr, a)
            te = per[f]
            sse = _sse(te, coef, icpt)
            if scoring == "r2":
                sst = te["syy"] - te["sy"] ** 2 / te["n"]
                scores.append(1 - sse / sst if sst else float("nan"))
            else:
                scores.append(sse / te["n"])
        rows.append((float(a), float(np.mean(scores))))
    best = min(range(len(rows)), key=lambda i: (-rows[i][1] if scoring == "r2" else rows[i][1], i), default=None)
    return df.sparkSession.createDataFrame([(*r, i == best) for i, r in enumerate(rows)], f"alpha double, mean_{scoring} double, chosen boolean")


def _sum_gram(gs: Sequence[dict]) -> dict:
    out = {k: sum(g[k] for g in gs) for k in ("n", "sx", "sy", "syy", "xtx", "xty")}
    out["columns"] = gs[0]["columns"]
    return out


def _sse(g: dict, coef: np.ndarray, icpt: float) -> float:
    # Σ (y - a - x·b)^2 = syy - 2a sy - 2 b·xty + n a^2 + 2a b·sx + bᵀ XᵀX b
    return float(g["syy"] - 2 * icpt * g["sy"] - 2 * coef @ g["xty"] + g["n"] * icpt ** 2
                 + 2 * icpt * coef @ g["sx"] + coef @ g["xtx"] @ coef)


def ridge_loo(df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float]) -> DataFrame:
    """Leave-one-out error of ridge for every α (sklearn ``RidgeCV`` default), and
    the chosen α (the least error; ties: the first).

    One Gram pass and one eigendecomposition X̃ᵀX̃ = QΛQᵀ.  In the rotated features
    z = Qᵀx̃ every α is diagonal: ŷ = ȳ + Σ z_k (Qᵀc)_k / (λ_k + α) and
    h = 1/n + Σ z_k² / (λ_k + α), so a batch of rows costs two products of its
    rotated features with p x alphas tables; the second pass adds up
    (e / (1 − h))² per α in each task, and Spark adds the tasks."""
    import pyarrow as pa
    cols, alphas = list(features), [float(a) for a in alphas]
    g = prep.gram(df, cols, label)
    spark = df.sparkSession
    if not g["n"]:
        return spark.createDataFrame([], "alpha double, loo_mse double, chosen boolean")
    cxx, cxy, mx, my = prep.centered(g)
    lam, q = np.linalg.eigh(cxx)
    with np.errstate(divide="ignore"):
        inverse = 1.0 / (np.maximum(lam, 0.0)[:, None] + np.array(alphas))
    inverse[~np.isfinite(inverse)] = 0.0  # no penalty on a direction without variance
    weights, n = (q.T @ cxy)[:, None] * inverse, g["n"]
    base = prep._gram_base(df, cols, label)

    def errors(batches):
        total = np.zeros(len(alphas))
        for batch in batches:
            data = np.column_stack([np.asarray(c, dtype=float) for c in batch.columns])
            z = (data[:, :-1] - mx) @ q
            left = 1.0 - 1.0 / n - (z * z) @ inverse
            with np.errstate(divide="ignore", invalid="ignore"):
                e = (data[:, -1:] - my - z @ weights) / left
            total += np.where(np.abs(left) > 1e-12, e * e, 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int32()), pa.array(total)], names=["j", "s"])

    sums = base.mapInArrow(errors, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
    mse = {r["j"]: r["s"] / n for r in sums}
    best = min(range(len(alphas)), key=lambda j: (mse[j], j))
    return spark.createDataFrame([(a, float(mse[j]), j == best) for j, a in enumerate(alphas)], "alpha double, loo_mse double, chosen boolean")


def cross_validate(df: DataFrame, features: Sequence[str], label: str, estimator,
                   param_maps: Sequence[Mapping] | None = None, fold_col: str = "fold",
                   metric: str = "rmse", parallelism: int = 4):
    """MLlib ``CrossValidator`` over a contiguous fold column."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    data = assemble(df, features).where(_c(label).isNotNull()).withColumn(fold_col, _c(fold_col).cast("int"))
    k = data.agg(F.max(fold_col)).first()[0] + 1
    maps = list(param_maps) if param_maps else ParamGridBuilder().build()
    ev = RegressionEvaluator(labelCol=label, predictionCol=PRED, metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev,
                        foldCol=fold_col, numFolds=int(k), parallelism=parallelism)
    return cv.fit(data)


def cv_score(df: DataFrame, features: Sequence[str], label: str, fit, fold_col: str = "fold",
             metric: str = "mae") -> DataFrame:
    """``cross_val_score``: for every fold, refit on the other folds with
    ``fit(train, features, label)`` (so penalties are mapped with that fold's
    own n and label std, as sklearn refits ``Ridge(alpha)``), score the held-out
    fold with :func:`eval_metrics`; returns (fold, score) rows plus the mean as
    fold -1.  One distributed fit and one aggregate per fold."""
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    rows = []
    for k in folds:
        model = fit(df.where(_c(fold_col) != k), features, label)
        sc = eval_metrics(predict(model, df.where(_c(fold_col) == k), features), label).first()[metric]
        rows.append((int(k), float(sc)))
    rows.append((-1, float(np.mean([r[1] for r in rows]))))
    return df.sparkSession.createDataFrame(rows, f"fold int, {metric} double")


def param_grid(estimator, grid: Mapping[str, Sequence]) -> list:
    from pyspark.ml.tuning import ParamGridBuilder
    b = ParamGridBuilder()
    for name, vals in grid.items():
        b = b.addGrid(estimator.getParam(name), list(vals))
    return b.build()


def random_param_maps(estimator, grid: Mapping[str, Sequence], n_iter: int, seed: int = 42) -> list:
    """Seeded sample of ``n_iter`` combinations from the full grid."""
    maps = param_grid(estimator, grid)
    rnd = random.Random(seed)
    return rnd.sample(maps, min(n_iter, len(maps)))


def cv_results(spark, model, maps: Sequence) -> DataFrame:
    rows = []
    for m, score in zip(maps, model.avgMetrics):
        rows.append((", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)),
                     float(score)))
    return spark.createDataFrame(rows, "params string, score double")


def model_compare(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str,
                  models: Mapping[str, callable]) -> DataFrame:
    """Fit each model on ``train``, score on ``valid``: (model, mse, rmse, mae, r2)."""
    out = None
    for name, fit in models.items():
        m = fit(train, features, label)
        pr = predict(m, valid, features)
        sc = eval_metrics(pr, label).withColumn("model", F.lit(name))
        out = sc if out is None else out.unionByName(sc)
    return out.select("model", "n", "mse", "rmse", "mae", "r2")
