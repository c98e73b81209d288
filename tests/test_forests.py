"""Histogram trees against brute force, and shared grids against single trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import forests as FO


def data(n, p=3, bins=8, seed=0):
    rng = np.random.default_rng(seed)
    b = rng.integers(0, bins, (n, p))
    y = b[:, 0] * 2.0 - (b[:, 1] > 3) * 5 + rng.normal(size=n) + 100
    return b, y, rng.poisson(1.0, n).astype(float)


def brute(b, y, w, least, depth, bins):
    """A nested (feature, bin, left, right) or a mean, by trying every split."""
    mean = (w * y).sum() / w.sum()
    sse = (w * (y - mean) ** 2).sum()
    best = (1e-9, None)
    if depth:
        for f in range(b.shape[1]):
            for t in range(bins - 1):
                left = b[:, f] <= t
                if left.sum() < least or (~left).sum() < least:
                    continue
                parts = [(w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (left, ~left)]
                if sse - sum(parts) > best[0] + 1e-9:
                    best = (sse - sum(parts), (f, t, left))
    if best[1] is None:
        return mean
    f, t, left = best[1]
    return (f, t, *(brute(b[m], y[m], w[m], least, depth - 1, bins) for m in (left, ~left)))


def nested(tree, node=0):
    feature, at, left, right, value, _ = tree
    if feature[node] < 0:
        return value[node]
    return (feature[node], at[node], nested(tree, left[node]), nested(tree, right[node]))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) else abs(a - b) < 1e-9


@pytest.mark.parametrize("least,depth", [(1, 3), (5, 6), (40, 4)])
def test_grow_takes_the_best_split_of_every_node(least, depth):
    for seed in range(5):
        b, y, w = data(120, seed=seed)
        keep = w > 0
        b, y, w = b[keep], y[keep] - 100, w[keep]
        assert same(nested(FO.grow(b, y, w, depth, 8, FO.Rule(least, tiny=1e-9))), brute(b, y, w, least, depth, 8))


def test_descend_reads_shallower_trees():
    b, y, w = data(300, seed=3)
    deep = FO.grow(b, y - 100, np.ones(300), 9, 8, FO.Rule(2))
    _, got = FO.descend(deep, b, [(0, 2), (3, 2), (9, 2), (9, 50)])
    for k, depth in enumerate((0, 3, 9)):
        own = FO.grow(b, y - 100, np.ones(300), depth, 8, FO.Rule(2))
        assert np.allclose(got[:, k], FO.descend(own, b, [(99, 2)])[1][:, 0])
    node, _ = FO.descend(deep, b)
    assert len(np.unique(got[:, 3])) < len(np.unique(node))


def frame(spark, n=400, folds=3):
    b, y, _ = data(n, seed=9)
    return spark.createDataFrame([(i, i * (folds + 1) // n, float(v), *map(float, x)) for i, (x, v) in enumerate(zip(b, y))],
                                 "k long, fold int, y double, x0 double, x1 double, x2 double")


def test_passes_and_tasks_grow_the_same_trees(spark):
    """Upper levels by shared passes, the rest in tasks: as trees that a task grows alone."""
    df = frame(spark)
    cuts = FO.cut_points(df, ["x0", "x1", "x2"], 8)
    rows = FO.binned(df, ["x0", "x1", "x2"], "y", ["k"], "fold", cuts).cache()
    specs = [FO.Spec(0, i, h, 3, 7 + i) for i in range(3) for h in (0, 1)] + [FO.Spec(1, 0, 2, 10, None)]
    readouts = [(1, 2), (3, 2), (8, 2), (8, 60)]

    def run(few):
        out = FO.forest_predictions(rows, specs, readouts, 3, 8, aside=3, few_rows=few).collect()
        return {(r["id"], r["family"], r["number"], r["fold"]): r["values"] for r in out}

    alone, passes = run(10_000), run(40)
    assert alone.keys() == passes.keys() and len(alone) == 700
    assert all(np.allclose(alone[k], passes[k]) for k in alone)
    # each tree is the one that brute force grows on the rows it trains on
    pdf = rows.toPandas()
    spec = specs[-1]
    tr, te = pdf[(pdf.fold != 2) & (pdf.fold != 3)], pdf[pdf.fold == 2]
    tree = FO.grow(np.stack(tr.b.to_numpy()), tr.y.to_numpy() - 100, np.ones(len(tr)), 8, 8, FO.Rule(10, tiny=1e-9))
    want = FO.descend(tree, np.stack(te.b.to_numpy()), readouts)[1] + 100
    assert all(np.allclose(alone[(i, 1, 0, 2)], v) for i, v in zip(te.id, want))


def test_bootstrap_weights_are_poisson_and_repeatable():
    ids = np.arange(100_000) * 7919
    w = FO.bootstrap_weights(ids, 5)
    assert (w == FO.bootstrap_weights(ids, 5)).all() and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w, FO.bootstrap_weights(ids, 6))[0, 1]) < 0.02


def test_grid_search_equals_single_searches(spark):
    df = frame(spark)
    grid = {"n_estimators": [2, 5], "max_depth": [2, None], "min_samples_split": [2, 30], "min_samples_leaf": [1, 4], "bootstrap": [True, False]}
    x = ["x0", "x1", "x2"]
    rows = FO.forest_grid_search(df, x, "y", ["k"], "fold", 3, grid, bins=8).collect()
    assert len(rows) == 32 and sum(r["chosen"] for r in rows) == 1
    assert min(rows, key=lambda r: r["cv_mse"])["place"] == 1
    every = {r["params"]: r for r in rows}
    one = {"n_estimators": 5, "max_depth": None, "min_samples_split": 30, "min_samples_leaf": 4, "bootstrap": True}
    alone = FO.forest_grid_search(df, x, "y", ["k"], "fold", 3, combinations=[one], bins=8).first()
    again = every[alone["params"]]
    assert abs(alone["cv_mse"] - again["cv_mse"]) < 1e-9 and abs(alone["refit_r2"] - again["refit_r2"]) < 1e-9
    # the refit trains on folds 0-2 and is scored on fold 3
    pdf = FO.binned(df, x, "y", ["k"], "fold", FO.cut_points(df.where("fold < 3"), x, 8)).toPandas()
    tr, te = pdf[pdf.fold < 3], pdf[pdf.fold == 3]
    tree = FO.grow(np.stack(tr.b.to_numpy()), tr.y.to_numpy() - 100, np.ones(len(tr)), 30, 8, FO.Rule(tiny=1e-9))
    guess = FO.descend(tree, np.stack(te.b.to_numpy()), [(30, 2)])[1][:, 0] + 100
    want = ((te.y - guess) ** 2).mean()
    key = "n_estimators=5, max_depth=None, min_samples_split=2, min_samples_leaf=1, bootstrap=False"
    assert abs(every[key]["refit_mse"] - want) < 1e-9
    assert {r["n_estimators"] for r in FO.sampled(grid, 9)} == {2, 5} and FO.sampled(grid, 9) == FO.sampled(grid, 9)


def test_empty_and_null_rows(spark):
    df = frame(spark, 40).withColumn("x1", F.when(F.col("k") % 5 > 0, F.col("x1")))
    rows = FO.binned(df, ["x0", "x1"], "y", ["k"], "fold", FO.cut_points(df, ["x0", "x1"], 8))
    assert rows.count() == 32
    none = FO.forest_grid_search(df.limit(0), ["x0"], "y", ["k"], "fold", 3, {"n_estimators": [2], "max_depth": [2], "min_samples_split": [2],
                                                                             "min_samples_leaf": [1], "bootstrap": [True]}).first()
    assert none["cv_mse"] is None
