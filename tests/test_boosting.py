"""Staged boosting: cells, stages and passes against plain boosting on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import boosting as B
from gridframe.operators import forests as FO


def plain(x, y, xq, rounds, rate, depth, bins, l1=0.0, l2=0.0, least_split=2):
    """Boosting by brute force: every split of every node tried on the rows."""
    def soft(s):
        return np.sign(s) * max(abs(s) - l1, 0)

    def fit(m, r, d):
        value = soft(r[m].sum()) / (m.sum() + l2)
        best = (1e-9, None)
        if d and m.sum() >= least_split:
            for f in range(x.shape[1]):
                for t in range(bins - 1):
                    a = m & (x[:, f] <= t)
                    c = m & ~a
                    if a.any() and c.any():
                        gain = sum(soft(r[z].sum()) ** 2 / (z.sum() + l2) for z in (a, c)) - soft(r[m].sum()) ** 2 / (m.sum() + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, t, a, c))
        if best[1] is None:
            return value
        f, t, a, c = best[1]
        return (f, t, fit(a, r, d - 1), fit(c, r, d - 1))

    def say(tree, q):
        if not isinstance(tree, tuple):
            return np.full(len(q), tree)
        return np.where(q[:, tree[0]] <= tree[1], say(tree[2], q), say(tree[3], q))

    f, fq = np.full(len(y), y.mean()), np.full(len(xq), y.mean())
    for _ in range(rounds):
        tree = fit(np.ones(len(y), bool), y - f, depth)
        f, fq = f + rate * say(tree, x), fq + rate * say(tree, xq)
    return fq


def frame(spark, n=240, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 3)).astype(float)
    y = 3 * x[:, 0] - 2 * (x[:, 1] > 2) * x[:, 2] + rng.normal(size=n) + 50
    return spark.createDataFrame([(i, i * 4 // n, float(v), *r) for i, (r, v) in enumerate(zip(x.tolist(), y))], "k long, fold int, y double, x0 double, x1 double, x2 double")


X = ["x0", "x1", "x2"]


@pytest.mark.parametrize("settings", [{"rate": 0.3, "depth": 2}, {"rate": 0.1, "depth": 3, "l1": 2.0, "l2": 5.0}, {"rate": 0.5, "depth": 4, "least_split": 30}])
def test_chain_equals_brute_force(spark, settings):
    rows = FO.binned(frame(spark), X, "y", ["k"], "fold", FO.cut_points(frame(spark), X, 6))
    pdf = rows.toPandas()
    tr, te = pdf[pdf.fold != 1], pdf[pdf.fold == 1]
    got = {r["rounds"]: r for r in B.boosted_scores(B.cells_of(rows, False), [B.Chain(1, 12, **settings)], [1, 5, 12], 3, 6).collect()}
    rate, depth = settings["rate"], settings["depth"]
    rest = {k: v for k, v in settings.items() if k not in ("rate", "depth")}
    for k in (1, 5, 12):
        want = plain(np.stack(tr.b), tr.y.to_numpy(), np.stack(te.b), k, rate, depth, 6, **rest)
        assert abs(got[k]["sse"] - ((te.y - want) ** 2).sum()) < 1e-6 * got[k]["sse"]
        assert got[k]["n"] == len(te)


def test_stages_equal_refits_and_cells_equal_rows(spark):
    rows = FO.binned(frame(spark), X, "y", ["k"], "fold", FO.cut_points(frame(spark), X, 6)).cache()
    staged = {r["rounds"]: r for r in B.boosted_scores(B.cells_of(rows, False), [B.Chain(0, 30)], [3, 10, 30], 3, 6).collect()}
    for k in (3, 10, 30):
        alone = B.boosted_scores(B.cells_of(rows, True), [B.Chain(0, k)], [k], 3, 6).first()
        assert abs(alone["sse"] - staged[k]["sse"]) < 1e-6 and alone["splits"] == staged[k]["splits"]
        assert np.allclose(alone["gains"], staged[k]["gains"])
    assert B.cells_of(rows, False).count() < rows.count()


def test_passes_equal_tasks(spark):
    """Beyond the broadcast bound, level passes over the cells give the same chains, with and without draws."""
    rows = FO.binned(frame(spark, 120), X, "y", ["k"], "fold", FO.cut_points(frame(spark, 120), X, 6))
    cells = B._written(B.cells_of(rows, True), "t")
    chains = [B.Chain(0, 5, 0.3, 2), B.Chain(1, 3, 0.2, 3, 10, 0.7, 0.6, 0.5, 2.0), B.Chain(-1, 4, 0.1, 1)]
    a, c = ({(r["chain"], r["rounds"]): r for r in B.boosted_scores(cells, chains, [2, 3, 5], 3, 6, few_cells=few, checkpoint_rounds=4).collect()} for few in (10**6, 0))
    assert a.keys() == c.keys() and len(a) == 7
    for k in a:
        assert abs(a[k]["sse"] - c[k]["sse"]) < 1e-6 * max(1, a[k]["sse"]) and a[k]["splits"] == c[k]["splits"]
        assert np.allclose(a[k]["gains"], c[k]["gains"])


def test_grid_search_stages_and_refit(spark):
    df = frame(spark)
    grid = {"n_estimators": [3, 8], "learning_rate": [0.1, 0.5], "max_depth": [1, 3], "subsample": [0.8, 1.0]}
    rows = {r["params"]: r for r in B.boosting_grid_search(df, X, "y", ["k"], "fold", 3, grid, bins=6).collect()}
    assert len(rows) == 16 and sum(r["chosen"] for r in rows.values()) == 1
    one = {"n_estimators": 3, "learning_rate": 0.5, "max_depth": 3, "subsample": 1.0}
    alone = B.boosting_grid_search(df, X, "y", ["k"], "fold", 3, combinations=[one], bins=6).first()
    assert abs(alone["cv_mse"] - rows[alone["params"]]["cv_mse"]) < 1e-9
    pdf = FO.binned(df, X, "y", ["k"], "fold", FO.cut_points(df.where("fold < 3"), X, 6)).toPandas()
    tr, te = pdf[pdf.fold < 3], pdf[pdf.fold == 3]
    want = ((te.y - plain(np.stack(tr.b), tr.y.to_numpy(), np.stack(te.b), 3, 0.5, 3, 6)) ** 2).mean()
    assert abs(alone["refit_mse"] - want) < 1e-6
    # draws of rows and features repeat, and do change the model
    drawn = [r for p, r in rows.items() if "subsample=0.8" in p]
    again = {r["params"]: r for r in B.boosting_grid_search(df, X, "y", ["k"], "fold", 3, grid, bins=6).collect()}
    assert all(again[r["params"]]["cv_mse"] == r["cv_mse"] for r in drawn)
    assert any(abs(r["cv_mse"] - rows[r["params"].replace("0.8", "1.0")]["cv_mse"]) > 1e-6 for r in drawn)


def test_staged_boosting_importance_and_empty(spark):
    df = frame(spark).withColumn("test", (F.col("fold") == 3).cast("int"))
    out = B.staged_boosting(df, X, "y", ["k"], "test", [2, 20], bins=6, depth=2, rate=0.3).orderBy("rounds").collect()
    assert [r["rounds"] for r in out] == [2, 20] and out[1]["mse"] < out[0]["mse"] and out[1]["r2"] > 0.8
    last = {i["feature"]: i for i in out[1]["importance"]}
    assert abs(sum(i["gain"] for i in last.values()) - 1) < 1e-9 and last["x0"]["gain"] > last["x1"]["gain"]
    none = B.staged_boosting(df.limit(0), X, "y", ["k"], "test", [2], bins=6).collect()
    assert [r["n"] for r in none] == [0] and none[0]["mse"] is None


def test_a_grown_tree_says_where_its_rows_are():
    rng = np.random.default_rng(5)
    b, y, n = rng.integers(0, 8, (300, 3)), rng.normal(size=300), rng.integers(1, 4, 300).astype(float)
    for depth in (0, 1, 4, 30):
        where = np.zeros(300, dtype=np.int64)
        once = FO.grow(b, y, n, depth, 8, FO.Rule(least_split=5.0), n, where=where)
        apart = FO.grow(b, y, n, depth, 8, FO.Rule(least_split=5.0), n.copy())
        assert all(np.array_equal(p, q) for p, q in zip(once, apart))
        assert np.array_equal(where, FO.descend(once, b)[0])


def test_grid_searches_share_one_model_frame(spark, monkeypatch):
    from gridframe.plans import queries as Q
    made, frame = [], Q.model_frame
    monkeypatch.setattr(Q, "model_frame", lambda *a: made.append(1) or frame(*a))
    nothing = lambda df, *a, **k: FO._ranked(df, [({}, 0.0, 0.0, 0.0)])
    monkeypatch.setattr(B, "boosting_grid_search", nothing)
    monkeypatch.setattr(FO, "forest_grid_search", nothing)
    assert Q.QUERIES["cv_grid"](spark, "/root/testdata/sf0.001").count() == 3 and len(made) == 1
