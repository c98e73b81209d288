"""Halo exchange: windows inside sorted partitions equal windows over all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridframe.operators import ordered as O
from gridframe.operators import timeseries as TS


def frame(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, None if rng.random() < 0.1 else float(np.round(rng.normal(), 3)), float(i)) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "d long, x double, y double")
    return df, pd.DataFrame(rows, columns=["d", "x", "y"]).sort_values("d").reset_index(drop=True)


@pytest.mark.parametrize("n,partitions", [(1, 8), (5, 8), (40, 8), (300, 3), (300, 60)])
def test_lags_rolling_and_sequences(spark, n, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions shorter than the windows stay
    try:
        df, pdf = frame(spark, n)
        got = O.row_lags(df, ["d"], "x", [1, 7, 30, -2]).toPandas().sort_values("d").reset_index(drop=True)
        for k in (1, 7, 30, -2):
            pd.testing.assert_series_equal(got[f"x_lag{k}"], pdf["x"].shift(k), check_names=False)
        got = O.rolling(df, ["d"], "x", 5, {"m": "mean", "s": (30, "std"), "lo": (2, "min"), "one": (1, "sum")}).toPandas().sort_values("d").reset_index(drop=True)
        for name, want in (("m", pdf["x"].rolling(5).mean()), ("s", pdf["x"].rolling(30).std()), ("lo", pdf["x"].rolling(2).min()), ("one", pdf["x"])):
            assert np.allclose(got[name].astype(float), want, equal_nan=True), name
        seq = TS.sliding_sequences(df, ["d"], ["x", "y"], "y", 7).orderBy("row_number").collect()
        assert [r["row_number"] for r in seq] == list(range(8, n + 1))
        for r in seq:
            t = r["row_number"] - 1
            assert r["d"] == t and [w["y"] for w in r["window"]] == [float(v) for v in range(t - 7, t)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_targets_cover_short_and_empty_partitions():
    counts = [3, 0, 1, 2, 0, 4, 1]
    starts = np.concatenate(([0], np.cumsum(counts)))
    for before in range(0, 12):
        for after in (0, 1, 5, 20):
            got = O._halo_targets(counts, before, after)
            need = {t: set(range(max(0, starts[t] - before), starts[t])) | set(range(starts[t + 1], min(starts[-1], starts[t + 1] + after)))
                    for t, n in enumerate(counts) if n}
            have = {t: set() for t in need}
            for p, ranges in enumerate(got):
                for t, lo, hi in ranges:
                    assert starts[p] <= lo < hi <= starts[p + 1]
                    assert not have[t] & set(range(lo, hi))
                    have[t] |= set(range(lo, hi))
            assert have == need


def test_one_sort_and_one_exchange(spark):
    """Beside the checkpointed sort, all lags and windows share one exchange, by partition id; no row is copied but the halos."""
    df, _ = frame(spark, 400)
    halo = O.with_halo(df, ["d"], 30)
    parts = halo.select(O.PID).distinct().count()
    assert halo.where(~F.col(O.OWN)).count() <= 30 * parts
    assert halo.where(O.OWN).count() == 400
    out = O.rolling(df, ["d"], "x", None, {"a": (7, "mean"), "b": (30, "std")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert O.row_lags(df.limit(0), ["d"], "x", [1]).collect() == []


def test_a_hot_date_is_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 8000, 5).otherwise(F.col("id")).alias("d"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    halo = O.with_halo(df, ["d", "id"], 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = halo.where(O.OWN).groupBy(O.PID).count().collect()
    assert max(r["count"] for r in rows) < 8000
    lag = O.row_lags(df, ["d", "id"], "id", [3]).orderBy("d", "id").select("id", "id_lag3").collect()
    ids = [r["id"] for r in lag]
    assert [r["id_lag3"] for r in lag] == [None] * 3 + ids[:-3]
