import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridframe.operators import aggregates as A
from gridframe.operators import columns as C
from gridframe.operators import joins as J
from gridframe.operators import ordered as O
from gridframe.operators import reshape as R
from gridframe.operators import timeseries as TS


def _series(spark, n=200, null_every=5, seed=1):
    rnd = random.Random(seed)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), None if i % null_every == 0 else rnd.uniform(0, 100))
            for i in range(n)]
    return spark.createDataFrame(rows, "d date, x double").repartition(7)


def test_global_row_number_matches_sort(spark):
    df = _series(spark).withColumn("k", F.rand(3))
    out = O.global_row_number(df, ["k", "d"], "rn").toPandas().sort_values("rn")
    assert list(out["rn"]) == list(range(1, 201))
    assert list(out["k"]) == sorted(out["k"])


def test_ffill_bfill_match_pandas(spark):
    df = _series(spark)
    pdf = df.toPandas().sort_values("d").reset_index(drop=True)
    ff = O.forward_fill(df, ["d"], ["x"]).toPandas().sort_values("d").reset_index(drop=True)
    bf = O.forward_fill(df, ["d"], ["x"], backward=True).toPandas().sort_values("d").reset_index(drop=True)
    pd.testing.assert_series_equal(ff["x"], pdf["x"].ffill(), check_names=False)
    pd.testing.assert_series_equal(bf["x"], pdf["x"].bfill(), check_names=False)


def test_lags_and_rolling_match_pandas(spark):
    df = _series(spark, null_every=1000)
    pdf = df.toPandas().sort_values("d").reset_index(drop=True)
    lg = O.row_lags(df, ["d"], "x", [1, 7]).toPandas().sort_values("d").reset_index(drop=True)
    assert np.allclose(lg["x_lag7"], pdf["x"].shift(7), equal_nan=True)
    rl = O.rolling(df, ["d"], "x", 7, {"m": "mean", "s": "std"}).toPandas().sort_values("d").reset_index(drop=True)
    assert np.allclose(rl["m"], pdf["x"].rolling(7).mean(), equal_nan=True)
    assert np.allclose(rl["s"], pdf["x"].rolling(7).std(), equal_nan=True)


def test_cumulative_sum(spark):
    df = _series(spark, null_every=1000)
    pdf = df.toPandas().sort_values("d")
    out = O.cumulative_sum(df, ["d"], "x", "cs").toPandas().sort_values("d")
    assert np.allclose(out["cs"].values, pdf["x"].cumsum().values, equal_nan=True)


def test_interval_activity_equals_range_join(spark):
    # no end; starts before the calendar; ends inside; end <= start (never active)
    rows = [("T", "N", dt.date(2020, 12, 1), None, 10.0), ("T", "N", dt.date(2021, 1, 5), dt.date(2021, 1, 8), 5.0),
            ("W", "S", dt.date(2021, 1, 3), dt.date(2021, 1, 3), 7.0), ("W", "S", dt.date(2021, 1, 9), None, 2.0),
            ("W", "S", dt.date(2021, 1, 6), dt.date(2021, 1, 2), 4.0)]
    reg = spark.createDataFrame(rows, "t string, r string, s date, e date, cap double")
    long = J.interval_activity(reg, start="s", end="e", amount="cap", keys=["t", "r"],
                               cal_start="2021-01-01", cal_end="2021-01-10", day="day").toPandas()
    got = {(a.t, a.r, a.day): a.cap for a in long.itertuples() if a.cap != 0}
    want = {}
    for day in pd.date_range("2021-01-01", "2021-01-10").date:
        for t, r, s, e, cap in rows:
            if s <= day and (e is None or e > day):
                want[(t, r, day)] = want.get((t, r, day), 0) + cap
    assert got == want


def test_dedup_keep_first_and_pivot_duplicates(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "k int, o int, v string")
    out = C.dedup_keep_first(df, ["k"], ["o"]).orderBy("k").collect()
    assert [(r.k, r.v) for r in out] == [(1, "a"), (2, "b")]
    with pytest.raises(R.DuplicatePivotKey):
        R.pivot_region(df, ["k"], "v", "o", ["a"], check_unique=False) and \
            R.pivot_region(df.union(df), ["k"], "v", "o", ["a", "b", "c"], check_unique=True)


def test_sum_all_null_is_zero_and_missing_cell_null(spark):
    # wind: a region whose values are all non-numeric sums to 0; a region with no rows stays NULL
    df = spark.createDataFrame([(dt.date(2021, 1, 1), "N", None), (dt.date(2021, 1, 1), "S", 2.0)],
                               "d date, r string, v double")
    agg = A.agg_sum_by_keys(df, ["d", "r"], "v")
    wide = R.pivot_region(agg, ["d"], "r", "v", ["N", "S", "NE"]).first()
    assert wide["N"] == 0 and wide["S"] == 2.0 and wide["NE"] is None


def test_filter_exclude_keeps_nulls(spark):
    df = spark.createDataFrame([("PY",), ("N",), (None,)], "c string")
    assert sorted(r.c or "" for r in C.filter_exclude_code(df, "c", ["PY"]).collect()) == ["", "N"]


def test_skew_and_std_single_row_groups(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 8.0), (1, 27.0), (1, 64.0), (2, 5.0)], "g int, x double")
    out = {r.g: r for r in df.groupBy("g").agg(A.skew_corrected("x").alias("u"), A.skew_biased("x").alias("b"),
                                                  F.stddev_samp("x").alias("s")).collect()}
    assert abs(out[1].u - 1.4791194917701886) < 1e-12
    assert abs(out[1].b - 0.9922) < 1e-4
    assert out[2].u is None and out[2].s is None


def test_last_vintage_two_vintages(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), dt.date(2021, 1, 10), 10.0),
                                (dt.date(2021, 1, 5), dt.date(2021, 1, 10), 20.0),
                                (dt.date(2021, 1, 12), dt.date(2021, 1, 10), 99.0)],
                               "issue date, valid date, v double")
    r = A.agg_last_vintage(df, ["valid"], "issue", "valid", values=["v"]).first()
    assert r.v == 20.0


def test_expand_period_final_open_period(spark):
    df = spark.createDataFrame([("N", dt.date(2021, 1, 1), 70.0), ("N", dt.date(2021, 1, 8), 7.0)],
                               "r string, s date, v double")
    out = TS.expand_period(df, group=["r"], start="s", value="v", out_value="dv", day="day").orderBy("day").collect()
    assert len(out) == 8  # 7 days of the first period, 1 day for the last (divided by 7)
    assert out[0].dv == 10.0 and out[-1].dv == 1.0 and out[-1].day == dt.date(2021, 1, 8)


def test_missing_dates_weekend(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 15) if d not in (6, 7)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = TS.missing_dates(df, "d").orderBy("DateTime").collect()
    assert [(r.DateTime.day, r.weekday) for r in out] == [(6, 5), (7, 6)]


def test_weekend_friday_match_counts_pairs(spark):
    rows = [(dt.date(2024, 1, 5), 1.0), (dt.date(2024, 1, 5), 2.0), (dt.date(2024, 1, 6), 1.0),
            (dt.date(2024, 1, 7), 3.0)]
    df = spark.createDataFrame(rows, "d date, p double")
    r = J.weekend_friday_match(df, "d", "p").first()
    assert (r.weekend_rows, r.pairs, r.matches) == (2, 4, 1)
    assert math.isclose(r.match_pct, 25.0)


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    h = {r.bin: r["count"] for r in A.agg_histogram(df, "x", 5).collect()}
    assert sum(h.values()) == 11 and h[5] == 3


def test_resample_daily_zero_fill(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 3), 1.0), ("A", dt.datetime(2024, 1, 3, 4), 2.0),
            ("B", dt.datetime(2024, 1, 2, 1), 5.0)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, v double")
    out = sorted((r.g, r.DateTime.day, r.v) for r in TS.resample_daily_sum(df, "g", "ts", "v").collect())
    assert out == [("A", 1, 1.0), ("A", 2, 0.0), ("A", 3, 2.0), ("B", 2, 5.0)]


def test_drop_constant_zero_cols(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, None), (2, 0.0, 0.0, None)], "k int, a double, b double, c double")
    assert C.drop_constant_zero_cols(df, ["a", "b", "c"]).columns == ["k", "b"]


def test_kde_exact_and_binned(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    ex = A.agg_kde(df, "x", 50).orderBy("grid").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    want = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in ex["x"]]
    assert np.allclose(ex["density"], want, rtol=1e-9)
    bn = A.agg_kde(df, "x", 50, binned=2000).orderBy("grid").toPandas()
    assert np.allclose(bn["density"], ex["density"], atol=2e-3)


def test_sequenced_splits_a_hot_key(spark):
    # a third of all rows share one date: the range partitioner samples the
    # full (date, tie-break) key, so the hot date is spread over partitions
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(dt.date(2024, 1, 1)))
         .otherwise(F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 1000).cast("int"))).alias("d"),
        F.col("id").alias("k")).repartition(8)
    # at this toy size AQE would coalesce everything into one partition; at
    # real sizes it targets the advisory partition size instead
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seq = O.sequenced(df, ["d", "k"])
        sizes = [r["count"] for r in seq.groupBy(O.PID).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == n and len(sizes) > 2
    assert max(sizes) < n / 3          # the hot date is not in one task
    rn = O.global_row_number(df, ["d", "k"], "rn").agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(rn) == (1, n, n)


def test_fill_both_directions_one_pass(spark):
    df = _series(spark, null_every=4)
    df = df.withColumn("y", F.col("x")).withColumn("z", F.col("x"))
    pdf = df.toPandas().sort_values("d").reset_index(drop=True)
    out = O.fill(df, ["d"], ffill=["x"], bfill=["y"], both=["z"]).toPandas().sort_values("d").reset_index(drop=True)
    pd.testing.assert_series_equal(out["x"], pdf["x"].ffill(), check_names=False)
    pd.testing.assert_series_equal(out["y"], pdf["y"].bfill(), check_names=False)
    pd.testing.assert_series_equal(out["z"], pdf["z"].ffill().bfill(), check_names=False)


def test_empty_inputs(spark):
    from gridframe.operators import prep as P
    e = spark.createDataFrame([], "d date, x double")
    frames = [O.global_row_number(e, ["d"], "rn"), O.fill(e, ["d"], ffill=["x"]),
              O.rolling(e, ["d"], "x", 3, {"m": "mean"}), O.row_lags(e, ["d"], "x", [1]),
              P.split_chrono(e, ["d"]), P.fold_assign(e, ["d"], 5), P.impute(e, ["x"], "mean"),
              P.scale(e, ["x"])[0], P.outlier_quantile(e, "x"), P.outlier_iqr(e, ["x"]),
              A.agg_histogram(e, "x"), A.agg_kde(e, "x"), TS.calendar_spine(e, "d"), TS.tail_months(e, "d")]
    assert all(f.count() == 0 for f in frames)


def test_join_null_safe_matches_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, va string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, vb string")
    out = {(r.k, r.va, r.vb) for r in J.join_null_safe(a, b, ["k"]).collect()}
    assert out == {(None, "y", "q"), (1, "x", "p")}


def test_missing_flags_and_broadcast_check(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 3),)], "d date")
    flags = {r.DateTime.day: r.is_missing for r in TS.missing_flags(df, "d").collect()}
    assert flags == {1: False, 2: True, 3: False}
    small = spark.range(10)
    big = spark.range(100)
    plan_small = J.broadcast_if_small(small, max_rows=50)._jdf.queryExecution().analyzed().toString()
    plan_big = J.broadcast_if_small(big, max_rows=50)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan_small or "broadcast" in plan_small.lower()
    assert "broadcast" not in plan_big.lower()


def test_unpivot_and_scale_inverse(spark):
    from gridframe.operators import prep as P
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "k int, a double, b double")
    long = R.unpivot_melt(df, ["k"], ["a", "b"], "var", "val").orderBy("k", "var").collect()
    assert [(r.k, r.var, r.val) for r in long] == [(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0), (2, "b", 5.0)]
    scaled, st = P.scale(df.withColumn("z", F.col("a")), ["z"])
    m, s = st["z"]
    back = P.scale_inverse(scaled, "z", m, s, "a_back").collect()
    assert all(abs(r.a_back - r.a) < 1e-12 for r in back)
