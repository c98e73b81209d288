"""Exact quantiles by radix selection against sorted values and ``percentile``."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import aggregates as A
from gridframe.operators import prep as P
from gridframe.operators import selection as SEL

EXTREMES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2),
            2.0, 0.5, 1e308, 1.7976931348623157e308, -1e308, math.inf, -math.inf, 8.0, math.nextafter(8.0, 0), 3.0, -7.25, 2.0 ** 52 + 1, 2.0 ** -1021]


def key_of(x):
    bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_order_key_is_the_bit_pattern(spark):
    rng = random.Random(1)
    xs = EXTREMES + [struct.unpack("<d", struct.pack("<q", rng.getrandbits(63)))[0] for _ in range(3000)]
    xs += [s * 2.0 ** e for e in range(-1074, 1024, 7) for s in (1, -1)] + [math.nextafter(2.0 ** e, 0) for e in range(-1022, 1024, 5)]
    xs = [x for x in xs if not math.isnan(x)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", SEL.order_key(F.col("x")).alias("k")).collect()
    assert all(r["k"] == key_of(r["x"]) for r in got)
    nan = spark.createDataFrame([(math.nan,)], "x double").select(SEL.order_key(F.col("x")).alias("k")).first()["k"]
    assert nan > key_of(math.inf)


@pytest.mark.parametrize("few", [4096, 0])
def test_exact_quantiles_equal_percentile(spark, few, monkeypatch):
    monkeypatch.setattr(SEL, "FEW_ROWS", few)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 else str(rng.integers(0, 5))
        rows.append((g if g != "4" else None, None if i % 11 == 0 else float(rng.normal()) * 10 ** int(rng.integers(-3, 6)),
                     float(rng.integers(0, 4)) if g == "hot" else float(rng.integers(0, 10 ** 6)), None))
    rows += [("one", 5.0, 1.0, None), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    want = {}
    for col in "abc":
        for r in df.groupBy("g").agg(F.count(col).alias("n"), F.percentile(col, probs).alias("q")).collect():
            if r["n"]:
                want[(r["g"], col)] = (r["n"], r["q"])
    got = {(r["g"], r["column"]): (r["n"], r["q"]) for r in SEL.exact_quantiles(df, ["a", "b", "c"], probs, ["g"]).collect()}
    assert got == want
    assert set(SEL.quantiles_of(df, ["a", "c"], [0.5])) == {"a"}


def test_exact_quantiles_of_extremes_and_empty(spark):
    df = spark.createDataFrame([(x,) for x in EXTREMES + [math.nan]], "x double")
    probs = [i / (len(EXTREMES)) for i in range(len(EXTREMES) + 1)]
    got = SEL.exact_quantiles(df, ["x"], probs).first()
    want = sorted(EXTREMES)
    assert got["n"] == len(EXTREMES) + 1
    vals = SEL.rank_values(df, ["x"], probs).orderBy("rank").collect()
    assert [r["value"] for r in vals[:-1]] == want and math.isnan(vals[-1]["value"])
    assert SEL.exact_quantiles(df.limit(0), ["x"], probs).collect() == []


def test_no_buffer_grows_with_distinct_values(spark, monkeypatch):
    """A group of many different values, most rows in one key: every bin table stays
    within 2**16 per wanted bin and no list is longer than FEW_ROWS."""
    monkeypatch.setattr(SEL, "FEW_ROWS", 50)
    tables = []
    keep = SEL._written
    monkeypatch.setattr(SEL, "_written", lambda df, name: tables.append(keep(df, name)) or tables[-1])
    df = spark.range(200_000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
                                     (F.rand(5) * 1000).alias("v"))
    got = {r["g"]: r["q"] for r in SEL.exact_quantiles(df, ["v"], [0.25, 0.5], ["g"]).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5]).alias("q")).collect()}
    assert got == want
    assert tables and max(t.count() for t in tables) <= 2 * 4 * 2 ** 16
    plan = SEL.exact_quantiles(df, ["v"], [0.5], ["g"])._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_box_stats_and_describe_against_pandas(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i % 17 == 0 else float(rng.normal() * 100)) for i in range(900)] + [("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = df.toPandas()
    got = {r["g"]: r for r in A.agg_box_stats(df, ["g"], "v").collect()}
    assert set(got) == {None, "g0", "g1", "g2"}
    for key, r in got.items():
        v = pdf[pdf["g"].isna() if key is None else pdf["g"] == key]["v"].dropna()
        q1, q2, q3 = v.quantile([0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"]], [q1, q2, q3, inside.min(), inside.max()])
        assert r["n_outliers"] == len(v) - len(inside) and r["n"] == len(v)
    stats = {(r["g"], r["stat"]): r["value"] for r in A.agg_describe(df, ["v"], ["g"]).collect()}
    whole = pdf[pdf["g"] == "g1"]["v"].describe()
    assert all(abs(stats[("g1", s)] - whole[s]) < 1e-9 for s in whole.index)
    assert stats[("nothing", "count")] == 0 and stats[("nothing", "50%")] is None


def test_outliers_and_medians(spark):
    rng = np.random.default_rng(6)
    rows = [("train" if i % 2 else "test", float(rng.normal()), None if i % 9 == 0 else float(rng.integers(0, 50))) for i in range(500)]
    df = spark.createDataFrame(rows, "split string, a double, b double")
    pdf = df.toPandas()
    lo, hi = pdf["a"].quantile([0.05, 0.95])
    assert P.outlier_quantile(df, "a", 0.05).count() == ((pdf["a"] > lo) & (pdf["a"] < hi)).sum()
    keep = np.ones(len(pdf), bool)
    for c in "ab":
        q1, q3 = pdf[c].quantile([0.25, 0.75])
        keep &= ~((pdf[c] < q1 - 1.5 * (q3 - q1)) | (pdf[c] > q3 + 1.5 * (q3 - q1)))
    assert P.outlier_iqr(df, ["a", "b"]).count() == keep.sum()
    per = {r["split"]: r["__fill0"] for r in P.fit_impute(df, ["b"], "median", by="split").collect()}
    assert per == {s: pdf[pdf["split"] == s]["b"].median() for s in ("train", "test")}
    filled = P.impute(df, ["b"], "median").where("b is null").count()
    assert filled == 0
    nothing = df.withColumn("b", F.lit(None).cast("double"))
    assert P.outlier_quantile(nothing, "b").count() == 0 and P.impute(nothing, ["b"], "median").where("b is null").count() == 500
