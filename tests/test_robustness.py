"""Readers and fits on inputs that used to lose rows or values silently."""

import math

import numpy as np
import pytest

from gridframe.operators import models as M
from gridframe.operators import prep as P
from gridframe.operators import stats as ST
from gridframe.sources import io as IO


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,extra,a\n2,z,1\nNaN,z,3\n")
    got = IO.read_csv(spark, str(tmp_path / "x.csv"), "a int, b double")
    assert got.columns == ["a", "b"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2.0), (3, None)]
    assert got.count() == 2
    with pytest.raises(ValueError, match="not in the CSV header"):
        IO.read_csv(spark, str(tmp_path / "x.csv"), "a int, c int")


def test_csv_bad_cell_and_other_header_fail(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n4,3\n")
    (tmp_path / "3.csv").write_text("a,b\nx,2\n")
    paths = [str(tmp_path / f"{i}.csv") for i in (1, 2, 3)]
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_csv(spark, paths[:2], "a int, b int").collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        IO.read_csv(spark, paths[2], "a int, b int").collect()
    both = IO.read_csv_many(spark, paths[:2], "a int, b int, c string", same_schema=False)
    assert sorted(tuple(r) for r in both.collect()) == [(1, 2, None), (3, 4, None)]
    assert dict(both.dtypes) == {"a": "int", "b": "int", "c": "string"}


def test_prediction_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 6.0), (4, None, 8.0)], "id int, x double, y double")
    got = {r["id"]: r["prediction"] for r in M.predict(M.fit_linear(df, ["x"], "y"), df, ["x"]).collect()}
    assert got[4] is None and len(got) == 4 and got[2] == pytest.approx(4.0)


def test_yeo_johnson_beyond_first_range(spark):
    x = np.log1p(np.random.default_rng(3).gamma(2.0, 1.0, 400) ** 3 + 50) * 4
    df = spark.createDataFrame([(float(v),) for v in 40 - x], "x double")
    lam = P.fit_yeo_johnson(df, ["x"])["x"]

    def loglik(k):
        v = 40 - x
        return -len(v) / 2 * math.log(np.var(((v + 1) ** k - 1) / k)) + (k - 1) * np.log1p(v).sum()

    assert lam > 2.0 and loglik(lam) >= max(loglik(lam - 0.01), loglik(lam + 0.01))
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert P.fit_yeo_johnson(flat, ["x"])["x"] == -2.0


def test_weibull_shapes_out_of_first_range(spark):
    x = 3 * (-np.log(np.random.default_rng(4).uniform(0.01, 0.99, 500))) ** (1 / 400.0)
    shape, scale, n = ST.fit_weibull(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x")
    assert 300 < shape < 550 and scale == pytest.approx(3, rel=0.01) and n == 500
    for bad in ([1.0, 0.0], [1.0, -2.0], [2.0, 2.0], [None]):
        with pytest.raises(ValueError):
            ST.fit_weibull(spark.createDataFrame([(v,) for v in bad], "x double"), "x")
