"""Queries that fit several times read the raw tables once."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ts_tail_period", "ts_ffill_bfill", "feat_pca", "feature_pipeline_random"])
def test_later_passes_read_the_written_daily_table(spark, capsys, name):
    out = E.queries()[name](spark, SF)
    capsys.readouterr()
    out.explain("simple")
    plan = capsys.readouterr().out
    assert f"{SF}/orders.parquet" not in plan and f"{SF}/lineitem.parquet" not in plan
