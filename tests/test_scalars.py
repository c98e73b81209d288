import datetime as dt

from pyspark.sql import functions as F

from gridframe.functions import codes
from gridframe.functions import scalars as S


def test_map_replace_keeps_unmapped_and_lookup_nulls(spark):
    df = spark.createDataFrame([("Norte",), ("Sul",), ("Paraguai",), (None,)], "r string")
    out = df.select(S.map_replace("r", codes.REGION_PORTUGUESE).alias("a"),
                    S.map_lookup("r", codes.REGION_PORTUGUESE).alias("b")).collect()
    assert [tuple(r) for r in out] == [("N", "N"), ("S", "S"), ("Paraguai", None), (None, None)]


def test_dst_fall_back_is_null_and_spring_gap_is_null(spark):
    # CET 2021: 28 Mar 02:00-03:00 does not exist; 31 Oct 02:00-03:00 happens twice.
    rows = [(dt.datetime(2021, 3, 28, 1, 30),), (dt.datetime(2021, 3, 28, 2, 30),),
            (dt.datetime(2021, 3, 28, 3, 30),), (dt.datetime(2021, 10, 31, 1, 30),),
            (dt.datetime(2021, 10, 31, 2, 30),), (dt.datetime(2021, 10, 31, 3, 30),)]
    df = spark.createDataFrame(rows, "w timestamp_ntz")
    out = [r[0] for r in df.select(S.localize("w", "CET").alias("u")).collect()]
    assert out[0] == dt.datetime(2021, 3, 28, 0, 30)
    assert out[1] is None                      # non-existent hour
    assert out[2] == dt.datetime(2021, 3, 28, 1, 30)
    assert out[3] == dt.datetime(2021, 10, 30, 23, 30)
    assert out[4] is None                      # repeated hour -> NaT in the source
    assert out[5] == dt.datetime(2021, 10, 31, 2, 30)


def test_tz_convert_cet_to_sao_paulo(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10, 0, 0),)], "w timestamp_ntz")
    r = df.select(S.tz_convert("w", "CET", "America/Sao_Paulo").alias("x")).first()[0]
    assert r == dt.datetime(2024, 1, 9, 20, 0)


def test_split_part_and_month_lookup(spark):
    df = spark.createDataFrame([("August 2021",), ("Bogus",)], "m string")
    out = df.select(S.split_part("m", " ", 0).alias("a"), S.split_part("m", " ", 1).alias("b"),
                    S.map_lookup(S.split_part("m", " ", 0), codes.MONTH_NUMBER).alias("n")).collect()
    assert tuple(out[0]) == ("August", "2021", 8)
    assert tuple(out[1]) == ("Bogus", None, None)


def test_num_coerce_and_parts(spark):
    df = spark.createDataFrame([("1.5", 2021, 2, 28), ("n/a", 2021, 2, 30)], "v string, y int, m int, d int")
    out = df.select(S.num_coerce("v").alias("x"), S.ts_from_parts("y", "m", "d").alias("d")).collect()
    assert out[0]["x"] == 1.5 and out[0]["d"] == dt.date(2021, 2, 28)
    assert out[1]["x"] is None and out[1]["d"] is None


def test_weekday_previous_friday_weekend(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 8)]  # Mon..Sun
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = df.select(S.weekday0("d").alias("w"), S.previous_friday("d").alias("f"),
                    S.weekend_flag("d").alias("e")).collect()
    assert [r["w"] for r in out] == list(range(7))
    assert out[5]["f"] == dt.date(2024, 1, 5) and out[6]["f"] == dt.date(2024, 1, 5)
    assert out[2]["f"] == dt.date(2024, 1, 3)
    assert [r["e"] for r in out] == [0, 0, 0, 0, 0, 1, 1]


def test_epoch_floor_and_cyclic(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 0, 1, 500000),), (dt.datetime(1969, 12, 31, 23, 59, 59, 500000),)],
                               "t timestamp_ntz")
    assert [r[0] for r in df.select(S.epoch_seconds("t")).collect()] == [1, -1]
    s, c = S.cyclic(F.lit(6), 24)
    r = spark.range(1).select(s.alias("s"), c.alias("c")).first()
    assert abs(r["s"] - 1.0) < 1e-12 and abs(r["c"]) < 1e-12


def test_safe_name():
    assert S.safe_name("SE/CW") == "SE_CW"
    assert S.safe_name("MIDDLE EAST") == "MIDDLE_EAST"


def test_time_zone_helpers_ignore_session_zone(spark):
    # 2021-03-14 02:30 does not exist in Los Angeles; the helpers must not care
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([("2021-03-14", "02:30:00"), ("2021-03-14", "bad")], "d string, t string")
        out = df.select(S.ts_from_date_time("d", "t").alias("w")).select(
            "w", S.localize("w", "CET").alias("u"), S.epoch_seconds("w").alias("e")).collect()
        assert out[0]["w"] == dt.datetime(2021, 3, 14, 2, 30)
        assert out[0]["u"] == dt.datetime(2021, 3, 14, 1, 30)
        assert out[0]["e"] == int((dt.datetime(2021, 3, 14, 2, 30) - dt.datetime(1970, 1, 1)).total_seconds())
        assert out[1]["w"] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
