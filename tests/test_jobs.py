"""Domain jobs on the literal fixtures listed in FIXTURES.md."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridframe.functions import codes
from gridframe.operators import columns as C
from gridframe.operators import reshape as R
from gridframe.plans import jobs as JB
from gridframe.sources import io as IO


def test_settlement_dst_day_drops_repeated_and_skipped_hours(spark):
    # CET fall-back 2021-10-31: 02:00 happens twice (ambiguous -> dropped);
    # spring-forward 2021-03-28: 02:00 does not exist (dropped).  Sao Paulo is
    # UTC-3 in 2021, so the remaining hours land on the local dates below.
    rows = []
    for d, hours in [("2021-10-31", [0, 1, 2, 2, 3, 4]), ("2021-03-28", [0, 1, 2, 3, 4])]:
        for i, hh in enumerate(hours):
            rows.append((d, f"{hh:02d}:00:00", "BRAZIL_SOUTHEAST_CENTRALWEST", float(10 * hh + i)))
    rows.append(("2021-10-31", "05:00:00", "BRAZIL_SOUTH", 999.0))
    raw = spark.createDataFrame(rows, "DateValueCET string, TimeValueCET string, PowerPriceAreaCode string, PriceMWh double")
    out = {r.DateTime: (r.min_settlement_price, r.max_settlement_price, r.avg_settlement_price)
           for r in JB.job_settlement(raw).collect()}
    assert out == {dt.date(2021, 10, 30): (0.0, 34.0, 15.0),   # 00:00, 01:00 CEST and 03:00 CET
                   dt.date(2021, 10, 31): (45.0, 45.0, 45.0),  # 04:00 CET = 00:00 in Sao Paulo
                   dt.date(2021, 3, 27): (0.0, 44.0, 22.0)}    # 00, 01, 03, 04 (02:00 skipped)


def test_capacity_registry_fixture(spark):
    rows = [("SE", "TÉRMICA", dt.date(2020, 6, 1), None, 100.0),          # no end, starts before calendar
            ("NE", "EOLIELÉTRICA", dt.date(2021, 1, 3), dt.date(2021, 1, 5), 10.0),  # ends inside
            ("PY", "TÉRMICA", dt.date(2021, 1, 1), None, 7.0),             # unknown region, dropped
            ("N", "NUCLEAR", dt.date(2022, 1, 1), None, 5.0)]              # starts after: all-zero column
    raw = spark.createDataFrame(rows, "id_subsistema string, nom_tipousina string, dat_entradaoperacao date, "
                                      "dat_desativacao date, val_potenciaefetiva double")
    out = JB.job_capacity(raw, "2021-01-01", "2021-01-06", codes.PLANT_TYPE, codes.REGION_CAPACITY,
                          ("PY",), ("NE", "N", "SE/CW", "S"))
    assert "Nuclear_capacity_N" not in out.columns
    got = {r.DateTime.day: (r.Thermal_capacity_SE_CW, r.Wind_capacity_NE, r.total_capacity_NE)
           for r in out.collect()}
    assert got == {1: (100.0, 0.0, 0.0), 2: (100.0, 0.0, 0.0), 3: (100.0, 10.0, 10.0),
                   4: (100.0, 10.0, 10.0), 5: (100.0, 0.0, 0.0), 6: (100.0, 0.0, 0.0)}


def test_wind_fixture_non_numeric_and_all_null_region(spark):
    rows = [(1, "August 2021", "Nordeste", "5.5"), (1, "August 2021", "Nordeste", "oops"),
            (1, "August 2021", "Sul", "n/a"), (2, "August 2021", "Norte", "1.0")]
    raw = spark.createDataFrame(rows, "`Day of din_instante` int, `Month of din_instante` string, "
                                      "id_subsistema string, val_geraenergiaconmwmed string")
    out = {r.DateTime.day: r for r in JB.job_wind(raw).collect()}
    assert out[1].wind_generation_NE == 5.5 and out[1].wind_generation_S == 0.0
    assert out[1].wind_generation_N is None and out[1].wind_generation_sum == 5.5
    assert out[2].wind_generation_N == 1.0


def test_consumption_two_vintages_and_open_period(spark):
    rows = [(dt.date(2021, 1, 1), dt.date(2021, 1, 4), 30.0, "BRAZIL_NORTH"),
            (dt.date(2021, 1, 2), dt.date(2021, 1, 4), 60.0, "BRAZIL_NORTH"),   # later vintage wins
            (dt.date(2021, 1, 5), dt.date(2021, 1, 7), 14.0, "BRAZIL_NORTH")]   # last period: /7, 1 day
    raw = spark.createDataFrame(rows, "DateForecastCET date, DateValueCET date, VolumeMWh double, "
                                      "PowerPriceAreaCode string")
    out = {r.DateTime.day: r.consumption_N for r in JB.job_consumption(raw).collect()}
    assert out == {4: 20.0, 5: 20.0, 6: 20.0, 7: 2.0}


def test_csv_sources_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, dt.date(2021, 1, 1)), (2, None, dt.date(2022, 5, 3))],
                               "k int, v double, d date")
    p = str(tmp_path / "t")
    IO.write_table(df, p, fmt="csv", partition_by_year_of="d")
    years = [f"{p}/year=2021", f"{p}/year=2022"]
    back = IO.read_csv_many(spark, years, "k int, v double, d date").orderBy("k").collect()
    assert [(r.k, r.v, r.d) for r in back] == [(1, 2.5, dt.date(2021, 1, 1)), (2, None, dt.date(2022, 5, 3))]
    semi = str(tmp_path / "s")
    df.write.option("header", True).option("sep", ";").csv(semi)
    assert IO.read_csv(spark, semi, "k int, v double, d date", sep=";").count() == 2


def test_pivots_keep_unlisted_codes(spark):
    # region X is in no list: its rows get a column and count in the total
    day = dt.date(2021, 1, 1)
    raw = spark.createDataFrame([(day, "N", 1.0), (day, "X", 10.0), (day, "X", 5.0), (day, None, 100.0)],
                                "d date, r string, v double")
    hydro = raw.selectExpr("d DateValueCET", "r Location", "v Value")
    out = JB.job_hydro(hydro, {}, ["N", "S"]).collect()
    assert [r.asDict() for r in out] == [{"DateTime": day, "hydro_inflow_N": 1.0, "hydro_inflow_S": None,
                                          "hydro_inflow_X": 15.0, "daily_sum_hydro_inflow": 16.0}]
    solar = raw.selectExpr("d din_instante", "r id_subsistema", "v val_geraenergiaconmwmed")
    out = JB.job_solar(solar, {}, ["N"]).first()
    assert (out.solar_sum_X, out.solar_mean_X, out.daily_sum_solar) == (15.0, 7.5, 16.0)
    wind = raw.selectExpr("'January 2021' `Month of din_instante`", "1 `Day of din_instante`", "r id_subsistema",
                          "cast(v as string) val_geraenergiaconmwmed")
    out = JB.job_wind(wind, {}, ["N"]).first()
    assert (out.wind_generation_X, out.wind_generation_sum) == (15.0, 16.0)
    use = raw.selectExpr("d DateForecastCET", "d DateValueCET", "r PowerPriceAreaCode", "v VolumeMWh")
    out = JB.job_consumption_by_vintage(use, {}, ["N"]).first()
    assert (out.consumption_X, out.total_consumption) == (15.0, 16.0)
    out = JB.job_consumption(use.where("VolumeMWh <> 5"), {}, ["N"], last_period_days=1).first()
    assert (out.consumption_X, out.daily_sum_consumption) == (10.0, 11.0)
    out = R.pivot_region(raw.where("v <> 5"), ["d"], "r", "v", ["N"]).first()
    assert (out.N, out.X) == (1.0, 10.0)
    assert R.pivot_table_sum_multi(raw, ["d"], "r", ["v"], ["N"]).first().v_X == 15.0


def test_pivots_keep_every_value_and_read_once(spark):
    rows = [("d1", "N", 1.0), ("d1", "X", 2.0), ("d1", "X", 3.0), ("d2", None, 7.0), ("d3", "N", None), (None, "S", 4.0)]
    df = spark.createDataFrame(rows, "d string, r string, v double")
    got = {r["d"]: r for r in R.pivot_table(df, ["d"], "r", "v", ["N", "Q"], "mean", prefix="m_").collect()}
    assert R.pivot_table(df, ["d"], "r", "v", ["N", "Q"], "mean", prefix="m_").columns == ["d", "m_N", "m_Q", "m_S", "m_X"]
    assert got["d1"]["m_X"] == 2.5 and got["d1"]["m_Q"] is None and got["d2"]["m_N"] is None and got[None]["m_S"] == 4.0
    count = {r["d"]: r for r in R.pivot_table(df, ["d"], "r", "v", ["N"], "count").collect()}
    assert count["d1"]["X"] == 2 and count["d3"]["N"] == 0 and count["d2"]["N"] is None
    total = {r["d"]: r for r in R.pivot_sum(df, ["d"], "r", "v", ["N"]).collect()}
    assert total["d3"]["N"] == 0 and total["d1"]["X"] == 5.0 and total["d2"]["N"] is None
    many = spark.range(R.MOST_COLUMNS + 1).select(F.lit(1).alias("d"), F.col("id").cast("string").alias("r"), F.lit(1.0).alias("v"))
    with pytest.raises(ValueError):
        R.pivot_sum(many, ["d"], "r", "v", [])
    plan = R.pivot_sum(df, ["d"], "r", "v", ["N"])._jdf.queryExecution().toString()
    assert "LocalRelation" not in plan and "LogicalRDD" not in plan  # the source is read when the small table is written


def test_cube_equals_the_jobs(spark):
    from gridframe.plans import standins as SI
    sf = "/root/testdata/sf0.001"
    from gridframe.plans.queries import REGION_MAP, REGIONS, START, hydro, solar, wind
    cube = JB.daily_cube(SI.generation_raw(spark, sf), REGION_MAP)
    def rows(df):
        names = sorted(df.columns)
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=repr)
    for mine, theirs in ((JB.hydro_of(cube, REGIONS, START), hydro(spark, sf, START)), (JB.solar_of(cube, REGIONS), solar(spark, sf)), (JB.wind_of(cube, REGIONS), wind(spark, sf))):
        assert rows(mine) == rows(theirs)


def test_settlement_converts_each_tick_once(spark, capsys):
    """A filter on the local day must not repeat the parsing and the time-zone guards."""
    ticks = [("2021-03-28", "01:30:00", 1.0), ("2021-03-28", "02:30:00", 2.0), ("2021-10-31", "02:15:00", 4.0),
             ("2021-10-31", "12:00", 8.0), ("2021-10-31", "9", 16.0), ("2021-10-31", "noon", 32.0), ("2021-10-31", None, 64.0),
             ("2021-10-31", "12:30.5", 128.0), ("2021-10-31", "12:60:00", 256.0), (None, "12:00:00", 512.0)]
    raw = spark.createDataFrame([(None if d is None else dt.date.fromisoformat(d), t, "A", p) for d, t, p in ticks],
                                "DateValueCET date, TimeValueCET string, PowerPriceAreaCode string, PriceMWh double")
    daily = C.filter_year(JB.job_settlement(raw, "A"), "DateTime", 2021)
    capsys.readouterr()
    daily.explain("simple")
    plan = capsys.readouterr().out
    got = {str(r["DateTime"]): (r["avg_settlement_price"], r["max_settlement_price"]) for r in daily.collect()}
    # the gap, the repeated hour, bad text and missing parts have no day
    assert got == {"2021-03-27": (1.0, 1.0), "2021-10-31": ((8.0 + 16.0 + 128.0) / 3, 128.0)}
    assert plan.count("convert_timezone") <= 5 and plan.count("regexp_extract") <= 3


def test_settlement_converts_each_wall_time_once(spark, capsys):
    """Statistics merged over ticks equal those over rows, and the conversion is above a combine by tick."""
    rows = [("2021-05-03", f"{h:02d}:00:00", area, v) for h, vs in {
        4: [1.0, 2.0, 4.0], 5: [1e6, 1e6 + 1, None], 6: [None], 7: [3.5]}.items() for area, v in zip("abc", vs)]
    rows += [("2021-05-05", "12:00:00", "a", 7.0), ("2021-05-07", "12:00:00", "a", None), ("2021-05-09", None, "a", 1.0),
             ("2021-05-09", "x", "a", 1.0), (None, "12:00:00", "a", 1.0)]
    rows += [("2021-05-11", f"{h}:30", "a", 0.1) for h in range(10, 20)]
    raw = spark.createDataFrame(rows, "DateValueCET string, TimeValueCET string, PowerPriceAreaCode string, PriceMWh double")
    daily = JB.job_settlement(raw, None)
    capsys.readouterr()
    daily.explain("simple")
    plan = capsys.readouterr().out
    combine = plan[plan.index("Generate"):]
    assert "convert_timezone" not in combine[combine.index("HashAggregate"):]
    out = {str(r.DateTime): tuple(r)[1:] for r in daily.collect()}
    first, second = out["2021-05-02"], out["2021-05-03"]
    assert first == pytest.approx((7 / 3, (14 / 3 / 2) ** 0.5, 1.0, 4.0))
    values = [1e6, 1e6 + 1, 3.5]
    mean = sum(values) / 3
    assert second == pytest.approx((mean, (sum((v - mean) ** 2 for v in values) / 2) ** 0.5, 3.5, 1e6 + 1), rel=1e-12)
    assert out["2021-05-05"] == (7.0, None, 7.0, 7.0) and out["2021-05-07"] == (None, None, None, None)
    assert out["2021-05-11"] == pytest.approx((0.1, 0.0, 0.1, 0.1), abs=1e-12) and len(out) == 5
