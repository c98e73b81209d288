"""Registered queries: one per operator ID of the survey, run on the driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame built from
whole driver tables (through :mod:`standins`) with the library operators.
Floating outputs are rounded (``rnd``) exactly as in the SQL oracle so the
results can be compared by value.  The oracle text lives in :mod:`oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import boosting as BO
from ..operators import columns as C
from ..operators import forests as FO
from ..operators import joins as J
from ..operators import models as M
from ..operators import ordered as O
from ..operators import prep as P
from ..operators import reshape as R
from ..operators import setops as SO
from ..operators import stats as ST
from ..operators import timeseries as TS
from ..session import scratch_dir
from ..sources import io as IO
from . import jobs as JB
from . import standins as SI

DT = "DateTime"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Driver-run parameters (stand-ins for the energy dictionaries and dates; the
# area and the dates are those of the domain jobs).
REGION_MAP = codes.DRIVER_REGION_CODE
REGIONS = codes.DRIVER_REGIONS
AREA = "AMERICA"
START = "1996-01-01"
CAL_START, CAL_END = "1997-01-01", "1999-12-31"


def q(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _half_away(c, n: int):
    # std::round on the binary value: floor(|x|*10^n + 0.5) with a pure-double
    # floor (w - w mod 1; fmod is exact), restoring the sign afterwards.
    # Beyond 2^52 every double is integral already.
    m = float(10 ** n)
    v = F.abs(c) * m
    w = v + 0.5
    return F.signum(c) * F.when(v >= F.lit(4.5e15), v).otherwise(w - F.pmod(w, F.lit(1.0))) / m


def rr(c, n: int = 4):
    """Round for comparison: first to 8 decimals, then to ``n``, both half away
    from zero on the binary value (``std::round(x*10^k)/10^k``, as the SQL
    engine does).  The first step snaps summation-order noise back onto exact
    decimal values (a mean such as 292.47 / 8 = 36.55875), so exact ties round
    the same way in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    # + 0.0 turns a -0.0 (noise just below zero) into +0.0, as in the oracle
    return (_half_away(_half_away(c, 8), n) if n < 8 else _half_away(c, n)) + F.lit(0.0)


def rnd(df: DataFrame, n: int = 4, digits: dict | None = None) -> DataFrame:
    """Round every floating column to ``n`` decimals (``digits`` overrides per
    column), the same rule as the oracle."""
    digits = digits or {}
    return df.select(*[rr(F.col(f"`{f.name}`"), digits.get(f.name, n)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def t(spark, d, name):
    return SI.table(spark, d, name)


# ------------------------------------------------------------ daily tables ---

def forward(spark, d):
    return JB.job_forward_price(SI.forward_raw(spark, d))


# Daily tables over all areas and all days; the domain jobs pass their area and dates.

def settlement(spark, d, area=None):
    return JB.job_settlement(SI.settlement_raw(spark, d), area=area)


def hydro(spark, d, start=None):
    return JB.job_hydro(SI.hydro_raw(spark, d), REGION_MAP, REGIONS, start)


def solar(spark, d, start=None):
    return JB.job_solar(SI.solar_raw(spark, d), REGION_MAP, REGIONS, start)


def wind(spark, d):
    return JB.job_wind(SI.wind_raw(spark, d), REGION_MAP, REGIONS)


def capacity(spark, d, start, end):
    return JB.job_capacity(SI.registry_raw(spark, d), start, end, {}, REGION_MAP, ("PY",), REGIONS)


def consumption(spark, d, start=None):
    return JB.job_consumption(SI.consumption_raw(spark, d), REGION_MAP, REGIONS, start,
                              ("l_orderkey", "l_linenumber"))


def consumption_last(spark, d):
    raw = SI.consumption_raw(spark, d)
    df = raw.select(F.col("DateForecastCET").alias("issue"), F.col("DateValueCET").alias("valid"),
                    F.col("VolumeMWh").alias("consumption"),
                    S.map_replace("PowerPriceAreaCode", REGION_MAP).alias("Region"),
                    "l_orderkey", "l_linenumber")
    return A.agg_last_vintage(df, ["valid", "Region"], "issue", "valid", ["l_orderkey", "l_linenumber"],
                              ["consumption", "issue"])


def weather_stations(spark, d):
    return SI.weather_raw(spark, d), SI.stations(spark, d)


# =============================================================== flagship ====

@q("job_settlement")
def q_job_settlement(spark, d):
    return rnd(settlement(spark, d, AREA))


# ========================================================= 2.1 sources ======

ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


@q("src_csv")
def q_src_csv(spark, d):
    path = scratch_dir(spark, "csv")
    IO.write_table(t(spark, d, "orders"), path, fmt="csv")
    return IO.read_csv(spark, path, ORDERS_SCHEMA)


@q("src_csv_sep")
def q_src_csv_sep(spark, d):
    path = scratch_dir(spark, "csvsep")
    t(spark, d, "orders").write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return IO.read_csv(spark, path, ORDERS_SCHEMA, sep=";")


@q("src_multi_file_union")
def q_src_multi_file_union(spark, d):
    base = scratch_dir(spark, "peryear")
    o = t(spark, d, "orders")
    IO.write_table(o, base, fmt="csv", partition_by_year_of="o_orderdate")
    years = sorted(r[0] for r in o.select(F.year("o_orderdate")).distinct().collect())
    return IO.read_csv_many(spark, [f"{base}/year={y}" for y in years], ORDERS_SCHEMA)


@q("src_parquet")
def q_src_parquet(spark, d):
    return rnd(IO.read_parquet(spark, f"{d}/lineitem.parquet",
                               ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]))


@q("snk_table")
def q_snk_table(spark, d):
    path = scratch_dir(spark, "sink")
    IO.write_table(forward(spark, d), path, partition_by_year_of=DT)
    return rnd(IO.read_table_back(spark, path).withColumn("year", F.col("year").cast("int")))


# ============================================ 2.2 projection / filters =====

@q("project_rename")
def q_project_rename(spark, d):
    return rnd(C.project_rename(t(spark, d, "orders"),
                                {"o_orderkey": "order_id", "o_orderdate": DT, "o_totalprice": "price",
                                 "o_orderpriority": "priority"}, drop=["priority"]))


@q("rename_by_rule")
def q_rename_by_rule(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rnd(C.rename_by_rule(li, ["l_quantity", "l_extendedprice"], C.prefix_suffix("li_", "_v")))


@q("select_by_pattern")
def q_select_by_pattern(spark, d):
    li = t(spark, d, "lineitem")
    return rnd(C.select_by_pattern(li, keep=["l_orderkey", "l_linenumber"], numeric=True,
                                   regex="(price|discount|tax)$"))


def qty_by_flag(spark, d):
    li = t(spark, d, "lineitem").withColumn(DT, F.to_date("l_shipdate"))
    wide = R.pivot_table(li, [DT], "l_returnflag", "l_quantity", ["A", "N", "R", "X"], "sum", prefix="qty_")
    return wide.select(DT, *[F.coalesce(F.col(f"qty_{v}"), F.lit(0.0)).alias(f"qty_{v}") for v in ["A", "N", "R", "X"]])


@q("drop_constant_zero_cols")
def q_drop_constant_zero_cols(spark, d):
    w = qty_by_flag(spark, d)
    return rnd(C.drop_constant_zero_cols(w, ["qty_A", "qty_N", "qty_R", "qty_X"]))


@q("filter_range")
def q_filter_range(spark, d):
    o = t(spark, d, "orders")
    return rnd(C.filter_range(o, "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"),
                              F.lit("1996-12-31").cast("timestamp_ntz"),
                              isin=["1-URGENT", "2-HIGH"], isin_column="o_orderpriority"))


@q("filter_year")
def q_filter_year(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return C.filter_year(li, "l_shipdate", 1998)


def customer_codes(spark, d):
    """Customer region codes, unknown (NULL) for customers in debit: the NULL
    codes exercise the keep-NULL rule of the exclusion filter."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    cr = SI.customer_region(spark, d)
    j = cr.join(c, "c_custkey")
    return j.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(None))
                    .otherwise(F.col("r_name")).alias("region_code"))


@q("filter_exclude_code")
def q_filter_exclude_code(spark, d):
    return C.filter_exclude_code(customer_codes(spark, d), "region_code", ["MIDDLE EAST"])


@q("drop_nulls")
def q_drop_nulls(spark, d):
    w = SI.weather_raw(spark, d).select("ts", "ESTACAO", "precipitation", "radiation")
    return rnd(C.drop_nulls(w, ["precipitation", "radiation"]))


@q("dedup_keep_first")
def q_dedup_keep_first(spark, d):
    return rnd(C.dedup_keep_first(forward(spark, d), [DT], ["delivery_start"]))


@q("rows_any_null")
def q_rows_any_null(spark, d):
    w = SI.weather_raw(spark, d).select("ts", "ESTACAO", "precipitation", "radiation")
    return rnd(C.rows_any_null(w))


@q("unit_convert")
def q_unit_convert(spark, d):
    h = SI.hydro_raw(spark, d)
    out = C.unit_convert(h, "Value", 1000.0, out="value_mwh", unit_col="unit", unit="MWh")
    return rnd(out.select("DateValueCET", "Location", "value_mwh", "unit"))


# ================================================================ 2.3 joins =

def dailies(spark, d):
    """The daily tables as the jobs clean them: one area, from their first day on.
    Hydro, solar and wind come from one cube."""
    cube = JB.daily_cube(SI.generation_raw(spark, d), REGION_MAP)
    return [settlement(spark, d, AREA), JB.hydro_of(cube, REGIONS, START), JB.solar_of(cube, REGIONS, START), JB.wind_of(cube, REGIONS),
            capacity(spark, d, CAL_START, CAL_END), consumption(spark, d, START)]


@q("join_left_chain")
def q_join_left_chain(spark, d):
    return rnd(J.join_left_chain(forward(spark, d), [settlement(spark, d), hydro(spark, d)], DT))


@q("join_inner")
def q_join_inner(spark, d):
    return rnd(J.join_inner_chain([settlement(spark, d), hydro(spark, d)], DT))


@q("join_index_chain")
def q_join_index_chain(spark, d):
    cube = JB.daily_cube(SI.generation_raw(spark, d), REGION_MAP)
    return rnd(J.join_inner_chain([settlement(spark, d), JB.hydro_of(cube, REGIONS), JB.wind_of(cube, REGIONS),
                                   JB.solar_of(cube, REGIONS), consumption(spark, d)], DT))


@q("join_full_outer")
def q_join_full_outer(spark, d):
    return rnd(J.join_full_outer(settlement(spark, d), hydro(spark, d), DT))


def hourly_by_area(spark, d, event_type=None):
    e = t(spark, d, "events")
    if event_type:
        e = e.where(F.col("event_type") == event_type)
    cr = SI.customer_region(spark, d)
    return e.join(cr, e.user_id == cr.c_custkey).select(
        F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.col("r_name").alias("area"), "value")


@q("join_multi_key")
def q_join_multi_key(spark, d):
    a = hourly_by_area(spark, d).groupBy("date", "hour", "area").agg(F.avg("value").alias("mean_value"))
    b = hourly_by_area(spark, d, "view").groupBy("date", "hour", "area").agg(
        F.count(F.lit(1)).alias("views"))
    return rnd(a.join(b, ["date", "hour", "area"], "inner"))


@q("join_dim_lookup")
def q_join_dim_lookup(spark, d):
    w, st = weather_stations(spark, d)
    out = JB.weather_hourly(w, st, "radiation", {"MIDDLE EAST": "ASIA"})
    return rnd(out)


@q("join_self_prev_friday")
def q_join_self_prev_friday(spark, d):
    return rnd(J.weekend_friday_match(forward(spark, d), DT, "forward_price"), 6)


@q("join_agg_back")
def q_join_agg_back(spark, d):
    return rnd(JB.job_temperature(SI.temperature_raw(spark, d)))


@q("join_interval_active")
def q_join_interval_active(spark, d):
    reg = SI.registry_raw(spark, d).select(
        F.col("nom_tipousina").alias("ptype"), S.map_replace("id_subsistema", REGION_MAP).alias("region"),
        "dat_entradaoperacao", "dat_desativacao", "val_potenciaefetiva")
    first, last = "dat_entradaoperacao", "dat_desativacao"
    days = reg.agg(F.min(first).alias("lo"), F.max(F.greatest(first, last)).alias("hi")).first()
    long = J.interval_activity(reg, start=first, end=last, amount="val_potenciaefetiva", keys=["ptype", "region"],
                               cal_start=str(days["lo"])[:10], cal_end=str(days["hi"])[:10])
    return rnd(long.where(F.col("val_potenciaefetiva") != 0)
                   .withColumnRenamed("val_potenciaefetiva", "capacity"))


@q("semi_anti_dates")
def q_semi_anti_dates(spark, d):
    f = forward(spark, d)
    s = settlement(spark, d)
    semi = J.semi_join(f, s, DT).withColumn("kind", F.lit("semi"))
    anti = J.anti_join(f, s, DT).withColumn("kind", F.lit("anti"))
    return rnd(semi.unionByName(anti))


def p0p1_features(spark, d):
    return [settlement(spark, d), hydro(spark, d)]


def with_features(p, feats):
    return J.join_left_chain(p, feats, DT)


@q("join_p0_p1")
def q_join_p0_p1(spark, d):
    p = JB.job_p0_p1(forward(spark, d), None)
    return rnd(with_features(p, p0p1_features(spark, d)))


@q("join_p0_p1_inner")
def q_join_p0_p1_inner(spark, d):
    p = JB.job_p0_p1(forward(spark, d), None, fill_front_from_next=False, require_both=True)
    return rnd(with_features(p, p0p1_features(spark, d)))


# ========================================================= 2.4 aggregates ===

def events_region(spark, d):
    e = t(spark, d, "events")
    cr = SI.customer_region(spark, d)
    return e.join(cr, e.user_id == cr.c_custkey).select(
        "event_id", "ts", "event_type", "value", F.col("r_name").alias("region"))


@q("agg_daily_stats")
def q_agg_daily_stats(spark, d):
    e = t(spark, d, "events").withColumn(DT, F.to_date("ts"))
    return rnd(A.agg_daily_stats(e, [DT], "value"))


@q("agg_daily_stats_ext")
def q_agg_daily_stats_ext(spark, d):
    ticks = JB.settlement_ticks(SI.settlement_raw(spark, d)).withColumn(DT, F.to_date("ts"))
    return rnd(A.agg_daily_stats_ext(ticks, [DT, "PowerPriceAreaCode"], "PriceMWh", ["ts", "row_id"]), digits={"var": 0})


@q("agg_sum_by_keys")
def q_agg_sum_by_keys(spark, d):
    h = SI.hydro_raw(spark, d).select(F.col("DateValueCET").alias(DT), F.col("Location").alias("region"), "Value")
    return rnd(A.agg_sum_by_keys(h, [DT, "region"], "Value", {"Value": "inflow"}))


@q("agg_sum_mean")
def q_agg_sum_mean(spark, d):
    s = SI.solar_raw(spark, d).select(F.to_date("din_instante").alias(DT),
                                      F.col("id_subsistema").alias("region"), "val_geraenergiaconmwmed")
    return rnd(A.agg_sum_mean(s, [DT, "region"], "val_geraenergiaconmwmed", "solar_sum", "solar_mean"))


@q("agg_sum_mean_std_peak")
def q_agg_sum_mean_std_peak(spark, d):
    e = t(spark, d, "events").withColumn(DT, F.to_date("ts"))
    return rnd(A.agg_sum_mean_std_peak(e, [DT, "event_type"], "value"))


@q("agg_by_calendar")
def q_agg_by_calendar(spark, d):
    return rnd(A.agg_by_calendar(events_region(spark, d), "ts", ["weekday", "hour"], "value",
                                 ["region"], ("mean", "sum", "count")))


@q("agg_group_mean_sd")
def q_agg_group_mean_sd(spark, d):
    e = t(spark, d, "events")
    return rnd(A.agg_group_mean_sd(e, [F.hour("ts").alias("hour"), F.col("event_type")], "value"))


@q("agg_by_year_cols")
def q_agg_by_year_cols(spark, d):
    w = qty_by_flag(spark, d)
    return rnd(A.agg_by_year_cols(w, DT, {"returned": ["qty_R"], "all": ["qty_A", "qty_N", "qty_R"]}))


@q("agg_last_vintage")
def q_agg_last_vintage(spark, d):
    return rnd(consumption_last(spark, d))


@q("agg_describe")
def q_agg_describe(spark, d):
    return rnd(A.agg_describe(t(spark, d, "events"), ["value"], ["event_type"]))


@q("agg_missing_summary")
def q_agg_missing_summary(spark, d):
    w = SI.weather_raw(spark, d).select("DATA", "Hora_UTC", "precipitation", "radiation", "wind_speed", "ESTACAO")
    return rnd(A.agg_missing_summary(w))


@q("agg_value_counts")
def q_agg_value_counts(spark, d):
    o = t(spark, d, "orders")
    cr = SI.customer_region(spark, d)
    j = o.join(cr, o.o_custkey == cr.c_custkey)
    return A.agg_value_counts(j, [F.col("r_name").alias("region"), S.day_name("o_orderdate").alias("weekday")])


@q("agg_distinct")
def q_agg_distinct(spark, d):
    return A.agg_distinct(t(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")), "d")


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@q("agg_skewness")
def q_agg_skewness(spark, d):
    return rnd(A.agg_skewness(t(spark, d, "lineitem"), LI_NUM), 6)


@q("agg_corr")
def q_agg_corr(spark, d):
    return rnd(A.agg_corr(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 6)


@q("agg_corr_grouped")
def q_agg_corr_grouped(spark, d):
    return rnd(A.agg_corr_grouped(t(spark, d, "lineitem"), ["l_returnflag"], LI_NUM), 6)


@q("agg_histogram")
def q_agg_histogram(spark, d):
    return rnd(A.agg_histogram(t(spark, d, "orders"), "o_totalprice", 50))


@q("agg_box_stats")
def q_agg_box_stats(spark, d):
    o = t(spark, d, "orders").withColumn("weekday", F.weekday("o_orderdate"))
    return rnd(A.agg_box_stats(o, ["weekday"], "o_totalprice"))


@q("agg_kde")
def q_agg_kde(spark, d):
    out = A.agg_kde(t(spark, d, "events"), "value", 200, 3.0)
    return out.select("grid", rr("x", 6).alias("x"), rr(F.col("density") * 1e6, 4).alias("density_e6"))


# ============================================================ 2.5 reshape ===

@q("pivot_region")
def q_pivot_region(spark, d):
    h = SI.hydro_raw(spark, d).select(F.col("DateValueCET").alias(DT),
                                      S.map_replace("Location", REGION_MAP).alias("Region"), "Value")
    agg = A.agg_sum_by_keys(h, [DT, "Region"], "Value")
    return rnd(R.pivot_region(agg, [DT], "Region", "Value", REGIONS, prefix="inflow_"))


@q("pivot_table_mean")
def q_pivot_table_mean(spark, d):
    e = t(spark, d, "events").select(F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), "value")
    return rnd(R.pivot_table(e, ["hour"], "weekday", "value", list(range(7)), "mean", prefix="wd_"))


@q("pivot_table_sum_multi")
def q_pivot_table_sum_multi(spark, d):
    li = t(spark, d, "lineitem").withColumn("month", F.trunc(F.to_date("l_shipdate"), "MM"))
    return rnd(R.pivot_table_sum_multi(li, ["month"], "l_returnflag", ["l_quantity", "l_extendedprice"],
                                       ["A", "N", "R"]))


@q("pivot_surface")
def q_pivot_surface(spark, d):
    return rnd(R.pivot_surface(forward(spark, d), "delivery_start", DT, "forward_price"))


@q("row_sum_cols")
def q_row_sum_cols(spark, d):
    return rnd(hydro(spark, d))


@q("row_mean_cols")
def q_row_mean_cols(spark, d):
    h = hydro(spark, d).drop("daily_sum_hydro_inflow")
    cols = [c for c in h.columns if c.startswith("hydro_inflow_")]
    return rnd(R.row_mean_cols(h, cols, "row_mean_inflow").select(DT, "row_mean_inflow"))


@q("unpivot_melt")
def q_unpivot_melt(spark, d):
    s = settlement(spark, d).select(DT, "avg_settlement_price", "max_settlement_price")
    return rnd(R.unpivot_melt(s, [DT], ["avg_settlement_price", "max_settlement_price"], "series", "value"))


# ====================================================== 2.6 time series =====

def settle_series(spark, d):
    return settlement(spark, d).select(DT, "avg_settlement_price", "max_settlement_price")


@q("win_lag")
def q_win_lag(spark, d):
    return rnd(TS.win_lag(settle_series(spark, d), [DT], "avg_settlement_price", [7, 30], "price_lag"))


@q("win_lead_group")
def q_win_lead_group(spark, d):
    return TS.win_lead_group(consumption_last(spark, d).select("valid", "Region"), ["Region"], "valid",
                             "next_valid")


@q("win_rolling")
def q_win_rolling(spark, d):
    s = settle_series(spark, d).select(DT, "avg_settlement_price")
    return rnd(TS.win_rolling(s, [DT], "avg_settlement_price", None,
                              {"rolling_mean_7": (7, "mean"), "rolling_std_30": (30, "std")}))


@q("win_group_transform_fill")
def q_win_group_transform_fill(spark, d):
    w = SI.weather_raw(spark, d).select("ts", "ESTACAO", "radiation")
    return rnd(TS.fill_with_group_mean(w, "radiation", F.hour("ts")))


def settle_on_spine(spark, d):
    s = R.written(settle_series(spark, d).select(DT, "avg_settlement_price"))  # read by the spine and the join
    spine = TS.calendar_spine(s, DT)
    return spine.join(s, DT, "left")


@q("ts_ffill_bfill")
def q_ts_ffill_bfill(spark, d):
    s = settle_on_spine(spark, d).select(DT, F.col("avg_settlement_price").alias("price_ffill"),
                                         F.col("avg_settlement_price").alias("price_bfill"))
    # both directions from one sorted, checkpointed pass
    return rnd(O.fill(s, [DT], ffill=["price_ffill"], bfill=["price_bfill"]))


@q("ts_calendar_spine")
def q_ts_calendar_spine(spark, d):
    return TS.calendar_spine(t(spark, d, "orders"), "o_orderdate")


@q("ts_missing_dates")
def q_ts_missing_dates(spark, d):
    return TS.missing_dates(t(spark, d, "orders"), "o_orderdate")


@q("ts_resample_daily")
def q_ts_resample_daily(spark, d):
    w, st = weather_stations(spark, d)
    h = JB.weather_hourly(w, st, "radiation", {"MIDDLE EAST": "ASIA"}).where(F.col("region").isNotNull())
    return rnd(TS.resample_daily_sum(h, "region", DT, "radiation"))


@q("ts_expand_period")
def q_ts_expand_period(spark, d):
    last = consumption_last(spark, d)
    return rnd(TS.expand_period(last, group=["Region"], start="valid", value="consumption",
                                out_value="daily_consumption", day=DT))


@q("ts_forecast_lead_filter")
def q_ts_forecast_lead_filter(spark, d):
    raw = SI.consumption_raw(spark, d)
    return rnd(TS.forecast_lead_filter(raw, "DateForecastCET", "DateValueCET", 1)
               .select("DateForecastCET", "DateValueCET", "VolumeMWh", "PowerPriceAreaCode",
                       "l_orderkey", "l_linenumber"))


@q("ts_sliding_sequences")
def q_ts_sliding_sequences(spark, d):
    s = settle_series(spark, d)
    seq = TS.sliding_sequences(s, [DT], ["avg_settlement_price", "max_settlement_price"],
                               "avg_settlement_price", 7)
    long = seq.select("row_number", F.col(DT).alias("target_date"), F.col("avg_settlement_price").alias("target"),
                      F.posexplode("window").alias("step", "f"))
    return rnd(long.select("row_number", "target_date", "target", "step",
                           F.col("f.avg_settlement_price").alias("avg_settlement_price"),
                           F.col("f.max_settlement_price").alias("max_settlement_price")))


@q("ts_tail_period")
def q_ts_tail_period(spark, d):
    """The evaluation slices: last 2 months, last 10 rows, first 7 and 30 rows
    and an inclusive date slice, tagged and stacked."""
    s = R.written(settle_series(spark, d))  # read by every slice
    parts = [("last_2_months", TS.tail_months(s, DT, 2)), ("last_10", TS.tail_rows(s, [DT], 10)),
             ("first_7", TS.head_rows(s, [DT], 7)), ("first_30", TS.head_rows(s, [DT], 30)),
             ("jan_1998", TS.date_slice(s, DT, "1998-01-01", "1998-01-31"))]
    return rnd(SO.set_union_tagged(parts, "slice"))


# ================================================= 2.7 sort / top-k / sets ==

@q("sort_multi")
def q_sort_multi(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return rnd(SO.sort_multi(o, [F.col("o_orderdate"), F.col("o_totalprice").desc(), F.col("o_orderkey")]))


@q("topk_abs")
def q_topk_abs(spark, d):
    li = t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        ((F.col("l_discount") - F.col("l_tax")) * F.col("l_extendedprice")).alias("score"))
    return rnd(SO.topk_abs(li, "score", 10, ["l_orderkey", "l_linenumber"]))


def date_set(df, col):
    return df.select(F.to_date(col).alias(DT)).distinct()


@q("set_difference")
def q_set_difference(spark, d):
    return SO.set_difference(date_set(t(spark, d, "orders"), "o_orderdate"),
                             date_set(t(spark, d, "lineitem"), "l_shipdate"))


@q("set_intersect")
def q_set_intersect(spark, d):
    return SO.set_intersect(date_set(t(spark, d, "orders"), "o_orderdate"),
                            date_set(t(spark, d, "lineitem"), "l_shipdate"))


@q("set_union_tagged")
def q_set_union_tagged(spark, d):
    f = forward(spark, d).select(DT).distinct()
    s = settlement(spark, d).select(DT)
    return SO.set_union_tagged([("forward", f), ("settlement", s)], "source")


# ======================================================= 2.8 scalars ========

PRIORITY_MAP = {"1-URGENT": "U", "2-HIGH": "H"}


@q("map_replace")
def q_map_replace(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", S.map_replace("o_orderpriority", PRIORITY_MAP).alias("priority"))


@q("map_lookup")
def q_map_lookup(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", S.map_lookup("o_orderpriority", PRIORITY_MAP).alias("priority"))


@q("str_split_expand")
def q_str_split_expand(spark, d):
    w = SI.wind_raw(spark, d).select("Month of din_instante").distinct()
    m = F.col("Month of din_instante")
    return w.select(m.alias("month_text"), S.split_part(m, " ", 0).alias("month_name"),
                    S.split_part(m, " ", 1).cast("int").alias("year"),
                    S.map_lookup(S.split_part(m, " ", 0), codes.MONTH_NUMBER).alias("month"))


@q("str_substring")
def q_str_substring(spark, d):
    w = SI.weather_raw(spark, d)
    return w.select("ts", "ESTACAO", S.substring0("Hora_UTC", 0, 2).alias("hour_text"))


@q("num_coerce")
def q_num_coerce(spark, d):
    raw = SI.wind_raw(spark, d)
    return rnd(raw.select("val_geraenergiaconmwmed",
                          S.num_coerce("val_geraenergiaconmwmed").alias("generation")).distinct())


@q("ts_build")
def q_ts_build(spark, d):
    r = SI.settlement_raw(spark, d)
    return r.select("row_id", S.ts_from_date_time("DateValueCET", "TimeValueCET").alias("ts"),
                    S.ts_from_parts(F.year("DateValueCET"), F.month("DateValueCET"), F.lit(1)).alias("month_start"),
                    S.ts_plus_seconds(F.col("DateValueCET").cast("timestamp_ntz"), F.lit(5400)).alias("plus_90min"))


@q("ts_tz_convert")
def q_ts_tz_convert(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", F.col("ts").alias("wall_cet"),
                    S.localize("ts", "CET").alias("utc"),
                    S.tz_convert("ts", "CET", "America/Sao_Paulo").alias("sao_paulo"),
                    S.utc_to_zone("ts", "Europe/Berlin").alias("berlin_from_utc"))


@q("date_parts")
def q_date_parts(spark, d):
    e = t(spark, d, "events")
    c = F.col("ts")
    return e.select("event_id", F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"),
                    F.hour(c).alias("hour"), S.day_name(c).alias("day_name"), S.month_name(c).alias("month_name"),
                    S.weekday0(c).alias("weekday"), F.dayofyear(c).alias("day_of_year"))


@q("date_format_trunc")
def q_date_format_trunc(spark, d):
    o = t(spark, d, "orders")
    c = F.col("o_orderdate")
    return o.select("o_orderkey", S.year_month_text(c).alias("year_month"), F.to_date(c).alias("date"),
                    S.month_start(c).alias("month_start"), F.date_format(c, "yyyy-MM-dd").alias("date_text"))


@q("date_offset")
def q_date_offset(spark, d):
    o = t(spark, d, "orders")
    c = F.to_date("o_orderdate")
    return o.select("o_orderkey", F.add_months(c, 1).alias("plus_1_month"), F.date_add(c, 3).alias("plus_3_days"),
                    F.date_sub(c, 1).alias("minus_1_day"), S.previous_friday(c).alias("previous_friday"))


@q("date_epoch")
def q_date_epoch(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", S.epoch_seconds("ts").alias("epoch_seconds"))


@q("cyclic_encode")
def q_cyclic_encode(spark, d):
    e = t(spark, d, "events")
    hs, hc = S.cyclic(F.hour("ts"), 24)
    ds, dc = S.cyclic(F.dayofyear("ts"), 365)
    ms, mc = S.cyclic(F.month("ts"), 12)
    return rnd(e.select("event_id", hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("day_sin"),
                        dc.alias("day_cos"), ms.alias("month_sin"), mc.alias("month_cos")), 6)


@q("weekend_flag")
def q_weekend_flag(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", S.weekend_flag("o_orderdate").alias("is_weekend"))


@q("interaction_features")
def q_interaction_features(spark, d):
    li = t(spark, d, "lineitem")
    return rnd(li.select("l_orderkey", "l_linenumber",
                         (F.col("l_extendedprice") * F.col("l_discount")).alias("price_x_discount"),
                         S.ratio("l_extendedprice", "l_quantity").alias("unit_price"),
                         S.ratio("l_discount", "l_tax").alias("discount_per_tax")))


@q("log_sqrt_transform")
def q_log_sqrt_transform(spark, d):
    li = t(spark, d, "lineitem")
    return rnd(li.select("l_orderkey", "l_linenumber", F.sqrt("l_extendedprice").alias("sqrt_price"),
                         F.log1p("l_extendedprice").alias("log1p_price")), 6)


# ================================================== 2.9 data preparation ====

def model_frame(spark, d):
    """Daily settlement statistics with the hydro inflow features (nulls where
    a day has a single order or no inflow).  Written, as fits read it several times."""
    return R.written(J.join_left_chain(settlement(spark, d), [hydro(spark, d)], DT))


HYDRO_COLS = [f"hydro_inflow_{S.safe_name(r)}" for r in REGIONS]
PRICE_COLS = ["avg_settlement_price", "min_settlement_price", "max_settlement_price"]


@q("split_random")
def q_split_random(spark, d):
    return P.split_random(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@q("split_chrono")
def q_split_chrono(spark, d):
    return P.split_chrono(settle_series(spark, d).select(DT), [DT])


@q("split_by_date")
def q_split_by_date(spark, d):
    return P.split_by_date(settle_series(spark, d).select(DT), DT, "1999-01-01")


@q("split_period_report")
def q_split_period_report(spark, d):
    return P.split_period_report(P.split_chrono(settle_series(spark, d).select(DT), [DT]), DT)


IMPUTE_COLS = ["std_settlement_price", "daily_sum_hydro_inflow"]


def _impute_query(strategy):
    def run(spark, d):
        m = model_frame(spark, d).select(DT, *IMPUTE_COLS)
        return rnd(P.impute(m, IMPUTE_COLS, strategy))
    return run


QUERIES["impute_mean"] = _impute_query("mean")
QUERIES["impute_median"] = _impute_query("median")
QUERIES["impute_mode"] = _impute_query("most_frequent")


def chrono_model_frame(spark, d):
    s = R.written(settlement(spark, d))  # read by both sides
    return P.split_chrono(s.select(DT, "avg_settlement_price", "max_settlement_price").join(
        s.select(DT, "min_settlement_price"), DT), [DT])


@q("scale_standard")
def q_scale_standard(spark, d):
    m = chrono_model_frame(spark, d)
    out, _ = P.scale(m, PRICE_COLS, "standard", fit_on=F.col(P.SPLIT) == "train")
    return rnd(out)


@q("scale_minmax")
def q_scale_minmax(spark, d):
    m = chrono_model_frame(spark, d)
    out, _ = P.scale(m, PRICE_COLS, "minmax", fit_on=F.col(P.SPLIT) == "train")
    return rnd(out)


@q("scale_inverse")
def q_scale_inverse(spark, d):
    m = chrono_model_frame(spark, d).select(DT, P.SPLIT, "avg_settlement_price",
                                            F.col("avg_settlement_price").alias("z"))
    scaled, st = P.scale(m, ["z"], "standard", fit_on=F.col(P.SPLIT) == "train")
    mean, std = st["z"]
    return rnd(P.scale_inverse(scaled, "z", mean, std, "restored").drop("z"))


@q("normalize_minmax")
def q_normalize_minmax(spark, d):
    s = C.filter_year(settle_series(spark, d), DT, 1998)
    return rnd(P.normalize_minmax(s, ["avg_settlement_price", "max_settlement_price"]))


@q("outlier_quantile")
def q_outlier_quantile(spark, d):
    return rnd(P.outlier_quantile(settle_series(spark, d), "avg_settlement_price", 0.01))


@q("outlier_iqr")
def q_outlier_iqr(spark, d):
    return rnd(P.outlier_iqr(settle_series(spark, d), ["avg_settlement_price", "max_settlement_price"]))


YJ_LAMBDAS = {"l_quantity": 0.5, "l_discount": 1.5, "l_tax": 2.0}


@q("power_yeo_johnson")
def q_power_yeo_johnson(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *YJ_LAMBDAS)
    out, _ = P.power_yeo_johnson(li, list(YJ_LAMBDAS), YJ_LAMBDAS, standardize=False)
    return rnd(out, 6)


@q("power_yeo_johnson_fit")
def q_power_yeo_johnson_fit(spark, d):
    m = chrono_model_frame(spark, d)
    out, lams = P.power_yeo_johnson(m, PRICE_COLS, fit_on=F.col(P.SPLIT) == "train")
    return rnd(out, 6)


@q("feat_variance_threshold")
def q_feat_variance_threshold(spark, d):
    m = model_frame(spark, d)
    return rnd(P.variance_table(m, PRICE_COLS + HYDRO_COLS, 0.0099), digits={"variance": 2})


@q("feat_select_kbest_f")
def q_feat_select_kbest_f(spark, d):
    return rnd(P.feat_select_kbest_f(t(spark, d, "lineitem"), LI_NUM, "l_returnflag", 3), 6)


@q("feat_rfe_linear")
def q_feat_rfe_linear(spark, d):
    m = P.impute(model_frame(spark, d), HYDRO_COLS, "mean")
    return P.feat_rfe_linear(m, HYDRO_COLS + ["std_settlement_price"], "avg_settlement_price", 3)


@q("feat_pca")
def q_feat_pca(spark, d):
    m = P.impute(model_frame(spark, d), HYDRO_COLS, "mean")
    m, _ = P.scale(m, HYDRO_COLS)
    var, load = P.feat_pca(m, HYDRO_COLS, 3)
    return rnd(P.pca_report(var, load), 6)


def feature_pipeline(spark, d, **kw):
    """The P0 pipeline on the driver stand-ins: P0/P1 frame with the daily
    features, then :func:`jobs.feature_pipeline`."""
    p = R.written(with_features(JB.job_p0_p1(forward(spark, d), None), p0p1_features(spark, d)))
    return JB.feature_pipeline(p, kw.pop("target", "P0"), **kw)


@q("feature_pipeline")
def q_feature_pipeline(spark, d):
    """Default settings without RFE (``drop_features=False``): P0/P1 frame ->
    chronological 64/16/20 split -> mean imputation and standard scaling fitted
    on train -> variance threshold on train.  RFE is ``feature_pipeline_rfe``."""
    return rnd(feature_pipeline(spark, d, features_to_drop=0), 6)


@q("feature_pipeline_rfe")
def q_feature_pipeline_rfe(spark, d):
    return rnd(feature_pipeline(spark, d, features_to_drop=2), 6)


@q("feature_pipeline_settlement")
def q_feature_pipeline_settlement(spark, d):
    """Settlement variant (see :func:`jobs.feature_pipeline_settlement`)."""
    m = JB.feature_pipeline_settlement(model_frame(spark, d), "avg_settlement_price",
                                       HYDRO_COLS + ["daily_sum_hydro_inflow"])
    return rnd(m, 6)


@q("feature_pipeline_random")
def q_feature_pipeline_random(spark, d):
    """``build_pipeline``: the wide prepared table with the forward price as
    target, date columns as epoch seconds, a hash-random 64/16/20 split,
    imputation, scaling and variance threshold fitted on train."""
    # written, as every fit reads it
    w = R.written(JB.job_prepared_dataset(forward(spark, d), [settlement(spark, d), hydro(spark, d)]))
    w = w.select(F.concat_ws("|", F.col(DT).cast("string"), F.col("delivery_start").cast("string")).alias("row_key"),
                 *[c for c in w.columns if c not in (DT, "delivery_start")],
                 S.epoch_seconds(F.col(DT).cast("timestamp_ntz")).cast("double").alias("date_epoch"),
                 S.epoch_seconds(F.col("delivery_start").cast("timestamp_ntz")).cast("double").alias("delivery_epoch"))
    return rnd(JB.feature_pipeline(w, "forward_price", date="row_key", split="random", split_key="row_key",
                                   features_to_drop=0), 6)


@q("feature_subset")
def q_feature_subset(spark, d):
    m = model_frame(spark, d)
    return rnd(m.select(DT, "avg_settlement_price", "hydro_inflow_AF", "hydro_inflow_AM", "daily_sum_hydro_inflow"))


# ================================================ 2.10 distribution tests ===

@q("test_ks_normal")
def q_test_ks_normal(spark, d):
    return rnd(ST.test_ks_normal(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 6)


@q("test_normality_moments")
def q_test_normality_moments(spark, d):
    return rnd(ST.test_normality_moments(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 6)


@q("fit_weibull_ks")
def q_fit_weibull_ks(spark, d):
    return rnd(ST.fit_weibull_ks(t(spark, d, "lineitem"), ["l_extendedprice"]), 4)


# ================================================== 2.11 models / eval ======

LI_FEATS = ["l_quantity", "l_discount", "l_tax"]


def li_frame(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *LI_FEATS)


def coef_frame(spark, model, features, name):
    rows = [(name, f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    rows.append((name, "intercept", float(model.intercept)))
    return spark.createDataFrame(rows, "model string, feature string, coefficient double")


@q("reg_linear")
def q_reg_linear(spark, d):
    m = M.fit_linear(li_frame(spark, d), ["l_quantity"], "l_extendedprice", "ols")
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                 "slope double, intercept double").select(rr("slope", 4).alias("slope"),
                                                                          rr("intercept", 2).alias("intercept"))


def path_frame(spark, fitted):
    """(alpha, feature, coefficient) of (alpha, coefficients, intercept) rows."""
    rows = [(a, f, float(c)) for a, coef, icpt, *_ in fitted for f, c in [*zip(LI_FEATS, coef), ("intercept", icpt)]]
    return spark.createDataFrame(rows, "alpha double, feature string, coefficient double")


RIDGE_ALPHAS, LASSO_ALPHAS, NET_ALPHAS = [0.1, 0.2, 3.0, 5.0, 10.0], [0.1, 0.8, 10.0], [0.1, 1.0]


@q("reg_ridge")
def q_reg_ridge(spark, d):
    """Five penalties from one pass: exact solves of the normal equations."""
    g = P.gram(li_frame(spark, d), LI_FEATS, "l_extendedprice")
    return rnd(path_frame(spark, [(a, *P.solve_ridge(g, a)) for a in RIDGE_ALPHAS]), digits={"alpha": 4, "coefficient": 3})


@q("reg_lasso")
def q_reg_lasso(spark, d):
    """Coordinate descent along the path, from one pass."""
    g = P.gram(li_frame(spark, d), LI_FEATS, "l_extendedprice")
    return rnd(path_frame(spark, P.penalised_path(g, LASSO_ALPHAS, 1.0)), 3)


@q("reg_elastic_net")
def q_reg_elastic_net(spark, d):
    g = P.gram(li_frame(spark, d), LI_FEATS, "l_extendedprice")
    return rnd(path_frame(spark, P.penalised_path(g, NET_ALPHAS, 0.5)), 3)


def li_split(spark, d):
    return P.split_random(li_frame(spark, d).withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")),
                          "k", (0.8, 0.2), ("train", "test"))


def fit_score(spark, d, fit, name):
    df = li_split(spark, d)
    tr, te = df.where("split = 'train'"), df.where("split = 'test'")
    model = fit(tr, LI_FEATS, "l_extendedprice")
    return rnd(M.eval_metrics(M.predict(model, te, LI_FEATS), "l_extendedprice").withColumn("model", F.lit(name)))


def with_validation(spark, d, folds, m=None):
    """Contiguous folds; the last one is the validation set of the refit."""
    return cv_frame(spark, d, folds + 1, m)


def scores(df):
    return rnd(df, 2, digits={"refit_r2": 4})


@q("reg_random_forest")
def q_reg_random_forest(spark, d):
    """Bootstrapped forests of 50, 100 and 200 trees, of depth 10, 20 and without
    limit: one forest per fold, read nine times."""
    grid = {**FO.FOREST_GRID, "min_samples_split": [2], "min_samples_leaf": [1], "bootstrap": [True]}
    return scores(FO.forest_grid_search(with_validation(spark, d, 3), CV_FEATS, "avg_settlement_price", [DT], "fold", 3, grid))


GBT_STAGES = [100, 300, 500, 700]


@q("reg_gbt")
def q_reg_gbt(spark, d):
    """One chain of 700 rounds over all of lineitem, scored on held-out rows at 100, 300, 500 and 700."""
    df = li_split(spark, d).withColumn("held", (F.col("split") == "test").cast("int"))
    out = BO.staged_boosting(df, LI_FEATS, "l_extendedprice", ["l_orderkey", "l_linenumber"], "held", GBT_STAGES, rate=0.05, depth=5)
    return rnd(out.drop("importance"), 2, digits={"r2": 6})


def cv_frame(spark, d, k=5, m=None):
    """Folds of the model frame (``m``, where it is written already)."""
    m = P.impute(model_frame(spark, d) if m is None else m, HYDRO_COLS + ["daily_sum_hydro_inflow", "std_settlement_price"], "mean")
    return P.fold_assign(m, [DT], k)


CV_FEATS = HYDRO_COLS + ["std_settlement_price"]


TWELVE_ALPHAS = [0.0005, 0.0007, 0.0008, 0.0009, 0.1, 0.17, 0.5, 1.0, 1.5, 2.0, 5.0, 8.0]
EIGHT_ALPHAS = [0.1, 0.15, 0.16, 0.17, 0.18, 0.26, 0.3, 1.0]
FOUR_ALPHAS = [0.3, 0.3731, 0.3732, 0.3736]
LOG_ALPHAS = [0.5 * 10 ** (10 - 12 * i / 99) for i in range(100)]


@q("cv_ridge")
def q_cv_ridge(spark, d):
    """Three searches over 5 contiguous folds: 12 alphas by MSE and by R2, 8 by MSE."""
    f, y = cv_frame(spark, d), "avg_settlement_price"
    found = [("mse_12", M.ridge_cv_gram(f, CV_FEATS, y, TWELVE_ALPHAS, "fold", "mse").withColumnRenamed("mean_mse", "score")),
             ("r2_12", M.ridge_cv_gram(f, CV_FEATS, y, TWELVE_ALPHAS, "fold", "r2").withColumnRenamed("mean_r2", "score")),
             ("mse_8", M.ridge_cv_gram(f, CV_FEATS, y, EIGHT_ALPHAS, "fold", "mse").withColumnRenamed("mean_mse", "score"))]
    return rnd(SO.set_union_tagged(found, "search"))


@q("cv_ridge_loo")
def q_cv_ridge_loo(spark, d):
    """The two leave-one-out searches: 4 listed alphas and 100 log-spaced ones."""
    f, y = cv_frame(spark, d), "avg_settlement_price"
    found = [("listed_4", M.ridge_loo(f, CV_FEATS, y, FOUR_ALPHAS)), ("log_100", M.ridge_loo(f, CV_FEATS, y, LOG_ALPHAS))]
    return rnd(SO.set_union_tagged(found, "search"))


@q("cv_grid")
def q_cv_grid(spark, d):
    """The three searches: boosting with 27 combinations (5 folds) and 162 (3 folds), forests with 162 (3 folds)."""
    m = model_frame(spark, d)
    five, three = with_validation(spark, d, 5, m), with_validation(spark, d, 3, m)
    y = "avg_settlement_price"
    found = [("boosting_27", BO.boosting_grid_search(five, CV_FEATS, y, [DT], "fold", 5, BO.BOOSTING_GRID)),
             ("boosting_162", BO.boosting_grid_search(three, CV_FEATS, y, [DT], "fold", 3, BO.SUBSAMPLED_GRID)),
             ("forest_162", FO.forest_grid_search(three, CV_FEATS, y, [DT], "fold", 3, FO.FOREST_GRID))]
    return scores(SO.set_union_tagged(found, "search"))


@q("cv_random")
def q_cv_random(spark, d):
    """50 of the 128 combinations of boosting with draws and penalties, 3 folds."""
    drawn = FO.sampled(BO.PENALISED_GRID, 50, seed=42)
    return scores(BO.boosting_grid_search(with_validation(spark, d, 3), CV_FEATS, "avg_settlement_price", [DT], "fold", 3, combinations=drawn))


@q("cv_score")
def q_cv_score(spark, d):
    """5-fold MAE of ridge(alpha=0.2) with contiguous folds, refitted per fold."""
    f = cv_frame(spark, d, 5)
    ridge = lambda a, b, c: M.fit_linear(a, b, c, "ridge", alpha=0.2, solver="normal")
    return rnd(M.cv_score(f, CV_FEATS, "avg_settlement_price", ridge, "fold", "mae"), 2)


@q("fold_assign")
def q_fold_assign(spark, d):
    return P.fold_assign(settle_series(spark, d).select(DT), [DT], 5)


MODELS = {
    "linear": lambda a, b, c: M.fit_linear(a, b, c, "ols"),
    "ridge": lambda a, b, c: M.fit_linear(a, b, c, "ridge", alpha=0.2, solver="normal"),
    "lasso": lambda a, b, c: M.fit_linear(a, b, c, "lasso", alpha=0.8),
    "random_forest": lambda a, b, c: M.fit_random_forest(a, b, c, numTrees=20, maxDepth=5),
    "gbt": lambda a, b, c: M.fit_gbt(a, b, c, maxIter=20, maxDepth=3),
}


def compare_models(spark, d):
    f = P.split_chrono(cv_frame(spark, d), [DT], 0.8, 0.2)
    tr, va = f.where("split = 'train'"), f.where("split = 'validation'")
    return M.model_compare(tr, va, CV_FEATS, "avg_settlement_price", MODELS)


@q("model_compare")
def q_model_compare(spark, d):
    return rnd(compare_models(spark, d), 2)


@q("leaderboard")
def q_leaderboard(spark, d):
    return rnd(SO.leaderboard(compare_models(spark, d), "mse"), 2)


@q("eval_metrics")
def q_eval_metrics(spark, d):
    li, pa = t(spark, d, "lineitem"), t(spark, d, "part")
    j = li.join(pa, li.l_partkey == pa.p_partkey).select(
        "l_extendedprice", (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    return rnd(M.eval_metrics(j, "l_extendedprice", "prediction", n_features=1), 6,
               digits={"mse": 0, "rmse": 4, "mae": 4})


@q("eval_train_combined")
def q_eval_train_combined(spark, d):
    f = P.split_chrono(cv_frame(spark, d), [DT], 0.75, 0.15)
    trval = SO.set_union_tagged([("train", f.where("split = 'train'")),
                                 ("validation", f.where("split = 'validation'"))], "part")
    model = M.fit_linear(trval, CV_FEATS, "avg_settlement_price", "ridge", alpha=0.2, solver="normal")
    return rnd(M.eval_metrics(M.predict(model, f.where("split = 'test'"), CV_FEATS), "avg_settlement_price"), 2)


def naive_predictions(spark, d):
    s = settle_series(spark, d).select(DT, "avg_settlement_price")
    return TS.win_lag(s, [DT], "avg_settlement_price", [1], "pred_lag").withColumnRenamed("pred_lag1", "prediction")


@q("eval_horizon")
def q_eval_horizon(spark, d):
    return rnd(M.eval_horizon(naive_predictions(spark, d), DT, "avg_settlement_price"), 6,
               digits={"mse": 0, "rmse": 4, "mae": 4})


@q("eval_actual_vs_pred")
def q_eval_actual_vs_pred(spark, d):
    return rnd(M.eval_actual_vs_pred(naive_predictions(spark, d), DT, "avg_settlement_price", long=True))


@q("explain_coefficients")
def q_explain_coefficients(spark, d):
    f = cv_frame(spark, d)
    fs, _ = P.scale(f, CV_FEATS)
    m = M.fit_linear(fs, CV_FEATS, "avg_settlement_price", "ridge", alpha=0.2, solver="normal")
    return rnd(M.explain_coefficients(spark, CV_FEATS, list(m.coefficients.toArray())), 3)


@q("explain_tree_importance")
def q_explain_tree_importance(spark, d):
    """Gain share and number of splits of the ten strongest features, after each
    stage of one boosting chain."""
    df = P.split_chrono(cv_frame(spark, d), [DT], 0.8, 0.0).withColumn("held", (F.col("split") != "train").cast("int"))
    out = BO.staged_boosting(df, CV_FEATS, "avg_settlement_price", [DT], "held", GBT_STAGES, rate=0.05, depth=3)
    strongest = F.sort_array(F.transform("importance", lambda i: F.struct((-i["gain"]).alias("less"), i["feature"].alias("feature"), i["splits"].alias("splits"))))
    long = out.select("rounds", F.explode(F.slice(strongest, 1, 10)).alias("i"))
    return rnd(long.select("rounds", "i.feature", (-F.col("i.less")).alias("gain"), "i.splits"), 6)


# ===================================================== 2.12 domain jobs =====

@q("job_forward_price")
def q_job_forward_price(spark, d):
    return rnd(forward(spark, d))


@q("job_market_price")
def q_job_market_price(spark, d):
    return rnd(JB.job_market_price(SI.forward_raw(spark, d), "AM"))


@q("job_settlement_ext")
def q_job_settlement_ext(spark, d):
    """All areas are mapped to region codes; one region's profile is kept."""
    return rnd(JB.job_settlement_ext(SI.settlement_raw(spark, d), "AM", REGION_MAP, ["ts", "row_id"]),
               digits={"var": 0})


@q("job_temperature")
def q_job_temperature(spark, d):
    return rnd(JB.job_temperature(SI.temperature_raw(spark, d)))


@q("job_hydro")
def q_job_hydro(spark, d):
    return rnd(hydro(spark, d, START))


@q("job_solar")
def q_job_solar(spark, d):
    return rnd(solar(spark, d, START))


@q("job_wind")
def q_job_wind(spark, d):
    return rnd(wind(spark, d))


@q("job_capacity")
def q_job_capacity(spark, d):
    return rnd(capacity(spark, d, CAL_START, CAL_END))


@q("job_consumption")
def q_job_consumption(spark, d):
    return rnd(consumption(spark, d, START))


@q("job_weather_daily")
def q_job_weather_daily(spark, d):
    w, st = weather_stations(spark, d)
    return rnd(JB.job_weather_daily(w, st, "radiation", ["AFRICA", "AMERICA", "ASIA", "EUROPE"],
                                    {"MIDDLE EAST": "ASIA"}))


@q("job_rain_features")
def q_job_rain_features(spark, d):
    w, st = weather_stations(spark, d)
    area = {"AFRICA": "AREA_AF", "AMERICA": "AREA_AM", "ASIA": "AREA_AS", "EUROPE": "AREA_EU"}
    return rnd(JB.job_rain_features(w, st, {"MIDDLE EAST": "ASIA"}, area), 6)


@q("job_consumption_by_vintage")
def q_job_consumption_by_vintage(spark, d):
    return rnd(JB.job_consumption_by_vintage(SI.consumption_raw(spark, d), REGION_MAP, REGIONS))


@q("job_prepared_dataset")
def q_job_prepared_dataset(spark, d):
    return rnd(JB.job_prepared_dataset(forward(spark, d), dailies(spark, d)))


@q("job_missing_audit")
def q_job_missing_audit(spark, d):
    return JB.job_missing_audit(forward(spark, d).select(DT), settlement(spark, d, AREA).select(DT))


@q("job_price_vs_driver")
def q_job_price_vs_driver(spark, d):
    return rnd(JB.job_price_vs_driver(forward(spark, d), settlement(spark, d, AREA), "1998-06-01"), 6)
