"""Driver tables re-shaped into the raw energy-file layouts.

Each function reads the driver Parquet tables and emits the columns of one raw
energy source (see FIXTURES.md A), so the domain jobs in
:mod:`gridframe.plans.jobs` run unchanged on either.  Mapping (all data work is
Spark joins and projections over whole tables):

* settlement price ticks  <- orders x customer region (price = o_totalprice)
* forward curve           <- lineitem x orders: quote date x ship month, mean unit price
* hydro inflow            <- lineitem x supplier region (l_quantity by ship date)
* solar generation        <- lineitem x supplier region (l_extendedprice / 1000)
* wind generation         <- lineitem x supplier region, value text with "n/a" for returns
* plant registry          <- lineitem x orders x supplier region (capacity intervals)
* consumption forecasts   <- lineitem x orders x customer region (vintage = order date)
* station weather         <- events (station = user), stations = customer region
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customer_region(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select("c_custkey", "n_name", "r_name"))


def supplier_region(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select("s_suppkey", "n_name", "r_name"))


def settlement_raw(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cr = customer_region(spark, d)
    return o.join(cr, o.o_custkey == cr.c_custkey).select(
        F.to_date("o_orderdate").alias("DateValueCET"),
        F.date_format("o_orderdate", "HH:mm:ss").alias("TimeValueCET"),
        F.col("r_name").alias("PowerPriceAreaCode"),
        F.col("o_totalprice").alias("PriceMWh"),
        F.col("o_orderkey").alias("row_id"))


def forward_raw(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return (j.groupBy(F.col("o_orderdate").alias("ReferenceDateTimeOffset"),
                      F.trunc(F.to_date("l_shipdate"), "MM").cast("timestamp_ntz")
                       .alias("DeliveryStartDateTimeOffset"))
             .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("PriceMWh"),
                  F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity"))
                   .alias("PriceI5MWh")))


def _lineitem_supplier(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    sr = supplier_region(spark, d)
    return li.join(sr, li.l_suppkey == sr.s_suppkey)


def hydro_raw(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem_supplier(spark, d).select(
        F.to_date("l_shipdate").alias("DateValueCET"),
        F.col("n_name").alias("PowerPriceAreaCode"),
        F.col("l_quantity").alias("Value"),
        F.col("r_name").alias("Location"))


def solar_raw(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem_supplier(spark, d).select(
        F.col("r_name").alias("id_subsistema"),
        F.col("l_shipdate").alias("din_instante"),
        (F.col("l_extendedprice") / 1000.0).alias("val_geraenergiaconmwmed"))


def wind_raw(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem_supplier(spark, d).select(
        F.dayofmonth("l_shipdate").alias("Day of din_instante"),
        F.date_format("l_shipdate", "MMMM yyyy").alias("Month of din_instante"),
        F.col("r_name").alias("id_subsistema"),
        F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
         .otherwise(F.col("l_quantity").cast("string")).alias("val_geraenergiaconmwmed"))


def generation_raw(spark: SparkSession, d: str) -> DataFrame:
    """The hydro, solar and wind values of a row side by side."""
    return _lineitem_supplier(spark, d).select(
        F.to_date("l_shipdate").alias("DateTime"), F.col("r_name").alias("Code"), F.col("l_quantity").alias("Inflow"),
        (F.col("l_extendedprice") / 1000.0).alias("Solar"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("Generation"))


def registry_raw(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    sr = supplier_region(spark, d)
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(sr, li.l_suppkey == sr.s_suppkey)
    od, sd = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return j.select(
        F.col("r_name").alias("id_subsistema"),
        od.alias("dat_entradateste"),
        F.least(od, sd).alias("dat_entradaoperacao"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("date"))
         .otherwise(F.greatest(od, sd)).alias("dat_desativacao"),
        F.col("l_quantity").alias("val_potenciaefetiva"),
        F.col("l_returnflag").alias("nom_tipousina"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
         .alias("nom_unidadegeradora"))


def consumption_raw(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    cr = customer_region(spark, d)
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(cr, o.o_custkey == cr.c_custkey)
    return j.select(
        F.to_date("o_orderdate").alias("DateForecastCET"),
        F.to_date("l_shipdate").alias("DateValueCET"),
        F.col("l_quantity").alias("VolumeMWh"),
        F.col("r_name").alias("PowerPriceAreaCode"),
        F.lit("Week").alias("ForecastRangeCET"),
        F.col("l_orderkey"), F.col("l_linenumber"))


def weather_raw(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.to_date("ts").alias("DATA"),
        F.concat(F.date_format("ts", "HHmm"), F.lit(" UTC")).alias("Hora_UTC"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("precipitation"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("double"))
         .otherwise(F.col("value") * 10).alias("radiation"),
        F.col("value").alias("wind_speed"),
        F.col("value").alias("wind_gust"),
        F.col("user_id").alias("ESTACAO"),
        F.col("ts"))


def stations(spark: SparkSession, d: str) -> DataFrame:
    cr = customer_region(spark, d)
    return cr.select(F.col("c_custkey").alias("id_station"), F.col("r_name").alias("region"),
                     F.col("n_name").alias("city_station"))


def temperature_raw(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cr = customer_region(spark, d)
    return e.join(cr, e.user_id == cr.c_custkey).select(
        F.to_date("ts").alias("DateValueCET"),
        F.date_format("ts", "HH:00:00").alias("TimeValueCET"),
        F.col("r_name").alias("PowerPriceAreaCode"),
        F.col("value").alias("Value"))
