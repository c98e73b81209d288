"""Domain jobs: raw energy-style tables -> cleaned daily tables -> wide table.

Each job is a lazy composition of the operators; column names of the raw
inputs are those of the energy files (FIXTURES.md A) and the outputs use safe
snake_case names.  Code dictionaries and region lists are parameters, so the
same job runs on energy data (``codes.REGION_*``) and on the driver stand-ins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import columns as C
from ..operators import joins as J
from ..operators import reshape as R
from ..operators import setops as SO
from ..operators import timeseries as TS
from ..session import ensure_checkpoint_dir

DT = "DateTime"


# --------------------------------------------------------------- prices -----

def job_forward_price(raw: DataFrame) -> DataFrame:
    """Forward curve: quote date, delivery start (DATE) and price."""
    df = C.project_rename(raw, {"ReferenceDateTimeOffset": DT,
                                "DeliveryStartDateTimeOffset": "delivery_start",
                                "PriceMWh": "forward_price"})
    return df.select(F.to_date(DT).alias(DT), F.to_date("delivery_start").alias("delivery_start"),
                     "forward_price")


def job_market_price(raw: DataFrame, region_tag: str = "SE/CW") -> DataFrame:
    """Forward curve plus calendar parts and a region tag."""
    df = job_forward_price(raw)
    return df.select("*", F.year(DT).alias("year"), F.month(DT).alias("month"),
                     F.dayofmonth(DT).alias("day"), S.day_name(DT).alias("weekday_name"),
                     F.lit(region_tag).alias("region"))


def settlement_ticks(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", S.ts_from_date_time("DateValueCET", "TimeValueCET"))


def job_settlement(raw: DataFrame, area: str | None = "BRAZIL_SOUTHEAST_CENTRALWEST",
                   from_zone: str = "CET", to_zone: str = "America/Sao_Paulo") -> DataFrame:
    """Hourly prices of one area (None: all) -> daily mean/std/min/max in local (destination) time.
    Rows are combined by tick first, so that each wall time is parsed and converted once.
    Ambiguous and non-existent wall times become NULL and are dropped, like
    NaT keys in a pandas groupby."""
    if area is not None:
        raw = raw.where(F.col("PowerPriceAreaCode") == area)

    def local_days(ticks: DataFrame) -> DataFrame:
        # one day per tick, or no row: as a plain column the conversion would be repeated in every
        # filter on the day, above or below the aggregate
        day = F.to_date(S.tz_convert("ts", from_zone, to_zone))
        t = settlement_ticks(ticks)
        return t.select(*ticks.columns, F.explode(F.array_compact(F.array(day))).alias(DT))

    return A.agg_daily_stats(raw, [DT], "PriceMWh", {
        "mean": "avg_settlement_price", "std": "std_settlement_price",
        "min": "min_settlement_price", "max": "max_settlement_price"}, ["DateValueCET", "TimeValueCET"], local_days)


def job_settlement_ext(raw: DataFrame, region: str = "SE/CW",
                       region_map: Mapping = codes.REGION_PRICE_AREA,
                       order: Sequence[str] = ("ts",), approx: bool = False) -> DataFrame:
    """11-statistic daily profile of one mapped region (no time-zone step).
    ``approx=True`` computes the median with the mergeable sketch, for days
    that hold a large share of all rows."""
    t = settlement_ticks(raw).withColumn("Region", S.map_replace("PowerPriceAreaCode", region_map))
    t = t.where(F.col("Region") == region).withColumn(DT, F.to_date("ts"))
    return A.agg_daily_stats_ext(t, [DT], "PriceMWh", list(order), approx=approx)


def job_temperature(raw: DataFrame) -> DataFrame:
    """Hourly mean per (timestamp, area) with the daily mean attached."""
    t = settlement_ticks(raw)
    hourly = t.groupBy(F.col("ts").alias(DT), "PowerPriceAreaCode").agg(F.avg("Value").alias("hourly_value"))
    hourly = hourly.withColumn("Date", F.to_date(DT))
    return A.join_agg_back(hourly, ["Date", "PowerPriceAreaCode"], "hourly_value", "daily_average_value")


# ----------------------------------------------------------- generation -----

def job_hydro(raw: DataFrame, region_map: Mapping = codes.REGION_HYDRO_LOCATION,
              regions: Sequence[str] = codes.ENERGY_REGIONS, start: str | None = "2021-01-01") -> DataFrame:
    df = raw.select(F.col("DateValueCET").cast("date").alias(DT),
                    S.map_replace("Location", region_map).alias("Region"), F.col("Value").alias("Inflow"))
    if start:
        df = df.where(F.col(DT) >= F.lit(start).cast("date"))
    wide = R.pivot_sum(df, [DT], "Region", "Inflow", regions, prefix="hydro_inflow_")
    names = [c for c in wide.columns if c.startswith("hydro_inflow_")]
    return R.row_sum_cols(wide, names, "daily_sum_hydro_inflow")


def job_solar(raw: DataFrame, region_map: Mapping = codes.REGION_PORTUGUESE,
              regions: Sequence[str] = ("NE", "SE/CW"), start: str | None = "2021-01-01") -> DataFrame:
    """Solar sum and mean per region and day.  The source pivots the sums and
    the means separately and full-outer-joins them on the date; both pivots
    come from the same aggregated rows, so one pivot with two aggregates gives
    the same table without the join."""
    df = raw.select(F.to_date("din_instante").alias(DT),
                    S.map_replace("id_subsistema", region_map).alias("Region"),
                    F.col("val_geraenergiaconmwmed").alias("v"))
    if start:
        df = df.where(F.col(DT) >= F.lit(start).cast("date"))
    wide = R.pivot_cells(df, [DT], "Region", regions, [(F.coalesce(F.sum("v"), F.lit(0.0)), R.namer("solar_sum_", "")),
                                                       (F.avg("v"), R.namer("solar_mean_", ""))])
    return R.row_sum_cols(wide, [c for c in wide.columns if c.startswith("solar_sum_")], "daily_sum_solar")


def job_wind(raw: DataFrame, region_map: Mapping = codes.REGION_PORTUGUESE,
             regions: Sequence[str] = ("N", "NE", "S")) -> DataFrame:
    month_txt = F.col("Month of din_instante")
    df = raw.select(
        S.map_replace("id_subsistema", region_map).alias("Region"),
        S.ts_from_parts(S.split_part(month_txt, " ", 1).cast("int"),
                        S.map_lookup(S.split_part(month_txt, " ", 0), codes.MONTH_NUMBER),
                        F.col("Day of din_instante")).alias(DT),
        S.num_coerce("val_geraenergiaconmwmed").alias("generation"))
    wide = R.pivot_sum(df, [DT], "Region", "generation", regions, prefix="wind_generation_")
    return R.row_sum_cols(wide, [c for c in wide.columns if c.startswith("wind_generation_")], "wind_generation_sum")


def job_capacity(raw: DataFrame, cal_start: str = "2021-01-01", cal_end: str = "2024-10-31",
                 type_map: Mapping = codes.PLANT_TYPE, region_map: Mapping = codes.REGION_CAPACITY,
                 exclude: Sequence[str] = ("PY",), regions: Sequence[str] = ("NE", "N", "SE/CW", "S")) -> DataFrame:
    """Daily installed capacity per plant type x region (active when
    ``start <= day`` and no end or ``end > day``), all-zero columns dropped,
    plus a total per region (the listed ones, then the others of the data)."""
    df = C.filter_exclude_code(raw, "id_subsistema", exclude)
    df = df.select(S.map_replace("nom_tipousina", type_map).alias("ptype"),
                   S.map_replace("id_subsistema", region_map).alias("region"),
                   "dat_entradaoperacao", "dat_desativacao", "val_potenciaefetiva")
    long = J.interval_activity(df, start="dat_entradaoperacao", end="dat_desativacao",
                               amount="val_potenciaefetiva", keys=["ptype", "region"],
                               cal_start=cal_start, cal_end=cal_end)
    # The long table has at most (calendar days x plant types x regions) rows,
    # independent of the registry size.  It is materialised once in the shared
    # checkpoint folder: the column set (types x regions present) and the
    # all-zero column check are then read from it instead of re-running the
    # registry scan and join three times.
    long = (long.where(F.col("ptype").isNotNull() & F.col("region").isNotNull())
                .withColumn("combo", F.concat_ws("|", "ptype", "region")))
    ensure_checkpoint_dir(raw.sparkSession)
    long = long.checkpoint(eager=True)
    combos = sorted(r[0] for r in long.select("combo").distinct().collect())
    names = {c: f"{S.safe_name(c.split('|')[0])}_capacity_{S.safe_name(c.split('|')[1])}" for c in combos}
    wide = long.groupBy(DT).agg(*[F.max(F.when(F.col("combo") == F.lit(c), F.col("val_potenciaefetiva")))
                                  .alias(names[c]) for c in combos])
    spine = J.date_spine(raw.sparkSession, cal_start, cal_end, DT)
    wide = spine.join(wide, DT, "left")
    wide = wide.select(DT, *[F.coalesce(F.col(names[c]), F.lit(0.0)).alias(names[c]) for c in combos])
    wide = C.drop_constant_zero_cols(wide, list(names.values()))
    others = sorted({c.split("|", 1)[1] for c in combos} - set(regions))
    for r in [*regions, *others]:
        suffix = f"_capacity_{S.safe_name(r)}"
        members = [c for c in wide.columns if c.endswith(suffix)]
        wide = wide.withColumn(f"total_capacity_{S.safe_name(r)}",
                               R.row_sum(members) if members else F.lit(0.0))
    return wide


def job_consumption(raw: DataFrame, region_map: Mapping = codes.REGION_PRICE_AREA,
                    regions: Sequence[str] = codes.ENERGY_REGIONS, start: str | None = "2021-01-01",
                    tiebreak: Sequence[str] = (), last_period_days: int = 7,
                    last_expand_days: int = 1) -> DataFrame:
    """Latest forecast per (valid date, region) -> spread over the days until
    the next valid date -> daily consumption per region + total."""
    df = raw.select(F.col("DateForecastCET").cast("date").alias("issue"),
                    F.col("DateValueCET").cast("date").alias("valid"),
                    F.col("VolumeMWh").alias("consumption"),
                    S.map_replace("PowerPriceAreaCode", region_map).alias("Region"), *tiebreak)
    if start:
        df = df.where((F.col("issue") >= F.lit(start).cast("date")) &
                      (F.col("valid") >= F.lit(start).cast("date")))
    last = A.agg_last_vintage(df, ["valid", "Region"], "issue", "valid", tiebreak, ["consumption"])
    daily = TS.expand_period(last, group=["Region"], start="valid", value="consumption",
                             out_value="daily_consumption", day=DT,
                             last_period_days=last_period_days, last_expand_days=last_expand_days)
    wide = R.pivot_sum(daily, [DT], "Region", "daily_consumption", regions, prefix="consumption_")
    return R.row_sum_cols(wide, [c for c in wide.columns if c.startswith("consumption_")], "daily_sum_consumption")


def job_consumption_by_vintage(raw: DataFrame, region_map: Mapping = codes.REGION_PRICE_AREA,
                               regions: Sequence[str] = codes.ENERGY_REGIONS) -> DataFrame:
    df = raw.select(F.col("DateForecastCET").cast("date").alias(DT),
                    F.col("DateValueCET").cast("date").alias("forecasted_date"),
                    F.col("VolumeMWh").alias("consumption"),
                    S.map_replace("PowerPriceAreaCode", region_map).alias("Region"))
    wide = R.pivot_sum(df, [DT, "forecasted_date"], "Region", "consumption", regions, prefix="consumption_")
    return R.row_sum_cols(wide, [c for c in wide.columns if c.startswith("consumption_")], "total_consumption")


# ------------------------------------------------------------ daily cube -----

# measure of the cube -> how its rows of a (day, region) become one value
CUBE = {"inflow": lambda c: F.coalesce(F.sum(c), F.lit(0)), "solar_sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
        "solar_mean": F.avg, "generation": lambda c: F.coalesce(F.sum(c), F.lit(0))}


def daily_cube(raw: DataFrame, region_map: Mapping) -> DataFrame:
    """(DateTime, Region, inflow, solar_sum, solar_mean, generation) from rows (DateTime, Code,
    Inflow, Solar, Generation): the fact table is read and joined once, combined
    map-side, and the hydro, solar and wind tables all come from the written result."""
    df = raw.select(F.col("DateTime").cast("date").alias(DT), S.map_replace("Code", region_map).alias("Region"),
                    F.col("Inflow").alias("inflow"), F.col("Solar").alias("solar_sum"), F.col("Solar").alias("solar_mean"),
                    F.col("Generation").alias("generation"))
    return R.written(df.groupBy(DT, "Region").agg(*[how(F.col(c)).alias(c) for c, how in CUBE.items()]))


def hydro_of(cube: DataFrame, regions: Sequence[str], start: str | None = None) -> DataFrame:
    """``job_hydro``'s table from the cube."""
    return _of_cube(cube, regions, {"inflow": "hydro_inflow_"}, "daily_sum_hydro_inflow", start)


def solar_of(cube: DataFrame, regions: Sequence[str], start: str | None = None) -> DataFrame:
    return _of_cube(cube, regions, {"solar_sum": "solar_sum_", "solar_mean": "solar_mean_"}, "daily_sum_solar", start)


def wind_of(cube: DataFrame, regions: Sequence[str], start: str | None = None) -> DataFrame:
    return _of_cube(cube, regions, {"generation": "wind_generation_"}, "wind_generation_sum", start)


def _of_cube(cube: DataFrame, regions: Sequence[str], cells: Mapping[str, str], total: str, start: str | None) -> DataFrame:
    rows = cube.where(F.col(DT) >= F.lit(start).cast("date")) if start else cube
    wide = R.spread(rows, [DT], "Region", regions, [(c, R.namer(prefix, "")) for c, prefix in cells.items()])
    first = next(iter(cells.values()))
    return R.row_sum_cols(wide, [c for c in wide.columns if c.startswith(first)], total)


# -------------------------------------------------------------- weather -----

def weather_hourly(raw: DataFrame, stations: DataFrame, measure: str,
                   remap: Mapping | None = None) -> DataFrame:
    """Station readings with a timestamp and the station's region."""
    df = C.drop_nulls(raw.select("DATA", "Hora_UTC", measure, "ESTACAO"))
    df = df.select(S.ts_from_date_time("DATA", S.substring0("Hora_UTC", 0, 2)).alias(DT),
                   F.col(measure).alias(measure), "ESTACAO")
    return J.join_dim_lookup(df, stations, "ESTACAO", "id_station", ["region"],
                             remap={"region": remap} if remap else None)


def job_weather_daily(raw: DataFrame, stations: DataFrame, measure: str, regions: Sequence[str],
                      remap: Mapping | None = None, prefix: str | None = None) -> DataFrame:
    """Daily sum per region (empty days inside a region's span = 0), wide by
    region, with a total."""
    h = weather_hourly(raw, stations, measure, remap).where(F.col("region").isNotNull())
    daily = TS.resample_daily_sum(h, "region", DT, measure, DT)
    prefix = prefix or f"{measure}_"
    wide = R.pivot_region(daily, [DT], "region", measure, regions, prefix=prefix)
    return R.row_sum_cols(wide, [c for c in wide.columns if c.startswith(prefix)], f"total_daily_{measure}")


def job_rain_features(raw: DataFrame, stations: DataFrame, remap: Mapping | None = None,
                      area_codes: Mapping | None = None, to_zone: str = "Europe/Berlin") -> DataFrame:
    """Hourly rain rows with calendar features: local time, weekday, cyclic
    hour / day-of-year, weekend flag, year and the price-area code."""
    h = weather_hourly(raw, stations, "precipitation", remap).withColumnRenamed("region", "Region")
    hs, hc = S.cyclic(F.hour(DT), 24)
    doy = F.dayofyear(DT)
    ds, dc = S.cyclic(doy, 365)
    out = h.select(DT, "Region", F.col("precipitation").alias("rain"), F.lit("mm").alias("unit"),
                   F.month(DT).alias("month"), S.utc_to_zone(DT, to_zone).alias("local_time"),
                   S.weekday0(DT).alias("day_of_week"), hs.alias("hour_sin"), hc.alias("hour_cos"),
                   doy.alias("day_of_year"), ds.alias("day_sin"), dc.alias("day_cos"),
                   S.weekend_flag(DT).alias("is_weekend"), F.year(DT).alias("year"))
    if area_codes:
        out = out.withColumn("price_area_code", S.map_lookup("Region", area_codes))
    return out


# ---------------------------------------------------------- wide table -------

def job_prepared_dataset(forward: DataFrame, dailies: Sequence[DataFrame]) -> DataFrame:
    """Forward curve (grain: quote date x delivery month) left-joined with
    every daily table on the date, left-deep as in the source."""
    return J.join_left_chain(forward, dailies, DT)


def daily_features(dailies: Sequence[DataFrame]) -> DataFrame:
    """Daily tables combined on the date with full outer joins (one row per
    day that appears in any of them)."""
    out = dailies[0]
    for d in dailies[1:]:
        out = J.join_full_outer(out, d, DT)
    return out


def p0_p1(forward: DataFrame, price: str = "forward_price", delivery: str = "delivery_start") -> DataFrame:
    """Front-month (P0) and next-month (P1) price per quote date."""
    qm = S.month_start(DT)
    dm = S.month_start(delivery)
    return (forward.groupBy(DT)
                   .agg(F.max(F.when(dm == qm, F.col(price))).alias("P0"),
                        F.max(F.when(dm == F.add_months(qm, 1), F.col(price))).alias("P1"))
                   .where(F.col("P0").isNotNull() | F.col("P1").isNotNull()))


def job_p0_p1(forward: DataFrame, features: DataFrame | None, fill_front_from_next: bool = True,
              require_both: bool = False) -> DataFrame:
    """P0/P1 frame with the daily features attached (the features are unique
    per date, so ``drop_duplicates(DateTime)`` of the source is implicit)."""
    p = p0_p1(forward)
    if require_both:
        p = p.where(F.col("P0").isNotNull() & F.col("P1").isNotNull())
    if fill_front_from_next:
        p = p.withColumn("P0", F.coalesce("P0", "P1"))
    return p.join(features, DT, "left") if features is not None else p


# --------------------------------------------------------------- audits ------

def job_missing_audit(forward_dates: DataFrame, settlement_dates: DataFrame) -> DataFrame:
    """Calendar gaps of two tables: missing in both, only in the settlement
    table, only in the forward table, and all gaps of each - counted by weekday."""
    mf = TS.missing_dates(forward_dates, DT).select(DT)
    ms = TS.missing_dates(settlement_dates, DT).select(DT)
    parts = [("forward_missing", mf), ("settlement_missing", ms),
             ("both_missing", SO.set_intersect(mf, ms)),
             ("only_settlement_missing", SO.set_difference(ms, mf)),
             ("only_forward_missing", SO.set_difference(mf, ms))]
    tagged = SO.set_union_tagged(parts, "category")
    return A.agg_value_counts(tagged, ["category", S.day_name(DT).alias("weekday")], "count")


def job_price_vs_driver(forward: DataFrame, settlement: DataFrame, delivery_month: str,
                        lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Forward price for one delivery month beside the daily settlement price,
    both min-max normalised over the slice, in date order."""
    f = forward.where(F.col("delivery_start") == F.lit(delivery_month).cast("date"))
    if lo or hi:
        f = C.filter_range(f, DT, lo, hi)
    j = f.join(settlement.select(DT, "avg_settlement_price"), DT, "inner")
    from ..operators.prep import normalize_minmax
    n = normalize_minmax(j.select(DT, "forward_price", "avg_settlement_price"),
                         ["forward_price", "avg_settlement_price"])
    return n.orderBy(DT)


def read_all_daily(spark: SparkSession, d: str, *, region_map: Mapping, regions: Sequence[str],
                   area: str, cal_start: str, cal_end: str, start: str | None) -> dict[str, DataFrame]:
    """All cleaned daily tables of the driver stand-ins (see standins)."""
    from . import standins as SI
    return {
        "forward": job_forward_price(SI.forward_raw(spark, d)),
        "settlement": job_settlement(SI.settlement_raw(spark, d), area=area),
        "hydro": job_hydro(SI.hydro_raw(spark, d), region_map, regions, start),
        "solar": job_solar(SI.solar_raw(spark, d), region_map, regions, start),
        "wind": job_wind(SI.wind_raw(spark, d), region_map, regions),
        "capacity": job_capacity(SI.registry_raw(spark, d), cal_start, cal_end, {}, region_map,
                                 ("PY",), regions),
        "consumption": job_consumption(SI.consumption_raw(spark, d), region_map, regions, start,
                                       ("l_orderkey", "l_linenumber")),
    }


# ------------------------------------------------------- feature pipelines ---

def feature_pipeline(frame: DataFrame, target: str, *, date: str = DT, imputation: str = "mean",
                     scaling: str = "standard", features_to_drop: int = 5, remove_outliers: bool = False,
                     percentage_of_outliers: float = 0.01, train_size: float = 0.64, val_size: float = 0.16,
                     deal_with_skewness: bool = False, split: str = "chrono", split_key: str | None = None,
                     fit_per_split: bool = False, variance_threshold: float = 0.99 * (1 - 0.99)) -> DataFrame:
    """``build_pipeline`` / ``build_pipeline_P0_foward_price`` as one frame with
    a ``split`` column: optional quantile trim of the target -> split
    (``chrono``: ordered 64/16/20 by ``date``; ``random``: hash of
    ``split_key``) -> imputation -> scaling fitted on train -> variance
    threshold and (``features_to_drop > 0``) RFE fitted on train -> optional
    Yeo-Johnson.  Every fit is one aggregate pass; the split step checkpoints
    the ordered frame, so later passes read it instead of recomputing inputs.
    ``fit_per_split=True`` refits the imputer on every split like the source."""
    from ..operators import prep as P
    p = frame
    if remove_outliers:
        p = P.outlier_quantile(p, target, percentage_of_outliers)
    if split == "chrono":
        p = P.split_chrono(p, [date], train_size, val_size)
    elif split == "random":
        p = P.split_random(p, split_key or date, (train_size, val_size, 1.0 - train_size - val_size))
    else:
        raise ValueError(f"Invalid split: {split}")
    feats = [c for c in p.columns if c not in (date, P.SPLIT, target)]
    train = F.col(P.SPLIT) == "train"
    if fit_per_split:
        p = P.impute(p, feats, imputation, fit_per_split=True)
    else:
        p = P.impute(p, feats, imputation, fit_on=train, order=[date])
    p, _ = P.scale(p, feats, scaling, fit_on=train)
    kept = P.feat_variance_threshold(p, feats, variance_threshold, fit_on=train)
    if features_to_drop:
        rk = P.feat_rfe_linear(p, kept, target, max(1, len(kept) - features_to_drop), fit_on=train)
        kept = [r["feature"] for r in rk.where("selected").collect()]
    p = p.select(date, P.SPLIT, target, *kept)
    if deal_with_skewness:
        p, _ = P.power_yeo_johnson(p, kept, fit_on=train)
    return p


def feature_pipeline_settlement(frame: DataFrame, target: str, features: Sequence[str], *,
                                date: str = DT) -> DataFrame:
    """``make_basic_features_pipeline_for_settlement_price_prediction``: drop
    NULL targets, fixed columns, one row per date, IQR outlier filter, 80/20
    then 80/20 random split (hash of the date), mean imputation refitted per
    split (as the source does) and standard scaling fitted on train."""
    from ..operators import prep as P
    m = frame.select(date, target, *features)
    m = C.drop_nulls(m, [target])
    m = C.dedup_keep_first(m, [date], [date])
    m = P.outlier_iqr(m, [target, *features])
    u = P.hash_unit(F.col(date).cast("string"))
    u2 = P.hash_unit(F.concat(F.col(date).cast("string"), F.lit("#val")))
    m = m.withColumn(P.SPLIT, F.when(u >= 0.8, "test").when(u2 >= 0.8, "validation").otherwise("train"))
    m = P.impute(m, list(features), "mean", fit_per_split=True)
    m, _ = P.scale(m, list(features), "standard", fit_on=F.col(P.SPLIT) == "train")
    return m
