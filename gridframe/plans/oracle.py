"""DuckDB SQL oracle for the registered queries.

Written independently of the Spark code, from the operator semantics: the
stand-in tables and every job are re-stated as plain SQL over the driver
views.  Floating outputs are rounded exactly like ``queries.rnd``.
"""

from __future__ import annotations

from itertools import product as _product

SQL: dict[str, str] = {}

# ------------------------------------------------------------------ pieces --

CUST_REGION = """SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
SUPP_REGION = """SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""

REGION_CODE = """CASE {c} WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS'
  WHEN 'EUROPE' THEN 'EU' ELSE {c} END"""
REGIONS = [("AF", "AF"), ("AM", "AM"), ("AS", "AS"), ("EU", "EU"), ("MIDDLE EAST", "MIDDLE_EAST")]

FORWARD = """SELECT CAST(o.o_orderdate AS DATE) AS DateTime,
  CAST(date_trunc('month', l.l_shipdate) AS DATE) AS delivery_start,
  avg(l.l_extendedprice / l.l_quantity) AS forward_price
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2"""

SETTLE_TICKS = f"""SELECT o.o_orderdate AS ts, o.o_orderkey AS row_id, cr.r_name AS area, o.o_totalprice AS p
  FROM orders o JOIN ({CUST_REGION}) cr ON o.o_custkey = cr.c_custkey"""

SETTLEMENT = f"""SELECT CAST(timezone('America/Sao_Paulo', timezone('CET', ts)) AS DATE) AS DateTime,
  avg(p) AS avg_settlement_price, stddev_samp(p) AS std_settlement_price,
  min(p) AS min_settlement_price, max(p) AS max_settlement_price
  FROM ({SETTLE_TICKS}) GROUP BY 1"""
JOB_SETTLEMENT = SETTLEMENT.replace(" GROUP BY 1", " WHERE area = 'AMERICA' GROUP BY 1")

LI_SUPP = f"""SELECT l.*, sr.n_name, sr.r_name FROM lineitem l JOIN ({SUPP_REGION}) sr ON l.l_suppkey = sr.s_suppkey"""


def pivot_cols(value: str, key: str, prefix: str, agg: str = "first") -> str:
    return ", ".join(f"{agg}({value}) FILTER (WHERE {key} = '{v}') AS {prefix}{n}" for v, n in REGIONS)


def row_sum(prefix: str) -> str:
    return " + ".join(f"coalesce({prefix}{n}, 0)" for _, n in REGIONS)


HYDRO_LONG = f"""SELECT CAST(l_shipdate AS DATE) AS DateTime, {REGION_CODE.format(c='r_name')} AS Region,
  coalesce(sum(l_quantity), 0) AS inflow
  FROM ({LI_SUPP}) WHERE TRUE GROUP BY 1, 2"""
_FROM_START = "WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01'"
HYDRO = f"""SELECT *, {row_sum('hydro_inflow_')} AS daily_sum_hydro_inflow FROM (
  SELECT DateTime, {pivot_cols('inflow', 'Region', 'hydro_inflow_')} FROM ({HYDRO_LONG}) GROUP BY DateTime)"""
JOB_HYDRO = HYDRO.replace("WHERE TRUE", _FROM_START)


def rnd_all(inner: str, cols: list[str], n: int = 4, keep: list[str] | None = None) -> str:
    """SELECT keep..., round(c, n) AS c ... FROM (inner)."""
    keep = keep or []
    sel = ", ".join(keep + [f"round({c}, {n}) AS {c}" for c in cols])
    return f"SELECT {sel} FROM ({inner})"


# ============================================================== flagship ====

SQL["job_settlement"] = rnd_all(JOB_SETTLEMENT, ["avg_settlement_price", "std_settlement_price",
                                             "min_settlement_price", "max_settlement_price"], keep=["DateTime"])

# ========================================================== 2.1 sources =====

SQL["src_csv"] = "SELECT * FROM orders"
SQL["src_csv_sep"] = "SELECT * FROM orders"
SQL["src_multi_file_union"] = "SELECT * FROM orders"
SQL["src_parquet"] = """SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity,
  round(l_extendedprice, 4) AS l_extendedprice, l_shipdate FROM lineitem"""
SQL["snk_table"] = f"""SELECT DateTime, delivery_start, round(forward_price, 4) AS forward_price,
  CAST(year(DateTime) AS INTEGER) AS year FROM ({FORWARD})"""

# ============================================ 2.2 projection / filters =====

SQL["project_rename"] = "SELECT o_orderkey AS order_id, o_orderdate AS DateTime, round(o_totalprice, 4) AS price FROM orders"
SQL["rename_by_rule"] = """SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS li_l_quantity_v,
  round(l_extendedprice, 4) AS li_l_extendedprice_v FROM lineitem"""
SQL["select_by_pattern"] = """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS l_extendedprice,
  round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax FROM lineitem"""
QTY_BY_FLAG = """SELECT CAST(l_shipdate AS DATE) AS DateTime,
  coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS qty_A,
  coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS qty_N,
  coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS qty_R
  FROM lineitem GROUP BY 1"""
SQL["drop_constant_zero_cols"] = rnd_all(QTY_BY_FLAG, ["qty_A", "qty_N", "qty_R"], keep=["DateTime"])
SQL["filter_range"] = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
    AND o_orderpriority IN ('1-URGENT', '2-HIGH')"""
SQL["filter_year"] = """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'"""
CUSTOMER_CODES = f"""SELECT cr.c_custkey, CASE WHEN c.c_acctbal < 0 THEN NULL ELSE cr.r_name END AS region_code
  FROM ({CUST_REGION}) cr JOIN customer c ON c.c_custkey = cr.c_custkey"""
SQL["filter_exclude_code"] = f"""SELECT * FROM ({CUSTOMER_CODES})
  WHERE region_code IS NULL OR region_code <> 'MIDDLE EAST'"""
WEATHER = """SELECT ts, user_id AS ESTACAO, CAST(ts AS DATE) AS DATA,
  strftime(ts, '%H%M') || ' UTC' AS Hora_UTC,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS precipitation,
  CASE WHEN event_type = 'view' THEN NULL ELSE value * 10 END AS radiation,
  value AS wind_speed FROM events"""
SQL["drop_nulls"] = f"""SELECT ts, ESTACAO, round(precipitation, 4) AS precipitation, round(radiation, 4) AS radiation
  FROM ({WEATHER}) WHERE precipitation IS NOT NULL AND radiation IS NOT NULL"""
SQL["dedup_keep_first"] = f"""SELECT DateTime, delivery_start, round(forward_price, 4) AS forward_price FROM (
  SELECT *, row_number() OVER (PARTITION BY DateTime ORDER BY delivery_start) AS rn FROM ({FORWARD})) WHERE rn = 1"""
SQL["rows_any_null"] = f"""SELECT ts, ESTACAO, round(precipitation, 4) AS precipitation, round(radiation, 4) AS radiation
  FROM ({WEATHER}) WHERE precipitation IS NULL OR radiation IS NULL"""
SQL["unit_convert"] = f"""SELECT CAST(l_shipdate AS DATE) AS DateValueCET, r_name AS Location,
  round(l_quantity * 1000.0, 4) AS value_mwh, 'MWh' AS unit FROM ({LI_SUPP})"""


def rs(inner: str, keep: list[str], n: int = 4) -> str:
    """Keep the listed columns as they are and round every other column."""
    if not keep:
        return f"SELECT round(COLUMNS(*), {n}) FROM ({inner})"
    names = ", ".join(f"'{k}'" for k in keep)
    return (f"SELECT COLUMNS(lambda c: c IN ({names})), "
            f"round(COLUMNS(lambda c: c NOT IN ({names})), {n}) FROM ({inner})")


CODE_R = REGION_CODE.format(c="r_name")

SOLAR_LONG = f"""SELECT CAST(l_shipdate AS DATE) AS DateTime, {CODE_R} AS Region,
  coalesce(sum(l_extendedprice / 1000.0), 0) AS s, avg(l_extendedprice / 1000.0) AS m
  FROM ({LI_SUPP}) WHERE TRUE GROUP BY 1, 2"""
SOLAR = f"""SELECT *, {row_sum('solar_sum_')} AS daily_sum_solar FROM (
  SELECT DateTime, {pivot_cols('s', 'Region', 'solar_sum_')}, {pivot_cols('m', 'Region', 'solar_mean_')}
  FROM ({SOLAR_LONG}) GROUP BY DateTime)"""
JOB_SOLAR = SOLAR.replace("WHERE TRUE", _FROM_START)

WIND_LONG = f"""SELECT CAST(l_shipdate AS DATE) AS DateTime, {CODE_R} AS Region,
  coalesce(sum(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END), 0) AS generation
  FROM ({LI_SUPP}) GROUP BY 1, 2"""
WIND = f"""SELECT *, {row_sum('wind_generation_')} AS wind_generation_sum FROM (
  SELECT DateTime, {pivot_cols('generation', 'Region', 'wind_generation_')} FROM ({WIND_LONG}) GROUP BY DateTime)"""

REGISTRY = f"""SELECT {CODE_R} AS region, l.l_returnflag AS ptype,
  least(CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS s,
  CASE WHEN l.l_linestatus = 'O' THEN NULL
       ELSE greatest(CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) END AS e,
  l.l_quantity AS cap
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN ({SUPP_REGION}) sr ON l.l_suppkey = sr.s_suppkey"""
CAL = "SELECT CAST(range AS DATE) AS DateTime FROM range(DATE '1997-01-01', DATE '2000-01-01', INTERVAL 1 DAY)"
CAP_LONG = f"""SELECT c.DateTime, r.ptype, r.region, sum(r.cap) AS capacity FROM ({CAL}) c
  JOIN ({REGISTRY}) r ON r.s <= c.DateTime AND (r.e IS NULL OR r.e > c.DateTime) GROUP BY 1, 2, 3"""
_CAP_COLS = [(p, v, n) for p in ("A", "N", "R") for v, n in REGIONS]
CAPACITY = f"""SELECT *, {", ".join(
    " + ".join(f"{p}_capacity_{n}" for p in ("A", "N", "R")) + f" AS total_capacity_{n}" for _, n in REGIONS)}
  FROM (SELECT c.DateTime, {", ".join(
    f"coalesce(sum(capacity) FILTER (WHERE ptype = '{p}' AND region = '{v}'), 0) AS {p}_capacity_{n}"
    for p, v, n in _CAP_COLS)}
  FROM ({CAL}) c LEFT JOIN ({CAP_LONG}) USING (DateTime) GROUP BY c.DateTime)"""

CONS_RAW = f"""SELECT CAST(o.o_orderdate AS DATE) AS issue, CAST(l.l_shipdate AS DATE) AS valid,
  l.l_quantity AS consumption, {REGION_CODE.format(c='cr.r_name')} AS Region, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN ({CUST_REGION}) cr ON o.o_custkey = cr.c_custkey"""
CONS_LAST_ALL = f"""SELECT valid, Region, consumption, issue FROM (
  SELECT *, row_number() OVER (PARTITION BY valid, Region ORDER BY issue DESC, l_orderkey DESC, l_linenumber DESC, consumption DESC) AS rn
  FROM ({CONS_RAW}) WHERE issue <= valid) WHERE rn = 1"""
CONS_LAST = CONS_LAST_ALL
CONS_EXP = f"""SELECT Region, CAST(unnest(generate_series(valid, coalesce(nxt, valid + 1) - 1, INTERVAL 1 DAY)) AS DATE) AS DateTime,
  consumption / coalesce(datediff('day', valid, nxt), 7) AS daily_consumption
  FROM (SELECT *, lead(valid) OVER (PARTITION BY Region ORDER BY valid) AS nxt FROM ({CONS_LAST}))"""
CONSUMPTION = f"""SELECT *, {row_sum('consumption_')} AS daily_sum_consumption FROM (
  SELECT DateTime, {pivot_cols('dc', 'Region', 'consumption_')} FROM (
    SELECT DateTime, Region, coalesce(sum(daily_consumption), 0) AS dc FROM ({CONS_EXP}) GROUP BY 1, 2)
  GROUP BY DateTime)"""
JOB_CONSUMPTION = CONSUMPTION.replace("WHERE issue <= valid",
                                      "WHERE issue <= valid AND issue >= DATE '1996-01-01' AND valid >= DATE '1996-01-01'")

# ================================================================ 2.3 joins =

SQL["join_left_chain"] = rs(f"""SELECT * FROM ({FORWARD}) LEFT JOIN ({SETTLEMENT}) USING (DateTime)
  LEFT JOIN ({HYDRO}) USING (DateTime)""", ["DateTime", "delivery_start"])
SQL["join_inner"] = rs(f"SELECT * FROM ({SETTLEMENT}) JOIN ({HYDRO}) USING (DateTime)", ["DateTime"])
SQL["join_index_chain"] = rs(f"""SELECT * FROM ({SETTLEMENT}) JOIN ({HYDRO}) USING (DateTime)
  JOIN ({WIND}) USING (DateTime) JOIN ({SOLAR}) USING (DateTime) JOIN ({CONSUMPTION}) USING (DateTime)""",
                             ["DateTime"])
SQL["join_full_outer"] = rs(f"SELECT * FROM ({SETTLEMENT}) FULL JOIN ({HYDRO}) USING (DateTime)", ["DateTime"])
HOURLY_AREA = f"""SELECT CAST(e.ts AS DATE) AS date, CAST(hour(e.ts) AS INTEGER) AS hour, cr.r_name AS area,
  e.value, e.event_type FROM events e JOIN ({CUST_REGION}) cr ON e.user_id = cr.c_custkey"""
SQL["join_multi_key"] = f"""SELECT a.date, a.hour, a.area, round(a.mean_value, 4) AS mean_value, b.views FROM
  (SELECT date, hour, area, avg(value) AS mean_value FROM ({HOURLY_AREA}) GROUP BY 1, 2, 3) a JOIN
  (SELECT date, hour, area, count(*) AS views FROM ({HOURLY_AREA}) WHERE event_type = 'view' GROUP BY 1, 2, 3) b
  USING (date, hour, area)"""
WEATHER_HOURLY = f"""SELECT CAST(DATA AS TIMESTAMP) + to_hours(CAST(substr(Hora_UTC, 1, 2) AS BIGINT)) AS DateTime,
  {{m}}, ESTACAO, CASE st.r_name WHEN 'MIDDLE EAST' THEN 'ASIA' ELSE st.r_name END AS region
  FROM ({WEATHER}) w LEFT JOIN ({CUST_REGION}) st ON w.ESTACAO = st.c_custkey
  WHERE DATA IS NOT NULL AND Hora_UTC IS NOT NULL AND {{m}} IS NOT NULL AND ESTACAO IS NOT NULL"""
SQL["join_dim_lookup"] = rs(WEATHER_HOURLY.format(m="radiation"), ["DateTime", "ESTACAO", "region"])
SQL["join_self_prev_friday"] = f"""WITH f AS ({FORWARD}),
  w AS (SELECT *, DateTime - CAST(isodow(DateTime) - 1 - 4 AS INTEGER) AS fri FROM f WHERE isodow(DateTime) >= 6),
  j AS (SELECT w.forward_price AS a, f.forward_price AS b FROM w JOIN f ON f.DateTime = w.fri)
  SELECT (SELECT count(*) FROM w) AS weekend_rows, count(*) AS pairs,
         CAST(coalesce(sum(CASE WHEN a = b THEN 1 ELSE 0 END), 0) AS BIGINT) AS matches,
         round(coalesce(sum(CASE WHEN a = b THEN 1 ELSE 0 END), 0) * 100.0 / count(*), 6) AS match_pct FROM j"""
TEMP_HOURLY = f"""SELECT date_trunc('hour', e.ts) AS DateTime, cr.r_name AS PowerPriceAreaCode, avg(e.value) AS hourly_value
  FROM events e JOIN ({CUST_REGION}) cr ON e.user_id = cr.c_custkey GROUP BY 1, 2"""
SQL["join_agg_back"] = f"""SELECT CAST(DateTime AS DATE) AS Date, PowerPriceAreaCode, DateTime,
  round(hourly_value, 4) AS hourly_value,
  round(avg(hourly_value) OVER (PARTITION BY CAST(DateTime AS DATE), PowerPriceAreaCode), 4) AS daily_average_value
  FROM ({TEMP_HOURLY})"""
ALL_DAYS = f"""SELECT CAST(unnest(generate_series(min(s), max(greatest(s, e)), INTERVAL 1 DAY)) AS DATE) AS DateTime FROM ({REGISTRY})"""
SQL["join_interval_active"] = f"""SELECT ptype, region, DateTime, round(capacity, 4) AS capacity
  FROM ({CAP_LONG.replace(CAL, ALL_DAYS)}) WHERE capacity <> 0"""
SQL["semi_anti_dates"] = rs(f"""SELECT f.*, 'semi' AS kind FROM ({FORWARD}) f
  WHERE EXISTS (SELECT 1 FROM ({SETTLEMENT}) s WHERE s.DateTime = f.DateTime)
  UNION ALL SELECT f.*, 'anti' AS kind FROM ({FORWARD}) f
  WHERE NOT EXISTS (SELECT 1 FROM ({SETTLEMENT}) s WHERE s.DateTime = f.DateTime)""",
                            ["DateTime", "delivery_start", "kind"])
P0P1 = f"""SELECT DateTime,
  max(CASE WHEN delivery_start = date_trunc('month', DateTime) THEN forward_price END) AS P0,
  max(CASE WHEN delivery_start = date_trunc('month', DateTime) + INTERVAL 1 MONTH THEN forward_price END) AS P1
  FROM ({FORWARD}) GROUP BY DateTime"""
SQL["join_p0_p1"] = rs(f"""SELECT * EXCLUDE (P0), coalesce(P0, P1) AS P0 FROM ({P0P1})
  LEFT JOIN ({SETTLEMENT}) USING (DateTime) LEFT JOIN ({HYDRO}) USING (DateTime)
  WHERE P0 IS NOT NULL OR P1 IS NOT NULL""", ["DateTime"])
SQL["join_p0_p1_inner"] = rs(f"""SELECT * FROM ({P0P1})
  LEFT JOIN ({SETTLEMENT}) USING (DateTime) LEFT JOIN ({HYDRO}) USING (DateTime)
  WHERE P0 IS NOT NULL AND P1 IS NOT NULL""", ["DateTime"])

# ========================================================= 2.4 aggregates ===

SQL["agg_daily_stats"] = rs("""SELECT CAST(ts AS DATE) AS DateTime, avg(value) AS mean, stddev_samp(value) AS std,
  min(value) AS min, max(value) AS max FROM events GROUP BY 1""", ["DateTime"])
_STATS_EXT = """avg(p) AS mean, stddev_samp(p) AS std,
  min(p) AS min, max(p) AS max, round(var_samp(p), 0) AS var, max(p) - min(p) AS range, median(p) AS median,
  first(p ORDER BY ts, row_id) AS first, last(p ORDER BY ts, row_id) AS last, count(p) AS count,
  CASE WHEN count(p) >= 3 AND var_pop(p) > 0 THEN skewness(p) END AS skew"""
SQL["agg_daily_stats_ext"] = rs(f"""SELECT CAST(ts AS DATE) AS DateTime, area AS PowerPriceAreaCode, {_STATS_EXT}
  FROM ({SETTLE_TICKS}) GROUP BY 1, 2""", ["DateTime", "PowerPriceAreaCode", "count", "var"])
SQL["agg_sum_by_keys"] = rs(f"""SELECT CAST(l_shipdate AS DATE) AS DateTime, r_name AS region,
  coalesce(sum(l_quantity), 0) AS inflow FROM ({LI_SUPP}) GROUP BY 1, 2""", ["DateTime", "region"])
SQL["agg_sum_mean"] = rs(f"""SELECT CAST(l_shipdate AS DATE) AS DateTime, r_name AS region,
  coalesce(sum(l_extendedprice / 1000.0), 0) AS solar_sum, avg(l_extendedprice / 1000.0) AS solar_mean
  FROM ({LI_SUPP}) GROUP BY 1, 2""", ["DateTime", "region"])
SQL["agg_sum_mean_std_peak"] = rs("""SELECT CAST(ts AS DATE) AS DateTime, event_type,
  coalesce(sum(value), 0) AS sum, avg(value) AS mean, stddev_samp(value) AS std, max(value) AS peak
  FROM events GROUP BY 1, 2""", ["DateTime", "event_type"])
SQL["agg_by_calendar"] = rs(f"""SELECT CAST(isodow(e.ts) - 1 AS INTEGER) AS weekday, CAST(hour(e.ts) AS INTEGER) AS hour,
  cr.r_name AS region, avg(e.value) AS mean, coalesce(sum(e.value), 0) AS sum, count(e.value) AS count
  FROM events e JOIN ({CUST_REGION}) cr ON e.user_id = cr.c_custkey GROUP BY 1, 2, 3""",
                            ["weekday", "hour", "region", "count"])
SQL["agg_group_mean_sd"] = rs("""SELECT hour, event_type, mean, sd, mean - sd AS lower, mean + sd AS upper FROM (
  SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, avg(value) AS mean, stddev_samp(value) AS sd
  FROM events GROUP BY 1, 2)""", ["hour", "event_type"])
SQL["agg_by_year_cols"] = rs(f"""SELECT CAST(year(DateTime) AS INTEGER) AS year, sum(qty_R) AS returned_sum,
  avg(qty_R) AS returned_mean, sum(qty_A + qty_N + qty_R) AS all_sum, avg((qty_A + qty_N + qty_R) / 3) AS all_mean
  FROM ({QTY_BY_FLAG}) GROUP BY 1""", ["year"])
SQL["agg_last_vintage"] = rs(CONS_LAST_ALL, ["valid", "Region", "issue"])
_DESC = [("count", "CAST(count(value) AS DOUBLE)"), ("mean", "avg(value)"), ("std", "stddev_samp(value)"),
         ("min", "min(value)"), ("25%", "quantile_cont(value, 0.25)"), ("50%", "quantile_cont(value, 0.5)"),
         ("75%", "quantile_cont(value, 0.75)"), ("max", "max(value)")]
SQL["agg_describe"] = " UNION ALL ".join(
    f"SELECT event_type, 'value' AS \"column\", '{s}' AS stat, round({e}, 4) AS value FROM events GROUP BY event_type"
    for s, e in _DESC)
_WCOLS = ["DATA", "Hora_UTC", "precipitation", "radiation", "wind_speed", "ESTACAO"]
SQL["agg_missing_summary"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing,
    round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct FROM ({WEATHER})""" for c in _WCOLS)
SQL["agg_value_counts"] = f"""SELECT cr.r_name AS region, dayname(o.o_orderdate) AS weekday, count(*) AS count
  FROM orders o JOIN ({CUST_REGION}) cr ON o.o_custkey = cr.c_custkey GROUP BY 1, 2"""
SQL["agg_distinct"] = """SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n_unique,
  min(CAST(o_orderdate AS DATE)) AS min, max(CAST(o_orderdate AS DATE)) AS max FROM orders"""
_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL["agg_skewness"] = " UNION ALL ".join(f"""SELECT "column", round(skew_biased, 6) AS skew_biased,
  round(skew_corrected, 6) AS skew_corrected,
  CASE WHEN skew_corrected > 0.5 THEN 'right-skewed' WHEN skew_corrected < -0.5 THEN 'left-skewed'
       WHEN skew_corrected IS NOT NULL THEN 'symmetric' END AS label FROM (
  SELECT '{c}' AS "column",
    CASE WHEN var_pop({c}) > 0 THEN skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) END AS skew_biased,
    CASE WHEN count({c}) >= 3 AND var_pop({c}) > 0 THEN skewness({c}) END AS skew_corrected FROM lineitem)""" for c in _LI_NUM)
SQL["agg_corr"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS corr FROM lineitem"
    for c in ["l_quantity", "l_discount", "l_tax"])
SQL["agg_corr_grouped"] = " UNION ALL ".join(
    f"""SELECT l_returnflag, '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr
    FROM lineitem GROUP BY l_returnflag""" for i, a in enumerate(_LI_NUM) for b in _LI_NUM[i + 1:])
SQL["agg_histogram"] = """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
  b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((o_totalprice - lo) / (hi - lo) * 50) AS BIGINT) + 1, 50) END AS bin,
        lo, hi FROM orders, r WHERE o_totalprice IS NOT NULL)
  SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 50), 4) AS bin_lo, round(lo + bin * ((hi - lo) / 50), 4) AS bin_hi,
         count(*) AS count FROM b GROUP BY bin, lo, hi"""
SQL["agg_box_stats"] = """WITH base AS (SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, o_totalprice AS v FROM orders),
  q AS (SELECT weekday, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
        FROM base GROUP BY weekday),
  j AS (SELECT base.*, q.q1, q.median, q.q3, q.q1 - 1.5 * (q.q3 - q.q1) AS lf, q.q3 + 1.5 * (q.q3 - q.q1) AS uf
        FROM base JOIN q USING (weekday))
  SELECT weekday, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
    round(min(CASE WHEN v >= lf AND v <= uf THEN v END), 4) AS whisker_lo,
    round(max(CASE WHEN v >= lf AND v <= uf THEN v END), 4) AS whisker_hi,
    CAST(sum(CASE WHEN v >= lf AND v <= uf THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers, count(*) AS n
  FROM j GROUP BY weekday, q1, median, q3"""
SQL["agg_kde"] = """WITH s AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx FROM events),
  p AS (SELECT n, sd * pow(n, -0.2) AS h, mn, mx FROM s),
  g AS (SELECT n, h, mn - 3.0 * h AS g0, (mx - mn + 6.0 * h) / 199 AS step FROM p),
  grid AS (SELECT CAST(range AS INTEGER) AS grid FROM range(0, 200))
  SELECT grid, round(g0 + grid * step, 6) AS x,
    round(sum(exp(-0.5 * pow((g0 + grid * step - e.value) / h, 2))) / (n * h * sqrt(2 * pi())) * 1e6, 4) AS density_e6
  FROM grid, g, events e WHERE e.value IS NOT NULL GROUP BY grid, g0, step, n, h"""

# ============================================================ 2.5 reshape ===

SQL["pivot_region"] = rs(f"""SELECT DateTime, {pivot_cols('inflow', 'Region', 'inflow_')} FROM (
  SELECT CAST(l_shipdate AS DATE) AS DateTime, {CODE_R} AS Region, coalesce(sum(l_quantity), 0) AS inflow
  FROM ({LI_SUPP}) GROUP BY 1, 2) GROUP BY DateTime""", ["DateTime"])
SQL["pivot_table_mean"] = rs(f"""SELECT CAST(hour(ts) AS INTEGER) AS hour, {", ".join(
    f"avg(value) FILTER (WHERE isodow(ts) - 1 = {i}) AS wd_{i}" for i in range(7))} FROM events GROUP BY 1""",
                             ["hour"])
SQL["pivot_table_sum_multi"] = rs(f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {", ".join(
    f"sum({v}) FILTER (WHERE l_returnflag = '{f}') AS {v}_{f}" for f in "ANR" for v in ["l_quantity", "l_extendedprice"])}
  FROM lineitem GROUP BY 1""", ["month"])
SQL["pivot_surface"] = rs(f"SELECT delivery_start, DateTime, avg(forward_price) AS forward_price FROM ({FORWARD}) GROUP BY 1, 2",
                          ["delivery_start", "DateTime"])
SQL["row_sum_cols"] = rs(HYDRO, ["DateTime"])
SQL["row_mean_cols"] = rs(f"""SELECT DateTime, CASE WHEN ({" + ".join(f"CASE WHEN hydro_inflow_{n} IS NULL THEN 0 ELSE 1 END" for _, n in REGIONS)}) > 0
  THEN ({row_sum('hydro_inflow_')}) / ({" + ".join(f"CASE WHEN hydro_inflow_{n} IS NULL THEN 0 ELSE 1 END" for _, n in REGIONS)}) END AS row_mean_inflow
  FROM ({HYDRO})""", ["DateTime"])
SQL["unpivot_melt"] = rs(f"""SELECT DateTime, 'avg_settlement_price' AS series, avg_settlement_price AS value FROM ({SETTLEMENT})
  UNION ALL SELECT DateTime, 'max_settlement_price' AS series, max_settlement_price AS value FROM ({SETTLEMENT})""",
                         ["DateTime", "series"])


# ====================================================== 2.6 time series =====

SETTLE_SERIES = f"SELECT DateTime, avg_settlement_price, max_settlement_price FROM ({SETTLEMENT})"
SQL["win_lag"] = rs(f"""SELECT *, lag(avg_settlement_price, 7) OVER (ORDER BY DateTime) AS price_lag7,
  lag(avg_settlement_price, 30) OVER (ORDER BY DateTime) AS price_lag30 FROM ({SETTLE_SERIES})""", ["DateTime"])
SQL["win_lead_group"] = f"""SELECT valid, Region, lead(valid) OVER (PARTITION BY Region ORDER BY valid) AS next_valid
  FROM ({CONS_LAST_ALL})"""
SQL["win_rolling"] = rs(f"""SELECT DateTime, avg_settlement_price,
  CASE WHEN count(avg_settlement_price) OVER w7 = 7 THEN avg(avg_settlement_price) OVER w7 END AS rolling_mean_7,
  CASE WHEN count(avg_settlement_price) OVER w30 = 30 THEN stddev_samp(avg_settlement_price) OVER w30 END AS rolling_std_30
  FROM ({SETTLE_SERIES})
  WINDOW w7 AS (ORDER BY DateTime ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (ORDER BY DateTime ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", ["DateTime"])
SQL["win_group_transform_fill"] = f"""SELECT ts, ESTACAO,
  round(coalesce(radiation, avg(radiation) OVER (PARTITION BY hour(ts))), 4) AS radiation FROM ({WEATHER})"""
SETTLE_SPINE = f"""SELECT CAST(g AS DATE) AS DateTime, s.avg_settlement_price FROM
  (SELECT unnest(generate_series(min(DateTime), max(DateTime), INTERVAL 1 DAY)) AS g FROM ({SETTLEMENT})) sp
  LEFT JOIN ({SETTLEMENT}) s ON s.DateTime = CAST(sp.g AS DATE)"""
SQL["ts_ffill_bfill"] = rs(f"""SELECT DateTime,
  last_value(avg_settlement_price IGNORE NULLS) OVER (ORDER BY DateTime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_ffill,
  first_value(avg_settlement_price IGNORE NULLS) OVER (ORDER BY DateTime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price_bfill
  FROM ({SETTLE_SPINE})""", ["DateTime"])
ORDER_SPINE = """SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)),
  INTERVAL 1 DAY)) AS DATE) AS DateTime FROM orders"""
SQL["ts_calendar_spine"] = ORDER_SPINE
SQL["ts_missing_dates"] = f"""SELECT DateTime, CAST(isodow(DateTime) - 1 AS INTEGER) AS weekday, dayname(DateTime) AS day_name
  FROM ({ORDER_SPINE}) WHERE DateTime NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)"""
RAD_HOURLY = f"SELECT * FROM ({WEATHER_HOURLY.format(m='radiation')}) WHERE region IS NOT NULL"
RAD_DAILY = f"""SELECT region, CAST(DateTime AS DATE) AS DateTime, coalesce(sum(radiation), 0) AS radiation
  FROM ({RAD_HOURLY}) GROUP BY 1, 2"""
RAD_RESAMPLED = f"""SELECT sp.region, sp.DateTime, coalesce(d.radiation, 0) AS radiation FROM (
    SELECT region, CAST(unnest(generate_series(min(DateTime), max(DateTime), INTERVAL 1 DAY)) AS DATE) AS DateTime
    FROM ({RAD_DAILY}) GROUP BY region) sp
  LEFT JOIN ({RAD_DAILY}) d ON d.region = sp.region AND d.DateTime = sp.DateTime"""
SQL["ts_resample_daily"] = rs(RAD_RESAMPLED, ["region", "DateTime"])
SQL["ts_expand_period"] = rs(CONS_EXP.replace(CONS_LAST, CONS_LAST_ALL), ["Region", "DateTime"])
SQL["ts_forecast_lead_filter"] = f"""SELECT CAST(o.o_orderdate AS DATE) AS DateForecastCET, CAST(l.l_shipdate AS DATE) AS DateValueCET,
  round(l.l_quantity, 4) AS VolumeMWh, cr.r_name AS PowerPriceAreaCode, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN ({CUST_REGION}) cr ON o.o_custkey = cr.c_custkey
  WHERE datediff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) = 1"""
NUMBERED = f"SELECT *, row_number() OVER (ORDER BY DateTime) AS rn FROM ({SETTLE_SERIES})"
SQL["ts_sliding_sequences"] = rs(f"""SELECT t.rn AS row_number, t.DateTime AS target_date, t.avg_settlement_price AS target,
  CAST(w.rn - (t.rn - 7) AS INTEGER) AS step, w.avg_settlement_price, w.max_settlement_price
  FROM ({NUMBERED}) t JOIN ({NUMBERED}) w ON w.rn BETWEEN t.rn - 7 AND t.rn - 1 WHERE t.rn > 7""",
                                 ["row_number", "target_date", "step"])
SQL["ts_tail_period"] = rs(f"""SELECT *, 'last_2_months' AS slice FROM ({SETTLE_SERIES})
    WHERE DateTime >= (SELECT max(DateTime) FROM ({SETTLEMENT})) - INTERVAL 2 MONTH
  UNION ALL SELECT * FROM (SELECT *, 'last_10' AS slice FROM ({SETTLE_SERIES}) ORDER BY DateTime DESC LIMIT 10)
  UNION ALL SELECT * FROM (SELECT *, 'first_7' AS slice FROM ({SETTLE_SERIES}) ORDER BY DateTime LIMIT 7)
  UNION ALL SELECT * FROM (SELECT *, 'first_30' AS slice FROM ({SETTLE_SERIES}) ORDER BY DateTime LIMIT 30)
  UNION ALL SELECT *, 'jan_1998' AS slice FROM ({SETTLE_SERIES})
    WHERE DateTime BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'""", ["DateTime", "slice"])

# ================================================= 2.7 sort / top-k / sets ==

SQL["sort_multi"] = """SELECT o_orderkey, o_orderdate, round(o_totalprice, 4) AS o_totalprice,
  row_number() OVER (ORDER BY o_orderdate, o_totalprice DESC, o_orderkey) AS rank FROM orders"""
SQL["topk_abs"] = """SELECT l_orderkey, l_linenumber, round((l_discount - l_tax) * l_extendedprice, 4) AS score FROM lineitem
  ORDER BY abs((l_discount - l_tax) * l_extendedprice) DESC, l_orderkey, l_linenumber LIMIT 10"""
SQL["set_difference"] = """SELECT CAST(o_orderdate AS DATE) AS DateTime FROM orders
  EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem"""
SQL["set_intersect"] = """SELECT CAST(o_orderdate AS DATE) AS DateTime FROM orders
  INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem"""
SQL["set_union_tagged"] = f"""SELECT DISTINCT DateTime, 'forward' AS source FROM ({FORWARD})
  UNION ALL SELECT DateTime, 'settlement' AS source FROM ({SETTLEMENT})"""

# ======================================================= 2.8 scalars ========

SQL["map_replace"] = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H'
  ELSE o_orderpriority END AS priority FROM orders"""
SQL["map_lookup"] = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H'
  END AS priority FROM orders"""
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
           "October", "November", "December"]
SQL["str_split_expand"] = f"""SELECT month_text, split_part(month_text, ' ', 1) AS month_name,
  CAST(split_part(month_text, ' ', 2) AS INTEGER) AS year,
  CAST(CASE split_part(month_text, ' ', 1) {" ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(_MONTHS))} END AS INTEGER) AS month
  FROM (SELECT DISTINCT strftime(l_shipdate, '%B %Y') AS month_text FROM ({LI_SUPP}))"""
SQL["str_substring"] = f"SELECT ts, ESTACAO, substr(Hora_UTC, 1, 2) AS hour_text FROM ({WEATHER})"
SQL["num_coerce"] = f"""SELECT DISTINCT val_geraenergiaconmwmed, round(TRY_CAST(val_geraenergiaconmwmed AS DOUBLE), 4) AS generation
  FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS val_geraenergiaconmwmed
        FROM ({LI_SUPP}))"""
SQL["ts_build"] = """SELECT o_orderkey AS row_id, o_orderdate AS ts,
  make_date(year(o_orderdate), month(o_orderdate), 1) AS month_start,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 90 MINUTE AS plus_90min FROM orders"""
SQL["ts_tz_convert"] = """SELECT event_id, ts AS wall_cet, timezone('UTC', timezone('CET', ts)) AS utc,
  timezone('America/Sao_Paulo', timezone('CET', ts)) AS sao_paulo,
  timezone('Europe/Berlin', timezone('UTC', ts)) AS berlin_from_utc FROM events"""
SQL["date_parts"] = """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS day_name,
  monthname(ts) AS month_name, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(dayofyear(ts) AS INTEGER) AS day_of_year FROM events"""
SQL["date_format_trunc"] = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, CAST(o_orderdate AS DATE) AS date,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, strftime(o_orderdate, '%Y-%m-%d') AS date_text FROM orders"""
SQL["date_offset"] = """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS plus_1_month,
  CAST(o_orderdate AS DATE) + 3 AS plus_3_days, CAST(o_orderdate AS DATE) - 1 AS minus_1_day,
  CASE WHEN isodow(o_orderdate) >= 6 THEN CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 - 4 AS INTEGER)
       ELSE CAST(o_orderdate AS DATE) END AS previous_friday FROM orders"""
SQL["date_epoch"] = "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch_seconds FROM events"
_TWO_PI = "6.283185307179586"
SQL["cyclic_encode"] = f"""SELECT event_id,
  round(sin({_TWO_PI} * CAST(hour(ts) AS DOUBLE) / 24.0), 6) AS hour_sin, round(cos({_TWO_PI} * CAST(hour(ts) AS DOUBLE) / 24.0), 6) AS hour_cos,
  round(sin({_TWO_PI} * CAST(dayofyear(ts) AS DOUBLE) / 365.0), 6) AS day_sin, round(cos({_TWO_PI} * CAST(dayofyear(ts) AS DOUBLE) / 365.0), 6) AS day_cos,
  round(sin({_TWO_PI} * CAST(month(ts) AS DOUBLE) / 12.0), 6) AS month_sin, round(cos({_TWO_PI} * CAST(month(ts) AS DOUBLE) / 12.0), 6) AS month_cos
  FROM events"""
SQL["weekend_flag"] = "SELECT o_orderkey, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM orders"
SQL["interaction_features"] = """SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS price_x_discount,
  round(CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END, 4) AS unit_price,
  round(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END, 4) AS discount_per_tax FROM lineitem"""
SQL["log_sqrt_transform"] = """SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS sqrt_price,
  round(ln(1 + l_extendedprice), 6) AS log1p_price FROM lineitem"""


# ================================================== 2.9 data preparation ====

HASH_U = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
SQL["split_random"] = f"""SELECT o_orderkey, CASE WHEN u < 0.64 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT o_orderkey, {HASH_U.format(k='o_orderkey')} AS u FROM orders)"""
CHRONO = f"""SELECT * EXCLUDE (rn, n), CASE WHEN rn <= CAST(trunc(n * CAST(0.64 AS DOUBLE)) AS BIGINT) THEN 'train'
  WHEN rn <= CAST(trunc(n * CAST(0.64 AS DOUBLE)) AS BIGINT) + CAST(trunc(n * CAST(0.16 AS DOUBLE)) AS BIGINT) THEN 'validation'
  ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY DateTime) AS rn, count(*) OVER () AS n FROM ({{src}}))"""
SQL["split_chrono"] = CHRONO.format(src=f"SELECT DateTime FROM ({SETTLEMENT})")
SQL["split_by_date"] = f"""SELECT DateTime, CASE WHEN DateTime < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split
  FROM ({SETTLEMENT})"""
SQL["split_period_report"] = f"""SELECT split, min(DateTime) AS start, max(DateTime) AS "end", count(*) AS rows
  FROM ({CHRONO.format(src=f"SELECT DateTime FROM ({SETTLEMENT})")}) GROUP BY split"""
MODEL = f"SELECT * FROM ({SETTLEMENT}) LEFT JOIN ({HYDRO}) USING (DateTime)"
_IMP = ["std_settlement_price", "daily_sum_hydro_inflow"]


def _impute_sql(fill: str) -> str:
    cols = ", ".join(f"coalesce({c}, ({fill.format(c=c)})) AS {c}" for c in _IMP)
    return rs(f"SELECT DateTime, {cols} FROM ({MODEL})", ["DateTime"])


SQL["impute_mean"] = _impute_sql(f"SELECT avg({{c}}) FROM ({MODEL})")
SQL["impute_median"] = _impute_sql(f"SELECT quantile_cont({{c}}, 0.5) FROM ({MODEL})")
SQL["impute_mode"] = _impute_sql(
    f"SELECT {{c}} FROM ({MODEL}) WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC, {{c}} LIMIT 1")
CHRONO_MODEL = CHRONO.format(src=f"SELECT DateTime, avg_settlement_price, max_settlement_price, min_settlement_price FROM ({SETTLEMENT})")
_PC = ["avg_settlement_price", "min_settlement_price", "max_settlement_price"]
SQL["scale_standard"] = rs(f"""WITH c AS ({CHRONO_MODEL}),
  st AS (SELECT {", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in _PC)} FROM c WHERE split = 'train')
  SELECT DateTime, split, {", ".join(f"(c.{x} - st.m_{x}) / CASE WHEN st.s_{x} = 0 THEN 1 ELSE st.s_{x} END AS {x}" for x in _PC)}
  FROM c, st""", ["DateTime", "split"])
SQL["scale_minmax"] = rs(f"""WITH c AS ({CHRONO_MODEL}),
  st AS (SELECT {", ".join(f"min({x}) AS lo_{x}, max({x}) AS hi_{x}" for x in _PC)} FROM c WHERE split = 'train')
  SELECT DateTime, split, {", ".join(f"(c.{x} - st.lo_{x}) / CASE WHEN st.hi_{x} = st.lo_{x} THEN 1 ELSE st.hi_{x} - st.lo_{x} END AS {x}" for x in _PC)}
  FROM c, st""", ["DateTime", "split"])
SQL["scale_inverse"] = rs(f"""WITH c AS ({CHRONO_MODEL}),
  st AS (SELECT avg(avg_settlement_price) AS m, stddev_pop(avg_settlement_price) AS s FROM c WHERE split = 'train')
  SELECT DateTime, split, avg_settlement_price, ((avg_settlement_price - m) / s) * s + m AS restored FROM c, st""",
                          ["DateTime", "split"])
SQL["normalize_minmax"] = rs(f"""WITH s AS (SELECT * FROM ({SETTLE_SERIES})
    WHERE DateTime >= DATE '1998-01-01' AND DateTime < DATE '1999-01-01'),
  r AS (SELECT min(avg_settlement_price) AS a0, max(avg_settlement_price) AS a1,
               min(max_settlement_price) AS b0, max(max_settlement_price) AS b1 FROM s)
  SELECT DateTime, (avg_settlement_price - a0) / (a1 - a0) AS avg_settlement_price,
         (max_settlement_price - b0) / (b1 - b0) AS max_settlement_price FROM s, r""", ["DateTime"])
SQL["outlier_quantile"] = rs(f"""WITH s AS ({SETTLE_SERIES}),
  q AS (SELECT quantile_cont(avg_settlement_price, 0.01) AS lo, quantile_cont(avg_settlement_price, 0.99) AS hi FROM s)
  SELECT s.* FROM s, q WHERE avg_settlement_price > lo AND avg_settlement_price < hi""", ["DateTime"])
SQL["outlier_iqr"] = rs(f"""WITH s AS ({SETTLE_SERIES}),
  q AS (SELECT quantile_cont(avg_settlement_price, 0.25) AS a1, quantile_cont(avg_settlement_price, 0.75) AS a3,
               quantile_cont(max_settlement_price, 0.25) AS b1, quantile_cont(max_settlement_price, 0.75) AS b3 FROM s)
  SELECT s.* FROM s, q WHERE NOT coalesce(avg_settlement_price < a1 - 1.5 * (a3 - a1) OR avg_settlement_price > a3 + 1.5 * (a3 - a1), false)
    AND NOT coalesce(max_settlement_price < b1 - 1.5 * (b3 - b1) OR max_settlement_price > b3 + 1.5 * (b3 - b1), false)""",
                        ["DateTime"])


def _yj(x: str, lam: float) -> str:
    pos = f"(pow({x} + 1.0, {lam!r}) - 1.0) / {lam!r}" if abs(lam) > 1e-12 else f"ln(1 + {x})"
    neg = (f"-(pow(-{x} + 1.0, {2.0 - lam!r}) - 1.0) / {2.0 - lam!r}" if abs(lam - 2.0) > 1e-12
           else f"-ln(1 - {x})")
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


_YJ = {"l_quantity": 0.5, "l_discount": 1.5, "l_tax": 2.0}
SQL["power_yeo_johnson"] = rs(f"""SELECT l_orderkey, l_linenumber, {", ".join(f"{_yj(c, lam)} AS {c}" for c, lam in _YJ.items())}
  FROM lineitem""", ["l_orderkey", "l_linenumber"], 6)
_VT = _PC + [f"hydro_inflow_{n}" for _, n in REGIONS]
SQL["feat_variance_threshold"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(var_pop({c}), 2) AS variance, coalesce(var_pop({c}) > 0.0099, false) AS selected
    FROM ({MODEL})""" for c in _VT)
_LN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL["feat_select_kbest_f"] = f"""WITH g AS (SELECT l_returnflag, count(*) AS ng, {", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _LN)}
    FROM lineitem GROUP BY l_returnflag),
  t AS (SELECT sum(ng) AS n, count(*) AS k, {", ".join(f"sum(m_{c} * ng) AS s_{c}, sum(ng * v_{c}) AS w_{c}" for c in _LN)} FROM g),
  f AS ({" UNION ALL ".join(f"""SELECT '{c}' AS feature,
      (SELECT sum(ng * (m_{c} - s_{c} / n) * (m_{c} - s_{c} / n)) FROM g) / (k - 1) / (w_{c} / (n - k)) AS f_score FROM t""" for c in _LN)})
  SELECT feature, round(f_score, 6) AS f_score FROM f ORDER BY f_score DESC, feature LIMIT 3"""
SQL["feature_subset"] = rs(f"""SELECT DateTime, avg_settlement_price, hydro_inflow_AF, hydro_inflow_AM, daily_sum_hydro_inflow
  FROM ({MODEL})""", ["DateTime"])

# ================================================ 2.10 distribution tests ===

SQL["test_normality_moments"] = " UNION ALL ".join(f"""SELECT '{c}' AS "column", n, round(skew, 6) AS skew,
    round(kurt, 6) AS excess_kurtosis, round(n / 6.0 * (skew * skew + kurt * kurt / 4.0), 6) AS jb,
    round(exp(-(n / 6.0 * (skew * skew + kurt * kurt / 4.0)) / 2.0), 6) AS p_value,
    exp(-(n / 6.0 * (skew * skew + kurt * kurt / 4.0)) / 2.0) > 0.05 AS normal
  FROM (SELECT count({c}) AS n, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS skew,
               kurtosis_pop({c}) AS kurt FROM lineitem)""" for c in ["l_quantity", "l_extendedprice"])

# ================================================== 2.11 models / eval ======

SQL["reg_linear"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem"""
SQL["fold_assign"] = f"""SELECT DateTime, CAST(CASE WHEN rn - 1 < (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1)
    ELSE (n % 5) + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
  FROM (SELECT DateTime, row_number() OVER (ORDER BY DateTime) AS rn, count(*) OVER () AS n FROM ({SETTLEMENT}))"""


def _metrics(src: str, y: str, p: str, extra: str = "", adj: int | None = None) -> str:
    adj_col = (f", round(1 - (1 - (1 - mse / vy)) * (n - 1) / (n - {adj} - 1), 6) AS adj_r2" if adj is not None else "")
    return f"""SELECT n, round(mse, 0) AS mse, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae,
      round(1 - mse / vy, 6) AS r2, round(1 - ve / vy, 6) AS explained_variance{adj_col}{extra}
    FROM (SELECT count(*) AS n, avg(({y} - {p}) * ({y} - {p})) AS mse, avg(abs({y} - {p})) AS mae,
                 var_pop({y}) AS vy, var_pop({y} - {p}) AS ve FROM ({src}) WHERE {y} IS NOT NULL AND {p} IS NOT NULL)"""


SQL["eval_metrics"] = _metrics("""SELECT l.l_extendedprice AS y, l.l_quantity * p.p_retailprice AS p
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""", "y", "p", adj=1)
NAIVE = f"""SELECT DateTime, avg_settlement_price AS y, lag(avg_settlement_price, 1) OVER (ORDER BY DateTime) AS p
  FROM ({SETTLEMENT})"""
SQL["eval_horizon"] = " UNION ALL ".join([
    _metrics(f"SELECT * FROM ({NAIVE}) ORDER BY DateTime LIMIT 7", "y", "p", ", 'first_7' AS horizon"),
    _metrics(f"SELECT * FROM ({NAIVE}) ORDER BY DateTime LIMIT 30", "y", "p", ", 'first_30' AS horizon"),
    _metrics(f"SELECT * FROM ({NAIVE}) ORDER BY DateTime DESC LIMIT 10", "y", "p", ", 'last_10' AS horizon"),
    _metrics(f"""SELECT * FROM ({NAIVE}) WHERE DateTime >= (SELECT max(DateTime) FROM ({SETTLEMENT})) - INTERVAL 2 MONTH""",
             "y", "p", ", 'last_2_months' AS horizon")])
SQL["eval_actual_vs_pred"] = rs(f"""SELECT DateTime, 'actual' AS series, y AS value FROM ({NAIVE})
  UNION ALL SELECT DateTime, 'predicted' AS series, p AS value FROM ({NAIVE})""", ["DateTime", "series"])

# ===================================================== 2.12 domain jobs =====

SQL["job_forward_price"] = rs(FORWARD, ["DateTime", "delivery_start"])
SQL["job_market_price"] = rs(f"""SELECT *, CAST(year(DateTime) AS INTEGER) AS year, CAST(month(DateTime) AS INTEGER) AS month,
  CAST(day(DateTime) AS INTEGER) AS day, dayname(DateTime) AS weekday_name, 'AM' AS region FROM ({FORWARD})""",
                             ["DateTime", "delivery_start", "year", "month", "day", "weekday_name", "region"])
SQL["job_settlement_ext"] = rs(f"""SELECT CAST(ts AS DATE) AS DateTime, {_STATS_EXT}
  FROM ({SETTLE_TICKS}) WHERE area = 'AMERICA' GROUP BY 1""", ["DateTime", "count", "var"])
SQL["job_temperature"] = SQL["join_agg_back"]
SQL["job_hydro"] = rs(JOB_HYDRO, ["DateTime"])
SQL["job_solar"] = rs(JOB_SOLAR, ["DateTime"])
SQL["job_wind"] = rs(WIND, ["DateTime"])
SQL["job_capacity"] = rs(CAPACITY, ["DateTime"])
SQL["job_consumption"] = rs(JOB_CONSUMPTION, ["DateTime"])
_WREG = [("AFRICA", "AFRICA"), ("AMERICA", "AMERICA"), ("ASIA", "ASIA"), ("EUROPE", "EUROPE")]
SQL["job_weather_daily"] = rs(f"""SELECT *, {" + ".join(f"coalesce(radiation_{n}, 0)" for _, n in _WREG)} AS total_daily_radiation FROM (
  SELECT DateTime, {", ".join(f"first(radiation) FILTER (WHERE region = '{v}') AS radiation_{n}" for v, n in _WREG)}
  FROM ({RAD_RESAMPLED}) GROUP BY DateTime)""", ["DateTime"])
SQL["job_rain_features"] = rs(f"""SELECT DateTime, region AS Region, precipitation AS rain, 'mm' AS unit,
  CAST(month(DateTime) AS INTEGER) AS month, timezone('Europe/Berlin', timezone('UTC', DateTime)) AS local_time,
  CAST(isodow(DateTime) - 1 AS INTEGER) AS day_of_week,
  sin({_TWO_PI} * CAST(hour(DateTime) AS DOUBLE) / 24.0) AS hour_sin, cos({_TWO_PI} * CAST(hour(DateTime) AS DOUBLE) / 24.0) AS hour_cos,
  CAST(dayofyear(DateTime) AS INTEGER) AS day_of_year,
  sin({_TWO_PI} * CAST(dayofyear(DateTime) AS DOUBLE) / 365.0) AS day_sin, cos({_TWO_PI} * CAST(dayofyear(DateTime) AS DOUBLE) / 365.0) AS day_cos,
  CASE WHEN isodow(DateTime) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(year(DateTime) AS INTEGER) AS year,
  CASE region WHEN 'AFRICA' THEN 'AREA_AF' WHEN 'AMERICA' THEN 'AREA_AM' WHEN 'ASIA' THEN 'AREA_AS' WHEN 'EUROPE' THEN 'AREA_EU' END AS price_area_code
  FROM ({WEATHER_HOURLY.format(m='precipitation')})""",
  ["DateTime", "Region", "unit", "month", "local_time", "day_of_week", "day_of_year", "is_weekend", "year", "price_area_code"], 6)
SQL["job_consumption_by_vintage"] = rs(f"""SELECT *, {row_sum('consumption_')} AS total_consumption FROM (
  SELECT DateTime, forecasted_date, {pivot_cols('c', 'Region', 'consumption_')} FROM (
    SELECT issue AS DateTime, valid AS forecasted_date, Region, coalesce(sum(consumption), 0) AS c
    FROM ({CONS_RAW}) GROUP BY 1, 2, 3) GROUP BY DateTime, forecasted_date)""", ["DateTime", "forecasted_date"])
SQL["job_prepared_dataset"] = rs(f"""SELECT * FROM ({FORWARD}) LEFT JOIN ({JOB_SETTLEMENT}) USING (DateTime)
  LEFT JOIN ({JOB_HYDRO}) USING (DateTime) LEFT JOIN ({JOB_SOLAR}) USING (DateTime) LEFT JOIN ({WIND}) USING (DateTime)
  LEFT JOIN ({CAPACITY}) USING (DateTime) LEFT JOIN ({JOB_CONSUMPTION}) USING (DateTime)""", ["DateTime", "delivery_start"])


def _missing(src: str) -> str:
    return f"""SELECT CAST(g AS DATE) AS DateTime FROM (SELECT unnest(generate_series(min(DateTime), max(DateTime), INTERVAL 1 DAY)) AS g
      FROM ({src})) WHERE CAST(g AS DATE) NOT IN (SELECT DateTime FROM ({src}))"""


_MF, _MS = _missing(f"SELECT DateTime FROM ({FORWARD})"), _missing(f"SELECT DateTime FROM ({JOB_SETTLEMENT})")
SQL["job_missing_audit"] = f"""SELECT category, dayname(DateTime) AS weekday, count(*) AS count FROM (
  SELECT DateTime, 'forward_missing' AS category FROM ({_MF})
  UNION ALL SELECT DateTime, 'settlement_missing' FROM ({_MS})
  UNION ALL SELECT DateTime, 'both_missing' FROM (SELECT DateTime FROM ({_MF}) INTERSECT SELECT DateTime FROM ({_MS}))
  UNION ALL SELECT DateTime, 'only_settlement_missing' FROM (SELECT DateTime FROM ({_MS}) EXCEPT SELECT DateTime FROM ({_MF}))
  UNION ALL SELECT DateTime, 'only_forward_missing' FROM (SELECT DateTime FROM ({_MF}) EXCEPT SELECT DateTime FROM ({_MS})))
  GROUP BY 1, 2"""
SQL["job_price_vs_driver"] = rs(f"""WITH j AS (SELECT f.DateTime, f.forward_price, s.avg_settlement_price FROM ({FORWARD}) f
    JOIN ({JOB_SETTLEMENT}) s USING (DateTime) WHERE f.delivery_start = DATE '1998-06-01'),
  r AS (SELECT min(forward_price) AS a0, max(forward_price) AS a1, min(avg_settlement_price) AS b0,
               max(avg_settlement_price) AS b1 FROM j)
  SELECT DateTime, (forward_price - a0) / (a1 - a0) AS forward_price, (avg_settlement_price - b0) / (b1 - b0) AS avg_settlement_price
  FROM j, r""", ["DateTime"], 6)


# ---------------------------------------------- feature pipeline (no RFE) ---

PF = f"""SELECT * EXCLUDE (P0), coalesce(P0, P1) AS P0 FROM ({P0P1})
  LEFT JOIN ({SETTLEMENT}) USING (DateTime) LEFT JOIN ({HYDRO}) USING (DateTime)
  WHERE P0 IS NOT NULL OR P1 IS NOT NULL"""
_PF_FEATS = (["P1", "avg_settlement_price", "std_settlement_price", "min_settlement_price", "max_settlement_price"]
             + [f"hydro_inflow_{n}" for _, n in REGIONS] + ["daily_sum_hydro_inflow"])
SQL["feature_pipeline"] = rs(f"""WITH c AS ({CHRONO.format(src=PF)}),
  m AS (SELECT {", ".join(f"avg({f}) AS m_{f}" for f in _PF_FEATS)} FROM c WHERE split = 'train'),
  i AS (SELECT DateTime, split, P0, {", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in _PF_FEATS)} FROM c, m),
  st AS (SELECT {", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in _PF_FEATS)} FROM i WHERE split = 'train')
  SELECT DateTime, split, P0, {", ".join(
      f"({f} - a_{f}) / CASE WHEN s_{f} IS NULL OR s_{f} = 0 THEN 1 ELSE s_{f} END AS {f}" for f in _PF_FEATS)}
  FROM i, st""", ["DateTime", "split"], 6)


# ------------------------------------------- ridge closed form (3 features) ---

def _det3(m) -> str:
    return (f"(({m[0][0]}) * (({m[1][1]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][1]}))"
            f" - ({m[0][1]}) * (({m[1][0]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][0]}))"
            f" + ({m[0][2]}) * (({m[1][0]}) * ({m[2][1]}) - ({m[1][1]}) * ({m[2][0]})))")


_RX = ["l_quantity", "l_discount", "l_tax"]
_GRAM = f"""g AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, {", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(_RX))},
    {", ".join(f"covar_pop({_RX[i]}, {_RX[j]}) * count(*) AS a{i}{j}" for i in range(3) for j in range(3))},
    {", ".join(f"covar_pop({x}, l_extendedprice) * count(*) AS c{i}" for i, x in enumerate(_RX))}
    FROM lineitem)"""


def _det(m) -> str:
    """A determinant written out; of no rows, 1."""
    if not m:
        return "1.0"
    if len(m) == 3:
        return _det3(m)
    if len(m) == 2:
        return f"(({m[0][0]}) * ({m[1][1]}) - ({m[0][1]}) * ({m[1][0]}))"
    return f"({m[0][0]})"


def _solution(active, signs, l1: float, l2: float) -> list[str]:
    """Coefficients of all features with the given active ones: (A + n l2) b = c - n l1 sign, by Cramer's rule."""
    a = [[f"a{i}{j}" + (f" + n * {l2}" if i == j else "") for j in active] for i in active]
    rhs = [f"c{i} - n * {l1} * ({s})" for i, s in zip(active, signs)]
    out = ["0.0"] * 3
    for k, i in enumerate(active):
        out[i] = f"{_det([[rhs[r] if c == k else a[r][c] for c in range(len(active))] for r in range(len(active))])} / {_det(a)}"
    return out


def _coefficients(fits: list[tuple[float, str]], digits: int) -> str:
    """(alpha, feature, coefficient) rows of (alpha, SQL of b0, b1, b2, my, m0, m1, m2)."""
    parts = []
    for alpha, sql in fits:
        named = ", ".join(f"('{x}', b{i})" for i, x in enumerate(_RX)) + ", ('intercept', my - b0 * m0 - b1 * m1 - b2 * m2)"
        parts.append(f"SELECT {alpha}::DOUBLE AS alpha, v.f AS feature, round(v.b, {digits}) AS coefficient FROM ({sql}) q, LATERAL (VALUES {named}) v(f, b)")
    return f"WITH {_GRAM} " + " UNION ALL ".join(parts)


def _ridge(alpha: float) -> str:
    b = _solution([0, 1, 2], [0, 0, 0], 0.0, 0.0)
    g = f"SELECT * REPLACE ({', '.join(f'a{i}{i} + {alpha} AS a{i}{i}' for i in range(3))}) FROM g"
    return f"SELECT my, m0, m1, m2, {', '.join(f'{x} AS b{i}' for i, x in enumerate(b))} FROM ({g})"


def _net(alpha: float, ratio: float) -> str:
    """The one sign pattern that meets the optimality conditions: b has those
    signs, and where b is 0 the correlation left is at most n l1."""
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    patterns = []
    for signs in _product((-1, 0, 1), repeat=3):
        active = [i for i in range(3) if signs[i]]
        b = _solution(active, [signs[i] for i in active], l1, l2)
        solved = f"SELECT *, {', '.join(f'{x} AS b{i}' for i, x in enumerate(b))} FROM g"
        test = [f"b{i} * ({signs[i]}) > 0" if signs[i] else f"abs(c{i} - {' - '.join(f'a{i}{j} * b{j}' for j in range(3))}) <= n * {l1}" for i in range(3)]
        patterns.append(f"SELECT my, m0, m1, m2, b0, b1, b2 FROM ({solved}) WHERE {' AND '.join(test)}")
    return "SELECT * FROM (" + " UNION ALL ".join(patterns) + ") LIMIT 1"


SQL["reg_ridge"] = _coefficients([(a, _ridge(a)) for a in (0.1, 0.2, 3.0, 5.0, 10.0)], 3)
SQL["reg_lasso"] = _coefficients([(a, _net(a, 1.0)) for a in (0.1, 0.8, 10.0)], 3)
SQL["reg_elastic_net"] = _coefficients([(a, _net(a, 0.5)) for a in (0.1, 1.0)], 3)


# ------------------------------------------ build_pipeline (random split) ---

_RW_FEATS = (["avg_settlement_price", "std_settlement_price", "min_settlement_price", "max_settlement_price"]
             + [f"hydro_inflow_{n}" for _, n in REGIONS] + ["daily_sum_hydro_inflow", "date_epoch", "delivery_epoch"])
_RW = f"""SELECT CAST(DateTime AS VARCHAR) || '|' || CAST(delivery_start AS VARCHAR) AS row_key,
    * EXCLUDE (DateTime, delivery_start),
    datediff('day', DATE '1970-01-01', DateTime) * 86400.0 AS date_epoch,
    datediff('day', DATE '1970-01-01', delivery_start) * 86400.0 AS delivery_epoch
  FROM ({FORWARD}) LEFT JOIN ({SETTLEMENT}) USING (DateTime) LEFT JOIN ({HYDRO}) USING (DateTime)"""
SQL["feature_pipeline_random"] = rs(f"""WITH c AS (SELECT *, CASE WHEN u < 0.64 THEN 'train' WHEN u < 0.8 THEN 'validation'
      ELSE 'test' END AS split FROM (SELECT *, {HASH_U.format(k='row_key')} AS u FROM ({_RW}))),
  m AS (SELECT {", ".join(f"avg({f}) AS m_{f}" for f in _RW_FEATS)} FROM c WHERE split = 'train'),
  i AS (SELECT row_key, split, forward_price, {", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in _RW_FEATS)} FROM c, m),
  st AS (SELECT {", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in _RW_FEATS)} FROM i WHERE split = 'train')
  SELECT row_key, split, forward_price, {", ".join(
      f"({f} - a_{f}) / CASE WHEN s_{f} IS NULL OR s_{f} = 0 THEN 1 ELSE s_{f} END AS {f}" for f in _RW_FEATS)}
  FROM i, st""", ["row_key", "split"], 6)


# ----------------------------------------- settlement pipeline (no RFE) -----

_SP_FEATS = [f"hydro_inflow_{n}" for _, n in REGIONS] + ["daily_sum_hydro_inflow"]
_SP_COLS = ["avg_settlement_price"] + _SP_FEATS
SQL["feature_pipeline_settlement"] = rs(f"""WITH m AS (SELECT DateTime, {", ".join(_SP_COLS)} FROM ({MODEL})
    WHERE avg_settlement_price IS NOT NULL),
  q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in _SP_COLS)} FROM m),
  f AS (SELECT m.* FROM m, q WHERE {" AND ".join(
      f"NOT coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false)"
      for c in _SP_COLS)}),
  c AS (SELECT *, CASE WHEN {HASH_U.format(k='CAST(DateTime AS VARCHAR)')} >= 0.8 THEN 'test'
                      WHEN {HASH_U.format(k="CAST(DateTime AS VARCHAR) || '#val'")} >= 0.8 THEN 'validation'
                      ELSE 'train' END AS split FROM f),
  pm AS (SELECT split, {", ".join(f"avg({c}) AS m_{c}" for c in _SP_FEATS)} FROM c GROUP BY split),
  i AS (SELECT c.DateTime, c.split, c.avg_settlement_price, {", ".join(f"coalesce(c.{x}, pm.m_{x}) AS {x}" for x in _SP_FEATS)}
        FROM c JOIN pm USING (split)),
  st AS (SELECT {", ".join(f"avg({x}) AS a_{x}, stddev_pop({x}) AS s_{x}" for x in _SP_FEATS)} FROM i WHERE split = 'train')
  SELECT DateTime, split, avg_settlement_price, {", ".join(
      f"({x} - a_{x}) / CASE WHEN s_{x} IS NULL OR s_{x} = 0 THEN 1 ELSE s_{x} END AS {x}" for x in _SP_FEATS)}
  FROM i, st""", ["DateTime", "split"], 6)


def _double_round(sql: str) -> str:
    """Rewrite ``round(x, n)`` as ``round(round(x, 8), n) + 0.0`` for n < 8 (see
    ``queries.rr``: both engines then round the same double the same way, and
    a signed zero becomes +0.0)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        k, depth, comma = j + 6, 1, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + 6:k - 1]
        if comma is None:
            out.append(sql[i:k])
        else:
            arg, n = sql[j + 6:comma], sql[comma + 1:k - 1].strip()
            arg = _double_round(arg)
            if n.isdigit() and int(n) < 8:
                out.append(sql[i:j] + f"(round(round({arg}, 8), {n}) + 0.0)")
            else:
                out.append(sql[i:j] + f"(round({arg}, {n}) + 0.0)")
        del inner
        i = k


SQL = {k: _double_round(v) for k, v in SQL.items()}


# ------------------------------------------------ principal components -------

_PX = [f"hydro_inflow_{n}" for _, n in REGIONS]
_P5 = range(len(_PX))


def _strongest(cov: str, name: str) -> str:
    """CTEs of a covariance table's first component: the matrix is squared again and
    again (trace kept at 1) until it is the projection on that component, whose
    largest entry is positive by construction; then the rest of the matrix."""
    cells = ", ".join(f"m{i}{j}" for i in _P5 for j in _P5)
    square = ", ".join(f"({' + '.join(f'm{i}{k} * m{k}{j}' for k in _P5)}) / ({' + '.join(f'm{a}{b} * m{a}{b}' for a in _P5 for b in _P5)}) AS m{i}{j}"
                       for i in _P5 for j in _P5)
    largest = "greatest(" + ", ".join(f"m{i}{i}" for i in _P5) + ")"
    entry = [f"(CASE {' '.join(f'WHEN m{r}{r} = {largest} THEN m{i}{r}' for r in _P5)} END) / sqrt({largest}) AS v{i}" for i in _P5]
    value = " + ".join(f"v{i} * m{i}{j} * v{j}" for i in _P5 for j in _P5)
    return f"""{name}_powers AS (SELECT 0 AS step, {cells} FROM {cov} UNION ALL SELECT step + 1, {square} FROM {name}_powers WHERE step < 45),
  {name}_vector AS (SELECT {", ".join(entry)} FROM {name}_powers WHERE step = 45),
  {name} AS (SELECT v.*, {value} AS value FROM {name}_vector v, {cov}),
  {name}_rest AS (SELECT {", ".join(f"m{i}{j} - value * v{i} * v{j} AS m{i}{j}" for i in _P5 for j in _P5)} FROM {name}, {cov})"""


_PCA_ROWS = " UNION ALL ".join(f"SELECT {k} AS component, value, v.f AS feature, v.x AS loading FROM pc{k}, LATERAL (VALUES "
                               + ", ".join(f"('{f}', v{i})" for i, f in enumerate(_PX)) + ") v(f, x)" for k in (1, 2, 3))
SQL["feat_pca"] = f"""WITH RECURSIVE m AS ({MODEL}),
  filled AS (SELECT {", ".join(f"coalesce({f}, (SELECT avg({f}) FROM m)) AS {f}" for f in _PX)} FROM m),
  st AS (SELECT {", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in _PX)} FROM filled),
  z AS (SELECT {", ".join(f"({f} - a_{f}) / s_{f} AS x{i}" for i, f in enumerate(_PX))} FROM filled, st),
  cov AS (SELECT {", ".join(f"covar_samp(x{i}, x{j}) AS m{i}{j}" for i in _P5 for j in _P5)} FROM z),
  {_strongest("cov", "pc1")}, {_strongest("pc1_rest", "pc2")}, {_strongest("pc2_rest", "pc3")},
  r AS ({_PCA_ROWS}), t AS (SELECT {" + ".join(f"m{i}{i}" for i in _P5)} AS trace FROM cov),
  c AS (SELECT component, value / trace AS explained_ratio, sum(value / trace) OVER (ORDER BY component) AS cumulative
        FROM (SELECT DISTINCT component, value FROM r), t)
  SELECT component, round(explained_ratio, 6) AS explained_ratio, round(cumulative, 6) AS cumulative, feature, round(loading, 6) AS loading,
         row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature)::INTEGER AS place
  FROM r JOIN c USING (component)"""
