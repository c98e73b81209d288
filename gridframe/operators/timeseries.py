"""Window and time-series operators.

Windows are always partitioned by a key whose partitions are bounded by the
calendar (one row per day and region after aggregation) or replaced by the
two-phase global forms of :mod:`gridframe.operators.ordered`.  Calendar spines
are generated with ``explode(sequence(...))`` from one aggregate row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .joins import materialized_small_side


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def win_lag(df: DataFrame, order: Sequence[str], column: str, lags: Sequence[int] = (7, 30),
            prefix: str | None = None) -> DataFrame:
    """Row-offset lags (``shift(n)``) along a global order."""
    return ordered.row_lags(df, order, column, lags, prefix)


def win_lead_group(df: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """Next ``order`` value within each group (``groupby().shift(-1)``)."""
    return df.withColumn(name, F.lead(_c(order)).over(Window.partitionBy(*group).orderBy(_c(order))))


def win_rolling(df: DataFrame, order: Sequence[str], column: str, size: int | None,
                aggs: dict) -> DataFrame:
    """Trailing rolling statistics; see :func:`ordered.rolling`."""
    return ordered.rolling(df, order, column, size, aggs)


def fill_with_group_mean(df: DataFrame, column: str, key: Column | str, key_name: str = "__g") -> DataFrame:
    """Fill NULLs with the mean of the same group (e.g. the same hour).

    The means are a partial aggregate with one row per group value,
    materialised once and broadcast back after a size check; no window
    gathers a hot group."""
    k = _c(key)
    base = df.withColumn(key_name, k)
    means = base.groupBy(key_name).agg(F.avg(_c(column)).alias("__m"))
    out = base.join(materialized_small_side(means), key_name, "left")
    return out.withColumn(column, F.coalesce(_c(column), F.col("__m"))).drop("__m", key_name)


def ts_ffill_bfill(df: DataFrame, order: Sequence[str], columns: Sequence[str],
                   method: str = "ffill") -> DataFrame:
    """``ffill``, ``bfill`` or ``ffill`` then ``bfill`` along a global order."""
    if method == "ffill":
        return ordered.forward_fill(df, order, columns)
    if method == "bfill":
        return ordered.forward_fill(df, order, columns, backward=True)
    if method == "ffill_bfill":
        return ordered.fill(df, order, both=columns)
    raise ValueError(f"Invalid fill method: {method}")


def calendar_spine(df: DataFrame, date: str, name: str = "DateTime") -> DataFrame:
    """Every day between the minimum and maximum of ``date``."""
    d = _c(date).cast("date")
    return (df.agg(F.min(d).alias("__lo"), F.max(d).alias("__hi"))
              .where(F.col("__lo").isNotNull())
              .select(F.explode(F.sequence("__lo", "__hi")).alias(name)))


def missing_dates(df: DataFrame, date: str, name: str = "DateTime") -> DataFrame:
    """Days of the spine that have no row in ``df``, with weekday columns."""
    spine = calendar_spine(df, date, name)
    present = df.select(_c(date).cast("date").alias(name)).distinct()
    gaps = spine.join(present, name, "left_anti")
    return gaps.select(name, F.weekday(name).alias("weekday"),
                       F.date_format(name, "EEEE").alias("day_name"))


def missing_flags(df: DataFrame, date: str, name: str = "DateTime") -> DataFrame:
    """Spine with ``is_missing`` per day."""
    spine = calendar_spine(df, date, name)
    present = df.select(_c(date).cast("date").alias(name)).distinct().withColumn("__p", F.lit(True))
    return (spine.join(present, name, "left")
                 .select(name, F.col("__p").isNull().alias("is_missing")))


def resample_daily_sum(df: DataFrame, group: str, ts: str, value: str, name: str = "DateTime") -> DataFrame:
    """``groupby(group).resample('D').sum()``: days without rows inside each
    group's own span get 0.  The per-group spine comes from one min/max row
    per group."""
    d = _c(ts).cast("date")
    sums = df.groupBy(_c(group).alias(group), d.alias(name)).agg(
        F.coalesce(F.sum(_c(value)), F.lit(0)).alias(value))
    spans = sums.groupBy(group).agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"))
    spine = spans.select(group, F.explode(F.sequence("__lo", "__hi")).alias(name))
    return (spine.join(sums, [group, name], "left")
                 .withColumn(value, F.coalesce(_c(value), F.lit(0))))


def expand_period(df: DataFrame, *, group: Sequence[str], start: str, value: str,
                  out_value: str = "DailyValue", day: str = "DateTime",
                  last_period_days: int = 7, last_expand_days: int = 1,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Spread each period total evenly over the days until the next period of
    the same group: value / days, one row per day.  The last period of a group
    is divided by ``last_period_days`` but expanded over ``last_expand_days``
    (the source's behaviour: 7 and 1)."""
    w = Window.partitionBy(*group).orderBy(_c(start))
    s = _c(start).cast("date")
    nxt = F.lead(s).over(w)
    with_next = df.withColumn("__next", nxt)
    days = F.coalesce(F.datediff("__next", s), F.lit(last_period_days))
    end = F.coalesce(F.col("__next"), F.date_add(s, last_expand_days))
    return with_next.select(*[_c(g) for g in group], *[_c(k) for k in keep],
                            F.explode(F.sequence(s, F.date_sub(end, 1))).alias(day),
                            (_c(value) / days).alias(out_value))


def forecast_lead_filter(df: DataFrame, issue: str, valid: str, days: int = 1) -> DataFrame:
    return df.where(F.datediff(_c(valid), _c(issue)) == days)


def sliding_sequences(df: DataFrame, order: Sequence[str], features: Sequence[str],
                      target: str, steps: int = 7) -> DataFrame:
    """For every row t with ``steps`` predecessors: the array of the previous
    ``steps`` feature rows and the target of row t.  A window over sorted
    partitions with a halo of ``steps`` rows; no row is copied but the halos."""
    rows = ordered.with_halo(df, order, steps)
    w = Window.partitionBy(ordered.PID).orderBy(ordered.ROW).rowsBetween(-steps, -1)
    seqs = rows.withColumn("window", F.collect_list(F.struct(*[_c(f).alias(f) for f in features])).over(w))
    seqs = seqs.where(F.col(ordered.OWN) & (F.size("window") == steps))
    names = dict.fromkeys([*order, target])
    return seqs.select((F.col(ordered.ROW) + 1).alias("row_number"), *[_c(c).alias(c) for c in names], "window")


def tail_months(df: DataFrame, date: str, months: int = 2) -> DataFrame:
    """Rows in the last ``months`` months before the maximum date."""
    mx = df.agg(F.max(_c(date)).alias("m")).first()["m"]
    if mx is None:
        return df.limit(0)
    return df.where(_c(date) >= F.add_months(F.lit(mx).cast("date"), -months))


def head_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows by order (TakeOrderedAndProject, a top-k)."""
    return df.orderBy(*order).limit(n)


def tail_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[_c(o).desc() for o in order]).limit(n)


def date_slice(df: DataFrame, date: str, lo, hi) -> DataFrame:
    """Inclusive date slice ``df.loc[lo:hi]``."""
    return df.where(_c(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
