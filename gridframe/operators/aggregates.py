"""Grouped statistics.

Every aggregate here is a Spark declarative or typed aggregate that combines
map-side (partial aggregation), so a key holding a third of all rows is folded
in every map task before the shuffle instead of gathering in one reducer.
Exact quantiles come from radix selection (``selection.py``), whose buffers
don't grow with the values of a group; only the daily profile's median merges a
day's values.  Each percentile operator takes ``approx=True`` to switch to the
mergeable ``percentile_approx`` sketch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def pct(c, p, approx: bool = False, accuracy: int = 10000) -> Column:
    """Exact linear-interpolated percentile (pandas ``quantile``), or the sketch."""
    if approx:
        return F.percentile_approx(_c(c), p, accuracy)
    return F.percentile(_c(c), p)


def skew_corrected(c) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``.skew()``); NULL for n < 3
    or a constant column.  Spark's ``skewness`` is the biased g1 (scipy)."""
    n = F.count(_c(c)).cast("double")
    g1 = F.skewness(_c(c))
    return F.when((n >= 3) & (F.var_pop(_c(c)) > 0),
                  g1 * F.sqrt(n * (n - 1)) / (n - 2))


def skew_biased(c) -> Column:
    n = F.count(_c(c))
    return F.when((n >= 1) & (F.var_pop(_c(c)) > 0), F.skewness(_c(c)))


def agg_daily_stats(df: DataFrame, keys: Sequence[str], value: str, names: Mapping[str, str] | None = None,
                    ticks: Sequence[str] = (), keyed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """mean / sample std / min / max of ``value`` per key (std NULL for n = 1).

    Keys that are costly to compute from a few columns: rows are combined by those
    columns (``ticks``) first, and ``keyed`` gives the combined rows their keys (it
    may drop some), so that it runs once per different tick, not once per row."""
    names = dict(names or {})
    if keyed is not None:
        v, day = _c(value), Window.partitionBy(*keys)
        parts = keyed(df.groupBy(*ticks).agg(F.count(v).alias("__n"), F.sum(v).alias("__s"), F.var_pop(v).alias("__v"),
                                             F.min(v).alias("__lo"), F.max(v).alias("__hi")))
        # squares around the key's mean: those inside a tick and those of the ticks' means
        mean = F.try_divide(F.sum("__s").over(day), F.sum("__n").over(day))
        off = F.try_divide("__s", "__n") - F.col("__mean")
        parts = parts.withColumn("__mean", mean).withColumn("__sq", F.col("__n") * (F.col("__v") + off * off))
        n = F.sum("__n")
        return parts.groupBy(*keys).agg(
            F.try_divide(F.sum("__s"), n).alias(names.get("mean", "mean")),
            F.when(n > 1, F.sqrt(F.try_divide(F.sum("__sq"), n - 1))).alias(names.get("std", "std")),
            F.min("__lo").alias(names.get("min", "min")),
            F.max("__hi").alias(names.get("max", "max")))
    return df.groupBy(*keys).agg(
        F.avg(value).alias(names.get("mean", "mean")),
        F.stddev_samp(value).alias(names.get("std", "std")),
        F.min(value).alias(names.get("min", "min")),
        F.max(value).alias(names.get("max", "max")))


def agg_daily_stats_ext(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                        approx: bool = False) -> DataFrame:
    """Eleven-statistic profile: mean, std, min, max, var, range, median,
    first, last (by ``order``, the row order of the source), count and
    bias-corrected skew."""
    v = _c(value)
    by = F.struct(*[_c(o) for o in order])
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.var_samp(v).alias("var"), (F.max(v) - F.min(v)).alias("range"),
        pct(v, 0.5, approx).alias("median"),
        F.min_by(v, by).alias("first"),
        F.max_by(v, by).alias("last"),
        F.count(v).alias("count"),
        skew_corrected(v).alias("skew"))


def agg_sum_by_keys(df: DataFrame, keys: Sequence[str], values: Sequence[str] | str,
                    out: Mapping[str, str] | None = None) -> DataFrame:
    """pandas ``groupby().sum()``: an all-NULL group sums to 0, not NULL."""
    values = [values] if isinstance(values, str) else list(values)
    out = dict(out or {})
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(_c(v)), F.lit(0)).alias(out.get(v, v))
                                   for v in values])


def agg_sum_mean(df: DataFrame, keys: Sequence[str], value: str,
                 sum_name: str = "sum", mean_name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(_c(value)), F.lit(0)).alias(sum_name),
                                 F.avg(_c(value)).alias(mean_name))


def agg_sum_mean_std_peak(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = _c(value)
    return df.groupBy(*keys).agg(F.coalesce(F.sum(v), F.lit(0)).alias("sum"), F.avg(v).alias("mean"),
                                 F.stddev_samp(v).alias("std"), F.max(v).alias("peak"))


CALENDAR_PARTS = {
    "hour": lambda c: F.hour(c),
    "weekday": lambda c: F.weekday(c),
    "dayofyear": lambda c: F.dayofyear(c),
    "month": lambda c: F.month(c),
    "year": lambda c: F.year(c),
    "day": lambda c: F.dayofmonth(c),
}


def agg_by_calendar(df: DataFrame, ts: str, parts: Sequence[str], value: str,
                    extra_keys: Sequence[str] = (), how: Sequence[str] = ("mean",)) -> DataFrame:
    """Mean / sum of ``value`` by calendar parts of ``ts`` (and extra keys)."""
    keys = [CALENDAR_PARTS[p](_c(ts)).alias(p) for p in parts] + [_c(k) for k in extra_keys]
    fns = {"mean": F.avg, "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "count": F.count,
           "std": F.stddev_samp}
    return df.groupBy(*keys).agg(*[fns[h](_c(value)).alias(h) for h in how])


def agg_group_mean_sd(df: DataFrame, keys: Sequence[Column | str], value: str) -> DataFrame:
    """Mean and the ``mean ± sd`` band per group."""
    v = _c(value)
    return (df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
              .withColumn("lower", F.col("mean") - F.col("sd"))
              .withColumn("upper", F.col("mean") + F.col("sd")))


def row_mean(columns: Sequence[str]) -> Column:
    """Row-wise mean skipping NULLs (NULL when all are NULL)."""
    s = sum((F.coalesce(_c(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((F.when(_c(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return F.when(n > 0, s / n)


def agg_by_year_cols(df: DataFrame, ts: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per year: sum of each column group and mean of the group's row-wise means."""
    cols = []
    for name, members in groups.items():
        rm = row_mean(members)
        total = sum((F.coalesce(_c(c), F.lit(0.0)) for c in members), F.lit(0.0))
        cols += [F.sum(total).alias(f"{name}_sum"), F.avg(rm).alias(f"{name}_mean")]
    return df.groupBy(F.year(_c(ts)).alias("year")).agg(*cols)


def agg_last_vintage(df: DataFrame, keys: Sequence[str], issue: str, valid: str,
                     tiebreak: Sequence[str] = (), values: Sequence[str] | None = None,
                     skip_nulls: bool = False) -> DataFrame:
    """Latest forecast per ``keys`` among rows with ``issue <= valid``.

    Default: the whole latest row by (issue, tie-break) via ``max_by`` (a
    mergeable aggregate).  ``skip_nulls=True`` reproduces pandas
    ``groupby().last()``: the last non-null value per column."""
    values = list(values) if values is not None else \
        [c for c in df.columns if c not in keys]
    # The values themselves close the order, so exact duplicates of the
    # tie-break keys still give one deterministic row.
    order = F.struct(_c(issue), *[_c(t) for t in tiebreak],
                     *[_c(v) for v in values if v not in tiebreak and v != issue])
    base = df.where(_c(issue) <= _c(valid))
    if skip_nulls:
        aggs = [F.max_by(_c(v), F.when(_c(v).isNotNull(), order)).alias(v) for v in values]
    else:
        aggs = [F.max_by(_c(v), order).alias(v) for v in values]
    return base.groupBy(*keys).agg(*aggs)


DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
QUARTILES = [0.25, 0.5, 0.75]


def agg_describe(df: DataFrame, columns: Sequence[str], group: Sequence[str] = (),
                 approx: bool = False) -> DataFrame:
    """pandas ``describe()`` in long form: (group..., column, stat, value).

    The quartiles are found by radix selection and joined to the moments, which
    are one grouped pass."""
    aggs = []
    for i, c in enumerate(columns):
        v = _c(c).cast("double")
        aggs += [F.count(v).cast("double").alias(f"c{i}_count"), F.avg(v).alias(f"c{i}_mean"),
                 F.stddev_samp(v).alias(f"c{i}_std"), F.min(v).alias(f"c{i}_min"), F.max(v).alias(f"c{i}_max")]
        if approx:
            aggs.append(pct(v, QUARTILES, True).alias(f"c{i}_q"))
    wide = df.groupBy(*group).agg(*aggs)
    if not approx:
        from .selection import exact_quantiles
        names = [f"__g{i}" for i in range(len(group))]
        q = exact_quantiles(df, columns, QUARTILES, group)
        # one row per group: an array of quartiles for each column
        q = q.groupBy(*[_c(g).alias(n) for g, n in zip(group, names)]).agg(
            *[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"c{i}_q") for i, c in enumerate(columns)])
        on = [_c(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)]
        wide = wide.join(q, on, "left") if on else wide.crossJoin(F.broadcast(q))  # without groups: one row each
    rows = []
    for i, c in enumerate(columns):
        vals = [F.col(f"c{i}_count"), F.col(f"c{i}_mean"), F.col(f"c{i}_std"), F.col(f"c{i}_min"),
                F.col(f"c{i}_q")[0], F.col(f"c{i}_q")[1], F.col(f"c{i}_q")[2], F.col(f"c{i}_max")]
        rows += [F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), x.alias("value"))
                 for s, x in zip(DESCRIBE_STATS, vals)]
    return wide.select(*group, F.explode(F.array(*rows)).alias("r")).select(*group, "r.*")


def agg_missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column: (column, missing, missing_pct)."""
    cols = list(columns) if columns is not None else df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.sum(F.when(_c(c).isNull(), 1).otherwise(0)).alias(f"m{i}")
                    for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("long").alias("missing"))
            for i, c in enumerate(cols)]
    return (wide.select("__n", F.explode(F.array(*rows)).alias("r"))
                .select("r.column", "r.missing",
                        F.try_divide(F.col("r.missing") * 100.0, F.col("__n")).alias("missing_pct")))


def agg_value_counts(df: DataFrame, keys: Sequence[Column | str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def agg_distinct(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values plus min and max (``nunique``, range)."""
    v = _c(column)
    return df.agg(F.count_distinct(v).alias("n_unique"), F.min(v).alias("min"), F.max(v).alias("max"))


def agg_skewness(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Both skew definitions per column plus a sign label."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [skew_biased(c).alias(f"b{i}"), skew_corrected(c).alias(f"u{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("skew_biased"),
                     F.col(f"u{i}").alias("skew_corrected")) for i, c in enumerate(columns)]
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    s = F.col("skew_corrected")
    return long.withColumn("label", F.when(s > threshold, "right-skewed")
                                     .when(s < -threshold, "left-skewed")
                                     .when(s.isNotNull(), "symmetric"))


def agg_corr(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with ``target`` (pairwise-complete)."""
    wide = df.agg(*[F.corr(_c(c).cast("double"), _c(target).cast("double")).alias(f"r{i}")
                    for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("corr"))
            for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def agg_corr_grouped(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns, per group, in long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.groupBy(*group).agg(*[F.corr(_c(a), _c(b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{k}").alias("corr"))
            for k, (a, b) in enumerate(pairs)]
    return wide.select(*group, F.explode(F.array(*rows)).alias("r")).select(*group, "r.*")


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy-style equal-width bin, 1..bins; the maximum goes into the last bin."""
    raw = F.floor((x - lo) / (hi - lo) * F.lit(bins)).cast("long") + 1
    return F.when(hi == lo, F.lit(1).cast("long")).otherwise(F.least(raw, F.lit(bins).cast("long")))


def agg_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Fixed-bin histogram over [min, max]: (bin, bin_lo, bin_hi, count).

    The range is one tiny aggregate fetched to the driver (two numbers), then
    the binning is a single map-side-combined ``groupBy``."""
    v = _c(column).cast("double")
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin long, bin_lo double, bin_hi double, count long")
    lo, hi = F.lit(float(r["lo"])), F.lit(float(r["hi"]))
    counted = (df.where(v.isNotNull())
                 .groupBy(bin_index(v, lo, hi, bins).alias("bin"))
                 .agg(F.count(F.lit(1)).alias("count")))
    width = (hi - lo) / F.lit(bins)
    return counted.select("bin", (lo + (F.col("bin") - 1) * width).alias("bin_lo"),
                          (lo + F.col("bin") * width).alias("bin_hi"), "count")


def agg_box_stats(df: DataFrame, group: Sequence[str], value: str,
                  approx: bool = False) -> DataFrame:
    """Quartiles, Tukey whiskers (extreme points inside 1.5 IQR) and outlier
    count per group (a null key is a group too).  The quartiles come from radix
    selection; one more pass joins the fences back by group key."""
    names = list(group)
    base = df.select(*[_c(g) for g in names], _c(value).cast("double").alias("__v")) \
             .where(F.col("__v").isNotNull())
    if approx:
        q = base.groupBy(*names).agg(pct("__v", QUARTILES, True).alias("__q"))
    else:
        from .selection import exact_quantiles
        q = exact_quantiles(base, ["__v"], QUARTILES, names).withColumnRenamed("q", "__q")
    keys = [f"__g{i}" for i in range(len(names))]
    q = q.select(*[_c(g).alias(k) for g, k in zip(names, keys)], F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
                 F.col("__q")[2].alias("q3"))
    q = q.withColumn("__lf", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("__uf", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # one row per group: materialised once, broadcast after a bounded size
    # check, else a shuffle join (AQE splits a hot group's partition)
    from .joins import materialized_small_side
    j = base.join(materialized_small_side(q), [_c(g).eqNullSafe(F.col(k)) for g, k in zip(names, keys)])
    inside = (F.col("__v") >= F.col("__lf")) & (F.col("__v") <= F.col("__uf"))
    return j.groupBy(*names, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


KERNEL_REACH = 8.8  # bandwidths; beyond them the Gaussian kernel is below 2e-17


def agg_kde(df: DataFrame, column: str, gridsize: int = 200, cut: float = 3.0,
            binned: int | None = None) -> DataFrame:
    """Gaussian KDE on an even grid (Scott bandwidth, like ``gaussian_kde``).

    A row adds to the grid points within ``KERNEL_REACH`` bandwidths of it, found
    by index arithmetic; the kernel sum of a grid point so leaves out less than 2e-17 per row, which is
    below the rounding of the sum.  The points are expanded with ``posexplode``
    inside the scan stage and summed per grid index with map-side partial
    aggregation, so only ``gridsize`` rows per task cross the shuffle.

    ``binned=B``: rows are first counted into B equal-width bins (one
    aggregation over the data), and the kernel sums run over the B weighted
    bin centres, so the per-row work is a single bin index; the density error
    is bounded by the bin width relative to the bandwidth."""
    v = _c(column).cast("double")
    st = (df.where(v.isNotNull())
            .agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"),
                 F.min(v).alias("mn"), F.max(v).alias("mx")).first())
    if not st["n"] or st["n"] < 2 or not st["sd"]:
        return df.sparkSession.createDataFrame([], "grid int, x double, density double")
    n = int(st["n"])
    h = float(st["sd"]) * n ** -0.2
    g0 = float(st["mn"]) - cut * h
    step = (float(st["mx"]) - float(st["mn"]) + 2 * cut * h) / (gridsize - 1)
    if binned:
        lo, hi = float(st["mn"]), float(st["mx"])
        width = (hi - lo) / binned
        b = bin_index(v, F.lit(lo), F.lit(hi), binned)
        pts = (df.where(v.isNotNull()).groupBy(b.alias("__b")).agg(F.count(F.lit(1)).cast("double").alias("__w"))
                 .select((F.lit(lo) + (F.col("__b") - 0.5) * F.lit(width)).alias("__x"), "__w"))
    else:
        pts = df.where(v.isNotNull()).select(v.alias("__x"), F.lit(1.0).alias("__w"))
    exploded = kernel_terms(pts, g0, step, gridsize, h)
    sums = exploded.groupBy("grid").agg(F.sum("__k").alias("__s"))
    # a grid point that no row reaches has density 0
    out = df.sparkSession.range(gridsize).select(F.col("id").cast("int").alias("grid")).join(F.broadcast(sums), "grid", "left")
    return out.select("grid", (F.lit(g0) + F.col("grid") * F.lit(step)).alias("x"),
                      (F.coalesce("__s", F.lit(0.0)) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))


def kernel_terms(pts: DataFrame, g0: float, step: float, gridsize: int, h: float) -> DataFrame:
    """(grid, __k): for weighted points (__x, __w), their kernel values at the grid points in reach."""
    x, last = F.col("__x"), gridsize - 1
    first = F.greatest(F.ceil((x - g0 - KERNEL_REACH * h) / step), F.lit(0)).cast("int")
    end = F.least(F.floor((x - g0 + KERNEL_REACH * h) / step), F.lit(last)).cast("int")
    placed = pts.select("__x", "__w", F.when(first <= end, F.sequence(first, end)).alias("__at"))
    terms = F.transform("__at", lambda i: F.struct(i.alias("grid"), (F.col("__w") * F.exp(F.lit(-0.5) * F.pow(
        (F.lit(g0) + i * F.lit(step) - x) / F.lit(h), 2))).alias("__k")))
    return placed.select(F.explode(terms).alias("t")).select("t.*")


def join_agg_back(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Group mean attached to every row.  Computed as a partial aggregate joined
    back on the keys (not a window, which would gather a hot key in one task)."""
    from .joins import materialized_small_side
    means = df.groupBy(*keys).agg(F.avg(_c(value)).alias(name))
    return df.join(materialized_small_side(means), list(keys), "left")
