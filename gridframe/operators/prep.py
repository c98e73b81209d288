"""Leakage-aware feature preparation: splits, imputation, scaling, outliers,
power transforms and feature selection.

Fitted statistics are computed with one aggregate pass (a single row, brought
to the driver as a handful of numbers) and applied as column expressions, so
"fit on train, apply to all" never moves data through the driver.  Frames
keep a ``split`` column instead of being cut into six pieces.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .aggregates import pct
from .selection import _written, exact_quantiles, quantiles_of

SPLIT = "split"


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# ------------------------------------------------------------------ splits ---

def hash_unit(key) -> Column:
    """Portable deterministic value in [0, 1) from a key: the first 32 bits of
    ``md5(string(key))``.  The same expression exists in DuckDB, so splits are
    reproducible across engines and runs (numpy's shuffle order is not)."""
    h = F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("long")
    return h.cast("double") / F.lit(float(2 ** 32))


def split_random(df: DataFrame, key: str, fractions: Sequence[float] = (0.64, 0.16, 0.2),
                 labels: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Random split by a hash of ``key`` compared to cumulative cut points."""
    u = hash_unit(key)
    cuts = np.cumsum(fractions)
    expr = None
    for lab, cut in zip(labels[:-1], cuts[:-1]):
        expr = (F.when(u < F.lit(float(cut)), lab) if expr is None
                else expr.when(u < F.lit(float(cut)), lab))
    return df.withColumn(SPLIT, expr.otherwise(labels[-1]))


def split_chrono(df: DataFrame, order: Sequence[str], train_size: float = 0.64,
                 val_size: float = 0.16) -> DataFrame:
    """Ordered split: first ``int(n*train)`` rows train, next ``int(n*val)``
    validation, the rest test (``int`` truncation as in the source)."""
    numbered = ordered.global_row_number(df, order, "__rn")
    n = numbered.count()
    train_end = int(n * train_size)
    val_end = train_end + int(n * val_size)
    rn = F.col("__rn")
    return numbered.withColumn(
        SPLIT, F.when(rn <= train_end, "train").when(rn <= val_end, "validation").otherwise("test")
    ).drop("__rn")


def split_by_date(df: DataFrame, date: str, cut, before: str = "train", after: str = "test") -> DataFrame:
    return df.withColumn(SPLIT, F.when(_c(date) < F.lit(cut).cast("date"), before).otherwise(after))


def split_period_report(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(SPLIT).agg(F.min(_c(date)).alias("start"), F.max(_c(date)).alias("end"),
                                 F.count(F.lit(1)).alias("rows"))


def fold_assign(df: DataFrame, order: Sequence[str], k: int = 5, name: str = "fold") -> DataFrame:
    """Contiguous k folds (``KFold`` without shuffle): the first ``n % k``
    folds are one row longer."""
    numbered = ordered.global_row_number(df, order, "__rn")
    n = numbered.count()
    small, r = divmod(n, k)
    big = small + 1
    i = F.col("__rn") - 1
    fold = F.when(i < r * big, F.floor(i / big)).otherwise(
        F.lit(r) + F.floor((i - r * big) / max(small, 1)))
    return numbered.withColumn(name, fold.cast("int")).drop("__rn")


# -------------------------------------------------------------- imputation ---

def fit_impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean",
               by: str | None = None) -> DataFrame:
    """One row of fill values (per ``by`` group if given).  Medians come from
    radix selection; a group without values in any column has no row then."""
    if strategy == "mean":
        fn = lambda c: F.avg(_c(c))
    elif strategy == "median":
        q = exact_quantiles(df, columns, [0.5], [by] if by else [])
        fills = [F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"__fill{i}") for i, c in enumerate(columns)]
        return q.groupBy(*([by] if by else [])).agg(*fills)
    elif strategy in ("most_frequent", "mode"):
        # sklearn returns the smallest of tied modes
        fn = lambda c: F.mode(_c(c), deterministic=True)
    else:
        raise ValueError(f"impute by mean, median or mode, not by {strategy!r}")
    aggs = [fn(c).alias(f"__fill{i}") for i, c in enumerate(columns)]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean",
           fit_on: Column | None = None, fit_per_split: bool = False,
           order: Sequence[str] | None = None) -> DataFrame:
    """Fill NULLs.  ``mean``/``median``/``most_frequent`` use statistics fitted
    on the rows selected by ``fit_on`` (default: all rows), or per split with
    ``fit_per_split=True`` (the source's behaviour); ``ffill``/``bfill``
    follow ``order``."""
    columns = list(columns)
    if strategy in ("ffill", "bfill"):
        from .timeseries import ts_ffill_bfill
        if order is None:
            raise ValueError("ffill/bfill need an order")
        return ts_ffill_bfill(df, order, columns, strategy)
    if fit_per_split:
        stats = fit_impute(df, columns, strategy, by=SPLIT)
        j = df.join(F.broadcast(stats), SPLIT, "left")  # one row per split label
        return j.select(*[F.coalesce(_c(c), F.col(f"__fill{columns.index(c)}")).alias(c)
                          if c in columns else _c(c) for c in df.columns])
    src = df.where(fit_on) if fit_on is not None else df
    row = fit_impute(src, columns, strategy).first()
    fills = {c: row[f"__fill{i}"] for i, c in enumerate(columns)}
    return df.select(*[F.coalesce(_c(c), F.lit(fills[c])).alias(c)
                       if c in columns and fills[c] is not None else _c(c) for c in df.columns])


# ---------------------------------------------------------------- scaling ---

def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (sklearn ``StandardScaler``)."""
    row = df.agg(*[x for i, c in enumerate(columns) for x in
                   (F.avg(_c(c)).alias(f"m{i}"), F.stddev_pop(_c(c)).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def apply_standard(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std; a zero std divides by 1 (sklearn's ``scale_`` rule)."""
    def expr(c):
        m, s = stats[c]
        if m is None:
            return _c(c)
        s = 1.0 if (s is None or s == 0 or math.isnan(s)) else s
        return ((_c(c) - F.lit(m)) / F.lit(s)).alias(c)
    return df.select(*[expr(c) if c in stats else _c(c) for c in df.columns])


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[x for i, c in enumerate(columns) for x in
                   (F.min(_c(c)).alias(f"lo{i}"), F.max(_c(c)).alias(f"hi{i}"))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def apply_minmax(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - min) / (max - min); a zero range divides by 1 (sklearn), unlike
    ``ml.MinMaxScaler`` which maps a constant to 0.5."""
    def expr(c):
        lo, hi = stats[c]
        if lo is None:
            return _c(c)
        rng = float(hi) - float(lo)
        rng = 1.0 if rng == 0 else rng
        return ((_c(c) - F.lit(float(lo))) / F.lit(rng)).alias(c)
    return df.select(*[expr(c) if c in stats else _c(c) for c in df.columns])


def scale_per_split(df: DataFrame, columns: Sequence[str], strategy: str = "standard") -> DataFrame:
    """The source's ``transform_test_and_val_data``: every split is scaled with
    its own statistics (leaks nothing across splits but is not train-fitted).
    Statistics are one grouped pass with one row per split label, joined back
    with a broadcast (bounded by the number of splits)."""
    cols = list(columns)
    if strategy == "standard":
        st = df.groupBy(SPLIT).agg(*[x for i, c in enumerate(cols) for x in
                                     (F.avg(_c(c)).alias(f"__a{i}"), F.stddev_pop(_c(c)).alias(f"__b{i}"))])
        expr = lambda i, c: (_c(c) - F.col(f"__a{i}")) / F.when(
            F.coalesce(F.col(f"__b{i}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"__b{i}"))
    elif strategy == "minmax":
        st = df.groupBy(SPLIT).agg(*[x for i, c in enumerate(cols) for x in
                                     (F.min(_c(c)).alias(f"__a{i}"), F.max(_c(c)).alias(f"__b{i}"))])
        expr = lambda i, c: (_c(c) - F.col(f"__a{i}")) / F.when(
            F.col(f"__b{i}") == F.col(f"__a{i}"), F.lit(1.0)).otherwise(F.col(f"__b{i}") - F.col(f"__a{i}"))
    else:
        raise ValueError("a scaler is 'standard' or 'minmax'")
    j = df.join(F.broadcast(st), SPLIT, "left")
    return j.select(*[expr(cols.index(c), c).alias(c) if c in cols else _c(c) for c in df.columns])


def scale(df: DataFrame, columns: Sequence[str], strategy: str = "standard",
          fit_on: Column | None = None) -> tuple[DataFrame, dict]:
    src = df.where(fit_on) if fit_on is not None else df
    if strategy == "standard":
        st = fit_standard(src, columns)
        return apply_standard(df, st), st
    if strategy == "minmax":
        st = fit_minmax(src, columns)
        return apply_minmax(df, st), st
    raise ValueError("a scaler is 'standard' or 'minmax'")


def scale_inverse(df: DataFrame, column: str, mean: float, std: float, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, _c(column) * F.lit(std) + F.lit(mean))


def normalize_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) computed over the given (already filtered) frame."""
    st = fit_minmax(df, columns)
    out = df
    for c in columns:
        lo, hi = st[c]
        if lo is None:
            continue
        rng = float(hi) - float(lo)
        out = out.withColumn(c, (_c(c) - F.lit(float(lo))) / F.lit(rng) if rng else F.lit(0.0))
    return out


# ---------------------------------------------------------------- outliers ---

def outlier_quantile(df: DataFrame, target: str, percentage: float = 0.01,
                     approx: bool = False) -> DataFrame:
    """Keep rows strictly between the ``p`` and ``1-p`` quantiles of the target
    (NULL targets are dropped, as the comparisons are false in pandas)."""
    probs = [percentage, 1 - percentage]
    q = df.agg(pct(target, probs, True).alias("q")).first()["q"] if approx else quantiles_of(df, [target], probs).get(target)
    if q is None:
        return df.limit(0)
    return df.where((_c(target) > F.lit(q[0])) & (_c(target) < F.lit(q[1])))


def outlier_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5,
                approx: bool = False) -> DataFrame:
    """Drop a row if any column lies outside [Q1 - k IQR, Q3 + k IQR]; NULLs
    never count as outliers.  The quartiles of all columns come from the same
    radix passes (``approx``: from one sketch pass)."""
    if approx:
        quartiles = df.agg(*[pct(c, [0.25, 0.75], True).alias(c) for c in columns]).first().asDict()
    else:
        quartiles = quantiles_of(df, columns, [0.25, 0.75])
    bad = []
    for c in columns:
        q = quartiles.get(c)
        if q is None or q[0] is None:
            continue
        iqr = q[1] - q[0]
        lo, hi = q[0] - k * iqr, q[1] + k * iqr
        bad.append(F.coalesce((_c(c) < F.lit(lo)) | (_c(c) > F.lit(hi)), F.lit(False)))
    if not bad:
        return df
    anybad = bad[0]
    for b in bad[1:]:
        anybad = anybad | b
    return df.where(~anybad)


# ------------------------------------------------------- power transforms ---

def yeo_johnson_expr(c, lam: float) -> Column:
    """Yeo-Johnson transform of a column for a fixed lambda."""
    x = _c(c).cast("double")
    eps = 1e-12
    if abs(lam) > eps:
        pos = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    else:
        pos = F.log1p(x)
    if abs(lam - 2.0) > eps:
        neg = -(F.pow(-x + 1.0, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    else:
        neg = -F.log1p(-x)
    return F.when(x >= 0, pos).otherwise(neg)


def _yj_lambda_expr(x: Column, lam: Column) -> Column:
    """Yeo-Johnson of ``x`` for a lambda given as a column (grid search)."""
    eps = F.lit(1e-12)
    pos = F.when(F.abs(lam) > eps, (F.pow(x + 1.0, lam) - 1.0) / lam).otherwise(F.log1p(x))
    neg = F.when(F.abs(lam - 2.0) > eps, -(F.pow(-x + 1.0, 2.0 - lam) - 1.0) / (2.0 - lam)) \
           .otherwise(-F.log1p(-x))
    return F.when(x >= 0, pos).otherwise(neg)


def _yj_loglik_grid(df: DataFrame, columns: Sequence[str], grid: Mapping[str, Sequence[float]]) -> dict:
    """Profile log-likelihood for every (column, lambda) in one pass.

    Columns are stacked into (column index, value) rows and each row is
    expanded over its column's lambda grid with ``posexplode`` inside the scan
    stage; ``var_pop`` per (column, lambda) then combines map-side, so only
    (columns x grid points) partial rows per task are shuffled and the
    generated code stays small however many lambdas are tried."""
    cols = list(columns)
    stacked = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), _c(c).cast("double").alias("x"))
                                              for i, c in enumerate(cols)])).alias("s"))
                 .select("s.c", "s.x").where(F.col("x").isNotNull()))
    grids = F.array(*[F.array(*[F.lit(float(v)) for v in grid[c]]) for c in cols])
    psi = F.transform(F.element_at(grids, F.col("c") + 1), lambda lam: _yj_lambda_expr(F.col("x"), lam))
    var = (stacked.select("c", F.posexplode(psi).alias("j", "psi"))
                  .groupBy("c", "j").agg(F.var_pop("psi").alias("v")).collect())
    base = (stacked.groupBy("c").agg(F.count(F.lit(1)).alias("n"), (F.min("x") < F.max("x")).alias("varies"),
                                     F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("l")).collect())
    nl = {r["c"]: (r["n"], r["l"]) for r in base if r["varies"]}
    vv = {(r["c"], r["j"]): r["v"] for r in var}
    out = {}
    for i, c in enumerate(cols):
        n, slog = nl.get(i, (0, 0.0))
        lls = []
        for j, lam in enumerate(grid[c]):
            v = vv.get((i, j))
            lls.append(-math.inf if not n or not v or not 0 < v < math.inf else -n / 2.0 * math.log(v) + (lam - 1.0) * slog)
        out[c] = lls
    return out


# doublings of the lambda range before the likelihood counts as unbounded
MOST_WIDENINGS = 10


def fit_yeo_johnson(df: DataFrame, columns: Sequence[str], lo: float = -2.0, hi: float = 2.0,
                    points: int = 41, passes: int = 3) -> dict[str, float]:
    """MLE lambda per column by successive grid refinement of the profile
    log-likelihood: a grid over [lo, hi], moved outwards and doubled in width
    for the columns whose best point is at an end, then grids of the same size
    around the best point.  Each pass is one aggregate over the data for all
    columns together; three passes of 41 points resolve lambda to about 2.5e-4
    within [-2, 2].  A likelihood that rises without end is an error; a column
    without variance keeps ``lo``."""
    columns = list(columns)
    grid = {c: list(np.linspace(lo, hi, points)) for c in columns}
    best, open_ended = {}, set(columns)
    for _ in range(MOST_WIDENINGS):
        ll = _yj_loglik_grid(df, sorted(open_ended), {c: grid[c] for c in open_ended})
        for c in sorted(open_ended):
            j = int(np.argmax(ll[c]))
            best[c] = float(grid[c][j])
            width = grid[c][-1] - grid[c][0]
            step = width / (points - 1)
            if ll[c][j] == -math.inf or 0 < j < points - 1:
                open_ended.discard(c)
            elif j == 0:
                grid[c] = list(np.linspace(best[c] + step - 2 * width, best[c] + step, points))
            else:
                grid[c] = list(np.linspace(best[c] - step, best[c] - step + 2 * width, points))
        if not open_ended:
            break
    else:
        raise ValueError(f"no finite Yeo-Johnson lambda for {sorted(open_ended)}")
    step = {c: (grid[c][-1] - grid[c][0]) / (points - 1) for c in columns}
    finest = (hi - lo) / (points - 1) * (2 / (points - 1)) ** (passes - 1)
    while any(s > finest * 1.001 for s in step.values()):
        grid = {c: list(np.linspace(best[c] - step[c], best[c] + step[c], points)) for c in columns}
        ll = _yj_loglik_grid(df, columns, grid)
        best = {c: float(grid[c][int(np.argmax(ll[c]))]) if max(ll[c]) > -math.inf else best[c] for c in columns}
        step = {c: 2 * step[c] / (points - 1) for c in columns}
    return best


def power_yeo_johnson(df: DataFrame, columns: Sequence[str], lambdas: Mapping[str, float] | None = None,
                      standardize: bool = True, fit_on: Column | None = None,
                      shift: float = 0.0) -> tuple[DataFrame, dict]:
    """Yeo-Johnson with lambdas fitted on ``fit_on`` rows (default all), then
    standardised with the transformed training mean / population std.
    ``shift=1e-5`` reproduces the source, which fits on x but transforms
    x + 1e-5."""
    src = df.where(fit_on) if fit_on is not None else df
    lambdas = dict(lambdas) if lambdas is not None else fit_yeo_johnson(src, columns)
    out = df.select(*[yeo_johnson_expr(_c(c) + F.lit(shift) if shift else c, lambdas[c]).alias(c)
                      if c in lambdas else _c(c) for c in df.columns])
    if standardize:
        st = fit_standard(out.where(fit_on) if fit_on is not None else out, list(lambdas))
        out = apply_standard(out, st)
    return out, lambdas


# -------------------------------------------------------- feature selection --

def variance_by_column(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.var_pop(_c(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(columns)}


def variance_table(df: DataFrame, columns: Sequence[str], threshold: float = 0.0099) -> DataFrame:
    """(feature, variance, selected) with population variance, lazily."""
    wide = df.agg(*[F.var_pop(_c(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("selected", F.coalesce(F.col("variance") > F.lit(threshold), F.lit(False)))


def feat_variance_threshold(df: DataFrame, columns: Sequence[str], threshold: float = 0.0099,
                            fit_on: Column | None = None) -> list[str]:
    """Columns whose population variance exceeds ``threshold``."""
    src = df.where(fit_on) if fit_on is not None else df
    v = variance_by_column(src, columns)
    return [c for c in columns if v[c] is not None and v[c] > threshold]


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F statistic of each column across the classes of ``label``
    (sklearn ``f_classif``; null labels take no part): F = (SSB/(k-1)) / (SSW/(n-k)).

    Per class, count, mean and sum of squared deviations; SSB is the weighted
    squared deviation of the class means, from moments that merge pairwise (each
    class counts its size in ``n * (mean - centre)`` sums around a fixed centre, the
    mean of all rows), so classes may be as many as rows: no list of them is ever built."""
    base = df.where(_c(label).isNotNull())
    per = base.groupBy(_c(label).alias("__k")).agg(*[x for i, c in enumerate(columns) for x in (
        F.count(_c(c)).alias(f"n{i}"), F.avg(_c(c)).alias(f"m{i}"), (F.var_pop(_c(c)) * F.count(_c(c))).alias(f"w{i}"))])
    # one row per class and column; the classes' moments are summed once around the
    # grand mean, which is itself an aggregate of the classes
    cells = per.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"w{i}").alias("w"))
                                           for i in range(len(columns))])).alias("r")).select("r.*").where("n > 0")
    cells = _written(cells, "anova")
    grand = cells.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    d = F.col("m") - F.col("g")
    # one row per column on the right
    tot = cells.join(F.broadcast(grand), "i").groupBy("i").agg(
        F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("w").alias("ssw"),
        F.sum(F.col("n") * d * d).alias("b"), F.sum(F.col("n") * d).alias("r"))
    ssb = F.col("b") - F.col("r") * F.col("r") / F.col("n")
    f = F.try_divide(F.try_divide(ssb, F.col("k") - 1), F.try_divide("ssw", F.col("n") - F.col("k")))
    names = F.array(*[F.lit(c) for c in columns])
    return tot.select(F.get(names, F.col("i")).alias("feature"), f.alias("f_score"))


def quantile_bucket(df: DataFrame, column: str, k: int, name: str, approx: bool = False) -> DataFrame:
    """Class label 0..k-1 from the k-quantiles of a continuous column (the
    source fed every distinct price to ``f_classif`` as its own class).  The
    k-1 cut points come from radix selection; the label is the number of cut
    points below the value (no global window)."""
    probs = [i / k for i in range(1, k)]
    cuts = (df.agg(pct(column, probs, True).alias("q")).first()["q"] if approx else quantiles_of(df, [column], probs).get(column)) or []
    x = _c(column)
    label = sum((F.when(x > F.lit(float(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    return df.withColumn(name, F.when(x.isNotNull(), label))


def feat_select_kbest_f(df: DataFrame, columns: Sequence[str], label: str, k: int = 30) -> DataFrame:
    f = anova_f(df, columns, label)
    return f.orderBy(F.col("f_score").desc_nulls_last(), "feature").limit(k)


def _gram_aggs(p: int) -> list:
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    aggs += [F.sum(f"x{i}").alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy{i}") for i in range(p)]
    aggs += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)]
    return aggs


def _gram_base(df: DataFrame, cols: Sequence[str], target: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*[_c(e) for e in extra],
                     *[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                     _c(target).cast("double").alias("y")).na.drop(subset=[f"x{i}" for i in range(len(cols))] + ["y"])


def gram(df: DataFrame, columns: Sequence[str], target: str) -> dict:
    """n, sums, XᵀX and Xᵀy in one aggregate pass (rows with NULLs skipped)."""
    cols = list(columns)
    row = _gram_base(df, cols, target).agg(*_gram_aggs(len(cols))).first()
    return _gram_from_row(row, cols)


def gram_by(df: DataFrame, columns: Sequence[str], target: str, by: str) -> dict:
    """Gram statistics per value of ``by`` (e.g. per CV fold) in one grouped
    pass; the result has one small row per group."""
    cols = list(columns)
    rows = _gram_base(df, cols, target, [by]).groupBy(by).agg(*_gram_aggs(len(cols))).collect()
    return {r[by]: _gram_from_row(r, cols) for r in rows}


def _gram_from_row(row, cols: Sequence[str]) -> dict:
    p = len(cols)
    n = row["n"]
    xtx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = row[f"xx{i}_{j}"] or 0.0
    return {"n": n, "sx": np.array([row[f"s{i}"] or 0.0 for i in range(p)]), "sy": row["sy"] or 0.0,
            "syy": row["syy"] or 0.0, "xtx": xtx,
            "xty": np.array([row[f"xy{i}"] or 0.0 for i in range(p)]), "columns": cols}


def centered(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    n = g["n"]
    mx = g["sx"] / n
    my = g["sy"] / n
    cxx = g["xtx"] - n * np.outer(mx, mx)
    cxy = g["xty"] - n * mx * my
    return cxx, cxy, mx, my


def solve_ridge(g: dict, alpha: float = 0.0, idx: Sequence[int] | None = None) -> tuple[np.ndarray, float]:
    """Intercept-fitted (unpenalised) ridge/OLS from the Gram statistics."""
    cxx, cxy, mx, my = centered(g)
    idx = list(range(len(mx))) if idx is None else list(idx)
    a = cxx[np.ix_(idx, idx)] + alpha * np.eye(len(idx))
    coef = np.linalg.lstsq(a, cxy[idx], rcond=None)[0]
    return coef, float(my - mx[idx] @ coef)


def penalised_path(g: dict, alphas: Sequence[float], l1_ratio: float = 1.0, sweeps: int = 10_000, tol: float = 1e-13) -> list[tuple]:
    """Lasso and elastic net by coordinate descent on Gram statistics.

    Minimises ``|y - Xb|^2 / 2n + alpha l1_ratio |b|_1 + alpha (1 - l1_ratio) / 2 |b|^2``
    (sklearn's objective, intercept free).  A step needs one column of X'X only, so
    the data is read once for a whole path; alphas run from the greatest down,
    each started from the last one's coefficients, and the active set's equations
    are solved exactly at the end.  Returns (alpha, coefficients, intercept,
    violation) in the given order; ``violation`` is the largest deviation from the optimality
    conditions, as a share of the largest correlation."""
    cxx, cxy, mx, my = centered(g)
    n, p = g["n"], len(mx)
    out, b = {}, np.zeros(p)
    for alpha in sorted(set(alphas), reverse=True):
        l1, l2 = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
        for _ in range(sweeps):
            moved = 0.0
            for k in range(p):
                if cxx[k, k] + l2 <= 0:
                    continue
                rho = cxy[k] - cxx[k] @ b + cxx[k, k] * b[k]
                new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (cxx[k, k] + l2)
                moved = max(moved, abs(new - b[k]) * np.sqrt(cxx[k, k]))
                b[k] = new
            if moved <= tol * np.sqrt(max(g["syy"] - n * my * my, 1e-300)):
                break
        active = np.flatnonzero(b)
        if len(active):
            exact = np.linalg.lstsq(cxx[np.ix_(active, active)] + l2 * np.eye(len(active)), cxy[active] - l1 * np.sign(b[active]), rcond=None)[0]
            if (np.sign(exact) == np.sign(b[active])).all():
                b[active] = exact
        slope = cxy - cxx @ b - l2 * b
        wrong = np.where(b != 0, np.abs(slope - l1 * np.sign(b)), np.maximum(np.abs(slope) - l1, 0.0))
        out[alpha] = (float(alpha), b.copy(), float(my - mx @ b), float(wrong.max(initial=0.0) / max(np.abs(cxy).max(initial=0.0), 1e-300)))
    return [out[a] for a in alphas]


def feat_rfe_linear(df: DataFrame, columns: Sequence[str], target: str, n_select: int,
                    fit_on: Column | None = None) -> DataFrame:
    """Recursive feature elimination with linear regression: one distributed
    Gram pass, then the p refits are p x p solves on the driver.  Output:
    (feature, ranking, selected) like sklearn's ``ranking_`` / ``support_``."""
    src = df.where(fit_on) if fit_on is not None else df
    g = gram(src, columns, target)
    alive = list(range(len(columns)))
    ranking = {i: 1 for i in alive}
    rank = len(columns) - n_select + 1
    while len(alive) > n_select:
        coef, _ = solve_ridge(g, 0.0, alive)
        worst = alive[int(np.argmin(np.abs(coef)))]
        ranking[worst] = rank
        rank -= 1
        alive.remove(worst)
    rows = [(columns[i], int(ranking[i]), i in alive) for i in range(len(columns))]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean")


def feat_pca(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """PCA on centred columns with MLlib.  Returns (variance table, loadings):
    (component, explained_ratio, cumulative) and (component, feature, loading).
    Spark's PCA does not centre, so the mean is removed first (one pass)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    means = df.agg(*[F.avg(_c(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centred = df.select(*[(_c(c) - F.lit(means[f"m{i}"])).alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    vec = VectorAssembler(inputCols=[f"c{i}" for i in range(len(columns))], outputCol="v").transform(centred)
    model = PCA(k=k, inputCol="v", outputCol="pc").fit(vec)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    cum = list(np.cumsum(ev))
    spark = df.sparkSession
    var = spark.createDataFrame([(i + 1, ev[i], float(cum[i])) for i in range(k)],
                                "component int, explained_ratio double, cumulative double")
    pcm = model.pc.toArray()
    load = spark.createDataFrame([(j + 1, columns[i], float(pcm[i, j])) for j in range(k)
                                  for i in range(len(columns))],
                                 "component int, feature string, loading double")
    return var, load


def pca_report(variances: DataFrame, loadings: DataFrame) -> DataFrame:
    """(component, explained_ratio, cumulative, feature, loading, place): each
    component's sign is that its largest loading is positive, ``place`` ranks its features by absolute loading."""
    top = loadings.groupBy("component").agg(F.max_by("loading", F.struct(F.abs("loading"), F.col("feature"))).alias("__top"))
    signed = loadings.join(F.broadcast(top), "component")  # a row per component
    size = F.abs(F.col("loading"))
    w = Window.partitionBy("component").orderBy(size.desc(), "feature")  # a component's features: as many as columns
    signed = signed.select("component", "feature", (F.col("loading") * F.signum("__top")).alias("loading"), F.row_number().over(w).alias("place"))
    return variances.join(signed, "component")
