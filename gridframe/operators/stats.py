"""Distribution tests built from distributed aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove_scratch, write_scratch
from .selection import DIGIT_BITS, order_key


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# ------------------------------------------------- Kolmogorov-Smirnov -------

KS_BINS = 16          # bins refined in one pass, per column
KS_ROWS = 1 << 16     # rows that are fetched as values instead


def ks_statistics(df: DataFrame, columns: Sequence[str], cdfs: Mapping[str, Callable[[np.ndarray], np.ndarray]]) -> dict[str, tuple[float, int]]:
    """{column: (D, n)}: the largest distance between a column's distribution and its
    ``cdf``, D = max_i max(i/n - F(x_(i)), F(x_(i)) - (i-1)/n), without sorting.

    One pass counts all columns by the leading bits of an order-preserving key,
    with each bin's least and greatest value.  At those values the distance is
    known, and inside a bin it can't exceed what the bin's ranks and F at its two
    ends allow.  Only bins whose bound is above the best known distance are refined, the most
    promising first, by further bits of the key or, when few rows are left, by
    their values.  The driver holds counts of at most 2**16 bins per refined one."""
    narrow, folder = write_scratch(df.select(*[_c(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), "ks")
    cells = narrow.select(F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(columns))])).alias("c", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    cells = cells.select("c", (F.col("v") + F.lit(0.0)).alias("v"), order_key(F.col("v")).alias("k"))
    counted = [F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("greatest")]
    shift = 64 - DIGIT_BITS
    top: dict[int, list] = {}
    for r in cells.groupBy("c", F.shiftright("k", shift).alias("bin")).agg(*counted).collect():
        top.setdefault(r["c"], []).append((r["bin"], r["rows"], r["least"], r["greatest"]))
    n = {c: sum(b[1] for b in bins) for c, bins in top.items()}
    best = dict.fromkeys(top, 0.0)
    open_: list[tuple] = []  # (bound, column, shift, prefix, rows before, rows)

    def look(c: int, at: int, before: int, bins: list) -> None:
        bins = sorted(bins)
        rows = np.array([b[1] for b in bins], dtype=float)
        least, greatest = (cdfs[columns[c]](np.array([b[k] for b in bins])) for k in (2, 3))
        end = before + np.cumsum(rows)
        start = end - rows
        best[c] = max(best[c], float((end / n[c] - greatest).max()), float((least - start / n[c]).max()))
        bound = np.maximum(end / n[c] - least, greatest - start / n[c])
        for k, b in enumerate(bins):
            if b[2] < b[3]:
                open_.append((float(bound[k]), c, at, b[0], float(start[k]), b[1]))

    for c, bins in top.items():
        look(c, shift, 0, bins)
    while True:
        open_ = sorted((o for o in open_ if o[0] > best[o[1]]), key=lambda o: -o[0])
        if not open_:
            break
        if sum(o[5] for o in open_) <= KS_ROWS:
            go, open_ = open_, []
        else:
            at = open_[0][2]
            go = [o for o in open_ if o[2] == at][:KS_BINS]
            open_ = [o for o in open_ if o not in go]
        few = sum(o[5] for o in go) <= KS_ROWS
        for at in sorted({o[2] for o in go}):
            mine = {(o[1], o[3]): o for o in go if o[2] == at}
            wanted = F.broadcast(df.sparkSession.createDataFrame(list(mine), "c int, prefix long"))  # KS_BINS rows, or KS_ROWS in all
            inside = cells.withColumn("prefix", F.shiftright("k", at)).join(wanted, ["c", "prefix"])
            if few:
                values: dict[tuple, list] = {}
                for r in inside.select("c", "prefix", "v").collect():
                    values.setdefault((r["c"], r["prefix"]), []).append(r["v"])
                for key, v in values.items():
                    f = cdfs[columns[key[0]]](np.sort(np.array(v)))
                    rank = mine[key][4] + np.arange(1, len(v) + 1)
                    best[key[0]] = max(best[key[0]], float((rank / n[key[0]] - f).max()), float((f - (rank - 1) / n[key[0]]).max()))
            else:
                down = max(0, at - DIGIT_BITS)
                parts: dict[tuple, list] = {}
                for r in inside.groupBy("c", "prefix", F.shiftright("k", down).alias("bin")).agg(*counted).collect():
                    parts.setdefault((r["c"], r["prefix"]), []).append((r["bin"], r["rows"], r["least"], r["greatest"]))
                for key, bins in parts.items():
                    look(key[0], down, mine[key][4], bins)
    remove_scratch(df.sparkSession, folder)
    return {columns[c]: (best[c], n[c]) for c in top}


def normal_cdf(mean: float, std: float) -> Callable[[np.ndarray], np.ndarray]:
    erfc = np.frompyfunc(math.erfc, 1, 1)
    return lambda x: 0.5 * erfc((mean - x) / (std * math.sqrt(2.0))).astype(float)


def ks_p_value(d: float, n: int) -> float:
    """P(D_n >= d): exactly for up to 140 rows (powers of the Marsaglia-Tsang-Wang
    matrix), else Kolmogorov's limit with the usual correction of the argument."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n <= 140:
        k = int(n * d) + 1
        m, h = 2 * k - 1, k - n * d
        a = np.tri(m, k=1)
        for i in range(m):
            a[i, 0] -= h ** (i + 1)
            a[m - 1, i] -= h ** (m - i)
        a[m - 1, 0] += max(0.0, 2 * h - 1) ** m
        for i in range(m):
            for j in range(m):
                if i - j + 1 > 0:
                    a[i, j] /= math.factorial(i - j + 1)
        power = np.linalg.matrix_power(a, n)[k - 1, k - 1]
        return float(min(1.0, max(0.0, 1.0 - power * math.exp(math.lgamma(n + 1) - n * math.log(n)))))
    z = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if z < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101)))))


def test_ks_normal(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """KS test of each column against N(mean, sample std); ``normal`` when p > alpha.
    Moments of all columns come from one pass, their distances from the same branch-and-bound passes."""
    x = [_c(c).cast("double") for c in columns]
    x = [F.when(~F.isnan(v), v) for v in x]
    st = df.agg(*[a for i, v in enumerate(x) for a in (F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"))]).first()
    spread = {c: (st[f"m{i}"], st[f"s{i}"]) for i, c in enumerate(columns)}
    tested = [c for c in columns if spread[c][1]]
    found = ks_statistics(df, tested, {c: normal_cdf(*spread[c]) for c in tested}) if tested else {}
    rows = []
    for c in columns:
        d, n = found.get(c, (None, None))
        p = None if d is None else ks_p_value(d, n)
        rows.append((c, d, p, None if p is None else p > alpha))
    return df.sparkSession.createDataFrame(rows, "column string, statistic double, p_value double, normal boolean")


def test_normality_moments(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera from distributed moments (a moment test, not Shapiro-Wilk):
    JB = n/6 (S^2 + K^2/4) with biased skewness S and excess kurtosis K;
    p = exp(-JB/2) (chi-square, 2 degrees of freedom)."""
    aggs = []
    for i, c in enumerate(columns):
        x = _c(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"s{i}"), F.kurtosis(x).alias(f"k{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        n, s, k = F.col(f"n{i}").cast("double"), F.col(f"s{i}"), F.col(f"k{i}")
        jb = n / 6.0 * (s * s + k * k / 4.0)
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), s.alias("skew"),
                             k.alias("excess_kurtosis"), jb.alias("jb"), F.exp(-jb / 2.0).alias("p_value")))
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("normal", F.col("p_value") > F.lit(alpha))


def _weibull_sums(df: DataFrame, ks: Sequence[float], totals: dict | None = None) -> dict:
    """n, Σ ln u and, for every shape k of the grid, Σ uᵏ and Σ uᵏ ln u.  The
    grid is expanded with ``posexplode`` and summed per grid index (map-side
    combined), so the pass costs one small grouped aggregate.  ``totals``
    (n, Σ ln u) from an earlier pass are reused instead of recomputed."""
    arr = F.array(*[F.lit(float(k)) for k in ks])
    lu = F.log("__u")
    terms = F.transform(arr, lambda k: F.struct(F.pow(F.col("__u"), k).alias("a"),
                                                (F.pow(F.col("__u"), k) * lu).alias("b")))
    per = (df.select(F.posexplode(terms).alias("j", "t"))
             .groupBy("j").agg(F.sum("t.a").alias("a"), F.sum("t.b").alias("b")).collect())
    if totals is None:
        tot = df.agg(F.count(F.lit(1)).alias("n"), F.sum(lu).alias("sl")).first()
        totals = {"n": tot["n"], "sl": tot["sl"]}
    out = dict(totals)
    for r in per:
        out[f"a{r['j']}"] = r["a"]
        out[f"b{r['j']}"] = r["b"]
    return out


def fit_weibull(df: DataFrame, column: str) -> tuple[float, float, int]:
    """Two-parameter Weibull MLE (location fixed at 0).  NULLs take no part; a
    value that is not positive, or values that are all equal, are an error.

    The shape k solves  Σ uᵏ ln u / Σ uᵏ − 1/k − mean(ln u) = 0  with u = x/max(x)
    for stability; the root is bracketed on a log grid, moved until it holds
    the root, and refined on a fine
    grid, each a single aggregate pass.  Scale = max · (Σ uᵏ / n)^(1/k)."""
    x = _c(column).cast("double")
    least, mx = df.agg(F.min(x), F.max(x)).first()
    if mx is None or least <= 0 or least == mx or math.isnan(mx):
        raise ValueError(f"{column}: a Weibull fit needs positive values, not all equal")
    base = df.where(x.isNotNull()).select((x / F.lit(mx)).alias("__u"))

    def g(sums, j, k):
        return sums[f"b{j}"] / sums[f"a{j}"] - 1.0 / k - sums["sl"] / sums["n"]

    # g rises with k from minus to plus, so its sign says where the root lies
    lowest, highest = 0.02, 100.0
    while True:
        ks = list(np.geomspace(lowest, highest, 120))
        s1 = _weibull_sums(base, ks)
        vals = [g(s1, j, k) for j, k in enumerate(ks)]
        lo_i = next((j for j in range(len(ks) - 1) if vals[j] <= 0 <= vals[j + 1]), None)
        if lo_i is not None:
            break
        lowest, highest = (lowest / 5000, lowest) if vals[0] > 0 else (highest, highest * 5000)
        if not 1e-12 < lowest < 1e12:
            raise ValueError(f"{column}: no Weibull shape between 1e-12 and 1e12")
    ks2 = list(np.linspace(ks[lo_i], ks[lo_i + 1], 101))
    totals = {"n": s1["n"], "sl": s1["sl"]}
    s2 = _weibull_sums(base, ks2, totals)
    v2 = [g(s2, j, k) for j, k in enumerate(ks2)]
    j = next((j for j in range(len(ks2) - 1) if v2[j] <= 0 <= v2[j + 1]), int(np.argmin(np.abs(v2))))
    if j < len(ks2) - 1 and v2[j + 1] != v2[j]:
        k = ks2[j] - v2[j] * (ks2[j + 1] - ks2[j]) / (v2[j + 1] - v2[j])
    else:
        k = ks2[j]
    n = s2["n"]
    s3 = _weibull_sums(base, [k], totals)
    scale = mx * (s3["a0"] / n) ** (1.0 / k)
    return float(k), float(scale), int(n)


LOCATIONS = 24


def _located_sums(base: DataFrame, points: Sequence[tuple[float, float]]) -> dict[int, tuple]:
    """For each (distance of the location below the minimum, shape): n and the sums of ln u, u^k,
    u^k ln u and u^k (ln u)^2 with u = (x - location) / its greatest value.  Each
    task adds up its rows for all points, Arrow batch by batch, and hands on a row per point."""
    grid = [(float(d), float(k)) for d, k in points]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((4, len(grid)))
        for batch in batches:
            y = np.asarray(batch.column(0), dtype=float)
            n += len(y)
            for j, (d, k) in enumerate(grid):
                ln = np.log((y + d) / (1.0 + d))
                power = np.exp(k * ln)
                weighted = power * ln
                sums[:, j] += ln.sum(), power.sum(), weighted.sum(), (weighted * ln).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array([n] * len(grid), pa.int64()),
                                          *[pa.array(s) for s in sums]], names=["j", "n", *"labc"])

    rows = (base.select("__y").mapInArrow(add_up, "j int, n long, l double, a double, b double, c double").groupBy("j")
            .agg(*[F.sum(x).alias(x) for x in ("n", *"labc")]).collect())
    return {r["j"]: (r["n"], r["l"], r["a"], r["b"], r["c"]) for r in rows}


def _profile(base: DataFrame, distances: Sequence[float], span: float, start: float = 1.0, rounds: int = 40) -> list[tuple]:
    """(log-likelihood, distance, shape, scale) with the best shape and scale for each location.

    The shape solves  sum u^k ln u / sum u^k - 1/k - mean ln u = 0, whose left side rises
    with k: Newton steps inside a bracket, all locations in one aggregate a step."""
    m = len(distances)
    k, lo, hi = np.full(m, start), np.zeros(m), np.full(m, np.inf)
    for _ in range(rounds):
        sums = _located_sums(base, list(zip(distances, k)))
        n, sl, a, b, c = (np.array([sums[j][x] for j in range(m)], dtype=float) for x in range(5))
        g = b / a - 1 / k - sl / n
        slope = c / a - (b / a) ** 2 + 1 / k**2
        lo, hi = np.where(g <= 0, k, lo), np.where(g >= 0, k, hi)
        step = k - g / slope
        inside = (step > lo) & (step < hi)
        new = np.where(inside, step, np.where(np.isinf(hi), 2 * k, (lo + hi) / 2))
        if (np.abs(new - k) <= 1e-10 * k).all():
            break
        k = np.where(g == 0, k, new)
    out = []
    for j, d in enumerate(distances):
        top = span * (1 + d)  # the greatest x - location
        log_scale = math.log(top) + math.log(a[j] / n[j]) / k[j]
        total = n[j] * (math.log(k[j]) - k[j] * log_scale) + (k[j] - 1) * (sl[j] + n[j] * math.log(top)) - n[j]
        out.append((float(total), float(d), float(k[j]), float(math.exp(log_scale))))
    return out


def fit_weibull3(df: DataFrame, column: str, zooms: int = 5) -> dict:
    """Three-parameter Weibull by profile likelihood over the location.

    Locations are tried at geometric distances below the minimum (1e-4 to 100 times the
    range), all in one aggregate a step, and the neighbourhood of the best is
    searched again ``zooms`` times.  At distance 0 the likelihood has no bound
    when the shape is below 1, so such locations don't count; if the best one left is the
    nearest or the farthest of all, ``edge`` says so, as the likelihood then has no inner maximum.
    Returns shape, location, scale, n, loglik, edge; equal or missing values are an error."""
    x = _c(column).cast("double")
    x = F.when(~F.isnan(x), x)
    least, most, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if least is None or least == most or math.isinf(least) or math.isinf(most):
        raise ValueError(f"{column}: a Weibull fit needs finite values, not all equal")
    span = most - least
    base, folder = write_scratch(df.where(x.isNotNull()).select(((x - F.lit(least)) / F.lit(span)).alias("__y")), "weibull")
    distances, edge = np.geomspace(1e-4, 100.0, LOCATIONS), False
    best = None
    for zoom in range(zooms + 1):
        found = _profile(base, list(distances), span, best[2] if best else 1.0)
        fine = [f for f in found if f[2] >= 1.0]
        if not fine:  # no bounded likelihood: the farthest location has the greatest shape
            best, edge = max(found, key=lambda f: f[2]), True
            break
        here = max(fine, key=lambda f: f[0])
        best = here if best is None or here[0] >= best[0] else best
        at = int(np.argmin(np.abs(distances - best[1])))
        if zoom == 0:
            edge = best[1] in (fine[0][1], distances[-1])
        low, high = distances[max(0, at - 1)], distances[min(len(distances) - 1, at + 1)]
        if high - low <= 1e-9 * high:
            break
        distances = np.geomspace(low, high, 10)
    remove_scratch(df.sparkSession, folder)
    total, d, shape, scale = best
    return {"shape": shape, "location": least - d * span, "scale": scale, "n": int(n), "loglik": total, "edge": edge}


def weibull_cdf(shape: float, location: float, scale: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: -np.expm1(-(np.maximum(x - location, 0.0) / scale) ** shape)


def fit_weibull_ks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Three-parameter Weibull fit per column (shape, location, scale; ``edge``: see
    ``fit_weibull3``) and the KS distance of the fit, all columns' distances from
    the same branch-and-bound passes."""
    fits = {c: fit_weibull3(df, c) for c in columns}
    found = ks_statistics(df, columns, {c: weibull_cdf(f["shape"], f["location"], f["scale"]) for c, f in fits.items()})
    rows = [(c, f["shape"], f["location"], f["scale"], f["n"], f["edge"], found[c][0]) for c, f in fits.items()]
    return df.sparkSession.createDataFrame(rows, "column string, shape double, location double, scale double, n long, edge boolean, ks_stat double")
