"""Global ordered operations without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.
For keyless time series (row numbers, forward fill, row lags, cumulative sums)
this module uses the two-phase form instead:

1. ``orderBy`` the frame on a total order (the caller's keys plus a unique
   tie-break).  The range partitioner samples the whole sort key, so even a hot
   date spreads over several partitions.
2. Cut the lineage with ``checkpoint()`` (the shared folder named by
   ``spark.checkpoint.dir``) so the partition boundaries stay fixed if an
   executor is lost and tasks are recomputed.
3. Per partition, compute a tiny summary (row count, last non-null value, sum).
   The summaries have one row per partition, a size bound independent of the
   data: the driver reads them, computes each partition's carry-in (a prefix
   over partitions) and the carry table is broadcast back.
4. Combine the carry-in with a window partitioned by the partition id, which
   is a balanced, parallel operation.

Row lags, rolling windows and sequences also need the rows just outside a
partition.  ``with_halo`` copies the last rows of each partition to the next
one (to several, where partitions are shorter than the window), so that the
windows run inside partitions: beside the sort, one exchange by partition id
serves all lags and window sizes, and no row is copied but the halos, of which
there are at most partitions x window rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

PID = "__pid"
POS = "__pos"
# A summary table has one row per partition; refuse to broadcast beyond this.
MAX_SUMMARY_ROWS = 2_000_000


def _cols(order: Iterable[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def sequenced(df: DataFrame, order: Iterable[Column | str]) -> DataFrame:
    """Sort globally, checkpoint, and tag each row with (partition id, position)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ordered = df.orderBy(*_cols(order)).checkpoint(eager=True)
    if ordered.rdd.getNumPartitions() > MAX_SUMMARY_ROWS:
        raise ValueError("too many partitions for a broadcast per-partition summary")
    mid = F.monotonically_increasing_id()
    pid = F.spark_partition_id()
    return (ordered.withColumn(PID, pid)
                   .withColumn(POS, mid - F.shiftleft(pid.cast("long"), 33)))


def _offsets(summary: DataFrame, col: str, dtype: str) -> DataFrame:
    """Exclusive prefix of ``col`` over partitions, computed on the driver from
    the per-partition summary (one row per partition) and returned as a small
    frame for a broadcast join."""
    rows = sorted((r[0], r[1]) for r in summary.select(PID, col).collect())
    acc, out = (0.0 if dtype == "double" else 0), []
    for pid, v in rows:
        out.append((pid, acc))
        acc += v or 0
    return summary.sparkSession.createDataFrame(out, f"{PID} int, __off {dtype}")


def global_row_number(df: DataFrame, order: Iterable[Column | str], name: str = "rn") -> DataFrame:
    """1-based row number over a total order, computed without one big task."""
    seq = sequenced(df, order)
    counts = seq.groupBy(PID).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _offsets(counts, "__n", "long")
    return (seq.join(F.broadcast(offsets), PID)
               .withColumn(name, F.col("__off") + F.col(POS) + 1)
               .drop("__off", PID, POS))


def fill(df: DataFrame, order: Iterable[Column | str], ffill: Iterable[str] = (),
         bfill: Iterable[str] = (), both: Iterable[str] = ()) -> DataFrame:
    """Forward fill ``ffill`` columns, backward fill ``bfill`` columns and
    ``ffill().bfill()`` the ``both`` columns along a global order, all from one
    sorted, checkpointed pass.  (``ffill`` then ``bfill`` equals
    ``coalesce(ffill, bfill)``: after a forward fill only leading NULLs remain.)"""
    ff = list(dict.fromkeys([*ffill, *both]))
    bf = list(dict.fromkeys([*bfill, *both]))
    both = set(both)
    seq = sequenced(df, order)
    nn = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.col(POS))
    # Per partition: last non-null of the forward columns, first non-null of the backward ones.
    summ = seq.groupBy(PID).agg(
        *[F.max_by(F.col(f"`{c}`"), nn(c)).alias(f"__f{i}") for i, c in enumerate(ff)],
        *[F.min_by(F.col(f"`{c}`"), nn(c)).alias(f"__b{i}") for i, c in enumerate(bf)],
        F.count(F.lit(1)).alias("__n"))
    # Carry-in per partition from the one-row-per-partition summary (driver side).
    rows = sorted(summ.collect(), key=lambda r: r[PID])
    carry_f, carry_b = {}, {}
    seen = [None] * len(ff)
    for r in rows:
        carry_f[r[PID]] = list(seen)
        seen = [r[f"__f{i}"] if r[f"__f{i}"] is not None else seen[i] for i in range(len(ff))]
    seen = [None] * len(bf)
    for r in reversed(rows):
        carry_b[r[PID]] = list(seen)
        seen = [r[f"__b{i}"] if r[f"__b{i}"] is not None else seen[i] for i in range(len(bf))]
    schema = T.StructType([T.StructField(PID, T.IntegerType())] +
                          [T.StructField(f"__cf{i}", summ.schema[f"__f{i}"].dataType) for i in range(len(ff))] +
                          [T.StructField(f"__cb{i}", summ.schema[f"__b{i}"].dataType) for i in range(len(bf))])
    carry = seq.sparkSession.createDataFrame(
        [(r[PID], *carry_f[r[PID]], *carry_b[r[PID]]) for r in rows], schema)
    wf = Window.partitionBy(PID).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(PID).orderBy(POS).rowsBetween(0, Window.unboundedFollowing)
    fval = {c: F.coalesce(F.last(F.col(f"`{c}`"), ignorenulls=True).over(wf), F.col(f"__cf{i}"))
            for i, c in enumerate(ff)}
    bval = {c: F.coalesce(F.first(F.col(f"`{c}`"), ignorenulls=True).over(wb), F.col(f"__cb{i}"))
            for i, c in enumerate(bf)}

    def value(c):
        if c in both:
            return F.coalesce(fval[c], bval[c]).alias(c)
        if c in fval:
            return fval[c].alias(c)
        if c in bval:
            return bval[c].alias(c)
        return F.col(f"`{c}`")

    out = seq.join(F.broadcast(carry), PID)
    return out.select(*[value(c) for c in df.columns])


def forward_fill(df: DataFrame, order: Iterable[Column | str], columns: Iterable[str],
                 backward: bool = False) -> DataFrame:
    """``ffill`` (or ``bfill``) of ``columns`` along a global order."""
    return fill(df, order, bfill=columns) if backward else fill(df, order, ffill=columns)


def cumulative_sum(df: DataFrame, order: Iterable[Column | str], column: str, name: str) -> DataFrame:
    """Running total of ``column`` along a global order."""
    seq = sequenced(df, order)
    sums = seq.groupBy(PID).agg(F.sum(column).cast("double").alias("__s"))
    offsets = _offsets(sums, "__s", "double")
    wp = Window.partitionBy(PID).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    return (seq.join(F.broadcast(offsets), PID)
               .withColumn(name, F.col("__off") + F.sum(column).over(wp))
               .drop("__off", PID, POS))


def _halo_targets(counts: list[int], before: int, after: int) -> list[list[tuple[int, int, int]]]:
    """Per partition, (other partition, first row, end): the global rows that the
    other one needs within ``before`` rows ahead of it or ``after`` rows behind it."""
    starts = [0]
    for n in counts:
        starts.append(starts[-1] + n)
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for t, n in enumerate(counts):
        if not n:
            continue
        lo, p = max(0, starts[t] - before), t - 1
        while p >= 0 and starts[p + 1] > lo:
            if counts[p]:
                out[p].append((t, max(lo, starts[p]), starts[p + 1]))
            p -= 1
        hi, p = min(starts[-1], starts[t + 1] + after), t + 1
        while p < len(counts) and starts[p] < hi:
            if counts[p]:
                out[p].append((t, starts[p], min(hi, starts[p + 1])))
            p += 1
    return out


ROW, OWN = "__row", "__own"


def with_halo(df: DataFrame, order: Iterable[Column | str], before: int, after: int = 0) -> DataFrame:
    """The rows along a global order with their partition id (``PID``) and 0-based global
    row number (``ROW``), and copies of the ``before`` rows ahead of each partition and
    the ``after`` rows behind it, marked by a false ``OWN``.

    A window ``partitionBy(PID).orderBy(ROW)`` that reaches at most that far sees
    what a window over all rows would; drop the copies (``where(OWN)``) after it."""
    seq = sequenced(df, order)
    found = {r[PID]: r["n"] for r in seq.groupBy(PID).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    targets, start, rows = _halo_targets(counts, before, after), 0, []
    for p, n in enumerate(counts):
        rows.append((p, start, targets[p]))
        start += n
    table = seq.sparkSession.createDataFrame(rows, f"{PID} int, __start long, __to array<struct<t:int,lo:long,hi:long>>")
    placed = seq.join(F.broadcast(table), PID).withColumn(ROW, F.col("__start") + F.col(POS))
    columns = [F.col(f"`{c}`") for c in df.columns]
    own = placed.select(*columns, PID, ROW, F.lit(True).alias(OWN))
    needed = F.filter("__to", lambda x: (x["lo"] <= F.col(ROW)) & (F.col(ROW) < x["hi"]))
    copies = placed.where(F.size("__to") > 0).select(*columns, ROW, F.explode(needed).alias("__x"))
    return own.unionByName(copies.select(*columns, F.col("__x.t").alias(PID), ROW, F.lit(False).alias(OWN)))


def _window():
    return Window.partitionBy(PID).orderBy(ROW)


def row_lags(df: DataFrame, order: Iterable[Column | str], column: str,
             lags: Iterable[int], prefix: str | None = None) -> DataFrame:
    """``shift(n)`` along a global order: the value ``n`` rows earlier (later, for
    a negative ``n``); all lags come from one pass over sorted partitions with halos."""
    lags = list(lags)
    prefix = prefix or f"{column}_lag"
    rows = with_halo(df, order, max([0, *lags]), max([0, *(-n for n in lags)]))
    value = F.col(f"`{column}`")
    for n in lags:
        rows = rows.withColumn(f"{prefix}{n}", F.lag(value, n).over(_window()))
    return rows.where(OWN).drop(PID, ROW, OWN)


ROLLING = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}


def rolling(df: DataFrame, order: Iterable[Column | str], column: str, size: int | None = None,
            aggs: dict | None = None) -> DataFrame:
    """Trailing row-window statistics, NULL until the window holds its full
    number of non-null values (pandas ``rolling(n)`` with ``min_periods=n``).

    ``aggs`` maps an output name to a function name (with ``size``) or to a
    ``(size, function)`` pair; windows of all lengths run in the same sorted
    partitions, whose halo is as long as the longest."""
    spec = {n: (f if isinstance(f, tuple) else (size, f)) for n, f in (aggs or {}).items()}
    rows = with_halo(df, order, max(sz for sz, _ in spec.values()) - 1)
    value = F.col(f"`{column}`")
    for name, (sz, f) in spec.items():
        w = _window().rowsBetween(1 - sz, 0)
        rows = rows.withColumn(name, F.when(F.count(value).over(w) == sz, ROLLING[f](value).over(w)))
    return rows.where(OWN).drop(PID, ROW, OWN)
