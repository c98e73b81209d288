"""Joins on dates and codes.

No join here carries a broadcast hint on data that grows with the input: the
daily tables are left to AQE, which switches a sort-merge join to a broadcast
only after it has measured the shuffled side (``autoBroadcastJoinThreshold``).
Dimension lookups go through :func:`broadcast_if_small`, which checks the row
count with a bounded ``limit`` job and otherwise keeps the shuffle join; small
sides that are aggregates of the big input go through
:func:`materialized_small_side`, which writes them once before the check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import map_replace, previous_friday


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only if it is proven small: at most ``max_rows`` rows
    (counted by a job that stops after ``max_rows + 1`` rows) and at most
    ``max_bytes`` by the schema's per-row size estimate.  Otherwise the frame
    is returned unchanged and the join stays a shuffle join."""
    try:
        row_bytes = int(df._jdf.schema().defaultSize())
    except Exception:  # pragma: no cover - conservative default
        row_bytes = 256
    limit = min(max_rows, max(1, max_bytes // max(row_bytes, 1)))
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def materialized_small_side(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """For a small side that is itself an aggregate over the big input (group
    means, quartiles): write it once to the shared checkpoint folder, then
    size-check and broadcast the written copy.  The aggregation over the big
    input runs once, not once for the check and again for the join."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return broadcast_if_small(df.checkpoint(eager=True), max_rows, max_bytes)


def join_left_chain(base: DataFrame, tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """``base ⟕ t1 ⟕ t2 ...`` on the same key(s), left-deep like the source."""
    on = [on] if isinstance(on, str) else list(on)
    return reduce(lambda acc, t: acc.join(t, on, "left"), tables, base)


def join_inner_chain(tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    return reduce(lambda acc, t: acc.join(t, on, "inner"), tables[1:], tables[0])


def join_full_outer(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join with using-columns: the key is coalesced from both sides
    (pandas ``merge(how='outer')``)."""
    on = [on] if isinstance(on, str) else list(on)
    return left.join(right, on, "full")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """pandas merges match NULL keys with NULL keys; SQL equality does not."""
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    out = left.join(right, cond, how)
    for k in keys:
        out = out.withColumn(f"__{k}", F.coalesce(left[k], right[k])).drop(left[k]).drop(right[k]) \
                 .withColumnRenamed(f"__{k}", k)
    return out


def join_dim_lookup(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                    keep: Sequence[str], remap: Mapping[str, Mapping] | None = None,
                    max_dim_rows: int = 1_000_000) -> DataFrame:
    """Attach dimension attributes by differently named keys (left join),
    drop the dimension key, optionally remap codes (e.g. CO -> SE)."""
    d = dim.select(F.col(dim_key).alias("__dk"), *[_c(k) for k in keep])
    d = broadcast_if_small(d, max_dim_rows)
    out = facts.join(d, facts[fact_key] == d["__dk"], "left").drop("__dk")
    for col, mapping in (remap or {}).items():
        out = out.withColumn(col, map_replace(col, mapping))
    return out


def weekend_friday_match(df: DataFrame, date: str, value: str,
                         extra_keys: Sequence[str] = ()) -> DataFrame:
    """Weekend rows compared with the previous Friday's rows on the date key.

    The source joins on the date only, so every weekend row meets every Friday
    row of that week (many-to-many).  The match rate is computed from counts
    per (date, value) instead of materialising the pairs:
    pairs = Σ n_weekend(d) · n_friday(f(d)), matches = Σ_v n_weekend(d, v) · n_friday(f(d), v).
    """
    keys = list(extra_keys)
    d = F.col(date).cast("date")
    base = df.select(d.alias("__d"), *[_c(k) for k in keys], _c(value).alias("__v"))
    wk = base.where(F.weekday("__d") >= 5).withColumn("__f", previous_friday("__d"))
    fr = base.where(F.weekday("__d") == 4)
    wk_v = wk.groupBy("__f", *keys, "__v").agg(F.count(F.lit(1)).alias("__nw"))
    fr_v = fr.groupBy(F.col("__d").alias("__f"), *keys, "__v").agg(F.count(F.lit(1)).alias("__nf"))
    match_prod = wk_v.join(fr_v, ["__f", *keys, "__v"]).select(
        F.lit("matches").alias("__kind"), (F.col("__nw") * F.col("__nf")).alias("__x"))
    wk_n = wk.groupBy("__f", *keys).agg(F.count(F.lit(1)).alias("__nw"))
    fr_n = fr.groupBy(F.col("__d").alias("__f"), *keys).agg(F.count(F.lit(1)).alias("__nf"))
    pair_prod = wk_n.join(fr_n, ["__f", *keys]).select(
        F.lit("pairs").alias("__kind"), (F.col("__nw") * F.col("__nf")).alias("__x"))
    weekend = wk_n.select(F.lit("weekend").alias("__kind"), F.col("__nw").alias("__x"))
    # the three totals in one global aggregate over a union (no joins between aggregates)
    tot = pair_prod.unionByName(match_prod).unionByName(weekend).agg(
        *[F.coalesce(F.sum(F.when(F.col("__kind") == k, F.col("__x"))), F.lit(0)).cast("long").alias(k)
          for k in ("weekend", "pairs", "matches")])
    return tot.select(F.col("weekend").alias("weekend_rows"), "pairs", "matches",
                      (F.col("matches") * 100.0 / F.when(F.col("pairs") > 0, F.col("pairs"))).alias("match_pct"))


def semi_join(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``.  The right side is reduced
    to its distinct keys first (deduplicated map-side), so a hot key is one
    row in the shuffle instead of a third of the table."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other`` (distinct keys on
    the right, as in :func:`semi_join`)."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def interval_activity(intervals: DataFrame, *, start: str, end: str, amount: str,
                      keys: Sequence[str], cal_start: str, cal_end: str,
                      day: str = "DateTime", decimals: int = 9) -> DataFrame:
    """Sum of ``amount`` over intervals active on each calendar day, per key:
    active when ``start <= day`` and (``end`` is NULL or ``end > day``).

    Written as event deltas instead of a range join: +amount at ``start``,
    -amount at ``end``, summed per (key, day); a running total per key (one
    row per event day, so bounded by the calendar) is expanded to the days
    until the next event.  Intervals that start before the calendar are folded
    into its first day; intervals whose end is not after their start never
    contribute (as in the source, where ``start <= d < end`` is empty).
    Output is long: (keys..., day, amount); the running total is rounded to
    ``decimals`` so that +x/-x cancellation leaves an exact 0."""
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    valid = intervals.where(s.isNotNull() & (e.isNull() | (e > s)))
    lo, hi = F.lit(cal_start).cast("date"), F.lit(cal_end).cast("date")
    plus = valid.select(*[_c(k) for k in keys], s.alias("__day"), _c(amount).cast("double").alias("__d"))
    minus = valid.where(e.isNotNull()).select(*[_c(k) for k in keys], e.alias("__day"),
                                               (-_c(amount).cast("double")).alias("__d"))
    deltas = (plus.unionByName(minus)
                  .where(F.col("__day") <= hi)
                  .withColumn("__day", F.greatest(F.col("__day"), lo))
                  .groupBy(*keys, "__day").agg(F.sum("__d").alias("__d")))
    w = Window.partitionBy(*keys).orderBy("__day")
    run = (deltas.withColumn("__v", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("__next", F.lead("__day").over(w)))
    last = F.coalesce(F.date_sub(F.col("__next"), 1), hi)
    return run.select(*[_c(k) for k in keys],
                      F.explode(F.sequence(F.col("__day"), last)).alias(day),
                      F.round(F.col("__v"), decimals).alias(amount))


def date_spine(spark, start, end, name: str = "DateTime") -> DataFrame:
    """One row per day in [start, end] (generated, no input scan)."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"),
                                                      F.lit(end).cast("date"))).alias(name))

