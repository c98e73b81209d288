"""Sort, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def sort_multi(df: DataFrame, order: Sequence[Column | str], rank: str | None = "rank") -> DataFrame:
    """Sort by several columns.  With ``rank`` the position is materialised as
    a column (computed without a single-partition window) so the order
    survives any later shuffle and can be checked."""
    if rank is None:
        return df.orderBy(*order)
    return ordered.global_row_number(df, order, rank).orderBy(rank)


def topk_abs(df: DataFrame, column: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` rows by absolute value (a bounded TakeOrderedAndProject)."""
    return df.orderBy(F.abs(_c(column)).desc(), *[_c(t) for t in ties]).limit(n)


def leaderboard(df: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    o = _c(metric).asc() if ascending else _c(metric).desc()
    return df.orderBy(o)


def _null_safe_on(a: DataFrame, b: DataFrame):
    cond = None
    for c in a.columns:
        e = a[c].eqNullSafe(b[c])
        cond = e if cond is None else cond & e
    return cond


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` not in ``b`` (``set(a) - set(b)``, NULL equal to
    NULL).  Both sides are deduplicated before the join (``EXCEPT`` would
    shuffle ``b`` with all its duplicates)."""
    a, b = a.distinct(), b.distinct()
    return a.join(b, _null_safe_on(a, b), "left_anti")


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows present in both (``set(a) & set(b)``)."""
    a, b = a.distinct(), b.distinct()
    return a.join(b, _null_safe_on(a, b), "left_semi")


def set_union_tagged(parts: Sequence[tuple[str, DataFrame]], tag: str = "source") -> DataFrame:
    """Concatenate frames with a literal tag column (``unionByName``)."""
    out = None
    for name, df in parts:
        t = df.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
