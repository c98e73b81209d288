"""Projection, renaming, filters and row predicates (DataFrame -> DataFrame).

All operators are narrow transformations: no shuffle, and filters written on
scan columns reach the Parquet reader as pushed filters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project_rename(df: DataFrame, columns: Mapping[str, str] | Iterable[str],
                   drop: Iterable[str] = ()) -> DataFrame:
    """Keep ``columns`` (a list, or a mapping old -> new name), then drop ``drop``."""
    if isinstance(columns, Mapping):
        out = df.select(*[F.col(f"`{k}`").alias(v) for k, v in columns.items()])
    else:
        out = df.select(*[F.col(f"`{c}`") for c in columns])
    drop = list(drop)
    return out.drop(*drop) if drop else out


def rename_by_rule(df: DataFrame, names: Iterable[str], rule: Callable[[str], str]) -> DataFrame:
    """Rename the listed columns with ``rule(name)``; others keep their name."""
    names = set(names)
    return df.select(*[F.col(f"`{c}`").alias(rule(c)) if c in names else F.col(f"`{c}`")
                       for c in df.columns])


def prefix_suffix(prefix: str = "", suffix: str = "") -> Callable[[str], str]:
    return lambda c: f"{prefix}{c}{suffix}"


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def columns_by_pattern(df: DataFrame, *, prefix: str | None = None, suffix: str | None = None,
                       contains: str | None = None, regex: str | None = None,
                       numeric: bool | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the columns matching every given condition (schema only, no job)."""
    exclude = set(exclude)
    out = []
    for f in df.schema.fields:
        n = f.name
        if n in exclude:
            continue
        if prefix is not None and not n.startswith(prefix):
            continue
        if suffix is not None and not n.endswith(suffix):
            continue
        if contains is not None and contains not in n:
            continue
        if regex is not None and not re.search(regex, n):
            continue
        if numeric is not None and isinstance(f.dataType, _NUMERIC) != numeric:
            continue
        out.append(n)
    return out


def select_by_pattern(df: DataFrame, keep: Iterable[str] = (), **pattern) -> DataFrame:
    """``keep`` columns plus every column matched by :func:`columns_by_pattern`."""
    keep = list(keep)
    cols = keep + [c for c in columns_by_pattern(df, **pattern) if c not in keep]
    return df.select(*[F.col(f"`{c}`") for c in cols])


def drop_constant_zero_cols(df: DataFrame, candidates: Iterable[str] | None = None) -> DataFrame:
    """Drop candidate columns whose every value is 0 or NULL (pandas
    ``df.loc[:, (df != 0).any()]``, but a column of zeros and NULLs goes too,
    where pandas keeps it as NaN != 0).  One aggregate pass decides the schema."""
    cand = list(candidates) if candidates is not None else columns_by_pattern(df, numeric=True)
    if not cand:
        return df
    flags = df.agg(*[F.max(F.coalesce(F.col(f"`{c}`") != 0, F.lit(False))).alias(f"f{i}")
                     for i, c in enumerate(cand)]).first()
    dead = [c for i, c in enumerate(cand) if not flags[f"f{i}"]]
    return df.drop(*dead) if dead else df


def filter_range(df: DataFrame, column: str, lo=None, hi=None, *, inclusive: str = "both",
                 isin: Iterable | None = None, isin_column: str | None = None) -> DataFrame:
    """Range filter on one column, optionally with an ``isin`` on another."""
    c = F.col(column)
    conds: list[Column] = []
    if lo is not None:
        conds.append(c >= F.lit(lo) if inclusive in ("both", "left") else c > F.lit(lo))
    if hi is not None:
        conds.append(c <= F.lit(hi) if inclusive in ("both", "right") else c < F.lit(hi))
    if isin is not None:
        conds.append(F.col(isin_column or column).isin(list(isin)))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def filter_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows of one calendar year, written as a half-open range so the Parquet
    reader and partition pruning can use it (``year(c) = y`` cannot be pushed)."""
    c = F.col(column)
    return df.where((c >= F.lit(f"{year:04d}-01-01").cast("date")) &
                    (c < F.lit(f"{year + 1:04d}-01-01").cast("date")))


def filter_exclude_code(df: DataFrame, column: str, codes: Iterable[str]) -> DataFrame:
    """Drop rows whose code is in ``codes``; rows with a NULL code are kept
    (pandas ``!=`` keeps NaN, SQL ``<>`` would drop them)."""
    codes = list(codes)
    return df.where(~F.coalesce(F.col(column).isin(codes), F.lit(False)))


def drop_nulls(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset is not None else None)


def dedup_keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """Keep the first row per key under an explicit order (``dropDuplicates``
    keeps an arbitrary row).  Implemented as ``min_by`` over a struct so the
    hash aggregate combines map-side and a hot key never gathers in one task."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    sort_key = F.struct(*order)
    return (df.groupBy(*keys)
              .agg(F.min_by(packed, sort_key).alias("__row"))
              .select(*keys, *[F.col("__row")[c].alias(c) for c in rest]))


def rows_any_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    cols = list(columns) if columns is not None else df.columns
    return df.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in cols]))


def unit_convert(df: DataFrame, column: str, factor: float, out: str | None = None,
                 unit_col: str | None = None, unit: str | None = None) -> DataFrame:
    df = df.withColumn(out or column, F.col(column) * F.lit(factor))
    if unit_col:
        df = df.withColumn(unit_col, F.lit(unit))
    return df

