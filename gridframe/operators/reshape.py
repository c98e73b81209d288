"""Pivot, unpivot and row-wise arithmetic.

Pivots take a list of pivot values, whose columns always exist and come first,
and add a column for every other value of the data, so no row is lost.  The
input is read once: it is aggregated to (index, pivot value) with map-side
combination, that small table is written, and both the values and the columns
come from it.  More than ``MOST_COLUMNS`` values are an error, as a schema must not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_name
from ..session import scratch_dir


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def namer(prefix: str, suffix: str) -> Callable[[str], str]:
    return lambda v: f"{prefix}{safe_name(str(v))}{suffix}"


class DuplicatePivotKey(ValueError):
    pass


MOST_COLUMNS = 1000


def pivot_values(df: DataFrame, column: str, listed: Sequence) -> list:
    """The listed values, then in order the others that the data holds; NULL is
    no pivot value.  At most ``MOST_COLUMNS`` in all."""
    present = {r[0] for r in df.select(_c(column)).where(_c(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()}
    values = [*listed, *sorted(present - set(listed))]
    if len(values) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values to pivot")
    return values


def written(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "pivot")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pivot_cells(df: DataFrame, index: Sequence[str], column: str, values: Sequence, cells: Sequence[tuple[Column, Callable]]) -> DataFrame:
    """One column per (value, cell): a cell is the aggregate of the rows of an
    (index, value) and the name of its column.  Rows with a NULL value make no
    cell, but their index stays."""
    names = [f"__c{k}" for k in range(len(cells))]
    long = written(df.groupBy(*[_c(i).alias(i) for i in index], _c(column).alias("__p")).agg(*[a.alias(n) for n, (a, _) in zip(names, cells)]))
    return spread(long, index, "__p", values, [(n, name) for n, (_, name) in zip(names, cells)])


def spread(long: DataFrame, index: Sequence[str], column: str, values: Sequence, cells: Sequence[tuple[str, Callable]]) -> DataFrame:
    """The columns of a written table of one row per (index, value): ``cells`` are
    its columns with the name of the wide column for a value."""
    values = pivot_values(long, column, values)
    # one row per (index, value): max() is the cell itself
    columns = [F.max(F.when(F.col(column) == F.lit(v), _c(n))).alias(name(v)) for v in values for n, name in cells]
    return long.groupBy(*index).agg(*columns)


def pivot_region(df: DataFrame, index: Sequence[str], column: str, value: str,
                 values: Sequence, prefix: str = "", suffix: str = "",
                 check_unique: bool = False) -> DataFrame:
    """Long -> wide with unique (index, column) keys (pandas ``pivot``).

    ``check_unique=True`` runs one extra aggregate pass and raises like pandas
    when a key repeats; else the greatest value of a repeated key is taken."""
    if check_unique:
        dup = df.groupBy(*index, column).count().where("count > 1").limit(1).collect()
        if dup:
            raise DuplicatePivotKey(f"Index contains duplicate entries: {dup[0]}")
    return pivot_cells(df, index, column, values, [(F.max(_c(value)), namer(prefix, suffix))])


def pivot_sum(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence,
              prefix: str = "", suffix: str = "") -> DataFrame:
    """``groupby([index, column]).sum()`` followed by ``pivot``.  Like pandas, a
    cell whose rows are all NULL sums to 0 and a cell without rows stays NULL."""
    return pivot_cells(df, index, column, values, [(F.coalesce(F.sum(_c(value)), F.lit(0)), namer(prefix, suffix))])


AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def pivot_table(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence,
                agg: str = "mean", prefix: str = "", suffix: str = "") -> DataFrame:
    """``pivot_table(aggfunc=agg)``: mean/sum/max/min/count of ``value``; cells
    without rows are NULL."""
    return pivot_cells(df, index, column, values, [(AGGREGATES[agg](_c(value)), namer(prefix, suffix))])


def pivot_table_sum_multi(df: DataFrame, index: Sequence[str], column: str,
                          value_columns: Sequence[str], values: Sequence) -> DataFrame:
    """Sum pivot with several value columns, ``{value}_{pivot value}``."""
    cells = [(F.sum(_c(v)), lambda pv, v=v: f"{safe_name(v)}_{safe_name(str(pv))}") for v in value_columns]
    return pivot_cells(df, index, column, values, cells)


def pivot_surface(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Surface (delivery x quote) kept long: one mean per cell.  Pivoting on
    thousands of dates would exceed ``spark.sql.pivotMaxValues`` and build a
    schema that grows with the data."""
    return df.groupBy(_c(row), _c(col)).agg(F.avg(_c(value)).alias(value))


def row_sum(columns: Sequence[str]) -> Column:
    """Row-wise sum treating NULL as 0 (pandas ``sum(axis=1)``)."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0)) for c in columns])


def row_sum_cols(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, row_sum(columns))


def row_mean_cols(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    s = reduce(lambda a, b: a + b, [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [F.when(_c(c).isNotNull(), 1).otherwise(0) for c in columns])
    return df.withColumn(name, F.when(n > 0, s / n))


def unpivot_melt(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 var_name: str = "variable", value_name: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var_name, value_name)


def rename_pivot(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))
