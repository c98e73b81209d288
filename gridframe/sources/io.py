"""Sources and sinks.

Readers always take an explicit schema (no ``inferSchema`` pass over the data)
and return lazy DataFrames, so projections and filters written downstream are
pushed into the scan.  The sink writes Parquet partitioned by year, which turns
the source project's "one file per year" habit into partition pruning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from ..functions.scalars import nan_to_null


def _header(spark: SparkSession, path: str | Sequence[str], sep: str) -> list[str]:
    """Column names of the first header line (a job over one file's head)."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str,
             sep: str = ",", header: bool = True, timestamp_format: str | None = None,
             date_format: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """CSV with an explicit schema (``sep=';'`` for the registry file).

    With a header, columns are matched by name: the schema is laid out in the
    header's order, a schema column that the header lacks is an error, columns
    outside the schema are not read, and a file whose header differs from the
    first one's fails the read.  A cell that does not parse fails it too, unless
    ``mode`` says otherwise.  NaN becomes NULL."""
    path = path if isinstance(path, str) else list(path)
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
    layout = StructType(fields)
    names = _header(spark, path, sep) if header else []
    if names:
        missing = [f.name for f in fields if f.name not in names]
        if missing:
            raise ValueError(f"columns {missing} are not in the CSV header {names}")
        known = {f.name: f for f in fields}
        layout = StructType([known.get(c, StructField(c, StringType())) for c in names])
    r = (spark.read.schema(layout).option("header", header).option("sep", sep).option("mode", mode)
         .option("enforceSchema", not names))
    if timestamp_format:
        r = r.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    if date_format:
        r = r.option("dateFormat", date_format)
    floating = (DoubleType, FloatType)
    return r.csv(path).select(*[nan_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, floating)
                                else F.col(f"`{f.name}`") for f in fields])


def read_csv_many(spark: SparkSession, paths: Sequence[str], schema: StructType | str,
                  sep: str = ",", same_schema: bool = True) -> DataFrame:
    """One file per period, concatenated.  With one header the paths go to a
    single scan (parallel over files); otherwise there is one scan per distinct
    header, and schema columns that a header lacks are NULL."""
    if same_schema:
        return read_csv(spark, list(paths), schema, sep)
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        by_header.setdefault(tuple(_header(spark, p, sep)), []).append(p)
    frames = [read_csv(spark, same, StructType([f for f in fields if f.name in names]), sep).select(
        *[F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        for names, same in by_header.items()]
    return reduce(DataFrame.unionByName, frames)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by_year_of: str | None = None,
                mode: str = "overwrite") -> str:
    """Write a cleaned table; optionally partitioned by the year of a date column."""
    out = df
    parts = []
    if partition_by_year_of:
        out = out.withColumn("year", F.year(F.col(partition_by_year_of)))
        parts = ["year"]
    w = out.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def read_table_back(spark: SparkSession, path: str, fmt: str = "parquet",
                    schema: StructType | str | None = None) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)
