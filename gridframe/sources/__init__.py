"""Readers and writers (CSV, ';'-CSV, multi-file union, Parquet, table sink)."""

from .io import (read_csv, read_csv_many, read_parquet, read_table_back, write_table)

__all__ = ["read_csv", "read_csv_many", "read_parquet", "read_table_back", "write_table"]
