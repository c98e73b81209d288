"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridframe.session import scratch_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back, so
    that later steps neither recompute it nor depend on live executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows per Arrow batch of the jobs started inside; rows here hold whole texts
    or sets, so the usual 10,000 would take a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: float) -> int:
    """The least power of two that is at least ``n``."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) on unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """The first ``n`` odd numbers of a fixed pseudo-random sequence."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(step + np.uint64(seed)) | np.uint64(1)


class Rows:
    """A growing array that keeps its memory when it is emptied.

    Many small arrays held between large temporaries leave a task's memory in
    pieces; one buffer doesn't."""

    def __init__(self, kind: np.dtype, capacity: int) -> None:
        self._held, self._size = np.empty(capacity, dtype=kind), 0

    def __len__(self) -> int:
        return self._size

    def more(self, n: int) -> np.ndarray:
        """A view of ``n`` further rows, to be filled."""
        if self._size + n > len(self._held):
            grown = np.empty(max(self._size + n, 2 * len(self._held)), dtype=self._held.dtype)
            grown[: self._size] = self._held[: self._size]
            self._held = grown
        self._size += n
        return self._held[self._size - n: self._size]

    def take(self) -> np.ndarray:
        """All rows, as a view that the next ``more`` overwrites."""
        size, self._size = self._size, 0
        return self._held[:size]
