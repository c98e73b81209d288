"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then
one-sided Jacobi on the triangular factor.

Entries become integers floor(scale * c) + shift.  One aggregate gives the row
count and the sums per dimension, a second pass the scatter of the rows centred
at the rounded mean: products of integers summed exactly, per task and then by
Spark, one row per pair of dimensions.  The driver holds that d x d matrix and
nothing else; the last remainder of the centring is exact integer arithmetic too.

The factor L of the pivoted Cholesky decomposition (V = L L') has as many
columns as V has rank.  Plane rotations from the right make its columns
orthogonal, all disjoint pairs of a round at once: the squared column norms are
the eigenvalues of V and the normalised columns its eigenvectors, without
forming V's own iterations.  Both steps run in extended precision."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import arrow_rows, materialise
from gridframe.llm.topk import matrix, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
MOST_DIMENSIONS = 4096
_LARGEST = 2.0**40  # of scale * c: a larger entry is an error
_BATCH = 4096
_SWEEPS = 60
_RANK = 16 * np.finfo(np.longdouble).eps  # a pivot below this share of the first is rounding error


class Fit:
    """Row count, sums per dimension, eigenvalues (falling) and unit eigenvectors as columns."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.base = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
        self.rest = [s - n * int(b) for s, b in zip(sums, self.base)]

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates of the first ``k`` components."""
        centred = (x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        y, rest = x - self.base, np.array(self.rest, dtype=np.int64)
        largest = float(np.abs(y).max(initial=0)) * self.n + float(np.abs(rest).max(initial=0))
        if largest**2 * len(rest) < 2.0**62:
            d = self.n * y - rest
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest)) for row in y.tolist()]
        return [v if v < 2**63 else None for v in exact]


def integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part: vectors of at least one entry, none of
    them null or non-finite, and of the most frequent length (ties: the longer)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    rows = rows.withColumn("d", F.size("v"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m"), F.max("d").alias("most")).first()
    if sizes["m"] is None:
        return rows.select("id", F.col("v").cast("array<long>").alias("x"))
    if sizes["most"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {sizes['most']} dimensions; the d x d scatter is held for at most {MOST_DIMENSIONS}")
    entry = lambda c: F.when(F.abs(c * SCALE) < _LARGEST, F.floor(c * SCALE) + SHIFT).otherwise(
        F.raise_error("an entry is too large to whiten"))
    return rows.where(F.col("d") == sizes["m"]["d"]).select("id", F.transform("v", entry).alias("x"))


def _chunks(x: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in blocks whose products' sums are exact in double precision."""
    most = float(np.abs(x).max(initial=1))
    step = int(min(len(x), 2.0**52 / max(1.0, most * most))) if len(x) else 0
    for at in range(0, len(x), max(1, step)):
        yield x[at: at + max(1, step)]


def _products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers."""
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    if float(np.abs(y).max(initial=0)) < 2.0**26:
        for part in _chunks(y):
            f = part.astype(np.float64)
            total += (f.T @ f).astype(np.int64).astype(object)
        return total
    high, low = y >> 21, y & (2**21 - 1)  # two exact halves
    for h, lo in zip(np.array_split(high, max(1, len(y) // 512)), np.array_split(low, max(1, len(y) // 512))):
        h, lo = h.astype(np.float64), lo.astype(np.float64)
        cross = (h.T @ lo).astype(np.int64).astype(object)
        total += (h.T @ h).astype(np.int64).astype(object) * 2**42 + (cross + cross.T) * 2**21 + (lo.T @ lo).astype(np.int64).astype(object)
    return total


def _summed(rows: DataFrame, block, d: int) -> np.ndarray:
    """The sum over all rows of ``block(x)``, d x d integers, added up by Spark."""
    upper = np.triu_indices(d)
    places = pa.array((upper[0] * d + upper[1]).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object)
        for batch in batches:
            total += block(matrix(pa.chunked_array([batch.column(0)]), np.int64))
        yield pa.RecordBatch.from_arrays([places, pa.array(total[upper].tolist(), pa.decimal128(38))], names=["at", "s"])

    with arrow_rows(rows.sparkSession, _BATCH):
        found = rows.select("x").mapInArrow(run, "at long, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(d * d, dtype=object)
    for r in found:
        out[r["at"]] = int(r["s"])
    out = out.reshape(d, d)
    return np.where(np.tri(d, k=-1, dtype=bool), out.T, out)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank) with L L' = v; the pivot is the largest remaining diagonal,
    and the rank ends where that is rounding error of the first."""
    d = len(v)
    rest, out = v.astype(np.longdouble).copy(), np.zeros((d, d), dtype=np.longdouble)
    first = rest.diagonal().max(initial=0)
    for k in range(d):
        p = int(rest.diagonal().argmax())
        if not rest[p, p] > _RANK * d * first:
            return out[:, :k]
        out[:, k] = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(out[:, k], out[:, k])
        rest[p, :] = rest[:, p] = 0
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of factor factor', by rotating
    pairs of its columns until all are orthogonal."""
    a = factor.copy()
    r = a.shape[1]
    seats = list(range(r + r % 2))
    tiny = np.finfo(np.longdouble).eps * 8
    for _ in range(_SWEEPS):
        worst = np.longdouble(0)
        for _ in range(max(0, len(seats) - 1)):  # a round robin: every pair meets once
            half = len(seats) // 2
            pairs = [(i, j) for i, j in zip(seats[:half], reversed(seats[half:])) if i < r and j < r]
            i, j = (np.array(side) for side in zip(*pairs)) if pairs else (np.empty(0, int), np.empty(0, int))
            x, y = a[:, i], a[:, j]
            p, q, g = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(p) * np.sqrt(q)
            off = np.where(size > 0, np.abs(g) / np.where(size > 0, size, 1), 0)
            worst = max(worst, off.max(initial=np.longdouble(0)))
            turn = off > tiny
            zeta = (q - p) / np.where(turn, 2 * g, 1)
            t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1)
            s = np.where(turn, c * t, 0)
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            seats[1:] = [seats[-1], *seats[1:-1]]
        if worst <= tiny:
            break
    values = (a * a).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], a[:, order] / np.sqrt(values[order])


def fit(rows: DataFrame) -> Fit | None:
    """From rows (id, x); None where no direction varies."""
    sums = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(
        F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    if not sums:
        return None
    n, s = int(sums[0]["n"]), [int(r["s"]) for r in sums]
    whole = Fit(n, s, np.empty(0), np.empty((len(s), 0)), 0.0)
    base, rest = whole.base, whole.rest
    scatter = _summed(rows, lambda x: _products(x - base), len(s))
    exact = [[Fraction(n * int(scatter[i, j]) - rest[i] * rest[j], n * n) for j in range(len(s))] for i in range(len(s))]
    trace = float(sum(exact[i][i] for i in range(len(s))))
    if trace == 0:
        return None
    cov = np.array([[_extended(x) for x in row] for row in exact], dtype=np.longdouble)
    values, vectors = one_sided_jacobi(pivoted_cholesky(cov))
    return Fit(n, s, values.astype(np.float64), vectors.astype(np.float64), trace)


def _extended(x: Fraction) -> np.longdouble:
    """A fraction to extended precision: a double and its remainder."""
    high = float(x)
    return np.longdouble(high) + np.longdouble(float(x - Fraction(high)))


def identity_error(rows: DataFrame, model: Fit, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the
    identity, measured over all rows: centred sums of products per task, merged by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.project(matrix(pa.chunked_array([batch.column(0)]), np.int64), k)
            total, first = total + w.T @ w, first + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate((total.ravel(), first)))], names=["at", "s"])

    with arrow_rows(rows.sparkSession, _BATCH):
        found = rows.select("x").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    s = np.array([r["s"] for r in found]) / model.n
    cov = s[: k * k].reshape(k, k) - np.outer(s[k * k:], s[k * k:])
    return float(np.abs(cov - np.eye(k)).max())


_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each row's whitened coordinates, one row per component.

    Rows whose vector is null or empty, holds null or non-finite entries, or has
    another length than the most frequent one take no part.  Repeated rows count
    as often as they stand there and return as often; a null id stays null;
    other columns aren't read, whatever their names.  Directions without
    variance have no whitened coordinate, so there are as many components as the
    covariance has rank, at most ``components``; an empty table, a single row or
    equal rows give no row.  Equal eigenvalues share a space, in which any
    basis is right.  ``deviation`` is null where it goes beyond 64 bits; an entry
    of 2**34 or more is an error."""
    spark = df.sparkSession
    rows = materialise(integers(df, id_col, vector_col), "whiten")
    model = fit(rows)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {_RESULT}"
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k = min(components, len(model.values))
    error = identity_error(rows, model, k)
    explained = model.values[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = matrix(pa.chunked_array([batch.column(1)]), np.int64)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(at), pa.array(model.project(x, k).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["id", *(part.split()[0] for part in _RESULT.split(", "))])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
