"""Exact top-k inner products: norm-sorted vectors, rotated partial sums.

Vectors become integers; the second moments of all of them give a rotation
(their singular vectors) that puts most of a product into the first
coordinates.  Queries and candidates meet in blocks: a stated query set against
all rows.  A block's candidates are processed by descending length: a slab ends
the search once its length times a query's cannot reach that query's k-th
score; within a slab the first rotated coordinates are multiplied, and the
rest is bounded by the product of the residual lengths (Cauchy-Schwarz); only
pairs that the bound lets pass get the exact integer product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, SHARD = 2048, 16_384
SLAB, HEAD = 1024, 24
_SLACK = 1e-6  # relative rounding of the floating-point bounds; products here stay far below 2**53


def usable(vectors: Column) -> Column:
    """Vectors without null or non-finite components, of at least one."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vectors.isNotNull() & (F.size(vectors) > 0) & fine, F.lit(False))


def in_blocks(rows: DataFrame, is_query: Column, query_block: int, shard: int) -> DataFrame:
    """Rows (id, v) dealt to (dim, query block, shard) with a mark and a key of id
    and vector: every query block meets every shard of its dimension, and repeated
    rows meet in one.  The block counts follow the row counts."""
    rows = rows.withColumns({"dim": F.size("v"), "q": is_query})
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("q")).first()
    blocks, shards = max(1, -(-(sizes["q"] or 0) // query_block)), max(1, -(-sizes["n"] // shard))
    h = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = F.xxhash64("id", "v").alias("key")
    queries = rows.where("q").select("id", "v", key, "dim", F.pmod(h, F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"), F.lit(True).alias("q"))
    others = rows.select("id", "v", key, "dim", every(blocks).alias("block"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("q"))
    return queries.union(others)


def once(key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different marked and of the different other rows."""
    queries, others = np.flatnonzero(mark), np.flatnonzero(~mark)
    return (queries[np.unique(key[queries], return_index=True)[1]], others[np.unique(key[others], return_index=True)[1]])


def best_of_shards(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k best of each query row over its shards, ties to the smaller id."""
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score_type).alias("score")))


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=kind).reshape(len(flat), -1)


def second_moments(rows: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Sum of v v' over all rows, by dimension: one matrix per partition and
    dimension, summed entry by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.asarray(pa.compute.list_value_length(column))
            for d in np.unique(sizes).tolist():
                v = np.asarray(column.filter(pa.array(sizes == d)).flatten(), dtype=np.float64).reshape(-1, d)
                sums[d] = sums.get(d, 0) + v.T @ v
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["dim", "at", "x"])

    total = rows.select("v").mapInArrow(run, "dim long, at long, x double").groupBy("dim", "at").agg(F.sum("x").alias("x")).toPandas()
    return {int(d): g.sort_values("at")["x"].to_numpy().reshape(int(d), int(d)) for d, g in total.groupby("dim")}


def _search(queries: tuple, others: tuple, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's best in one shard; queries are (keys,
    vectors), the others (keys, ids, vectors)."""
    qkey, q = queries
    ckey, cid, c = others
    length = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((cid, -length))
    ckey, cid, c, length = ckey[order], cid[order], c[order], length[order]
    head = min(HEAD, c.shape[1])
    cr, qr = c @ rotation, q @ rotation
    rest_c, rest_q = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (cr, qr))
    long_q = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    top = np.full((len(q), k), -np.inf)
    top_id = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for at in range(0, len(c), SLAB):
        own = slice(at, at + SLAB)
        # slack keeps ties and rounding inside
        reach = long_q[live] * length[at] * (1 + _SLACK) + 1
        live = live[reach >= top[live, -1]]
        if not len(live):
            break
        bound = qr[live, :head] @ cr[own, :head].T + rest_q[live, None] * rest_c[None, own]
        passes = bound + np.abs(bound) * _SLACK + 1 >= top[live, -1:]
        passes &= qkey[live, None] != ckey[None, own]
        some = np.flatnonzero(passes.any(axis=0))
        # whole numbers, so products in floating point are exact
        score = q[live] @ c[own][some].T
        score[~passes[:, some]] = -np.inf
        if len(some) > k:
            least = np.maximum(top[live, -1], -np.partition(-score, k - 1, axis=1)[:, k - 1])
        else:
            least = top[live, -1]
        i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        score, i, j = score[i, j], live[i], some[j] + at
        # join the new scores with the best so far, per query
        i = np.concatenate([np.repeat(live, k), i])
        score, ids = np.concatenate([top[live].ravel(), score]), np.concatenate([top_id[live].ravel(), cid[j]])
        order = np.lexsort((ids, -score, i))
        i, score, ids = i[order], score[order], ids[order]
        first = np.searchsorted(i, live)
        pick = first[:, None] + np.arange(k)
        top[live], top_id[live] = score[pick], ids[pick]
    row, col = np.nonzero(np.isfinite(top))
    return row, top_id[row, col], top[row, col]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query its k candidates of greatest inner product of floor(scale * x):
    query_id, rank, vec_id, score.  A row is no candidate of its own query; only
    vectors of equal dimension meet; unusable ones and null ids take no part.
    Rows repeated in id and vector are one row; rows that share an id alone are different
    ones, each a query and a candidate of the other.  Other columns aren't read; an empty
    table gives no row.  Components so large that a product could leave the exact
    range of doubles (2**53) are an error."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).alias("id"), v.alias("v"))
    largest = rows.agg(F.max(F.pow(F.array_max(F.transform("v", lambda x: F.abs(x))), 2) * F.size("v"))).first()[0] or 0.0
    if largest >= 2.0**53:
        raise ValueError("components are too large for exact products")
    rotations = {d: np.linalg.svd(m)[0] for d, m in second_moments(rows, np.float64).items()}
    shared = vectors.sparkSession.sparkContext.broadcast(rotations)

    def run(table: pa.Table) -> pa.Table:
        ids, key, v = np.asarray(table.column("id")), np.asarray(table.column("key")), matrix(table.column("v"), np.float64)
        own, others = once(key, np.asarray(table.column("q")))
        row, found, score = _search((key[own], v[own]), (key[others], ids[others], v[others]), shared.value[v.shape[1]], k)
        return pa.table({"query_id": ids[own][row], "key": key[own][row], "vec_id": found, "score": score.astype(np.int64)})

    found = (in_blocks(rows, is_query, QUERY_BLOCK, SHARD).groupBy("dim", "block", "shard")
             .applyInArrow(run, "query_id long, key long, vec_id long, score long"))
    return best_of_shards(found, k, "long")
