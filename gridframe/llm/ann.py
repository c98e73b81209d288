"""Approximate nearest neighbours by collision counting.

Each of ``PROJECTIONS`` random directions orders the vectors in an array of its
own.  A query's window in an array is centred at its own projection and grows
by virtual rehashing: round r takes the vectors within ``radius * GROWTH**r``.
A vector collides once per array whose window holds it, and one with at least
``THRESHOLD`` collisions is verified by its true inner product.  A query grows
its windows until it has verified ``VERIFY`` of the block's vectors (at least
``LEAST``).  Every row is indexed, in blocks that each query block meets.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with
the greatest length M of all rows, which queries have as 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.topk import best_of_shards, in_blocks, matrix, once, usable

QUERY_BLOCK, SHARD, QUERIES = 4096, 8192, 64
PROJECTIONS, THRESHOLD = 64, 40
VERIFY, LEAST = 0.3, 400
GROWTH, START = 1.1, 1.3
SEED = 17
PAIRS = 4096  # exact products at a time
_SLACK = 1e-9  # relative rounding of the products


def _collisions(sorted_c: np.ndarray, rank: np.ndarray, at_q: np.ndarray, radius: float) -> np.ndarray:
    """Collisions of each query with each vector.  A window is a run of places
    in a sorted array, and a vector is in it if its place is."""
    counts = np.zeros((len(at_q), sorted_c.shape[1]), np.uint8)
    for p in range(len(sorted_c)):
        first = np.searchsorted(sorted_c[p], at_q[:, p] - radius, side="left").astype(rank.dtype)
        last = np.searchsorted(sorted_c[p], at_q[:, p] + radius, side="right").astype(rank.dtype)
        # places before the window wrap round to large numbers
        counts += rank[p][None, :] - first[:, None] < (last - first)[:, None]
    return counts


def _search(qkey: np.ndarray, q: np.ndarray, ckey: np.ndarray, cid: np.ndarray, c: np.ndarray, longest: float, k: int):
    """(query index, id, score) of each query's best verified vectors of one shard."""
    rng = np.random.default_rng(SEED)
    directions = rng.standard_normal((c.shape[1] + 1, PROJECTIONS)) / np.sqrt(c.shape[1] + 1)
    extra = np.sqrt(np.maximum(0.0, longest ** 2 - (c ** 2).sum(axis=1)))
    lengths = np.sqrt((q ** 2).sum(axis=1))
    at_c = (np.concatenate([c, extra[:, None]], axis=1) / longest) @ directions
    # a query's length does not change which products are greatest
    at_q = (q / lengths[:, None]) @ directions[:-1]
    order = np.argsort(at_c, axis=0).T
    sorted_c = np.take_along_axis(at_c.T, order, axis=1)
    rank = np.empty(order.shape, np.uint16 if len(c) < 1 << 16 else np.uint32)
    np.put_along_axis(rank, order, np.arange(len(c), dtype=rank.dtype)[None, :], axis=1)
    enough = min(len(c), max(LEAST, int(np.ceil(VERIFY * len(c)))))
    rows, ids, scores = [], [], []
    for block in range(0, len(q), QUERIES):
        live = np.arange(block, min(block + QUERIES, len(q)))
        radius = START / np.sqrt(c.shape[1] + 1)
        while len(live):
            counts = _collisions(sorted_c, rank, at_q[live], radius)
            hit = counts >= THRESHOLD
            done = (hit.sum(axis=1) >= enough) | (radius > 8)
            own, hit = live[done], hit[done] | (radius > 8)
            product = q[own] @ c.T
            product[~hit | (qkey[own][:, None] == ckey[None, :])] = -np.inf
            least = -np.partition(-product, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
            # slack keeps ties, which rounding may part, inside
            i, j = np.nonzero((product >= (least - _SLACK * longest * lengths[own])[:, None]) & np.isfinite(product))
            exact = np.concatenate([np.empty(0), *((q[own[i[at:at + PAIRS]]] * c[j[at:at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS))])
            order = np.lexsort((cid[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(own[i[best]])
            ids.append(cid[j[best]])
            scores.append(exact[best])
            live = live[~done]
            radius *= GROWTH
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query its k nearest found by inner product: query_id, rank, vec_id, score.

    A row is no candidate of its own query; only vectors of equal dimension
    meet; null, zero and unusable vectors take no part.  Rows repeated in id and vector
    are one row; rows that share an id alone are different ones.  Other columns
    aren't read; an empty table gives no row."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).alias("id"), v.alias("v"))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)))).first()[0] or 1.0

    def run(table: pa.Table) -> pa.Table:
        mark = np.asarray(table.column("q"))
        ids, key, v = np.asarray(table.column("id")), np.asarray(table.column("key")), matrix(table.column("v"), np.float64)
        if not mark.any() or mark.all():
            return pa.table({"query_id": ids[:0], "key": key[:0], "vec_id": ids[:0], "score": v[:0, 0]})
        own, others = once(key, mark)
        row, found, score = _search(key[own], v[own], key[others], ids[others], v[others], longest, k)
        return pa.table({"query_id": ids[own][row], "key": key[own][row], "vec_id": found, "score": score})

    found = (in_blocks(rows, is_query, QUERY_BLOCK, SHARD).groupBy("dim", "block", "shard")
             .applyInArrow(run, "query_id long, key long, vec_id long, score double"))
    return best_of_shards(found, k, "double")
