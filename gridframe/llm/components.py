"""Connected components of a large edge list, by star contraction.

Every round first points the larger neighbours of a node, then the smaller
ones, at the least node known; the edges end as one star per component.  A
node with very many neighbours is only ever aggregated (``min``) and joined,
never collected.  Each partition first reduces its own edges to a spanning
forest, so chains are short before the first shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    side = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return side.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns.  Returns (node, root), root being the least
    node of the component; nodes that are their own root are left out.

    Empty input gives an empty result; repeated edges and loops do no harm."""
    a, b = edges.columns
    e = (edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
         .mapInArrow(_forest, "a long, b long").checkpoint())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.toDF("node", "root")
        seen = state
        e = _small_star(_large_star(e)).checkpoint()
