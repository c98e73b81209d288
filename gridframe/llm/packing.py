"""Packing: length buckets of least padding, and batches within a token budget.

The global histogram of lengths (all documents) gives the bucket boundaries by
dynamic programming: with K buckets, each padded to its longest member, the
boundaries' total padding is the least possible.  Documents of a bucket are then
numbered, and every ``budget // bucket length`` of them form a batch (a document
longer than the budget is a batch of its own).

The driver holds the histogram, one small row per different length.  n different
lengths take at least n * (n - 1) / 2 words, so their number grows at most with
the square root of the input; none is rounded, and the boundaries are optimal at
every size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import materialise, shuffle_width


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over ascending ``lengths`` that
    minimise sum(count * (end - length)).

    The cost of a bucket from i to j is ``length[j] * docs - tokens``; the best
    last start grows with j (the quadrangle inequality), so each layer is solved
    by halving, all midpoints of a level at once."""
    n = len(lengths)
    if n == 0:
        return []
    docs = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = lengths * docs[1:]  # one bucket; the tokens' sum is the same for all choices
    starts = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        layer, start = np.full(n, np.inf), np.zeros(n, np.int64)
        tasks = [(0, n - 1, 0, n - 1)]
        while tasks:
            following = []
            for low, high, first, last in tasks:
                j = (low + high) // 2
                i = np.arange(max(first, 1), min(last, j) + 1)
                if len(i):
                    cost = best[i - 1] + lengths[j] * (docs[j + 1] - docs[i])
                    k = int(np.argmin(cost))
                    layer[j], start[j] = cost[k], i[k]
                if not len(i) or best[j] <= layer[j]:
                    layer[j], start[j] = best[j], -1  # no further cut helps
                split = start[j] if start[j] >= 0 else first
                if low < j:
                    following.append((low, j - 1, first, split if start[j] >= 0 else last))
                if j < high:
                    following.append((j + 1, high, split, last))
            tasks = following
        best = layer
        starts.append(start)
    ends, j, k = [], n - 1, len(starts) - 1
    while j >= 0:
        ends.append(int(lengths[j]))
        while k and starts[k][j] < 0:
            k -= 1
        j, k = int(starts[k][j]) - 1, max(k - 1, 0)
    return ends[::-1]


def word_count(text_col: str = "text"):
    """The number of words between spaces; null and blank texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text_col, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")), F.lit(0))


def pack(docs: DataFrame, buckets: int = 16, budget: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its
    bucket) and padding.  Empty texts have length 0 and form batches like others.

    Rows are numbered by partition and then over the partitions' counts, so no
    bucket passes through one task."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), word_count(text_col).cast("long").alias("n_tokens"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    rows = materialise(rows, "lengths")
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("docs"))
    found = np.array([(r.n_tokens, r.docs) for r in histogram.collect()], dtype=np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    ends = optimal_boundaries(found[:, 0].astype(np.float64), found[:, 1], buckets)

    bucket, length = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, end in reversed(list(enumerate(ends))):
        bucket, length = F.when(F.col("n_tokens") <= end, k).otherwise(bucket), F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(length)
    parts = shuffle_width(spark)
    rows = rows.withColumns({"bucket": bucket, "bucket_len": length, "part": F.pmod("h", F.lit(parts))})
    sizes = rows.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(
        Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    own = Window.partitionBy("bucket", "part").orderBy("id", "h")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))))
    return (rows.withColumn("rank", F.row_number().over(own) - 1).join(before, ["bucket", "part"])
            .select(F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_len",
                    F.floor((F.col("before") + F.col("rank")) / per_batch).cast("long").alias("batch"),
                    (F.col("bucket_len") - F.col("n_tokens")).alias("padding")))
