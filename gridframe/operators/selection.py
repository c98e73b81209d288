"""Exact quantiles by distributed selection.

``percentile`` merges a map of a group's different values in one task.  Here the
wanted ranks are located by radix passes instead.  A double becomes a signed
64-bit key of the same order; a pass counts rows per (group, column, leading
bits of the key), with the bin's least and greatest value, combined map-side.
Running counts tell which bin holds each wanted rank, and the next pass looks at
the rows of those bins only, ``DIGIT_BITS`` further bits at a time: four passes
resolve any key.  A bin of one value is done at once, however many rows share
it, and bins of at most ``FEW_ROWS`` rows are sorted, half a megabyte each.  So no
buffer grows with the rows or values of a group: bins are at most 2**16 per
wanted one, whatever the data.

The state of a pass (group, column, rank, bin) is a written table, never
collected, so there may be as many groups as the data has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, remove_scratch, write_scratch

DIGIT_BITS = 16
FEW_ROWS = 1 << 16
FEW_TARGETS = 100_000  # bins looked into that are broadcast; a row of some 100 bytes each
_NAN_KEY, _INF_KEY = 0x7FF8000000000000, 0x7FF0000000000000


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def order_key(x: Column) -> Column:
    """A long that orders doubles as Spark does: -inf < ... < 0 < ... < inf < NaN.
    Exponent and mantissa come from exact arithmetic (divisions by powers of two)."""
    a = F.abs(x)
    two = F.lit(2.0)
    guess = F.floor(F.log2(a)).cast("double")
    # log2 may be off by one next to a power of two
    e = guess + F.when(a >= F.pow(two, guess + 1), 1).when(a < F.pow(two, guess), -1).otherwise(0)
    normal = (e + 1023).cast("long") * F.lit(1 << 52) + ((a / F.pow(two, e) - 1.0) * float(1 << 52)).cast("long")
    tiny = (a * 2.0 ** 537 * 2.0 ** 537).cast("long")
    size = (F.when(F.isnan(x), F.lit(_NAN_KEY)).when(a == float("inf"), F.lit(_INF_KEY))
             .when(a < 2.0 ** -1022, tiny).otherwise(normal))
    return F.when(x < 0, -size).otherwise(size)


def _written(df: DataFrame, name: str) -> DataFrame:
    return write_scratch(df, name)[0]


def _wanted(n: Column, probs: Sequence[float]) -> Column:
    """The 0-based ranks on both sides of each quantile's position."""
    ranks = [f((n - 1) * F.lit(float(p))).cast("long") for p in probs for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*ranks))


def _located(bins: DataFrame, by: list[str], ranks: Column) -> DataFrame:
    """(by, rank, bin, rank in the bin, rows, least, greatest) of the bins that hold ranks."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = bins.withColumn("upto", F.sum("rows").over(w)).withColumn("ranks", ranks)
    held = F.filter("ranks", lambda r: (r["at"] >= F.col("upto") - F.col("rows")) & (r["at"] < F.col("upto")))
    out = run.select(*by, "rows", "bin", "least", "greatest", (F.col("upto") - F.col("rows")).alias("before"), F.explode(held).alias("r"))
    return out.select(*[c for c in by if c != "prefix"], F.col("r.rank").alias("rank"), F.col("bin").alias("prefix"),
                      (F.col("r.at") - F.col("before")).alias("at"), "rows", "least", "greatest")


def rank_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group: Sequence[str] = (),
                few_rows: int | None = None) -> DataFrame:
    """(g, c, n, rank, value): the values at the wanted 0-based ranks of each group
    (a struct) and column (its place) among the ``n`` non-null values."""
    few_rows = FEW_ROWS if few_rows is None else few_rows
    ensure_checkpoint_dir(df.sparkSession)
    keys = F.struct(*[_c(g).alias(f"g{i}") for i, g in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))
    narrow = df.select(keys.alias("g"), *[_c(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    narrow, folder = write_scratch(narrow, "selection")
    cells = narrow.select("g", F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(columns))])).alias("c", "v"))
    cells = cells.where(F.col("v").isNotNull()).select("g", "c", (F.col("v") + F.lit(0.0)).alias("v"), order_key(F.col("v")).alias("k"))
    counted = [F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("greatest")]

    shift = 64 - DIGIT_BITS
    bins = _written(cells.groupBy("g", "c", F.shiftright("k", shift).alias("bin")).agg(*counted), "selection")
    sizes = bins.groupBy("g", "c").agg(F.sum("rows").alias("n"))
    ranks = F.transform(_wanted(F.col("n"), probs), lambda r: F.struct(r.alias("rank"), r.alias("at")))
    state = _written(_located(bins.join(sizes, ["g", "c"]), ["g", "c"], ranks), "selection")
    done = [state.where("least = greatest").select("g", "c", "rank", F.col("least").alias("value"))]
    while shift:
        open_ = state.where("least < greatest")
        tally = open_.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).first()
        if not tally["n"]:
            break
        targets = open_.select("g", "c", "prefix").distinct()
        targets = F.broadcast(targets) if tally["n"] <= FEW_TARGETS else targets
        inside = cells.withColumn("prefix", F.shiftright("k", shift)).join(targets, ["g", "c", "prefix"])
        if tally["most"] <= few_rows:
            sets = inside.groupBy("g", "c", "prefix").agg(F.sort_array(F.collect_list("v")).alias("vs"))
            found = open_.join(sets, ["g", "c", "prefix"]).select("g", "c", "rank", F.get("vs", F.col("at").cast("int")).alias("value"))
            done.append(_written(found, "selection"))
            break
        shift = max(0, shift - DIGIT_BITS)
        bins = inside.groupBy("g", "c", "prefix", F.shiftright("k", shift).alias("bin")).agg(*counted)
        wanted = open_.groupBy("g", "c", "prefix").agg(F.collect_list(F.struct("rank", "at")).alias("ranks"))
        state = _written(_located(bins.join(wanted, ["g", "c", "prefix"]), ["g", "c", "prefix"], F.col("ranks")), "selection")
        done.append(state.where("least = greatest").select("g", "c", "rank", F.col("least").alias("value")))
    remove_scratch(df.sparkSession, folder)  # what follows reads the small tables only
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.join(sizes, ["g", "c"])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group..., column, n, q): the exact quantiles of each column in each group, an array
    in the order of ``probs``, linear between ranks as pandas and ``percentile``
    give them.  Nulls don't count, NaN is the greatest value, null group keys
    are a group, and a column without values in a group has no row."""
    values = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    per = rank_values(df, columns, probs, group).groupBy("g", "c").agg(F.max("n").alias("n"), values.alias("m"))

    def at(p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(place).cast("long"), F.ceil(place).cast("long")
        low, high = F.element_at("m", lo), F.element_at("m", hi)
        return F.when((lo == hi) | (low == high), low).otherwise((hi - place) * low + (place - lo) * high)

    names = F.array(*[F.lit(c) for c in columns])
    return per.select(*[F.col(f"g.g{i}").alias(g) for i, g in enumerate(group)], F.get(names, F.col("c")).alias("column"),
                      "n", F.array(*[at(p) for p in probs]).alias("q"))


def quantiles_of(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """The quantiles of each column that has values, as numbers: columns x probs of them."""
    return {r["column"]: r["q"] for r in exact_quantiles(df, columns, probs).collect()}
