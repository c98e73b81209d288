"""Tree ensembles for whole parameter grids in shared passes.

Features are binned once (exact quantile cut points), and all trees of all
folds and combinations grow together: a level of all their open nodes is one
pass over the rows, which counts (tree, node, feature, bin) per task, and one
aggregate that sums the counts and takes each node's best split.  Nodes of at
most ``few_rows`` rows are finished by one task each, so the passes end at that
size and no task holds more rows.

Many combinations are the same tree read differently.  Fewer estimators are a
prefix of the trees; a smaller depth and a greater least node size to split are
the same tree, left earlier.  Only the least leaf size and the bootstrap change
the splits, and without a bootstrap all trees of a family are one.  So a grid
grows (leaf sizes x bootstraps x trees x folds) trees, and every combination is
read off them.  The rows that a tree doesn't train on take the same way through
it, so predictions are made where the nodes are, and finished trees never leave
their tasks.

Splits are least squares on bins, ties to the first feature and bin.  Bootstrap
weights are Poisson(1) by a hash of (row, tree): repeatable, whatever the
partitions.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove_scratch, write_scratch
from .selection import quantiles_of

BINS = 32
FEW_ROWS = 16_384
MOST_DEPTH = 30  # stands for "no limit"
_PARTS = 256
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 20)))))


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# ---------------------------------------------------------------- binning ---

def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Ascending cut points per feature (at most ``bins - 1``): a value's bin is the
    number of cut points below it, and a split at bin b is ``x <= cuts[b]``."""
    found = quantiles_of(df, features, [i / bins for i in range(1, bins)])
    return [sorted(set(found.get(f) or [])) for f in features]


def binned(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], fold: str | None,
           cuts: Sequence[Sequence[float]]) -> DataFrame:
    """(id, fold, y, b): a hash of the key columns, the fold, the label and an array of
    bins; rows with a null label, feature or fold are left out."""
    def bin_of(i: int, f: str) -> Column:
        x = _c(f).cast("double")
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[i]]), lambda c: c < x)) if cuts[i] else F.lit(0)

    rows = df.select(F.xxhash64(*[_c(k) for k in key]).alias("id"), (_c(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
                     _c(label).cast("double").alias("y"), *[_c(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).na.drop()
    return rows.select("id", "fold", "y", F.array(*[bin_of(i, f"x{i}") for i in range(len(features))]).cast("array<int>").alias("b"))


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """Hashed numbers in [0, 1), by row and seed."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def bootstrap_weights(ids: np.ndarray, seed: int | None) -> np.ndarray:
    """Poisson(1) numbers; one each without a seed."""
    return np.ones(len(ids)) if seed is None else np.searchsorted(_POISSON, _uniform(ids, seed), side="right").astype(np.float64)


# ------------------------------------------------------------------ trees ---

class Tree:
    """A growing tree on the driver: feature (-1: none yet), bin, left and right
    child, value and training rows of each node."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.right, self.value, self.rows = [], [], [], [], [], []

    def add(self, value: float, rows: int) -> int:
        for column, x in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.value, value), (self.rows, rows)):
            column.append(x)
        return len(self.value) - 1

    def split(self, node: int, feature: int, at: int, left: int, right: int) -> None:
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, left, right

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.left, self.right, self.value, self.rows))


class Rule(NamedTuple):
    """When a node may split: rows on each side, rows in it, least gain; L1 and L2
    penalties of leaf values."""

    least: float = 1.0
    least_split: float = 2.0
    tiny: float = 0.0
    l1: float = 0.0
    l2: float = 0.0

    def soft(self, s: np.ndarray) -> np.ndarray:
        return s if self.l1 == 0 else np.sign(s) * np.maximum(np.abs(s) - self.l1, 0.0)

    def value(self, s, w):
        return self.soft(s) / (w + self.l2)


def descend(tree: tuple[np.ndarray, ...], b: np.ndarray, readouts: Sequence[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Each row's last node, and its value at each readout (depth, least rows to
    split): that of the first node that is as deep, has fewer rows, or is the last."""
    feature, at, left, right, value, rows = tree
    n = len(b)
    node, every = np.zeros(n, dtype=np.int64), np.arange(n)
    values = np.empty((n, len(readouts)))
    moving, depth = np.ones(n, dtype=bool), 0
    open_ = [np.ones(n, dtype=bool) for _ in readouts]
    while True:
        moving &= feature[node] >= 0
        for k, (most, least) in enumerate(readouts):
            stop = open_[k] & (~moving | (depth >= most) | (rows[node] < least))
            values[stop, k] = value[node[stop]]
            open_[k] &= ~stop
        if not moving.any():
            return node, values
        go = every[moving]
        here = node[go]
        node[go] = np.where(b[go, feature[here]] <= at[here], left[here], right[here])
        depth += 1


def best_splits(count: np.ndarray, weight: np.ndarray, total: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """From (nodes, features, bins) sums of rows, weights and weighted labels: each node's best gain
    (-inf: none), its feature and bin, and (rows, weight, total) of the left side and of the node."""
    c, s = (np.cumsum(x, axis=2) for x in (count, total))
    w = c if weight is count else np.cumsum(weight, axis=2)
    m, p, bins = count.shape
    whole = [x[:, 0, -1] for x in (c, w, s)]
    ca, wa, sa = (x[:, :, -1:] for x in (c, w, s))
    c, w, s = (x[:, :, :-1] for x in (c, w, s))
    fine = (c >= rule.least) & (ca - c >= rule.least) & (w > 0) & (wa - w > 0) & (ca >= rule.least_split)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = rule.soft(s) ** 2 / (w + rule.l2) + rule.soft(sa - s) ** 2 / (wa - w + rule.l2) - rule.soft(sa) ** 2 / (wa + rule.l2)
    flat = np.where(fine, gain, -np.inf).reshape(m, -1)
    if not flat.shape[1]:
        nothing = np.zeros(m, dtype=np.int64)
        return np.full(m, -np.inf), nothing, nothing, whole, whole
    best, every = flat.argmax(axis=1), np.arange(m)
    left = [x.reshape(m, -1)[every, best] for x in (c, w, s)]
    return flat[every, best], best // (bins - 1), best % (bins - 1), left, whole


def grow(b: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, bins: int, rule: Rule = Rule(), n: np.ndarray | None = None,
         features: np.ndarray | None = None, where: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """A tree of all rows as arrays, level by level, all nodes of a level at once.
    ``n``: rows that each row stands for (else one; ``w`` itself: weights that are rows are summed once);
    ``features``: those that may split; ``where``: zeros, which become each row's last node."""
    p = b.shape[1]
    used = np.arange(p) if features is None else features
    q, offsets = len(used), np.arange(len(used)) * bins
    wy, one = w * y, n is None
    levels = [[np.array([-1]), np.array([-1]), np.array([-1]), np.array([-1]),
               np.array([rule.value(wy.sum(), w.sum()) if len(y) and w.sum() > 0 else 0.0]), np.array([float(len(y)) if one else n.sum()])]]
    rows, slot, first = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 0
    bu = b[:, used]
    for _ in range(depth):
        last = levels[-1]
        # nodes too small for two sides are leaves without a look at their bins
        able = np.flatnonzero(last[5] >= max(2 * rule.least, rule.least_split))
        m, slots = len(able), np.full(len(last[0]), -1, dtype=np.int64)
        slots[able] = np.arange(m)
        slot = slots[slot]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        if not len(rows):
            break
        at = ((slot * q * bins)[:, None] + offsets + bu[rows]).ravel()
        shape, size = (m, q, bins), m * q * bins
        count = (np.bincount(at, minlength=size).astype(np.float64) if one else np.bincount(at, np.repeat(n[rows], q), size)).reshape(shape)
        weight = count if n is w else np.bincount(at, np.repeat(w[rows], q), size).reshape(shape)
        total = np.bincount(at, np.repeat(wy[rows], q), size).reshape(shape)
        gain, feature, cut, left, whole = best_splits(count, weight, total, rule)
        good = gain > rule.tiny
        k = int(good.sum())
        if not k:
            break
        child = np.full(m, -1, dtype=np.int64)
        child[good] = np.arange(k) * 2
        after, split = first + len(last[0]), able[good]
        for column, x in enumerate((used[feature[good]], cut[good], after + child[good], after + child[good] + 1)):
            last[column] = np.full(len(last[0]), -1)
            last[column][split] = x
        sides = [np.stack((x[good], a[good] - x[good]), axis=1).ravel() for x, a in zip(left, whole)]
        none = np.full(2 * k, -1)
        levels.append([none, none, none, none, rule.value(sides[2], sides[1]), sides[0]])
        stay = good[slot]
        rows, slot = rows[stay], slot[stay]
        slot = child[slot] + (bu[rows, feature[slot]] > cut[slot])
        if where is not None:
            where[rows] = after + slot
        first = after
    return tuple(np.concatenate(x) for x in zip(*levels))


# ----------------------------------------------------------------- forest ---

class Spec(NamedTuple):
    """One tree: the fold it is scored on, its least leaf size, and the seed of its
    weights (None: all rows once)."""

    family: int
    number: int
    held: int
    least: int
    seed: int | None


def _trains(spec: Spec, folds: np.ndarray, aside: int) -> np.ndarray:
    return (folds != spec.held) & (folds != aside)


def _matrix(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, ...]:
    ids, folds, y = (np.asarray(batch.column(k)) for k in range(3))
    return ids, folds, y, np.asarray(batch.column(3).flatten(), dtype=np.int64).reshape(-1, p)


def _level(rows: DataFrame, tops: list[tuple], open_: dict[int, list[int]], p: int, bins: int, part, rules: Sequence[Rule]) -> list:
    """Each open node's best split and both sides' sums: one pass, one aggregate.
    ``part(batch)`` gives a function from a tree's number to (bins, rows, weights, weighted labels)."""
    shared = rows.sparkSession.sparkContext.broadcast((tops, open_))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, open_ = shared.value
        sums = {t: np.zeros((3, len(nodes) * p * bins)) for t, nodes in open_.items()}
        for batch in batches:
            of = part(batch)
            for t, nodes in open_.items():
                b, *parts = of(t)
                node, _ = descend(tops[t], b)
                slots = np.full(len(tops[t][0]), -1)
                slots[nodes] = np.arange(len(nodes))
                use = np.flatnonzero(slots[node] >= 0)
                at = ((slots[node[use]] * p * bins)[:, None] + np.arange(p) * bins + b[use]).ravel()
                for k, x in enumerate(parts):
                    sums[t][k] += np.bincount(at, np.repeat(x[use], p), sums[t].shape[1])
        for t, s in sums.items():
            at = np.flatnonzero(s[0])
            node = np.array(open_[t])[at // (p * bins)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(at), t), node, at // bins % p, at % bins, *s[:, at])],
                                             names=["tree", "node", "feature", "bin", "c", "w", "s"])

    cells = rows.mapInArrow(count, "tree long, node long, feature long, bin long, c double, w double, s double")
    cells = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(x).alias(x) for x in "cws"])
    along = Window.partitionBy("tree", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("tree", "node", "feature")
    sides = cells.select("tree", "node", "feature", "bin", *[F.sum(x).over(along).alias(x) for x in "cws"], *[F.sum(x).over(whole).alias(f"{x}a") for x in "cws"])

    def of_tree(field: str) -> Column:
        return F.element_at(F.lit([float(getattr(r, field)) for r in rules]), (F.col("tree") + 1).cast("int"))

    def share(s: Column, w: Column) -> Column:
        kept = F.greatest(F.abs(s) - of_tree("l1"), F.lit(0.0))
        return kept * kept / (w + of_tree("l2"))

    rest = {x: F.col(f"{x}a") - F.col(x) for x in "cws"}
    fine = (F.col("c") >= of_tree("least")) & (rest["c"] >= of_tree("least")) & (F.col("ca") >= of_tree("least_split")) & (F.col("w") > 0) & (rest["w"] > 0)
    gain = F.when(fine, share(F.col("s"), F.col("w")) + share(rest["s"], rest["w"]) - share(F.col("sa"), F.col("wa")))
    return sides.withColumn("gain", gain).groupBy("tree", "node").agg(
        F.max_by(F.struct("feature", "bin", "c", "w", "s", "ca", "wa", "sa", "gain"),
                 F.struct(F.coalesce("gain", F.lit(float("-inf"))), -F.col("feature"), -F.col("bin"))).alias("best")).collect()


def grow_tops(rows: DataFrame, trees: int, n: int, p: int, bins: int, part, rules: Sequence[Rule], few_rows: int,
              depths: Sequence[int]) -> list[Tree]:
    """The upper nodes of all trees: those of more than ``few_rows`` rows, and their
    children.  With at most ``few_rows`` rows in all, just the roots."""
    tops = [Tree() for _ in range(trees)]
    for t in tops:
        t.add(0.0, n)
    open_ = {t: [0] for t in range(trees) if depths[t] > 0} if n > few_rows else {}
    for level in range(max(depths, default=0)):
        if not open_:
            break
        found = _level(rows, [t.arrays() for t in tops], open_, p, bins, part, rules)
        open_ = {}
        for r in found:
            t, node, best = r["tree"], r["node"], r["best"]
            tree, rule = tops[t], rules[t]
            tree.value[node], tree.rows[node] = float(rule.value(best["sa"], best["wa"])), int(best["ca"])
            if best["gain"] is None or best["gain"] <= rule.tiny:
                continue
            sides = []
            for c, w, s in ((best["c"], best["w"], best["s"]), (best["ca"] - best["c"], best["wa"] - best["w"], best["sa"] - best["s"])):
                sides.append(tree.add(float(rule.value(s, w)), int(c)))
                if c > few_rows and level + 1 < depths[t]:
                    open_.setdefault(t, []).append(sides[-1])
            tree.split(node, best["feature"], best["bin"], *sides)
    return tops


def forest_predictions(rows: DataFrame, specs: Sequence[Spec], readouts: Sequence[tuple[int, int]], p: int,
                       bins: int = BINS, aside: int = -2, few_rows: int = FEW_ROWS) -> DataFrame:
    """(id, y, fold, family, number, values): what each tree says of the rows of its
    held fold, at each readout (depth, least rows to split)."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var")).first()
    n, centre = size["n"], size["mean"] or 0.0
    depth = max(d for d, _ in readouts)
    rules = [Rule(least=s.least, tiny=1e-12 * n * (size["var"] or 0.0)) for s in specs]

    def part(batch: pa.RecordBatch):
        ids, folds, y, b = _matrix(batch, p)

        def of(t: int):
            w = bootstrap_weights(ids, specs[t].seed) * _trains(specs[t], folds, aside)
            use = w > 0
            return b[use], np.ones(int(use.sum())), w[use], w[use] * (y[use] - centre)
        return of

    tops = grow_tops(rows, len(specs), n, p, bins, part, rules, few_rows, [depth] * len(specs))
    shared = rows.sparkSession.sparkContext.broadcast((list(specs), [t.arrays() for t in tops]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specs, tops = shared.value
        for batch in batches:
            ids, folds, y, b = _matrix(batch, p)
            for t, spec in enumerate(specs):
                w = bootstrap_weights(ids, spec.seed) * _trains(spec, folds, aside)
                asked = folds == spec.held
                use = np.flatnonzero((w > 0) | asked)
                node, _ = descend(tops[t], b[use])
                # a large node that doesn't split is a leaf: only the rows that ask go on, in parts
                large = tops[t][5][node] > few_rows
                go = ~large | asked[use]
                use, node, part = use[go], node[go], np.where(large, ids[use] % _PARTS, 0)[go].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(use), t, dtype=np.int32)), pa.array(node), pa.array(part), batch.column(0).take(pa.array(use)), pa.array(folds[use]),
                    pa.array(y[use]), pa.array(w[use]), batch.column(3).take(pa.array(use))], names=["tree", "node", "part", "id", "fold", "y", "w", "b"])

    dealt = rows.mapInArrow(deal, "tree int, node long, part int, id long, fold int, y double, w double, b array<int>")

    def finish(table: pa.Table) -> pa.Table:
        specs, tops = shared.value
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        y, w = np.asarray(table.column("y")), np.asarray(table.column("w"))
        b = np.asarray(table.column("b").combine_chunks().flatten(), dtype=np.int64).reshape(-1, p)
        ask = np.asarray(table.column("fold")) == specs[t].held
        fit = w > 0
        top = tops[t]
        above = _depth_of(top, node)
        if fit.any() and top[5][node] <= few_rows:
            below = grow(b[fit], y[fit] - centre, w[fit], depth - above, bins, rules[t])
        else:
            below = tuple(np.array([x]) for x in (-1, -1, -1, -1, float(top[4][node]), int(top[5][node])))
        q = b[ask]
        _, upper = descend(top, q, readouts)
        _, lower = descend(below, q, [(d - above, s) for d, s in readouts])
        reached = _reaches(top, node, readouts)
        values = np.where(reached, lower, upper) + centre
        flat = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * len(readouts), values.ravel())
        m = int(ask.sum())
        return pa.table([table.column("id").filter(pa.array(ask)), pa.array(y[ask]), pa.array(np.full(m, specs[t].held, dtype=np.int32)),
                         pa.array(np.full(m, specs[t].family, dtype=np.int32)), pa.array(np.full(m, specs[t].number, dtype=np.int32)), flat],
                        names=["id", "y", "fold", "family", "number", "values"])

    return dealt.groupBy("tree", "node", "part").applyInArrow(finish, "id long, y double, fold int, family int, number int, values array<double>")


def _path(tree: tuple[np.ndarray, ...], node: int) -> list[int]:
    parent = {int(c): k for k, (a, b) in enumerate(zip(tree[2], tree[3])) for c in (a, b) if c >= 0}
    out = [node]
    while out[-1] in parent:
        out.append(parent[out[-1]])
    return out[::-1]


def _depth_of(tree: tuple[np.ndarray, ...], node: int) -> int:
    return len(_path(tree, node)) - 1


def _reaches(tree: tuple[np.ndarray, ...], node: int, readouts: Sequence[tuple[int, int]]) -> np.ndarray:
    """Whether a readout goes down to ``node`` (it doesn't where an upper node ends it)."""
    path = _path(tree, node)
    return np.array([all(d < most and tree[5][v] >= least for d, v in enumerate(path[:-1])) for most, least in readouts])


# ------------------------------------------------------------ grid search ---

FOREST_GRID = {"n_estimators": [50, 100, 200], "max_depth": [10, 20, None], "min_samples_split": [2, 5, 10],
               "min_samples_leaf": [1, 2, 4], "bootstrap": [True, False]}


def forest_grid_search(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], fold: str, folds: int,
                       grid: Mapping[str, Sequence] = FOREST_GRID, combinations: Sequence[Mapping] | None = None,
                       bins: int = BINS, seed: int = 42, few_rows: int = FEW_ROWS) -> DataFrame:
    """Cross-validated random forests for every combination of ``grid`` (or the given ones).

    Folds ``0 .. folds-1`` of the column ``fold`` are trained and scored on in
    turn; fold number ``folds`` is the validation set of the refit: trees that
    train on all other folds and are scored there.  Both come from the same passes.
    Returns per combination: its parameters, ``cv_mse`` (mean over folds), ``refit_mse`` and
    ``refit_r2`` (on the validation fold), ``place`` (by cv_mse) and ``chosen``."""
    combos = [dict(c) for c in combinations] if combinations is not None else [dict(zip(grid, v)) for v in product(*grid.values())]
    cuts = cut_points(df.where(_c(fold) < folds), features, bins)
    rows, folder = write_scratch(binned(df, features, label, key, fold, cuts), "forest")
    trees = max(c["n_estimators"] for c in combos)
    families = sorted({(c["min_samples_leaf"], c["bootstrap"]) for c in combos})
    readouts = sorted({(c["max_depth"] or MOST_DEPTH, c["min_samples_split"]) for c in combos})
    specs = [Spec(k, i, held, least, seed + i if boot else None)
             for k, (least, boot) in enumerate(families) for held in range(folds + 1) for i in range(trees if boot else 1)]
    said = forest_predictions(rows, specs, readouts, len(features), bins, folds, few_rows)
    sizes = sorted({c["n_estimators"] for c in combos})
    # sums over the first trees of each size, combined map-side
    sums = [F.sum(F.when(F.col("number") < n, F.get("values", F.lit(k)))).alias(f"s{n}_{k}") for n in sizes for k in range(len(readouts))]
    per_row = said.groupBy("id", "y", "fold", "family").agg(F.count(F.lit(1)).alias("n"), *sums)
    errors = [(F.col("y") - F.col(f"s{n}_{k}") / F.least(F.lit(n), F.col("n"))) ** 2 for n in sizes for k in range(len(readouts))]
    per_fold = per_row.groupBy("family", "fold").agg(F.var_pop("y").alias("vy"), F.array(*[F.avg(e) for e in errors]).alias("mse")).collect()
    remove_scratch(df.sparkSession, folder)
    mse = {(r["family"], r["fold"]): r for r in per_fold}
    out = []
    for c in combos:
        k = families.index((c["min_samples_leaf"], c["bootstrap"]))
        at = sizes.index(c["n_estimators"]) * len(readouts) + readouts.index((c["max_depth"] or MOST_DEPTH, c["min_samples_split"]))
        scored = [mse[(k, f)]["mse"][at] for f in range(folds) if (k, f) in mse]
        last = mse.get((k, folds))
        out.append((c, float(np.mean(scored)) if scored else None, last["mse"][at] if last else None,
                    1 - last["mse"][at] / last["vy"] if last and last["vy"] else None))
    return _ranked(df, out)


def _ranked(df: DataFrame, scored: list[tuple]) -> DataFrame:
    """Combinations with their scores, place by cv_mse (ties: the first given), chosen."""
    order = sorted(range(len(scored)), key=lambda i: (scored[i][1] is None, scored[i][1] or 0.0, i))
    place = {i: k + 1 for k, i in enumerate(order)}
    rows = [(i, ", ".join(f"{k}={v}" for k, v in c.items()), cv, mse, r2, place[i], place[i] == 1) for i, (c, cv, mse, r2) in enumerate(scored)]
    return df.sparkSession.createDataFrame(rows, "combination int, params string, cv_mse double, refit_mse double, refit_r2 double, place int, chosen boolean")


def sampled(grid: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` different combinations of the grid, by a seeded draw."""
    every = [dict(zip(grid, v)) for v in product(*grid.values())]
    return random.Random(seed).sample(every, min(n, len(every)))
