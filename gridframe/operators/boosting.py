"""Staged gradient boosting of many parameter combinations.

One chain of the most rounds serves every smaller number of estimators: a score
after ``k`` rounds is read as the chain passes them.  Rows are counted into
cells first, as boosting with squared loss sees a row only through its bins:
a cell is (fold, bins) with its rows, sum and sum of squares of the label, so
the data is read once and combined map-side.  Chains that draw rows keep a cell
per row.

Chains (a fold left out, a rate, a depth, ...) are independent of each other.
Where there are at most ``few_cells`` cells, which is counted, they are broadcast and every chain runs in
a task of its own.  Beyond that, all chains go on together: a level of all
their trees is one pass over the cells and one aggregate, and the cells with
their predictions so far are written every ``checkpoint_rounds`` rounds, so that
lineage stays short and an executor's loss costs those rounds at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forests as FO
from ..session import remove_scratch, write_scratch
from .forests import BINS, Rule, _c, _ranked, _uniform, descend, grow, grow_tops
from .selection import _written

FEW_CELLS = 1 << 17
CHECKPOINT_ROUNDS = 25


class Chain(NamedTuple):
    """Rounds of one model: the fold left out and scored (-1: none), the learning rate, the depth of a tree, the
    least rows of a node to split, the shares of rows and of features drawn per
    tree, and L1 and L2 penalties of leaf values."""

    held: int
    rounds: int
    rate: float = 0.1
    depth: int = 3
    least_split: int = 2
    subsample: float = 1.0
    colsample: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 42


def cells_of(rows: DataFrame, each_row: bool) -> DataFrame:
    """(id, fold, n, sy, syy, b): rows counted by fold and bins, or a cell per row."""
    if each_row:
        return rows.select("id", "fold", F.lit(1.0).alias("n"), F.col("y").alias("sy"), (F.col("y") * F.col("y")).alias("syy"), "b")
    cells = rows.groupBy("fold", "b").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    return cells.select(F.xxhash64("b").alias("id"), "fold", "n", "sy", "syy", "b")


def _columns(batch, p: int) -> tuple[np.ndarray, ...]:
    return (*(np.asarray(batch.column(k)) for k in range(5)), np.asarray(batch.column(5).flatten(), dtype=np.int64).reshape(-1, p))


def _drawn(chain: Chain, k: int, ids: np.ndarray) -> np.ndarray:
    """Which rows the k-th tree is grown on."""
    return np.ones(len(ids), dtype=bool) if chain.subsample >= 1 else _uniform(ids, chain.seed * 100_003 + k) < chain.subsample


def _features(chain: Chain, k: int, p: int) -> np.ndarray:
    """Which features the k-th tree may use."""
    take = max(1, round(chain.colsample * p))
    return np.arange(p) if take >= p else np.sort(np.random.default_rng((chain.seed, k)).choice(p, take, replace=False))


def _trained(chain: Chain, folds: np.ndarray, aside: int) -> np.ndarray:
    return (folds != chain.held) & (folds != aside)


def _rule(chain: Chain, tiny: float) -> Rule:
    return Rule(1.0, float(chain.least_split), tiny, chain.l1, chain.l2)


_SCORE = "chain int, rounds int, n double, sse double, sy double, syy double, gains array<double>, splits array<long>"


def _score(chain: int, rounds: int, held: tuple, f: np.ndarray, gains: np.ndarray, splits: np.ndarray) -> tuple:
    n, sy, syy = held
    return (chain, rounds, float(n.sum()), float((syy - 2 * f * sy + n * f * f).sum()), float(sy.sum()), float(syy.sum()), gains.tolist(), splits.tolist())


def run_chain(number: int, chain: Chain, cells: tuple[np.ndarray, ...], stages: Sequence[int], bins: int, aside: int) -> Iterator[tuple]:
    """Scores of one chain on its held fold after each stage's rounds, with the gain
    and the splits that each feature has had so far."""
    ids, folds, n, sy, syy, b = cells
    p = b.shape[1]
    fit = _trained(chain, folds, aside)
    bt, nt, idt, yt = b[fit], n[fit], ids[fit], sy[fit] / n[fit]
    ask = folds == chain.held
    bq, held = b[ask], (n[ask], sy[ask], syy[ask])
    base = float(sy[fit].sum() / nt.sum()) if len(nt) else 0.0
    tiny = 1e-12 * float(max(0.0, (syy[fit] - 2 * base * sy[fit] + nt * base * base).sum()))
    ft, fq = np.full(len(bt), base), np.full(len(bq), base)
    gains, splits = np.zeros(p), np.zeros(p, dtype=np.int64)
    for k in range(chain.rounds):
        use = _drawn(chain, k, idt)
        every = bool(use.all())
        bs, ys, ns = (bt, yt - ft, nt) if every else (bt[use], (yt - ft)[use], nt[use])
        node = np.zeros(len(bs), dtype=np.int64)
        tree = grow(bs, ys, ns, chain.depth, bins, _rule(chain, tiny), ns, _features(chain, k, p), node)
        if not every:
            node, _ = descend(tree, bt)
        ft += chain.rate * tree[4][node]
        fq += chain.rate * tree[4][descend(tree, bq)[0]]
        inner = tree[0] >= 0
        np.add.at(splits, tree[0][inner], 1)
        np.add.at(gains, tree[0][inner], tree_gains(tree, _rule(chain, tiny))[inner])
        if k + 1 in stages:
            yield _score(number, k + 1, held, fq, gains, splits)


def tree_gains(tree: tuple[np.ndarray, ...], rule: Rule) -> np.ndarray:
    """Each inner node's gain, from the values and rows of its children (weights being rows)."""
    feature, _, left, right, value, rows = tree
    w = rows + rule.l2
    # soft(s)^2 / (w + l2) is value^2 * (w + l2)
    score = value * value * w
    return np.where(feature >= 0, score[left] + score[right] - score, 0.0)


def boosted_scores(cells: DataFrame, chains: Sequence[Chain], stages: Sequence[int], p: int, bins: int = BINS, aside: int = -2,
                   few_cells: int = FEW_CELLS, checkpoint_rounds: int = CHECKPOINT_ROUNDS) -> DataFrame:
    """(chain, rounds, n, sse, sy, syy, gains, splits) of every chain at every stage it reaches."""
    size = cells.count()
    if size <= few_cells:
        return _in_tasks(cells, chains, stages, p, bins, aside)
    return _in_passes(cells, chains, stages, p, bins, aside, size, checkpoint_rounds)


def _in_tasks(cells: DataFrame, chains: Sequence[Chain], stages: Sequence[int], p: int, bins: int, aside: int) -> DataFrame:
    """A chain per row of a table of chains; the cells, a checked number of them, are broadcast."""
    spark = cells.sparkSession
    table = cells.orderBy("fold", "b", "id").toArrow().combine_chunks()
    held = spark.sparkContext.broadcast(_columns(table.to_batches()[0], p) if len(table) else tuple(
        np.empty((0, p) if k == 5 else 0) for k in range(6)))
    todo, marks = list(chains), set(stages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                found = list(run_chain(number, todo[number], held.value, marks, bins, aside))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), (
                        pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.list_(pa.float64()), pa.list_(pa.int64())))], names=[f.split()[0] for f in _SCORE.split(", ")])

    # the longest chains first, one to a task
    order = sorted(range(len(todo)), key=lambda i: -todo[i].rounds * 2 ** min(todo[i].depth, 10))
    numbers = spark.createDataFrame([(i,) for i in order], "number int").repartition(max(1, len(todo)))
    return _written(numbers.mapInArrow(run, _SCORE), "boosting")


def _in_passes(cells: DataFrame, chains: Sequence[Chain], stages: Sequence[int], p: int, bins: int, aside: int, size: int,
               checkpoint_rounds: int) -> DataFrame:
    """All chains round by round; the state of a cell is its prediction in every chain."""
    spark = cells.sparkSession
    todo = list(chains)
    sums = cells.groupBy("fold").agg(*[F.sum(x).alias(x) for x in ("n", "sy", "syy")]).collect()
    base, tiny = [], []
    for c in todo:
        n, sy, syy = (sum(r[x] for r in sums if r["fold"] not in (c.held, aside)) for x in ("n", "sy", "syy"))
        base.append(sy / n if n else 0.0)
        tiny.append(1e-12 * max(0.0, syy - sy * base[-1]))
    rules = [_rule(c, t) for c, t in zip(todo, tiny)]
    state, folder = write_scratch(cells.withColumn("f", F.lit(base).cast("array<double>")), "boosting")
    recent: list[list[tuple]] = [[] for _ in todo]  # trees since the state was written
    gains, splits, out = np.zeros((len(todo), p)), np.zeros((len(todo), p), dtype=np.int64), []

    def predictions(batch: pa.RecordBatch, b: np.ndarray, trees: list) -> np.ndarray:
        f = np.asarray(batch.column(6).flatten(), dtype=np.float64).reshape(-1, len(todo)).copy()
        for t, grown in enumerate(trees):
            for tree in grown:
                f[:, t] += todo[t].rate * tree[4][descend(tree, b)[0]]
        return f

    for k in range(max(c.rounds for c in todo)):
        going = [t for t, c in enumerate(todo) if k < c.rounds]
        before = spark.sparkContext.broadcast(recent)

        def part(batch: pa.RecordBatch, k=k, before=before):
            ids, folds, n, sy, _, b = _columns(batch, p)
            f = predictions(batch, b, before.value)

            def of(t: int):
                use = _trained(todo[t], folds, aside) & _drawn(todo[t], k, ids)
                bt = b[use]
                barred = np.setdiff1d(np.arange(p), _features(todo[t], k, p))
                if len(barred):
                    bt = bt.copy()
                    bt[:, barred] = 0  # one bin: no split
                return bt, n[use], n[use], (sy - n * f[:, t])[use]
            return of

        if not going:
            break
        tops = grow_tops(state, len(todo), size + 1, p, bins, part, rules, 0, [c.depth if k < c.rounds else 0 for c in todo])
        for t in going:
            tree = tops[t].arrays()
            recent[t] = [*recent[t], tree]
            inner = tree[0] >= 0
            np.add.at(splits[t], tree[0][inner], 1)
            np.add.at(gains[t], tree[0][inner], tree_gains(tree, rules[t])[inner])
        at_stage = [t for t in going if k + 1 in stages]
        if at_stage or (k + 1) % checkpoint_rounds == 0:
            done = spark.sparkContext.broadcast(recent)

            def moved(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    b = np.asarray(batch.column(5).flatten(), dtype=np.int64).reshape(-1, p)
                    f = predictions(batch, b, done.value)
                    flat = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * len(todo), f.ravel())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:6], flat], names=batch.schema.names)

            old, (state, folder) = folder, write_scratch(state.mapInArrow(moved, state.schema), "boosting")
            remove_scratch(spark, old)
            recent = [[] for _ in todo]
            for t in at_stage:
                f = F.get("f", F.lit(t))
                r = state.where(F.col("fold") == todo[t].held).agg(
                    F.sum("n").alias("n"), F.sum(F.col("syy") - 2 * f * F.col("sy") + F.col("n") * f * f).alias("sse"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy")).first()
                out.append((t, k + 1, *(float(r[x] or 0.0) for x in ("n", "sse", "sy", "syy")), gains[t].tolist(), splits[t].tolist()))
    remove_scratch(spark, folder)
    return spark.createDataFrame(out, _SCORE)


# ------------------------------------------------------------ grid search ---

BOOSTING_GRID = {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]}
SUBSAMPLED_GRID = {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7],
                   "subsample": [0.8, 1.0], "min_samples_split": [2, 5, 10]}
PENALISED_GRID = {"n_estimators": [100, 500], "max_depth": [3, 5], "learning_rate": [0.01, 0.1], "subsample": [0.8, 1.0],
                  "colsample_bytree": [0.8, 1.0], "reg_alpha": [0, 0.1], "reg_lambda": [1, 10]}


def chain_of(c: Mapping, held: int, rounds: int, seed: int = 42) -> Chain:
    return Chain(held, rounds, c.get("learning_rate", 0.1), c.get("max_depth", 3), c.get("min_samples_split", 2), c.get("subsample", 1.0),
                 c.get("colsample_bytree", 1.0), float(c.get("reg_alpha", 0.0)), float(c.get("reg_lambda", 0.0)), seed)


def boosting_grid_search(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], fold: str, folds: int,
                         grid: Mapping[str, Sequence] = BOOSTING_GRID, combinations: Sequence[Mapping] | None = None,
                         bins: int = BINS, seed: int = 42, few_cells: int = FEW_CELLS) -> DataFrame:
    """Cross-validated boosting for every combination of ``grid`` (or the given ones), with
    the columns of ``forests.forest_grid_search``: fold ``folds`` of the column ``fold``
    is the validation set of the refit on all other folds.  Combinations that differ
    in ``n_estimators`` alone are stages of one chain."""
    combos = [dict(c) for c in combinations] if combinations is not None else [dict(zip(grid, v)) for v in product(*grid.values())]
    cuts = FO.cut_points(df.where(_c(fold) < folds), features, bins)
    rows = FO.binned(df, features, label, key, fold, cuts)
    cells, folder = write_scratch(cells_of(rows, any(c.get("subsample", 1.0) < 1 for c in combos)), "boosting")
    longest: dict[Chain, int] = {}
    for c in combos:
        for held in range(folds + 1):
            alike = chain_of(c, held, 0, seed)
            longest[alike] = max(longest.get(alike, 0), c["n_estimators"])
    chains = [alike._replace(rounds=n) for alike, n in longest.items()]
    scores = boosted_scores(cells, chains, sorted({c["n_estimators"] for c in combos}), len(features), bins, folds, few_cells).collect()
    remove_scratch(df.sparkSession, folder)
    found = {(chains[r["chain"]]._replace(rounds=0), r["rounds"]): r for r in scores}
    out = []
    for c in combos:
        per = [found.get((chain_of(c, held, 0, seed), c["n_estimators"])) for held in range(folds + 1)]
        mse = [r["sse"] / r["n"] if r and r["n"] else None for r in per]
        known = [m for m in mse[:-1] if m is not None]
        last, spread = mse[-1], per[-1]["syy"] - per[-1]["sy"] ** 2 / per[-1]["n"] if per[-1] and per[-1]["n"] else 0.0
        out.append((c, float(np.mean(known)) if known else None, last, 1 - per[-1]["sse"] / spread if last is not None and spread > 0 else None))
    return _ranked(df, out)


def staged_boosting(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], held: str, stages: Sequence[int],
                    bins: int = BINS, few_cells: int = FEW_CELLS, **settings) -> DataFrame:
    """One chain of the most rounds, trained where the 0/1 column ``held`` is 0 and scored
    where it is 1: (rounds, n, mse, rmse, r2) per stage, and per feature the gain and the number of
    splits so far (``importance``: an array of feature, gain share, splits)."""
    cuts = FO.cut_points(df.where(_c(held) == 0), features, bins)
    rows = FO.binned(df, features, label, key, held, cuts)
    cells = _written(cells_of(rows, settings.get("subsample", 1.0) < 1), "boosting")
    chain = Chain(1, max(stages), **settings)
    s = boosted_scores(cells, [chain], stages, len(features), bins, -2, few_cells)
    total = F.aggregate("gains", F.lit(0.0), lambda a, x: a + x)
    share = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"),
                         F.transform("gains", lambda g: F.try_divide(g, total)).alias("gain"), F.col("splits"))
    mse = F.try_divide("sse", "n")
    spread = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    return s.select("rounds", F.col("n").cast("long").alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                    (1 - F.try_divide("sse", spread)).alias("r2"), share.alias("importance"))
