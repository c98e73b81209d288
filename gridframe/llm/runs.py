"""Periodic runs of words, by a suffix automaton with link-cut access.

The automaton of a stretch of words has a tree of suffix links; the node of a
prefix and its ancestors stand for all the prefix's suffixes.  When word ``i`` is
appended, the path from its prefix's node to the root is accessed: every node on
it takes ``i`` as its last end.  Nodes of one former last end ``j`` lie on the
path in one segment.  Let its deepest node have length ``l``: the ``l`` words up to
``j`` and those up to ``i`` are the same, so ``l >= i - j`` is a square of period
``i - j``, and it is extended to both sides to a whole run.  The first square of
a run has its smallest period: a primitive word occurs in its square only at
the two halves, so its last end is that period ago.

The tree is finished before the first access, so the preferred paths that an
access changes are held on the tree's heavy paths: the colours of a heavy path
are a stack of segments, of which an access replaces the upper ones.  That is
O(log n) heavy paths an access and O(n log n) segments in all.

Only stretches that can hold a run get an automaton.  A run of smallest period
``q`` has at least max(6, 4 q) words, so each of its 5-grams occurs again ``q``
words before or after: stretches are maximal rows of 5-grams with another
occurrence no further off than a quarter of the stretch.  Nothing else is
skipped, and a run never reaches beyond its stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import mix64, stream64

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
_GRAM = 5
_PLACE = stream64(_GRAM, 41)
_STEP = 64


class _Automaton:
    """Suffix links and lengths of the states of a word sequence; ``ends[i]`` is
    the state of the prefix that ends at word ``i``.

    Most states have one transition, which is kept in two lists; a dictionary is
    only made for further ones."""

    def __init__(self, words: list[int]) -> None:
        link, length, word, target = [-1], [0], [-1], [-1]
        more: dict[int, dict[int, int]] = {}
        ends, last = [], 0
        for c in words:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            word.append(-1)
            target.append(-1)
            p, q = last, -1
            while p != -1:
                if word[p] == -1:
                    word[p], target[p] = c, new
                elif word[p] == c:
                    q = target[p]
                    break
                elif p in more:
                    q = more[p].setdefault(c, new)
                    if q != new:
                        break
                    q = -1
                else:
                    more[p] = {c: new}
                p = link[p]
            if p != -1:
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    word.append(word[q])
                    target.append(target[q])
                    if q in more:
                        more[clone] = more[q].copy()
                    while p != -1:
                        if word[p] == c:
                            if target[p] != q:
                                break
                            target[p] = clone
                        elif p in more and more[p].get(c) == q:
                            more[p][c] = clone
                        else:
                            break
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
            ends.append(new)
        self.link, self.length, self.ends = link, length, ends

    def heads(self) -> list[int]:
        """The top node of each node's heavy path."""
        link, length = self.link, self.length
        order = np.argsort(np.array(length), kind="stable").tolist()
        size, heavy = [1] * len(link), [-1] * len(link)
        for v in reversed(order[1:]):
            u = link[v]
            size[u] += size[v]
            if heavy[u] == -1 or size[v] > size[heavy[u]]:
                heavy[u] = v
        head = list(range(len(link)))
        for v in order[1:]:
            if heavy[link[v]] == v:
                head[v] = head[link[v]]
        return head


def _squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares, by end: each run's first one with its smallest period among them."""
    tree = _Automaton(words)
    link, length, head = tree.link, tree.length, tree.heads()
    colours: list[list[tuple[int, int]] | None] = [None] * len(link)
    for i, u in enumerate(tree.ends):
        while u > 0:
            top, deep = head[u], length[u]
            path = colours[top]
            if path is None:
                path = colours[top] = []
            reach = 0
            while path and path[-1][0] <= deep:
                reach, j = path.pop()
                if reach >= i - j:
                    yield i, i - j
            # a segment that goes on below the accessed node is cut there
            if path and reach < deep >= i - path[-1][1]:
                yield i, i - path[-1][1]
            path.append((deep, i))
            u = link[top]


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common prefix, compared in growing blocks."""
    at, step, n = 0, _STEP, min(len(a), len(b))
    while at < n:
        same = a[at: at + step][: n - at] == b[at: at + step][: n - at]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), step * 2
    return at


def _runs_of_stretch(ids: np.ndarray) -> list[tuple[int, int, int]]:
    found, done = [], {}
    for end, period in _squares(ids.tolist()):
        if end < done.get(period, 0):
            continue
        first, last = end - 2 * period + 1, end + 1
        last += _matching(ids[last:], ids[last - period:])
        first -= _matching(ids[:first][::-1], ids[: first + period][::-1])
        done[period] = last
        if last - first >= max(LEAST_LENGTH, LEAST_EXPONENT * period):
            found.append((first, last - first, period))
    return found


def _stretches(near: np.ndarray) -> list[tuple[int, int]]:
    """Maximal rows of 5-grams whose nearest other occurrence is at most a quarter
    of the row away, as first word and end; ``near``: the nearest occurrences."""
    todo, out = [(0, len(near))], []
    while todo:
        first, last = todo.pop()
        kept = np.concatenate(([False], near[first:last] <= (last - first + _GRAM - 1) // LEAST_EXPONENT, [False]))
        if kept[1:-1].all():
            if last > first + LEAST_LENGTH - _GRAM:
                out.append((first, last + _GRAM - 1))
            continue
        edges = np.flatnonzero(np.diff(kept)).reshape(-1, 2) + first
        todo.extend((int(a), int(b)) for a, b in edges if b - a > LEAST_LENGTH - _GRAM)
    return out


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of at least max(6, 4 periods)
    words, by start, then period.  ``ids``: one number per word, equal for equal words."""
    n = len(ids) - _GRAM + 1
    if n <= LEAST_LENGTH - _GRAM:
        return []
    grams = np.zeros(n, dtype=np.uint64)
    values = ids.astype(np.uint64)
    for k in range(_GRAM):
        grams += mix64(values[k: k + n] + np.uint64(1)) * _PLACE[k]
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    gap = np.where(ordered[1:] == ordered[:-1], np.diff(order), len(ids))
    near = np.empty(n, dtype=np.int64)
    ends = np.array([len(ids)])
    near[order] = np.minimum(np.concatenate((gap, ends)), np.concatenate((ends, gap)))
    found = []
    for first, last in _stretches(near):
        found.extend((first + s, length, q) for s, length, q in _runs_of_stretch(ids[first:last]))
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word's first place."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), dtype=np.int64, count=len(words))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the registered query's planted period (null id: as they are)."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a: a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


_REPORT = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"),
           ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def _report(words: list[bytes]) -> tuple:
    runs = find_runs(word_ids(words))
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = words
    if runs:
        keep = kept_words(len(words), runs).tolist()
        kept = [w for w, k in zip(words, keep) if k]
    return (len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _words(text: bytes | None) -> list[bytes]:
    # bytes.split() parts at 0x20 and 0x09-0x0D only
    return text.split() if text else []


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, the number of runs, the longest run
    and digests of all runs and of the words left when runs are collapsed.

    Null and empty texts, and texts without a word, have no run, null figures
    and the digests of empty text.  Repeated rows and null ids give a row each;
    other columns, whatever their names, aren't read; an empty table gives no
    row.  ``planted``: words are first rewritten by ``planted_period``.  A text
    is one task's work, of O(n log n) time in its repeated stretches."""
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            rows = []
            for key, text in zip(keys, texts):
                words = _words(text.as_py())
                rows.append(_report(planted_period(words, key.as_py()) if planted else words))
            columns = [pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(zip(*rows), _REPORT)]
            if rows:
                yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", *(name for name, _ in _REPORT)])

    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} {t}" for n, t in _REPORT)).withColumnRenamed("key", id_col)


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each text's kept words, joined by one space (null stays null)."""
    name = docs.schema.names.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(name).cast(pa.large_binary()):
                words = _words(text.as_py())
                keep = kept_words(len(words), find_runs(word_ids(words))).tolist()
                out.append(None if not text.is_valid else b" ".join(w for w, k in zip(words, keep) if k).decode())
            yield batch.set_column(name, batch.schema.field(name), pa.array(out, pa.string()).cast(batch.schema.field(name).type))

    return docs.mapInArrow(run, docs.schema)
