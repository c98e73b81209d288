"""N-gram Jaccard join by set relations, without losing a link.

Documents are sets of distinct five-word shingles; two are linked when
``100 * |intersection| >= 75 * |union|`` (both numbers are parameters).

1. Equal sets become one set, named by a 64-bit fingerprint, and the shingles'
   document counts are gathered over all documents in ``2**COUNT_BITS`` hashed
   counters, dealt by counter range.  Counters above 1/2**20 of all shingles,
   at most 2**20 of them, mark common shingles, which order last.
2. Each set indexes the first ``p = n - ceil(0.75 n) + 1`` shingles of that
   order.  All that two sets share lies in both prefixes, or after the last
   index shingle they share, or after the prefix that ends first; linked sets
   therefore share at least ``least_shared`` index shingles, and positions in
   the order bound what is still to come.
3. Relations between sets: short index lists are compared in full, in long
   ones each set only with a few leaders of its size.  Sets that prove similar
   form a class; the class answers for its members, so that the long lists are
   then probed only for sets of different classes.  There a list is sorted by
   size and cut into blocks; from the sizes, positions and numbers of shingles
   shared with other classes that a block holds, a probing set knows what it
   can share with any of them at most and skips the block whole.
4. Two sets that were compared with one leader differ as their differences
   from the leader do: the shingles of one and not the other.  How many of
   these differences they must have in common follows from numbers that are
   known.  Sets with a leader in common are therefore paired only if that is
   none, or if they meet in an index of the differences, rare ones first, at
   places with as many differences left as they need.
5. Pairs that share enough index shingles are checked exactly on the whole
   sets, and the links' components computed by star contraction.

No list, candidate or partner is capped.  Null text counts as empty; an empty
set is linked with nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import Rows, arrow_rows, materialise, mix64, power_of_two, shuffle_width
from gridframe.llm.components import components
from gridframe.llm.shingles import fingerprint, shingle_sets

NUM, DEN = 75, 100
COUNT_BITS = 28
FLUSH = 1 << 19          # shingles or index entries a task holds before it passes them on
SHORT_LIST = 8           # lists up to this long are compared in full at once
LEADERS = 2              # most central sets of a long list, by size band, that the others are first compared with
LATE = 8                 # a set is compared with a group's leader late if it shares this part of its prefix with the group
BLOCK = 64               # entries of an index list that are skipped together
GROUP_ENTRIES = 1 << 17  # index entries per group of lists
BLOOM_BITS = 22
BATCH = 500

_U64 = np.uint64


def _int64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _count_rows(shingles: np.ndarray, ranges: int) -> tuple[list[int], list[bytes], list[bytes]]:
    counters, counts = np.unique((shingles >> _U64(64 - COUNT_BITS)).astype(np.uint32), return_counts=True)
    cuts = np.searchsorted(counters, np.arange(ranges + 1, dtype=np.int64) * ((1 << COUNT_BITS) // ranges))
    out: tuple[list[int], list[bytes], list[bytes]] = ([], [], [])
    for k in range(ranges):
        own, times = counters[cuts[k]: cuts[k + 1]], counts[cuts[k]: cuts[k + 1]]
        if len(own):
            # gaps by byte plane: all planes but the lowest are almost zeros and compress away
            gaps = np.diff(own, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
            more = np.flatnonzero(times > 1)
            out[0].append(k)
            out[1].append(np.ascontiguousarray(gaps.T).tobytes())
            out[2].append(np.stack([more, times[more]]).astype("<u4").tobytes())
    return out


def _describe(ranges: int, id_type: pa.DataType):
    """Per document its set's size and name; per range of counters the counts."""
    names = ["id", "n", "fp", "part", "gaps", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = Rows(np.dtype(np.uint64), FLUSH), set()

        def flush() -> pa.RecordBatch:
            part, gaps, more = _count_rows(held.take(), ranges)
            k = len(part)
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(part, pa.int32()),
                 pa.array(gaps, pa.binary()), pa.array(more, pa.binary())], names)

        for batch in batches:
            n, fp = [], []
            for found in shingle_sets(batch.column(1)):
                n.append(len(found))
                fp.append(name := fingerprint(found))
                if len(found) and name not in seen:
                    seen.add(name)
                    held.more(len(found))[:] = found
                    if len(held) >= FLUSH:
                        yield flush()
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), pa.array(n, pa.int64()), pa.array(fp, pa.int64()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)
        if len(held):
            yield flush()

    return run


def _common(ranges: int, least: int):
    """Counters of at least ``least``, from the rows of whole ranges."""
    width = (1 << COUNT_BITS) // ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def emit() -> pa.RecordBatch:
            found = np.flatnonzero(total >= least)
            return pa.RecordBatch.from_arrays([_int64(found + at * width), _int64(total[found])], ["counter", "docs"])

        for batch in batches:
            for part, gaps, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if part != at:
                    if at is not None:
                        yield emit()
                    at, total = part, np.zeros(width, dtype=np.int64)
                own = np.cumsum(np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)
                times = np.ones(len(own), dtype=np.int64)
                if more:
                    where, many = np.frombuffer(more, "<u4").reshape(2, -1)
                    times[where] = many
                total[own - part * width] += times
        if at is not None:
            yield emit()

    return run


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _prefix(found: np.ndarray, counters: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The set's index shingles in global order: rarer ones first, common ones by count."""
    length = prefix_length(len(found))
    if len(counters):
        own = found >> _U64(64 - COUNT_BITS)
        where = np.minimum(np.searchsorted(counters, own), len(counters) - 1)
        common = counters[where] == own
        if common.any():
            rare = found[~common][:length]
            if len(rare) == length:
                return rare
            rest, times = found[common], docs[where[common]]
            return np.concatenate([rare, rest[np.lexsort((rest, times))]])[:length]
    return found[:length]


# a group's shingles differ in these 32 bits but for chance, which only adds to what a pair seems
# to share; a lower position than the true one only loosens a bound
_ENTRY = np.dtype([("token", "<u4"), ("fp", "<i8"), ("n", "<u4"), ("pos", "<u2")])
_TOP = np.iinfo(np.uint16).max


def least_shared(nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """How many index shingles two linked sets of these sizes share at least."""
    return _overlap(nx, ny) + 1 - np.maximum(-(-NUM * nx // DEN), -(-NUM * ny // DEN))


def _overlap(nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The least intersection of two linked sets of these sizes."""
    return -(-NUM * (nx + ny) // (NUM + DEN))


def _index(groups: int, shared):
    """Index entries, packed per group of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, docs = shared.value
        held, part, seen = Rows(_ENTRY, FLUSH), Rows(np.dtype(np.int32), FLUSH), set()

        def flush() -> pa.RecordBatch:
            entries, key = held.take(), part.take()
            seen.clear()
            order = np.argsort(key, kind="stable")
            key, entries = key[order], entries[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            cuts = [*first.tolist(), len(key)]
            return pa.RecordBatch.from_arrays(
                [pa.array(key[first]),
                 pa.array([entries[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["part", "entries"])

        for batch in batches:
            for found in shingle_sets(batch.column(0)):
                if not len(found) or (name := fingerprint(found)) in seen:
                    continue
                seen.add(name)
                tokens = _prefix(found, counters, docs)
                entry = held.more(len(tokens))
                entry["token"], entry["fp"], entry["n"] = tokens >> _U64(32), name, len(found)
                entry["pos"] = np.minimum(np.arange(len(tokens)), _TOP)
                part.more(len(tokens))[:] = tokens & _U64(groups - 1)
                if len(held) >= FLUSH:
                    yield flush()
        if len(held):
            yield flush()

    return run


def _sizes_fit(nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return np.minimum(nx, ny) * DEN >= NUM * np.maximum(nx, ny)


_PAIR = ["a", "b", "na", "nb", "pa", "pb", "shared"]
_PAIR_TYPE = "a long, b long, na int, nb int, pa int, pb int, shared int"
_LISTED = [*_PAIR, "entries"]


def _sum_pairs(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry pair per pair of sets, x the lesser: last positions of shingles
    shared in these lists, and how many they are."""
    swap = x["fp"] > y["fp"]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((y["fp"], x["fp"]))
    x, y, shared = x[order], y[order], shared[order]
    if not len(x):
        return x, y, shared
    first = np.flatnonzero(np.concatenate([[True], (x["fp"][1:] != x["fp"][:-1]) | (y["fp"][1:] != y["fp"][:-1])]))
    px, py = np.maximum.reduceat(x["pos"], first), np.maximum.reduceat(y["pos"], first)
    x, y, shared = x[first], y[first], np.add.reduceat(shared, first)
    x["pos"], y["pos"] = px, py
    return x, y, shared


def _pairs_batch(x: np.ndarray, y: np.ndarray, shared: np.ndarray, names: list[str]) -> pa.RecordBatch:
    x, y, shared = _sum_pairs(x, y, shared)
    columns = [_int64(x["fp"]), _int64(y["fp"])]
    columns += [pa.array(c.astype(np.int32)) for c in (x["n"], y["n"], x["pos"], y["pos"], shared)]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(x), pa.binary())] * (len(names) - len(columns)), names)


def _first_pairs(table: pa.Table) -> pa.Table:
    """A group's lists.  Rows of three kinds: pairs (a, b) of short lists; sets
    (a), with the number of their shingles in long lists as ``shared``; long
    lists (entries)."""
    entries = np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()])
    entries = entries[np.argsort(entries["token"], kind="stable")]
    same = entries["token"][1:] == entries["token"][:-1]
    keep = np.zeros(len(entries), dtype=bool)  # a list with one entry has no pairs
    keep[1:] |= same
    keep[:-1] |= same
    entries = entries[keep]
    entries = entries[np.lexsort((entries["fp"], entries["token"]))]
    fresh = np.ones(len(entries), dtype=bool)
    fresh[1:] = (entries["token"][1:] != entries["token"][:-1]) | (entries["fp"][1:] != entries["fp"][:-1])
    entries = entries[fresh]
    if not len(entries):
        return pa.Table.from_batches([_pairs_batch(entries, entries, np.empty(0, np.int64), _LISTED)])
    starts = np.flatnonzero(np.concatenate([[True], entries["token"][1:] != entries["token"][:-1]]))
    sizes = np.diff(starts, append=len(entries))
    length = np.repeat(sizes, sizes)
    out = []

    short, long = entries[length <= SHORT_LIST], entries[length > SHORT_LIST]
    for gap in range(1, SHORT_LIST):
        at = np.flatnonzero(short["token"][:-gap] == short["token"][gap:])
        at = at[_sizes_fit(short["n"][at].astype(np.int64), short["n"][at + gap].astype(np.int64))]
        out.append(_pairs_batch(short[at], short[at + gap], np.ones(len(at), np.int64), _LISTED))
    if len(long):
        part = table.column("part")[0].as_py()
        lists = [entries[p: p + size].tobytes() for p, size in zip(starts.tolist(), sizes.tolist()) if size > SHORT_LIST]
        k = len(lists)
        out.append(pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64())] * 2 + [pa.array([part] * k, pa.int32())] + [pa.nulls(k, pa.int32())] * 4 + [pa.array(lists, pa.binary())], _LISTED))
        fps, counts = np.unique(long["fp"], return_counts=True)
        k = len(fps)
        out.append(pa.RecordBatch.from_arrays(
            [_int64(fps), pa.nulls(k, pa.int64())] + [pa.nulls(k, pa.int32())] * 4
            + [pa.array(counts.astype(np.int32)), pa.nulls(k, pa.binary())], _LISTED))
    return pa.Table.from_batches(out)


_CLASSED = np.dtype([(name, "<i8") for name in ("fp", "root", "n", "pos", "most", "ref", "both", "lack")])
# a set in the index of differences from its leader; both: what it shares with the leader, lack: what of the
# leader it lacks
_APART = np.dtype([(name, "<i8") for name in ("fp", "root", "n", "pos", "both", "lack")])


def _probe(entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of different classes in one list that the bounds allow.

    Entries are sorted by size.  Blocks of them carry their least and greatest
    size, the most index shingles a set shares with another class, the most
    shingles after the position, and the class if it is one: an entry skips
    blocks that hold only its own class, sets of other sizes, or sets that
    cannot share enough with it.  Two sets with the same leader must be linked by
    what they share with it alone (``_apart_pairs`` finds the others)."""
    entries = entries[np.lexsort((entries["root"], entries["n"]))]
    cuts = np.arange(0, len(entries), BLOCK)
    low, high = np.minimum.reduceat(entries["n"], cuts), np.maximum.reduceat(entries["n"], cuts)
    most, rest = np.maximum.reduceat(entries["most"], cuts), np.maximum.reduceat(entries["n"] - entries["pos"], cuts)
    least_root, most_root = np.minimum.reduceat(entries["root"], cuts), np.maximum.reduceat(entries["root"], cuts)
    for k in range(len(cuts)):
        own = entries[cuts[k]: cuts[k] + BLOCK]
        there = np.arange(k, len(cuts))
        there = there[high[k] * DEN >= NUM * low[there]]
        shared, overlap = np.minimum(most[k], most[there]), _overlap(low[k], low[there])
        there = there[(shared >= overlap + 1 - -(-NUM * high[there] // DEN)) & (shared + np.minimum(rest[k], rest[there]) > overlap)]
        if least_root[k] == most_root[k]:
            there = there[(least_root[there] != least_root[k]) | (most_root[there] != least_root[k])]
        for j in there.tolist():
            other = entries[cuts[j]: cuts[j] + BLOCK]
            i, o = np.nonzero(own["root"][:, None] != other["root"][None, :])
            if j == k:
                i, o = i[i < o], o[i < o]
            x, y = own[i], other[o]
            shared, overlap = np.minimum(x["most"], y["most"]), _overlap(x["n"], y["n"])
            ok = (_sizes_fit(x["n"], y["n"]) & (shared >= least_shared(x["n"], y["n"]))
                  & (shared + np.minimum(x["n"] - x["pos"], y["n"] - y["pos"]) > overlap)
                  & ((x["ref"] != y["ref"]) | (x["both"] - y["lack"] >= overlap)))
            if ok.any():
                yield x[ok], y[ok]


def _probe_apart(entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of different classes that share a difference from their
    leader, if both have as many differences from there on as they must share.

    Of the differences that two sets share, the first has all others after it;
    so the lists of frequent differences, which come last, give few pairs."""
    if (entries["root"] == entries["root"][0]).all():
        return
    size = entries["n"] - entries["both"] + entries["lack"]
    order = np.lexsort((entries["root"], size))
    entries, size = entries[order], size[order]
    left = size - entries["pos"]
    cuts = np.arange(0, len(entries), BLOCK)
    least, most_left, high = size[cuts], np.maximum.reduceat(left, cuts), np.maximum.reduceat(entries["n"], cuts)
    least_root, most_root = np.minimum.reduceat(entries["root"], cuts), np.maximum.reduceat(entries["root"], cuts)
    for k in range(len(cuts)):
        own, own_left = entries[cuts[k]: cuts[k] + BLOCK], left[cuts[k]: cuts[k] + BLOCK]
        there = np.arange(k, len(cuts))
        # linked sets differ in at most this many shingles, twice those needed less
        differ = (high[k] + high[there]) * (DEN - NUM) // (NUM + DEN)
        there = there[2 * np.minimum(most_left[k], most_left[there]) >= least[k] + least[there] - differ]
        if least_root[k] == most_root[k]:
            there = there[(least_root[there] != least_root[k]) | (most_root[there] != least_root[k])]
        for j in there.tolist():
            other, other_left = entries[cuts[j]: cuts[j] + BLOCK], left[cuts[j]: cuts[j] + BLOCK]
            i, o = np.nonzero(own["root"][:, None] != other["root"][None, :])
            if j == k:
                i, o = i[i < o], o[i < o]
            x, y = own[i], other[o]
            needed = _overlap(x["n"], y["n"]) - x["both"] + y["lack"]
            ok = _sizes_fit(x["n"], y["n"]) & (needed > 0) & (np.minimum(own_left[i], other_left[o]) >= needed)
            if ok.any():
                yield x[ok], y[ok]


def _by_list(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The lists in rows (list, *names) sorted by list, one at a time."""
    held: list[np.ndarray] = []
    at = None
    kind = np.dtype([(name, "<i8") for name in names])
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        rows = np.empty(len(key), dtype=kind)
        for name, column in zip(names, batch.columns[1:]):
            rows[name] = column.to_numpy()
        for p, q in zip(cuts, cuts[1:]):
            if key[p] != at:
                if held:
                    yield at, np.concatenate(held)
                held, at = [], key[p]
            held.append(rows[p:q])
    if held:
        yield at, np.concatenate(held)


def _led_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of each list with its leaders: those of their size that have
    the largest part of their shingles in long lists, as a text has that many
    others were copied from."""
    for _, rows in _by_list(batches, ["fp", "n", "k"]):
        # sets of one band have sizes close enough for a link
        band = np.floor(np.log(rows["n"]) / -np.log((NUM + DEN) / (2 * DEN))).astype(np.int64)
        order = np.lexsort((rows["fp"], -rows["k"] / rows["n"], band))
        rows, band = rows[order], band[order]
        new = np.concatenate([[True], band[1:] != band[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        for k in range(LEADERS):
            at = np.flatnonzero(lead + k < np.arange(len(rows)))
            x, y = rows[lead[at] + k], rows[at]
            ok = np.minimum(x["k"], y["k"]) > 0
            a, b = np.minimum(x["fp"], y["fp"])[ok], np.maximum(x["fp"], y["fp"])[ok]
            yield pa.RecordBatch.from_arrays(
                [_int64(a), _int64(b), _int64(least_shared(x["n"], y["n"])[ok]), _int64(np.minimum(x["k"], y["k"])[ok]), _int64(x["fp"][ok])],
                ["a", "b", "least_shared", "most", "leader"])


def _mixed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists that hold sets of several classes, with their least set: the
    lists of one passage mostly have the same."""
    names = ["fp", "root", "n", "pos"]
    for key, rows in _by_list(batches, names):
        if (rows["root"] != rows["root"][0]).any():
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, key)), pa.array(np.full(k, rows["fp"].min())), *(_int64(rows[x]) for x in names)],
                ["list", "lead", *names])


def _second_pairs(names: list[str], probe):
    """Rows sorted by (lead, list): the pairs that ``probe`` finds in each list,
    summed over the lists of a lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, lead = [], 0, None

        def together() -> tuple[np.ndarray, ...]:
            return _sum_pairs(*map(np.concatenate, zip(*held)))

        for _, rows in _by_list(batches, ["lead", *names]):
            if size and rows["lead"][0] != lead:
                yield _pairs_batch(*together(), _PAIR)
                held, size = [], 0
            lead = rows["lead"][0]
            for x, y in probe(rows):
                held.append((x, y, np.ones(len(x), np.int64)))
                size += len(x)
                if size >= FLUSH:
                    held = [together()]
                    size = len(held[0][0])
                    if size >= FLUSH // 2:
                        yield _pairs_batch(*held[0], _PAIR)
                        held, size = [], 0
        if size:
            yield _pairs_batch(*together(), _PAIR)

    return run


def _unpack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            e = np.frombuffer(packed, _ENTRY)
            name = (e["token"].astype(np.int64) << 31) + part
            yield pa.RecordBatch.from_arrays([_int64(name), *(_int64(e[x]) for x in ("fp", "n", "pos"))], ["list", "fp", "n", "pos"])


def _sets_in(shared, kind: type):
    """Whole sets, as the upper bits of ``kind``, of the documents whose set's
    name may be in a bit map."""
    drop = _U64(64 - 8 * np.dtype(kind).itemsize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            fps, sets, held, seen = [], [], 0, set()
            for found in shingle_sets(batch.column(0)):
                name = fingerprint(found)
                if len(found) and bits[name & ((1 << BLOOM_BITS) - 1)] and name not in seen:
                    seen.add(name)
                    fps.append(name)
                    sets.append((found >> drop).astype(kind).tobytes())
                    held += len(found)
                    if held >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], ["fp", "members"])
                        fps, sets, held = [], [], 0
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], ["fp", "members"])

    return run


def _compared(kind: type, marks: list[str]):
    """Sizes and intersection of each pair's whole sets.  Shingles that are equal
    in the bits given count as equal: with fewer bits, no linked pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.empty((3, batch.num_rows), dtype=np.int64)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                sizes[:2, k] = len(x), len(y)
                if len(x) > len(y):
                    x, y = y, x
                where = np.minimum(np.searchsorted(y, x), len(y) - 1)
                sizes[2, k] = (y[where] == x).sum()
            kept = ["a", "b", *marks]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(_int64, sizes)], [*kept, "na", "nb", "both"])

    return run


_LINKED = f"{DEN} * both >= {NUM} * (na + nb - both)"


def _whole_sets(wanted: DataFrame, texts: DataFrame, kind: type = np.uint64) -> DataFrame:
    """(fp, members) of the sets named in the column ``fp`` of ``wanted``, and some others.

    Sets are computed again from the texts; a bit map of fixed size lets most
    sets that are not wanted stay where they are."""
    spark = wanted.sparkSession
    mask = (1 << BLOOM_BITS) - 1
    bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
    found = wanted.select(F.col("fp").bitwiseAND(F.lit(mask)).alias("bit")).distinct().toArrow()
    bits[found.column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(bits)
    sets = texts.mapInArrow(_sets_in(shared, kind), "fp long, members binary")
    return sets.groupBy("fp").agg(F.first("members").alias("members"))


def _check(pairs: DataFrame, texts: DataFrame, kind: type = np.uint64) -> DataFrame:
    """The candidate pairs with na, nb and both, by the whole sets; columns
    beside a and b are kept."""
    marks = [c for c in pairs.columns if c not in ("a", "b")]
    sets = _whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")), texts, kind)
    x = sets.select(F.col("fp").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("members").alias("y"))
    kept = "".join(f"{c} long, " for c in ["a", "b", *marks])
    return (pairs.join(x, "a").join(y, "b").select("a", "b", *marks, "x", "y")
            .mapInArrow(_compared(kind, marks), f"{kept}na long, nb long, both long"))


def _leaders(compared: DataFrame) -> DataFrame:
    """Per set (fp) one leader that holds at least half of it, as ``ref``, how
    many shingles it shares with it (``both``) and how many of it it lacks (``lack``).

    Of several it is the one that most sets were compared with, so that the
    sets of a group mostly name the same; a leader counts itself."""
    led = compared.where("leader is not null")
    near = led.selectExpr("leader as ref", "if(leader = a, b, a) as fp", "both", "if(leader = a, nb, na) as n", "if(leader = a, na, nb) - both as lack").where("2 * both >= n").select("ref", "fp", "both", "lack")
    own = led.selectExpr("leader as ref", "leader as fp", "if(leader = a, na, nb) as both", "0L as lack").distinct()
    known = near.groupBy("ref").agg(F.count("*").alias("times"))
    return (near.union(own).join(known, "ref").groupBy("fp")
            .agg(F.max_by(F.struct("ref", "both", "lack"), F.struct("times", "ref")).alias("best")).select("fp", "best.ref", "best.both", "best.lack"))


def _late_pairs(mixed: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs (a, b, leader) of the sets in ``mixed`` that have no leader yet with
    the leader that most sets of their lists name, if these are lists of
    ``1/LATE`` of the set's prefix.

    A set that meets a group in fewer lists hardly has half of its shingles in
    common with the leader, and needs none: a leader only tightens bounds."""
    named = mixed.select("list", "fp", "n").join(leaders, "fp", "left")
    usual = (named.where("ref is not null").groupBy("list", "ref").agg(F.count("*").alias("times"))
             .groupBy("list").agg(F.max_by("ref", F.struct("times", "ref")).alias("usual")))
    return (named.where("ref is null").join(usual, "list").groupBy("fp", "n", "usual").agg(F.count("*").alias("lists"))
            .where(f"{LATE} * lists > n + floor(-{NUM} * n / {DEN})").groupBy("fp")
            .agg(F.max_by("usual", F.struct("lists", "usual")).alias("leader"))
            .selectExpr("least(fp, leader) as a", "greatest(fp, leader) as b", "leader"))


def _late_leaders(mixed: DataFrame, leaders: DataFrame, texts: DataFrame) -> DataFrame:
    """Leaders (fp, ref, both, lack) of the sets in ``mixed`` that have none yet: too
    few shared index shingles kept them from a comparison."""
    compared = _check(materialise(_late_pairs(mixed, leaders), "late"), texts)
    return (compared.selectExpr("if(leader = a, b, a) as fp", "leader as ref", "both", "if(leader = a, nb, na) as n", "if(leader = a, na, nb) - both as lack")
            .where("2 * both >= n").select("fp", "ref", "both", "lack"))


def _differences(x: np.ndarray, y: np.ndarray, counters: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The first differences of the set ``x`` from its leader ``y``, in an order
    that depends on the leader only: by how many sets of the group are likely to
    have them, which for a shingle outside the leader are the documents that hold
    it and for one of the leader's those that don't.

    Linked sets differ in at most a third of their sizes, so the first difference
    they share is one of those given here."""
    def held(found: np.ndarray) -> np.ndarray:
        if not len(counters):
            return np.zeros(len(found), np.int64)
        own = found >> _U64(64 - COUNT_BITS)
        where = np.minimum(np.searchsorted(counters, own), len(counters) - 1)
        return np.where(counters[where] == own, docs[where], 0).astype(np.int64)

    more, lack = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
    found = np.concatenate([more, lack])
    times = np.concatenate([held(more), 1 + held(y).max(initial=0) - held(lack)])
    return found[np.lexsort((found, times))][: len(x) * (DEN - NUM) // NUM + 1]


def _apart(shared):
    """A row per difference of a set from its leader."""
    names = [name for name in _APART.names if name != "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column("ref").to_numpy()
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                found = _differences(x, y, *shared.value)
                if len(found):
                    own = {c: pa.array(np.full(len(found), batch.column(c)[k].as_py(), np.int64)) for c in names}
                    own["pos"] = _int64(np.arange(len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [_int64(mix64(found + refs[k: k + 1].view(np.uint64))), *(own[c] for c in _APART.names)], ["list", *_APART.names])

    return run


def _apart_pairs(sets: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """Pairs (a, b) of sets with one leader that can be linked by the differences
    from it that they share.  ``sets``: fp, root, n, ref, both, lack."""
    sets = sets.where("ref <> fp")
    whole = _whole_sets(sets.select(F.explode(F.array("fp", "ref")).alias("fp")), texts)
    x, y = whole.select("fp", F.col("members").alias("x")), whole.select(F.col("fp").alias("ref"), F.col("members").alias("y"))
    lists = (sets.join(x, "fp").join(y, "ref").select("fp", "root", "n", "ref", "both", "lack", "x", "y")
             .mapInArrow(_apart(shared), "list long, " + ", ".join(f"{c} long" for c in _APART.names))
             .select("list", F.lit(0).cast("long").alias("lead"), *_APART.names).repartition("list").sortWithinPartitions("list"))
    return lists.mapInArrow(_second_pairs(list(_APART.names), _probe_apart), _PAIR_TYPE).select("a", "b").distinct()


def _summed(listed: DataFrame) -> DataFrame:
    """One row per pair; ``enough``: with what it shares in the given lists, the
    pair can be linked if it shares nothing in other lists."""
    overlap = f"-floor(-{NUM} * (na + nb) / {NUM + DEN})"
    marks = [F.max("probed").alias("probed")] if "probed" in listed.columns else []
    return (listed.groupBy("a", "b", "na", "nb")
            .agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.sum("shared").alias("shared"), *marks)
            .withColumn("least_shared", F.expr(f"{overlap} + 1 - greatest(-floor(-{NUM} * na / {DEN}), -floor(-{NUM} * nb / {DEN}))"))
            .withColumn("enough", F.expr(f"shared >= least_shared and shared + least(na - pa, nb - pb) > {overlap}")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles`` and ``component_id``, the
    least id that links reach, its own included.

    Rows may repeat an id; each is a document of its own.  A null id is never
    the least one; a component of null ids only has a null component_id.
    Other columns are not read, whatever their names."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    sql_type = id_type.simpleString()
    arrow_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[sql_type]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with arrow_rows(spark, BATCH):
        rows, known = _rows_and_classes(source, sql_type, arrow_type)
    names = rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"))
    named = (names.join(known.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    leasts = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(leasts, "root").select("fp", "component")
    return (rows.join(classes, "fp", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")))


def _rows_and_classes(source: DataFrame, sql_type: str, arrow_type: pa.DataType) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, fp) of all documents, and (node, root) of the sets that have links."""
    spark = source.sparkSession
    texts = source.select("text").where("text is not null")
    ranges = power_of_two(shuffle_width(spark))

    found = materialise(source.mapInArrow(
        _describe(ranges, arrow_type), f"id {sql_type}, n long, fp long, part int, gaps binary, more binary"), "sets")
    rows = found.where("part is null").select("id", "n", "fp")
    total = rows.agg(F.sum("n")).first()[0] or 0

    counted = (found.where("part is not null").select("part", "gaps", "more")
               .repartition(ranges, "part").sortWithinPartitions("part")
               .mapInArrow(_common(ranges, max(16, -(-total >> 20))), "counter long, docs long").toArrow())
    order = np.argsort(counted.column(0).to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast(tuple(counted.column(k).to_numpy()[order].astype(np.uint64) for k in (0, 1)))

    groups = power_of_two(max(shuffle_width(spark), total / 4 / GROUP_ENTRIES))
    listed = materialise(
        texts.mapInArrow(_index(groups, shared), "part int, entries binary").groupBy("part")
        .applyInArrow(_first_pairs, f"{_PAIR_TYPE}, entries binary"), "pairs")
    listed_pairs = listed.where("b is not null").drop("entries")
    lists = listed.where("entries is not null").select("entries", F.col("na").alias("part")).mapInArrow(_unpack_lists, "list long, fp long, n long, pos long")
    # pairs that the short lists alone let pass, and pairs with leaders of long lists
    pairs = _summed(listed_pairs)
    in_long = listed.where("a is not null and b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("shared").alias("k"))
    led = (lists.join(in_long, "fp").select("list", "fp", "n", "k").repartition("list").sortWithinPartitions("list")
           .mapInArrow(_led_pairs, "a long, b long, least_shared long, most long, leader long")
           .groupBy("a", "b", "least_shared", "most").agg(F.max("leader").alias("leader"))
           .join(pairs.select("a", "b", "shared"), ["a", "b"], "left")
           .where("most + coalesce(shared, 0) >= least_shared").select("a", "b", "leader"))
    pairs = materialise(pairs.where("enough").select("a", "b", F.lit(None).cast("long").alias("leader")).union(led), "pairs")
    compared = materialise(_check(pairs, texts), "compared")
    known = components(compared.where(_LINKED).select("a", "b"))

    # the rest: sets of different classes that meet in a long list
    roots = known.withColumnRenamed("node", "fp")
    lists = (lists.join(roots, "fp", "left").select("list", "fp", F.coalesce("root", "fp").alias("root"), "n", "pos")
             .repartition("list").sortWithinPartitions("list"))
    mixed = materialise(lists.mapInArrow(_mixed_lists, "list long, lead long, fp long, root long, n long, pos long"), "lists")
    across = (listed_pairs.groupBy("a", "b").agg(F.sum("shared").alias("k"))
              .join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
              .where("coalesce(ra, a) <> coalesce(rb, b)"))
    leaders = materialise(_leaders(compared), "leaders")
    leaders = leaders.union(_late_leaders(mixed, leaders, texts))
    most = (mixed.groupBy("fp").agg(F.count("*").alias("k"), F.first("root").alias("root"), F.first("n").alias("n"))
            .join(across.select(F.explode(F.array("a", "b")).alias("fp"), "k").groupBy("fp").agg(F.max("k").alias("k2")), "fp", "left")
            .join(leaders, "fp", "left")
            .selectExpr("fp", "root", "n", "k + coalesce(k2, 0) as most", "coalesce(ref, fp) as ref", "coalesce(both, n) as both", "coalesce(lack, 0) as lack"))
    most = materialise(most, "most")
    probed = (mixed.join(most.drop("root", "n"), "fp").select("list", "lead", *_CLASSED.names)
              .repartition("lead").sortWithinPartitions("lead", "list")
              .mapInArrow(_second_pairs(list(_CLASSED.names), _probe), _PAIR_TYPE))
    probed = materialise(probed, "probed")
    if not most.isEmpty():
        pairs = _summed(listed_pairs.withColumn("probed", F.lit(False)).union(probed.withColumn("probed", F.lit(True))))
        pairs = materialise(pairs.where("probed and enough").select("a", "b").union(_apart_pairs(most, texts, shared)).distinct(), "pairs")
        # few of these pairs are linked: half of each shingle's bits tell most of the others
        pairs = materialise(_check(pairs, texts, np.uint32).where(_LINKED).select("a", "b"), "pairs")
        links = materialise(_check(pairs, texts).where(_LINKED).select("a", "b"), "links")
        known = components(known.toDF("a", "b").union(links))
    return rows, known
