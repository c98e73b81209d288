"""Sets of word shingles as sorted arrays of 64-bit hashes, computed on bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  A word's hash is a sum of random byte codes times random odd
position factors; a shingle's hash combines the hashes of its words the same
way.  Texts are taken whole, in slices of about ``SLICE`` bytes, a longer text
being a slice of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gridframe.llm.common import mix64, stream64

SLICE = 1 << 19
ROWS = 512
WIDTH = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_CODE = stream64(256, 11)[_LOWER]
_CODE[_SPACE] = 0
_PLACE = stream64(WIDTH, 23)
_FACTOR = stream64(64, 37)


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts and the number of words of each text.

    ``bounds`` holds the texts' byte offsets in ``data``, first and last included."""
    global _FACTOR
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    heads = bounds[:-1][bounds[:-1] < n]
    start[heads] = ~space[heads]
    at = np.flatnonzero(start)
    if len(at) == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    place = np.zeros(n, dtype=np.int64)
    place[at] = np.diff(at, prepend=0)
    place = np.arange(n, dtype=np.int64) - np.cumsum(place)
    longest = int(np.diff(at, append=n).max())
    if longest > len(_FACTOR):
        _FACTOR = stream64(longest, 37)
    value = _CODE[data]
    place[: at[0]] = 0
    # the place of a space may exceed a word's length; its code is zero
    value *= _FACTOR[np.minimum(place, len(_FACTOR) - 1)]
    words = mix64(np.add.reduceat(value, at))
    counts = np.diff(np.searchsorted(at, bounds))
    return words, counts


def _sets_of(words: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(counts)
    total = len(words)
    rolled = np.zeros(max(0, total - WIDTH + 1), dtype=np.uint64)
    for k in range(WIDTH):
        rolled += words[k: k + len(rolled)] * _PLACE[k]
    rolled = mix64(rolled)
    for end, count in zip(ends.tolist(), counts.tolist()):
        first = end - count
        if count >= WIDTH:
            found = np.sort(rolled[first: end - WIDTH + 1])
            keep = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif count:
            mixed = (words[first:end] * _PLACE[:count]).sum(dtype=np.uint64)
            yield mix64(np.array([mixed + np.uint64(count)], dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text of an Arrow string array (null: empty), in order."""
    for at in range(0, len(texts), ROWS):
        yield from _sets_of_rows(texts.slice(at, ROWS))


def _sets_of_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        bounds = offsets[first: last + 1] - offsets[first]
        yield from _sets_of(*_word_hashes(data[offsets[first]: offsets[last]], bounds))
        first = last


def fingerprint(found: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    total = mix64(found).sum(dtype=np.uint64) + np.uint64(len(found))
    return int(mix64(np.array([total], dtype=np.uint64)).view(np.int64)[0])
