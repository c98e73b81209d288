"""BPE encoding by per-prefix dynamic programming, and decoding.

A word's encoding is unique, and so is the last token of each of its prefixes:
the vocabulary token that ends there such that it can follow the last
token of what is before it.  Tokens that end at a position come from a suffix
automaton of the vocabulary: its state names the longest suffix of the
prefix that occurs in any token, its suffix links lead to the shorter ones.
Two tokens are compatible if no merge that is due earlier than theirs would
join them across the border, tested by undoing merges from the border.
Back-pointers over the prefixes give the ids.

Normalisation and word splitting follow the tokenizer file (added tokens cut
out first; NFC, spaces, lower case; the split pattern; bytes with a word-end
mark).  Texts are whole; null is empty."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridframe.llm.common import arrow_rows, materialise

BATCH = 500
_CACHED = 400_000  # words, and pairs of tokens, that a worker remembers


def _byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself where
    it prints, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(free)
            free += 1
    return [signs[b] for b in range(256)]


class SuffixAutomaton:
    """Of many strings (sequences of ints); a state's ``ends`` is the string that is its longest one."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [-1]

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(-1)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, string: tuple[int, ...], name: int) -> None:
        last = 0
        for c in string:
            last = self._extend(last, c)
        self.ends[last] = name

    def finish(self) -> None:
        """``above``: the nearest state by suffix links that ends a string."""
        self.above = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            self.above[v] = up if up > 0 and self.ends[up] >= 0 else self.above[up] if up > 0 else -1


class Bpe:
    """Encoder and decoder of one tokenizer file's contents."""

    def __init__(self, contents: str) -> None:
        spec = json.loads(contents)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self._cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        signs = _byte_signs()
        # symbols: a byte, or a byte that ends a word (+256)
        symbol = {s: b for b, s in enumerate(signs)} | {s + end: b + 256 for b, s in enumerate(signs)}
        self._single = {symbol[t]: i for t, i in vocab.items() if t in symbol}
        rank, self._pair, self._parts = {}, {}, {}
        spelt = {i: (symbol[t],) for t, i in vocab.items() if t in symbol}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self._pair[a, b] = (r, whole)
            if whole not in rank:
                rank[whole] = r
                self._parts[whole] = (a, b)
                spelt[whole] = spelt[a] + spelt[b]
        self._rank = rank
        self._size = {i: len(s) for i, s in spelt.items()}
        self._automaton = SuffixAutomaton()
        for i, s in spelt.items():
            self._automaton.add(s, i)
        self._automaton.finish()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[bytes, str, int]] = {}

    def _fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the text of a then b is exactly [a, b]."""
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > _CACHED:
                self._compatible.clear()
            known = self._compatible[a, b] = self._test(a, b)
        return known

    def _test(self, a: int, b: int) -> bool:
        due = None  # the merge undone last; one across the border that is due before it would have come first
        while True:
            across = self._pair.get((a, b))
            if across and (due is None or across[0] < due[0] or (across[0] == due[0] and due[1])):
                return False
            ra, rb = self._rank.get(a, -1), self._rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # of equal ranks the left one comes first, so the right one is undone first
            if ra > rb:
                due, a = (ra, False), self._parts[a][1]
            else:
                due, b = (rb, True), self._parts[b][0]

    def encode_word(self, symbols: list[int]) -> list[int]:
        sam, size = self._automaton, self._size
        state, matched = 0, 0
        last = [-1] * (len(symbols) + 1)
        for i, c in enumerate(symbols, 1):
            while state and c not in sam.next[state]:
                state = sam.link[state]
                matched = sam.length[state]
            state = sam.next[state].get(c, 0)
            matched = matched + 1 if state else 0
            v = state
            while v > 0:
                t = sam.ends[v]
                if t >= 0 and size[t] <= matched:
                    before = i - size[t]
                    if before == 0 or (last[before] >= 0 and self._fits(last[before], t)):
                        last[i] = t
                        break
                v = sam.above[v]
        out, i = [], len(symbols)
        while i > 0:
            out.append(last[i])
            i -= size[last[i]]
        return out[::-1]

    def _word(self, word: str) -> tuple[bytes, str, int]:
        raw = list(word.encode())
        raw[-1] += 256
        ids = self.encode_word(raw)
        found = (np.array(ids, "<u4").tobytes(), " ".join(self.tokens[i] for i in ids), len(ids))
        if len(self._cache) > _CACHED:
            self._cache.clear()
        self._cache[word] = found
        return found

    def _pieces(self, text: str) -> Iterator[tuple[bytes, str, int]]:
        """(ids, decoded text, number of ids) of each word and added token."""
        cache = self._cache
        for part in (self._cut.split(text) if self._cut else [text]):
            if part in self.added:
                yield np.array([self.added[part]], "<u4").tobytes(), part, 1
            elif part:
                part = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part))
                for word in self._words.findall("".join(map(str.lower, part)) if not part.isascii() else part.lower()):
                    yield cache.get(word) or self._word(word)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self._pieces(text or "")), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does where a file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        pieces = list(self._pieces(text or ""))
        ids = b"".join([p[0] for p in pieces])
        decoded = " ".join([p[1] for p in pieces])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256, as a written table.
    ``path`` is read on the driver; the workers build the encoder once each."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shared.value)
        for batch in batches:
            found = [bpe.digest(t) for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    with arrow_rows(spark, BATCH):
        kind = rows.schema[id_col].dataType.simpleString()
        return materialise(rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"), "tokens")


_ENCODERS: dict[int, Bpe] = {}


def _encoder(contents: str) -> Bpe:
    """One encoder per worker process and file."""
    key = hash(contents)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Bpe(contents)
    return _ENCODERS[key]
