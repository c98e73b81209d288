"""Toxicity: a bidirectional gated recurrent network over words and characters.

A word is its own vector (for words of the training sample) joined with the
last states of a bidirectional GRU over its characters.  A second
bidirectional GRU runs over windows of ``WINDOW`` words, attention pools its
states, and a logistic unit scores the window.  A document's score is that of
its worst window, over all windows of its whole text, each overlapping the next
by half, calibrated on the sample.

The network is trained here, in numpy, on a bounded sample of labelled rows
(``SAMPLE``: rows of each label, at most ``SAMPLE_CHARS`` characters long);
scoring covers every row.  Null and empty texts have no words and get the score
of an empty window."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridframe.llm.common import arrow_rows, materialise

WINDOW, STRIDE = 32, 16
SAMPLE = {1: 400, 0: 800}
SAMPLE_CHARS = 4000
THRESHOLD = 0.7
BATCH = 500
WORD_DIM, CHAR_DIM, CHAR_HIDDEN, HIDDEN, ATTEND = 4, 8, 8, 8, 8
ALPHABET, LONGEST = 128, 24
EPOCHS, BAG, LEAST_STEPS = 6, 32, 160
_LENGTHS = (0, 4, 7, 10, 14, LONGEST)  # words of similar length go through the character network together
RARE, PRIOR = 5, 10.0  # documents of the sample a word must be in to have a vector; rows that its prior counts for
_CACHED_WORDS = 100_000
_WORD = re.compile(r"\w{1,%d}" % LONGEST)  # a longer run is several words in a row
_KEEP = 40.0  # a gate so far open leaves the state as it is


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(steps: list[np.ndarray], u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """GRU states after each step; ``steps`` are the inputs' shares (keep, reset, new)."""
    h = np.zeros((len(steps[0]), u.shape[0]), np.float32)
    k = u.shape[0]
    out = []
    for p in steps:
        a = h @ u
        gate = _sigmoid(p[:, : 2 * k] + a[:, : 2 * k])
        z, r = gate[:, :k], gate[:, k:]
        new = np.tanh(p[:, 2 * k:] + r * a[:, 2 * k:])
        if keep is not None:
            keep.append((h, z, r, a[:, 2 * k:], new))
        h = new + z * (h - new)
        out.append(h)
    return out


def _run_back(kept: list, grads: list[np.ndarray], u: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of ``_run``: of each step's share, and of ``u``."""
    du, dh, k = np.zeros_like(u), 0, u.shape[0]
    out = [None] * len(kept)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, q, new = kept[t]
        d = grads[t] + dh if grads[t] is not None else dh
        dn = d * (1 - z) * (1 - new * new)
        dz = d * (h - new) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        through = np.concatenate([dz, dr, dn * r], axis=1)
        dh = d * z + through @ u.T
        du += h.T @ through
        out[t] = np.concatenate([dz, dr, dn], axis=1)
    return out, du


def _char_ids(words: list[str]) -> np.ndarray:
    """Characters of each word, 0 after its end."""
    ids = np.zeros((len(words), max(map(len, words), default=1)), np.int64)
    for i, w in enumerate(words):
        ids[i, : len(w)] = [ord(c) % (ALPHABET - 1) + 1 for c in w]
    return ids


class Network:
    """The parameters, scoring and training."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)

        def near(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        inputs = WORD_DIM + 2 * CHAR_HIDDEN
        self.vocabulary = vocabulary
        self.scale = (1.0, 0.0)
        self.p = {
            "word": near(len(vocabulary) + 1, WORD_DIM) * 0.1, "char": near(ALPHABET, CHAR_DIM),
            "cf_w": near(CHAR_DIM, 3 * CHAR_HIDDEN), "cf_u": near(CHAR_HIDDEN, 3 * CHAR_HIDDEN), "cf_b": np.zeros(3 * CHAR_HIDDEN, np.float32),
            "cb_w": near(CHAR_DIM, 3 * CHAR_HIDDEN), "cb_u": near(CHAR_HIDDEN, 3 * CHAR_HIDDEN), "cb_b": np.zeros(3 * CHAR_HIDDEN, np.float32),
            "f_w": near(inputs, 3 * HIDDEN), "f_u": near(HIDDEN, 3 * HIDDEN), "f_b": np.zeros(3 * HIDDEN, np.float32),
            "b_w": near(inputs, 3 * HIDDEN), "b_u": near(HIDDEN, 3 * HIDDEN), "b_b": np.zeros(3 * HIDDEN, np.float32),
            "att": near(2 * HIDDEN, ATTEND), "att_v": near(ATTEND), "out": near(2 * HIDDEN), "out_b": np.zeros(1, np.float32),
        }

    # words

    def _vectors(self, words: list[str], kept: dict | None = None, drop: np.ndarray | None = None) -> np.ndarray:
        p = self.p
        ids = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        if drop is not None:
            ids = np.where(drop, 0, ids)
        ends = np.empty((len(words), 2 * CHAR_HIDDEN), np.float32)
        lengths = np.array(list(map(len, words)))
        for low, high in zip(_LENGTHS, _LENGTHS[1:]):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(own):
                note: dict | None = {"own": own} if kept is not None else None
                ends[own] = self._ends([words[i] for i in own], note)
                if kept is not None:
                    kept.setdefault("chars", []).append(note)
        if kept is not None:
            kept["ids"] = ids
        return np.concatenate([p["word"][ids], ends], axis=1)

    def _ends(self, words: list[str], kept: dict | None) -> np.ndarray:
        """The character network's last states, forward and backward."""
        p, chars = self.p, _char_ids(words)
        ends = []
        for side, order in (("cf", range(chars.shape[1])), ("cb", range(chars.shape[1] - 1, -1, -1))):
            share = p["char"] @ p[side + "_w"] + p[side + "_b"]
            share[0, :CHAR_HIDDEN], share[0, CHAR_HIDDEN:] = _KEEP, 0
            notes: list | None = [] if kept is not None else None
            ends.append(_run([share[chars[:, t]] for t in order], p[side + "_u"], notes)[-1])
            if kept is not None:
                kept[side] = notes
        if kept is not None:
            kept["chars"] = chars
        return np.concatenate(ends, axis=1)

    def shares(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of the forward and the backward GRU."""
        x = self._vectors(words)
        return np.concatenate([x @ self.p["f_w"] + self.p["f_b"], x @ self.p["b_w"] + self.p["b_b"]], axis=1)

    @staticmethod
    def _pad(shares: np.ndarray) -> np.ndarray:
        pad = np.zeros((1, shares.shape[1]), np.float32)
        pad[0, :HIDDEN] = pad[0, 3 * HIDDEN: 4 * HIDDEN] = _KEEP
        return np.concatenate([pad, shares])

    # windows

    def logits(self, shares: np.ndarray, windows: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Of each window, a row of indexes into ``shares`` (0: no word)."""
        p, t = self.p, windows.shape[1]
        notes_f, notes_b = ([], []) if kept is not None else (None, None)
        fore, back = shares[:, : 3 * HIDDEN], shares[:, 3 * HIDDEN:]
        forward = _run([fore[windows[:, i]] for i in range(t)], p["f_u"], notes_f)
        backward = _run([back[windows[:, i]] for i in range(t - 1, -1, -1)], p["b_u"], notes_b)[::-1]
        states = np.stack([np.concatenate(x, axis=1) for x in zip(forward, backward)], axis=1)
        mixed = np.tanh(states @ p["att"])
        weight = mixed @ p["att_v"] - _KEEP * (windows == 0)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        context = np.einsum("nt,nth->nh", weight, states)
        if kept is not None:
            kept |= {"f": notes_f, "b": notes_b, "states": states, "mixed": mixed, "weight": weight, "context": context}
        return context @ p["out"] + p["out_b"][0]

    # training

    def _step(self, texts: list[list[str]], labels: np.ndarray, sharp: float, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss of a bag of documents."""
        p = self.p
        words = sorted({w for t in texts for w in t})
        index = {w: i + 1 for i, w in enumerate(words)}
        kept: dict = {}
        x = self._vectors(words, kept, rng.random(len(words)) < 0.4)
        shares = self._pad(np.concatenate([x @ p["f_w"] + p["f_b"], x @ p["b_w"] + p["b_b"]], axis=1))
        windows, owner = windows_of([np.array([index[w] for w in t], np.int64) for t in texts], WINDOW)
        z = self.logits(shares, windows, kept)
        # the windows of a document share its label, the worse ones more
        pull = np.exp(sharp * (z - np.maximum.reduceat(z, np.searchsorted(owner, np.arange(len(texts))))[owner]))
        pull /= np.bincount(owner, pull)[owner]
        doc = np.bincount(owner, pull * z)
        dz = (((_sigmoid(doc) - labels) / len(texts))[owner] * pull).astype(np.float32)
        g: dict[str, np.ndarray] = {}
        g["out"], g["out_b"] = kept["context"].T @ dz, np.array([dz.sum()], np.float32)
        dc = dz[:, None] * p["out"]
        states, weight, mixed = kept["states"], kept["weight"], kept["mixed"]
        dw = np.einsum("nh,nth->nt", dc, states)
        de = weight * (dw - (weight * dw).sum(axis=1, keepdims=True))
        dm = de[:, :, None] * p["att_v"] * (1 - mixed * mixed)
        g["att_v"] = np.einsum("nt,nta->a", de, mixed)
        g["att"] = np.einsum("nth,nta->ha", states, dm)
        ds = weight[:, :, None] * dc[:, None, :] + dm @ p["att"].T
        t = windows.shape[1]
        dshares = np.zeros_like(shares)
        for side, off, order, part in (("f", 0, range(t), slice(0, HIDDEN)), ("b", 3 * HIDDEN, range(t - 1, -1, -1), slice(HIDDEN, None))):
            steps, g[side + "_u"] = _run_back(kept[side], [ds[:, i, part] for i in order], p[side + "_u"])
            flat = windows[:, list(order)].T.ravel()
            every = np.concatenate(steps)
            for c in range(3 * HIDDEN):
                dshares[:, off + c] = np.bincount(flat, every[:, c], minlength=len(shares))
        dshares = dshares[1:]
        df, db = dshares[:, : 3 * HIDDEN], dshares[:, 3 * HIDDEN:]
        g |= {"f_w": x.T @ df, "f_b": df.sum(axis=0), "b_w": x.T @ db, "b_b": db.sum(axis=0)}
        dx = df @ p["f_w"].T + db @ p["b_w"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], kept["ids"], dx[:, :WORD_DIM])
        for note in kept["chars"]:
            chars, dend = note["chars"], dx[note["own"], WORD_DIM:]
            t = chars.shape[1]
            for side, part, order in (("cf", slice(0, CHAR_HIDDEN), range(t)), ("cb", slice(CHAR_HIDDEN, None), range(t - 1, -1, -1))):
                steps, du = _run_back(note[side], [None] * (t - 1) + [dend[:, part]], p[side + "_u"])
                flat, every = chars[:, list(order)].T.ravel(), np.concatenate(steps)
                dshare = np.stack([np.bincount(flat, every[:, c], minlength=ALPHABET) for c in range(3 * CHAR_HIDDEN)], axis=1)
                dshare[0] = 0
                for key, d in ((side + "_u", du), (side + "_w", p["char"].T @ dshare), (side + "_b", dshare.sum(axis=0)),
                               ("char", dshare @ p[side + "_w"].T)):
                    g[key] = g.get(key, 0) + d
        return g

    def train(self, texts: list[list[str]], labels: np.ndarray) -> None:
        rng = np.random.default_rng(3)
        aside = rng.random(len(texts)) < 0.25  # for the calibration
        if min(labels[aside].sum(), (1 - labels[aside]).sum()) < 20:
            aside[:] = False
        own_texts, own_labels = [t for t, out in zip(texts, aside) if not out], labels[~aside]
        epochs = max(EPOCHS, LEAST_STEPS * BAG // len(own_texts))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(own_texts))
            for at in range(0, len(order), BAG):
                own = order[at: at + BAG]
                step += 1
                rate = 0.02 * (1 - 0.8 * epoch / epochs)
                # in the end the worst window alone decides, as in scoring
                for k, g in self._step([own_texts[i] for i in own], own_labels[own], 1 + 4 * epoch / epochs, rng).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= (rate * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        last = aside if aside.any() else ~aside
        self._calibrate(np.array(list(self.worst([t for t, out in zip(texts, last) if out]))), labels[last])

    def _calibrate(self, z: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression of the label on the worst window's logit, by Newton steps."""
        x = np.stack([z, np.ones_like(z)], axis=1).astype(np.float64)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            q = _sigmoid(np.clip(x @ w, -30, 30))
            hessian = (x * (q * (1 - q))[:, None]).T @ x + np.diag([0.005, 0.005])
            w = w - np.clip(np.linalg.solve(hessian, x.T @ (q - labels) + 0.005 * (w - [1.0, 0.0])), -1, 1)
        self.scale = (float(max(w[0], 1e-3)), float(w[1]))

    # scoring

    def worst(self, texts: list[list[str]], cache: "Words | None" = None) -> Iterator[float]:
        """The greatest window logit of each text."""
        cache = cache or Words(self)
        held, size = [], 0
        for t in texts:
            held.append(cache.ids(t))
            size += len(t)
            if size >= 40_000:
                yield from self._flush(held, cache)
                held, size = [], 0
        if held:
            yield from self._flush(held, cache)

    def _flush(self, held: list[np.ndarray], cache: "Words") -> Iterator[float]:
        shares = cache.table()
        windows, owner = windows_of(held, STRIDE)
        z = np.concatenate([self.logits(shares, windows[i: i + 2048]) for i in range(0, len(windows), 2048)])
        yield from np.maximum.reduceat(z, np.searchsorted(owner, np.arange(len(held)))).tolist()
        cache.trim()

    def scores(self, texts: list[list[str]], cache: "Words | None" = None) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(np.clip(a * np.array(list(self.worst(texts, cache)), dtype=np.float64) + b, -30, 30))


class Words:
    """Shares of the words met so far, by index; starts anew when it is full."""

    def __init__(self, network: Network) -> None:
        self._network, self._index, self._new = network, {}, []
        self._table = network._pad(np.empty((0, 6 * HIDDEN), np.float32))

    def ids(self, words: list[str]) -> np.ndarray:
        index, new = self._index, self._new
        for w in set(words).difference(index):
            index[w] = len(index) + 1
            new.append(w)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        if self._new:
            added = [self._network.shares(self._new[i: i + 4096]) for i in range(0, len(self._new), 4096)]
            self._table = np.concatenate([self._table, *added])
            self._new.clear()
        return self._table

    def trim(self) -> None:
        if len(self._index) > _CACHED_WORDS:
            self.__init__(self._network)


def windows_of(texts: list[np.ndarray], stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of word indexes that cover each text whole, and each window's text."""
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-(sizes - WINDOW) // stride) + 1)
    begin = np.cumsum(sizes + WINDOW + stride) - (sizes + WINDOW + stride)
    line = np.zeros(int((sizes + WINDOW + stride).sum()), np.int64)
    for b, t in zip(begin, texts):
        line[b: b + len(t)] = t
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return line[(begin[owner] + place * stride)[:, None] + np.arange(WINDOW)], owner


def train(rows: list[tuple[str, int]]) -> Network:
    """A network from (text, label) rows; equal texts count once."""
    rows = sorted(set(rows))
    texts = [words_of(t) for t, _ in rows]
    labels = np.array([y for _, y in rows], dtype=np.float64)
    seen, bad = Counter(), Counter()
    for t, y in zip(texts, labels):
        seen.update(own := set(t))
        if y:
            bad.update(own)
    common = sorted(w for w, n in seen.items() if n >= RARE)
    network = Network({w: i + 1 for i, w in enumerate(common)})
    network.p["word"][0] = 0
    if common:
        # a word's first coordinate starts at its log odds, shrunk to those of all rows
        rate = (labels.sum() + 1) / (len(labels) + 2)
        share = (np.array([bad[w] for w in common]) + PRIOR * rate) / (np.array([seen[w] for w in common]) + PRIOR)
        network.p["word"][1:, 0] = np.log(share / (1 - share)) - np.log(rate / (1 - rate))
    if 0 < labels.sum() < len(labels):
        network.train(texts, labels)
    return network


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """At most ``SAMPLE`` rows of each label where ``usable`` holds, in an order
    given by a hash.  An id with several labels counts as toxic if one is."""
    own = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)")
           .groupBy("id").agg(F.max("y").alias("y")))
    rows = []
    for y, most in SAMPLE.items():
        # more ids than rows, as some texts will be too long; still a fixed number
        ids = own.where((F.col("y") == y) & usable).orderBy(F.xxhash64("id"), "id").limit(4 * most).select("id")
        found = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .where(F.length("text").between(1, SAMPLE_CHARS)).join(F.broadcast(ids), "id")
                 .orderBy(F.xxhash64("id"), "id", "text").limit(most).select("text"))
        rows += [(r.text, y) for r in found.collect()]
    return rows


def with_score(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "toxicity",
               where: str = "true", keep_text: bool = True) -> DataFrame:
    """``docs`` with a score of each whole text, as a written table; ``where``
    may filter on the score.  A column of that name is replaced."""
    spark = docs.sparkSession
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        cache = Words(network)
        for batch in batches:
            found = network.scores([words_of(t) for t in batch.column(at).to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, score_col])

    with arrow_rows(spark, BATCH):
        schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
        scored = docs.mapInArrow(run, schema).where(where)
        return materialise(scored if keep_text else scored.drop(text_col), "toxicity")
