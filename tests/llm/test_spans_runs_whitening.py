"""Decontamination, whitening and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridframe.llm")
from gridframe.llm import decontaminate, runs, whitening  # noqa: E402
from gridframe.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "x y " * 20_000


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------ periodic runs ---

def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(6, 4 * q) and not any(all(w[s + x] == w[s + x + r] for x in range(n - r)) for r in range(1, q)):
                out.add((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    return (key, len(found), best[0], best[1], best[2], 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            p, a = rng.randint(1, max(1, n // 4)), rng.randrange(n)
            unit = [rng.randrange(k) for _ in range(p)]
            for x in range(a, n):
                if rng.random() < 0.99:
                    w[x] = unit[(x - a) % p]
        assert runs.find_runs(np.array(w, dtype=np.int64)) == brute_runs(w)


def test_runs_of_a_long_text():
    unit = [*range(777), *range(5)]
    w = np.array((list(range(2000, 2100)) + unit * 40)[:30_000])
    assert runs.find_runs(w) == [(100, 29_900, 782)]


def test_run_report_edges(spark):
    rng = random.Random(5)
    rows = [(None, "a b " * 5), (1, None), (2, ""), (3, " \t\n"), (4, "a " * 7), (4, "a " * 7), (5, "A a " * 6), (6, "a\x1fb c d " * 9), (-7, "ß ü " * 4)]
    rows += [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 120)))) for i in range(10, 120)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, key string, n_runs int")
    got = sorted(map(tuple, runs.run_report(df, planted=True).collect()), key=repr)
    assert got == sorted((brute_report(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows if k is not None)
    assert runs.run_report(df.limit(0), planted=True).collect() == []
    # a text of one run keeps its first period
    kept = {r["doc_id"]: r["text"] for r in runs.collapse_runs(df.where("doc_id in (1, 2, 4, 5)")).collect()}
    assert kept == {1: None, 2: "", 4: "a", 5: "A a"}
    long = spark.createDataFrame([(4, LONG)], "doc_id long, text string")
    assert [tuple(r)[1:5] for r in runs.run_report(long).collect()] == [(1, 0, 40_000, 2)]


def test_runs_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [r for r in docs if len(r[1] or "") < 4000]
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_runs"](spark, SF).collect()}
    assert [got[r[0]] for r in docs] == [brute_report(*r) for r in docs]
    assert sum(r[1] > 0 for r in got.values()) > 0


# ---------------------------------------------------------------- whitening ---

def integers(vectors):
    return np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)


def test_jacobi_on_a_pivoted_factor():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((9, 5)) * np.array([1e3, 1e2, 10, 1, 0.5])
    v = (a @ a.T).astype(np.longdouble)
    factor = whitening.pivoted_cholesky(v)
    assert np.abs(factor @ factor.T - v).max() < 1e-12 * float(np.abs(v).max())
    values, vectors = whitening.one_sided_jacobi(factor)
    assert np.allclose(values[:5].astype(float), np.linalg.eigvalsh(v.astype(float))[::-1][:5], rtol=1e-8)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-15
    assert (np.diff(values) <= 0).all()


def test_products_are_exact():
    for most in (100, 2**30, 2**38):
        y = np.random.default_rng(1).integers(-most, most, (700, 3))
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)], dtype=object)
        assert (whitening._products(y) == exact).all()


def test_whiten_edges(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((300, 6)) * np.array([8, 5, 3, 2, 1, 0.5])).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    rows += [rows[0], rows[0], (None, good[1].tolist())]  # repeated rows and a null id take part
    used = list(rows)
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, n long, component string")
    got = whitening.whiten(df, components=5).toPandas()
    x = integers([v for _, v in used])
    n, s = len(x), x.sum(axis=0)
    assert len(got) == 5 * n and set(got["n"]) == {n}
    centred = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :5] / np.sqrt(values[:5])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for at, (key, _) in enumerate(used):
        mine = got[got["vec_id"].isna() if key is None else got["vec_id"] == key].sort_values("component")
        assert (mine["deviation"] == deviation[at]).all()
        assert np.allclose(np.abs(mine["whitened"].to_numpy()[:: len(mine) // 5]), np.abs(want[at]), atol=1e-9)
    explained = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(explained, values[:5] / values.sum(), rtol=1e-9)
    assert got["identity_error"].max() < 1e-9
    signed = got.sort_values(["component", "deviation"]).groupby("component")["whitened"].apply(lambda c: np.array(c))
    assert abs(np.dot(signed[1], signed[1]) / n - 1) < 1e-9


def test_whiten_few_directions(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], kind)
    got = whitening.whiten(line).toPandas()
    assert set(got["component"]) == {1} and len(got) == 9 and abs(got["explained"].iloc[0] - 1) < 1e-12
    huge = spark.createDataFrame([(i, [2.0**33 * (-1) ** i, 1.0 * (i % 3)]) for i in range(60)], kind)
    got = whitening.whiten(huge).toPandas()
    assert got["deviation"].isna().all() and got["identity_error"].max() < 1e-6


# ---------------------------------------------------------- decontamination ---

def item_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(docs, items):
    windows = [(str(k) if k is not None else None, w[i:i + 10]) for k, w in ((k, item_words(t)) for k, t in items) if w
               for i in range(max(1, len(w) - 9))]
    out = []
    for key, text in docs:
        w, hit, held = item_words(text), set(), set()
        for item, win in windows:
            at = [i for i in range(len(w) - len(win) + 1) if w[i:i + len(win)] == win]
            hit.update(p for i in at for p in range(i, i + len(win)))
            if at:
                held.add(item)
        listed = sorted(x for x in held if x is not None)
        out.append((key, len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return sorted(out, key=repr)


def passage(rng, n, k=400):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


def test_decontamination_edges(spark):
    rng = random.Random(7)
    shared, loop = passage(rng, 30), ["a"] * 14
    items = [(i, " ".join(passage(rng, 12))) for i in range(5)]
    items += [(10, " ".join(shared)), (11, " ".join(shared)), (12, "-- ".join(shared[5:25]).upper()), (13, "Be  short"), (14, "One, two three.4 five six"),
              (15, " ".join(loop)), (16, None), (17, ""), (18, "?!"), (None, "never listed words here"), (10, "another text"), (19, "ÄÖ é λόγος Σ слово 字 x y z")]
    docs = [(None, " ".join(passage(rng, 20) + shared)), (1, None), (2, ""), (3, "!! --"), (4, "be short"), (4, "be short"), (5, "be  SHORT one two-three 4 five six seven"),
            (6, " ".join(loop * 3)), (7, " ".join(shared[:9])), (8, " ".join(shared[3:13])), (9, LONG + " ".join(shared) + " x" * 5000),
            (20, "never listed words here"), (21, "Another Text"), (22, "äö é λόγος σ слово 字 x y z"), (23, "ÄÖ é λόγος Σ слово 字 X y z"), (4, "one other text")]
    for i in range(60):
        w = passage(rng, 40, 30)
        part = list(rng.choice([shared, item_words(items[rng.randrange(5)][1]), loop]))
        if rng.random() < 0.5:
            part[rng.randrange(len(part))] = "changed"
        docs.append((100 + i, " ".join(w[: rng.randrange(40)] + part + w[:5])))
    left = spark.createDataFrame([(*r, 0, "i", 1) for r in docs], "doc_id long, text string, n_hit int, item_id string, th int")
    right = spark.createDataFrame([(*r, "w", 2) for r in items], "item_id long, text string, words string, size int")
    got = sorted(map(tuple, decontaminate.contamination(left, right).collect()), key=repr)
    assert got == brute_hits(docs, items)
    none = decontaminate.contamination(left, right.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert decontaminate.contamination(left.limit(0), right).collect() == []


def test_decontamination_spans_and_wide_join(spark, monkeypatch):
    rng = random.Random(9)
    shared = passage(rng, 14)
    docs = spark.createDataFrame([(1, " ".join(["p", "q", *shared, "r", *shared[:10]]))], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(shared)), ("j", " ".join(shared))], "item_id string, text string")
    # without broadcasts the joins are shuffles, with the same rows
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df, *_: df)
    found = decontaminate.shared_spans(docs, items)
    assert [[tuple(s) for s in r["spans"]] for r in found.spans.collect()] == [[(2, 16), (17, 27)]]
    assert [r["items"] for r in found.item_sets.collect()] == [["i", "j"]]


def test_winnowing_keeps_every_window(spark):
    """A window has its least code among the codes kept of any text around it."""
    rng = random.Random(11)
    rows = [(i, [str(rng.randrange(3)) for _ in range(40)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    kept = df.select("w", decontaminate.fingerprints(F.col("w"), 10, 5).alias("v"),
                     decontaminate.fingerprints(F.slice("w", 13, 10), 10, 5).alias("own")).collect()
    for r in kept:
        assert len(r["own"]) == 1
        assert (r["own"][0] + 12) in r["v"]


def test_decontamination_query(spark):
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()]
    got = sorted(map(tuple, QUERIES["op11_decontaminate"](spark, SF).collect()), key=repr)
    assert got == brute_hits(read("documents", "doc_id"), read("benchmark", "item_id"))
