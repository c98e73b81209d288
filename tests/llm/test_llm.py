"""Operators of the training-data pipeline against brute force on small data."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridframe.llm")
from gridframe.llm import ann, bpe, chat, ngram_join, packing, pii, topk, toxicity, url_filter, warc  # noqa: E402
from gridframe.llm.common import mix64  # noqa: E402
from gridframe.llm.ngram_join import jaccard_components  # noqa: E402
from gridframe.llm.queries import URL_RULES, held_out, tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, "  \t\n"), (4, "a b"), (4, "a b"), (5, "A  B"), (6, "x " * 30_000), (7, "1.2.3.4 a@b.co +1 (456) 555-2186"), (None, "q r s t u v")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "s", 0) for r in EDGE], "doc_id long, text string, score string, id int")


def _sets(rows):
    out = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _components(rows):
    sets, root = _sets(rows), list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_ngram_join_edges(edge):
    assert sorted(map(tuple, jaccard_components(edge).collect()), key=repr) == _components(EDGE)


def test_ngram_join_near_copies(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(6):
        base = rng.integers(0, 10**6, 60).tolist()
        for _ in range(14):
            w = list(base)
            for p in rng.integers(0, 60, rng.integers(0, 4)):
                w[p] = int(rng.integers(0, 10**6))
            rows.append((len(rows), " ".join(map(str, w[: int(rng.integers(45, 61))]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect()), key=repr) == _components(rows)


def test_ngram_join_copies_around_a_leader(spark):
    """Large groups of near copies, many too far from the leader: edits from a
    small vocabulary (shared outside the leader), cut ends, groups of their own."""
    rng = np.random.default_rng(0)
    rows = []

    def family(base, copies, edits, vocabulary, cut):
        for _ in range(copies):
            w = list(base)
            for p in rng.integers(0, len(w), rng.integers(0, edits)):
                w[p] = int(rng.integers(0, vocabulary))
            rows.append((len(rows), " ".join(map(str, w[int(rng.integers(0, cut + 1)): len(w) - int(rng.integers(0, cut + 1))]))))

    for g, (edits, vocabulary, cut) in enumerate([(4, 3, 0), (8, 10**6, 4), (12, 5, 3), (5, 2, 12)]):
        base = rng.integers(0, 10**6, 70).tolist()
        family(base, 60, edits, vocabulary, cut)
        base[20: 26 + 3 * g] = rng.integers(0, 10**6, 6 + 3 * g).tolist()
        family(base, 25, 5, 4, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect()), key=repr) == _components(rows)


def test_ngram_join_no_original(spark):
    """Groups whose leader is an edited copy: its own edit is a difference of all others."""
    rng = np.random.default_rng(5)
    rows = []
    for edits, vocabulary in [(5, 10**6), (7, 40), (9, 6)]:
        base = rng.integers(0, 10**6, 90).tolist()
        for _ in range(50):
            w = list(base)
            for p in rng.choice(90, int(rng.integers(2, edits)), replace=False):
                w[p] = int(rng.integers(0, vocabulary))
            rows.append((len(rows), " ".join(map(str, w))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect()), key=repr) == _components(rows)


def test_ngram_join_differences_from_a_leader():
    """Sets around a leader that lacks what all others have give few pairs, and none that is linked gets lost."""
    rng = np.random.default_rng(2)

    def edited(words, edits):
        words = words.copy()
        words[rng.choice(150, edits, replace=False)] = rng.integers(1, 2**40, edits)
        return np.unique(mix64(sum(words[k: 146 + k].astype(np.uint64) << np.uint64(5 * k) for k in range(5))))

    base = rng.integers(1, 2**40, 150)
    leader, whole = edited(base, 1), edited(base, 0)
    sets = [edited(base, edits) for edits in rng.integers(3, 14, 300)]
    # the shingles that most documents hold, as their counters mark them
    marked, docs = np.unique(np.concatenate([x[np.isin(x, whole)] for x in sets]) >> np.uint64(64 - ngram_join.COUNT_BITS), return_counts=True)
    lists = {}
    for k, x in enumerate(sets):
        both = len(np.intersect1d(x, leader))
        for pos, s in enumerate(ngram_join._differences(x, leader, marked, docs.astype(np.uint64)).tolist()):
            lists.setdefault(s, []).append((k, k, len(x), pos, both, len(leader) - both))
    found = set()
    for rows in lists.values():
        for x, y in ngram_join._probe_apart(np.array(rows, ngram_join._APART)):
            found |= set(zip(np.minimum(x["fp"], y["fp"]).tolist(), np.maximum(x["fp"], y["fp"]).tolist()))
    linked = set()
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(x, sets[j]))
            needed = -(-75 * (len(x) + len(sets[j])) // 175)
            own = [len(np.setxor1d(s, leader)) for s in (x, sets[j])]
            if both >= needed and sum(own) > len(x) + len(sets[j]) - 2 * needed:
                linked.add((i, j))
    assert linked and linked <= found
    # all pairs share the leader's own edit
    assert len(found) < len(sets) ** 2 / 8


def test_ngram_join_late_leaders(spark):
    """A set that meets a group in one list only is not compared with the group's leader."""
    mixed = spark.createDataFrame([(k, fp, n) for k in range(14) for fp, n in ((1, 400), (2, 400)) if fp == 1 or k] + [(0, 3, 400), (0, 4, 16)], "list long, fp long, n long")
    leaders = spark.createDataFrame([(1, 1, 400, 0)], "fp long, ref long, both long, lack long")
    assert sorted(map(tuple, ngram_join._late_pairs(mixed, leaders).collect())) == [(1, 2, 1), (1, 4, 1)]


def test_ngram_join_empty_table(edge):
    assert jaccard_components(edge.limit(0)).count() == 0


def test_pii_spans(spark, edge):
    texts = ["m: a@b.c_x@d.e, 999.1.1.1 1.2.3.4.5 4111 1111 1111 1111 +12 34", "a.b%c@d-e.f.g 0000255.0.0.1", None, "é " * 700 + "1.2.3.4 " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (df, edge.select("doc_id", "text"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")):
        for r in pii.with_spans(frame, pii.fit(frame)).select("text", pii.span_list(F.col("pii.base")).alias("s")).collect():
            assert r.s == ",".join(_base(r.text or ""))


def _base(text):
    def luhn(d):
        return sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, f in kinds for m in re.finditer(p, text) if f(m[0])]


def test_pii_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.co or 1.2.3.4!")], "doc_id long, text string")
    found = pii.with_spans(df, {}).select(pii.redacted(F.col("text"), F.col("pii.all")).alias("t")).first()
    assert found.t == "to [EMAIL] or [IP]!"


def test_bpe_as_library(spark, edge):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [t or "" for _, t in EDGE] + ["<|endoftext|>Hi", "İstanbul ΟΔΟΣ", "it's 123 ½", "日本語😀", "\u200bé"]
    own = bpe.Bpe(open(tokenizer_path(), encoding="utf-8").read())
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded_digests(edge, tokenizer_path()).count() == len(EDGE)


def test_warc_round_trip(spark):
    long = "ü" * 800
    rows = [(1, "u", long), (2, None, long), (3, "v\n", "short"), (4, "w", "short"), (5, "x", None), (6, "y", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    index = warc.write(df, folder)
    got = {r.page_id: r for r in warc.read(index, folder).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 6) if page in (1, 2) else ("response", None))
        assert r.payload == ((html or "") if r.record_type == "response" else None)
    assert warc.read(index.limit(0), folder).count() == 0


def _vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300, rows[50][1]), (301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [0.0] * 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_exact_top_k(spark):
    rows, df = _vectors(spark)
    ids = [i for i, v in rows if v and None not in v and not np.isnan(v).any()]
    x = np.floor(256 * np.array([dict(rows)[i] for i in ids]))
    want = []
    for q in (i for i in ids if i % 50 == 0):
        score = x @ x[ids.index(q)]
        best = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:5]
        want += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 50 == 0).collect())) == sorted(want)


def test_nearest_recall(spark):
    rows, df = _vectors(spark)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    own = {i: np.array(v) for i, v in rows[:301]}
    hit = sum(len(set(sorted((i for i in own if i != q), key=lambda i: -own[i] @ own[q])[:20]) & got[q]) for q in got)
    assert len(got) == 16 and hit / (20 * len(got)) >= 0.9


def test_nearest_ties(spark):
    rng = np.random.default_rng(3)
    copied = rng.standard_normal(8).tolist()
    rows = [(i, copied if i % 3 else rng.standard_normal(8).tolist()) for i in range(900)]
    rows.append((900, (2 * np.array(copied)).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = [1, 2, 301, 900]
    got = {}
    for r in ann.nearest(df, F.col("id").isin(queries)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    own = {i: np.array(v) for i, v in rows}
    for q in queries:
        score = {i: (own[q] * v).sum() for i, v in own.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert got[q] == want


def test_optimal_boundaries():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.choice(40, 9, replace=False)).astype(float)
        counts = rng.integers(1, 20, 9)
        for k in (1, 2, 3, 5):
            ends = packing.optimal_boundaries(lengths, counts, k)
            cost = lambda e: sum(c * (min(x for x in e if x >= n) - n) for n, c in zip(lengths, counts))
            from itertools import combinations
            best = min(cost([*s, lengths[-1]]) for r in range(k) for s in combinations(lengths[:-1], r))
            assert len(ends) <= k and cost(ends) == best


def test_packing_budget(edge):
    rows = packing.pack(edge, buckets=3, budget=100).collect()
    batches = {}
    for r in rows:
        assert 0 <= r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r.bucket_len)
    assert len(rows) == len(EDGE) and all(sum(b) <= 100 or len(b) == 1 for b in batches.values())


def test_packing_is_optimal_above_any_count(spark, monkeypatch):
    # lengths were rounded up once there were more different ones than this
    monkeypatch.setattr(packing, "MOST_LENGTHS", 6, raising=False)
    lengths = [2, 2, 3, 7, 8, 8, 40, 41, 100, 101, 150, 150, 151, 290]
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(df, buckets=3).collect()
    longest = {}
    for r in rows:
        longest[r.bucket] = max(longest.get(r.bucket, 0), r.n_tokens)
    assert all(r.bucket_len == longest[r.bucket] for r in rows)
    different, counts = np.unique(lengths, return_counts=True)
    ends = packing.optimal_boundaries(different.astype(float), counts, 3)
    assert sorted({r.bucket_len for r in rows}) == ends
    assert sum(r.padding for r in rows) == sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_chat_keeps_maximal(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    turns = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, b, ("user", "")]}
    rows = [(i, k, *t) for i, ts in turns.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.collapse(df).collect()}
    assert got == {3: (3, 2), 5: (1, 1), 6: (3, 1)}


def test_urls(spark):
    urls = [None, "none", "http://WWW.Example.com/en/x?q#f", "http://a.net/es/", "http://net/fr/1", "http://com", "x://y.org/p://q", "http://example.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got == {0: ("", "", None), 1: ("", "", None), 2: ("www.example.com", "/en/x", "www.example.com/en/"), 3: ("a.net", "/es/", "net/es/"),
                   4: ("net", "/fr/1", "net/fr/"), 5: ("com", "", None), 6: ("y.org", "/p://q", None), 7: ("example.com", "/en/", "example.com/en/")}


def test_toxicity_held_out(spark, edge):
    rng = np.random.default_rng(4)
    clean, rows = [f"w{i}" for i in range(200)], []
    for i in range(400):
        words = rng.choice(clean, 40).tolist()
        if i % 3 == 0:
            words[int(rng.integers(0, 40))] = "zzbad" + str(rng.integers(0, 10**6))
        rows.append((" ".join(words), int(i % 3 == 0)))
    network = toxicity.train(rows[:300])
    score = network.scores([toxicity.words_of(t) for t, _ in rows[300:]])
    assert ((score >= 0.5) == np.array([y for _, y in rows[300:]])).mean() >= 0.9
    scored = toxicity.with_score(edge, network).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.toxicity <= 1 for r in scored)


def test_held_out_rows(spark):
    got = {r.i: r.h for r in spark.range(50).select(F.col("id").alias("i"), held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_pipeline_rows(spark):
    import corpus_pipeline as pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = pipeline.drop_near_duplicates(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted({c for _, _, c in _components(rows)})
    assert sorted(r.doc_id for r in own.collect()) == want and own.columns == docs.columns
    red = pipeline.redact_pii(spark, own, SF)
    assert red.columns == docs.columns and not any(_base(r.text or "") for r in red.collect())
    assert pipeline.pack_batches(spark, red, SF).count() == len(want)


def test_pipeline_duplicates_by_row(spark):
    import corpus_pipeline as pipeline
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abce")
    near = a.replace("a39", "z")
    rows = [(-5, c), (7, a), (7, b), (3, near), (7, b), (None, c), (None, e), (None, e), (None, ""), (None, ""), (9, None), (10, b), (11, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, df, SF).collect()), key=repr)
    assert got == sorted([(-5, c), (3, near), (7, b), (None, e), (None, ""), (None, ""), (9, None)], key=repr)
