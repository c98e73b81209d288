"""Repeated rows, large components, very long conversations, clashing names and page outcomes."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridframe.llm")
from gridframe.llm import ann, chat, pii, topk, url_filter  # noqa: E402
from gridframe.llm.queries import URL_RULES  # noqa: E402

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, is_query, k, exact):
    """Rows are told apart by id and vector."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = []
    for q, v in rows:
        if is_query(q):
            scores = sorted((-exact(v, w), c) for c, w in rows if (c, w) != (q, v))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return sorted(out)


def test_repeated_rows_are_one_row(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=6), 3).tolist()) for i in range(120)]
    rows += [rows[0], rows[0], rows[33], rows[33], rows[50]]          # repeated as they are
    rows += [(100, np.round(rng.normal(size=6), 3).tolist()), (7, rows[8][1])]  # an id with two vectors
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], VECTORS + ", score int, key string").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("id") % 50 == 0).collect())
    want = brute(rows, lambda i: i % 50 == 0, 5, lambda a, b: int(np.floor(256 * np.array(a)) @ np.floor(256 * np.array(b))))
    assert got == want
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("id") % 20 == 0).collect())
    want = brute(rows, lambda i: i % 20 == 0, 20, lambda a, b: float(np.array(a) @ np.array(b)))
    assert got == [w[:3] for w in want]
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, F.col("id") % 50 == 0).collect() == [] and ann.nearest(none, F.col("id") % 20 == 0).collect() == []


def test_products_beyond_exact_doubles_are_an_error(spark):
    rows = [(i, [1e6 * (i + 1), 2.0, 3.0]) for i in range(4)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0)


def test_rolling_hashes_of_long_conversations(spark):
    n = 1000
    whole = [("c", k, "user", f"t{k % 7}") for k in range(n)]
    rows = whole + [("p", *r[1:]) for r in whole[:700]] + [("q", *r[1:]) for r in whole] + [("x", *r[1:]) for r in whole[:64]] + [("y", 0, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.collapse(df).collect()}
    assert got == {"c": (n, 2), "y": (1, 1)}
    hashes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(200)]
    rolled = spark.createDataFrame([(hashes,)], "t array<string>").select(chat._rolled(F.col("t")).alias("r")).first()["r"]
    last, want = "", []
    for h in hashes:
        last = hashlib.sha256((last + h).encode()).hexdigest()
        want.append(last)
    assert rolled == want
    assert chat.collapse(df.limit(0)).collect() == []
    took = []
    for m in (20_000, 60_000):
        long = spark.range(m).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
        began = time.time()
        assert [r.n_turns for r in chat.maximal_conversations(long).collect()] == [m]
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 5  # three times the turns


def test_pii_keeps_columns_of_any_name(spark):
    text = "write to a.b@example.com or 10.0.0.1"
    names = ["proposed", "base_email", "wide_ip", "found", "more", "row", "spans", "pii__text", "text"]
    df = spark.createDataFrame([(*["own"] * 8, text), (*["own"] * 8, text), (*["own"] * 8, None)], ", ".join(f"{n} string" for n in names))
    got = pii.with_spans(df, pii.fit(df))
    assert got.columns == [*names, "pii"]
    rows = got.select(*names[:8], pii.span_list(F.col("pii.base")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["email:9:24,ip:28:36"] * 2 + [""] and all(r[n] == "own" for r in rows for n in names[:8])
    assert pii.with_spans(df.limit(0), {}).collect() == []


def test_labelled_pages_decide_their_host(spark):
    bad, mixed, unknown = "http://bad.example.net", "http://mixed.example.net", "http://new.example.net"
    urls = [f"{bad}/es/{i}" for i in range(40)] + [f"{bad}/x{i}" for i in range(60)]
    urls += [f"{unknown}/{i}" for i in range(30)] + [f"http://h{i}.example.org/" for i in range(200)] + [None]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {}
    for r in url_filter.judge(df, URL_RULES).collect():
        got.setdefault((r["host"], r["rule"]), set()).add(r["verdict"])
    assert got[("bad.example.net", "net/es/")] == {"block"} and got[("bad.example.net", None)] == {"block"}
    assert got[("new.example.net", None)] == {"allow"} and got[("h1.example.org", None)] == {"allow"} and got[("", None)] == {"allow"}
    # given outcomes: half good ones are enough to stay
    rows = [(i, f"{mixed}/{i}", i % 2 if i < 40 else None) for i in range(60)] + [(100 + i, f"{bad}/{i}", 1 if i < 20 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, outcome int")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(df, [], outcome_col="outcome").collect()}
    assert got == {"mixed.example.net": "allow", "bad.example.net": "block"}
    assert url_filter.judge(df.limit(0), URL_RULES).collect() == []
