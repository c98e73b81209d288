"""Benchmark decontamination by winnowing.

The words of a text are hashed in k-grams, and of every ``window - k + 1``
k-grams in a row the least hash is kept with its place.  A benchmark item's
windows are its stretches of ``window`` words; a window is one such row of
k-grams, so a document that holds a window keeps the same fingerprint at the same
place in it: every shared stretch of ``window`` words or more is found.  Items
of fewer words are one window of their own length, found by the hashes of all
document stretches of that length.

Fingerprints of all documents are joined with those of the benchmark; hits are
extended to the windows that can hold them, and these are compared word by word.
Everything is DataFrame functions: a document's words and hashes stay arrays of
its row, and only kept fingerprints become rows.

Windows are told apart by their words, not by their items: windows with the same
items form a class, and documents with the same classes an item set, so that a
passage that many items and many documents share isn't paired up in full."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import materialise
from gridframe.operators.joins import broadcast_if_small

WINDOW, GRAM = 10, 5
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE_BITS = 31  # no array is longer
BROADCAST_BYTES = 32 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATOR), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def _coded(hashed: Column, place: Column) -> Column:
    """A hash of 32 bits above its place: the least code is the least hash, leftmost."""
    return F.shiftleft(hashed.bitwiseAND(F.lit(0xFFFFFFFF)), _PLACE_BITS).bitwiseOR(place.cast("long"))


def _gram_codes(words: Column, size: int, short: bool) -> Column:
    """Codes of all stretches of ``size`` words; the hash of an item shorter than
    a window also holds its length."""
    more = [F.lit(size)] if short else []
    places = F.sequence(F.lit(0), F.size(words) - size)
    return F.transform(places, lambda i: _coded(F.xxhash64(F.slice(words, i + 1, size), *more), i))


def fingerprints(words: Column, window: int, gram: int) -> Column:
    """The kept codes of words of at least ``window``; null for fewer."""
    row = window - gram + 1
    def least(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(codes) - row), lambda i: F.least(*(F.get(codes, i + j) for j in range(row)))
                           if row > 1 else F.get(codes, i))
    return F.when(F.size(words) >= window, F.array_distinct(_let(_gram_codes(words, gram, False), least)))


def _hash_of(code: Column) -> Column:
    return F.shiftright(code, _PLACE_BITS)


def _checked(df: DataFrame, text_col: str) -> DataFrame:
    """Broadcast where the measured bytes are few."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col) + 64), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class Shared(NamedTuple):
    """``spans``: a row per different (id, text) that holds windows, with
    ``text_hash``, ``spans`` (an array of word ranges start, end) and ``item_set``.
    ``item_sets``: per item_set its ``items`` as sorted strings."""

    spans: DataFrame
    item_sets: DataFrame


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Different windows (words joined by a space, their number, class), and the
    (class, item) rows.  A class is the set of items that hold a window."""
    w = F.col("w")
    rows = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    stretches = F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.array_join(F.slice(w, i + 1, window), " ")))
    stretches = stretches.when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    pairs = materialise(rows.select("item", F.explode_outer(stretches).alias("words")).where("words is not null").distinct(), "windows")
    h = F.xxhash64("item")
    kinds = pairs.groupBy("words").agg(F.bit_xor(h).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b"), F.count("item").alias("n"))
    kinds = materialise(kinds.select("words", F.size(F.split("words", " ")).alias("size"), F.xxhash64("a", "b", "n").alias("class")), "classes")
    first = kinds.groupBy("class").agg(F.min("words").alias("words"))
    return kinds, pairs.where("item is not null").join(first, "words").select("class", "item")


def _short_windows(words: Column, size: int) -> Column:
    inside = F.filter("at", lambda a: a + size <= F.size(words))
    return F.transform(inside, lambda a: F.struct(a.alias("start"), F.array_join(F.slice(words, a + 1, size), " ").alias("words")))


def shared_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> Shared:
    """Where documents hold windows of benchmark items.

    Null and empty texts have no words: such items have no window, such
    documents no span.  Repeated document rows have the same spans; items that
    are repeated or share an id count once, an item without an id is searched but not
    listed.  Empty tables give empty results.  Only the named columns are read,
    so other columns may have any names."""
    kinds, members = benchmark_windows(items, item_id_col, item_text_col, window)
    sizes = sorted(r["size"] for r in kinds.where(F.col("size") < window).select("size").distinct().collect())

    def codes(words: Column) -> Column:
        none = F.array().cast("array<bigint>")
        lists = [F.coalesce(fingerprints(words, window, gram), none)]
        lists += [F.when(F.size(words) >= n, _gram_codes(words, n, True)).otherwise(none) for n in sizes]
        return F.concat(*lists) if sizes else lists[0]

    parts = F.split("words", " ")
    own = F.when(F.col("size") == window, fingerprints(parts, window, gram))
    own = own.otherwise(F.array(_coded(F.xxhash64(parts, F.col("size")), F.lit(0))))
    marks = materialise(kinds.select(F.explode_outer(own).alias("v")).select(_hash_of(F.col("v")).alias("fp")).distinct(), "marks")

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    kept = texts.select("id", "th", F.explode_outer(_let(words_of(F.col("text")), codes)).alias("v")).withColumn("fp", _hash_of(F.col("v")))
    hits = kept.join(broadcast_if_small(marks), "fp").select("id", "th", F.col("v").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("at"))
    hits = materialise(hits.groupBy("id", "th").agg(F.collect_set("at").alias("at")), "hits")

    # extension: the windows that can hold a hit, whole
    w = F.col("w")
    near = F.transform("at", lambda a: F.sequence(F.greatest(a - (window - gram), F.lit(0)), a))
    starts = F.filter(F.array_distinct(F.flatten(near)), lambda s: s + window <= F.size(w))
    found = [F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(w, s + 1, window), " ").alias("words")))]
    found += [_short_windows(w, n) for n in sizes]
    few = broadcast_if_small(hits.select("id", "th"), 100_000)
    held = texts.join(few, texts["id"].eqNullSafe(few["id"]) & (texts["th"] == few["th"]), "left_semi").dropDuplicates(["id", "th"])
    held = held.select(F.col("id").alias("key"), F.col("th").alias("text_hash"), words_of(F.col("text")).alias("w"))
    whole = held.join(hits, held["key"].eqNullSafe(hits["id"]) & (held["text_hash"] == hits["th"]))
    whole = whole.select("key", "text_hash", F.explode_outer(F.concat(*found)).alias("c")).select("key", "text_hash", "c.start", "c.words")
    matched = whole.join(_checked(kinds, "words"), "words").groupBy("key", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("found"),
        F.sort_array(F.collect_set("class")).alias("classes"))
    matched = materialise(matched.select(F.col("key").alias("id"), "text_hash", _merged(F.col("found")).alias("spans"),
                                         "classes", F.xxhash64("classes").alias("item_set")), "spans")

    sets = matched.groupBy("item_set").agg(F.first("classes").alias("classes")).select("item_set", F.explode("classes").alias("class"))
    listed = sets.join(members, "class").groupBy("item_set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return Shared(matched.drop("classes"), listed)


def _merged(ranges: Column) -> Column:
    """Sorted ranges with overlapping and adjoining ones made one."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    def closed(acc: Column) -> Column:
        return F.when(acc["start"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
    def step(acc: Column, x: Column) -> Column:
        grown = F.struct(acc["done"].alias("done"), acc["start"].alias("start"), F.greatest(acc["end"], x["end"]).alias("end"))
        fresh = F.struct(closed(acc).cast(kind).alias("done"), x["start"].alias("start"), x["end"].alias("end"))
        return F.when(x["start"] <= acc["end"], grown).otherwise(fresh)
    return F.aggregate(ranges, zero, step, lambda acc: closed(acc).cast(kind))


def covered(spans: Column) -> Column:
    """Words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: its id, words, words inside benchmark windows, items
    held (their number, and the digest of their sorted ids), and whether there are any.  Edge
    cases as in ``shared_spans``; a null text has no words, repeated rows stay."""
    found = shared_spans(docs, items, id_col, text_col, **options)
    listed = found.item_sets.select("item_set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    spans = found.spans.join(listed, "item_set", "left").select("id", "text_hash", covered(F.col("spans")).alias("n_hit"), "n_items", "items_sha256")
    spans = materialise(spans, "contaminated")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("th"), word_count(text).alias("n_words"))
    joined = rows.join(spans, rows["key"].eqNullSafe(spans["id"]) & (rows["th"] == spans["text_hash"]), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(F.col("key").alias(id_col), "n_words", hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                         F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))
