"""Chat formatting: logged snapshots of a conversation collapse to the longest.

A chat service that logs a conversation after every turn leaves prefixes of
it.  Each conversation's turns get rolling hashes, the k-th naming its first k
turns; a conversation whose whole hash is a proper prefix hash of another is
dropped by an anti-join, of equal ones the least id stays, and the maximal
ones are rendered.

Turns are ordered by turn, nulls first, equal ones by a hash of role and text; a null role or text
differs from an empty one in the hashes and renders as empty.  Rows without a conv_id are
one conversation.  Prefix hashes are linear in the turns; a first turn or
whole conversation that very many share is aggregated before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_turn(role: Column, text: Column) -> Column:
    none = F.lit("")
    return F.concat(F.lit(OPEN), F.coalesce(role, none), F.lit("\n"), F.coalesce(text, none), F.lit(CLOSE + "\n"))


def _turn_hash() -> Column:
    marked = [F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.sha2(F.coalesce(c, F.lit("")), 256)) for c in ("role", "text")]
    return F.sha2(F.concat(*marked), 256)


def _rolled(hashes: Column) -> Column:
    """Rolling hashes, the k-th of the first k elements.  An array is only ever
    extended within a block, so the work is linear in the elements."""
    def within(last: Column, block: Column) -> Column:
        one = lambda acc, h: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), last), h), 256)))
        return F.aggregate(block, F.array().cast("array<string>"), one)

    def step(acc: Column, b: Column) -> Column:
        found = F.transform(F.array(within(acc["last"], F.slice(hashes, b * _BLOCK + 1, _BLOCK))), lambda x: F.struct(
            F.element_at(x, -1).alias("last"), F.concat(acc["out"], F.array(x)).alias("out")))
        return F.get(found, F.lit(0))

    zero = F.struct(F.lit("").alias("last"), F.array().cast("array<array<string>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / _BLOCK).cast("int"))
    return F.flatten(F.aggregate(blocks, zero, step, lambda acc: acc["out"]))


def maximal_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, whole) of the conversations that prefix no other; ``whole``
    names the sequence of turns."""
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    hashed = rows.select("id", "turn", "role", "text", _turn_hash().alias("h"))
    whole = (hashed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", F.xxhash64("role", "text").alias("tie"), "h"))).alias("t"))
             .select("id", F.size("t").alias("n_turns"), F.transform("t", lambda x: x["h"]).alias("t")))
    whole = whole.select("id", "n_turns", _rolled(F.col("t")).alias("rolled")).withColumn("whole", F.element_at("rolled", -1))
    prefixes = whole.select(F.explode(F.slice("rolled", 1, F.col("n_turns") - 1)).alias("whole")).distinct()
    least = F.min(F.struct(F.col("id").isNull().alias("null"), F.col("id")))
    kept = whole.groupBy("whole").agg(least.alias("k"), F.first("n_turns").alias("n_turns"), F.count("*").alias("copies"))
    return kept.join(prefixes, "whole", "left_anti").select(F.col("k.id").alias("id"), "n_turns", "copies", "whole")


def collapse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """Per maximal conversation: its id, n_turns, copies (equal ones, itself
    included) and the rendered text."""
    kept = maximal_conversations(turns, id_col, turn_col, role_col, text_col).select("id", "n_turns", "copies")
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    own = rows.join(kept, rows["id"].eqNullSafe(kept["id"])).select(kept["id"], "n_turns", "copies", "turn", "role", "text")
    turn = F.struct("turn", F.xxhash64("role", "text").alias("tie"), render_turn(F.col("role"), F.col("text")).alias("line"))
    return (own.groupBy("id").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(turn)).alias("t"))
            .select(F.col("id").alias(id_col), "n_turns", "copies", F.array_join(F.transform("t", lambda x: x["line"]), "").alias("rendered")))
