"""A corpus pipeline over ``documents``: stages that each keep or rewrite rows.

Toxic documents go, one document of each near-duplicate group stays, personal
data is replaced, and what is left is packed into batches.  Each stage works on
all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.llm import packing, pii, toxicity
from gridframe.llm.common import materialise, read_table
from gridframe.llm.ngram_join import jaccard_components
from gridframe.llm.queries import trained_network

_SCORE = "pipeline__toxicity"
_KEY, _NO_ID = "pipeline__row", "~"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts are no exception."""
    kept = toxicity.with_score(docs, trained_network(spark, sf_dir), score_col=_SCORE, where=f"{_SCORE} < {toxicity.THRESHOLD}")
    return kept.select(docs.columns)


def row_key(docs: DataFrame) -> Column:
    """Id and text as one string whose order is the ids' (no id last) and then
    that of the texts' hashes."""
    own = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, T.StringType):
        text_of_id = F.hex(own)
    else:
        text_of_id = F.lpad((own + F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast("string"), 21, "0")
    return F.concat(F.coalesce(text_of_id, F.lit(_NO_ID)), F.lit(" "), F.coalesce(F.sha2("text", 256), F.lit("")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, one row: that of the least id (no id last), then of
    the least hash of its text.  Different texts of one id are documents of their
    own; a row repeated with its id and text stays once, and of rows without an
    id all that have no words stay."""
    keyed = docs.withColumn(_KEY, row_key(docs))
    found = jaccard_components(keyed, _KEY)
    kept = found.where(f"{_KEY} = component_id").groupBy(_KEY).agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    single = (F.col("rows") == 1) | ((F.col("n") == 0) & F.col(_KEY).startswith(_NO_ID))
    once = keyed.join(kept.where(single), _KEY, "left_semi")
    repeated = keyed.join(kept.where(~single), _KEY, "left_semi").dropDuplicates([_KEY])
    return once.unionByName(repeated).select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced, and their lengths; null texts stay null."""
    found = pii.with_spans(docs, pii.fit(docs), out="pipeline__pii")
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("pipeline__pii.all")))
    return (found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
            .select(docs.columns))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", redact_pii),
    ("packing", pack_batches),
]

#: No SQL expresses the trained stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied in turn to ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
