"""The registered queries: one thin query per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import ann, bpe, chat, decontaminate, packing, pii, runs, topk, toxicity, url_filter, warc, whitening
from gridframe.llm.common import read_table
from gridframe.llm.ngram_join import jaccard_components

# fixed values: the rules of the url query
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are kept for evaluation."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1


def trained_network(spark: SparkSession, sf_dir: str) -> toxicity.Network:
    """Fitted on labelled rows of ``documents`` that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.train(toxicity.training_sample(docs, labels, ~held_out("id")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, trained_network(spark, sf_dir), score_col="score", keep_text=False)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the installed package of public tokenizers keeps the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    index = warc.write(read_table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(read_table(spark, sf_dir, "conversations"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.fit(docs))
    def count(k: int) -> Column:
        return F.size(F.filter("pii.base", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("pii.base")), 256).alias("base_sha256"),
                        pii.span_list(F.col("pii.all")).alias("spans"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_rate_lower")})


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(read_table(spark, sf_dir, "documents"), planted=True)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op6_chat_collapse": op6_chat_collapse,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_pii": op8_pii,
    "op9_url_reputation": op9_url_reputation,
    "op10_ann": op10_ann,
    "op11_decontaminate": op11_decontaminate,
    "op12_whitening": op12_whitening,
    "op13_runs": op13_runs,
}
