"""The corpus operators as registered queries, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import mix, neardup, quality_model, quality_rules, shard, tokenize, topk, toxicity, url_filter
from terravane.llm.shared import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokenize.encode_decode(docs, public_tokenizers.path(TOKENIZER), ids=False, decoded=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokenize.token_counts(docs, public_tokenizers.path(TOKENIZER), scratch_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = neardup.jaccard_groups(docs)
    return found.select(F.col("key").alias("doc_id"), F.col("group").alias("class_id"), "copies", F.col("links").alias("n_links"), "text_links")


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train_quality(docs, table(spark, sf_dir, "labels"), quality_model.graded())
    return quality_model.grade_documents(docs, model, carry=["doc_id"])


def op7_suffix_array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, carry=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, url_filter.train_url_model())
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_token_counts": op2_token_counts,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_histogram_shards": op5_histogram_shards,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_suffix_array_rules": op7_suffix_array_rules,
    "op8_systematic_mix": op8_systematic_mix,
    "op9_toxicity_grammar": op9_toxicity_grammar,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": topk.TOP_K_SQL,
    "op8_systematic_mix": mix.MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM c",
}
