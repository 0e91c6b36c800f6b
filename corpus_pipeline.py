"""The corpus pipeline: toxic and poor documents go, one of each group of near copies stays, sources are mixed, texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import mix, neardup, quality_rules, tokenize, toxicity
from terravane.llm.queries import TOKENIZER, table
from terravane.llm.shared import added_name, discard, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents whose toxicity score reaches the threshold.

    Nulls and empty texts stay; repeated rows are scored alike. Without labels nothing goes.
    """
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    rejected = added_name(docs.columns, "predicted")
    return toxicity.score_toxicity(docs, model).where(F.col(rejected) == 0).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the quality rules reject, nulls and empty texts among them; repeated rows are judged alike."""
    return quality_rules.quality_rules(docs).where(added_name(docs.columns, "kept")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-gram Jaccard similarity of 0.8 or more, that of the smallest id; of rows that repeat id and text, one."""
    return neardup.without_near_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as systematic sampling towards the sources' targets says: not at all, once or twice; those without words never."""
    return mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with digests of the ids and of the text that they decode to; null texts have no ids."""
    slim = docs.select("doc_id", "lang", "source", "text")
    return tokenize.encode_decode(slim, public_tokenizers.path(TOKENIZER), decoded=False).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_to_weights),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the learned grammar nor BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a table that the next one reads. Columns that clash with an operator's, repeated rows, nulls and empty tables pass."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
        if before:
            discard(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
