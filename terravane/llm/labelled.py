"""Bounded samples of labelled documents, for operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.shared import materialise


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: dict[str, Column], bound: int, keep: Column | None = None) -> DataFrame:
    """Texts of at most `bound` labelled documents, the first by a hash of the id, with label columns as doubles.

    Label rows without id or with a null label are left out; an id that is labelled twice
    counts once. The ids of the sample, `bound` of them at most, are broadcast to the
    documents.
    """
    rows = labels.where("doc_id is not null")
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.select("doc_id", *(c.cast("double").alias(n) for n, c in columns.items())).dropna().dropDuplicates(["doc_id"])
    chosen = rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(bound)
    chosen, _ = materialise(chosen, "label-sample")
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return materialise(sample, "labelled")[0]
