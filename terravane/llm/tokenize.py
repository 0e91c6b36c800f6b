"""Tokenising whole tables: encoding and decoding, and counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.bpe import encoder_of, read_spec
from terravane.llm.shared import added_name, bounded, discard, materialise, text_chunks

#: Digests of 32 bytes that may be broadcast, 4 MB.
SMALL_MISSES = 100_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest that names a tokenizer: of its file's bytes."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _with_columns(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(added_name(df.columns, n), T._parse_datatype_string(t)) for n, t in fields)])


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Adds the token ids of every whole text (`ids`, as an array) and the text that they decode to (`decoded`).

    Null and empty texts have no ids and decode to the empty text; very long ones are
    encoded whole. Every row is encoded by itself, so repeated rows come out alike, and an
    empty table gives an empty one. Other columns pass through. Always adds n_tokens,
    ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256;
    where a column has an added column's name already, the added one gets underscores
    behind it (shared.added_name). The tokenizer file is read on the driver and sent to
    the executors, a few MB at any size of the table.
    """
    spec, key = read_spec(tokenizer_path), tokenizer_version(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("ids", "array<int>")] * ids + [("decoded", "string")] * decoded
    schema = _with_columns(docs, *fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(key, sent.value)
        for batch in batches:
            for part in text_chunks(batch, text):
                packed = bpe.encode_texts(part.column(text).to_pylist())
                plain = [bpe.decode_ids(p) for p in packed]
                new = [
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in plain], pa.string()),
                ]
                if ids:
                    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                    new.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                if decoded:
                    new.append(pa.array(plain, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return bounded(docs).mapInArrow(run, schema)


def _count_distinct(distinct: DataFrame, tokenizer_path: str) -> DataFrame:
    spec, key = read_spec(tokenizer_path), tokenizer_version(tokenizer_path)
    sent = distinct.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(key, sent.value)
        for batch in batches:
            for part in text_chunks(batch):
                counts = [len(p) // 4 for p in bpe.encode_texts(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(counts), pa.string()), part.column("digest"), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    return bounded(distinct).mapInArrow(run, CACHE_SCHEMA)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at `path`; it begins empty."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to every row, through the cache of counts at `cache_path`.

    The key of a count is the SHA-256 of the content as the tokenizer normalises it
    (byte-level BPE: its UTF-8 bytes as they are; null counts as empty) with the SHA-256
    of the tokenizer's file. Contents that the cache lacks are gathered once each
    (copies fold before the exchange), encoded and appended; then all rows are joined to
    the cache, a join whose hot keys Spark may split. Appending the same count twice,
    as two jobs at once may do, changes nothing: counts are read distinct.
    Very long texts are counted whole; an empty table gives an empty one. Where a column
    has an added column's name already, the added one gets underscores behind it
    (shared.added_name).

    Digests meet the cache without their texts. Where the digests that it lacks fit
    SMALL_MISSES, they are broadcast to the texts and only these are shuffled; beyond
    that, every content is shuffled once.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    cached = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses, misses_at = materialise(docs.select(digest.alias("digest")).distinct().join(cached, "digest", "left_anti"), "misses")
    contents = docs.select(digest.alias("digest"), content.alias("text"))
    if misses.count() <= SMALL_MISSES:
        wanted = contents.join(F.broadcast(misses), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    else:
        wanted = contents.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")
    _count_distinct(wanted, tokenizer_path).write.mode("append").parquet(cache_path)
    discard(spark, misses_at)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    key, bytes_, tokens, over = (added_name(docs.columns, n) for n in ("digest", "n_bytes", "n_tokens", "over_limit"))
    known = known.groupBy(F.col("digest").alias(key)).agg(F.max("n_tokens").alias(tokens))
    known, _ = materialise(known, "counts")  # a plain table: the join below may then split a hot digest
    slim = [c for c in docs.columns if c != text]
    rows = docs.select(*slim, digest.alias(key), F.octet_length(content).cast("long").alias(bytes_))
    return rows.join(known, key).drop(key).withColumn(over, F.col(tokens) > limit)
