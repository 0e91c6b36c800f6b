import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravane.llm import tokenize
from terravane.llm.bpe import SHIFT, SegmentTreeBpe, read_spec
from tests.llm.cases import documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return SegmentTreeBpe(read_spec(PATH))


def ids(own, text):
    return np.frombuffer(own.encode_texts([text])[0], "<u4").tolist()


@pytest.mark.parametrize("text", ["", "a", " a  b \n\n", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "it's we'll 'RE", "日本語 😀👍🏽", "\x00\x1c\x85\u200b　", "ab" * 3000, "x" * 70_000, "٣٤ ²³ ½", "e\u0301"])
def test_ids_and_text_are_those_of_the_library(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want
    assert own.decode_ids(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(own, library, text):
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_long_and_short_words_take_the_same_merges(own):
    for word in ("internationalisation" * 3, "aaaaaaaa", " thethethe"):
        raw = word.encode()
        width = 1 << (len(raw) - 1).bit_length()
        assert own._encode_long(raw) == own._encode_matrix([raw], width)[0]


def test_long_words_take_merges_of_any_rank():
    """Ranks raised by 2**24 make leaves as large as in a word of more than 16 MiB."""
    plain, raised = SegmentTreeBpe(read_spec(PATH)), SegmentTreeBpe(read_spec(PATH))
    raised.by_key = {k: r << 24 for k, r in raised.by_key.items()}
    raised.ranks = raised.ranks << 24
    raised.merged = {r << 24: m for r, m in enumerate(raised.merged.tolist())}
    late = max(plain.by_key, key=plain.by_key.get)
    raw = (b"internationalisation" + plain.token_bytes[late >> SHIFT] + plain.token_bytes[late & ((1 << SHIFT) - 1)]) * 4
    assert plain._encode_long(raw) == raised._encode_long(raw) != plain.first[np.frombuffer(raw, np.uint8)].astype("<u4").tobytes()


def test_ids_that_are_no_utf8_decode_with_replacements(own, library):
    for some in ([255], [447, 222], [128, 129, 130]):
        assert own.decode_ids(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_tables(spark, library):
    docs = documents(spark).withColumn("extra", F.lit(1))
    out = tokenize.encode_decode(docs, PATH).collect()
    assert len(out) == docs.count()
    for row in out:
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == want and row["n_tokens"] == len(want) and row["decoded"] == (row["text"] or "")
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    assert tokenize.encode_decode(empty(spark), PATH).count() == 0
    clash = tokenize.encode_decode(docs.withColumn("n_tokens", F.lit("x")), PATH)
    assert clash.where("n_tokens = 'x' and n_tokens_ = size(ids)").count() == docs.count()


def test_counts_through_the_cache(spark, library, tmp_path):
    docs, cache = documents(spark), f"file://{tmp_path}/cache"
    first = tokenize.token_counts(docs, PATH, cache).join(docs.select("doc_id", "text").dropDuplicates(), "doc_id").collect()
    assert len(first) >= docs.where("doc_id is not null").count()
    for row in first:
        assert row["n_tokens"] == len(library.encode(row["text"] or "", add_special_tokens=False).ids)
        assert row["n_bytes"] == len((row["text"] or "").encode()) and row["over_limit"] == (row["n_tokens"] > 512)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = tokenize.token_counts(docs, PATH, cache)
    assert again.count() == docs.count()
    assert spark.read.parquet(cache).count() == stored.count()
    more = documents(spark, [(900, "a new text", "en", "src0", 1)])
    assert tokenize.token_counts(more, PATH, cache).where("doc_id = 900").first()["n_tokens"] == len(library.encode("a new text").ids)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert tokenize.token_counts(empty(spark), PATH, f"file://{tmp_path}/other").count() == 0


def test_cached_counts_are_used(spark, tmp_path):
    """A stored count wins over encoding: the cache is looked up first."""
    docs = spark.createDataFrame([(1, "known")], "doc_id long, text string")
    cache, version = f"file://{tmp_path}/cache", tokenize.tokenizer_version(PATH)
    spark.createDataFrame([(version, hashlib.sha256(b"known").digest(), 77), ("another", hashlib.sha256(b"known").digest(), 5)], tokenize.CACHE_SCHEMA).write.parquet(cache)
    assert tokenize.token_counts(docs, PATH, cache).first()["n_tokens"] == 77
