import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terravane.llm import mix, shard
from tests.llm.cases import documents, empty


def test_shards_hold_equal_bytes(spark):
    rows = [(i, "x" * (i * 37 % 300)) for i in range(3000)] + [(5000 + i, "a copy of one text") for i in range(1500)]
    out = shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 10, 0.01).collect()
    assert len(out) == len(rows)
    texts, total, slots = dict(rows), defaultdict(int), defaultdict(list)
    for r in out:
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(total.values()) / 10
    assert sorted(total) == list(range(10))
    assert max(abs(b - mean) for b in total.values()) <= 0.02 * mean + 2 * 316
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_by_hand(spark):
    """Keys recomputed from the definition: shards are ranges of the sorted keys, each cut within tolerance of its target or at the row next to it."""
    import xxhash

    rows = [(i, f"text {i % 700} " + "y" * (i * 53 % 900)) for i in range(2500)] + [(9000 + i, "hot text") for i in range(1200)] + [(20_000, None), (20_001, "")]
    out = {r["doc_id"]: r for r in shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 12, 0.01).collect()}
    keyed = []
    for i, t in rows:
        text = (t or "").encode()
        keyed.append((xxhash.xxh64(text, seed=42).intdigest() >> 4, xxhash.xxh64(i.to_bytes(8, "little"), seed=42).intdigest() >> 4, i, len(text) + 16))
    keyed.sort()
    assert all(out[i]["size"] == size for _, _, i, size in keyed) and len(out) == len(rows)
    order = [out[i]["shard"] for _, _, i, _ in keyed]
    assert order == sorted(order) and set(order) == set(range(12))
    total = sum(k[3] for k in keyed)
    for cut in range(1, 12):
        below = sum(size for _, _, i, size in keyed if out[i]["shard"] < cut)
        here = order.index(cut)
        assert abs(below - total * cut / 12) <= max(0.01 * total / 12, keyed[here][3], keyed[here - 1][3])


def test_equal_texts_stay_together_unless_cut(spark):
    rows = [(i, f"text {i % 400} of some length") for i in range(4000)]
    out = shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8, 0.02)
    split = out.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()
    assert split <= 7


def test_shards_of_odd_tables(spark, tmp_path):
    docs = documents(spark).withColumns({"size": F.lit(1), "shard": F.lit(2), "slot": F.lit("x")})
    out = shard.shard_by_bytes(docs)
    assert out.count() == docs.count()
    nulls = out.where("doc_id = 100").first()
    assert nulls["size"] == 16 and nulls["text_crc32"] == 0
    assert shard.shard_by_bytes(empty(spark)).count() == 0
    one = shard.shard_by_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 4).collect()
    assert len(one) == 1 and one[0]["slot"] == 0 and 0 <= one[0]["shard"] < 4
    shard.write_shards(documents(spark), f"{tmp_path}/shards", 4)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == docs.count()


def test_splitters_refine_in_few_rounds(spark):
    rows = spark.range(20_000).select(F.lit(10).cast("long").alias("size"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("__k1"), F.lit(0).cast("long").alias("__k2"))
    bounds, rounds = shard.find_splitters(rows, 20, 0.01)
    assert len(bounds) == 19 and rounds <= 3


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_targets_and_taken_words(spark):
    docs = documents(spark, [(1000 + i, "some words " * (i % 50 + 1), "en", "src1" if i % 3 else "ä", 1) for i in range(600)])
    out = mix.mix_sources(docs, carry=["source"]).collect()
    assert len(out) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    want = targets_by_hand(dict(sizes))
    largest = max(r["size"] for r in out)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-5)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], 2 * largest if s in ("src0",) else 0.2 * want[s] + 300)


def test_reruns_and_partitions_agree(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    one = sorted(map(tuple, mix.mix_sources(docs).collect()))
    two = sorted(map(tuple, mix.mix_sources(docs.repartition(7)).collect()))
    assert one == two
    other = sorted(map(tuple, mix.mix_sources(docs, seed=9).collect()))
    assert one != other


def test_mixed_rows(spark):
    docs = documents(spark)
    out = mix.mixed_documents(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in mix.mix_sources(docs.where("doc_id < 60")).collect()}
    assert set(want.values()) <= {0, 1, 2}
    assert mix.mixed_documents(empty(spark)).count() == 0 and mix.mix_sources(empty(spark)).count() == 0
    clash = mix.mixed_documents(docs.withColumns({"copies": F.lit("x"), "size": F.lit(2), "copy": F.lit(3)}))
    assert clash.where("copies = 'x' and size = 2 and copy = 3").count() == out.count() and len(clash.columns) == len(docs.columns) + 3


def test_ranks_by_hand(spark):
    """Copies come from whole numbers that rank * e + u crosses, in the order of size and MD5."""
    import hashlib

    docs = documents(spark).where("source = 'src0' and doc_id is not null")
    out = mix.mix_sources(docs).collect()
    e = out[0]["target"] / out[0]["source_size"]
    u = int(hashlib.md5(b"0:=src0").hexdigest()[:8], 16) / 2**32
    order = sorted(out, key=lambda r: (r["size"], hashlib.md5(str(r["doc_id"]).encode()).hexdigest()))
    for n, r in enumerate(order, 1):
        assert r["copies"] == int(e * n + u) - int(e * (n - 1) + u)
