import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terravane.llm import neardup, quality_rules, toxicity
from tests.llm.test_neardup import brute
from tests.llm.test_shard_mix import targets_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("tables")
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 160))]
        bad = int(i % 6 == 0)
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zorgle")
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 1))
        labels.append((i, 1, bad))
    for i in range(40):
        words = rows[1 + 6 * i][1].split() if i else rows[1][1].split()
        words[5] = f"edit{i}"
        rows.append((1000 + i, " ".join(words), "en", "src1", 1))
    rows += [(2000, "loop " * 100, "en", "src0", 1), (2001, None, None, None, None), (2002, "too short", "en", "src0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, labels


def test_stages_one_by_one(spark, folder):
    path, rows, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        target = f"{path}/out-{len(kept)}"
        out.write.parquet(target)
        docs = spark.read.parquet(target)
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    a, b, c, d, e = kept.values()
    bad = {i for i, _, t in labels if t}
    assert not bad & set(a) and len(set(text) - set(a) - bad) <= 2
    assert 2000 in a and not {2000, 2001, 2002} & set(b) and set(a) - set(b) <= {2000, 2001, 2002}
    groups = brute([(i, text[i]) for i in b])
    assert sorted(c) == sorted(i for i in b if groups[i][0] == i)
    size = {i: len(text[i].split()) for i in c}
    source = {r[0]: r[3] for r in rows}
    total = {s: sum(size[i] for i in c if source[i] == s) for s in {source[i] for i in c}}
    want = targets_by_hand(total)
    for s in total:
        assert abs(sum(size[i] for i in d if source[i] == s) - want[s]) < 0.03 * want[s] + 160
    assert all(d.count(i) <= 2 for i in set(d)) and sorted(e) == sorted(d)


def test_run_is_the_stages(spark, folder):
    path, rows, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.where("n_tokens <> size(ids)").count() == 0 and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_operators_are_those_of_the_queries():
    assert corpus_pipeline.neardup is neardup and corpus_pipeline.quality_rules is quality_rules and corpus_pipeline.toxicity is toxicity


def test_odd_tables_pass(spark, folder, tmp_path):
    """Columns that clash with those of the operators, repeated rows, nulls; and an empty table."""
    path, rows, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.unionByName(docs.where("doc_id < 40")).withColumns({c: F.lit("x") for c in ("score", "predicted", "kept", "n_words", "size", "copies", "n_tokens", "key", "body")})
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("odd", "none"):
        spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").select("doc_id").collect()]
    assert len(ids) > 100 and max(ids.count(i) for i in set(ids)) <= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
