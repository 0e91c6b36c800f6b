import math
import random

import numpy as np
from pyspark.sql import functions as F

from terravane.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault((i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)), None)
    out = []
    for i, q in fine:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in fine if j != i and len(w) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, k=10):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # many copies of one vector
    rows += [(7, rows[7][1]), (2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2100, [0.5, 0.5]), (2104, [0.25, -0.5])]
    assert found(spark, rows) == brute(rows, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0])]
    assert found(spark, rows) == [(0, 1, 1, 1024 * 1024)]
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0])]) == []


def test_extra_columns_and_large_values(spark):
    rows = [(0, [3e6] * 4), (1, [2e6] * 4), (2, [-1e6] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit(1)).withColumn("shard", F.lit(2))
    out = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    limit = 2**63 - 1  # sums beyond 64 bits stop at its limits
    assert out == [(0, 1, 1, min(limit, 4 * 3_000_000 * 2_000_000 * 1024**2)), (0, 2, 2, max(-limit, -4 * 3_000_000 * 1_000_000 * 1024**2))]


def test_tree_prunes_and_shares_the_kth_score():
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.integers(-50, 50, (2000, 6)), rng.integers(900, 1000, (64, 6))])
    tree = topk.BallTree(vectors, np.arange(len(vectors)))
    query = np.full((1, 6), 1000)
    seen = []
    plain = topk.products
    topk.products = lambda q, v: (seen.append(len(v)), plain(q, v))[1]
    try:
        scores, _ = topk.search(tree, query, np.array([-1]), np.array([topk.LOWEST]), np.array([topk.NO_ID]), 10)
        first = sum(seen)
        seen.clear()
        topk.search(tree, query, np.array([-1]), np.array([int(tree.bounds(query)[:, 1:].max()) + 1]), np.array([0]), 10)
    finally:
        topk.products = plain
    assert first < len(vectors) / 4 and sum(seen) == 0
    assert scores[0].tolist() == sorted((vectors @ query[0]).tolist(), reverse=True)[:10]


def test_rounds_visit_few_cells_of_clustered_vectors(spark, monkeypatch):
    """Clusters in far directions: a query's own cluster gives a kth score that no other cell's bound reaches; results stay exact."""
    monkeypatch.setattr(topk, "CELL_ROWS", 50)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 10) for _ in range(6)] for _ in range(20)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 20]]) for i in range(2000)]
    visits, plain = [], topk._visits
    monkeypatch.setattr(topk, "_visits", lambda asks, cells, places: (visits.append((plain(asks, cells, places).count(), len(cells.pivots[6]))), plain(asks, cells, places))[1])
    assert found(spark, rows) == brute(rows, 10)
    pivots = visits[0][1]
    assert pivots > 10 and sum(n for n, _ in visits) < 20 * pivots / 2  # 20 queries


def test_cells_split_and_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CELL_ROWS", 100)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(rng.choice([2, 3, 3, 3]))]) for i in range(900)]
    assert found(spark, rows) == brute(rows, 10)
