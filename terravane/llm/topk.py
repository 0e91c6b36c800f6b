"""Exact top-k inner products: ball trees per shard, searched by branch and bound.

Vectors are dealt to the nearest of a few sampled pivots, so that a cell is a ball: its
pivot and the distance of its farthest vector. Cells above a shard's size are split by
hash. A query visits its cells in the order of their upper bounds, in rounds: the best
cell, then some more, then all others, and only cells whose bound reaches the kth score
that the rounds before gave. Within a shard, a ball tree is searched in the same way.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.shared import discard, materialise

#: Vectors of a leaf, of a shard at most, and of a cell while there are pivots for it.
LEAF, SHARD_ROWS, CELL_ROWS = 32, 16_384, 2_048
#: Pivots at most; they go to the executors.
MOST_PIVOTS = 1_024
#: Queries that one task searches a shard with.
QUERY_BLOCK = 4_096
#: The cells of a query's rounds, by the place of their bounds.
ROUNDS = ((0, 1), (1, 5), (5, None))
LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Nodes with centre, radius, smallest id and a range of rows; splits at the median of the widest coordinate."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        points = vectors.astype(np.float64)
        centres, radii, least = [], [], []

        def build(lo: int, hi: int) -> int:
            at = len(self.nodes)
            own = points[order[lo:hi]]
            centre = own.mean(axis=0) if own.shape[1] else np.zeros(0)
            self.nodes.append((lo, hi, -1, -1))
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            least.append(int(ids[order[lo:hi]].min()))
            if hi - lo > LEAF and radii[at] > 0:
                spread = own.max(axis=0) - own.min(axis=0)
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(spread.argmax())], mid)]
                left, right = build(lo, lo + mid), build(lo + mid, hi)
                self.nodes[at] = (lo, hi, left, right)
            return at

        build(0, len(ids))
        self.vectors, self.ids = vectors[order], ids[order]
        self.centres, self.radii, self.least = np.array(centres), np.array(radii), np.array(least)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No vector of a node has a larger inner product with a query (queries × nodes)."""
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        return q @ self.centres.T + length * self.radii + 1e-9 * length * reach + 1e-3


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; sums beyond 64 bits stop at its limits."""
    top = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, vectors.shape[1])
    if top < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, LOWEST + 1, NO_ID).astype(np.int64)


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best of a tree (scores, ids) that beat its kth so far; unused places hold LOWEST.

    Nodes are taken by the largest upper bound among the queries that still need them. A
    query drops a node whose bound is below its kth score, or equal where the node has
    no smaller id.
    """
    n = len(queries)
    scores = np.full((n, k), LOWEST)
    ids = np.full((n, k), NO_ID)
    kth, kth_id = kth.copy(), kth_id.copy()
    upper = np.maximum(tree.bounds(queries), float(LOWEST))  # sums stop there
    heap = [(-float(upper[:, 0].max(initial=0)), 0, np.arange(n))]
    while heap:
        _, node, active = heapq.heappop(heap)
        bound = upper[active, node]
        active = active[(bound > kth[active]) | ((bound >= kth[active]) & (tree.least[node] < kth_id[active]))]
        if not len(active):
            continue
        lo, hi, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(heap, (-float(upper[active, child].max()), child, active))
            continue
        got = products(queries[active], tree.vectors[lo:hi])
        who = np.broadcast_to(tree.ids[lo:hi], got.shape)
        better = ((got > kth[active, None]) | ((got == kth[active, None]) & (who < kth_id[active, None]))) & (who != query_ids[active, None])
        some = better.any(axis=1)
        if not some.any():
            continue
        active, got, who, better = active[some], got[some], who[some], better[some]
        all_scores = np.concatenate([scores[active], np.where(better, got, LOWEST)], axis=1)
        all_ids = np.concatenate([ids[active], np.where(better, who, NO_ID)], axis=1)
        best = np.lexsort((all_ids, -all_scores.astype(np.float64) if np.abs(got).max() < 2**52 else np.invert(all_scores)), axis=1)[:, :k]
        scores[active] = np.take_along_axis(all_scores, best, axis=1)
        ids[active] = np.take_along_axis(all_ids, best, axis=1)
        full = ids[active, k - 1] != NO_ID
        kth[active[full]], kth_id[active[full]] = scores[active[full], k - 1], ids[active[full], k - 1]
    return scores, ids


def scaled(vector: str) -> Column:
    """floor(1024 * x) of each component, as double; null where the vector or a component is null or not finite."""
    wide = F.col(vector).cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(wide.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * 1024.0).cast("long")))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1) if table.num_rows else values.reshape(0, 0)


OUT = "query_id long, vec_id long, score long"


def _search_group(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids = vectors.column("vec_id").to_numpy()
        tree = BallTree(_matrix(vectors, "q"), ids)
        query_ids = queries.column("query_id").to_numpy()
        scores, found = search(tree, _matrix(queries, "q"), query_ids, queries.column("kth").to_numpy(), queries.column("kth_id").to_numpy(), k)
        real = found != NO_ID
        return pa.table([np.broadcast_to(query_ids[:, None], found.shape)[real], found[real], scores[real]], names=names)

    return run


@dataclass(frozen=True)
class Cells:
    """For each length of vectors: pivots, and how far the farthest vector of each one's cell is (-1: no vectors)."""

    pivots: dict[int, np.ndarray]
    far: dict[int, np.ndarray]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and the distance from its pivot."""
        pivots, x = self.pivots_of(vectors.shape[1]), vectors.astype(np.float64)
        cell = ((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T).argmin(axis=1)
        return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))

    def pivots_of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim)))

    def worth(self, queries: np.ndarray, kth: np.ndarray, places: tuple[int, int | None]) -> list[np.ndarray]:
        """Each query's cells at these places of the order of bounds, if their bounds reach its kth score."""
        pivots, q = self.pivots_of(queries.shape[1]), queries.astype(np.float64)
        far = self.far[queries.shape[1]]
        length, reach = np.sqrt((q**2).sum(axis=1))[:, None], np.sqrt((pivots**2).sum(axis=1)) + far
        upper = q @ pivots.T + length * far + 1e-9 * length * reach + 1e-3
        upper = np.where(far < 0, -np.inf, np.maximum(upper, float(LOWEST)))
        order = np.argsort(-upper, axis=1, kind="stable")[:, places[0] : places[1]]
        at = np.take_along_axis(upper, order, axis=1)
        return [o[(u > -np.inf) & (u >= float(k))] for o, u, k in zip(order, at, kth.tolist(), strict=True)]


def _by_length(f: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Callable:
    """A kernel for mapInArrow that gets the rows of each length of `q` with their matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                yield f(part, _matrix(pa.Table.from_batches([part]), "q").reshape(part.num_rows, dim))

    return run


def _pivots(rows: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Some vectors, the first by a hash of the id, as pivots of their lengths: one for CELL_ROWS vectors, MOST_PIVOTS at most."""
    wanted = min(MOST_PIVOTS, -(-total // CELL_ROWS))
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(wanted).collect():
        found.setdefault(len(r["q"]), []).append(r["q"])
    return {dim: np.unique(np.array(v, dtype=np.float64).reshape(len(v), dim), axis=0) for dim, v in found.items()}


def _deal(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    cells = Cells(pivots, {})

    def kernel(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        cell, far = cells.nearest(x)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*part.schema.names, "cell", "far"])

    return rows.mapInArrow(_by_length(kernel), T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))


def _visits(asks: DataFrame, cells: Cells, places: tuple[int, int | None]) -> DataFrame:
    """(query_id, q, dim, kth, kth_id, cell): the cells that a round searches for each query."""

    def kernel(part: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
        chosen = cells.worth(q, part.column("kth").to_numpy(), places)
        ends = np.cumsum([0, *map(len, chosen)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *chosen]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "cells"])

    schema = T.StructType([*asks.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return asks.mapInArrow(_by_length(kernel), schema).withColumn("cell", F.explode("cells")).drop("cells")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products among all other rows.

    `queries` says which rows are queries. Components are taken as floor(1024 * x). Ties
    go to the smaller id; a query has fewer results if there are fewer rows. Rows without
    id, and vectors that are null or hold null or non-finite components, take no part;
    vectors meet vectors of their own length, however long. Rows that repeat an id and a
    vector count once; a query's own id is never its result. Sums beyond 64 bits stop at
    its limits. An empty table gives an empty result; other columns, whatever their
    names, take no part.

    Shards and query blocks are of bounded size, whatever the table's; a shard is copied
    only for as many blocks as queries reach it. The driver holds the pivots and one row
    for each cell.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), scaled(vector).alias("q"), queries.alias("is_query")).where("vec_id is not null and q is not null")
    rows = rows.dropDuplicates(["vec_id", "q"]).withColumn("dim", F.size("q"))
    rows, rows_at = materialise(rows, "vectors")
    pivots = _pivots(rows.select("vec_id", "q"), rows.count())
    dealt, _ = materialise(_deal(rows, pivots), "cells")
    held = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    far: dict[int, np.ndarray] = {}
    for r in held:
        far.setdefault(r["dim"], np.full(len(pivots.get(r["dim"], [0])), -1.0))[r["cell"]] = r["far"]
    cells = Cells(pivots, far)
    subs = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // SHARD_ROWS)) for r in held], "dim int, cell int, subs int")
    data = dealt.join(F.broadcast(subs), ["dim", "cell"]).select("vec_id", "q", "dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int").alias("sub"))
    asked = dealt.where("is_query").select(F.col("vec_id").alias("query_id"), "q", "dim")
    found = None
    for places in ROUNDS:
        if found is None:
            asks = asked.withColumns({"kth": F.lit(LOWEST).cast("long"), "kth_id": F.lit(NO_ID).cast("long")})
        else:
            kth = _best(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
            asks = asked.join(kth, "query_id", "left").withColumns({"kth": F.coalesce("kth", F.lit(LOWEST)), "kth_id": F.coalesce("kth_id", F.lit(NO_ID))})
        if places[0] >= max((len(f) for f in far.values()), default=0) and found is not None:
            break
        visits, _ = materialise(_visits(asks, cells, places), "visits")
        blocks = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        blocks = subs.join(blocks, ["dim", "cell"])
        key = ["dim", "cell", "sub", "block"]
        left = data.join(F.broadcast(blocks.drop("subs")), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "vec_id", "q")
        right = visits.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.col("query_id"), F.lit(1)), F.col("blocks")).cast("int"))
        right = right.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(*key, "query_id", "q", "kth", "kth_id")
        new, _ = materialise(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search_group(k), OUT), "found")
        found = new if found is None else found.unionByName(new)
    discard(spark, rows_at)
    return _best(found, k)


#: The same rows as exact_top_k over the table embeddings, as DuckDB SQL.
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
