"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set sizes decide.

1. Each text's set of word five-grams is hashed. Texts of equal sets are one class
   of copies; only one of them goes on.
2. A tree of the forest labels a text with a sequence of MinHashes. All labels of a
   tree are sorted, which makes them a prefix trie: texts under one node of it are
   neighbours, and the longest prefix that a text shares with any text before it is the
   one it shares with its neighbour. So one pass over the sorted labels finds, for every
   text and tree, its longest matched prefix and the first text under that node.
3. Texts meet where they share a whole label. Matched prefixes are then shortened
   adaptively: every round verifies the texts that meet, takes the weakest link found, and
   shortens to the longest prefix at which a pair as weak as that meets in some tree with
   the target recall. Rounds end when the prefix in use is short enough for the weakest
   link. If m links lie at one similarity, m of them must all be missed for the rounds to
   end too early.
4. Texts that meet form clusters (components of their lines to the nodes' first texts).
   A cluster's texts are verified in blocks, every pair of a cluster: sizes of set
   intersections come from matrix products of blocks, so pairs never become rows. A block
   gives a row for each text (its links) and one for each local root that it connects, so
   lines stay in proportion to texts. Components of the verified links are the groups.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from terravane.llm.graph import components
from terravane.llm.shared import added_name, bounded, discard, materialise, text_chunks
from terravane.llm.words import MIX_A, constants, find_words, mix

#: Texts of a cluster that are verified in one block: few, so that blocks of a large cluster spread evenly; more in very large ones.
BLOCK, LARGEST_BLOCK, MOST_BLOCKS = 128, 1024, 512
#: Bytes of gram sets that a block should hold; a longer single text is a block by itself.
BLOCK_BYTES = 16 << 20
#: Columns of a block's matrix that are multiplied at once.
COLUMNS = 32_768
#: Bytes of a label's value: equal MinHashes have equal values, different ones differ but for a chance of 2**-16.
VALUE_BYTES = 2


@dataclass(frozen=True)
class Forest:
    """trees, depth: of the forest; recall: that the weakest link found must reach."""

    trees: int = 24
    depth: int = 8
    recall: float = 0.9999
    seed: int = 1

    def met(self, similarity: float, depth: int) -> float:
        """The chance that a pair of this similarity shares a prefix of this length in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def prefix(self, similarity: float) -> int:
        """The longest prefix at which a pair of this similarity meets with the wanted recall."""
        return next((d for d in range(self.depth, 1, -1) if self.met(similarity, d) >= self.recall), 1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `words` words in a row; of all its words, if it has fewer; none without words."""
    w = find_words(texts)
    codes = w.hashes()
    m = len(codes)
    key = np.zeros(m, dtype=np.uint64)
    for k in range(words):
        shifted = np.zeros(m, dtype=np.uint64)
        shifted[: m - k] = codes[k:] if k else codes
        key = mix(key * np.uint64(MIX_A) + shifted)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(key[a : b - words + 1]))
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for code in codes[a:b]:
                short = mix(short * np.uint64(MIX_A) + code)
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minhashes(sets: list[np.ndarray], forest: Forest) -> np.ndarray:
    """MinHashes of each set (sets × trees × depth); zeros for empty sets."""
    out = np.zeros((len(sets), forest.trees * forest.depth), dtype=np.uint32)
    at = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(at):
        return out.reshape(len(sets), forest.trees, forest.depth)
    full = [sets[i] for i in at]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
    values = (np.concatenate(full) >> np.uint64(32)).astype(np.uint32)
    flips = (constants(out.shape[1], forest.seed) >> np.uint64(16)).astype(np.uint32)
    scales = (constants(out.shape[1], forest.seed + 1) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
    for k in range(out.shape[1]):
        hashed = (values ^ flips[k]) * scales[k]
        hashed ^= hashed >> np.uint32(15)
        out[at, k] = np.minimum.reduceat(hashed, bounds)
    return out.reshape(len(sets), forest.trees, forest.depth)


def labels(sets: list[np.ndarray], forest: Forest) -> np.ndarray:
    """Each set's label in each tree (sets × trees × depth), as big-endian values: their bytes sort as the values do."""
    return (mix(minhashes(sets, forest).astype(np.uint64)) >> np.uint64(48)).astype(">u2")


def _binaries(data: bytes, n: int, width: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(data)])


def _sketch(docs: DataFrame, words: int, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                sets = shingle_sets(part.column("text"), words)
                n = len(sets) * forest.trees
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * forest.trees), _binaries(labels(sets, forest).tobytes(), n, forest.depth * VALUE_BYTES))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("body"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), own], names=["key", "body", "digest", "grams", "labels"]
                )

    return bounded(docs).mapInArrow(run, "key long, body long, digest binary, grams long, labels array<binary>")


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


# the sorted tries


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of fixed width as a matrix of bytes."""
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[start : start + len(column) * width].reshape(len(column), width)


def _matches(labelled: DataFrame, forest: Forest, floor: int) -> tuple[DataFrame, str]:
    """For a table (node, labels): (a, b, level) and where that table is. Under the longest prefix, `level` values, that node `a` shares with nodes before it in a tree's sorted labels, `b` is the first. Levels below `floor` are left out.

    The sort deals the tries over all partitions by range; the order ends in the node, so
    one label that many texts share can be cut too. What crosses a cut is joined by the
    partitions' first and last rows, two for each.
    """
    depth = forest.depth
    names = ["a", "b", "level", "part", "side", "tree", "label"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last_tree, last_label, last_node = -1, np.zeros((1, depth), ">u2"), 0
        heads = np.zeros(depth + 1, np.int64)  # the first node under the open prefix of each level

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            label = _bytes_of(batch.column("label"), depth * VALUE_BYTES).view(">u2")
            begins = last_tree < 0
            if begins:
                yield _batch([(None, int(node[0]), None, part, 0, int(tree[0]), label[0].tobytes())], kinds, names)
            same = np.concatenate([last_label, label[:-1]]) == label
            level = np.where(np.concatenate([[last_tree], tree[:-1]]) == tree, np.cumprod(same, axis=1).sum(axis=1), 0)
            known = np.concatenate([heads, node])  # rows of the batch come after the open heads
            first = np.empty(n, dtype=np.int64)
            for d in range(depth + 1):
                here = np.where(level < d, np.arange(depth + 1, depth + 1 + n), 0)
                here[0] = here[0] or d
                at = np.maximum.accumulate(here)
                first[level == d] = at[level == d]
                heads[d] = known[at[-1]]
            met = np.flatnonzero(level >= floor)
            last_tree, last_label, last_node = int(tree[-1]), label[-1:].copy(), int(node[-1])
            if len(met):
                none = [pa.nulls(len(met), k) for k in kinds[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(known[first[met]]), pa.array(level[met].astype(np.int32)), *none], names=names)
        if last_tree >= 0:
            yield _batch([(None, last_node, None, part, 1, last_tree, last_label.tobytes())], kinds, names)

    order = labelled.select("node", F.posexplode("labels").alias("tree", "label")).orderBy("tree", "label", "node")
    found, at = materialise(order.mapInArrow(run, "a long, b long, level int, part int, side int, tree int, label binary"), "tries")
    before = Window.orderBy("part", "side")  # two rows for each partition of the sort
    cut = found.where("part is not null").select(F.col("b").alias("a"), F.lag("b").over(before).alias("b"), "tree", F.lag("tree").over(before).alias("left"), "label", F.lag("label").over(before).alias("before"))
    level = F.lit(0)
    for d in range(1, depth + 1):
        level = F.when(F.substring("label", 1, d * VALUE_BYTES) == F.substring("before", 1, d * VALUE_BYTES), F.lit(d)).otherwise(level)
    cut = cut.where("tree = left and a <> b").select("a", "b", level.alias("level")).where(F.col("level") >= floor)
    return found.where("part is null").select("a", "b", "level").unionByName(cut), at


def _lines(matches: DataFrame, depth: int) -> DataFrame:
    """Lines (a, b) that connect what shares a prefix of `depth` values in some tree: each text to the smallest of its nodes' first texts, and these to one another."""
    near = matches.where(F.col("level") >= depth).groupBy("a").agg(F.collect_set("b").alias("b"))  # one for each tree at most
    near = near.select("a", "b", F.array_min("b").alias("least"))
    return near.select("a", F.col("least").alias("b")).unionByName(near.select(F.explode("b").alias("a"), F.col("least").alias("b")))


# verification


def _intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of a block with all of another, or of itself."""
    sets = left if right is None else left + right
    sizes = [len(s) for s in sets]
    if right is None and len(left) == 2:
        both = len(np.intersect1d(left[0], left[1], assume_unique=True))
        return np.array([[sizes[0], both], [both, sizes[1]]])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
    rows, width, m = rows[shared], int((counts > 1).sum()), len(left)
    out = np.zeros((m, m if right is None else len(right)), dtype=np.int64)
    by = np.argsort(column, kind="stable")
    rows, column = rows[by], column[by]
    for a in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, width - a)), dtype=np.float32)
        x[rows[lo:hi], column[lo:hi] - a] = 1
        out += np.rint(x[:m] @ (x if right is None else x[m:]).T).astype(np.int64)
    return out


@dataclass
class Block:
    """Texts of a cluster in the order of their digests: id, documents, gram set, and the place of the smallest text that each is connected to in the block."""

    ids: list[bytes]
    copies: np.ndarray
    sets: list[np.ndarray]
    roots: np.ndarray

    @staticmethod
    def of(rows: list[dict]) -> Block:
        rows = sorted({r["digest"]: r for r in rows}.values(), key=lambda r: r["digest"])
        return Block([r["digest"] for r in rows], np.array([r["copies"] for r in rows], np.int64), [np.frombuffer(r["shingles"], np.uint64) for r in rows], np.arange(len(rows)))

    def similar(self, other: Block | None, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """Which texts are linked to which of the other block (or of this one), and how similar they are."""
        both = _intersections(self.sets, other and other.sets)
        a = np.array([len(s) for s in self.sets])[:, None]
        b = (np.array([len(s) for s in other.sets]) if other else a[:, 0])[None, :]
        union = a + b - both
        linked = both * similarity.denominator >= union * similarity.numerator
        if other is None:
            np.fill_diagonal(linked, False)
        return linked, both / union


class Roots(dict):
    """Union-find over text ids; the smallest id of a set is its root."""

    def root(self, at: bytes) -> bytes:
        while (up := self.setdefault(at, at)) != at:
            self[at] = at = self[up]
        return at

    def join(self, a: bytes, b: bytes) -> None:
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


FOUND = "digest binary, root binary, links long, texts long, weakest double"
KINDS = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
NAMES = ["digest", "root", "links", "texts", "weakest"]
PACKED = ", packed binary, cluster long, block int, blocks int"
PACKED_KINDS, PACKED_NAMES = [pa.binary(), pa.int64(), pa.int32(), pa.int32()], ["packed", "cluster", "block", "blocks"]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _verify(members: DataFrame, similarity: Fraction) -> DataFrame:
    """Blocks of a cluster: a row for each text with links in its block, and the block itself where the cluster has more."""

    def block_rows(rows: list[dict]) -> Iterator[tuple]:
        own, blocks = Block.of(rows), rows[0]["blocks"]
        if len(own.ids) > 1:
            linked, similar = own.similar(None, similarity)
            while True:
                new = np.minimum(own.roots, np.where(linked, own.roots[None, :], len(own.ids)).min(axis=1))
                if (new == own.roots).all():
                    break
                own.roots = new
            links, texts, weakest = linked @ own.copies, linked.sum(axis=1), np.where(linked, similar, 2.0).min(axis=1)
            for i in np.flatnonzero(texts).tolist():
                yield own.ids[i], own.ids[own.roots[i]], int(links[i]), int(texts[i]), float(weakest[i]), None, None, None, None
        if blocks > 1:
            yield None, None, None, None, None, pickle.dumps(own), rows[0]["cluster"], rows[0]["block"], blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []
        for row in _rows_of(batches):
            if held and (row["cluster"], row["block"]) != at:
                out.extend(block_rows(held))
                held = []
                if len(out) > 2000 or (out and out[-1][5]):
                    yield _batch(out, KINDS + PACKED_KINDS, NAMES + PACKED_NAMES)
                    out = []
            at = row["cluster"], row["block"]
            held.append(row)
        if held:
            out.extend(block_rows(held))
        if out:
            yield _batch(out, KINDS + PACKED_KINDS, NAMES + PACKED_NAMES)

    return members.mapInArrow(run, FOUND + PACKED)


def _verify_pairs(blocks: DataFrame, similarity: Fraction) -> DataFrame:
    """Each block against all others of its cluster, which pass by one at a time: a row for each of its texts with links there, and one for each local root that they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own = None

        def result() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(texts).tolist()
            rows = [(own.ids[i], own.ids[i], int(links[i]), int(texts[i]), float(weakest[i])) for i in some]
            rows += [(r, roots.root(r), 0, 0, None) for r in list(roots)]
            if rows:
                yield _batch(rows, KINDS, NAMES)

        for row in _rows_of(batches):
            here, block = (row["cluster"], row["block"]), pickle.loads(row["packed"])
            if here != at:
                if own:
                    yield from result()
                at, own, roots = here, block, Roots()  # the block itself is its first row
                links, texts, weakest = np.zeros(len(own.ids), np.int64), np.zeros(len(own.ids), np.int64), np.full(len(own.ids), 2.0)
                continue
            linked, similar = own.similar(block, similarity)
            if linked.any():
                links += linked @ block.copies
                texts += linked.sum(axis=1)
                weakest = np.minimum(weakest, np.where(linked, similar, 2.0).min(axis=1))
                i, j = np.nonzero(linked)
                for code in np.unique(own.roots[i] * len(block.ids) + block.roots[j]).tolist():
                    roots.join(own.ids[code // len(block.ids)], block.ids[code % len(block.ids)])
        if own:
            yield from result()

    return blocks.mapInArrow(run, FOUND)


def _gram_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column("text"), words)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("copies"), sets], names=["digest", "copies", "shingles"])

    return bounded(texts).mapInArrow(run, "digest binary, copies long, shingles binary").groupBy("digest").agg(F.first("copies").alias("copies"), F.first("shingles").alias("shingles"))


def _links(members: DataFrame, known: DataFrame, similarity: Fraction, tasks: int) -> tuple[DataFrame, float | None]:
    """Verified links of all texts of the clusters in `members` (digest, cluster, block, blocks) as a table (digest, root, links, texts, weakest), and the weakest of all."""
    rows = members.hint("merge").join(known, "digest").select("cluster", "block", "blocks", "digest", "copies", "shingles")
    dealt = rows.repartition(tasks, "cluster", "block").sortWithinPartitions("cluster", "block")
    verified, at = materialise(_verify(bounded(dealt), similarity), "verified")
    blocks = verified.where("packed is not null").select("packed", "cluster", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocks = blocks.select("packed", "cluster", "block", (F.col("own") != F.col("block")).alias("passes"))
    dealt = blocks.repartition(tasks, "cluster", "block").sortWithinPartitions("cluster", "block", "passes")
    seen = Observation()
    found = verified.where("packed is null").select(*NAMES).unionByName(_verify_pairs(bounded(dealt), similarity)).observe(seen, F.min("weakest").alias("weakest"))
    found, _ = materialise(found, "links")
    discard(members.sparkSession, at)
    return found, seen.get["weakest"]


def document_key(id_col: str, text: str) -> Column:
    """A row's id; where it is null, a hash of the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("no id")))


def _body(text: str) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.col(text), F.lit("text"))


def _classes(docs: DataFrame, similarity: float, words: int, forest: Forest, id_col: str, text: str) -> DataFrame:
    """A table (key, body, root, group, copies, links, text_links), one row for each key and text; root is null where a text has no words."""
    spark, exact = docs.sparkSession, Fraction(similarity).limit_denominator(10_000)
    texts = docs.select(document_key(id_col, text).alias("key"), _body(text).alias("body"), F.col(text).alias("text"))
    sketch, sketch_at = materialise(_sketch(texts, words, forest), "forest")
    own, own_at = materialise(sketch.select("key", "body", "digest", "grams").distinct(), "documents")
    node = F.xxhash64("digest").alias("node")  # of candidates only: digests that agree in it would be verified together
    least = F.min(F.struct("key", "body")).alias("first")
    sets, sets_at = materialise(own.where("digest is not null").groupBy("digest").agg(node, least, F.count("*").alias("copies"), F.max("grams").alias("grams")), "sets")
    labelled = sketch.where("digest is not null").groupBy("digest").agg(node, F.first("labels").alias("labels"))
    matches, matches_at = _matches(labelled, forest, forest.prefix(similarity))
    discard(spark, sketch_at)
    near = matches.select(F.col("a").alias("node")).unionByName(matches.select(F.col("b").alias("node"))).distinct().join(sets, "node")
    near, near_at = materialise(near.select("digest", "copies", F.col("first.key").alias("key"), F.col("first.body").alias("body")), "near")
    # both sides grow with the table: a merge join at every size, here and in _links
    known, known_at = materialise(_gram_sets(texts.join(near.hint("merge"), ["key", "body"]).select("digest", "copies", "text"), words), "gram-sets")

    depth, weakest, before, found = forest.depth, 1.0, None, None
    while True:
        clusters = components(_lines(matches, depth)).join(sets.select("node", "digest", "grams"), "node").select("digest", F.col("root").alias("cluster"), "grams")
        sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("grams").alias("grams"))
        if before is not None:  # clusters only grow: one of the same root and size is the same
            sizes = sizes.join(before, ["cluster", "size"], "left_anti")
        wide = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), F.ceil(F.col("size") / MOST_BLOCKS)))
        count = F.greatest(F.ceil(F.col("size") / wide), F.least(F.col("size"), F.ceil(F.col("grams") * 8 / BLOCK_BYTES))).cast("int")
        members = clusters.drop("grams").join(sizes.select("cluster", "size", count.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        seen = Observation()
        members, _ = materialise(members.observe(seen, F.count("*").alias("n")), "members")
        new, least = _links(members, known, exact, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen.get["n"] // (4 * BLOCK))))
        found = new if found is None else found.join(members.select("digest"), "digest", "left_anti").unionByName(new)
        weakest = min(weakest, 1.0 if least is None else least)
        shorter = min(depth, forest.prefix(max(weakest, similarity)))
        if shorter == depth:
            break
        now = members.select("cluster", "size").distinct()
        before = now if before is None else before.unionByName(now)
        depth = shorter

    counts = found.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts")).where("texts > 0")
    groups = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "digest")
    names = groups.join(sets, "digest").groupBy("root").agg(F.min("first.key").alias("group"))
    linked = groups.join(names, "root").join(counts, "digest")
    rows = sets.join(linked, "digest", "left").select(
        "digest", "copies", F.coalesce("root", "digest").alias("root"), F.coalesce("group", "first.key").alias("group"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("text_links")
    )
    rows, _ = materialise(rows, "classes")  # a plain table: the join below may then split a hot digest
    out = own.select("key", "body", "digest").join(rows, "digest", "left").select(
        "key", "body", "root", F.coalesce("group", "key").alias("group"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"),
    )
    out, _ = materialise(out, "groups")
    discard(spark, own_at, sets_at, matches_at, near_at, known_at)
    return out


def jaccard_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, forest: Forest = Forest(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, group (the smallest key of its group), copies (documents of the same set of five-grams, itself included), links (other documents of at least `similarity`, copies included) and text_links (different texts among them).

    Ids are cast to long; null ids are told apart by text. Rows that repeat id and text are
    one document; rows that repeat an id with another text are further ones, with a row
    each. Texts of fewer words than a five-gram are one gram of all their words; null
    texts and texts without words have no grams, no links and a group of their own. Very
    long texts are taken whole; a block of the verification holds one at least. Links as
    weak as the weakest found meet with the forest's recall or more, and every candidate
    is verified exactly, so no link is false. An empty table gives an empty result. Other
    columns, whatever their names, take no part. No group of copies, node or cluster is
    gathered in one task. The result is a table in the shared folder.
    """
    return _classes(docs, similarity, words, forest, id_col, text).drop("body", "root")


def without_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, forest: Forest = Forest(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with one document of each group of jaccard_groups, that of the smallest key (then text hash).

    Rows that repeat id and text are one document, of which one row stays; texts without
    words all stay. An empty table stays empty; columns keep their names, whatever they are.
    """
    classes = _classes(docs, similarity, words, forest, id_col, text)
    first = classes.where("root is not null").groupBy("root").agg(F.min(F.struct("key", "body")).alias("first")).select("first.*")
    key, body = added_name(docs.columns, "key"), added_name(docs.columns, "body")
    kept = first.unionByName(classes.where("root is null").select("key", "body")).toDF(key, body)
    return docs.withColumns({key: document_key(id_col, text), body: _body(text)}).join(kept, [key, body]).dropDuplicates([key, body]).select(*docs.columns)
