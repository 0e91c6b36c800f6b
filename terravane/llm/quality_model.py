"""Quality by ordinal cumulative-link regression on hashed text.

P(grade >= j) = logistic(x·w - t_j) with one weight vector for all grades and
ordered thresholds t_1 < t_2 < ... Features are hashed words and hashed word
shapes (runs of letter kinds and punctuation, with a mark for a word that repeats the
one before it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.labelled import labelled_sample
from terravane.llm.shared import added_name, bounded, text_chunks
from terravane.llm.words import MIX_A, find_words, mix, span_hashes

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 12, 1 << 10
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS

#: The kind of each byte in a shape: lower-case and non-ASCII letters, capitals, digits; other bytes are their own kind.
KIND = np.arange(256, dtype=np.uint8)
KIND[ord("a") : ord("z") + 1] = KIND[0x80:] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3


@dataclass
class Sparse:
    """Rows of feature values: row, bucket and value of each entry."""

    rows: int
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, minlength=self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row] * self.value, minlength=BUCKETS)


def features(texts: pa.Array) -> Sparse:
    """Hashed words and shapes: log counts, each half of the buckets scaled to unit length per text."""
    w = find_words(texts)
    n, words = len(w.bounds) - 1, w.hashes()
    if not len(words):
        return Sparse(n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    kind = KIND[w.data]
    run = np.ones(len(kind), dtype=bool)
    run[1:] = kind[1:] != kind[:-1]
    run[w.starts] = True
    place = np.cumsum(run)
    shapes = span_hashes(kind[run], place[w.starts] - 1, place[w.ends - 1])
    again = np.zeros(len(words), dtype=np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (w.doc[1:] == w.doc[:-1])
    shapes = mix(shapes * np.uint64(MIX_A) + again)
    at = np.concatenate([(words % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS + (shapes % np.uint64(SHAPE_BUCKETS)).astype(np.int64)])
    key, count = np.unique(np.tile(w.doc, 2) * BUCKETS + at, return_counts=True)
    row, at, value = key // BUCKETS, key % BUCKETS, np.log1p(count)
    half = row * 2 + (at >= WORD_BUCKETS)
    norm = np.sqrt(np.bincount(half, value**2, minlength=2 * n))
    return Sparse(n, row, at, value / norm[half])


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, x: Sparse) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... (rows × thresholds)."""
        return 1 / (1 + np.exp(-np.clip(x.dot(self.weights)[:, None] - self.thresholds, -30, 30)))


def fit_ordinal(x: Sparse, grades: np.ndarray, levels: int, l2: float = 1e-3, rounds: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on full batches; thresholds are a first one and positive steps."""
    n = max(1, len(grades))
    share = np.clip([(grades >= j).mean() if len(grades) else 0.5 for j in range(1, levels)], 1e-3, 1 - 1e-3)
    base = np.maximum.accumulate(-np.log(share / (1 - share)))
    theta = np.concatenate([np.zeros(BUCKETS), base[:1], np.log(np.maximum(np.diff(base), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1 if len(grades) else 1):
        gaps = np.exp(theta[BUCKETS + 1 :])
        t = theta[BUCKETS] + np.concatenate([[0.0], np.cumsum(gaps)])
        tail = 1 / (1 + np.exp(-np.clip(x.dot(theta[:BUCKETS])[:, None] - t, -30, 30)))
        full = np.column_stack([np.ones(len(grades)), tail, np.zeros(len(grades))])
        own = np.maximum(full[np.arange(len(grades)), grades] - full[np.arange(len(grades)), grades + 1], 1e-9)
        slope = full * (1 - full)
        down = slope[np.arange(len(grades)), grades] / own / n
        up = slope[np.arange(len(grades)), grades + 1] / own / n
        g_t = np.zeros(levels + 1)
        np.add.at(g_t, grades, down)
        np.add.at(g_t, grades + 1, -up)
        g_t = g_t[1:levels]
        g = np.concatenate([-x.back(down - up) + l2 / 10 * theta[:BUCKETS], [g_t.sum()], [g_t[k + 1 :].sum() * gaps[k] for k in range(levels - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(theta[:BUCKETS], theta[BUCKETS] + np.concatenate([[0.0], np.cumsum(np.exp(theta[BUCKETS + 1 :]))]))


def graded() -> Column:
    """The rating that the labels give: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).otherwise(F.when(F.col("toxic") == 1, 1).otherwise(2))


def train_quality(docs: DataFrame, labels: DataFrame, grade: Column, levels: int = 3, bound: int = 8_192) -> OrdinalModel:
    """Fits the model on the driver to at most `bound` labelled documents: at most `bound` × BUCKETS feature entries."""
    sample = labelled_sample(docs, labels, {"grade": F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), grade)}, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                x = features(part.column("text"))
                ends = np.searchsorted(x.row, np.arange(x.rows + 1))
                at, value = x.at.astype(np.int16).tobytes(), x.value.astype(np.float32).tobytes()
                cut = [pa.array([b[s * int(ends[i]) : s * int(ends[i + 1])] for i in range(x.rows)], pa.binary()) for b, s in ((at, 2), (value, 4))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), *cut], names=["doc_id", "grade", "at", "value"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = bounded(sample).mapInArrow(run, f"doc_id {kind}, grade double, at binary, value binary").toPandas().sort_values("doc_id")
    at = [np.frombuffer(b, np.int16).astype(np.int64) for b in rows["at"]]
    value = [np.frombuffer(b, np.float32).astype(np.float64) for b in rows["value"]]
    x = Sparse(len(rows), np.repeat(np.arange(len(rows)), [len(a) for a in at]), np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0), *value]))
    return fit_ordinal(x, rows["grade"].to_numpy().astype(int), levels)


def grade_documents(docs: DataFrame, model: OrdinalModel, tail: int = 1, least: float = 0.5, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds expected_grade, tail_probability = P(grade >= `tail`) and kept (it reaches `least`) to every row; `carry` names the columns to keep.

    Null and empty texts have no features and are graded by the thresholds alone, then
    never kept. Copies and repeated rows are graded alike; very long texts are read whole;
    a probability of exactly `least` is kept. An empty table gives an empty one. Where a column of the table
    has an added column's name, the added one gets underscores behind it
    (shared.added_name).
    """
    kept = docs.columns if carry is None else carry
    added = (("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType()), ("kept", T.BooleanType()))
    source = docs.select(*dict.fromkeys([*kept, text]))
    at, text_at = [source.columns.index(c) for c in kept], source.columns.index(text)
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(added_name(kept, n), t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, batch.schema.names[text_at]):
                x = features(part.column(text_at))
                tails = model.tails(x)
                wordy = np.bincount(x.row, minlength=x.rows) > 0
                new = [pa.array(tails.sum(axis=1)), pa.array(tails[:, tail - 1]), pa.array((tails[:, tail - 1] >= least) & wordy)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *new], names=schema.names)

    return bounded(source).mapInArrow(run, schema)
