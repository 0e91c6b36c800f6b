"""Quality rules: base counts and repetition by word suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terravane.llm.shared import added_name, bounded, text_chunks
from terravane.llm.words import BASE, MIX_A, MIX_B, Words, find_words, mix, span_hashes

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionLimits:
    """A document stays while at most `covered` of its words lie in repeated substrings of `least_words` or more, and the longest repeat is at most `longest` of its words.

    The base rule rejects half of the words in repeated three-word windows, which implies
    `covered` from 0.5 on, and `longest` from 0.25 on as a passage given twice counts twice.
    `covered` is the share of repeated paragraphs that published web-corpus rules allow; one
    passage given twice may make a quarter of a text, so `longest` is below half of `covered`
    and either limit can reject alone.
    """

    least_words: int = 5
    covered: float = 0.3
    longest: float = 0.125


def suffix_repeats(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur again elsewhere in the same text.

    codes: a word's code; first: index of each text's first word, and the total. Suffix
    arrays of all texts are built at once by prefix doubling: words that are alone in
    their class of equal 1, 2, 4, ... word prefixes drop out. Suffixes that are
    neighbours in the order share their longest common prefix; the largest of a
    suffix's two is the height of the highest interval that holds it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    lens = np.diff(first)
    doc = np.repeat(np.arange(len(lens)), lens)
    stop = np.repeat(first[1:], lens)
    key = mix(codes + doc.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    heads = np.ones(n, dtype=bool)
    heads[1:] = ordered[1:] != ordered[:-1]
    start_of = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    # words of a batch fit 32 bits, and every level keeps its ranks
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    rank[order] = start_of
    alone = heads.copy()
    alone[:-1] &= heads[1:]
    active = order[~alone]
    levels, h = [rank.copy()], 1
    tied = active.copy()
    while len(active):
        nxt = active + h
        second = np.where(nxt < stop[active], rank[np.minimum(nxt, n - 1)], -1)
        own = rank[active]
        by = np.lexsort((second, own))
        active, own, second = active[by], own[by], second[by]
        group = np.ones(len(active), dtype=bool)
        group[1:] = own[1:] != own[:-1]
        begin = np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        split = group.copy()
        split[1:] |= second[1:] != second[:-1]
        at = np.maximum.accumulate(np.where(split, np.arange(len(active)), 0))
        rank[active] = own + at - begin
        single = split.copy()
        single[:-1] &= split[1:]
        active = active[~single]
        levels.append(rank.copy())
        h *= 2
    out = np.zeros(n, dtype=np.int64)
    if not len(tied):
        return out
    sa = tied[np.argsort(rank[tied], kind="stable")]
    i, j = sa[:-1], sa[1:]
    same = levels[0][i] == levels[0][j]
    i, j = i[same], j[same]
    lcp = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        ok = (a < stop[i]) & (b < stop[j])
        hit = ok & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]) & (a != b)
        lcp[hit] += 1 << k
    np.maximum.at(out, i, lcp)
    np.maximum.at(out, j, lcp)
    return out


def covered_words(repeat: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in the union of repeated substrings of `least` words or more."""
    n = len(repeat)
    mark = np.zeros(n + 1, dtype=np.int64)
    long = np.flatnonzero(repeat >= least)
    np.add.at(mark, long, 1)
    np.add.at(mark, long + repeat[long], -1)
    return np.cumsum(mark[:n]) > 0


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(w: Words) -> np.ndarray:
    n = len(w.bounds) - 1
    breaks = np.flatnonzero(w.data == 0x0A)
    edges = np.unique(np.concatenate([breaks, breaks + 1, w.bounds]))
    starts, ends = edges[:-1], edges[1:]
    keep = w.data[starts] != 0x0A if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    wordy = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[wordy], ends[wordy]
    doc = np.searchsorted(w.bounds, starts, side="right") - 1
    key = mix(span_hashes(w.data, starts, ends) + doc.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[1:] = key[order[1:]] == key[order[:-1]]
    return np.bincount(doc[order][again], minlength=n)


def _repeat_words(w: Words, codes: np.ndarray, width: int = 3) -> np.ndarray:
    """Words in windows of `width` words that a text holds twice or more."""
    m = len(codes)
    out = np.zeros(m, dtype=bool)
    if m >= width:
        key = np.zeros(m - width + 1, dtype=np.uint64)
        for k in range(width):
            key = mix(key * np.uint64(MIX_A) + codes[k : m - width + 1 + k])
        whole = w.doc[: m - width + 1] == w.doc[width - 1 :]
        at = np.flatnonzero(whole)
        key = mix(key[at] + w.doc[at].astype(np.uint64) * np.uint64(MIX_B))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        twin = np.zeros(len(order), dtype=bool)
        if len(order) > 1:
            same = ordered[1:] == ordered[:-1]
            twin[1:] |= same
            twin[:-1] |= same
        hit = at[order[twin]]
        for k in range(width):
            out[hit + k] = True
    return _per_doc(out, w.first)


def repetition_columns(texts: pa.Array, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    w = find_words(texts)
    codes = w.hashes()
    n_words = np.diff(w.first)
    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    inside[w.starts] = 1
    np.add.at(inside, w.ends, -1)
    letters = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((w.data & 0xC0) != 0x80)
    repeats = _repeat_words(w, codes)
    height = suffix_repeats(codes, w.first)
    covered = _per_doc(covered_words(height, w.first, limits.least_words), w.first)
    longest = np.zeros(len(n_words), dtype=np.int64)
    np.maximum.at(longest, w.doc, height)
    longest[longest < limits.least_words] = 0
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    fine = (covered <= limits.covered * n_words) & (longest <= limits.longest * n_words)
    return {
        "n_words": n_words, "word_chars": _per_doc(letters, w.bounds), "n_symbols": _per_doc(IS_SYMBOL[w.data], w.bounds), "n_dup_lines": _dup_lines(w), "n_repeat_words": repeats,
        "covered_words": covered, "longest_repeat": longest, "base_failed": failed, "kept": ~failed & fine,
    }


def repeated_spans(text: str, least: int = 5) -> list[tuple[int, int]]:
    """The union of a text's repeated substrings of `least` words or more, as (first word, word after the last)."""
    w = find_words(pa.array([text or ""], pa.string()))
    inside = covered_words(suffix_repeats(w.hashes(), w.first), w.first, least)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


FIELDS = [(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")] + [("base_failed", "boolean"), ("kept", "boolean")]


def quality_rules(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds counts, repetition figures and a verdict to every row; `carry` names the columns to keep (all by default).

    Null and empty texts have no words and fail the base rule. Every row is judged by its
    own whole text, so ties, copies and repeated rows come out alike; a text longer than
    a chunk is a chunk by itself. An empty table gives an empty one. Where a column of the table
    has an added column's name, the added one gets underscores behind it
    (shared.added_name).
    """
    kept = docs.columns if carry is None else carry
    source = docs.select(*dict.fromkeys([*kept, text]))
    at = [source.columns.index(c) for c in kept]
    text_at = source.columns.index(text)
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(added_name(kept, c), T._parse_datatype_string(k)) for c, k in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, batch.schema.names[text_at]):
                found = repetition_columns(part.column(text_at), limits)
                new = [pa.array(found[c], pa.bool_() if k == "boolean" else pa.int64()) for c, k in FIELDS]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *new], names=schema.names)

    return bounded(source).mapInArrow(run, schema)
