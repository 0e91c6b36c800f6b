"""Words of UTF-8 text as NumPy arrays: positions and 64-bit hashes, many texts at once.

Words are runs of bytes other than space and 0x09 to 0x0D. A hash is a polynomial
in the bytes, modulo 2**64, mixed afterwards; equal words have equal hashes, and two
different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd 64-bit constants: the polynomial's base, and those of the splitmix64 finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed * 0x632BE59BD9B4E019 & MASK)) | np.uint64(1)


_tables: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, `size` of them at least; kept for the longest data so far."""
    for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
        while len(_tables[k]) < size:
            p = _tables[k]
            more = p[: max(1 << 16, size) - len(p)] if len(p) >= 1 << 16 else p
            _tables[k] = np.concatenate([p, more * np.uint64(pow(base, len(p), 1 << 64))])
    return _tables


@dataclass
class Words:
    """starts, ends: of each word in `data`; doc: its text's index; first: index of each text's first word, and the total; bounds: of the texts in `data`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(MIX_B))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (nulls as empty), and the bounds of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def find_words(texts: pa.Array) -> Words:
    data, bounds = buffers(texts)
    n = len(bounds) - 1
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins, stops = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, bounds)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, starts, ends, doc, first, bounds)
