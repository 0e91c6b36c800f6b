"""Byte-level BPE by segment trees over adjacent pair ranks.

Every word of the pre-tokeniser starts as its bytes. The leaves of a segment
tree hold (rank, position) of each adjacent pair that may merge, so the root
is the leftmost pair of lowest rank. A merge changes three leaves (the merged
pair, its left and its right neighbour), each in logarithmic time, until the
root holds no pair. Short words run through many trees at once, one row of a
NumPy matrix each; long ones through a tree of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import regex

#: The longest word, in bytes, that runs in a matrix of trees.
MATRIX_WIDTH = 64
#: Words that an encoder remembers before it forgets them all.
MEMO_WORDS = 200_000
NO_PAIR = np.int64(1) << 40
#: The same for a leaf of a long word, above any rank * width + position.
NO_LEAF = 1 << 62
SHIFT = 20

#: Fixed by the GPT-2 byte-level format: how it cuts a text into words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def read_spec(path: str) -> dict:
    """What the encoder needs of a tokenizer file: merges, vocabulary and added tokens.

    Raises ValueError for files that ask for more than byte-level BPE (normalisers,
    prefix spaces, post-processors, added tokens with flags).
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, pre = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE without a prefix space is supported")
    if whole.get("normalizer") or whole.get("post_processor") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
        raise ValueError("normalisers, post-processors, dropout and whole-word lookup are not supported")
    added = whole.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with flags are not supported")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    return {
        "merges": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64).reshape(-1, 3),
        "bytes": np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], dtype=np.int64),
        "tokens": sorted((i, t) for t, i in vocab.items()),
        "added": [(t["content"], t["id"]) for t in added],
    }


class SegmentTreeBpe:
    """Encodes and decodes as the tokenizers library does with the same file.

    Special strings of the file inside a text become their ids, as by the
    library's default. Nulls encode as the empty text.
    """

    def __init__(self, spec: dict):
        merges = spec["merges"]
        keys = (merges[:, 0] << SHIFT) | merges[:, 1]
        ranks = np.arange(len(keys), dtype=np.int64)
        self.by_key = {}
        for k, r in zip(keys.tolist(), ranks.tolist(), strict=True):
            self.by_key[k] = r  # a pair that is listed twice takes its last rank, as a map does
        self.keys = np.array(sorted(self.by_key), dtype=np.int64)
        self.ranks = np.array([self.by_key[k] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = merges[:, 2].copy()
        self.first = spec["bytes"]
        self.words = regex.compile(BYTE_LEVEL_WORDS)
        self.added = dict(spec["added"])
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        back = {c: b for b, c in byte_alphabet().items()}
        texts = [*spec["tokens"], *((i, t) for t, i in spec["added"])]
        self.token_bytes = [b""] * (1 + max(i for i, _ in texts))
        for i, t in texts:
            self.token_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.memo: dict[str, bytes] = {}

    # pairs

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_PAIR)
        key = np.where((left < 0) | (right < 0), -1, (left << SHIFT) | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    # one tree for a long word

    def _encode_long(self, word: bytes) -> bytes:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        sym, none, get = self.first[np.frombuffer(word, np.uint8)].tolist(), NO_LEAF, self.by_key.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._rank(np.array(sym[:-1], dtype=np.int64), np.array(sym[1:], dtype=np.int64))
        leaves = np.full(width, none, dtype=np.int64)
        leaves[: n - 1] = np.where(ranks < NO_PAIR, ranks * width + np.arange(n - 1), none)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(axis=1))
        tree = [none, *(v for level in reversed(levels) for v in level.tolist())]

        def put(at: int, left: int, right: int) -> None:
            r = get(left << SHIFT | right) if left >= 0 and right >= 0 else None
            node = width + at
            tree[node] = none if r is None else r * width + at
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            right, left = nxt[at], prv[at]
            after = nxt[right]
            sym[at], sym[right], nxt[at] = int(self.merged[rank]), -1, after
            put(right, -1, -1)
            put(at, sym[at], sym[after] if after < n else -1)
            if after < n:
                prv[after] = at
            if left >= 0:
                put(left, sym[left], sym[at])
        return np.array([s for s in sym if s >= 0], dtype="<u4").tobytes()

    # many trees at once

    def _encode_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        m, log = len(words), width.bit_length() - 1
        lens = np.fromiter(map(len, words), np.int64, m)
        sym = np.full((m, width + 1), -1, dtype=np.int64)
        sym[np.arange(width + 1) < lens[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.minimum(np.arange(1, width + 2), lens[:, None])
        nxt[nxt == lens[:, None]] = width
        prv = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()
        tree = np.full((m, 2 * width), NO_PAIR, dtype=np.int64)
        ranks = self._rank(sym[:, :width].ravel(), sym[:, 1:].ravel()).reshape(m, width)
        tree[:, width:] = np.where(ranks < NO_PAIR, (ranks << log) | np.arange(width), NO_PAIR)
        for level in range(log - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = tree[:, 2 * a : 4 * a].reshape(m, a, 2).min(axis=2)
        flat, of, nx, pv = tree.ravel(), sym.ravel(), nxt.ravel(), prv.ravel()

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node, base = at + width, rows * (2 * width)
            flat[base + node] = value
            for _ in range(log):
                node >>= 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        def leaf(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            r = self._rank(left, right)
            return np.where(r < NO_PAIR, (r << log) | at, NO_PAIR)

        rows = np.arange(m)
        while True:
            root = flat[rows * (2 * width) + 1]
            live = root < NO_PAIR
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            at, new = root & (width - 1), self.merged[root >> log]
            base = rows * (width + 1)
            right, left = nx[base + at], pv[base + at]
            after = nx[base + right]
            of[base + at], of[base + right], nx[base + at] = new, -1, after
            pv[base + after] = at
            put(rows, right, np.full(len(rows), NO_PAIR))
            put(rows, at, leaf(at, new, of[base + after]))
            has = left >= 0
            if has.any():
                b, p = base[has], left[has]
                put(rows[has], p, leaf(p, of[b + p], new[has]))
        alive = sym >= 0
        ends = np.cumsum(alive.sum(axis=1) * 4).tolist()
        packed = sym[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word, as packed little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "replace")
            if not raw:
                out[word] = b""
            elif len(raw) > MATRIX_WIDTH:
                out[word] = self._encode_long(raw)
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for width, group in by_width.items():
            for k in range(0, len(group), 4_096):
                part = group[k : k + 4_096]
                out.update(zip((w for w, _ in part), self._encode_matrix([r for _, r in part], width), strict=True))
        return out

    # whole texts

    def _words(self, text: str) -> list[str | int]:
        if not self.cut or not any(t in text for t in self.added):
            return self.words.findall(text)
        out: list[str | int] = []
        for piece in self.cut.split(text):
            out.extend([self.added[piece]] if piece in self.added else self.words.findall(piece))
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        cut = [self._words(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        unseen: set = set()
        for words in cut:
            unseen.update(words)
        unseen.difference_update(self.memo)
        for i in [x for x in unseen if isinstance(x, int)]:
            unseen.discard(i)
            self.memo[i] = np.array([i], dtype="<u4").tobytes()
        self.memo.update(self.encode_words(unseen))
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode_ids(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included; invalid UTF-8 becomes replacement characters."""
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[str, SegmentTreeBpe] = {}


def encoder_of(key: str, spec: dict) -> SegmentTreeBpe:
    """The encoder for a specification, made once in each Python worker."""
    if key not in _made:
        _made.clear()
        _made[key] = SegmentTreeBpe(spec)
    return _made[key]
