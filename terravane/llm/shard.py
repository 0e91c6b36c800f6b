"""Sharding by histogram sort, with DataFrame functions only.

Rows have a 120-bit key: 60 hash bits of the text, then 60 of the row's id, so
equal texts are neighbours. Splitters that cut the bytes into equal shards are
sought by counting: each round counts bytes exactly in a fixed number of bins of
the key space, keeps for each splitter the bin in which its target falls, and
splits just those bins further, until the bytes below every splitter are within
tolerance of the target, a bin holds one row, or the key has no more bits. Then rows move once, to
their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm.shared import materialise

#: Bits of the key that one round looks at, and the rounds that use up its 120 bits.
ROUND_BITS = 12
KEY_BITS = 60
LEVELS = 2 * KEY_BITS // ROUND_BITS
#: Rows that one numbering task should hold.
SLOT_ROWS = 200_000


PER_KEY = KEY_BITS // ROUND_BITS


def _lead(level: int) -> tuple[Column, Column]:
    """The bits of the key's two halves that come before round `level`."""
    if level < PER_KEY:
        return F.shiftright(F.col("__k1"), KEY_BITS - ROUND_BITS * level), F.lit(0).cast("long")
    return F.col("__k1"), F.shiftright(F.col("__k2"), KEY_BITS - ROUND_BITS * (level - PER_KEY))


def _digit(level: int) -> Column:
    """The bits of the key that round `level` looks at."""
    key = "__k1" if level < PER_KEY else "__k2"
    shift = KEY_BITS - ROUND_BITS * (level % PER_KEY + 1)
    return F.shiftright(F.col(key), shift).bitwiseAND(F.lit((1 << ROUND_BITS) - 1)).cast("int")


def _number(prefix: tuple[int, ...]) -> tuple[int, int]:
    """Leading digits of the key as its two halves' leading bits, like `_lead`."""
    halves = []
    for part in (prefix[:PER_KEY], prefix[PER_KEY:]):
        n = 0
        for digit in part:
            n = (n << ROUND_BITS) + digit
        halves.append(n)
    return halves[0], halves[1]


def _below(boundary: tuple[int, ...]) -> Column:
    """Whether a row's key is below the boundary with these leading digits; the last may be one above its range."""
    one, two = _number(boundary)
    if len(boundary) <= PER_KEY:
        return F.col("__k1") < F.lit(one << (KEY_BITS - ROUND_BITS * len(boundary)))
    two <<= KEY_BITS - ROUND_BITS * (len(boundary) - PER_KEY)
    return (F.col("__k1") < F.lit(one)) | ((F.col("__k1") == F.lit(one)) & (F.col("__k2") < F.lit(two)))


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, ...]], int]:
    """Boundaries between shards, as leading digits of the key, and the rounds it took.

    Each round brings at most (shards - 1) * 2**ROUND_BITS sums to the driver, at any
    number of rows.
    """
    sums = F.sum("size").alias("b"), F.count("*").alias("n")
    bins: dict[tuple[int, int], dict[int, tuple[int, int]]] = {(0, 0): {r["d"]: (r["b"], r["n"]) for r in rows.groupBy(_digit(0).alias("d")).agg(*sums).collect()}}
    total = sum(b for b, _ in bins[0, 0].values())
    slack = tolerance * total / shards
    done: dict[int, tuple[int, ...]] = {}
    sought: dict[int, tuple[tuple[int, ...], int]] = {i: ((), 0) for i in range(1, shards)}
    rounds = 1
    while True:
        nxt: dict[int, tuple[tuple[int, ...], int]] = {}
        for i, (prefix, below) in sought.items():
            target, digit, size, n = total * i / shards, 0, 0, 0
            for digit, (size, n) in sorted(bins.get(_number(prefix), {}).items()):
                if below + size >= target:
                    break
                below += size
            over = below + size - target
            if target - below <= slack or (n <= 1 and target - below <= over):
                done[i] = (*prefix, digit)
            elif over <= slack or n <= 1 or len(prefix) + 1 == LEVELS:
                done[i] = (*prefix, digit + 1)
            else:
                nxt[i] = ((*prefix, digit), below)
        if not nxt:
            return [done[i] for i in range(1, shards)], rounds
        sought, level = nxt, rounds
        rounds += 1
        one, two = _lead(level)
        wanted = sorted({_number(p) for p, _ in sought.values()})
        here = one.isin(sorted({a for a, _ in wanted})) & (two.isin(sorted({b for _, b in wanted})))
        found = rows.where(here).groupBy(one.alias("one"), two.alias("two"), _digit(level).alias("d")).agg(*sums).collect()
        bins = {}
        for r in found:
            bins.setdefault((r["one"], r["two"]), {})[r["d"]] = (r["b"], r["n"])


def shard_by_bytes(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, id_col: str = "doc_id", text: str = "text", overhead: int = 16, carry_text: bool = False) -> DataFrame:
    """Puts every row into one of `shards` shards of nearly equal bytes: the law `bytes`.

    A row's size is its UTF-8 bytes (null: none) plus `overhead`. Adds size, text_crc32
    (unsigned; null and empty: 0), law, shard, slot (gapless from 0 within a shard) and
    grown_shard (null: this law keeps no rows in place when shards are added). A shard's
    bytes differ from the mean by `tolerance` of it at most, or by the largest row where
    that is more. Equal texts are neighbours in the order, so they share a shard unless a
    boundary has to cut their group; a group as large as several shards fills them. Rows
    that agree in text and id can't be told apart by the key and stay together. Null ids
    sort as one id; an empty table gives an empty result. Other columns than id and text
    aren't returned; `carry_text` keeps the text for writers.
    Only sizes, hashes and ids take part in the search; they are written to the shared
    folder once, so the texts are read once.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(content), 64 - KEY_BITS).alias("__k1"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - KEY_BITS).alias("__k2"),
        *([F.col(text)] if carry_text else []),
    )
    slim, _ = materialise(slim, "shard-keys")
    splitters, _ = find_splitters(slim, shards, tolerance)
    shard = F.lit(0)
    for boundary in splitters:
        shard = shard + F.when(_below(boundary), 0).otherwise(1)
    n = slim.count()
    parts = max(16, -(-n // (shards * SLOT_ROWS)))
    placed = slim.withColumn("shard", shard.cast("int")).withColumn("__part", F.pmod(F.xxhash64(F.col("__k2"), F.col("__k1")), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = placed.withColumn("__rn", F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__k1", "__k2", id_col)) - 1)
    out = numbered.join(offsets, ["shard", "__part"])
    return out.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__before") + F.col("__rn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *([text] if carry_text else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> None:
    """Writes every row with its text under `path`, one folder `shard=k` for each shard."""
    shard_by_bytes(docs, shards, carry_text=True, **options).write.partitionBy("shard").parquet(path)
