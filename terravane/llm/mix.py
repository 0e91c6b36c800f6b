"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm.shared import added_name, materialise

#: Bins of the order within a source: documents of one size group are dealt over so many by hash.
HASH_BINS = 64
#: Size groups that are summed together first.
GROUP_STEP = 64

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Adds each source's target to a table (source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share`
    of all sizes; no target is above `cap` times its source's size, and what is over is
    shared again by weight until none is above. That fixed point is a water level: with
    sources in order of cap size per weight, a source stops at its cap while the level
    that the rest would have is not below it. The table has a row for each source; its
    windows run over these rows alone.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("__total", F.sum(F.col("source_size")).over(all_) * F.lit(float(share))).withColumn("__weights", F.sum("__w").over(all_))
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__used", F.coalesce(F.sum("__cap").over(fill), F.lit(0.0))).withColumn("__spent", F.coalesce(F.sum("__w").over(fill), F.lit(0.0)))
    rows = rows.withColumn("__level", (F.col("__total") - F.col("__used")) / (F.col("__weights") - F.col("__spent")))
    rows = rows.withColumn("__capped", F.col("__cap") <= F.col("__level") * F.col("__w"))
    level = F.min(F.when(~F.col("__capped"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level").alias("level")))).over(all_)["level"]
    rows = rows.withColumn("__final", level)
    return rows.withColumn("target", F.round(F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__final") * F.col("__w")), 6)).select("source", "source_size", "target")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _rows_before(bins: DataFrame) -> DataFrame:
    """Adds the rows of a source's earlier bins, summed in three steps of at most some hundred bins each: a large source's bins need not meet in one task."""

    def earlier(keys: list[str], at: str) -> Window:
        return Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)

    steps = [["__source"], ["__source", "__w"], ["__source", "__w", "__g"]]
    bins = bins.withColumn("__w", F.floor(F.col("__g") / GROUP_STEP))
    total = F.coalesce(F.sum("__k").over(earlier(steps[2], "__b")), F.lit(0))
    out = bins.withColumn("__before", total)
    for keys, at in ((steps[1], "__g"), (steps[0], "__w")):
        sums = bins.groupBy(*keys, at).agg(F.sum("__k").alias("__k"))
        sums = sums.select(*(F.col(c).alias(f"{c}_") for c in (*keys, at)), F.coalesce(F.sum("__k").over(earlier(keys, at)), F.lit(0)).alias("__more"))
        same = F.lit(True)
        for c in (*keys, at):
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
        out = out.join(sums, same).withColumn("__before", F.col("__before") + F.col("__more")).select(*bins.columns, "__before")
    return out.drop("__w")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document with size, source_size, target, copies and taken (and the columns in `carry`); reruns agree.

    A document's size is its words (null text: 0). Each document of a source is expected
    target / source_size times, `cap` at most. Within a source, in the order of size and
    then of the MD5 of the id, expected copies are summed up from a random offset in
    [0, 1) (from `seed` and the source's name), and a document is emitted once for each
    whole number that the sum crosses on it: its copies. So copies differ by one at most
    and, as neighbours have like sizes, taken words are near the target. Sources may be
    null; sources of size 0 have target 0 and copies 0. Null ids share one place in the
    order; repeated rows count each, very long texts whole. An empty table gives an empty
    result. Where a column in `carry` has an added column's name, the added one gets
    underscores behind it (shared.added_name).

    No window runs over a whole source: ranks come from counts in bins of (size group,
    hash), so a source that holds most rows is dealt over many tasks.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*dict.fromkeys([id_col, *carry])).alias("__row"), F.col(source).alias("__source"), size.alias("__size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__h"))
    # order within a source: size, hash. A bin is a range of that order.
    small = F.col("__size") < 4096
    group = F.when(small, F.col("__size")).otherwise(F.lit(4096) + F.floor(F.log2(F.greatest(F.col("__size"), F.lit(1)) / 4096.0) * 64).cast("long"))
    part = F.when(small, (F.conv(F.substring("__h", 1, 4), 16, 10).cast("long") * HASH_BINS / 65536).cast("int")).otherwise(0)
    rows = rows.withColumns({"__g": group, "__b": part})
    bins = rows.groupBy("__source", "__g", "__b").agg(F.count("*").alias("__k"), F.sum("__size").alias("__bytes"))
    bins, _ = materialise(bins, "bins")  # read several times below; the texts are not
    bins = _rows_before(bins)
    sizes = bins.groupBy(F.col("__source").alias("source")).agg(F.sum("__bytes").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    targets = targets.withColumn("__e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("__u", _unit(F.concat(F.lit(f"{seed}:"), name)))
    bins = bins.alias("b").join(targets.alias("t"), F.col("b.__source").eqNullSafe(F.col("t.source"))).select("b.__source", "__g", "__b", "__before", "source_size", "target", "__e", "__u")
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__source", "__g", "__b").orderBy("__size", "__h", f"__row.{id_col}")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__source", "__g", "__b")]
    placed = ranked.alias("r").join(bins.alias("b"), same[0] & same[1] & same[2])
    rank = F.col("__before") + F.col("__rn")
    copies = (F.floor(F.col("__e") * rank + F.col("__u")) - F.floor(F.col("__e") * (rank - 1) + F.col("__u"))).cast("long")
    kept = [F.col(f"__row.{c}").alias(c) for c in dict.fromkeys([id_col, *carry])]
    own = [] if source in (id_col, *carry) else [F.col("r.__source").alias(source)]
    added = {"size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": copies * F.col("__size")}
    return placed.select(*kept, *own, *(c.alias(added_name([id_col, source, *carry], n)) for n, c in added.items()))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the table's rows, each as often as mix_sources takes it."""
    copies = added_name(docs.columns, "copies")
    mixed = mix_sources(docs, carry=docs.columns, **options).where(F.col(copies) > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(added_name([*docs.columns, copies], "copy"))
    return mixed.select(*docs.columns, each).select(*docs.columns)


#: The same rows as mix_sources, as DuckDB SQL over the table documents.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(COALESCE(doc_id::VARCHAR, '')) AS h FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap,
        sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
x AS (SELECT *, sum(w) OVER () AS ws, COALESCE(sum(cap) OVER fill, 0) AS used, COALESCE(sum(w) OVER fill, 0) AS spent FROM w
        WINDOW fill AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, (total - used) / (ws - spent) AS lvl, cap <= (total - used) / (ws - spent) * w AS capped FROM x),
z AS (SELECT source, source_size, round(CASE WHEN capped THEN cap ELSE (SELECT arg_min(lvl, cap / w) FROM y WHERE NOT capped) * w END, 6) AS target FROM y),
t AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
        ('0x' || md5('0:' || COALESCE('=' || source, '-'))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM z),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS rnk FROM d),
c AS (SELECT r.doc_id, r.source, r.size, t.source_size, t.target, (floor(t.e * r.rnk + t.u) - floor(t.e * (r.rnk - 1) + t.u))::BIGINT AS copies FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
"""
