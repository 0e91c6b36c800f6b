"""Class dependence: joint probabilities of classes by distance, their interpolation and shrinkage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.joins import folded_angle, in_sector, range_join
from terravane.operators.places import class_sums, edge_groups, sector_edge_groups


def normalize_indicators(indicators: Column, tol: float = 1e-6, uniform: bool = True) -> Column:
    """Rows of non-negative numbers scaled to sum 1; rows that sum to `tol` or less become uniform, or null."""
    total = F.aggregate(indicators, F.lit(0.0), lambda s, x: s + x)
    flat = F.transform(indicators, lambda x: F.lit(1.0) / F.size(indicators)) if uniform else F.lit(None)
    return F.when(total > tol, F.transform(indicators, lambda x: x / total)).otherwise(flat)


def one_hot(label: Column, classes: Sequence[str]) -> Column:
    return F.transform(F.array(*map(F.lit, classes)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def distance_bin(d: Column, edges: Sequence[float]) -> Column:
    """0 for no distance, else i for (edges[i-1], edges[i]]; null beyond."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((d > edges[i - 1]) & (d <= edges[i]), i).otherwise(out)
    return F.when(d == 0, 0).otherwise(out)


def ptable(points: DataFrame, edges: Sequence[float], label: str = "cls", group: str | None = None, sector: tuple[float, float] | None = None) -> DataFrame:
    """(bin, d, ci, cj, n, p) over ordered pairs, own pairs included: joint class probability, mean distance and pairs of each bin.

    n counts each unordered pair once, but own and collocated pairs (bin 0) in both
    orders. `group` keeps pairs of one group, `sector` those in a direction.
    """
    if not group:
        found = class_sums(points, label, float(edges[-1]), sector_edge_groups(edges, [sector]) if sector else edge_groups(edges))
        return _shares(found.withColumnRenamed("g", "bin"), ["bin"])
    cells = _cells(points, label, group)
    pairs = range_join(cells, cells, float(edges[-1]))
    if group:
        pairs = pairs.where(F.col(f"a.{group}") == F.col(f"b.{group}"))
    if sector:
        pairs = pairs.where(in_sector(folded_angle(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")), *sector))
    rows = pairs.select(distance_bin(F.col("d"), edges).alias("bin"), "d", F.col(f"a.{label}").alias("ci"), F.col(f"b.{label}").alias("cj"), _weight()).where("bin is not null")
    return _shares(rows, ["bin"])


def _weight() -> Column:
    """Pairs of points in a pair of cells."""
    return (F.col("a.__m") * F.col("b.__m")).alias("__m")


def _cells(points: DataFrame, *labels: str) -> DataFrame:
    """Points of like labels at a place, with their number: pairs of these grow with places and classes, not with points."""
    return points.groupBy("x", "y", *labels).agg(F.count("*").alias("__m"))


def _shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """(…, ci, cj, d, n, p) from pairs: every pair of classes in every bin, 0 where there is none. The table has bins times classes squared rows."""
    m = F.col("__m") if "__m" in rows.columns else F.lit(1)
    cells = rows if "sd" in rows.columns else rows.groupBy(*by, "ci", "cj").agg(F.sum(m).alias("c"), F.sum(F.col("d") * m).alias("sd"))
    cells = cells.select(*(F.col(c).alias(f"__{c}") for c in (*by, "ci", "cj")), "c", "sd")
    totals = cells.groupBy(*(F.col(f"__{c}").alias(c) for c in by)).agg(F.sum("c").alias("tc"), F.sum("sd").alias("td"))
    classes = cells.select("__ci").distinct()
    grid = totals.crossJoin(F.broadcast(classes.withColumnRenamed("__ci", "ci"))).crossJoin(F.broadcast(classes.withColumnRenamed("__ci", "cj")))  # a table's classes are a handful
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__{c}") for c in (*by, "ci", "cj")])
    total = F.col("tc").cast("double")
    n = F.when(F.col("bin") == 0, total).otherwise(total / 2.0)
    return grid.join(cells, same, "left").select(*by, "ci", "cj", (F.col("td") / total).alias("d"), n.alias("n"), (F.coalesce(F.col("c"), F.lit(0)) / total).alias("p"))


def ptable_soft(points: DataFrame, edges: Sequence[float], probabilities: str = "ps") -> DataFrame:
    """The same for soft labels: mean outer products of probability arrays, classes by position."""
    pairs = range_join(points, points, float(edges[-1])).select(distance_bin(F.col("d"), edges).alias("bin"), "d", F.col(f"a.{probabilities}").alias("pa"), F.col(f"b.{probabilities}").alias("pb")).where("bin is not null")
    cells = pairs.select("bin", "d", F.posexplode("pa").alias("ci", "x"), "pb").select("bin", "d", "ci", "x", F.posexplode("pb").alias("cj", "y"))
    return cells.groupBy("bin", "ci", "cj").agg(F.avg("d").alias("d"), F.when(F.col("bin") == 0, F.count("*").cast("double")).otherwise(F.count("*") / 2.0).alias("n"), F.avg(F.col("x") * F.col("y")).alias("p"))


def ptable_centres(centres: DataFrame, points: DataFrame, edges: Sequence[float], label: str = "cls") -> DataFrame:
    """Local tables: for each centre (k), pairs i < j among the points within the last edge of it: (k, bin, ci, cj, d, n, p) with n pairs."""
    near = range_join(centres, points, float(edges[-1])).select(F.col("a.k").alias("k"), *(F.col(f"b.{c}").alias(c) for c in ("id", "x", "y", label)))
    d = F.sqrt(F.pow(F.col("u.x") - F.col("v.x"), 2.0) + F.pow(F.col("u.y") - F.col("v.y"), 2.0))
    pairs = near.alias("u").join(near.alias("v"), (F.col("u.k") == F.col("v.k")) & (F.col("u.id") < F.col("v.id"))).select(F.col("u.k").alias("k"), d.alias("d"), F.col(f"u.{label}").alias("a"), F.col(f"v.{label}").alias("b"))
    rows = pairs.withColumn("bin", distance_bin(F.col("d"), edges)).where("bin is not null")
    both = rows.select("k", "bin", "d", F.explode(F.array(F.struct(F.col("a").alias("ci"), F.col("b").alias("cj")), F.struct(F.col("b").alias("ci"), F.col("a").alias("cj")))).alias("s")).select("k", "bin", "d", "s.ci", "s.cj")
    halves = _shares(both, ["k", "bin"])  # both orders of each pair
    return halves.withColumn("n", F.when(F.col("bin") == 0, F.col("n") / 2.0).otherwise(F.col("n")))


def ptable_covariate(points: DataFrame, edges: Sequence[float], covariate: str = "z", label: str = "cls") -> DataFrame:
    """Tables by absolute covariate difference over ordered pairs i != j, bins (left, right], the first one from 0 on."""
    one = points.select("id", F.col(covariate).alias("x"), F.col(label).alias("cls"))
    pairs = range_join(one, one, float(edges[-1]), dims=("x",)).where(F.col("a.id") != F.col("b.id"))
    bin_ = F.when(F.col("d") == 0, 1).otherwise(distance_bin(F.col("d"), edges))
    rows = pairs.select(bin_.alias("bin"), "d", F.col("a.cls").alias("ci"), F.col("b.cls").alias("cj")).where("bin is not null")
    return _shares(rows, ["bin"])


def ptable_covariates(points: DataFrame, edges1: Sequence[float], edges2: Sequence[float], first: str, second: str, label: str = "cls") -> DataFrame:
    """Tables by two covariates' differences: (bin, bin2, ci, cj, d, n, p) with d the mean first difference."""
    one = points.select("id", F.col(first).alias("x"), F.col(second).alias("w"), F.col(label).alias("cls"))
    pairs = range_join(one, one, float(edges1[-1]), dims=("x",)).where(F.col("a.id") != F.col("b.id"))
    rows = pairs.select(F.coalesce(F.when(F.col("d") == 0, 1), distance_bin(F.col("d"), edges1)).alias("bin"), F.abs(F.col("a.w") - F.col("b.w")).alias("d2"), "d", F.col("a.cls").alias("ci"), F.col("b.cls").alias("cj"))
    rows = rows.withColumn("bin2", F.coalesce(F.when(F.col("d2") == 0, 1), distance_bin(F.col("d2"), edges2))).where("bin is not null and bin2 is not null")
    return _shares(rows, ["bin", "bin2"])


def interpolate(model: DataFrame, at: DataFrame) -> DataFrame:
    """Table values at distances: model (ci, cj, d, p), at (d, ...); linear between the model's distances, constant beyond."""
    order = Window.partitionBy("ci", "cj").orderBy("d")
    parts = model.select("ci", "cj", F.col("d").alias("d0"), F.col("p").alias("p0"), F.lead("d").over(order).alias("d1"), F.lead("p").over(order).alias("p1"), F.row_number().over(order).alias("r"))
    q = at.withColumnRenamed("d", "q")
    inside = (F.col("q") >= F.col("d0")) & (F.col("d1").isNull() | (F.col("q") < F.col("d1"))) | ((F.col("r") == 1) & (F.col("q") < F.col("d0")))
    share = F.when(F.col("d1").isNull() | (F.col("q") <= F.col("d0")), F.col("p0")).otherwise(F.col("p0") + (F.col("p1") - F.col("p0")) * (F.col("q") - F.col("d0")) / (F.col("d1") - F.col("d0")))
    return q.join(F.broadcast(parts), inside).select(*[F.col("q").alias("d") if c == "q" else F.col(c) for c in q.columns], "ci", "cj", share.alias("p"))  # a model has classes squared times some tens of rows


def marginals(table: DataFrame) -> DataFrame:
    """Class marginals of a table's first bin: (cls, p)."""
    first = table.groupBy("ci").agg(F.min("bin").alias("bin")).agg(F.min("bin").alias("bin"))
    return table.join(F.broadcast(first), "bin").groupBy(F.col("ci").alias("cls")).agg(F.sum("p").alias("p"))


def shrink(table: DataFrame, alpha: float, marginal: DataFrame) -> DataFrame:
    """(n p + alpha p_i p_j) / (n + alpha) in every cell."""
    i, j = marginal.select(F.col("cls").alias("ci"), F.col("p").alias("pi")), marginal.select(F.col("cls").alias("cj"), F.col("p").alias("pj"))
    rows = table.join(F.broadcast(i), "ci").join(F.broadcast(j), "cj")
    return rows.withColumn("p", (F.col("n") * F.col("p") + alpha * F.col("pi") * F.col("pj")) / (F.col("n") + alpha)).drop("pi", "pj")


def effective_range(table: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The distance at which total variation from independence, relative to the first bin's, first falls to the threshold: one row, null if never."""
    rows, cols = Window.partitionBy("bin", "ci"), Window.partitionBy("bin", "cj")
    gap = table.withColumn("g", F.abs(F.col("p") - F.sum("p").over(rows) * F.sum("p").over(cols)))
    tv = gap.groupBy("bin").agg(F.first("d").alias("d"), (F.sum("g") / 2).alias("tv"))
    order = Window.orderBy("bin")  # one row for each distance bin
    scaled = tv.withColumn("s", F.col("tv") / F.first("tv").over(order)).withColumns({"s0": F.lag("s").over(order), "d0": F.lag("d").over(order)})
    hit = scaled.where((F.col("s") <= threshold) & (F.col("s0") > threshold))
    return hit.agg(F.min_by(F.col("d0") + (F.col("s0") - threshold) / (F.col("s0") - F.col("s")) * (F.col("d") - F.col("d0")), F.col("bin")).alias("range"))


def regional_blend(targets: DataFrame, regions: DataFrame, tables: DataFrame, scale_alpha: float = 0.2) -> DataFrame:
    """Regional tables at targets: weights exp(-d² / (2 s²)) N**alpha of each region (region, x, y, s, n), then the weighted mean of tables (region, bin, ci, cj, p).

    Regions and their tables are model parameters, a few rows each.
    """
    r = F.broadcast(regions.select("region", F.col("x").alias("rx"), F.col("y").alias("ry"), "s", F.col("n").alias("rn")))
    w = F.exp((F.pow(F.col("x") - F.col("rx"), 2.0) + F.pow(F.col("y") - F.col("ry"), 2.0)) / (F.pow("s", 2.0) * -2)) * F.pow("rn", scale_alpha)
    weights = targets.join(r, F.lit(True)).select("k", "region", w.alias("w"))
    weights = weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("k")))
    return weights.join(F.broadcast(tables.select("region", "bin", "ci", "cj", "p")), "region").groupBy("k", "bin", "ci", "cj").agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def ptable_sectors(points: DataFrame, edges: Sequence[float], angles: Sequence[float], tolerance: float, label: str = "cls") -> DataFrame:
    """Tables of every direction in one pass: (sector, bin, ci, cj, d, n, p)."""
    found = class_sums(points, label, float(edges[-1]), sector_edge_groups(edges, [(c, tolerance) for c in angles]))
    g = F.col("g")
    return _shares(found.withColumns({"sector": F.floor(g / len(edges)).cast("int"), "bin": g % len(edges)}), ["sector", "bin"])



def class_ranges(sectors: DataFrame) -> DataFrame:
    """(sector, cls, range): the distance at which a class's own probability falls to p_bg + (P0 - p_bg) / e, by linear interpolation between bins; p_bg is the squared marginal."""
    own = sectors.where("ci = cj").select("sector", F.col("ci").alias("cls"), "bin", "d", "p")
    order = Window.partitionBy("sector", "cls").orderBy("bin")  # one row for each distance bin
    first = F.first("p").over(order)
    level = first * first + (first - first * first) / F.exp(F.lit(1.0))
    rows = own.withColumns({"level": level, "p0": F.lag("p").over(order), "d0": F.lag("d").over(order)}).where("p <= level AND p0 > level")
    return rows.groupBy("sector", "cls").agg(F.min_by(F.col("d0") + (F.col("p0") - F.col("level")) / (F.col("p0") - F.col("p")) * (F.col("d") - F.col("d0")), F.col("bin")).alias("range"))


def joint_information(model: DataFrame, measure: str = "tv") -> DataFrame:
    """(d, score) of a table at each of its distances: total variation from independence, or mutual information."""
    rows, cols = Window.partitionBy("d", "ci"), Window.partitionBy("d", "cj")  # classes squared rows for each distance
    free = F.sum("p").over(rows) * F.sum("p").over(cols)
    each = F.abs(F.col("p") - free) / 2 if measure == "tv" else F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / free)).otherwise(0.0)
    return model.withColumn("__e", each).groupBy("d").agg(F.sum("__e").alias("score"))


def interpolate_2d(model: DataFrame, at: DataFrame) -> DataFrame:
    """Bilinear values of a table on a grid (d1, d2, ci, cj, p) at (q1, q2, ...), constant beyond the grid's edges."""
    names = at.columns
    grid = [model.select(F.col(c).alias("v")).distinct().agg(F.sort_array(F.collect_list("v")).alias(f"g{i}")) for i, c in enumerate(("d1", "d2"))]  # a grid's axes, some tens of values
    q = at.crossJoin(F.broadcast(grid[0])).crossJoin(F.broadcast(grid[1]))
    for i, c in enumerate(("q1", "q2")):
        v = F.greatest(F.element_at(f"g{i}", 1), F.least(F.element_at(f"g{i}", -1), F.col(c)))
        at_ = F.greatest(F.lit(1), F.least(F.size(F.filter(f"g{i}", lambda x: x <= F.col(c))), F.size(f"g{i}") - 1))
        q = q.withColumn(f"lo{i}", F.element_at(f"g{i}", at_)).withColumn(f"hi{i}", F.element_at(f"g{i}", at_ + 1)).withColumn(f"w{i}", (v - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}")))
    corners = F.array(*(F.struct(F.col(f"{a}0").alias("c1"), F.col(f"{b}1").alias("c2"), ((F.col("w0") if a == "hi" else 1 - F.col("w0")) * (F.col("w1") if b == "hi" else 1 - F.col("w1"))).alias("w")) for a in ("lo", "hi") for b in ("lo", "hi")))
    rows = q.select(*names, F.explode(corners).alias("c")).select(*names, "c.c1", "c.c2", "c.w")
    m = F.broadcast(model)
    return rows.join(m, (rows["c1"] == m["d1"]) & (rows["c2"] == m["d2"])).groupBy(*names, "ci", "cj").agg(F.sum(F.col("w") * F.col("p")).alias("p"))
