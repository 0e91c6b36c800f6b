"""Pairing joins: all pairs in blocks, pairs within a radius through grid cells, and k nearest neighbours.

Spark has no range join; a bare distance predicate would become a nested loop over a
broadcast table. Here a radius becomes an equi-join on grid cells as wide as the radius
(one side takes part in its 3**d neighbouring cells), which shuffles both sides once
and whose skewed cells Spark may split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.covariance import aniso2iso_columns, iso2aniso_columns


def distance(a: str, b: str, dims: Sequence[str], p: float = 2) -> Column:
    """Minkowski distance of rows of two aliases."""
    gaps = [F.col(f"{a}.{d}") - F.col(f"{b}.{d}") for d in dims]
    if p == 2:
        return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))
    return F.pow(reduce(lambda x, y: x + y, [F.pow(F.abs(g), float(p)) for g in gaps]), 1.0 / p)


def folded_angle(dx: Column, dy: Column) -> Column:
    """Direction of a difference, folded to (-pi/2, pi/2]; null for no difference."""
    return F.when((dx == 0) & (dy == 0), None).when(dx == 0, math.pi / 2).otherwise(F.atan(dy / F.when(dx != 0, dx)))


def in_sector(angle: Column, centre: float, tolerance: float) -> Column:
    """(centre - tolerance, centre + tolerance], wrapping at ±pi/2; null angles are in every sector."""
    lo, hi, half = centre - tolerance, centre + tolerance, math.pi / 2
    inside = (angle > lo) & (angle <= hi)
    if lo < -half:
        inside = inside | (angle > lo + math.pi)
    if hi > half:
        inside = inside | (angle <= hi - math.pi)
    return angle.isNull() | inside


def block_join(left: DataFrame, right: DataFrame, blocks: int = 16) -> DataFrame:
    """Every row of alias a with every row of alias b, as an equi-join on pairs of blocks: no side is broadcast."""
    l = left.withColumn("__i", F.pmod(F.xxhash64(*left.columns), F.lit(blocks))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = right.withColumn("__j", F.pmod(F.xxhash64(*right.columns), F.lit(blocks))).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return l.alias("a").join(r.alias("b").hint("shuffle_hash"), (F.col("a.__i") == F.col("b.__i")) & (F.col("a.__j") == F.col("b.__j")))


def place_lists(points: DataFrame, *columns: str, dims: Sequence[str] = ("x", "y"), most: int = 256) -> DataFrame:
    """The rows of each place as lists `rows` of structs of the columns, at most so many rows in one: a crowded place has several lists."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["__p", *dims]  # the hash is a key that needs no normalising: one exchange serves all
    dealt = points.select(F.xxhash64(*dims).alias("__p"), *dims, F.struct(*columns).alias("__r")).repartition(parts, "__p")  # small rows, long work: not to be coalesced
    dealt = dealt.withColumn("__n", F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("__r")) - 1) / most))
    return dealt.groupBy(*place, "__n").agg(F.collect_list("__r").alias("rows")).select(*dims, "rows")


def once(value: Column) -> Column:
    """A generator of the value itself, for use below an explode: a projection would be evaluated again for every row that comes of it.

    The lambda is interpreted, so that compiled code ends here: it holds all rows that
    come of one of its input rows, which are then those of two lists and not of a join.
    """
    return F.explode(F.transform(F.array(value), lambda v: v))


def place_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every list of alias a with every list of alias b: a task has a part of the left side and reads the right one again, so that no row is shuffled or kept more than once."""
    return left.alias("a").join(right.coalesce(1).alias("b").hint("shuffle_replicate_nl"))


def range_join(left: DataFrame, right: DataFrame, radius: float, dims: Sequence[str] = ("x", "y"), strict: bool = False) -> DataFrame:
    """Rows of aliases a and b within `radius` of each other (`strict`: nearer), with their distance d."""
    if not radius > 0:
        raise ValueError("the radius must be positive")
    cells = [f"__c{i}" for i in range(len(dims))]
    l = left.withColumns({c: F.floor(F.col(d) / radius) for c, d in zip(cells, dims, strict=True)})
    for c in cells:
        l = l.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    r = right.withColumns({c: F.floor(F.col(d) / radius) for c, d in zip(cells, dims, strict=True)})
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cells])
    d = distance("a", "b", dims)
    return l.alias("a").join(r.alias("b"), same & (d < radius if strict else d <= radius)).withColumn("d", d)


def pair_join(points: DataFrame, radius: float, dims: Sequence[str] = ("x", "y"), own: bool = True) -> DataFrame:
    """Unordered pairs within `radius`: the smaller id is a. With `own`, each point with itself."""
    pairs = range_join(points, points, radius, dims)
    return pairs.where(F.col("a.id") <= F.col("b.id") if own else F.col("a.id") < F.col("b.id"))


def list_pairs(points: DataFrame, radius: float, *columns: str) -> DataFrame:
    """Lists of the points of two places within `radius`, each two places once: (own, other, d, same), aliases a and b as in a range join. `same` tells of one place, whose points meet both ways."""
    lists = place_lists(points.where("x is not null and y is not null"), *columns)
    order = (F.col("a.x") < F.col("b.x")) | ((F.col("a.x") == F.col("b.x")) & (F.col("a.y") <= F.col("b.y")))
    met = range_join(lists, lists, radius).where(order)
    return met.withColumns({"same": (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")), "own": F.col("a.rows"), "other": F.col("b.rows")})


def paired(lists: DataFrame, same: str, *keep: str | Column) -> DataFrame:
    """A row (p, q, the kept columns) of every pair of points p and q of `list_pairs`, once: of one place, those with p.id <= q.id. A point's id stands for one place."""
    rows = lists.select(same, "other", *keep, F.explode("own").alias("p"))
    names = [c for c in rows.columns if c not in (same, "other", "p")]
    rows = rows.select(same, *names, "p", F.explode("other").alias("q"))
    return rows.where(F.when(F.col(same), F.col("p.id") <= F.col("q.id")).otherwise(F.col("p.id").isNotNull() & F.col("q.id").isNotNull())).select(*names, "p", "q")


def _first_radius(points: DataFrame, nmax: int, dims: Sequence[str]) -> float:
    """The radius that would hold 2.5 nmax points if they lay evenly over their bounds; infinite where that says nothing. One row comes to the driver."""
    row = points.agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo{i}") for i, c in enumerate(dims)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(dims))).first()
    if not row["n"]:
        return math.inf
    volume = math.prod(row[f"hi{i}"] - row[f"lo{i}"] if row[f"hi{i}"] is not None else 0.0 for i in range(len(dims)))
    ball = math.pi ** (len(dims) / 2) / math.gamma(len(dims) / 2 + 1)
    return (2.5 * nmax * volume / (row["n"] * ball)) ** (1 / len(dims)) if 0 < volume < math.inf else math.inf


def knn_join(targets: DataFrame, points: DataFrame, nmax: int, dmax: float, dims: Sequence[str] = ("x", "y"), strict: bool = False) -> DataFrame:
    """Each target's nmax nearest points within dmax, ties to the smaller id: columns of b, k, d and place (from 1).

    Where points lie densely for dmax, a smaller radius by their mean density comes first:
    targets with nmax points within it have their nearest there, only the others look
    as far as dmax. So pairs grow with nmax and not with the points within dmax.
    Targets at one place share their neighbours and are looked up once, and of the points
    at one place only the nmax smallest ids can be among them: pairs grow with places.
    """
    return _at_places(targets, points, nmax, dims, lambda some, few: _knn(some, few, nmax, dmax, dims, strict))


def _at_places(targets: DataFrame, points: DataFrame, nmax: int, dims: Sequence[str], find: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A search of the targets' places, as (k, the points' columns, d, place), for every target. `find` sees the nmax smallest ids of every place."""
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in dims])
    few = points.where(known).withColumn("__n", F.row_number().over(Window.partitionBy(*dims).orderBy("id"))).where(F.col("__n") <= nmax).drop("__n")
    own = targets.where(known).select("k", F.struct(*dims).alias("__p"))
    found = find(own.select("__p").distinct().select(F.col("__p").alias("k"), "__p.*"), few)
    return own.join(found.withColumnRenamed("k", "__p"), "__p").select("k", *points.columns, "d", "place")


def _knn(targets: DataFrame, points: DataFrame, nmax: int, dmax: float, dims: Sequence[str], strict: bool) -> DataFrame:
    def nearest(some: DataFrame, radius: float, strict: bool) -> DataFrame:
        near = range_join(some, points, radius, dims, strict)
        kept = near.select(F.col("a.k").alias("k"), *(F.col(f"b.{c}").alias(c) for c in points.columns), "d")
        return kept.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= nmax)

    first = _first_radius(points, nmax, dims)
    if not 0 < first < dmax / 1.5:
        return nearest(targets, dmax, strict)
    close = range_join(targets.select("k", *dims), points.select(*dims), first, dims)
    full = close.groupBy(F.col("a.k").alias("k")).agg(F.count("*").alias("n")).where(F.col("n") >= nmax).select("k")
    near = nearest(targets, first, False)
    whole = near.withColumn("__n", F.count("*").over(Window.partitionBy("k"))).where(F.col("__n") == nmax).drop("__n")
    return whole.unionByName(nearest(targets.join(full, "k", "left_anti"), dmax, strict))


def spacetime_join(left: DataFrame, right: DataFrame, ds: float, dt: float) -> DataFrame:
    """Rows of aliases a and b within ds in space and dt in time, by cells of both, with their distance d."""
    widths = {"x": ds, "y": ds, "t": max(dt, 1e-9)}
    cells = {c: f"__c{i}" for i, c in enumerate(widths)}
    l, r = (side.withColumns({cells[c]: F.floor(F.col(c) / w) for c, w in widths.items()}) for side in (left, right))
    for c in cells.values():
        l = l.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    l = l.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cells.values())  # small rows, long work: not to be coalesced
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cells.values()])
    d = distance("a", "b", ("x", "y"))
    return l.alias("a").join(r.alias("b"), same & (d <= ds) & (F.abs(F.col("a.t") - F.col("b.t")) <= dt)).withColumn("d", d)


def nearest_cells(near: DataFrame, nmax: int, spare: str | None = None) -> DataFrame:
    """Of rows (k, cell, g, n), n points of a cell g away from k: those cells that may hold some of k's nmax nearest points, fewer than nmax being nearer. As many points as there are values of the cells' field `spare` around k may not count; `__less` keeps their number."""
    lists = near.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("g", "n", "__c"))).alias("__l"))
    less = F.size(F.array_distinct(F.transform("__l", lambda e: e["__c"][spare]))) if spare else F.lit(0)
    lists = lists.withColumn("__less", less)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(math.inf).alias("g"))
    last = F.aggregate("__l", start, lambda s, e: F.when(s["n"] < nmax + F.col("__less"), F.struct((s["n"] + e["n"]).alias("n"), e["g"].alias("g"))).otherwise(s))["g"]
    rows = lists.withColumn("__g", last).select("k", "__less", F.explode(F.filter("__l", lambda e: e["g"] <= F.col("__g"))).alias("e"))
    return rows.select("k", "__less", "e.g", "e.__c")


def knn_spacetime(targets: DataFrame, points: DataFrame, nmax: int, ds: float, dt: float, ratio: float) -> DataFrame:
    """Nearest by distance + ratio * lag among points within ds in space and dt in time, ties to the smaller id.

    Targets at one place and time are looked up once; places and times with their number
    of points meet first, and only the nmax smallest ids of the nearest become rows.
    """
    dims = ("x", "y", "t")

    def find(some: DataFrame, few: DataFrame) -> DataFrame:
        met = spacetime_join(some, few.groupBy(*dims).agg(F.count("*").alias("n")), ds, dt)
        near = met.select(F.col("a.k").alias("k"), F.struct(*(F.col(f"b.{c}").alias(c) for c in dims)).alias("__c"), (F.col("d") + ratio * F.abs(F.col("a.t") - F.col("b.t"))).alias("g"), "b.n")
        rows = nearest_cells(near, nmax).join(few.withColumn("__c", F.struct(*dims)), "__c").select("k", *points.columns, F.col("g").alias("d"))
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= nmax)

    return _at_places(targets, points, nmax, dims, find)


def knn_sectored(targets: DataFrame, points: DataFrame, per_sector: int, nmax: int, dmax: float) -> DataFrame:
    """Nearest points nearer than dmax, at most `per_sector` of each quadrant and nmax of all."""
    near = range_join(targets, points, dmax, strict=True)
    east, north = F.col("b.x") >= F.col("a.x"), F.col("b.y") >= F.col("a.y")
    sector = F.when(east & north, 0).when(~east & north, 1).when(~east & ~north, 2).otherwise(3)
    kept = near.select(F.col("a.k").alias("k"), *(F.col(f"b.{c}").alias(c) for c in points.columns), "d", sector.alias("sector"))
    kept = kept.withColumn("__p", F.row_number().over(Window.partitionBy("k", "sector").orderBy("d", "id"))).where(F.col("__p") <= per_sector).drop("__p")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= nmax)


def knn_separable(targets: DataFrame, points: DataFrame, nmax: int, dmax: Sequence[float], dims: Sequence[str], reach: Sequence[float]) -> DataFrame:
    """Separable axes: each axis within its dmax, capped at half of its model's reach; ranked by the sum of normalised squared distances."""
    caps = [min(d, r / 2) for d, r in zip(dmax, reach, strict=True)]

    def find(some: DataFrame, few: DataFrame) -> DataFrame:
        cells = [f"__c{i}" for i in range(len(dims))]
        l = some
        for c, d, cap in zip(cells, dims, caps, strict=True):
            l = l.withColumn(c, F.explode(F.array(*(F.floor(F.col(d) / cap) + i for i in (-1, 0, 1)))))
        r = few.withColumns({c: F.floor(F.col(d) / cap) for c, d, cap in zip(cells, dims, caps, strict=True)})
        near = l.alias("a").join(r.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cells]))
        for d, cap in zip(dims, caps, strict=True):
            near = near.where(F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")) <= cap)
        score = F.sqrt(reduce(lambda x, y: x + y, [F.pow((F.col(f"a.{d}") - F.col(f"b.{d}")) / cap, 2.0) for d, cap in zip(dims, caps, strict=True)]))
        kept = near.select(F.col("a.k").alias("k"), *(F.col(f"b.{c}").alias(c) for c in points.columns), score.alias("d"))
        return kept.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= nmax)

    return _at_places(targets, points, nmax, dims, find)


def neighbour_sets(neighbours: DataFrame) -> DataFrame:
    """Targets that share the same neighbours: (ids, ks). nmax bounds a set; one set's targets may be many, so they are counted and listed per set and hash of the target."""
    sets = neighbours.groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return sets.groupBy("ids", F.pmod(F.xxhash64("k"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("ks"))


def nearest_distance(points: DataFrame, dmax: float) -> DataFrame:
    """Each point's distance to its nearest other point within dmax."""
    places = points.where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = range_join(places, places, dmax).where((F.col("a.x") != F.col("b.x")) | (F.col("a.y") != F.col("b.y")) | (F.col("a.n") > 1))
    near = pairs.groupBy(F.col("a.x").alias("x"), F.col("a.y").alias("y")).agg(F.min("d").alias("d"))
    return points.select("id", "x", "y").join(near, ["x", "y"]).select("id", "d")


def exact_matches(left: DataFrame, right: DataFrame, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """Pairs of ids with identical coordinates."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.{d}") == F.col(f"b.{d}") for d in dims])
    return left.alias("a").join(right.alias("b"), same).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def local_marginal(targets: DataFrame, points: DataFrame, bandwidth: float, reference: dict[str, float], dmax: float, label: str = "cls") -> DataFrame:
    """Gaussian-kernel class shares around each target, shrunk to the reference by 1 / (n_eff + 1), n_eff = (sum w)² / sum w²."""
    # points of a class meet at their places, and targets at theirs
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"), *(F.count_if(F.col(label) == c).alias(f"n_{i}") for i, c in enumerate(reference)))
    own = targets.select("k", F.struct("x", "y").alias("__p"))
    near = range_join(own.select("__p").distinct().select(F.col("__p").alias("k"), "__p.*"), places, dmax)
    w = F.exp(F.pow(F.col("d") / bandwidth, 2.0) * -0.5)
    total = near.groupBy(F.col("a.k").alias("__p")).agg(F.sum(w * F.col("b.n")).alias("sw"), F.sum(w * w * F.col("b.n")).alias("sw2"), *(F.sum(w * F.col(f"b.n_{i}")).alias(f"w_{i}") for i in range(len(reference))))
    total = own.join(total, "__p").drop("__p")
    alpha = 1 / (F.col("sw") * F.col("sw") / F.col("sw2") + 1)
    shares = F.array(*(F.struct(F.lit(c).alias("cls"), (alpha * F.lit(p) + (1 - alpha) * F.col(f"w_{i}") / F.col("sw")).alias("p")) for i, (c, p) in enumerate(reference.items())))
    return total.select("k", (F.col("sw") * F.col("sw") / F.col("sw2")).alias("n_eff"), F.explode(shares).alias("s")).select("k", "n_eff", "s.cls", "s.p")


def rotate(points: DataFrame, angle: float, ratio: float, inverse: bool = False) -> DataFrame:
    """Geometric anisotropy: aniso -> iso coordinates, or back."""
    turn = iso2aniso_columns if inverse else aniso2iso_columns
    x, y = turn(F.col("x"), F.col("y"), angle, ratio)
    return points.withColumns({"x": x, "y": y})


def knn_informative(targets: DataFrame, points: DataFrame, scores: DataFrame, nmax: int, dmax: float) -> DataFrame:
    """The nmax neighbours nearer than dmax that say most about the target's class: ranked by a score table (d, score), linear between its distances, ties to the nearer and then the smaller id."""
    order = Window.orderBy("d")  # a model's distances, some tens of rows
    parts = scores.select(F.col("d").alias("d0"), F.col("score").alias("s0"), F.lead("d").over(order).alias("d1"), F.lead("score").over(order).alias("s1"), F.row_number().over(order).alias("r"))
    near = range_join(targets, points, dmax, strict=True).select(F.col("a.k").alias("k"), *(F.col(f"b.{c}").alias(c) for c in points.columns), "d")
    inside = (F.col("d") >= F.col("d0")) & (F.col("d1").isNull() | (F.col("d") < F.col("d1"))) | ((F.col("r") == 1) & (F.col("d") < F.col("d0")))
    value = F.when(F.col("d1").isNull() | (F.col("d") <= F.col("d0")), F.col("s0")).otherwise(F.col("s0") + (F.col("s1") - F.col("s0")) * (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0")))
    rows = near.join(F.broadcast(parts), inside).withColumn("score", value).drop("d0", "s0", "d1", "s1", "r")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("score", 9)), "d", "id"))).where(F.col("place") <= nmax)
