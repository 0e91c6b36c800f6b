"""Empirical dependence: binned covariances in space and time, by direction, as maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.joins import block_join, distance, pair_join, range_join
from terravane.operators.places import distance_counts, gap_sums, lag_groups, ordered_sums, sector_groups, time_sums

Lags = Sequence[tuple[float, float]]  # (lag, tolerance)


def bins_of(value: Column, lags: Lags) -> Column:
    """The bins (bin, lag) that hold a value, closed at both ends; bins may overlap, so there may be several."""
    bins = F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(float(m)).alias("lag"), F.lit(float(m - tol)).alias("lo"), F.lit(float(m + tol)).alias("hi")) for i, (m, tol) in enumerate(lags)))
    return F.filter(bins, lambda b: (value >= b["lo"]) & (value <= b["hi"]))


def covariance_of(a: Column, b: Column) -> Column:
    return F.avg(a * b) - F.avg(a) * F.avg(b)


def _reach(lags: Lags) -> float:
    return max(m + t for m, t in lags)


def _valued(points: DataFrame) -> DataFrame:
    return points.where("z is not null and not isnan(z)")


def stcov_spatial(points: DataFrame, lags: Lags, direction: tuple[float, float] | None = None, variogram: bool = False) -> DataFrame:
    """(bin, lag, n, cov) over pairs i <= j by id, self pairs included; NaN and null values drop out.

    `direction` keeps pairs in a sector (centre and tolerance in radians). With
    `variogram`, half mean squared differences over pairs i < j instead.
    """
    groups = sector_groups(lags, [direction]) if direction else lag_groups(lags)
    z = F.col("z").cast("double")
    sums = ordered_sums(_valued(points), [z, z * z] if variogram else [z], _reach(lags), groups, own=not variogram)
    value = ((F.col("a1") + F.col("b1") - 2 * F.col("p0_0")) / F.col("n") / 2).alias("gamma") if variogram else _covariance().alias("cov")
    return sums.select(F.col("g").alias("bin"), F.element_at(F.array(*(F.lit(float(m)) for m, _ in lags)), F.col("g") + 1).alias("lag"), "n", value)


def _covariance() -> Column:
    return F.col("p0_0") / F.col("n") - F.col("a0") / F.col("n") * (F.col("b0") / F.col("n"))


def stcov_sectors(points: DataFrame, lags: Lags, angles: Sequence[float], tolerance: float = math.radians(20)) -> DataFrame:
    """Covariances of every sector and lag in one pass: (sector, bin, n, cov)."""
    sums = ordered_sums(_valued(points), [F.col("z")], _reach(lags), sector_groups(lags, [(c, tolerance) for c in angles]))
    bins = len(lags)
    return sums.select(F.floor(F.col("g") / bins).cast("int").alias("sector"), (F.col("g") % bins).alias("bin"), "n", _covariance().alias("cov"))


def stcov_spacetime(grid: DataFrame, lags: Lags, time_lags: Lags, symmetric: bool = False) -> DataFrame:
    """(sbin, tbin, n, cov) of a long grid (site, x, y, t, z): site pairs i <= j with times s <= t.

    `symmetric` pairs times both ways and averages both means. Sums go by place, tile by
    tile and by chunks of time: no pairs of sites become rows.
    """
    # a site's place is its first one
    sites = grid.groupBy(F.col("site").alias("id")).agg(F.first("x").cast("double").alias("x"), F.first("y").cast("double").alias("y"), F.collect_list(F.when(F.col("z").isNotNull() & ~F.isnan("z"), F.struct("t", "z"))).alias("v"))
    values = sites.select("id", "x", "y", F.explode("v").alias("v")).select("id", "x", "y", F.col("v.t").cast("double").alias("t"), F.col("v.z").cast("double").alias("z"))
    values = values.where("id is not null and x is not null and y is not null and t is not null and not isnan(x) and not isnan(y) and not isnan(t)")
    sums = time_sums(values, _reach(lags), lag_groups(lags), time_lags, symmetric).withColumnRenamed("g", "sbin")
    mean_a, mean_b = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    means = F.pow((mean_a + mean_b) / 2, 2.0) if symmetric else mean_a * mean_b
    return sums.select("sbin", "tbin", "n", (F.col("ab") / F.col("n") - means).alias("cov"))


def cov_nd(pairs: DataFrame, dims: dict[str, Lags]) -> DataFrame:
    """Covariances over pairs with lag columns, a and b: bins half-open (lag - tol, lag + tol], at least two pairs."""
    rows = pairs
    for d, lags in dims.items():
        held = F.array_compact(F.array(*(F.when((F.col(d) > m - t) & (F.col(d) <= m + t), F.lit(i)) for i, (m, t) in enumerate(lags))))
        rows = rows.withColumn(f"{d}_bin", F.explode(held))
    return rows.groupBy(*(f"{d}_bin" for d in dims)).agg(F.count("*").alias("n"), covariance_of(F.col("a"), F.col("b")).alias("cov")).where("n > 1")


def cov_gaps(points: DataFrame, space: Lags, gaps: Lags) -> DataFrame:
    """`cov_nd` over the pairs i <= j of points, by distance (ds) and by the difference of their values (dz): bins of positive lags, without rows of pairs."""
    bins, bands = ([(float(m - t), float(m + t)) for m, t in lags] for lags in (space, gaps))
    sums = gap_sums(points, _reach(space), lambda dx, dy, d: [(d > lo) & (d <= hi) for lo, hi in bins], bands).where("n > 1")
    return sums.select(F.col("g").alias("ds_bin"), F.col("band").alias("dz_bin"), "n", (F.col("ab") / F.col("n") - F.col("a") / F.col("n") * (F.col("b") / F.col("n"))).alias("cov"))


def lagged_sums(one: DataFrame, two: DataFrame, least: float, most: float) -> DataFrame:
    """For two series (t, z): sum of products, pairs, and sums of either side over pairs with signed lag in [least, most]."""
    width = max(most - least, 1e-9)
    a = one.select(F.col("t").alias("t1"), F.col("z").alias("z1"), F.explode(F.array(F.floor((F.col("t") + least) / width), F.floor((F.col("t") + least) / width) + 1)).alias("c"))
    b = two.select(F.col("t").alias("t2"), F.col("z").alias("z2"), F.floor(F.col("t") / width).alias("c"))
    gap = F.col("t2") - F.col("t1")
    return a.join(b, "c").where((gap >= least) & (gap <= most)).agg(F.sum(F.col("z1") * F.col("z2")).alias("sum_ab"), F.count("*").alias("n"), F.sum("z1").alias("sum_a"), F.sum("z2").alias("sum_b"))


def covariance_map(points: DataFrame, dx: float, dy: float, bins: int, fraction: float = 1.0) -> DataFrame:
    """Mean centred products on a displacement grid of (2 bins + 1)² cells over ±dx, ±dy, each pair both ways: (ix, iy, n, cov)."""
    clean = _valued(points)
    mean = clean.agg(F.avg("z").alias("m"))
    centred = clean.crossJoin(F.broadcast(mean)).withColumn("z", F.col("z") - F.col("m")).drop("m")  # one row is broadcast
    pairs = pair_join(centred, math.hypot(dx, dy), own=False)
    both = pairs.select(F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s"), (F.col("b.x") - F.col("a.x")).alias("hx"), (F.col("b.y") - F.col("a.y")).alias("hy"), (F.col("a.z") * F.col("b.z")).alias("zz"))
    wx, wy = dx / bins, dy / bins
    cells = both.withColumns({"hx": F.col("hx") * F.col("s"), "hy": F.col("hy") * F.col("s")}).withColumns({"ix": F.floor(F.col("hx") / wx + 0.5), "iy": F.floor(F.col("hy") / wy + 0.5)})
    near = (F.abs(F.col("hx") - F.col("ix") * wx) <= wx * fraction / 2) & (F.abs(F.col("hy") - F.col("iy") * wy) <= wy * fraction / 2)
    inside = (F.abs(F.col("ix")) <= bins) & (F.abs(F.col("iy")) <= bins)
    return cells.where(near & inside).groupBy("ix", "iy").agg(F.count("*").alias("n"), F.avg("zz").alias("cov"))


def first_crossing(curves: DataFrame, threshold: str = "threshold", value: str = "cov", lag: str = "lag", by: Sequence[str] = ("sector",)) -> DataFrame:
    """The lag at which each curve first falls to the threshold column, by linear interpolation between bins."""
    order = Window.partitionBy(*by).orderBy(lag)
    before, at = F.lag(value).over(order), F.lag(lag).over(order)
    rows = curves.withColumns({"__v": before, "__l": at}).where((F.col(value) <= F.col(threshold)) & (F.col("__v") > F.col(threshold)))
    crossing = F.col("__l") + (F.col("__v") - F.col(threshold)) / (F.col("__v") - F.col(value)) * (F.col(lag) - F.col("__l"))
    return rows.groupBy(*by).agg(F.min_by(crossing, F.col(lag)).alias("range"))


def pair_distances(points: DataFrame, radius: float | None, by: str | None = None) -> DataFrame:
    """Positive distances of all pairs, or of those within a radius, with whether both have the same group."""
    same = F.col(f"a.{by}") == F.col(f"b.{by}") if by else F.lit(True)
    if radius is None:
        pairs = block_join(points, points).where(F.col("a.id") < F.col("b.id")).withColumn("d", distance("a", "b", ("x", "y")))
    else:
        pairs = pair_join(points, radius, own=False)
    return pairs.where("d > 0").select("d", same.alias("same"))


def _quantile(q: float | Sequence[float], accuracy: int) -> Column:
    """With ranks within 1 / accuracy."""
    return F.percentile_approx("d", list(q) if not isinstance(q, float) else q, accuracy)


def distance_quantiles(points: DataFrame, radius: float | None, levels: Sequence[float], by: str | None = None, accuracy: int | None = None) -> DataFrame:
    """Quantiles of pair distances (exact, or of an accuracy), pairs, and the share within groups: one row.

    Without a radius, of all pairs, so that a high quantile is the domain's extent. Exact
    ones are taken over counts of each distance, from pairs of places.
    """
    if accuracy is None:
        counts = distance_counts(points, radius, by)
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("same"), F.sum("told")).alias("same_share"), *(F.percentile("d", F.lit(float(q)), F.col("n")).alias(f"q{round(q * 100)}") for q in levels))
    d = pair_distances(points, radius, by)
    return d.agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("same_share"), *(_quantile(float(q), accuracy).alias(f"q{round(q * 100)}") for q in levels))


def adaptive_edges(points: DataFrame, bins: int, dmax: float, method: str = "equal_pairs", power: float = 1.5, dmin: float | None = None, accuracy: int | None = None) -> DataFrame:
    """Bin edges (bin, edge) from 0: by pair quantiles, by a power law, or logarithmic from dmin."""
    steps = [i / bins for i in range(1, bins + 1)]
    if method == "equal_pairs":
        exact = F.percentile("d", F.array(*map(F.lit, steps)), F.col("n"))
        row = distance_counts(points, dmax).agg(exact.alias("e")) if accuracy is None else pair_distances(points, dmax).agg(_quantile(steps, accuracy).alias("e"))
        edges = row.select(F.explode(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.coalesce(F.col("e"), F.array().cast("array<double>"))))).alias("edge"))
    else:
        spark = points.sparkSession
        if method == "power_law":
            values = [dmax * s**power for s in steps]
        elif method == "log":
            low = dmin or dmax / 100
            values = [low * (dmax / low) ** ((i) / (bins - 1)) for i in range(bins)]
        else:
            raise ValueError(f"unknown method {method}")
        edges = spark.createDataFrame([(v,) for v in sorted({0.0, *values})], "edge double")
    return edges.select((F.row_number().over(Window.orderBy("edge")) - 1).alias("bin"), "edge")  # a handful of edges


def cross_covariance(points: DataFrame, lags: Lags, first: str, second: str) -> DataFrame:
    """Symmetrised cross-covariance of two variables at the same points, for coregionalisation: (bin, lag, n, cov)."""
    has = F.col(first).isNotNull() & F.col(second).isNotNull()
    values = [has.cast("double"), F.when(has, F.col(first)).otherwise(0.0), F.when(has, F.col(second)).otherwise(0.0)]
    sums = ordered_sums(points, values, _reach(lags), lag_groups(lags))
    # a pair with a missing value counts, but has no part in the means
    ab, a, b = (F.col("p1_2") + F.col("p2_1")) / 2, (F.col("p1_0") + F.col("p0_1")) / 2, (F.col("p2_0") + F.col("p0_2")) / 2
    cov = F.try_divide(ab, F.col("p0_0")) - F.try_divide(a, F.col("p0_0")) * F.try_divide(b, F.col("p0_0"))
    return sums.select(F.col("g").alias("bin"), F.element_at(F.array(*(F.lit(float(m)) for m, _ in lags)), F.col("g") + 1).alias("lag"), "n", cov.alias("cov"))


__all__ = ["adaptive_edges", "bins_of", "cov_gaps", "cov_nd", "covariance_map", "cross_covariance", "distance_quantiles", "first_crossing", "lagged_sums", "pair_distances", "range_join", "stcov_sectors", "stcov_spacetime", "stcov_spatial"]
