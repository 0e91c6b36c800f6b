"""Rows that a plot needs: densities, exceedance, ribbons, model curves. Drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions.covariance import Structure, nested_parts, nested_values


def kde(rows: DataFrame, column: str, nodes: int = 50, bandwidth: float | None = None) -> DataFrame:
    """(x, density) at `nodes` places from the least to the greatest value: a Gaussian kernel, by default of Scott's width n**-0.2 · sd."""
    s = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n")).first()
    if not s["n"]:
        return rows.sparkSession.createDataFrame([], "x double, density double")
    h = bandwidth or max((s["sd"] or 0.0) * s["n"] ** -0.2, 1e-12)
    places = [s["lo"] + (s["hi"] - s["lo"]) * i / (nodes - 1) for i in range(nodes)]
    each = rows.select(F.col(column).alias("v"), F.explode(F.array(*map(F.lit, map(float, places)))).alias("x"))
    return each.groupBy("x").agg((F.sum(F.exp(F.pow((F.col("x") - F.col("v")) / h, 2.0) * -0.5)) / (s["n"] * h * math.sqrt(2 * math.pi))).alias("density"))


def _cumulative(z: Column, f: Column) -> Column:
    """Trapezoid CDF at the nodes, scaled to end at 1."""
    steps = F.transform(F.sequence(F.lit(1), F.size(z) - 1), lambda i: (F.element_at(z, i + 1) - F.element_at(z, i)) * (F.element_at(f, i + 1) + F.element_at(f, i)) / 2)
    raw = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.transform(raw, lambda c: c / F.element_at(raw, -1))


def densities(pdf: DataFrame) -> DataFrame:
    """(k, z, f): a target's density nodes as two arrays, from rows (k, i, z, density); some hundred nodes each."""
    grouped = pdf.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "z", "density"))).alias("n"))
    return grouped.select("k", F.col("n.z").alias("z"), F.col("n.density").alias("f"))


def exceedance(nodes: DataFrame, threshold: float) -> DataFrame:
    """(k, p): P(Z > threshold) by linear interpolation of the CDF nodes."""
    c = _cumulative(F.col("z"), F.col("f"))
    rows = nodes.select("k", "z", c.alias("c"))
    i = F.size(F.filter("z", lambda v: v <= threshold))
    z0, z1, c0, c1 = (F.element_at(a, i + b) for a, b in (("z", 0), ("z", 1), ("c", 0), ("c", 1)))
    p = F.when(F.element_at("z", 1) > threshold, 1.0).when(F.element_at("z", -1) <= threshold, 0.0).otherwise(1 - (c0 + (c1 - c0) * (threshold - z0) / (z1 - z0)))
    return rows.select("k", p.alias("p"))


def ribbons(nodes: DataFrame, levels: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(k, q, z): quantiles along a transect from density nodes."""
    rows = nodes.select("k", "z", _cumulative(F.col("z"), F.col("f")).alias("c"))
    rows = rows.select("k", "z", "c", F.explode(F.array(*map(F.lit, map(float, levels)))).alias("q"))
    i = F.greatest(F.lit(1), F.least(F.size(F.filter("c", lambda v: v <= F.col("q"))), F.size("c") - 1))
    z0, z1, c0, c1 = (F.element_at(a, i + b) for a, b in (("z", 0), ("z", 1), ("c", 0), ("c", 1)))
    return rows.select("k", "q", (z0 + (z1 - z0) * F.try_divide(F.col("q") - c0, c1 - c0)).alias("z"))


def quantile_range(quantiles: DataFrame, low: float, high: float) -> DataFrame:
    """(k, width): the gap between two quantiles of rows (k, q, z)."""
    at = lambda q: F.max(F.when(F.abs(F.col("q") - q) < 1e-12, F.col("z")))
    return quantiles.groupBy("k").agg((at(high) - at(low)).alias("width"))


def model_curve(spark: SparkSession, structures: Sequence[Structure], end: float, nodes: int = 100, variogram: bool = False, time: float | None = None) -> DataFrame:
    """(h, value, part<i>): a nested model and its parts over lags, at a time lag if given; as a variogram, C(0) less the covariance."""
    h = [end * i / (nodes - 1) for i in range(nodes)]
    t = None if time is None else [time] * nodes
    total, parts = nested_values(structures, h, t), nested_parts(structures, h, t)
    if variogram:
        total, parts = total[0] - total, [p[0] - p for p in parts]
    rows = [(float(h[i]), float(total[i]), *(float(p[i]) for p in parts)) for i in range(nodes)]
    return spark.createDataFrame(rows, "h double, value double" + "".join(f", part{k} double" for k in range(len(parts))))


def directional_curves(spark: SparkSession, structures: Sequence[Structure], axis: float, ratio: float, angles: Sequence[float], lags: Sequence[float]) -> DataFrame:
    """(theta, lag, cov): a model with geometric anisotropy in several directions."""
    from terravane.functions.covariance import directional_range

    rows = []
    for theta in angles:
        turned = [Structure(s.model, s.sill, (directional_range(s.space[0], ratio, theta, axis), *s.space[1:]) if s.space else (), s.time, s.ratio) for s in structures]
        rows.extend((float(theta), float(h), float(v)) for h, v in zip(lags, nested_values(turned, list(lags)), strict=True))
    return spark.createDataFrame(rows, "theta double, lag double, cov double")
