"""Soft (probabilistic) data: a struct column soft(type, nl, limi, probdens), all by array functions.

Types: 1 histogram (nl limits, nl - 1 densities), 2 piecewise linear (nl nodes), 3 and 4
the same on a regular grid (start, step, end). A Gaussian datum is (mean, var).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.special import normal_quantile, t_quantile

# Probabilities and nodes of the 13-node forms.
GAUSSIAN_PROBABILITIES = [0.0001, 0.001, 0.01, 0.05, 0.3, 0.4, 0.5, 0.6, 0.7, 0.95, 0.99, 0.999, 0.9999]
STUDENT_NORMAL_PROBABILITIES = [0.00001, 0.001, 0.01, 0.05, 0.3, 0.4, 0.5, 0.6, 0.7, 0.95, 0.99, 0.999, 0.99999]
STUDENT_PROBABILITIES = [0.001, 0.01, 0.02, 0.05, 0.3, 0.4, 0.5, 0.6, 0.7, 0.95, 0.98, 0.99, 0.999]
USER_NODES = [-3.719, -3.090, -2.326, -1.645, -0.524, -0.253, 0.000, 0.253, 0.524, 1.645, 2.326, 3.090, 3.719]

NODES = [float(normal_quantile(p)) for p in GAUSSIAN_PROBABILITIES]


def _soft(kind: int, limi: Column, dens: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.size(limi).alias("nl"), limi.alias("limi"), dens.alias("probdens"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def segments(limi: Column, dens: Column) -> Column:
    """(x0, x1, p0, p1) of neighbouring nodes; histograms repeat their density."""
    n = F.size(limi) - 1
    flat = F.size(dens) < F.size(limi)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(limi, i).alias("x0"), F.element_at(limi, i + 1).alias("x1"), F.element_at(dens, i).alias("p0"), F.when(flat, F.element_at(dens, i)).otherwise(F.try_element_at(dens, i + 1)).alias("p1")))


def area(limi: Column, dens: Column) -> Column:
    return _sum(F.transform(segments(limi, dens), lambda s: (s["x1"] - s["x0"]) * (s["p0"] + s["p1"]) / 2))


def uniform(low: Column, high: Column) -> Column:
    """[low, high] as a linear density of two nodes."""
    return _soft(2, F.array(low, high), F.array(1 / (high - low), 1 / (high - low)))


def uniform_nodes(low: Column, high: Column) -> Column:
    """[low, high] as five nodes."""
    d = 1 / (high - low)
    return _soft(2, F.array(*(low + (high - low) * (i / 4) for i in range(5))), F.array(d, d, d, d, d))


def _nodes(mean: Column, sd: Column, z: list[float], density: list[float]) -> Column:
    """A linear density on mean + sd z, scaled to area 1."""
    limi = F.array(*(mean + sd * q for q in z))
    raw = F.array(*(F.lit(p) / sd for p in density))
    return _soft(2, limi, F.transform(raw, lambda p: p / area(limi, raw)))


def gaussian(mean: Column, var: Column) -> Column:
    """A normal density on 13 fixed quantiles."""
    return _nodes(mean, F.sqrt(var), NODES, [math.exp(-z * z / 2) for z in NODES])


def gaussian_user_nodes(mean: Column, var: Column) -> Column:
    """A normal density on the 13 rounded nodes of the user-defined form."""
    return _nodes(mean, F.sqrt(var), USER_NODES, [math.exp(-z * z / 2) for z in USER_NODES])


def student_nodes(n: int) -> list[float]:
    """Signed geometric means of normal and t quantiles, for a mean of n > 1 observations."""
    normal = [float(normal_quantile(p)) for p in STUDENT_NORMAL_PROBABILITIES]
    return [math.copysign(math.sqrt(abs(q * t_quantile(p, n - 1))), q) if abs(q) > 1e-12 else 0.0 for p, q in zip(STUDENT_PROBABILITIES, normal, strict=True)]


def student_t(mean: Column, var: Column, n: int) -> Column:
    """The density of a mean of n observations on 13 nodes: signed geometric means of normal and t quantiles times sd / sqrt(n); n <= 1 is normal."""
    sd = F.sqrt(var / max(n, 1))
    normal = [float(normal_quantile(p)) for p in STUDENT_NORMAL_PROBABILITIES]
    if n <= 1:
        return _nodes(mean, sd, normal, [math.exp(-z * z / 2) for z in normal])
    z = student_nodes(n)
    return _nodes(mean, sd, z, [(1 + q * q / (n - 1)) ** (-n / 2) for q in z])


def normalised(soft: Column) -> Column:
    a = area(soft["limi"], soft["probdens"])
    return F.struct(soft["type"].alias("type"), soft["nl"].alias("nl"), soft["limi"].alias("limi"), F.transform(soft["probdens"], lambda p: p / a).alias("probdens"))


def moments(soft: Column) -> tuple[Column, Column]:
    """Exact mean and variance of the density, by its segments."""
    s = segments(soft["limi"], soft["probdens"])
    first = _sum(F.transform(s, lambda g: (g["x1"] - g["x0"]) * (g["p0"] * (g["x0"] * 2 + g["x1"]) + g["p1"] * (g["x0"] + g["x1"] * 2)) / 6))
    second = _sum(F.transform(s, lambda g: (g["x1"] - g["x0"]) * (g["p0"] * (g["x0"] * g["x0"] * 3 + g["x0"] * g["x1"] * 2 + g["x1"] * g["x1"]) + g["p1"] * (g["x0"] * g["x0"] + g["x0"] * g["x1"] * 2 + g["x1"] * g["x1"] * 3)) / 12))
    total = area(soft["limi"], soft["probdens"])
    mean = first / total
    return mean, second / total - mean * mean


def cdf_nodes(soft: Column) -> Column:
    """The trapezoid CDF at the nodes, ending at 1."""
    s = segments(soft["limi"], soft["probdens"])
    parts = F.transform(s, lambda g: (g["x1"] - g["x0"]) * (g["p0"] + g["p1"]) / 2)
    total = _sum(parts)
    return F.aggregate(parts, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x / total)))


def quantile(soft: Column, q: float) -> Column:
    """Linear interpolation of the CDF nodes."""
    limi, cdf = soft["limi"], cdf_nodes(soft)
    i = F.greatest(F.lit(1), F.least(F.size(F.filter(cdf, lambda c: c <= q)), F.size(cdf) - 1))
    x0, x1, c0, c1 = F.element_at(limi, i), F.element_at(limi, i + 1), F.element_at(cdf, i), F.element_at(cdf, i + 1)
    return x0 + (x1 - x0) * (F.lit(q) - c0) / (c1 - c0)


def density_at(soft: Column, z: Column) -> Column:
    """The density at z: half-open bins for histograms, linear between nodes; 0 outside."""
    hit = F.filter(segments(soft["limi"], soft["probdens"]), lambda g: (z >= g["x0"]) & F.when(F.lit(True) & (soft["type"] % 2 == 1), z < g["x1"]).otherwise(z <= g["x1"]))
    g = F.try_element_at(hit, F.lit(1))
    return F.when(F.size(hit) == 0, 0.0).otherwise(g["p0"] + (g["p1"] - g["p0"]) * (z - g["x0"]) / (g["x1"] - g["x0"]))


def interval(soft: Column) -> tuple[Column, Column]:
    return F.element_at(soft["limi"], 1), F.element_at(soft["limi"], -1)


def offset(soft: Column, by: Column | float) -> Column:
    return F.struct(soft["type"].alias("type"), soft["nl"].alias("nl"), F.transform(soft["limi"], lambda x: x + by).alias("limi"), soft["probdens"].alias("probdens"))


def expand_grid(soft: Column) -> Column:
    """Types 3 and 4 (start, step, end) as types 1 and 2 with explicit limits."""
    start, step, end = soft["limi"][0], soft["limi"][1], soft["limi"][2]
    n = F.round((end - start) / step).cast("int")
    limi = F.when(soft["type"] >= 3, F.transform(F.sequence(F.lit(0), n), lambda i: start + step * i)).otherwise(soft["limi"])
    return _soft(0, limi, soft["probdens"]).withField("type", F.when(soft["type"] >= 3, soft["type"] - 2).otherwise(soft["type"]))


def split(soft: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is in `ids`, and the rest."""
    return soft.join(ids, "id", "left_semi"), soft.join(ids, "id", "left_anti")


def concat(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two)


def combine_collocated(soft: DataFrame, by: tuple[str, ...] = ("x", "y"), method: str = "mult") -> DataFrame:
    """One linear density per place: products ('mult'; sums where they vanish) or sums ('add') on the whole union of nodes, scaled to area 1.

    Repeated rows at a place count once. A place's densities are gathered in its row.
    """
    rows = soft.select(*by, F.struct("soft.limi", "soft.probdens").alias("s")).distinct()
    groups = rows.groupBy(*by).agg(F.collect_list("s").alias("all"))
    grid = F.array_sort(F.array_distinct(F.flatten(F.col("all")["limi"])))
    groups = groups.withColumn("limi", grid)

    def at(s: Column, z: Column) -> Column:
        return density_at(F.struct(F.lit(2).alias("type"), s["limi"].alias("limi"), s["probdens"].alias("probdens")), z)

    product = F.transform("limi", lambda z: F.aggregate("all", F.lit(1.0), lambda acc, s: acc * at(s, z)))
    total = F.transform("limi", lambda z: F.aggregate("all", F.lit(0.0), lambda acc, s: acc + at(s, z)))
    groups = groups.withColumn("mult", product).withColumn("dens", F.when(F.lit(method != "add") & (area(F.col("limi"), F.col("mult")) > 0), F.col("mult")).otherwise(total))
    scaled = F.transform("dens", lambda p: p / area(F.col("limi"), F.col("dens")))
    return groups.select(*by, _soft(2, F.col("limi"), scaled).alias("soft"))


def check(soft: DataFrame, column: str = "soft") -> DataFrame:
    """The rows that break a rule: unknown type, limits that don't rise, lengths that don't fit, negative densities."""
    s = F.col(column)
    rising = F.aggregate(F.transform(F.sequence(F.lit(1), F.size(s["limi"]) - 1), lambda i: F.element_at(s["limi"], i) < F.element_at(s["limi"], i + 1)), F.lit(True), lambda a, b: a & b)
    fits = F.when(s["type"] == 1, F.size(s["probdens"]) == F.size(s["limi"]) - 1).when(s["type"] == 2, F.size(s["probdens"]) == F.size(s["limi"])).otherwise(True)
    fine = s["type"].isin(1, 2, 3, 4) & F.when(s["type"] <= 2, rising).otherwise(True) & fits & F.forall(s["probdens"], lambda p: p >= 0)
    return soft.where(~F.coalesce(fine, F.lit(False)))


def standard_type(kind: str | int) -> int:
    """'histogram' 1, 'linear' 2, 'gaussian' or 'normal' 10, by prefix; numbers 1, 2 and 10."""
    if isinstance(kind, int):
        if kind in (1, 2, 10):
            return kind
    else:
        for name, number in (("histogram", 1), ("linear", 2), ("gaussian", 10), ("normal", 10)):
            if kind and name.startswith(kind.lower()):
                return number
    raise ValueError(f"unknown soft type {kind!r}")


def standard_order(order: object) -> object:
    """'zero mean' is NaN, 'constant mean' 0; anything else stays."""
    return {"zero mean": float("nan"), "constant mean": 0}.get(order, order) if isinstance(order, str) else order


def random_intervals(points: DataFrame, width: float, method: str = "centred", value: float = 0.0, seed: int = 0) -> DataFrame:
    """Intervals (low, high) of a width around values: random, centred, a fixed share below, or the bin that holds the value."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    low = {"random": F.col("z") - u * width, "centred": F.col("z") - width / 2, "fixed": F.col("z") - value * width, "binned": F.floor(F.col("z") / width) * width}[method]
    return points.withColumn("low", low).withColumn("high", low + width)
