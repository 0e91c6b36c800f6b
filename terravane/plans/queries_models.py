"""Queries on posteriors, patterns, densities, class tables and bases whose results have closed forms or systems that SQL can solve."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions.covariance import isspacetime, parse_model
from terravane.functions.special import normal_cdf
from terravane.kernels import maxent, optimize
from terravane.kernels.posterior import BmeOptions
from terravane.operators import bme, categorical, density, multivariate, normalscore, series
from terravane.plans.linear_sql import solved_sql, system_sql
from terravane.plans.queries_dependence import DIST
from terravane.plans.queries_estimation import EXPONENTIAL, PQ, C, customers, field, near_sql, suppliers, targets
from terravane.plans.registry import query, r, rounded
from terravane.sources.tables import binding

# posteriors of hard data: normals by simple kriging

HARD = f"{near_sql('targets', 'pts_s', 6, 25, more=', ' + C.format(h=DIST) + ' AS k0')}, {system_sql('m', C.format(h=PQ), ['p.k0'], [])}, {solved_sql('s')}, o AS (SELECT m.k, sum(w[i][1] * z) AS m, 8 - sum(w[i][1] * k0) AS v FROM m JOIN solved ON m.k = solved.k GROUP BY m.k), post AS (SELECT targets.k, coalesce(m, 0) AS m, coalesce(v, 8) AS v FROM targets LEFT JOIN o ON targets.k = o.k)"


@query(f"WITH RECURSIVE {HARD} SELECT k, round(m, 6) + 0.0::DOUBLE AS mean, round(v, 6) AS var, 0.0::DOUBLE AS skew FROM post", "targets pts_s")
def bme_hard_moments(spark, sf):
    """Six hard data around every target."""
    return rounded(bme.bme_moments(targets(spark, sf), suppliers(spark, sf), None, EXPONENTIAL, 6, 0, 25.0))


@query(f"WITH RECURSIVE {HARD} SELECT k, round(m, 6) + 0.0::DOUBLE AS mode FROM post", "targets pts_s")
def bme_hard_mode(spark, sf):
    return rounded(bme.bme_mode(targets(spark, sf), suppliers(spark, sf), None, EXPONENTIAL, 6, 0, 25.0))


@query(f"WITH RECURSIVE {HARD} SELECT k, q, round(m + z * sqrt(v), 6) + 0.0::DOUBLE AS z FROM post CROSS JOIN (VALUES (0.1::DOUBLE, -1.2815515655446004::DOUBLE), (0.5, 0), (0.9, 1.2815515655446004)) levels(q, z)", "targets pts_s")
def bme_hard_quantiles(spark, sf):
    return rounded(bme.bme_quantiles(targets(spark, sf), suppliers(spark, sf), None, EXPONENTIAL, 6, 0, 25.0, levels=(0.1, 0.5, 0.9)))


@query(f"WITH RECURSIVE {HARD} SELECT k, 0.95::DOUBLE AS level, round(m - z * sqrt(v), 6) + 0.0::DOUBLE AS low, round(m + z * sqrt(v), 6) + 0.0::DOUBLE AS high, round(exp(-z * z / 2) / sqrt(2 * pi() * v), 6) AS low_density, round(exp(-z * z / 2) / sqrt(2 * pi() * v), 6) AS high_density FROM post CROSS JOIN (SELECT 1.959963984540054::DOUBLE AS z)", "targets pts_s")
def bme_hard_ci(spark, sf):
    return rounded(bme.bme_intervals(targets(spark, sf), suppliers(spark, sf), None, EXPONENTIAL, 6, 0, 25.0, levels=(0.95,)))


GRID = [float(z) for z in range(-4, 13, 4)]


@query(f"WITH RECURSIVE {HARD} SELECT k, i::INTEGER AS i, (-4 + 4 * i)::DOUBLE AS z, round(exp(-pow(-4 + 4 * i - m, 2) / (2 * v)) / sqrt(2 * pi() * v), 6) + 0.0::DOUBLE AS density FROM post CROSS JOIN range(5) t(i)", "targets pts_s")
def bme_hard_pdf(spark, sf):
    return rounded(bme.bme_pdf(targets(spark, sf), suppliers(spark, sf), None, EXPONENTIAL, 6, 0, 25.0, grid=GRID))


@query(f"WITH RECURSIVE {HARD}, f AS (SELECT *, sqrt(v) AS sd FROM post) SELECT k, round(greatest(m, 0), 6) + 0.0::DOUBLE AS mean FROM f", "targets pts_s")
def bme_hard_nonnegative(spark, sf):
    """Means cut off at 0."""
    return rounded(bme.bme_moments(targets(spark, sf), suppliers(spark, sf), None, EXPONENTIAL, 6, 0, 25.0, options=BmeOptions(nonneg=True)).select("k", "mean"))


# fields folded to few columns

EVEN = "two AS (SELECT r, c % 2 AS c, avg(v) AS v FROM field GROUP BY r, c % 2), s AS (SELECT var_samp(a.v) AS a, var_samp(b.v) AS d, covar_samp(a.v, b.v) AS b FROM two a JOIN two b ON a.r = b.r AND a.c = 0 AND b.c = 1)"
ROOTS = "l AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l1, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS l2 FROM s)"


def folded(spark: SparkSession, sf: str, columns: int) -> DataFrame:
    """The field with its columns averaged by their remainder."""
    return field(spark, sf).groupBy("r", (F.col("c") % columns).alias("c")).agg(F.avg("v").alias("v"))


def numbered(spark: SparkSession, values, name: str = "variance") -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"mode int, {name} double")


@query(f"WITH {EVEN}, {ROOTS} SELECT unnest([0, 1])::INTEGER AS mode, round(unnest([l1, l2]), 8) AS variance FROM l", "field")
def eof_two_columns(spark, sf):
    """Patterns of the means of even and odd columns."""
    return rounded(numbered(spark, multivariate.eof(folded(spark, sf, 2))[0]), 8)


@query(f"WITH {EVEN} SELECT unnest([0, 1])::INTEGER AS mode, round(unnest([1 + abs(b) / sqrt(a * d), 1 - abs(b) / sqrt(a * d)]), 6) AS variance FROM s", "field")
def pca_two_columns(spark, sf):
    """Components of standardised columns: 1 ± |r|."""
    return rounded(numbered(spark, multivariate.pca(folded(spark, sf, 2), norm=1)[0]))


ONE = "one AS (SELECT r, avg(v) AS v FROM field GROUP BY r)"


@query(f"WITH {ONE}, p AS (SELECT x.v AS x, y.v AS y FROM one x JOIN one y ON y.r = x.r + 1), s AS (SELECT var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM p), {ROOTS} SELECT unnest([0, 1])::INTEGER AS mode, round(unnest([l1, l2]), 8) AS variance FROM l", "field")
def extended_eof_window(spark, sf):
    """Extended patterns of the row means with a window of two."""
    return rounded(numbered(spark, multivariate.extended_eof(folded(spark, sf, 1), 2, rotate=False)[0]), 8)


@query(f"WITH {EVEN.replace('c % 2 AS c, avg(v) AS v', 'c % 2 AS c, avg(v) * (1 + 2 * (c % 2)) AS v')}, {ROOTS} SELECT unnest([0, 1])::INTEGER AS mode, round(unnest([l1, l2]), 8) AS variance FROM l", "field")
def multi_field_eof(spark, sf):
    """Two fields side by side: even columns' means, and three times the odd ones'."""
    f = folded(spark, sf, 2)
    odd = f.where("c = 1").select("r", F.lit(0).cast("long").alias("c"), (F.col("v") * 3).alias("v"))
    return rounded(numbered(spark, multivariate.eof(multivariate.stack_fields([f.where("c = 0"), odd]))[0]), 8)


@query("SELECT c AS column, round(var_samp(v), 6) AS communality FROM field GROUP BY c", "field")
def rotated_eof_communality(spark, sf):
    """Rotating all patterns moves variance between them; each column keeps its own."""
    f = field(spark, sf)
    _, turned = multivariate.rotated_eof(f, multivariate.columns_of(f))
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate((turned**2).sum(axis=1))], "column long, communality double"))


THREE = "x AS (SELECT r, avg(v) AS v FROM field WHERE c < 32 GROUP BY r), y AS (SELECT r, c % 2 AS c, avg(v) AS v FROM field WHERE c >= 32 GROUP BY r, c % 2), s AS (SELECT var_samp(x.v) AS xx, var_samp(a.v) AS aa, var_samp(b.v) AS bb, covar_samp(a.v, b.v) AS ab, covar_samp(x.v, a.v) AS xa, covar_samp(x.v, b.v) AS xb FROM x JOIN y a ON x.r = a.r AND a.c = 0 JOIN y b ON x.r = b.r AND b.c = 1)"


def halves(spark, sf):
    """Means of the first 32 columns, and of the others by parity."""
    f = field(spark, sf)
    one = f.where("c < 32").groupBy("r").agg(F.avg("v").alias("v")).select("r", F.lit(0).cast("long").alias("c"), "v")
    return one, f.where("c >= 32").groupBy("r", (F.col("c") % 2).alias("c")).agg(F.avg("v").alias("v"))


@query(f"WITH {THREE} SELECT 0::INTEGER AS mode, round(sqrt(xa * xa + xb * xb), 8) AS value FROM s", "field")
def mca_one_against_two(spark, sf):
    return rounded(numbered(spark, multivariate.mca(*halves(spark, sf))[0], "value"), 8)


@query(f"WITH {THREE} SELECT 0::INTEGER AS mode, round(sqrt((xa * xa * bb - 2 * xa * xb * ab + xb * xb * aa) / (aa * bb - ab * ab) / xx), 5) AS correlation FROM s", "field")
def cca_one_against_two(spark, sf):
    """The canonical correlation of one column with two is the multiple one."""
    return rounded(numbered(spark, multivariate.cca(*halves(spark, sf), n=1)[0], "correlation"), 5)


# maximum-entropy densities of two moments are normal

NODES = "(SELECT i::INTEGER AS i, (i - 6) / 2 AS u FROM range(13) t(i))"


def at_nodes(spark: SparkSession, f: density.MaxEntDensity) -> DataFrame:
    u = (np.arange(13) - 6) / 2
    x = f.mean + f.sd * u
    x = np.exp(x) if f.logs else x
    return spark.createDataFrame([(i, float(a), float(p)) for i, (a, p) in enumerate(zip(x, f(x), strict=True))], "i int, x double, density double")


@query(f"WITH m AS (SELECT avg(z) AS m, stddev_pop(z) AS s FROM pts_c) SELECT i, round(m + s * u, 6) + 0.0::DOUBLE AS x, round(exp(-u * u / 2) / (s * sqrt(2 * pi())), 6) AS density FROM m CROSS JOIN {NODES}", "pts_c")
def maxent_density_normal(spark, sf):
    m = multivariate.moments(customers(spark, sf), "z", 2).first()
    return rounded(at_nodes(spark, density.maxent_density([m["m1"], m["m2"]])))


@query(f"WITH m AS (SELECT avg(ln(m)) AS m, stddev_pop(ln(m)) AS s FROM soft) SELECT i, round(exp(m + s * u), 6) AS x, round(exp(-u * u / 2) / (s * sqrt(2 * pi()) * exp(m + s * u)), 6) AS density FROM m CROSS JOIN {NODES}", "soft")
def maxent_density_lognormal(spark, sf):
    logs = binding(spark, sf, "soft").select(F.log("m").alias("l"))
    m = multivariate.moments(logs, "l", 2).first()
    return rounded(at_nodes(spark, density.maxent_density([m["m1"], m["m2"]], logs=True)))


@query(f"WITH m AS (SELECT avg(z) AS m, stddev_pop(z) AS s, corr(x, z) AS r, avg(x) AS mx, stddev_pop(x) AS sx FROM pts_c) SELECT i, round(m + s * u, 6) + 0.0::DOUBLE AS x, round(exp(-pow(u - r, 2) / (2 * (1 - r * r))) / (s * sqrt(2 * pi() * (1 - r * r))), 4) + 0.0::DOUBLE AS density FROM m CROSS JOIN {NODES}", "pts_c")
def copula_conditional_normal(spark, sf):
    """The density of values a standard deviation of x above its mean: a copula of two normal margins."""
    p = customers(spark, sf)
    row = p.agg(F.avg("z").alias("m"), F.var_pop("z").alias("v"), F.avg("x").alias("mx"), F.var_pop("x").alias("vx"), F.corr("x", "z").alias("r")).first()
    margins = [density.maxent_density([row["m"], row["v"]]), density.maxent_density([row["mx"], row["vx"]])]
    x = row["m"] + row["v"] ** 0.5 * (np.arange(13) - 6) / 2
    f = density.conditional_copula_density(margins, np.array([[1, row["r"]], [row["r"], 1]]), x, np.array([row["mx"] + row["vx"] ** 0.5]))
    out = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(x, f, strict=True))], "i int, x double, density double")
    return out.select("i", r(F.col("x")).alias("x"), r(F.col("density"), 4).alias("density"))


# normal scores of a normal table are linear


SCORES = np.linspace(-4, 4, 80001)


def normal_score(spark, sf) -> normalscore.NormalScore:
    """The table of a normal with the soft means' moments."""
    row = binding(spark, sf, "soft").agg(F.avg("m").alias("m"), F.stddev_pop("m").alias("s")).first()
    return normalscore.NormalScore(row["m"] + row["s"] * SCORES, normal_cdf(SCORES))


@query("WITH n AS (SELECT avg(m) AS mu, stddev_pop(m) AS s FROM soft) SELECT id, round(greatest((m - w - mu) / s, -4), 3) + 0.0::DOUBLE AS lo, round(least((m + w - mu) / s, 4), 3) + 0.0::DOUBLE AS hi FROM soft CROSS JOIN n", "soft")
def soft_scores(spark, sf):
    """Intervals in normal scores, cut at the ends of the table."""
    from terravane.operators import soft

    s = binding(spark, sf, "soft").select("id", "x", "y", soft.uniform(F.col("m") - F.col("w"), F.col("m") + F.col("w")).alias("soft"))
    lo, hi = soft.interval(F.col("soft"))
    return rounded(bme.score_soft(s, normal_score(spark, sf)).select("id", lo.alias("lo"), hi.alias("hi")), 3)


@query("WITH n AS (SELECT avg(m) AS mu, stddev_pop(m) AS s FROM soft) SELECT i::INTEGER AS i, round(s, 5) AS slope, round(exp(-pow((i - 4) / 2, 2) / 2) / (s * sqrt(2 * pi())), 5) AS density FROM n CROSS JOIN range(9) t(i)", "soft")
def score_derivative(spark, sf):
    """dy/dz at nodes, and the density of y from that of a standard normal score."""
    score = normal_score(spark, sf)
    at = np.searchsorted(SCORES, (np.arange(9) - 4) / 2 - 1e-6)
    f = score.density(score.y[at], SCORES, np.exp(-SCORES * SCORES / 2) / math.sqrt(2 * math.pi))
    rows = [(i, float(score.slope()[a]), float(v)) for i, (a, v) in enumerate(zip(at, f, strict=True))]
    return rounded(spark.createDataFrame(rows, "i int, slope double, density double"), 5)


# joint class tables from two pairs that share the target

SHARES = "t AS (SELECT id % 3 AS a, CASE WHEN z > 6 THEN 2 WHEN z > 2 THEN 1 ELSE 0 END AS b, CASE WHEN x > 140 THEN 2 WHEN x > 70 THEN 1 ELSE 0 END AS c FROM pts_c), cells AS (SELECT a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS c FROM range(3) x(a), range(3) y(b), range(3) z(c)), pb AS (SELECT a, b, count(*)::DOUBLE / (SELECT count(*) FROM t) AS p FROM t GROUP BY a, b), pc AS (SELECT a, c, count(*)::DOUBLE / (SELECT count(*) FROM t) AS q FROM t GROUP BY a, c), pa AS (SELECT a, sum(p) AS s FROM pb GROUP BY a), j AS (SELECT cells.*, greatest(coalesce(p, 0), 1e-10) AS p, greatest(coalesce(q, 0), 1e-10) AS q, s FROM cells LEFT JOIN pb ON cells.a = pb.a AND cells.b = pb.b LEFT JOIN pc ON cells.a = pc.a AND cells.c = pc.c LEFT JOIN pa ON cells.a = pa.a)"


def class_pairs(spark, sf) -> dict[tuple[int, int], np.ndarray]:
    """Tables of a target's class with those of two neighbours, each of three classes."""
    z, x = F.col("z"), F.col("x")
    t = customers(spark, sf).select((F.col("id") % 3).alias("a"), F.when(z > 6, 2).when(z > 2, 1).otherwise(0).alias("b"), F.when(x > 140, 2).when(x > 70, 1).otherwise(0).alias("c"))
    out = {}
    for j, other in enumerate(("b", "c"), 1):
        p = np.zeros((3, 3))
        for row in t.groupBy("a", other).count().collect():  # nine rows at most
            p[row["a"], row[other]] = row["count"]
        out[0, j] = p / p.sum()
    return out


def table_rows(spark: SparkSession, t: np.ndarray, digits: int = 6) -> DataFrame:
    return rounded(spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(t)], "a int, b int, c int, p double"), digits)


@query(f"WITH {SHARES} SELECT a, b, c, round(p * q / sum(p * q) OVER (), 6) AS p FROM j", "pts_c")
def joint_table_product(spark, sf):
    """Maximum pseudo-likelihood."""
    return table_rows(spark, maxent.joint_table(class_pairs(spark, sf), 3, 3, "MPL"))


MARKOV = f"WITH {SHARES} SELECT a, b, c, round(p * q / s, {{}}) AS p FROM j"


@query(MARKOV.format(6), "pts_c")
def joint_table_gis(spark, sf):
    """Maximum entropy given two tables that share the target: the neighbours are independent given it."""
    return table_rows(spark, maxent.joint_table(class_pairs(spark, sf), 3, 3, "GIS", tol=1e-12))


@query(MARKOV.format(6), "pts_c")
def joint_table_iis(spark, sf):
    return table_rows(spark, maxent.scaled_table(class_pairs(spark, sf), 3, 3, tol=1e-13, rounds=5000, damped=True))


@query(MARKOV.format(5), "pts_c")
def joint_table_dual(spark, sf):
    return table_rows(spark, maxent.dual_table(class_pairs(spark, sf), 3, 3, reg=0.0), 5)


@query(MARKOV.format(6), "pts_c")
def joint_table_sequential(spark, sf):
    p = class_pairs(spark, sf)
    return table_rows(spark, maxent.sequential_table([{(0, 1): p[0, 1]}, {(0, 2): p[0, 2]}], 3, 3, tol=1e-12))


@query(f"WITH {SHARES}, w AS (SELECT a, sum(p * q / s * [0.2, 0.3, 0.5][b + 1] * [0.6, 0.3, 0.1][c + 1]) AS p FROM j GROUP BY a) SELECT a, round(p / sum(p) OVER (), 6) AS p FROM w", "pts_c")
def joint_table_posterior(spark, sf):
    """The target's classes given class probabilities of both neighbours."""
    t = maxent.scaled_table(class_pairs(spark, sf), 3, 3, tol=1e-12)
    p = maxent.target_posterior(t, [np.array([0.2, 0.3, 0.5]), np.array([0.6, 0.3, 0.1])])
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "a int, p double"))


@query("WITH t AS (SELECT avg(CASE WHEN z > 4 AND x > 100 THEN 1.0::DOUBLE ELSE 0 END) AS p11, avg(CASE WHEN z > 4 AND x <= 100 THEN 1.0::DOUBLE ELSE 0 END) AS p10, avg(CASE WHEN z <= 4 AND x > 100 THEN 1.0::DOUBLE ELSE 0 END) AS p01, avg(CASE WHEN z <= 4 AND x <= 100 THEN 1.0::DOUBLE ELSE 0 END) AS p00 FROM pts_c), o AS (SELECT p11 * p00 / (p10 * p01) AS odds FROM t), q AS (SELECT odds, 1 + (0.3 + 0.6) * (odds - 1) AS s FROM o), u AS (SELECT (s - sqrt(s * s - 4 * odds * (odds - 1) * 0.3 * 0.6)) / (2 * (odds - 1)) AS p FROM q) SELECT round(p, 6) AS p11, round(0.3::DOUBLE - p, 6) AS p10, round(0.6::DOUBLE - p, 6) AS p01, round(1 - 0.9::DOUBLE + p, 6) AS p00 FROM u", "pts_c")
def table_to_margins(spark, sf):
    """A table fitted to given margins keeps its odds ratio."""
    big, east = F.col("z") > 4, F.col("x") > 100
    share = [[F.avg(F.when(a & b, 1.0).otherwise(0.0)) for b in (~east, east)] for a in (~big, big)]
    row = customers(spark, sf).agg(*(share[i][j].alias(f"p{i}{j}") for i in range(2) for j in range(2))).first()
    t = maxent.scale_margins(np.array([[row["p00"], row["p01"]], [row["p10"], row["p11"]]]), np.array([0.7, 0.3]), np.array([0.4, 0.6]))
    return rounded(spark.createDataFrame([(float(t[1, 1]), float(t[1, 0]), float(t[0, 1]), float(t[0, 0]))], "p11 double, p10 double, p01 double, p00 double"))


@query(f"WITH {SHARES}, f AS (SELECT a, b, c, p * q / s AS p FROM j) SELECT b, c, round(sum(p), 6) AS p FROM f GROUP BY b, c", "pts_c")
def separable_table(spark, sf):
    """Two components joined through the class they share: P1ᵀ diag(1 / p) P2."""
    p = class_pairs(spark, sf)
    t = categorical.separable_table([p[0, 1].T, p[0, 2]], p[0, 1].sum(axis=1))
    return rounded(spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(t)], "b int, c int, p double"))


# optimisers


@query("SELECT round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z FROM pts_c", "pts_c")
def least_squares_simplex(spark, sf):
    """The point of least mean squared distance to all points, by the bounded simplex, is their mean."""
    return _least(spark, sf, lambda f, low, high: optimize.bounded_simplex(f, [1.0, 1.0, 1.0], low, high)[0])


@query("SELECT round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z FROM pts_c", "pts_c")
def least_squares_swarm(spark, sf):
    return _least(spark, sf, lambda f, low, high: optimize.particle_swarm(f, (low, high), rounds=300)[0])


def _least(spark, sf, search) -> DataFrame:
    names = ("x", "y", "z")
    row = customers(spark, sf).agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.avg(F.col(c) * F.col(c)).alias(f"s_{c}") for c in names)).first()
    m, s = (np.array([row[f"{k}_{c}"] for c in names]) for k in "ms")
    best = search(lambda p: float((s - 2 * p * m + p * p).sum() - (s - m * m).sum()), np.full(3, -300.0), np.full(3, 300.0))
    return rounded(spark.createDataFrame([tuple(map(float, best))], "x double, y double, z double"), 3)


# bases, models, local means

KNOT = 60.0


@query(f"WITH b AS (SELECT site, t, row_number() OVER (PARTITION BY site ORDER BY t) AS n, z, pow(greatest(z - {KNOT}, 0), 3) AS h FROM grid), s AS (SELECT a.site, a.t, sum(b.z) AS l0, sum((a.n - b.n) * b.z) AS l1, sum(b.h) AS h0 FROM b a JOIN b ON a.site = b.site AND b.n BETWEEN a.n - 2 AND a.n GROUP BY a.site, a.t) SELECT site, t, round(l0, 4) + 0.0::DOUBLE AS cb0_0, round(l1, 4) + 0.0::DOUBLE AS cb0_1, round(h0, 2) + 0.0::DOUBLE AS cb3_0 FROM s", "grid")
def cross_basis(spark, sf):
    """Distributed lags: the linear and the hinge column of two lags, by powers of the lag."""
    out = series.cross_basis(binding(spark, sf, "grid").select("site", "t", "z"), "z", 2, [KNOT], 1)
    return out.select("site", "t", r(F.col("cb0_0"), 4).alias("cb0_0"), r(F.col("cb0_1"), 4).alias("cb0_1"), r(F.col("cb3_0"), 2).alias("cb3_0"))


MODEL_NAMES = ("exponentialC", "gaussianC/exponentialC", "sphericalCST", "nuggetC")


@query("SELECT * FROM (VALUES ('exponentialC', 'exponentialC', NULL, false, false), ('gaussianC/exponentialC', 'gaussianC', 'exponentialC', true, true), ('sphericalCST', 'sphericalCST', 'ST', true, false), ('nuggetC', 'nuggetC', NULL, false, false)) t(model, space, time, spacetime, separable)")
def model_names(spark, sf):
    return spark.createDataFrame([(m, *parse_model(m), *isspacetime([m])[:2]) for m in MODEL_NAMES], "model string, space string, time string, spacetime boolean, separable boolean")


@query("SELECT 'z ~ x + s(y, by=cls) + factor(cls)' AS formula UNION ALL SELECT 'z ~ 1'")
def gam_formula(spark, sf):
    return spark.createDataFrame([(series.gam_formula("z", ["x"], ["y"], ["cls"], by="cls"),), (series.gam_formula("z"),)], "formula string")
