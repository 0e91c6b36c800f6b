"""Queries on reshaping, soft forms, tensors, trends and priors that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import categorical, interpolate, joins, multivariate, ptable, reshape, soft
from terravane.plans.queries_dependence import CLASSES, DIST
from terravane.plans.queries_estimation import TRIANGLE, customers, field, targets, triangle
from terravane.plans.registry import query, rounded
from terravane.sources.tables import binding

# reshaping


@query("SELECT x, y, t, round(avg(z), 6) + 0.0::DOUBLE AS z FROM grid GROUP BY x, y, t", "grid")
def cell_means(spark, sf):
    return rounded(reshape.mean_by_cell(binding(spark, sf, "grid")))


@query("WITH s AS (SELECT DISTINCT x, y FROM grid), d AS (SELECT DISTINCT t FROM grid), m AS (SELECT x, y, t, avg(z) AS z FROM grid GROUP BY x, y, t) SELECT x, y, t, round(z, 6) + 0.0::DOUBLE AS z FROM s CROSS JOIN d LEFT JOIN m USING (x, y, t)", "grid")
def completed_grid(spark, sf):
    """Every site at every time, null where nothing was measured."""
    g = binding(spark, sf, "grid")
    return rounded(reshape.complete_grid(g, g, g))


# soft forms


def _node_sql(z: list[float], density: list[float], scale: str) -> str:
    """Rows (id, i, x, p): densities at m + scale * z, scaled to area 1 by trapezia."""
    rows = ", ".join(f"({i}, {q!r}::DOUBLE, {p!r}::DOUBLE)" for i, (q, p) in enumerate(zip(z, density, strict=True)))
    raw = f"z(i, z, g) AS (VALUES {rows}), f AS (SELECT id, i, m + {scale} * z AS x, g / ({scale}) AS p FROM soft CROSS JOIN z)"
    area = "a AS (SELECT id, sum((x1 - x) * (p + p1) / 2) AS area FROM (SELECT id, x, p, lead(x) OVER q AS x1, lead(p) OVER q AS p1 FROM f WINDOW q AS (PARTITION BY id ORDER BY i)) GROUP BY id)"
    return f"WITH {raw}, {area} SELECT id, i, round(x, 6) AS x, round(p / area, 6) AS p FROM f JOIN a USING (id)"


def _nodes(spark, sf, column):
    s = binding(spark, sf, "soft").select("id", column.alias("s"))
    return rounded(s.select("id", F.posexplode(F.arrays_zip("s.limi", "s.probdens")).alias("i", "n")).select("id", "i", F.col("n.limi").alias("x"), F.col("n.probdens").alias("p")))


USER_DENSITY = [2.718281828459045 ** (-z * z / 2) for z in soft.USER_NODES]


@query(_node_sql(soft.USER_NODES, USER_DENSITY, "w"), "soft")
def soft_gaussian_user_nodes(spark, sf):
    return _nodes(spark, sf, soft.gaussian_user_nodes(F.col("m"), F.pow("w", 2.0)))


SAMPLE = 5  # observations behind each mean
STUDENT_NODES = soft.student_nodes(SAMPLE)


@query(_node_sql(STUDENT_NODES, [(1 + q * q / (SAMPLE - 1)) ** (-SAMPLE / 2) for q in STUDENT_NODES], "w / sqrt(5)"), "soft")
def soft_student_nodes(spark, sf):
    return _nodes(spark, sf, soft.student_t(F.col("m"), F.pow("w", 2.0), SAMPLE))


@query("WITH q(i) AS (VALUES (0), (1), (2), (3), (4)) SELECT id, i, round(m - w + 2 * w * i / 4, 6) AS x, round(1 / (2 * w), 6) AS p FROM soft CROSS JOIN q", "soft")
def soft_uniform_nodes(spark, sf):
    return _nodes(spark, sf, soft.uniform_nodes(F.col("m") - F.col("w"), F.col("m") + F.col("w")))


@query(f"SELECT id, round(2 / (3 * w), 6) AS peak, round(a, 6) AS lo, round(c, 6) AS hi FROM ({TRIANGLE})", "soft")
def soft_normalised(spark, sf):
    """Triangles of three times the area that a density has, scaled back; and their intervals."""
    tall = triangle(spark, sf).withColumn("soft", F.col("soft").withField("probdens", F.transform("soft.probdens", lambda p: p * 3)))
    fine = tall.select("id", soft.normalised(F.col("soft")).alias("s"))
    lo, hi = soft.interval(F.col("s"))
    return rounded(fine.select("id", F.col("s.probdens")[1].alias("peak"), lo.alias("lo"), hi.alias("hi")))


@query(f"SELECT id, 0.0::DOUBLE AS c0, round((b - a) / (c - a), 6) AS c1, 1.0::DOUBLE AS c2 FROM ({TRIANGLE})", "soft")
def soft_cdf_nodes(spark, sf):
    cdf = triangle(spark, sf).select("id", soft.cdf_nodes(F.col("soft")).alias("c"))
    return rounded(cdf.select("id", *(F.col("c")[i].alias(f"c{i}") for i in range(3))))


@query("SELECT id FROM soft WHERE w > 4 OR id % 7 = 0 OR id % 11 = 0", "soft")
def soft_check(spark, sf):
    """Rows that break a rule: a negative density, limits that fall, an unknown type."""
    s = F.col("soft")
    s = F.when(F.col("w") > 4, s.withField("probdens", F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0)))).otherwise(s)
    s = F.when(F.col("id") % 7 == 0, s.withField("limi", F.reverse(s["limi"]))).otherwise(s)
    s = F.when(F.col("id") % 11 == 0, s.withField("type", F.lit(9))).otherwise(s)
    return soft.check(triangle(spark, sf).withColumn("soft", s)).select("id")


@query("SELECT id, round(z - 1, 6) + 0.0::DOUBLE AS centred, round(z - 0.5, 6) + 0.0::DOUBLE AS fixed, round(floor(z / 2) * 2, 6) + 0.0::DOUBLE AS binned, round(z - ('0x' || md5('3:' || id::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2, 6) + 0.0::DOUBLE AS random FROM pts_c", "pts_c")
def soft_random_intervals(spark, sf):
    """The lower ends of intervals of width 2 around values, by each method."""
    out = customers(spark, sf).select("id", "z")
    for method in ("centred", "fixed", "binned", "random"):
        out = soft.random_intervals(out, 2.0, method, 0.25, seed=3).withColumnRenamed("low", method).drop("high")
    return rounded(out.drop("z"))


@query("WITH n AS (SELECT id, unnest([0, 1, 2, 3]) AS i, unnest([m - w, m, m + w - 0.5, m + w]) AS x FROM soft WHERE w > 0.5) SELECT id, count(*) AS nodes, round(min(x), 6) + 0.0::DOUBLE AS lo, round(max(x), 6) + 0.0::DOUBLE AS hi FROM (SELECT DISTINCT id, x FROM n) GROUP BY id", "soft")
def soft_combine_add(spark, sf):
    """Sums of two densities at one place keep the whole union of nodes."""
    s = binding(spark, sf, "soft").where("w > 0.5")
    one = s.select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), soft.uniform(F.col("m") - F.col("w"), F.col("m") + F.col("w")).alias("soft"))
    two = s.select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), soft.uniform(F.col("m"), F.col("m") + F.col("w") - 0.5).alias("soft"))
    both = soft.combine_collocated(one.unionByName(two), method="add")
    lo, hi = soft.interval(F.col("soft"))
    return rounded(both.select(F.col("x").cast("long").alias("id"), F.size("soft.limi").cast("long").alias("nodes"), lo.alias("lo"), hi.alias("hi")))


# class indicators and priors


@query("SELECT id, i, round(CASE WHEN s > 1.5 THEN p / s ELSE 1 / 3.0::DOUBLE END, 6) + 0.0::DOUBLE AS p FROM (SELECT id, unnest([0, 1, 2]) AS i, unnest([w, abs(z) / 10, 0.0::DOUBLE]) AS p, w + abs(z) / 10 AS s FROM (SELECT id, z, (id % 3)::DOUBLE AS w FROM pts_c))", "pts_c")
def indicators_normalised(spark, sf):
    """Rows of class indicators scaled to sum 1; small sums become uniform."""
    raw = F.array((F.col("id") % 3).cast("double"), F.abs("z") / 10, F.lit(0.0))
    return rounded(customers(spark, sf).select("id", F.posexplode(ptable.normalize_indicators(raw, 1.5)).alias("i", "p")))


@query(f"SELECT k, cls, 0.2::DOUBLE AS p FROM targets CROSS JOIN (SELECT unnest({CLASSES!r}) AS cls)", "targets")
def prior_uniform(spark, sf):
    prior = categorical.uniform_prior(targets(spark, sf), CLASSES)
    return prior.select("k", F.explode(F.arrays_zip(F.array(*map(F.lit, CLASSES)).alias("cls"), "prior")).alias("s")).select("k", F.col("s.cls").alias("cls"), F.col("s.prior").alias("p"))


# interpolation and trends


@query(f"WITH k AS (SELECT id AS k, x + 0.5 AS x, y + 0.25 AS y, t FROM (SELECT site AS id, any_value(x) AS x, any_value(y) AS y, max(t) AS t FROM grid GROUP BY site)), p AS (SELECT site * 100 + t::BIGINT AS id, x, y, t, z FROM grid), n AS (SELECT a.k, b.z, {DIST} + 1.5 * abs(a.t - b.t) AS d, row_number() OVER (PARTITION BY a.k ORDER BY {DIST} + 1.5 * abs(a.t - b.t), b.id) AS place FROM k a JOIN p b ON {DIST} <= 6 AND abs(a.t - b.t) <= 4) SELECT k, round(sum(z / (d * d)) / sum(1 / (d * d)), 6) + 0.0::DOUBLE AS z FROM n WHERE place <= 6 GROUP BY k", "grid")
def idw_spacetime(spark, sf):
    g = binding(spark, sf, "grid")
    k = g.groupBy(F.col("site").alias("k")).agg((F.first("x") + 0.5).alias("x"), (F.first("y") + 0.25).alias("y"), F.max("t").alias("t"))
    p = g.select((F.col("site") * 100 + F.col("t").cast("long")).alias("id"), "x", "y", "t", "z")
    return rounded(interpolate.idw_spacetime(p, k, 6, 6.0, 4.0, 1.5))


PLANE = """WITH s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz, count(*) AS n FROM pts_c),
b AS (SELECT *, (yy * xz - xy * yz) / (xx * yy - xy * xy) AS bx, (xx * yz - xy * xz) / (xx * yy - xy * xy) AS by_ FROM s),
c AS (SELECT *, mz - bx * mx - by_ * my AS b0, n * (zz - bx * xz - by_ * yz) / (n - 3) AS v FROM b)"""


@query(f"{PLANE} SELECT unnest([0, 1, 2]) AS term, round(unnest([b0, bx, by_]), 6) + 0.0::DOUBLE AS beta, round(unnest([v, v, v]), 6) AS variance FROM c", "pts_c")
def trend_plane(spark, sf):
    """A plane by least squares: coefficients and the residual variance."""
    beta, variance = interpolate.fit_trend(customers(spark, sf), 1)
    return rounded(spark.createDataFrame([(i, float(b), variance) for i, b in enumerate(beta)], "term int, beta double, variance double"))


@query(f"{PLANE} SELECT k, round(b0 + bx * x + by_ * y, 6) + 0.0::DOUBLE AS z FROM targets CROSS JOIN c", "targets pts_c")
def trend_at_targets(spark, sf):
    beta, _ = interpolate.fit_trend(customers(spark, sf), 1)
    return rounded(targets(spark, sf).select("k", interpolate.trend_column(beta, 1).alias("z")))


# fields and tensors


@query("WITH n AS (SELECT max(c) + 1 AS n FROM field) SELECT a.r, s * n + a2.c AS c, round(a2.v, 6) + 0.0::DOUBLE AS v FROM (SELECT DISTINCT r FROM field) a CROSS JOIN (SELECT unnest([0, 1]) AS s) CROSS JOIN n JOIN field a2 ON a2.r = a.r + s WHERE a.r + 1 IN (SELECT r FROM field)", "field")
def lag_embedding(spark, sf):
    """Two successive rows side by side, for extended patterns."""
    return rounded(multivariate.lag_embedding(field(spark, sf), 2))


@query("SELECT r, c, round(v, 6) + 0.0::DOUBLE AS v FROM field UNION ALL SELECT r, c + (SELECT max(c) + 1 FROM field), round(2 * v, 6) + 0.0::DOUBLE FROM field", "field")
def stacked_fields(spark, sf):
    f = field(spark, sf)
    return rounded(multivariate.stack_fields([f, f.withColumn("v", F.col("v") * 2)]))


@query("SELECT f.c, round(covar_samp(f.v, s.v) / stddev_samp(s.v), 5) + 0.0::DOUBLE AS beta FROM field f JOIN field s ON f.r = s.r AND s.c = 0 GROUP BY f.c", "field")
def regression_map(spark, sf):
    """Each column on the first one, as an expansion coefficient."""
    f = field(spark, sf)
    return rounded(multivariate.regression_map(f, f.where("c = 0").select("r", F.lit(0).alias("k"), "v")), 5)


@query("SELECT r, c, round(v, 5) + 0.0::DOUBLE AS v FROM field", "field")
def eof_mean_whole(spark, sf):
    """A field rebuilt from all its patterns is the field."""
    return rounded(multivariate.eof_mean(field(spark, sf), 1.0), 5)


def tensor(spark, sf):
    """The field as a rows × 8 × 8 tensor."""
    return field(spark, sf).select(F.col("r").alias("i0"), (F.col("c") % 8).alias("i1"), F.floor(F.col("c") / 8).alias("i2"), "v")


@query("SELECT r AS i0, m::BIGINT AS i1, c // 8 AS i2, round(sum(v * (m + 1) / (c % 8 + 1)), 5) + 0.0::DOUBLE AS v FROM field CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) GROUP BY r, m, c // 8", "field")
def tensor_times_matrix(spark, sf):
    m = spark.range(3).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c")).withColumn("v", (F.col("r") + 1) / (F.col("c") + 1))
    return rounded(multivariate.tensor_times_matrix(tensor(spark, sf), m, 3, 1), 5)


@query("SELECT c // 8 AS i0, r AS i1, c % 8 AS i2, round(v, 6) + 0.0::DOUBLE AS v FROM field", "field")
def tensor_permuted(spark, sf):
    return rounded(multivariate.permute(tensor(spark, sf), [2, 0, 1]))


@query("SELECT round(sum(v * v), 4) AS energy FROM (SELECT avg(v) AS v FROM field GROUP BY r % 8, c)", "field")
def hosvd_energy(spark, sf):
    """The core tensor holds all of the energy of a tensor of 8 × 8 × 8 means."""
    small = tensor(spark, sf).groupBy((F.col("i0") % 8).alias("i0"), "i1", "i2").agg(F.avg("v").alias("v"))
    _, core = multivariate.hosvd(small, [8, 8, 8])
    return rounded(core.agg(F.sum(F.col("v") * F.col("v")).alias("energy")), 4)


@query(f"WITH n AS (SELECT a.k, b.id, {DIST} AS d FROM targets a JOIN pts_s b ON {DIST} <= 20) SELECT k, count(*) AS n, round(min(d), 6) AS nearest FROM n GROUP BY k", "targets pts_s")
def neighbour_counts(spark, sf):
    near = joins.range_join(targets(spark, sf), binding(spark, sf, "pts_s"), 20.0)
    return rounded(near.groupBy(F.col("a.k").alias("k")).agg(F.count("*").alias("n"), F.min("d").alias("nearest")))
