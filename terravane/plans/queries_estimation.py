"""Queries on interpolation, kriging, Bayesian maximum entropy, soft data, classes, outliers and analysis."""

from __future__ import annotations




from pyspark.sql import functions as F

from terravane.functions.covariance import Structure
from terravane.operators import bme, categorical, dependence, entropy, evaluate, fitting, interpolate, kriging, multivariate, normalscore, outlier, ptable, regions, series, simulate, soft
from terravane.plans.linear_sql import solved_sql, system_sql
from terravane.plans.queries_dependence import CLASSES, DIST, EDGES, MODEL, REFERENCE, VALUE
from terravane.plans.registry import query, r, rounded
from terravane.sources.tables import binding

EXPONENTIAL = [Structure("exponentialC", 8.0, (30.0,))]
C = "8 * exp(-3 * {h} / 30)"


def targets(spark, sf):
    return binding(spark, sf, "targets")


def suppliers(spark, sf):
    return binding(spark, sf, "pts_s")


def customers(spark, sf):
    return binding(spark, sf, "pts_c")


# interpolation


@query(f"SELECT a.k, round(sum(b.z / pow({DIST} + 1e-10, 2)) / sum(1 / pow({DIST} + 1e-10, 2)), 6) + 0.0::DOUBLE AS z FROM targets a CROSS JOIN pts_s b GROUP BY a.k", "targets pts_s")
def idw_all(spark, sf):
    return rounded(interpolate.idw_all(suppliers(spark, sf), targets(spark, sf)))


@query(f"WITH p AS (SELECT a.id AS k, b.z, {DIST} AS d FROM pts_s a CROSS JOIN pts_s b) SELECT k, round(sum(CASE WHEN d = 0 THEN 0 ELSE z / pow(d, 2) END) / sum(CASE WHEN d = 0 THEN 0 ELSE 1 / pow(d, 2) END), 6) + 0.0::DOUBLE AS z FROM p GROUP BY k", "pts_s")
def idw_zero_weight(spark, sf):
    """At the data's own places, a collocated datum is left out."""
    own = suppliers(spark, sf).select(F.col("id").alias("k"), "x", "y")
    return rounded(interpolate.idw_all(suppliers(spark, sf), own, zero_weight=True))


@query(f"WITH n AS (SELECT a.k, b.id, b.z, {DIST} AS d, row_number() OVER (PARTITION BY a.k ORDER BY {DIST}, b.id) AS place FROM targets a JOIN pts_c b ON {DIST} <= 12) SELECT k, round(sum(z / (d * d)) / sum(1 / (d * d)), 6) + 0.0::DOUBLE AS z FROM n WHERE place <= 10 GROUP BY k", "targets pts_c")
def idw_knn(spark, sf):
    return rounded(interpolate.idw_knn(customers(spark, sf), targets(spark, sf), 10, 12.0))


ST_TARGETS = "k AS (SELECT site * 100 + t::BIGINT AS k, x, y, t FROM grid)"


def st_targets(spark, sf):
    g = binding(spark, sf, "grid")
    return g, g.select((F.col("site") * 100 + F.col("t").cast("long")).alias("k"), "x", "y", "t")


@query(f"WITH {ST_TARGETS} SELECT a.k, round(sum(b.z * exp(-3 * (pow({DIST} / 2, 2) + pow(abs(a.t - b.t) / 3, 2)))) / sum(exp(-3 * (pow({DIST} / 2, 2) + pow(abs(a.t - b.t) / 3, 2)))), 6) AS z FROM k a JOIN grid b ON {DIST} <= 10 GROUP BY a.k", "grid")
def kernel_smooth_st(spark, sf):
    g, k = st_targets(spark, sf)
    return rounded(interpolate.smooth_spacetime(g, k, 2.0, 3.0))


U = f"(pow({DIST} / 4, 2) + pow(abs(a.t - b.t) / 3, 2))"


@query(f"WITH {ST_TARGETS} SELECT a.k, round(sum(b.z * greatest(1 - {U}, 0)) / sum(greatest(1 - {U}, 0)), 6) AS z FROM k a JOIN grid b ON {DIST} <= 4 AND abs(a.t - b.t) <= 3 WHERE {U} < 1 GROUP BY a.k", "grid")
def kernel_smooth_quadratic(spark, sf):
    g, k = st_targets(spark, sf)
    return rounded(interpolate.smooth_spacetime(g, k, 4.0, 3.0, "quadratic"))


@query(f"WITH {ST_TARGETS} SELECT a.k, round(sum(b.z * exp(-3 * {U})) / sum(exp(-3 * {U})), 6) AS z FROM k a JOIN grid b ON {DIST} <= 4 AND abs(a.t - b.t) <= 3 WHERE {U} <= 1 GROUP BY a.k", "grid")
def kernel_smooth_truncated(spark, sf):
    g, k = st_targets(spark, sf)
    return rounded(interpolate.smooth_spacetime(g, k, 4.0, 3.0, truncate=True))


@query(f"WITH n AS (SELECT a.k, b.z, {DIST} AS d, row_number() OVER (PARTITION BY a.k ORDER BY {DIST}, b.id) AS place FROM targets a JOIN pts_c b ON {DIST} <= 12) SELECT k, round(sum(z * exp(-0.5 * d * d / 16)) / sum(exp(-0.5 * d * d / 16)), 6) + 0.0::DOUBLE AS z FROM n WHERE place <= 20 GROUP BY k", "targets pts_c")
def kernel_smooth_knn(spark, sf):
    return rounded(interpolate.smooth_knn(customers(spark, sf), targets(spark, sf), 4.0, 20, 12.0))


@query("SELECT site, t, round(avg(z), 6) AS m FROM grid GROUP BY GROUPING SETS ((site), (t), ())", "grid")
def stmean_levels(spark, sf):
    return rounded(interpolate.means_by_site_and_time(binding(spark, sf, "grid")))


@query("SELECT g.site, g.t, round(ms + mt - mg, 6) AS m FROM grid g JOIN (SELECT site, avg(z) AS ms FROM grid GROUP BY site) s USING (site) JOIN (SELECT t, avg(z) AS mt FROM grid GROUP BY t) u USING (t) CROSS JOIN (SELECT avg(z) AS mg FROM grid) m", "grid")
def stmean_raw(spark, sf):
    return rounded(interpolate.stmean(binding(spark, sf, "grid")))


@query(f"WITH s AS (SELECT site, any_value(x) AS x, any_value(y) AS y, avg(z) AS ms FROM grid GROUP BY site), u AS (SELECT t, avg(z) AS mt FROM grid GROUP BY t), ss AS (SELECT a.site, sum(b.ms * CASE WHEN {DIST} < 6 THEN pow(1 - pow({DIST} / 6, 3), 3) ELSE 0 END) / sum(CASE WHEN {DIST} < 6 THEN pow(1 - pow({DIST} / 6, 3), 3) ELSE 0 END) AS ms FROM s a JOIN s b ON {DIST} <= 6 GROUP BY a.site), tt AS (SELECT a.t, sum(b.mt * CASE WHEN abs(a.t - b.t) < 5 THEN pow(1 - pow(abs(a.t - b.t) / 5, 3), 3) ELSE 0 END) / sum(CASE WHEN abs(a.t - b.t) < 5 THEN pow(1 - pow(abs(a.t - b.t) / 5, 3), 3) ELSE 0 END) AS mt FROM u a JOIN u b ON abs(a.t - b.t) <= 5 GROUP BY a.t) SELECT g.site, g.t, round(ms + mt - mg, 6) AS m FROM grid g JOIN ss USING (site) JOIN tt USING (t) CROSS JOIN (SELECT avg(z) AS mg FROM grid) m", "grid")
def stmean_smooth(spark, sf):
    return rounded(interpolate.stmean(binding(spark, sf, "grid"), smooth=True, d_neib=6.0, t_neib=5.0))


@query(f"WITH s AS (SELECT site AS id, any_value(x) AS x, any_value(y) AS y, avg(z) AS z FROM grid GROUP BY site), k AS (SELECT id AS k, x % 31 + 0.5 AS x, y % 29 + 0.25 AS y FROM pts_s), sp AS (SELECT a.k, sum(b.z / pow({DIST} + 1e-10, 2)) / sum(1 / pow({DIST} + 1e-10, 2)) AS z FROM k a CROSS JOIN s b GROUP BY a.k), u AS (SELECT t, avg(z) AS m FROM grid GROUP BY t), q AS (SELECT (i + 0.5)::DOUBLE AS t FROM range(0, 32, 4) r(i)), b AS (SELECT q.t, (SELECT max(t) FROM u WHERE u.t <= q.t) AS lo, (SELECT min(t) FROM u WHERE u.t > q.t) AS hi FROM q), c AS (SELECT b.t, CASE WHEN lo IS NULL THEN h.m WHEN hi IS NULL THEN l.m ELSE l.m + (h.m - l.m) * (b.t - lo) / (hi - lo) END AS m FROM b LEFT JOIN u l ON l.t = lo LEFT JOIN u h ON h.t = hi) SELECT k, t, round(sp.z + c.m - mg, 6) AS m FROM sp CROSS JOIN c CROSS JOIN (SELECT avg(z) AS mg FROM grid) g", "grid pts_s")
def stmean_interp(spark, sf):
    sites = suppliers(spark, sf).select(F.col("id").alias("k"), (F.col("x") % 31 + 0.5).alias("x"), (F.col("y") % 29 + 0.25).alias("y"))
    times = spark.range(0, 32, 4).select((F.col("id") + 0.5).cast("double").alias("t"))
    return rounded(interpolate.stmean_interp(binding(spark, sf, "grid"), sites, times))


@query(f"SELECT a.k, round(sum(b.z * exp(-0.5 * pow({DIST} / 8, 2))) / sum(exp(-0.5 * pow({DIST} / 8, 2))), 6) + 0.0::DOUBLE AS m FROM targets a JOIN pts_s b ON {DIST} <= 64 GROUP BY a.k", "targets pts_s")
def prior_mean_kernel(spark, sf):
    return rounded(interpolate.prior_mean(suppliers(spark, sf), targets(spark, sf), 8.0))


@query(f"SELECT a.k, round(coalesce(sum(b.z * greatest(1 - pow({DIST} / 8, 2), 0)) FILTER ({DIST} < 8) / sum(greatest(1 - pow({DIST} / 8, 2), 0)) FILTER ({DIST} < 8), (SELECT avg(z) FROM pts_s)), 6) + 0.0::DOUBLE AS m FROM targets a CROSS JOIN pts_s b GROUP BY a.k", "targets pts_s")
def prior_mean_truncated(spark, sf):
    return rounded(interpolate.prior_mean(suppliers(spark, sf), targets(spark, sf), 8.0, "kernel_truncate", "epanechnikov"))


@query(f"SELECT a.k, round(sum(b.z / pow({DIST} + 1e-10, 2)) / sum(1 / pow({DIST} + 1e-10, 2)), 6) + 0.0::DOUBLE AS m FROM targets a CROSS JOIN pts_s b GROUP BY a.k", "targets pts_s")
def prior_mean_idw(spark, sf):
    return rounded(interpolate.prior_mean(suppliers(spark, sf), targets(spark, sf), 8.0, "idw"))


@query(f"WITH p AS (SELECT a.id, a.z AS za, b.z AS zb, {DIST} AS d FROM pts_c a JOIN pts_c b ON a.id <> b.id AND {DIST} <= 12), f AS (SELECT w.bandwidth, id, any_value(za) AS za, sum(zb * exp(-0.5 * pow(d / bandwidth, 2))) / nullif(sum(exp(-0.5 * pow(d / bandwidth, 2))), 0) AS m FROM p CROSS JOIN (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (8.0::DOUBLE)) w(bandwidth) GROUP BY 1, 2) SELECT bandwidth, round(avg(pow(za - m, 2)), 6) AS mse, count(m) AS n FROM f GROUP BY bandwidth", "pts_c")
def bandwidth_loocv(spark, sf):
    return rounded(interpolate.loocv_bandwidths(customers(spark, sf), [2.0, 4.0, 8.0], 12.0))


@query(f"WITH w(bandwidth) AS (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (8.0::DOUBLE)), p AS (SELECT a.id, b.z, {DIST} AS d FROM pts_c a JOIN pts_c b ON a.id <> b.id), f AS (SELECT bandwidth, id, sum(z * exp(-0.5 * pow(d / bandwidth, 2))) / nullif(sum(exp(-0.5 * pow(d / bandwidth, 2))), 0) AS m FROM p CROSS JOIN w GROUP BY 1, 2), g AS (SELECT avg(z) AS g FROM pts_c) SELECT w.bandwidth, round(avg(pow(c.z - coalesce(f.m, g.g), 2)), 6) AS mse, count(*) AS n FROM pts_c c CROSS JOIN w CROSS JOIN g LEFT JOIN f ON f.id = c.id AND f.bandwidth = w.bandwidth GROUP BY w.bandwidth", "pts_c")
def bandwidth_loocv_all(spark, sf):
    """Every point by all others."""
    return rounded(interpolate.loocv_bandwidths(customers(spark, sf), [2.0, 4.0, 8.0]))


@query(f"WITH n AS (SELECT min({DIST}) AS d FROM pts_c a JOIN pts_c b ON a.id <> b.id AND {DIST} <= 30 GROUP BY a.id) SELECT round(greatest(1.5 * (SELECT quantile_cont(d, 0.5) FROM n), greatest(max(x) - min(x), max(y) - min(y)) / 10), 6) AS bandwidth FROM pts_c", "pts_c")
def bandwidth_default(spark, sf):
    return rounded(interpolate.default_bandwidth(customers(spark, sf), 30.0))


@query("SELECT round(avg(z), 6) AS beta, round(var_samp(z) / count(*), 6) AS var_beta, count(*) AS n FROM pts_c", "pts_c")
def ols_mean(spark, sf):
    return rounded(interpolate.ols_mean(customers(spark, sf)))


# kriging and BME

TWO = f"n AS (SELECT a.k, b.id, b.x, b.y, b.z, {DIST} AS d, row_number() OVER (PARTITION BY a.k ORDER BY {DIST}, b.id) AS place FROM targets a JOIN pts_s b ON {DIST} <= 25), two AS (SELECT u.k, u.z AS z1, v.z AS z2, {C.format(h='u.d')} AS k1, {C.format(h='v.d')} AS k2, {C.format(h='sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2))')} AS c FROM n u JOIN n v ON u.k = v.k AND u.place = 1 AND v.place = 2), one AS (SELECT k, any_value(z) AS z, {C.format(h='any_value(d)')} AS k1 FROM n GROUP BY k HAVING count(*) = 1)"
NONE = "SELECT k, NULL, NULL FROM targets WHERE k NOT IN (SELECT k FROM n)"


@query(f"WITH {TWO}, w AS (SELECT *, 0.5 + (k1 - k2) / (2 * (8 - c)) AS l FROM two) SELECT k, round(l * z1 + (1 - l) * z2, 6) + 0.0::DOUBLE AS zk, round(8 - 2 * (l * k1 + (1 - l) * k2) + 8 * (l * l + (1 - l) * (1 - l)) + 2 * l * (1 - l) * c, 6) + 0.0::DOUBLE AS vk FROM w UNION ALL SELECT k, round(z, 6), round(16 - 2 * k1, 6) FROM one UNION ALL {NONE}", "targets pts_s")
def ok_two_neighbours(spark, sf):
    """Ordinary kriging from two neighbours, against its closed form."""
    return rounded(kriging.kriging(targets(spark, sf), suppliers(spark, sf), EXPONENTIAL, 2, 25.0, order=0))


SIMPLE = "SELECT k, (8 * k1 - c * k2) / (64 - c * c) AS a, (8 * k2 - c * k1) / (64 - c * c) AS b, z1, z2, k1, k2 FROM two"


@query(f"WITH {TWO}, w AS ({SIMPLE}) SELECT k, round(a * z1 + b * z2, 6) + 0.0::DOUBLE AS zk, round(8 - a * k1 - b * k2, 6) + 0.0::DOUBLE AS vk FROM w UNION ALL SELECT k, round(k1 / 8 * z, 6) + 0.0::DOUBLE, round(8 - k1 * k1 / 8, 6) FROM one UNION ALL {NONE}", "targets pts_s")
def sk_two_neighbours(spark, sf):
    return rounded(kriging.kriging(targets(spark, sf), suppliers(spark, sf), EXPONENTIAL, 2, 25.0))


PQ = "sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))"


def near_sql(a: str, b: str, nmax: int, dmax: float, where: str = "true", more: str = "") -> str:
    """CTE `m`: the nmax nearest of b to each target in a (k, x, y), places i from 1."""
    return f"n AS (SELECT a.k, b.*, {DIST} AS d, row_number() OVER (PARTITION BY a.k ORDER BY {DIST}, b.id) AS i{more} FROM {a} a JOIN {b} b ON {DIST} <= {dmax} WHERE {where}), m AS (SELECT * FROM n WHERE i <= {nmax})"


def ordinary_sql(sill: float) -> str:
    """Estimates and variances from the solved systems of ordinary kriging: the last row is the multiplier."""
    return f"o AS (SELECT m.k, sum(w[i][1] * z) AS zk, {sill} - sum(w[i][1] * k0) - any_value(w[len(w)][1]) AS vk FROM m JOIN solved ON m.k = solved.k GROUP BY m.k)"


PLACES = "places AS (SELECT min(id) AS id, x, y, avg(z) AS z FROM pts_c WHERE z IS NOT NULL GROUP BY x, y)"
NUGGET = f"CASE WHEN p.i = q.i THEN 9.0 ELSE {C.format(h=PQ)} END"
LOCAL = f"{PLACES}, {near_sql('targets', 'places', 12, 20, more=', ' + C.format(h=DIST) + ' AS k0')}, {system_sql('m', NUGGET, ['p.k0'], [('1', ['1'])])}, {solved_sql('s')}, {ordinary_sql(9.0)}"


@query(f"WITH RECURSIVE {LOCAL} SELECT k, round(zk, 6) + 0.0::DOUBLE AS zk, round(vk, 6) + 0.0::DOUBLE AS vk FROM targets LEFT JOIN o USING (k)", "targets pts_c")
def kriging_local(spark, sf):
    return rounded(kriging.kriging(targets(spark, sf), kriging.place_means(customers(spark, sf)), [Structure("nuggetC", 1.0), *EXPONENTIAL], 12, 20.0, order=0))


LOOCV = f"own AS (SELECT id AS k, x, y FROM pts_s), {near_sql('own', 'pts_s', 8, 40, 'a.k <> b.id', ', ' + C.format(h=DIST) + ' AS k0')}, {system_sql('m', C.format(h=PQ), ['p.k0'], [('1', ['1'])])}, {solved_sql('s')}, {ordinary_sql(8.0)}"


@query(f"WITH RECURSIVE {LOOCV} SELECT id AS k, round(z, 6) + 0.0::DOUBLE AS z, round(zk, 6) + 0.0::DOUBLE AS zk, round(vk, 6) + 0.0::DOUBLE AS vk FROM pts_s LEFT JOIN o ON id = o.k", "pts_s")
def kriging_loocv(spark, sf):
    return rounded(kriging.kriging_loocv(suppliers(spark, sf), EXPONENTIAL, 8, 40.0, order=0))


ST_GRID = "points AS (SELECT min(site * 100 + t::BIGINT) AS id, x, y, t, avg(z) AS z FROM grid WHERE z IS NOT NULL GROUP BY x, y, t), own AS (SELECT site AS k, any_value(x) AS x, any_value(y) AS y, max(t) + 1 AS t FROM grid GROUP BY site)"
LAG = "abs(a.t - b.t)"
ST_NEAR = f"n AS (SELECT a.k, b.*, 2 * exp(-3 * {DIST} / 8) * exp(-3 * {LAG} / 4) AS k0, row_number() OVER (PARTITION BY a.k ORDER BY {DIST} + {LAG}, b.id) AS i FROM own a JOIN points b ON {DIST} <= 6 AND {LAG} <= 5), m AS (SELECT * FROM n WHERE i <= 8)"
ST_SYSTEM = f"{ST_GRID}, {ST_NEAR}, {system_sql('m', f'2 * exp(-3 * {PQ} / 8) * exp(-3 * abs(p.t - q.t) / 4)', ['p.k0'], [('1', ['1'])])}, {solved_sql('s')}, {ordinary_sql(2.0)}"


@query(f"WITH RECURSIVE {ST_SYSTEM} SELECT k, round(zk, 6) + 0.0::DOUBLE AS zk, round(vk, 6) + 0.0::DOUBLE AS vk FROM own LEFT JOIN o USING (k)", "grid")
def kriging_spacetime(spark, sf):
    g = binding(spark, sf, "grid").withColumn("id", F.col("site") * 100 + F.col("t").cast("long"))
    k = g.groupBy(F.col("site").alias("k")).agg(F.first("x").alias("x"), F.first("y").alias("y"), (F.max("t") + 1).alias("t"))
    return rounded(kriging.kriging(k, kriging.place_means(g, ("x", "y", "t")), [Structure("exponentialC/exponentialC", 2.0, (8.0,), (4.0,))], 8, (6.0, 5.0, 1.0), order=0))


FACTORS = f"{near_sql('targets', 'pts_s', 8, 25, more=', ' + C.format(h=DIST) + ' AS k0')}, {system_sql('m', NUGGET, ['0', 'p.k0', '0'], [('1', ['0', '0', '1'])])}, {solved_sql('s')}"


@query(f"WITH RECURSIVE {FACTORS} SELECT m.k, part, round(sum(w[i][j] * z), 6) + 0.0::DOUBLE AS zk FROM m JOIN solved ON m.k = solved.k CROSS JOIN (VALUES (1, '0:nuggetC'), (2, '1:exponentialC'), (3, 'mean')) parts(j, part) GROUP BY m.k, part", "targets pts_s")
def kriging_factorial(spark, sf):
    return rounded(kriging.factorial_kriging(targets(spark, sf), suppliers(spark, sf), [Structure("nuggetC", 1.0), *EXPONENTIAL], 8, 25.0))


LMC = [kriging.Coregion("exponentialC", (30.0,), ((8.0, 2.0), (2.0, 4.0))), kriging.Coregion("nuggetC", (), ((1.0, 0.0), (0.0, 0.5)))]


def two_variables(spark, sf):
    p = suppliers(spark, sf)
    return p.withColumn("var", F.lit(0)).unionByName(p.withColumns({"var": F.lit(1), "z": F.col("z") * 0.5 + 1, "id": F.col("id") + 1_000_000_000}))


SILLS = "CASE p.var + q.var WHEN 0 THEN 8 WHEN 1 THEN 2 ELSE 4 END"
TWO_VARIABLES = "points AS (SELECT id, x, y, z, 0 AS var FROM pts_s UNION ALL SELECT id + 1000000000, x, y, z * 0.5 + 1, 1 FROM pts_s)"
CO_NEAR = f"n AS (SELECT a.k, b.*, CASE b.var WHEN 0 THEN 8 ELSE 2 END * exp(-3 * {DIST} / 30) AS k0, row_number() OVER (PARTITION BY a.k, b.var ORDER BY {DIST}, b.id) + 5 * b.var AS i FROM targets a JOIN points b ON {DIST} <= 25), m0 AS (SELECT * FROM n WHERE i - 5 * var <= 5), m AS (SELECT * REPLACE (row_number() OVER (PARTITION BY k ORDER BY i) AS i) FROM m0)"
CO_COV = f"{SILLS} * exp(-3 * {PQ} / 30) + CASE WHEN p.var = q.var AND p.x = q.x AND p.y = q.y THEN CASE p.var WHEN 0 THEN 1 ELSE 0.5 END ELSE 0 END"
CO_SYSTEM = f"{TWO_VARIABLES}, {CO_NEAR}, {system_sql('m', CO_COV, ['p.k0'], [('1 - p.var', ['1']), ('p.var', ['0'])])}, {solved_sql('s')}"


@query(f"WITH RECURSIVE {CO_SYSTEM}, o AS (SELECT m.k, sum(w[i][1] * z) AS zk, 9 - sum(w[i][1] * k0) - any_value(w[len(w) - 1][1]) AS vk FROM m JOIN solved ON m.k = solved.k GROUP BY m.k) SELECT k, round(zk, 6) + 0.0::DOUBLE AS zk, round(vk, 6) + 0.0::DOUBLE AS vk FROM targets LEFT JOIN o USING (k)", "targets pts_s")
def cokriging(spark, sf):
    return rounded(kriging.cokriging(targets(spark, sf), two_variables(spark, sf), LMC, 5, 25.0))


@query()
def cokriging_transformed(spark, sf):
    scores = [normalscore.fit(two_variables(spark, sf).where(F.col("var") == v)) for v in (0, 1)]
    return rounded(kriging.cokriging_transformed(targets(spark, sf), two_variables(spark, sf), [kriging.Coregion("exponentialC", (30.0,), ((1.0, 0.5), (0.5, 1.0)))], 5, 25.0, scores))


@query(f"WITH {TWO}, w AS ({SIMPLE}) SELECT k, round(a * z1 + b * z2, 6) + 0.0::DOUBLE AS mean, round(8 - a * k1 - b * k2, 6) + 0.0::DOUBLE AS var, 0.0::DOUBLE AS skew FROM w UNION ALL SELECT k, round(k1 / 8 * z, 6) + 0.0::DOUBLE, round(8 - k1 * k1 / 8, 6), 0 FROM one UNION ALL SELECT k, 0, 8, 0 FROM targets WHERE k NOT IN (SELECT k FROM n)", "targets pts_s")
def bme_hard_only_two(spark, sf):
    """Hard data alone: conditioning of a normal, as simple kriging."""
    return rounded(bme.bme_moments(targets(spark, sf), suppliers(spark, sf), None, EXPONENTIAL, 2, 0, 25.0))


def gaussian_soft(spark, sf):
    return binding(spark, sf, "soft").select("id", "x", "y", F.struct(F.lit(10).alias("type"), (F.col("m") / 5).alias("mean"), F.pow("w", 2.0).alias("var")).alias("soft"))


def interval_soft(spark, sf):
    return binding(spark, sf, "soft").select("id", "x", "y", soft.uniform(F.col("m") / 5 - F.col("w"), F.col("m") / 5 + F.col("w")).alias("soft"))


def distinct_targets(spark, sf):
    return suppliers(spark, sf).select(F.col("id").alias("k"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"))


@query(f"WITH n AS (SELECT a.id AS k, b.id, b.m / 5 AS m, pow(b.w, 2) AS v, {DIST.replace('a.x', '(a.x + 0.5)').replace('a.y', '(a.y + 0.25)')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST.replace('a.x', '(a.x + 0.5)').replace('a.y', '(a.y + 0.25)')}, b.id) AS place FROM pts_s a JOIN soft b ON {DIST.replace('a.x', '(a.x + 0.5)').replace('a.y', '(a.y + 0.25)')} <= 20), o AS (SELECT k, m, v, {C.format(h='d')} AS c FROM n WHERE place = 1) SELECT k, round(c / (8 + v) * m, 6) AS mean, round(8 - c * c / (8 + v), 6) AS var, 0.0::DOUBLE AS skew FROM o", "pts_s soft")
def bme_gaussian_soft_one(spark, sf):
    """One Gaussian soft datum: its variance is added to its own covariance."""
    return rounded(bme.bme_moments(distinct_targets(spark, sf), None, gaussian_soft(spark, sf), EXPONENTIAL, 0, 1, 20.0))


BME_NEAR = (
    f"own AS (SELECT id AS k, x + 0.5 AS x, y + 0.25 AS y FROM pts_s), hn AS (SELECT a.k, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.k ORDER BY {DIST}, b.id) AS i, {C.format(h=DIST)} AS k0 FROM own a JOIN pts_s b ON {DIST} <= 20), "
    f"sn AS (SELECT a.k, b.x, b.y, b.m / 5 AS z, b.w * b.w AS v, row_number() OVER (PARTITION BY a.k ORDER BY {DIST}, b.id) AS i, {C.format(h=DIST)} AS k0 FROM own a JOIN soft b ON {DIST} <= 20), "
    "h AS (SELECT * FROM hn WHERE i <= 6), f AS (SELECT * FROM sn WHERE i <= 4), "
    "mean AS (SELECT k, avg(z) AS mu FROM (SELECT k, z FROM h UNION ALL SELECT k, z FROM f) GROUP BY k)"
)
#: Soft data given the hard ones: what each is expected to be, and its variance.
BME_FIRST = (
    "hs AS (SELECT p.k, p.i, f.i AS j, " + C.format(h="sqrt(pow(p.x - f.x, 2) + pow(p.y - f.y, 2))") + " AS c FROM h p JOIN f ON p.k = f.k), "
    "hm AS (SELECT h.*, r.c1 FROM h LEFT JOIN (SELECT k, i, list(c ORDER BY j) AS c1 FROM hs GROUP BY k, i) r ON h.k = r.k AND h.i = r.i), "
    f"e1 AS (SELECT p.k, p.i, list(({C.format(h=PQ)})::DOUBLE ORDER BY q.i) || any_value(p.c1) AS c FROM hm p JOIN hm q ON p.k = q.k WHERE p.c1 IS NOT NULL GROUP BY p.k, p.i), s1 AS (SELECT k, list(c ORDER BY i) AS a FROM e1 GROUP BY k), "
    + solved_sql("s1").replace("g AS", "g1 AS").replace("FROM g)", "FROM g1)").replace("FROM g ", "FROM g1 ").replace("solved AS", "solved1 AS")
    + ", given AS (SELECT hs.k, hs.j, sum(w[hs.i][hs.j] * (h.z - mu)) AS up, sum(w[hs.i][hs.j] * c) AS less FROM hs JOIN h ON hs.k = h.k AND hs.i = h.i JOIN solved1 ON hs.k = solved1.k JOIN mean ON hs.k = mean.k GROUP BY hs.k, hs.j), "
    "gate AS (SELECT f.*, abs(mu + coalesce(up, 0) - f.z) AS gap, sqrt(greatest(8 - coalesce(less, 0), 0)) + sqrt(f.v) AS sd, up IS NOT NULL AS hard FROM f JOIN mean ON f.k = mean.k LEFT JOIN given ON f.k = given.k AND f.i = given.j), "
    "u AS (SELECT k, x, y, z, 0.0::DOUBLE AS v, k0, i FROM h UNION ALL SELECT k, x, y, z, CASE WHEN hard AND gap > 3 * sd THEN pow(gap / 3, 2) ELSE v END, k0, 100 + i FROM gate), m AS (SELECT * REPLACE (row_number() OVER (PARTITION BY k ORDER BY i) AS i) FROM u)"
)
BME_BOTH = f"{BME_NEAR}, {BME_FIRST}, {system_sql('m', C.format(h=PQ) + ' + CASE WHEN p.i = q.i THEN p.v ELSE 0 END', ['p.k0'], [])}, {solved_sql('s')}"


@query(f"WITH RECURSIVE {BME_BOTH}, o AS (SELECT m.k, any_value(mu) + sum(w[i][1] * (z - mu)) AS mean, 8 - sum(w[i][1] * k0) AS var FROM m JOIN solved ON m.k = solved.k JOIN mean ON m.k = mean.k GROUP BY m.k) SELECT own.k, round(coalesce(mean, 0), 6) + 0.0::DOUBLE AS mean, round(coalesce(var, 8), 6) + 0.0::DOUBLE AS var, 0.0::DOUBLE AS skew FROM own LEFT JOIN o ON own.k = o.k", "pts_s soft")
def bme_gaussian(spark, sf):
    return rounded(bme.bme_moments(distinct_targets(spark, sf), suppliers(spark, sf), gaussian_soft(spark, sf), EXPONENTIAL, 6, 4, 20.0, order=0))


@query()
def bme_interval_moments(spark, sf):
    return rounded(bme.bme_moments(distinct_targets(spark, sf), suppliers(spark, sf), interval_soft(spark, sf), EXPONENTIAL, 6, 3, 20.0, order=0))


@query()
def bme_pdf(spark, sf):
    return rounded(bme.bme_pdf(distinct_targets(spark, sf), suppliers(spark, sf), interval_soft(spark, sf), EXPONENTIAL, 6, 2, 20.0, nodes=60))


@query()
def bme_mode(spark, sf):
    return rounded(bme.bme_mode(distinct_targets(spark, sf), suppliers(spark, sf), interval_soft(spark, sf), EXPONENTIAL, 6, 2, 20.0))


@query()
def bme_ci(spark, sf):
    return rounded(bme.bme_intervals(distinct_targets(spark, sf), suppliers(spark, sf), interval_soft(spark, sf), EXPONENTIAL, 6, 2, 20.0, levels=(0.68, 0.95)))


@query()
def bme_quantiles(spark, sf):
    return rounded(bme.bme_quantiles(distinct_targets(spark, sf), suppliers(spark, sf), interval_soft(spark, sf), EXPONENTIAL, 6, 2, 20.0))


@query()
def bme_transformed(spark, sf):
    score = normalscore.fit(suppliers(spark, sf))
    return rounded(bme.bme_transformed(distinct_targets(spark, sf), suppliers(spark, sf), None, [Structure("exponentialC", 1.0, (30.0,))], 6, 0, 20.0, score))


# soft data

IV = "(m - w) AS lo, (m + w) AS hi"


@query(f"SELECT id, round(lo, 6) AS lo, round(hi, 6) AS hi, round(1 / (hi - lo), 6) AS dens, round((lo + hi) / 2, 6) AS mean, round(pow(hi - lo, 2) / 12, 6) AS var FROM (SELECT id, {IV} FROM soft)", "soft")
def soft_uniform(spark, sf):
    s = binding(spark, sf, "soft").select("id", soft.uniform(F.col("m") - F.col("w"), F.col("m") + F.col("w")).alias("s"))
    m, v = soft.moments(F.col("s"))
    lo, hi = soft.interval(F.col("s"))
    return rounded(s.select("id", lo.alias("lo"), hi.alias("hi"), F.col("s.probdens")[0].alias("dens"), m.alias("mean"), v.alias("var")))


NODE_ROWS = ", ".join(f"({i}, {z!r}::DOUBLE)" for i, z in enumerate(soft.NODES))


@query(f"WITH z(i, z) AS (VALUES {NODE_ROWS}), f AS (SELECT id, i, m + w * z AS x, exp(-z * z / 2) / w AS p FROM soft CROSS JOIN z), a AS (SELECT id, sum((x1 - x) * (p + p1) / 2) AS area FROM (SELECT id, x, p, lead(x) OVER q AS x1, lead(p) OVER q AS p1 FROM f WINDOW q AS (PARTITION BY id ORDER BY i)) WHERE x1 IS NOT NULL GROUP BY id) SELECT f.id, i, round(x, 6) AS x, round(p / area, 6) AS p FROM f JOIN a USING (id)", "soft")
def soft_gaussian_nodes(spark, sf):
    s = binding(spark, sf, "soft").select("id", soft.gaussian(F.col("m"), F.pow("w", 2.0)).alias("s"))
    return rounded(s.select("id", F.posexplode(F.arrays_zip("s.limi", "s.probdens")).alias("i", "n")).select("id", "i", F.col("n.limi").alias("x"), F.col("n.probdens").alias("p")))


TRIANGLE = "SELECT id, m - w AS a, m AS b, m + 2 * w AS c, w FROM soft"


def triangle(spark, sf):
    m, w = F.col("m"), F.col("w")
    limi, dens = F.array(m - w, m, m + w * 2), F.array(F.lit(0.0), 2 / (w * 3), F.lit(0.0))
    return binding(spark, sf, "soft").select("id", "x", "y", "m", "w", F.struct(F.lit(2).alias("type"), F.lit(3).alias("nl"), limi.alias("limi"), dens.alias("probdens")).alias("soft"))


@query(f"SELECT id, round((a + b + c) / 3, 6) AS mean, round((a * a + b * b + c * c - a * b - a * c - b * c) / 18, 6) + 0.0::DOUBLE AS var FROM ({TRIANGLE})", "soft")
def soft_stats(spark, sf):
    """Triangular densities: mean and variance in closed form."""
    mean, var = soft.moments(F.col("soft"))
    return rounded(triangle(spark, sf).select("id", mean.alias("mean"), var.alias("var")))


@query(f"SELECT id, round(a + (b - a) * 0.25 * 3, 6) AS q25, round(b + (c - b) * (0.75 - 1 / 3.0::DOUBLE) / (2 / 3.0::DOUBLE), 6) AS q75 FROM ({TRIANGLE})", "soft")
def soft_quantiles(spark, sf):
    return rounded(triangle(spark, sf).select("id", soft.quantile(F.col("soft"), 0.25).alias("q25"), soft.quantile(F.col("soft"), 0.75).alias("q75")))


@query(f"SELECT id, round(2 / (3 * w) * (1 - (0.5 * w) / (c - b)), 6) AS p, 0.0::DOUBLE AS outside FROM ({TRIANGLE})", "soft")
def soft_density_at(spark, sf):
    return rounded(triangle(spark, sf).select("id", soft.density_at(F.col("soft"), F.col("m") + F.col("w") / 2).alias("p"), soft.density_at(F.col("soft"), F.col("m") + F.col("w") * 3).alias("outside")))


@query(f"SELECT id, round(a + 5, 6) AS lo, round(c + 5, 6) AS hi FROM ({TRIANGLE})", "soft")
def soft_offset(spark, sf):
    lo, hi = soft.interval(soft.offset(F.col("soft"), 5.0))
    return rounded(triangle(spark, sf).select("id", lo.alias("lo"), hi.alias("hi")))


@query("SELECT CASE WHEN w > 2.5 THEN 1 ELSE 0 END AS part, count(*) AS n, sum(id)::BIGINT AS ids FROM soft GROUP BY 1", "soft")
def soft_split(spark, sf):
    s = triangle(spark, sf)
    one, two = soft.split(s, s.where("w > 2.5").select("id"))
    both = soft.concat(one.withColumn("part", F.lit(1)), two.withColumn("part", F.lit(0)))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT id, round(m + 0.5 - w, 6) AS lo, round(m + w, 6) AS hi, round(1 / (2 * w), 6) AS dens FROM soft WHERE 2 * w - 0.5 > 0.1", "soft")
def soft_combine_mult(spark, sf):
    """Two intervals at one place: their product is flat on the overlap, with linear flanks to the outer nodes."""
    s = binding(spark, sf, "soft")
    m, w = F.col("m"), F.col("w")
    both = s.select(F.col("id").alias("x"), F.lit(0.0).alias("y"), soft.uniform(m - w, m + w).alias("soft")).unionByName(s.select(F.col("id").alias("x"), F.lit(0.0).alias("y"), soft.uniform(m + 0.5 - w, m + 0.5 + w).alias("soft")))
    rows = soft.combine_collocated(both).join(s.select(F.col("id").alias("x"), "m", "w"), "x").where("2 * w - 0.5 > 0.1")
    inside = soft.density_at(F.col("soft"), m + 0.25)
    support = F.filter(F.arrays_zip("soft.limi", "soft.probdens"), lambda n: n["probdens"] > 0)["limi"]
    return rounded(rows.select(F.col("x").alias("id"), F.array_min(support).alias("lo"), F.array_max(support).alias("hi"), inside.alias("dens")))


@query("WITH q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS f, unnest(quantile_cont(z, [0.05, 0.25, 0.5, 0.75, 0.95])) AS y FROM pts_c) SELECT round(y, 6) + 0.0::DOUBLE AS y, f FROM q", "pts_c")
def nst_cdf_table(spark, sf):
    table = customers(spark, sf).agg(F.percentile("z", F.array(*map(F.lit, [0.05, 0.25, 0.5, 0.75, 0.95]))).alias("q"))
    return rounded(table.select(F.posexplode("q").alias("i", "y")).select("y", F.element_at(F.array(*map(F.lit, [0.05, 0.25, 0.5, 0.75, 0.95])), F.col("i") + 1).alias("f")))


@query()
def nst_forward(spark, sf):
    p = customers(spark, sf)
    return rounded(normalscore.transform_column(p.select("id", "z"), normalscore.fit(p), "z"))


# classes

MARGINAL = "m AS (SELECT ci AS cls, sum(p) AS p FROM tab WHERE bin = 0 GROUP BY ci)"
LOGS = f"q AS (SELECT k, id, d, cls AS seen FROM (SELECT a.k, b.id, b.cls, {DIST} AS d, row_number() OVER (PARTITION BY a.k ORDER BY {DIST}, b.id) AS place FROM targets a JOIN pts_c b ON {DIST} < 8) WHERE place <= 4), l AS (SELECT q.k, ci AS cls, count(*) AS n, sum(ln(greatest({VALUE}, 1e-10))) AS l FROM q JOIN parts ON cj = seen AND ((q.d >= d0 AND (d1 IS NULL OR q.d < d1)) OR (r = 1 AND q.d < d0)) GROUP BY q.k, ci)"


def class_model(spark, sf):
    t = ptable.ptable(customers(spark, sf), EDGES)
    return t, ptable.marginals(t)


@query(f"WITH {MODEL}, {MARGINAL}, {LOGS}, s AS (SELECT l.k, l.cls, ln(p) - n * ln(p) + l AS s FROM l JOIN m USING (cls)), e AS (SELECT k, cls, exp(s - max(s) OVER (PARTITION BY k)) AS e FROM s) SELECT k, cls, round(e / sum(e) OVER (PARTITION BY k), 6) AS p FROM e", "targets pts_c")
def mcp_posterior(spark, sf):
    model, marginal = class_model(spark, sf)
    return rounded(categorical.mcp(targets(spark, sf), customers(spark, sf), model, marginal, 4, 8.0))


@query(f"WITH {MODEL}, {LOGS}, e AS (SELECT k, cls, exp(l - max(l) OVER (PARTITION BY k)) AS e FROM l) SELECT k, cls, round(e / sum(e) OVER (PARTITION BY k), 6) AS p FROM e", "targets pts_c")
def maxent_mpl_hard(spark, sf):
    model, _ = class_model(spark, sf)
    return rounded(categorical.maxent_product(targets(spark, sf), customers(spark, sf), model, 4, 8.0))


LOO = LOGS.replace("FROM targets a JOIN pts_c b ON", "FROM (SELECT id AS k, x, y FROM pts_c) a JOIN pts_c b ON a.k <> b.id AND")


@query(f"WITH {MODEL}, {MARGINAL}, {LOO}, s AS (SELECT l.k, l.cls, ln(p) - n * ln(p) + l AS s FROM l JOIN m USING (cls)), e AS (SELECT k, cls, exp(s - max(s) OVER (PARTITION BY k)) AS e FROM s), p AS (SELECT k, cls, e / sum(e) OVER (PARTITION BY k) AS p FROM e) SELECT count(*) AS n, round(avg(ln(greatest(p.p, 1e-15))), 6) AS mean_log_likelihood FROM p JOIN pts_c c ON c.id = p.k AND c.cls = p.cls", "pts_c")
def mcp_loocv(spark, sf):
    """Each point from the others: mean log probability of its class."""
    model, marginal = class_model(spark, sf)
    own = customers(spark, sf).select(F.col("id").alias("k"), "x", "y")
    post = categorical.mcp(own, customers(spark, sf), model, marginal, 4, 8.0, exclude_own=True)
    hit = post.join(customers(spark, sf).select(F.col("id").alias("k"), "cls"), ["k", "cls"])
    return rounded(hit.agg(F.count("*").alias("n"), F.avg(F.log(F.greatest("p", F.lit(1e-15)))).alias("mean_log_likelihood")))


def labelled(spark, sf):
    return customers(spark, sf).withColumn("ps", ptable.one_hot(F.col("cls"), CLASSES))


@query()
def bme_categorical(spark, sf):
    model, _ = class_model(spark, sf)
    return categorical.bme_cat(distinct_targets(spark, sf), labelled(spark, sf), model, CLASSES, 3, 8.0)


@query()
def maxent_dual(spark, sf):
    model, _ = class_model(spark, sf)
    return categorical.bme_cat(distinct_targets(spark, sf), labelled(spark, sf), model, CLASSES, 2, 8.0, estimator="ME_dual")


@query()
def hbme(spark, sf):
    model, marginal = class_model(spark, sf)
    return categorical.hbme_cat(distinct_targets(spark, sf), labelled(spark, sf), model, marginal, CLASSES, 2, 6.0, 15.0, 10)


@query(f"WITH cells AS (SELECT x, y, count(*) AS n, {', '.join(f'avg((cls = {chr(39)}{c}{chr(39)})::INT) AS c{i}' for i, c in enumerate(CLASSES))} FROM pts_c GROUP BY x, y), n AS (SELECT a.k, exp(-0.5 * pow({DIST} / 5, 2)) AS w, b.* FROM targets a JOIN cells b ON {DIST} <= 20), s AS (SELECT k, sum(w) AS sw, {', '.join(f'sum(w * c{i}) AS s{i}' for i in range(5))} FROM n GROUP BY k) SELECT t.k, v.cls, round((coalesce(CASE v.i {' '.join(f'WHEN {i} THEN s{i}' for i in range(5))} END, 0) + 2 * 0.2) / (coalesce(sw, 0) + 2), 6) AS p FROM targets t LEFT JOIN s USING (k) CROSS JOIN (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(CLASSES))}) v(i, cls)", "targets pts_c")
def kernel_first_order(spark, sf):
    return rounded(categorical.kernel_first_order(targets(spark, sf), customers(spark, sf), REFERENCE, 5.0, 20.0))


@query()
def feature_prior(spark, sf):
    p = customers(spark, sf)
    return categorical.feature_prior(targets(spark, sf), p, ["x", "y"], CLASSES, trees=5, depth=3).select("k", "prior")


# metrics


def evals(spark, sf):
    return binding(spark, sf, "evals")


@query("SELECT y_true, y_pred, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY y_true))::DOUBLE, 6) AS share FROM evals GROUP BY y_true, y_pred", "evals")
def confusion_matrix(spark, sf):
    return rounded(evaluate.confusion_matrix(evals(spark, sf)))


REPORT = "r AS (SELECT cls, coalesce(tp / nullif(pr, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(su, 0)::DOUBLE, 0) AS recall, su AS support FROM (SELECT cls, sum((t = 1 AND hit)::INT) AS tp, sum(t) AS su, sum(p) AS pr FROM (SELECT y_true AS cls, 1 AS t, 0 AS p, y_true = y_pred AS hit FROM evals UNION ALL SELECT y_pred, 0, 1, FALSE FROM evals) GROUP BY cls)), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"


@query(f"WITH {REPORT} SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f", "evals")
def classification_report(spark, sf):
    return rounded(evaluate.classification_report(evals(spark, sf)))


@query(f"WITH {REPORT} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f", "evals")
def report_averages(spark, sf):
    return rounded(evaluate.report_averages(evaluate.classification_report(evals(spark, sf))))


@query("SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT avg((y_true = y_pred)::INT) AS r FROM evals GROUP BY y_true)", "evals")
def balanced_accuracy(spark, sf):
    return rounded(evaluate.balanced_accuracy(evals(spark, sf)))


def probable(spark, sf):
    return evals(spark, sf).withColumn("p", F.array(1 - F.col("p1"), F.col("p1")))


@query("SELECT round(avg(2 * pow(p1 - y_true, 2)), 6) AS brier FROM evals", "evals")
def brier(spark, sf):
    return rounded(evaluate.brier_score(probable(spark, sf), [0, 1]))


@query("SELECT round(avg(ln(greatest(CASE WHEN y_true = 1 THEN p1 ELSE 1 - p1 END, 1e-15))), 6) AS mean_log_likelihood FROM evals", "evals")
def mean_loglik(spark, sf):
    return rounded(evaluate.mean_log_likelihood(probable(spark, sf), [0, 1]))


@query("SELECT id, CASE WHEN (1 - p1) / pow(0.2, 0.7) >= p1 / pow(0.8, 0.7) THEN 0 ELSE 1 END AS cls FROM evals", "evals")
def tempered_map(spark, sf):
    return probable(spark, sf).select("id", evaluate.tempered_class([0, 1], [0.2, 0.8], 0.7).alias("cls"))


@query("WITH t AS (SELECT (i * 0.25)::DOUBLE AS tau FROM range(5) r(i)), p AS (SELECT tau, y_true, CASE WHEN (1 - p1) / pow(0.2, tau) >= p1 / pow(0.8, tau) THEN 0 ELSE 1 END AS y FROM evals CROSS JOIN t) SELECT tau, round(avg(r), 6) AS balanced_accuracy FROM (SELECT tau, y_true, avg((y = y_true)::INT) AS r FROM p GROUP BY 1, 2) GROUP BY tau", "evals")
def tau_search(spark, sf):
    return rounded(evaluate.tune_temper(probable(spark, sf), [0, 1], [0.2, 0.8], [0.25 * i for i in range(5)]))


@query("WITH a AS (SELECT id, ROUND(atan2(y - (SELECT avg(y) FROM pts_s), x - (SELECT avg(x) FROM pts_s)), 9) AS a FROM pts_s) SELECT id, place::INTEGER AS place FROM (SELECT id, row_number() OVER (ORDER BY a, id) - 1 AS place FROM a) WHERE place % 3 = 0", "pts_s")
def loocv_station_order(spark, sf):
    return evaluate.loocv_stations(suppliers(spark, sf), 3)


# outliers

Z = "SELECT site, t, z, (z - avg(z) OVER w) / coalesce(nullif(stddev_samp(z) OVER w, 0), 1) AS zs FROM grid WINDOW w AS (PARTITION BY site)"


@query(f"SELECT site, t, round(zs, 6) + 0.0::DOUBLE AS zscore FROM ({Z})", "grid")
def zscore_by_site(spark, sf):
    return rounded(outlier.zscores(binding(spark, sf, "grid")).select("site", "t", "zscore"))


def spatial_sql(source: str, radius: float, nmax: int, k: float) -> str:
    return f"n AS (SELECT a.id, a.z AS own, b.z, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS place FROM {source} a JOIN {source} b ON {DIST} <= {radius}), s AS (SELECT id, count(*) AS n, stddev_pop(z) AS sd, sum(CASE WHEN d > 0 THEN z / pow(d, 1.5) ELSE 0 END) AS wz, sum(CASE WHEN d > 0 THEN 1 / pow(d, 1.5) ELSE 0 END) AS sw, any_value(own) AS own FROM n WHERE place <= {nmax} GROUP BY id), o AS (SELECT id, n, CASE WHEN sw = 0 THEN FALSE ELSE abs(own - wz / sw) > {k} * sd END AS outlier FROM s)"


@query(f"WITH {spatial_sql('pts_c', 10, 30, 1.5)} SELECT id, n, outlier FROM o", "pts_c")
def outlier_spatial(spark, sf):
    return outlier.spatial_outliers(customers(spark, sf), 10.0, 30, k=1.5)


@query("WITH b AS (SELECT site, t, z, floor(t / 2) AS b FROM grid), s AS (SELECT b, count(z) AS n, sum(z) AS s, sum(z * z) AS q FROM b GROUP BY b), w AS (SELECT b, sum(n) OVER v AS n, sum(s) OVER v AS s, sum(q) OVER v AS q FROM s WINDOW v AS (ORDER BY b RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT site, t, abs(z - s / n) > 2 * sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS outlier FROM b JOIN w USING (b)", "grid")
def outlier_time_window(spark, sf):
    return outlier.window_outliers(binding(spark, sf, "grid").select("site", "t", "z"), 2.0, 6.0, 2.0).select("site", "t", "outlier")


@query("WITH b AS (SELECT site, t, x, y, z, floor(t / 1) AS b FROM grid), s AS (SELECT site, b, count(z) AS n, sum(z) AS s, sum(z * z) AS q FROM b GROUP BY site, b), w AS (SELECT site, b, sum(n) OVER v AS n, sum(s) OVER v AS s, sum(q) OVER v AS q FROM s WINDOW v AS (PARTITION BY site ORDER BY b RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)), tm AS (SELECT site, t, abs(z - s / n) > 1.5 * sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS o FROM b JOIN w USING (site, b)), n AS (SELECT a.site, a.t, a.z AS own, c.z, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) AS d, row_number() OVER (PARTITION BY a.site, a.t ORDER BY sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)), c.site) AS place FROM grid a JOIN grid c ON a.t = c.t AND sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) <= 8), p AS (SELECT site, t, stddev_pop(z) AS sd, sum(CASE WHEN d > 0 THEN z / pow(d, 1.5) ELSE 0 END) AS wz, sum(CASE WHEN d > 0 THEN 1 / pow(d, 1.5) ELSE 0 END) AS sw, any_value(own) AS own FROM n WHERE place <= 20 GROUP BY site, t) SELECT tm.site, tm.t, (o AND CASE WHEN sw = 0 THEN FALSE ELSE abs(own - wz / sw) > 1.5 * sd END) AS outlier FROM tm JOIN p USING (site, t)", "grid")
def outlier_spacetime(spark, sf):
    return outlier.spacetime_outliers(binding(spark, sf, "grid"), 8.0, 20, 1.0, 10.0, 1.5)


@query()
def outlier_sequential(spark, sf):
    return outlier.sequential_outliers(binding(spark, sf, "grid").select("site", "t", "z"), 2.0, 6.0, k=2.0).select("site", "t", "outlier")


# analysis


@query("WITH c AS (SELECT event_type, dayofweek(ts) AS d, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2) SELECT round(-sum(n / s * ln(n / s)), 6) AS h FROM c CROSS JOIN (SELECT sum(n) AS s FROM c) t")
def entropy_discrete(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(entropy.entropy(events.select("event_type", F.dayofweek("ts").alias("d")), ["event_type", "d"]))


BINS = "CASE WHEN {v} = hi THEN {n} - 1 ELSE floor(({v} - lo) / (hi - lo) * {n}) END"


@query(f"WITH b AS (SELECT {BINS.format(v='z', n=10)} AS b FROM pts_c CROSS JOIN (SELECT min(z) AS lo, max(z) AS hi FROM pts_c) e), c AS (SELECT count(*)::DOUBLE AS n FROM b GROUP BY b) SELECT round(-sum(n / s * ln(n / s)), 6) AS h FROM c CROSS JOIN (SELECT sum(n) AS s FROM c) t", "pts_c")
def entropy_binned(spark, sf):
    return rounded(entropy.entropy_binned(customers(spark, sf), ["z"]))


@query(f"WITH b AS (SELECT {BINS.format(v='z', n=8)} AS b, x FROM pts_c CROSS JOIN (SELECT min(z) AS lo, max(z) AS hi FROM pts_c) e), d AS (SELECT b, {BINS.format(v='x', n=8)} AS a FROM b CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM pts_c) e), j AS (SELECT a, b, count(*)::DOUBLE / (SELECT count(*) FROM pts_c) AS p FROM d GROUP BY a, b), h AS (SELECT (SELECT -sum(p * ln(p)) FROM j) AS hxy, (SELECT -sum(p * ln(p)) FROM (SELECT sum(p) AS p FROM j GROUP BY a)) AS hx, (SELECT -sum(p * ln(p)) FROM (SELECT sum(p) AS p FROM j GROUP BY b)) AS hy) SELECT round(hxy - hx, 6) AS h_y_given_x, round(hy - hxy + hx, 6) + 0.0::DOUBLE AS information FROM h", "pts_c")
def conditional_entropy(spark, sf):
    return rounded(entropy.conditional_entropy(customers(spark, sf), "z", "x", 8))


@query(f"SELECT ({BINS.format(v='z', n=10)})::INTEGER AS bin, count(*) AS n FROM pts_c CROSS JOIN (SELECT min(z) AS lo, max(z) AS hi FROM pts_c) e GROUP BY 1", "pts_c")
def histogram(spark, sf):
    return entropy.histogram(customers(spark, sf), "z")


@query("SELECT z AS value, round(max(f), 9) AS f FROM (SELECT z, cume_dist() OVER (ORDER BY z) AS f FROM pts_c) GROUP BY z", "pts_c")
def ecdf(spark, sf):
    return entropy.ecdf(customers(spark, sf), "z").select("value", r(F.col("f"), 9).alias("f"))


def field(spark, sf):
    return binding(spark, sf, "field")


@query("SELECT a.c AS i, b.c AS j, round(sum(a.v * b.v), 4) + 0.0::DOUBLE AS g FROM field a JOIN field b ON a.r = b.r AND a.c <= b.c GROUP BY a.c, b.c", "field")
def gram_matrix(spark, sf):
    return rounded(multivariate.gram(field(spark, sf)), 4)


@query("SELECT a.c AS i, b.c - 32 AS j, round(sum(a.v * b.v), 4) + 0.0::DOUBLE AS g FROM field a JOIN field b ON a.r = b.r AND a.c < 32 AND b.c >= 32 GROUP BY a.c, b.c", "field")
def cross_gram(spark, sf):
    f = field(spark, sf)
    return rounded(multivariate.gram(f.where("c < 32"), f.where("c >= 32").withColumn("c", F.col("c") - 32)), 4)


@query("SELECT a.c AS i, b.c AS j, round(covar_samp(a.v, b.v), 6) + 0.0::DOUBLE AS cov FROM field a JOIN field b ON a.r = b.r AND a.c <= b.c GROUP BY a.c, b.c", "field")
def pca_covariance(spark, sf):
    return rounded(multivariate.covariance(field(spark, sf)))


@query("WITH m AS (SELECT avg(z) AS m FROM pts_c) SELECT round(any_value(m), 6) AS m1, round(avg(pow(z - m, 2)), 6) AS m2, round(avg(pow(z - m, 3)), 4) AS m3, round(avg(pow(z - m, 4)), 4) AS m4 FROM pts_c CROSS JOIN m", "pts_c")
def moments_order4(spark, sf):
    m = multivariate.moments(customers(spark, sf), "z")
    return m.select(r(F.col("m1")).alias("m1"), r(F.col("m2")).alias("m2"), r(F.col("m3"), 4).alias("m3"), r(F.col("m4"), 4).alias("m4"))


@query("SELECT c % 8 AS r, r * 8 + c // 8 AS c, round(v, 6) + 0.0::DOUBLE AS v FROM field".replace("r * 8 + c // 8", "r + (SELECT max(r) + 1 FROM field) * (c // 8)"), "field")
def unfold_mode2(spark, sf):
    """The field as a rows × 8 × 8 tensor, unfolded along its second mode."""
    f = field(spark, sf)
    n = f.agg(F.max("r")).first()[0] + 1
    t = f.select(F.col("r").alias("i0"), (F.col("c") % 8).alias("i1"), F.floor(F.col("c") / 8).alias("i2"), "v")
    return rounded(multivariate.unfold(t, [n, 8, 8], 1))


@query("SELECT r, c, round(v, 6) + 0.0::DOUBLE AS v FROM field", "field")
def unfold_fold(spark, sf):
    """Unfolding along the third mode and folding back."""
    f = field(spark, sf)
    n = f.agg(F.max("r")).first()[0] + 1
    t = f.select(F.col("r").alias("i0"), (F.col("c") % 8).alias("i1"), F.floor(F.col("c") / 8).alias("i2"), "v")
    back = multivariate.fold(multivariate.unfold(t, [n, 8, 8], 2), [n, 8, 8], 2)
    return rounded(back.select(F.col("i0").alias("r"), (F.col("i2") * 8 + F.col("i1")).alias("c"), "v"))


@query("WITH RECURSIVE s AS (SELECT site, z, row_number() OVER (PARTITION BY site ORDER BY t) AS i, t FROM grid), k AS (SELECT site, 0::BIGINT AS i, 0.0::DOUBLE AS t, 0.0::DOUBLE AS x, 10.0::DOUBLE AS p FROM (SELECT DISTINCT site FROM grid) UNION ALL SELECT s.site, s.i, s.t, k.x + (k.p + 0.1) / (k.p + 0.1 + 2.0) * (s.z - k.x), (1 - (k.p + 0.1) / (k.p + 0.1 + 2.0)) * (k.p + 0.1) FROM k JOIN s ON s.site = k.site AND s.i = k.i + 1) SELECT site, t, round(x, 6) + 0.0::DOUBLE AS xf, round(p, 6) AS pf FROM k WHERE i > 0", "grid")
def kalman_scalar(spark, sf):
    return rounded(multivariate.kalman_series(binding(spark, sf, "grid").select("site", "t", "z"), 0.1, 2.0, 0.0, 10.0).select("site", "t", "xf", "pf"))


@query()
def eof(spark, sf):
    values, _, _ = multivariate.eof(field(spark, sf), 10)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "mode int, variance double"), 5)


@query()
def mca(spark, sf):
    f = field(spark, sf)
    s, *_ = multivariate.mca(f.where("c < 32"), f.where("c >= 32").withColumn("c", F.col("c") - 32), 5)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "mode int, value double"), 5)


@query()
def stl_series(spark, sf):
    return rounded(series.decompose(binding(spark, sf, "grid").select("site", "t", "z"), 7).select("site", "t", "seasonal", "trend", "remainder"), 4)


@query()
def gam_fit(spark, sf):
    p = customers(spark, sf)
    return rounded(series.gam(p, "z", ["x", "y"], ["cls"])(p).select("id", "fit"), 4)


@query()
def covmodel_fit(spark, sf):
    """An exponential plus a nugget fitted to the empirical bins."""
    bins = dependence.stcov_spatial(customers(spark, sf), [(2.0 * i, 1.0) for i in range(10)]).toPandas()
    found, value = fitting.fit_covariance(bins, [Structure("nuggetC", 4.0), Structure("exponentialC", 4.0, (8.0,))])
    return rounded(spark.createDataFrame([(s.model, float(s.sill), float(s.space[0]) if s.space else 0.0, value) for s in found], "model string, sill double, range double, wls double"), 4)


@query()
def pmodel_fit(spark, sf):
    t = ptable.ptable(customers(spark, sf), [0.0, 1.5, 3.0, 4.5, 6.0, 8.0, 10.0]).toPandas()
    return rounded(spark.createDataFrame(fitting.fit_ptable(t, 20)), 5)


@query()
def homogeneous_regions(spark, sf):
    return regions.regions_from_features(customers(spark, sf), ["x", "y", "z"], 4)


def _nodes(spark, sf):
    return suppliers(spark, sf).orderBy("id").select("x", "y", "z").toPandas().to_numpy(float)


@query()
def simuchol(spark, sf):
    return rounded(simulate.simulate_cholesky(spark, _nodes(spark, sf)[:, :2] + 0.5, EXPONENTIAL, 20, seed=1), 5)


@query()
def simuseqcond(spark, sf):
    data = _nodes(spark, sf)
    grid = [(x + 0.5, y + 0.5) for x in range(0, 100, 20) for y in range(0, 100, 20)]
    import numpy as np

    return rounded(simulate.simulate_sequential(spark, np.array(grid), EXPONENTIAL, 8, 20.0, 5, seed=1, c0=data[:, :2], z0=data[:, 2]), 5)


