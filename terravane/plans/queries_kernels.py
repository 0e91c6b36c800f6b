"""Queries on fitted coregions, orthogonal bases, curves, files, regions, random fields and tuning."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions.covariance import Structure
from terravane.kernels import linear, qmc
from terravane.operators import categorical, dependence, fitting, multivariate, plots, regions, series, simulate
from terravane.plans.queries_dependence import CLASSES, DIST, EDGES, LAGS, lag_rows, shares_sql
from terravane.plans.queries_estimation import EXPONENTIAL, class_model, customers, field, suppliers
from terravane.plans.registry import query, rounded
from terravane.sources import tables
from terravane.sources.tables import binding

# coregionalisation of one exponential: a weighted least-squares matrix, made positive semi-definite

CROSS = f"p AS (SELECT id, x, y, z, z * z / 10 AS w FROM pts_c), q AS (SELECT {DIST} AS d, a.z * b.z AS zz, a.w * b.w AS ww, (a.z * b.w + b.z * a.w) / 2 AS zw, (a.z + b.z) / 2 AS u, (a.w + b.w) / 2 AS v FROM p a JOIN p b ON a.id <= b.id AND {DIST} <= 11), {lag_rows(LAGS)}, t AS (SELECT bin, lag, count(*) AS n, avg(zz) - avg(u) * avg(u) AS zz, avg(zw) - avg(u) * avg(v) AS zw, avg(ww) - avg(v) * avg(v) AS ww FROM q JOIN lags ON d BETWEEN lo AND hi GROUP BY bin, lag)"


@query(f"WITH {CROSS}, f AS (SELECT *, exp(-3 * lag / 5) AS g FROM t), s AS (SELECT sum(n * g * zz) / sum(n * g * g) AS a, sum(n * g * zw) / sum(n * g * g) AS b, sum(n * g * ww) / sum(n * g * g) AS d FROM f), l AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l1, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS l2 FROM s), c AS (SELECT *, CASE WHEN l2 >= 0 THEN 1 WHEN l1 > 0 THEN l1 / (l1 - l2) ELSE 0 END AS m, CASE WHEN l2 >= 0 THEN 0 ELSE l2 END AS o FROM l) SELECT round(m * (a - o), 5) + 0.0::DOUBLE AS zz, round(m * b, 5) + 0.0::DOUBLE AS zw, round(m * (d - o), 5) + 0.0::DOUBLE AS ww FROM c", "pts_c")
def coregion_fit(spark, sf):
    p = customers(spark, sf).withColumn("w", F.col("z") * F.col("z") / 10)
    tensor, n, lag = np.zeros((len(LAGS), 2, 2)), np.zeros(len(LAGS)), np.array([h for h, _ in LAGS])
    for i, j, one, two in ((0, 0, "z", "z"), (0, 1, "z", "w"), (1, 1, "w", "w")):
        for row in dependence.cross_covariance(p, LAGS, one, two).collect():  # a row a bin
            at = int(np.abs(lag - row["lag"]).argmin())
            tensor[at, i, j] = tensor[at, j, i] = row["cov"]
            n[at] = row["n"]
    has = n > 0
    sill = fitting.fit_coregion(lag[has], tensor[has], n[has], [("exponentialC", (5.0,))])[0]
    return rounded(spark.createDataFrame([(float(sill[0, 0]), float(sill[0, 1]), float(sill[1, 1]))], "zz double, zw double, ww double"), 5)


# orthogonal bases of the field's mean columns


def mean_rows(spark, sf) -> np.ndarray:
    """Two rows of eight: means of even and odd rows by remainder of the column."""
    out = np.zeros((2, 8))
    for row in field(spark, sf).groupBy((F.col("r") % 2).alias("i"), (F.col("c") % 8).alias("j")).agg(F.avg("v").alias("v")).collect():  # sixteen rows
        out[row["i"], row["j"]] = row["v"]
    return out


BASE = "b AS (SELECT c % 8 AS j, avg(CASE WHEN r % 2 = 0 THEN v END) AS u, avg(CASE WHEN r % 2 = 1 THEN v END) AS v FROM field GROUP BY c % 8)"


@query(f"WITH {BASE}, d AS (SELECT sum(u * v) / sum(u * u) AS k FROM b), o AS (SELECT j, u, v - k * u AS w FROM b CROSS JOIN d) SELECT j, round(u / sqrt(sum(u * u) OVER ()), 5) + 0.0::DOUBLE AS q0, round(w / sqrt(sum(w * w) OVER ()), 5) + 0.0::DOUBLE AS q1 FROM o", "field")
def gram_schmidt(spark, sf):
    q = linear.gram_schmidt(mean_rows(spark, sf))
    return rounded(spark.createDataFrame([(j, float(q[0, j]), float(q[1, j])) for j in range(8)], "j long, q0 double, q1 double"), 5)


@query(f"WITH {BASE}, d AS (SELECT sum((j + 1) * u * v) / sum((j + 1) * u * u) AS k FROM b), o AS (SELECT j, u, v - k * u AS w FROM b CROSS JOIN d) SELECT j, round(u / sqrt(sum((j + 1) * u * u) OVER ()), 5) + 0.0::DOUBLE AS q0, round(w / sqrt(sum((j + 1) * w * w) OVER ()), 5) + 0.0::DOUBLE AS q1 FROM o", "field")
def weighted_qr(spark, sf):
    """Columns orthonormal under the weights 1 to 8."""
    q, _ = linear.weighted_qr(mean_rows(spark, sf).T, np.arange(1, 9))
    return rounded(spark.createDataFrame([(j, float(q[j, 0]), float(q[j, 1])) for j in range(8)], "j long, q0 double, q1 double"), 5)


# curves and integrals


@query("SELECT theta, lag, round(8 * exp(-3 * lag / (30 * 0.5 / sqrt(0.25 * pow(cos(theta - 0.5), 2) + pow(sin(theta - 0.5), 2)))), 6) AS cov FROM (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS theta) CROSS JOIN (SELECT unnest([0.0, 5.0, 10.0, 20.0])::DOUBLE AS lag)")
def directional_curves(spark, sf):
    """A model of anisotropy 0.5 along 0.5 radians, in four directions."""
    return rounded(plots.directional_curves(spark, EXPONENTIAL, 0.5, 0.5, [0.0, 0.5, 1.0, 2.0], [0.0, 5.0, 10.0, 20.0]))


@query("SELECT round(avg(x) / 4 + avg(y) / 2, 1) AS total, round(pow(1 - exp(-1), 3), 2) AS decay FROM pts_c", "pts_c")
def cubature_box(spark, sf):
    """Integrals over the unit cube: a linear function of the points' means, and exp(-u - v - w)."""
    row = customers(spark, sf).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    mean, _, _ = qmc.cubature(lambda p: np.column_stack([row["x"] * p[:, 0] * p[:, 1] + row["y"] * p[:, 2], np.exp(-p.sum(axis=1))]), [0, 0, 0], [1, 1, 1], rel=1e-5, abs_=1e-5)
    out = spark.createDataFrame([(float(mean[0]), float(mean[1]))], "total double, decay double")
    return rounded(out.select("total"), 1).crossJoin(rounded(out.select("decay"), 2))


# files: written to the folder that executors share, and read again


def shared(spark: SparkSession, name: str) -> str:
    """A path of this application's in the shared folder; a temporary one in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terravane-")
    return f"{base.rstrip('/')}/terravane/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


@query("SELECT round(id::DOUBLE, 6) AS id, x, y, round(z, 6) + 0.0::DOUBLE AS z FROM pts_s", "pts_s")
def geoeas_round_trip(spark, sf):
    """Suppliers written as GeoEAS text and read."""
    path = shared(spark, "geoeas")
    tables.write_geoeas(suppliers(spark, sf).select(F.col("id").alias("row"), F.col("id").cast("double").alias("id"), "x", "y", "z"), path, "suppliers")
    return rounded(tables.read_geoeas(spark, path).drop("row"))


@query("SELECT round(m - w, 6) AS a, round(m, 6) AS b, round(m + 2 * w, 6) AS c, round(2 / (3 * w), 6) AS peak, 3::INTEGER AS nl FROM soft", "soft")
def soft_pdf_round_trip(spark, sf):
    """Triangular densities written as text and read."""
    path = shared(spark, "soft-pdf")
    m, w = F.col("m"), F.col("w")
    binding(spark, sf, "soft").select(F.concat_ws(", ", *(c.cast("string") for c in (F.lit(2), m - w, m, m + w * 2, F.lit(0.0), 2 / (w * 3), F.lit(0.0)))).alias("value")).write.text(path)
    s = tables.read_soft_pdf(spark, path)
    return rounded(s.select(F.col("soft.limi")[0].alias("a"), F.col("soft.limi")[1].alias("b"), F.col("soft.limi")[2].alias("c"), F.col("soft.probdens")[1].alias("peak"), F.col("soft.nl").alias("nl")))


# regions and class tables

STRIPS = "strips AS (SELECT *, floor(x / 53)::BIGINT AS region FROM pts_c)"


def strips(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = customers(spark, sf)
    return p, p.select("id", F.floor(F.col("x") / 53).alias("region"))


@query(f"WITH {STRIPS} SELECT region, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(sqrt(var_pop(x) + var_pop(y)), 6) AS s, count(*) AS n FROM strips GROUP BY region", "pts_c")
def regional_layout(spark, sf):
    """Centres, spreads and sizes of four strips."""
    return rounded(regions.regional_models(*strips(spark, sf), EDGES)[0])


REGIONAL = f"ordered AS (SELECT a.region, a.cls AS ci, b.cls AS cj, {DIST} AS d, CASE WHEN {DIST} = 0 THEN 0 WHEN {DIST} <= 2 THEN 1 WHEN {DIST} <= 4 THEN 2 ELSE 3 END AS bin FROM strips a JOIN strips b ON a.region = b.region AND {DIST} <= 8)"


@query(f"WITH {STRIPS}, {REGIONAL}, {shares_sql('ordered', 'region, bin')} SELECT region, bin, ci, cj, round(d, 6) + 0.0::DOUBLE AS d, n, round(p, 6) + 0.0::DOUBLE AS p FROM tab", "pts_c")
def regional_tables(spark, sf):
    """Class tables of each strip by itself."""
    return rounded(regions.regional_models(*strips(spark, sf), EDGES)[1])


SHARES = dict(zip(CLASSES, (0.3, 0.25, 0.2, 0.15, 0.1), strict=True))


@query(f"SELECT ci, round(p, 6) AS low, round(p, 6) AS high FROM (VALUES {', '.join(f'({c!r}, {p!r}::DOUBLE)' for c, p in SHARES.items())}) t(ci, p)")
def model_recentred(spark, sf):
    """Every distance of a class table gets the given class sums: the least and the largest over distances agree."""
    t, _ = class_model(spark, sf)
    fitted = categorical.recenter_distributed(t.select("ci", "cj", "d", F.greatest("p", F.lit(1e-4)).alias("p")), SHARES)
    sums = fitted.groupBy("d", "ci").agg(F.sum("p").alias("p"))
    return rounded(sums.groupBy("ci").agg(F.min("p").alias("low"), F.max("p").alias("high")))


@query()
def regions_of_tables(spark, sf):
    """Strips whose classes at no distance are alike are merged."""
    about, t = regions.regional_models(*strips(spark, sf), EDGES)
    pdf = t.where("bin = 0").orderBy("region", "ci", "cj").toPandas()  # strips times classes squared
    names = sorted(pdf["region"].unique())
    p = np.stack([pdf[pdf["region"] == n]["p"].to_numpy().reshape(len(CLASSES), -1) for n in names]) + 1e-6
    c = np.array([[row["x"], row["y"]] for row in about.orderBy("region").collect()])
    found = regions.regions_from_tables(c, p, n=2, least=1)
    return spark.createDataFrame([(int(n), int(v)) for n, v in zip(names, found, strict=True)], "region long, cluster int")


@query()
def class_bins_tuned(spark, sf):
    """Edges of class tables by leave-one-out likelihood, the best first."""
    found = categorical.tune_bins(customers(spark, sf), [(0.0, 2.0, 4.0, 8.0), (0.0, 4.0, 8.0)], 4, 8.0)
    return rounded(spark.createDataFrame([(i, len(e) - 1, v) for i, (e, v) in enumerate(found)], "place int, bins int, score double"))


@query()
def feature_prior_held_out(spark, sf):
    """Priors of every customer from a model without its strip."""
    p = customers(spark, sf).withColumn("station", F.floor(F.col("x") / 20))
    return categorical.feature_prior_loocv(p.withColumn("k", F.col("id")), ["x", "y", "z"], CLASSES, "station", folds=2, method="multinomial").select("id", F.posexplode("prior").alias("i", "p")).transform(rounded)


# isotropy


def cell_points(spark, sf) -> tuple[np.ndarray, np.ndarray]:
    """Places and means of the customers in cells 20 wide: 110 at most, whatever the table's size, as the tests and dense simulations are made for some hundreds of points."""
    cells = customers(spark, sf).groupBy(F.floor(F.col("x") / 20).alias("i"), F.floor(F.col("y") / 20).alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    a = np.array([(row["x"], row["y"], row["z"]) for row in cells.orderBy("i", "j").collect()], float)
    return a[:, :2], a[:, 2]


@query()
def isotropy_bootstrap(spark, sf):
    c, z = cell_points(spark, sf)
    found = regions.isotropy_test(spark, c, z, [20.0, 40.0, 60.0, 80.0], 10.0, [0.0, 0.785, 1.571, 2.356], 0.4, replicates=99)
    return rounded(spark.createDataFrame([(float(found["statistic"]), float(found["p_value"]))], "statistic double, p double"))


@query()
def isotropy_bootstrap_classes(spark, sf):
    c, z = cell_points(spark, sf)
    found = regions.isotropy_test_classes(spark, c, np.where(z > np.median(z), "high", "low"), [0.0, 30.0, 50.0, 80.0], [0.0, 0.785, 1.571, 2.356], 0.4, replicates=99)
    return rounded(spark.createDataFrame([(float(found["statistic"]), float(found["p_value"]))], "statistic double, p double"))


# random fields

CELLS = np.array([(x + 0.37, y + 0.61) for x in range(0, 200, 40) for y in range(0, 200, 40)], float)


@query()
def gaussian_process_grid(spark, sf):
    """Stationary fields on a 16 × 16 grid, by embedding in a torus."""
    return rounded(simulate.replicate(spark, 10, 1, lambda rng: simulate.circulant_field(16, 16, lambda dx, dy: 8 * np.exp(-np.hypot(dx, dy)), rng)[0].ravel()), 5)


@query()
def simulate_anisotropic(spark, sf):
    return rounded(simulate.simulate_cholesky(spark, CELLS, EXPONENTIAL, 10, seed=1, angle=30.0, ratio=0.5), 5)


@query()
def simulate_conditional(spark, sf):
    c, z = cell_points(spark, sf)
    return rounded(simulate.simulate_conditional(spark, CELLS, c, z, EXPONENTIAL, 10, seed=1), 5)


@query()
def simulate_conditional_errors(spark, sf):
    """Data with measurement errors, at the data's own places."""
    c, z = cell_points(spark, sf)
    return rounded(simulate.simulate_conditional(spark, c, c, z, EXPONENTIAL, 10, seed=1, noise=np.full(len(c), 0.5)), 5)


@query()
def simulate_sequential(spark, sf):
    return rounded(simulate.simulate_sequential(spark, CELLS, EXPONENTIAL, 8, 80.0, 5, seed=1), 5)


@query()
def simulate_sequential_errors(spark, sf):
    c, z = cell_points(spark, sf)
    return rounded(simulate.simulate_sequential(spark, CELLS, EXPONENTIAL, 6, 40.0, 3, seed=1, c0=c, z0=z, noise=np.full(len(c), 0.5)), 5)


@query()
def simulate_sequential_intervals(spark, sf):
    """Even cells are exact, odd ones known within 0.5."""
    c, z = cell_points(spark, sf)
    even = np.arange(len(c)) % 2 == 0
    return rounded(simulate.simulate_sequential(spark, CELLS, EXPONENTIAL, 4, 40.0, 2, seed=1, c0=c[even], z0=z[even], cs=c[~even], low=z[~even] - 0.5, high=z[~even] + 0.5), 5)


# fits and parts without a closed form


@query()
def likelihood_fit(spark, sf):
    """An exponential covariance by maximum likelihood of the cells' means."""
    c, z = cell_points(spark, sf)
    found, value = fitting.fit_likelihood(c, z - z.mean(), EXPONENTIAL)
    return rounded(spark.createDataFrame([(found[0].model, float(found[0].sill), float(found[0].space[0]), float(value))], "model string, sill double, range double, likelihood double"), 4)


@query()
def time_downscaled(spark, sf):
    """A daily covariance from that of ten-day means."""
    s = fitting.downscale_time(Structure("exponentialC/exponentialC", 2.0, (8.0,), (30.0,)), 10.0)
    return rounded(spark.createDataFrame([(s.model, float(s.sill), float(s.time[0]))], "model string, sill double, range double"), 4)


@query()
def trend_stl(spark, sf):
    return rounded(series.stl_mean(binding(spark, sf, "grid"), 7), 4)


@query()
def eof_classes(spark, sf):
    """Row means in two classes by a mixture of two normals."""
    return multivariate.eof_class(field(spark, sf).groupBy("r").agg(F.avg("v").alias("v"))).select("r", F.col("cls").cast("int").alias("cls"))
