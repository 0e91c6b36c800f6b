import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.functions.covariance import Structure, covariance_matrix
from terravane.operators import categorical, interpolate, ptable, regions


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    xy = rng.random((60, 2)) * 12
    cls = np.where(xy[:, 0] + rng.normal(0, 1.5, 60) > 6, "a", "b")
    pdf = pd.DataFrame({"id": np.arange(60), "x": xy[:, 0], "y": xy[:, 1], "cls": cls, "station": np.arange(60) // 10})
    return spark.createDataFrame(pdf).withColumn("ps", ptable.one_hot(F.col("cls"), ["a", "b"])), pdf


def test_class_isotropy(spark, points):
    pdf = points[1]
    out = regions.isotropy_test_classes(spark, pdf[["x", "y"]].to_numpy(), pdf.cls.to_numpy(), [0.0, 2.0, 4.0, 6.0, 9.0], [0.0, math.pi / 2], 0.6, replicates=19)
    assert out["statistic"] >= 0 and 0 < out["p_value"] <= 1


def test_symmetry():
    even = pd.DataFrame([(x, y, 50, math.exp(-abs(x) - abs(y))) for x in range(-3, 4) for y in range(-3, 4)], columns=["ix", "iy", "n", "cov"])
    assert regions.symmetry_test(even) == (pytest.approx(0), pytest.approx(1, abs=0.05))
    odd = even.assign(cov=np.exp(-abs(even.ix + even.iy)))
    assert regions.symmetry_test(odd)[1] < 0.01


def test_tuning(points):
    model = ptable.ptable(points[0], [0.0, 2.0, 4.0, 8.0])
    grid = categorical.tune_regularisation(points[0], model, ["a", "b"], 2, 6.0, [0.01, 10.0])
    assert len(grid) == 2 and grid[0][1] >= grid[1][1]
    bins = categorical.tune_bins(points[0], [[0.0, 2.0, 4.0], [0.0, 4.0]], 3, 4.0)
    assert len(bins) == 2 and bins[0][1] >= bins[1][1]


def test_priors(points):
    out = categorical.feature_prior_loocv(points[0], ["x", "y"], ["a", "b"], "station", folds=3, trees=5, depth=3)
    assert out.count() == 60 and out.where(F.abs(F.aggregate("prior", F.lit(0.0), lambda s, x: s + x) - 1) > 1e-9).count() == 0
    flat = categorical.uniform_prior(points[0], ["a", "b"]).first()["prior"]
    assert flat == [0.5, 0.5]
    logistic = categorical.feature_prior(points[0], points[0], ["x", "y"], ["a", "b"], method="logistic")
    hit = logistic.withColumn("y", F.when(F.col("prior")[0] > 0.5, "a").otherwise("b")).where("y = cls").count()
    assert hit > 45


def test_regional_estimates(spark, points):
    labels = points[0].select("id", F.when(F.col("y") < 6, 0).otherwise(1).alias("region"))
    out = regions.loocv_regional(points[0], labels, [0, 1], [0.0, 2.0, 4.0, 8.0], ["a", "b"], 4, 6.0)
    total = out.groupBy("k").agg(F.sum("p").alias("s")).collect()
    assert len(total) == 20 and all(r["s"] == pytest.approx(1) for r in total)
    about, tables = regions.regional_models(points[0], labels, [0.0, 2.0, 4.0, 8.0])
    models = {r: g for r, g in tables.toPandas().groupby("region")}
    got = categorical.bme_cat_regional(points[0].select(F.col("id").alias("k"), (F.col("x") + 0.01).alias("x"), "y"), points[0], about.withColumn("n", F.col("n").cast("double")), models, ["a", "b"], 2, 6.0)
    assert all(sum(r["ps"]) == pytest.approx(1) for r in got.collect())
    c, t = points[1][["x", "y"]].to_numpy(), np.array([np.eye(2) / 2] * 30 + [np.full((2, 2), 0.25)] * 30)
    assert len(set(regions.regions_from_tables(c, t, 2).tolist())) == 2


def test_least_squares():
    rng = np.random.default_rng(0)
    c = rng.random((40, 2)) * 10
    k = covariance_matrix(c, c, [Structure("exponentialC", 1.0, (5.0,))])
    z = 3 + np.linalg.cholesky(k) @ rng.standard_normal(40)
    f = np.ones((40, 1))
    beta, cov, fit = interpolate.gls(f, z, k)
    w = np.linalg.inv(k)
    assert beta[0] == pytest.approx((w.sum(axis=0) @ z) / w.sum()) and cov[0, 0] == pytest.approx(1 / w.sum()) and fit == pytest.approx(np.full(40, beta[0]))
    plain, _, _ = interpolate.gls(f, z)
    assert plain[0] == pytest.approx(z.mean())
    soft = interpolate.local_mean(c[:20], z[:20], c[20:], z[20:], np.full(20, 1e-12), [Structure("exponentialC", 1.0, (5.0,))])
    assert soft[0] == pytest.approx(beta[0], abs=1e-6)


def test_shipping(spark):
    from terravane.session import ship

    ship(spark)
    ship(spark)
    assert spark.range(4).mapInPandas(_imports, "n long").first()["n"] > 0


def _imports(batches):
    import terravane.kernels.qmc as q

    for pdf in batches:
        yield pd.DataFrame({"n": [len(q.__name__)]})
