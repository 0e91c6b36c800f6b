import numpy as np
import pytest

from terravane.operators import dependence, interpolate
from terravane.plans.queries import QUERIES
from terravane.sources.tables import binding

SF = "/root/testdata/sf0.001"


def scattered(spark):
    """Three near points, two of them at one place, and one far from all."""
    xy = np.array([[0.0, 0.0], [0.0, 0.0], [3.0, 4.0], [300.0, 400.0]])
    z, cls = np.array([1.0, 2.0, 4.0, 9.0]), ["a", "a", "b", "a"]
    rows = [(i, *map(float, xy[i]), float(z[i]), cls[i]) for i in range(4)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, cls string"), xy, z


def test_distance_quantiles_of_all_pairs(spark):
    df, *_ = scattered(spark)
    d = [5.0, 5.0, 500.0, 500.0, 495.0]
    got = dependence.distance_quantiles(df, None, [0.5, 0.99], by="cls").first()
    assert got["n"] == 5 and got["same_share"] == pytest.approx(2 / 5)
    assert (got["q50"], got["q99"]) == pytest.approx(tuple(np.quantile(d, [0.5, 0.99])))
    rough = dependence.distance_quantiles(df, None, [0.5], accuracy=100).first()
    assert rough["n"] == 5 and rough["q50"] == 495.0


@pytest.mark.parametrize("name", ["gaussian", "epanechnikov"])
def test_loocv_scores_every_point_by_all_others(spark, name):
    df, xy, z = scattered(spark)
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    for row in interpolate.loocv_bandwidths(df, [2.0, 8.0, 200.0], name=name).collect():
        u2 = (d / row["bandwidth"]) ** 2
        w = np.exp(-0.5 * u2) if name == "gaussian" else np.maximum(1 - u2, 0)
        np.fill_diagonal(w, 0)
        m = np.where(w.sum(axis=1) > 0, w @ z / np.where(w.sum(axis=1) > 0, w.sum(axis=1), 1), z.mean())
        assert row["n"] == 4 and row["mse"] == pytest.approx(np.mean((z - m) ** 2))


def test_grid_has_every_day(spark):
    got = QUERIES["long_to_grid_all"](spark, SF)
    assert got.columns == ["x", "y", *(f"t{i}" for i in range(31))]
    days = {r["t"] for r in binding(spark, SF, "grid").select("t").distinct().collect()}
    row = got.toPandas()
    assert {float(i + 1) for i in range(31) if row[f"t{i}"].notna().any()} == days and max(days) > 6


def test_mca_uses_all_columns(spark):
    wide = binding(spark, SF, "field").toPandas().pivot(index="r", columns="c", values="v").to_numpy()
    x = wide - wide.mean(axis=0)
    want = np.linalg.svd(x[:, :32].T @ x[:, 32:] / (len(x) - 1))[1][:5]
    got = QUERIES["mca"](spark, SF).toPandas().sort_values("mode")["value"].to_numpy()
    assert wide.shape[1] == 64 and got == pytest.approx(want, abs=2e-5)
