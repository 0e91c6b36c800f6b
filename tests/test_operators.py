import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.functions.covariance import Structure, covariance_matrix, model_values
from terravane.operators import bme, categorical, density, entropy, fitting, interpolate, joins, kriging, multivariate, normalscore, outlier, ptable, regions, reshape, series, simulate, soft
from terravane.sources import tables

MODEL = [Structure("nuggetC", 0.3), Structure("exponentialC", 2.0, (6.0,))]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    xy = rng.random((80, 2)) * 20
    z = np.sin(xy[:, 0] / 3) + rng.normal(0, 0.2, 80)
    cls = np.where(xy[:, 1] + rng.normal(0, 3, 80) > 10, "a", "b")
    pdf = pd.DataFrame({"id": np.arange(80), "x": xy[:, 0], "y": xy[:, 1], "z": z, "cls": cls})
    return spark.createDataFrame(pdf), pdf


@pytest.fixture(scope="module")
def targets(spark):
    xy = np.random.default_rng(1).random((25, 2)) * 20
    pdf = pd.DataFrame({"k": np.arange(25), "x": xy[:, 0], "y": xy[:, 1]})
    return spark.createDataFrame(pdf), pdf


def nearest(t, p, nmax, dmax):
    d = np.hypot(p.x - t.x, p.y - t.y).to_numpy()
    order = [i for i in np.argsort(d, kind="stable") if d[i] <= dmax][:nmax]
    return order, d[order]


def test_knn_join(points, targets):
    got = joins.knn_join(targets[0], points[0], 7, 5.0).toPandas().sort_values(["k", "place"])
    for _, t in targets[1].iterrows():
        order, d = nearest(t, points[1], 7, 5.0)
        rows = got[got.k == t.k]
        assert rows.id.tolist() == points[1].id.to_numpy()[order].tolist() and rows.d.to_numpy() == pytest.approx(d)


def test_joins_ignore_order_and_place(points, targets):
    one = joins.knn_join(targets[0], points[0], 5, 6.0).select("k", "id").toPandas()
    moved = joins.knn_join(targets[0].withColumn("x", F.col("x") + 1000.25), points[0].withColumn("x", F.col("x") + 1000.25).repartition(7), 5, 6.0).select("k", "id").toPandas()
    assert set(map(tuple, one.to_numpy())) == set(map(tuple, moved.to_numpy()))
    with pytest.raises(ValueError):
        joins.range_join(targets[0], points[0], 0.0)


def test_minkowski_and_spatial_sets(points, targets):
    p = joins.block_join(targets[0], points[0]).select("a.k", "b.id", joins.distance("a", "b", ("x", "y"), 1).alias("d")).toPandas()
    assert len(p) == 25 * 80
    row = p.iloc[5]
    t, q = targets[1].iloc[int(row.k)], points[1].iloc[int(row.id)]
    assert row.d == pytest.approx(abs(t.x - q.x) + abs(t.y - q.y))
    near = joins.nearest_distance(points[0], 40.0).toPandas()
    d = np.hypot(*(points[1][["x", "y"]].to_numpy()[:, None] - points[1][["x", "y"]].to_numpy()[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    assert near.sort_values("id").d.to_numpy() == pytest.approx(d.min(axis=1))


@pytest.mark.parametrize("order", [None, 0, 1])
def test_kriging(points, targets, order):
    got = kriging.kriging(targets[0], points[0], MODEL, 6, 6.0, order).toPandas().set_index("k")
    for _, t in targets[1].iterrows():
        i, _ = nearest(t, points[1], 6, 6.0)
        if not i:
            assert np.isnan(got.loc[t.k, "zk"])
            continue
        c, z, ck = points[1][["x", "y"]].to_numpy()[i], points[1].z.to_numpy()[i], t[["x", "y"]].to_numpy(float)[None]
        k, k0 = covariance_matrix(c, c, MODEL), covariance_matrix(c, ck, MODEL)[:, 0]
        f = kriging.trend_basis(c - ck, order)
        f0 = kriging.trend_basis(np.zeros((1, 2)), order)[0]
        big = np.block([[k, f], [f.T, np.zeros((f.shape[1],) * 2)]])
        if np.linalg.matrix_rank(big) < len(big):
            continue
        w = np.linalg.solve(big, np.concatenate([k0, f0]))[: len(z)]
        assert got.loc[t.k, "zk"] == pytest.approx(w @ z, abs=1e-8)
        assert got.loc[t.k, "vk"] == pytest.approx(2.3 - 2 * w @ k0 + w @ k @ w, abs=1e-8)


def test_kriging_is_exact_at_data_and_lonely_targets_are_null(spark, points):
    model = [Structure("exponentialC", 2.0, (6.0,))]
    own = points[0].select(F.col("id").alias("k"), "x", "y")
    got = kriging.kriging(own, points[0], model, 5, 5.0, 0).toPandas().sort_values("k")
    assert got.zk.to_numpy() == pytest.approx(points[1].z.to_numpy(), abs=1e-8) and got.vk.to_numpy() == pytest.approx(np.zeros(80), abs=1e-8)
    far = spark.createDataFrame([(1, 900.0, 900.0)], "k long, x double, y double")
    row = kriging.kriging(far, points[0], model, 5, 5.0, 0).first()
    assert row["zk"] is None and row["vk"] is None


def test_factorial_parts_add_up(points, targets):
    parts = kriging.factorial_kriging(targets[0], points[0], MODEL, 6, 8.0).groupBy("k").agg(F.sum("zk").alias("s")).toPandas().set_index("k").s
    whole = kriging.kriging(targets[0], points[0], MODEL, 6, 8.0, 0).toPandas().set_index("k").zk.dropna()
    assert parts[whole.index].to_numpy() == pytest.approx(whole.to_numpy(), abs=1e-7)


def test_collocated_values_meet_in_their_mean(spark):
    rows = [(3, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 4.0), (5, 0.0, 0.0, None), (7, 1.0, 0.0, float("nan")), (9, 1.0, 1.0, 2.0)]
    got = kriging.place_means(spark.createDataFrame(rows, "id long, x double, y double, z double")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(2, 0.0, 0.0, 2.5), (9, 1.0, 1.0, 2.0)]


def test_cokriging_of_one_variable_is_kriging(points, targets):
    lmc = [kriging.Coregion("exponentialC", (6.0,), ((2.0,),)), kriging.Coregion("nuggetC", (), ((0.3,),))]
    got = kriging.cokriging(targets[0], points[0].withColumn("var", F.lit(0)), lmc, 6, 8.0).toPandas().set_index("k")
    want = kriging.kriging(targets[0], points[0], MODEL, 6, 8.0, 0).toPandas().set_index("k")
    assert got.zk[want.index].to_numpy(float) == pytest.approx(want.zk.to_numpy(float), abs=1e-7, nan_ok=True)


def test_bme_with_narrow_and_wide_soft_data(points, targets):
    hard = points[0].where("id < 40")
    rest = points[0].where("id >= 40")
    narrow = rest.select("id", "x", "y", F.struct(F.lit(10).alias("type"), F.col("z").alias("mean"), F.lit(1e-8).alias("var")).alias("soft"))
    model = [Structure("exponentialC", 2.0, (6.0,))]
    got = bme.bme_moments(targets[0], hard, narrow, model, 40, 40, 60.0, options=bme.BmeOptions(outliers="none")).toPandas().set_index("k")
    want = kriging.kriging(targets[0], points[0], model, 80, 60.0).toPandas().set_index("k")
    assert got["mean"][want.index].to_numpy() == pytest.approx(want.zk.to_numpy(), abs=1e-4)
    box = rest.select("id", "x", "y", soft.uniform(F.col("z") - 0.5, F.col("z") + 0.5).alias("soft"))
    ci = bme.bme_intervals(targets[0], hard, box, model, 5, 2, 8.0, levels=(0.9,)).toPandas()
    assert (ci.low < ci.high).all()


def test_bme_outputs_agree(points, targets):
    hard, model = points[0].where("id < 60"), [Structure("exponentialC", 2.0, (6.0,))]
    box = points[0].where("id >= 60").select("id", "x", "y", soft.uniform(F.col("z") - 0.5, F.col("z") + 0.7).alias("soft"))
    few = targets[0].where("k < 4")
    m = bme.bme_moments(few, hard, box, model, 5, 2, 8.0).toPandas().set_index("k")
    pdf = bme.bme_pdf(few, hard, box, model, 5, 2, 8.0, nodes=400).toPandas()
    for k, g in pdf.groupby("k"):
        g = g.sort_values("i")
        z, f = g.z.to_numpy(), g.density.to_numpy()
        assert np.trapezoid(z * f, z) / np.trapezoid(f, z) == pytest.approx(m.loc[k, "mean"], abs=5e-3)
    q = bme.bme_quantiles(few, hard, box, model, 5, 2, 8.0, levels=(0.5,)).toPandas().set_index("k").z
    assert q.to_numpy() == pytest.approx(m["mean"][q.index].to_numpy(), abs=0.2)


def test_bme_from_a_covariance_matrix():
    c = np.random.default_rng(0).random((7, 2)) * 5
    k = covariance_matrix(c, c, [Structure("exponentialC", 2.0, (6.0,))])
    out = bme.bme_covmat(k, 2, np.array([1.0, 2.0, 0.5]), [bme.SoftDatum(10, mean=1.0, var=0.1)] * 2, 3, 2)
    assert out.shape == (2, 3) and (out[:, 1] > 0).all()


def test_normal_scores(spark, points):
    score = normalscore.fit(points[0], nodes=200)
    score.check(None)
    y = np.linspace(score.y[1], score.y[-2], 30)
    assert score.inverse(score.forward(y)) == pytest.approx(y, abs=1e-6)
    z = normalscore.transform_column(points[0].select("id", "z"), score, "z").toPandas().z.dropna()
    assert abs(z.mean()) < 0.1 and 0.8 < z.std() < 1.2
    grid = np.linspace(-8, 8, 4001)
    dens = score.density(np.linspace(score.y[0], score.y[-1], 4000), grid, np.exp(-grid**2 / 2) / math.sqrt(2 * math.pi))
    assert np.trapezoid(np.nan_to_num(dens), np.linspace(score.y[0], score.y[-1], 4000)) == pytest.approx(1, abs=0.25)
    with pytest.raises(ValueError):
        normalscore.NormalScore(np.array([0.0, 1.0]), np.array([0.1, 0.9])).check()


def test_soft_structs(spark):
    df = spark.createDataFrame([(1, 2.0, 0.25)], "id long, m double, v double")
    for s in (soft.gaussian(F.col("m"), F.col("v")), soft.student_t(F.col("m"), F.col("v"), 8), soft.student_t(F.col("m"), F.col("v"), 1), soft.uniform_nodes(F.col("m") - 1, F.col("m") + 1)):
        row = df.select(s.alias("s")).select(soft.area(F.col("s.limi"), F.col("s.probdens")).alias("a"), soft.moments(F.col("s"))[0].alias("m"), soft.quantile(F.col("s"), 0.5).alias("q"), F.size(soft.cdf_nodes(F.col("s"))).alias("n"), F.col("s.nl").alias("nl")).first()
        assert row["a"] == pytest.approx(1) and row["m"] == pytest.approx(2.0) and row["q"] == pytest.approx(2.0) and row["n"] == row["nl"]
    grid = spark.createDataFrame([(1, (3, 3, [0.0, 1.0, 3.0], [0.2, 0.3, 0.5]))], "id long, soft struct<type:int,nl:int,limi:array<double>,probdens:array<double>>")
    out = grid.select(soft.expand_grid(F.col("soft")).alias("s")).first()["s"]
    assert out["type"] == 1 and list(out["limi"]) == [0.0, 1.0, 2.0, 3.0]
    bad = spark.createDataFrame([(1, (2, 2, [1.0, 0.0], [1.0, 1.0])), (2, (2, 2, [0.0, 1.0], [1.0, 1.0])), (3, (7, 2, [0.0, 1.0], [1.0, 1.0]))], grid.schema)
    assert [r["id"] for r in soft.check(bad).orderBy("id").collect()] == [1, 3]
    assert soft.standard_type("lin") == 2 and soft.standard_type(10) == 10 and math.isnan(soft.standard_order("zero mean"))
    with pytest.raises(ValueError):
        soft.standard_type("box")
    p = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, z double")
    for method in ("random", "centred", "fixed", "binned"):
        assert soft.random_intervals(p, 2.0, method, 0.3).where("low > z or high < z").count() == 0


def test_categorical_estimators_agree_on_hard_labels(spark, points, targets):
    edges = [0.0, 2.0, 4.0, 8.0]
    model = ptable.ptable(points[0], edges)
    marginal = ptable.marginals(model)
    assert marginal.agg(F.sum("p")).first()[0] == pytest.approx(1)
    sums = model.groupBy("bin").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    labelled = points[0].withColumn("ps", ptable.one_hot(F.col("cls"), ["a", "b"]))
    table = categorical.bme_cat(targets[0], labelled, model, ["a", "b"], 3, 8.0).toPandas().set_index("k").ps
    closed = categorical.maxent_product(targets[0], points[0], model, 3, 8.0).toPandas()
    for _, r in closed.iterrows():
        assert table[r.k][["a", "b"].index(r.cls)] == pytest.approx(r.p, abs=1e-6)
    post = categorical.mcp(targets[0], points[0], model, marginal, 4, 8.0).groupBy("k").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in post)
    deep = categorical.hbme_cat(targets[0], labelled, model, marginal, ["a", "b"], 2, 4.0, 9.0, 6).toPandas()
    assert all(sum(p) == pytest.approx(1) for p in deep.ps) and len(deep) == 25


def test_soft_tables_match_hard_ones(points):
    edges = [0.0, 2.0, 4.0]
    hard = ptable.ptable(points[0], edges).toPandas()
    soft_ = ptable.ptable_soft(points[0].withColumn("ps", ptable.one_hot(F.col("cls"), ["a", "b"])), edges).toPandas()
    for _, r in hard.iterrows():
        s = soft_[(soft_.bin == r.bin) & (soft_.ci == "ab".index(r.ci)) & (soft_.cj == "ab".index(r.cj))].iloc[0]
        assert s.p == pytest.approx(r.p) and s.n == pytest.approx(r.n)


def test_separable_and_recentred_tables():
    p = np.array([0.4, 0.6])
    free = np.outer(p, p)
    t = np.array([[0.3, 0.1], [0.1, 0.5]])
    assert categorical.separable_table([t, free], p) == pytest.approx(np.outer(t.sum(1), p), abs=1e-9)
    assert categorical.separable_table([t, free], p, "additive") == pytest.approx(t)
    model = pd.DataFrame([("a", "a", 1.0, 0.3), ("a", "b", 1.0, 0.2), ("b", "a", 1.0, 0.2), ("b", "b", 1.0, 0.3)], columns=["ci", "cj", "d", "p"])
    got = categorical.recenter(model, {"a": 0.2, "b": 0.8})
    assert got[got.ci == "a"].p.sum() == pytest.approx(0.2)


def test_grids(spark):
    rows = [(1.0, 2.0, 1.0, None), (1.0, 2.0, 2.0, 72.0), (1.0, 1.0, 1.0, 2.0), (2.0, 2.0, 2.0, 2.0), (3.0, 2.0, 1.0, 55.0), (3.0, 4.0, 1.0, 9999.0), (3.0, 4.0, 2.0, 998.0)]
    grid = spark.createDataFrame(rows, "x double, y double, t double, z double")
    raw = spark.createDataFrame([(1.0, 2.0, 1.0), (3.0, 2.0, 1.0), (1.0, 1.0, 2.0), (1.0, 2.0, 2.0), (2.0, 2.0, 2.0), (3.0, 4.0, 2.0), (6.0, 6.0, 1.0)], "x double, y double, t double").withColumn("n", F.monotonically_increasing_id())
    got = {(r["x"], r["y"], r["t"]): r["z"] for r in reshape.lookup_grid(raw, grid).collect()}
    assert got == {(1.0, 2.0, 1.0): None, (3.0, 2.0, 1.0): 55.0, (1.0, 1.0, 2.0): None, (1.0, 2.0, 2.0): 72.0, (2.0, 2.0, 2.0): 2.0, (3.0, 4.0, 2.0): 998.0, (6.0, 6.0, 1.0): None}
    back = reshape.grid_to_long(reshape.long_to_grid(grid, [1.0, 2.0]), [1.0, 2.0]).where("z is not null")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, grid.where("z is not null").collect()))
    sites = spark.createDataFrame([(1.0, 1.0), (9.0, 9.0)], "x double, y double")
    assert reshape.complete_grid(grid, sites, grid.select("t")).count() == 4


def test_files(spark, tmp_path):
    text = "A title\n3\neast m\nnorth\nz\n\n1 2 3.5\n 4\t5 6e1 \n"
    (tmp_path / "a.dat").write_text(text)
    df = tables.read_geoeas(spark, str(tmp_path / "a.dat"))
    assert df.columns == ["row", "east m", "north", "z"] and [tuple(r)[1:] for r in df.orderBy("row").collect()] == [(1.0, 2.0, 3.5), (4.0, 5.0, 60.0)]
    tables.write_geoeas(df, str(tmp_path / "b"), "again")
    assert [tuple(r)[1:] for r in tables.read_geoeas(spark, str(tmp_path / "b")).orderBy("row").collect()] == [(1.0, 2.0, 3.5), (4.0, 5.0, 60.0)]
    (tmp_path / "s.csv").write_text("head\n2, 0, 1, 2, 0.1, 0.8, 0.1\n1,3,5,0.5,0.5\n")
    soft_ = tables.read_soft_pdf(spark, str(tmp_path / "s.csv"), skip=1).orderBy("id").collect()
    assert soft_[0]["soft"]["limi"] == [0.0, 1.0, 2.0] and soft_[1]["soft"]["probdens"] == [0.5, 0.5]


def test_fits_find_what_made_the_bins():
    lag = np.linspace(0.5, 20, 15)
    truth = [Structure("sphericalC", 3.0, (12.0,))]
    bins = pd.DataFrame({"lag": lag, "cov": model_values("sphericalC", lag, 3.0, 12.0), "n": 100.0})
    found, value = fitting.fit_covariance(bins, [Structure("sphericalC", 2.0, (8.0,))])
    assert found[0].sill == pytest.approx(3.0, rel=0.02) and found[0].space[0] == pytest.approx(12.0, rel=0.02) and value < 1e-6
    sills = fitting.fit_coregion(lag, model_values("exponentialC", lag, 1.0, 8.0)[:, None, None] * np.array([[2.0, 0.5], [0.5, 1.0]]), np.full(15, 10.0), [("exponentialC", (8.0,))])
    assert sills[0] == pytest.approx(np.array([[2.0, 0.5], [0.5, 1.0]]), abs=1e-6)
    angles = np.linspace(-math.pi / 2 + 0.1, math.pi / 2, 9)
    ranges = [fitting.directional_range(10, 0.4, a, 0.5) for a in angles]
    axis, ratio, major = fitting.ellipse(angles, ranges)
    assert (axis, ratio, major) == (pytest.approx(0.5, abs=0.02), pytest.approx(0.4, abs=0.02), pytest.approx(10, rel=0.02))
    rows = pd.concat([pd.DataFrame({"theta": a, "lag": lag, "cov": model_values("exponentialC", lag, 2.0, fitting.directional_range(10, 0.5, a, 0.3)), "n": 10.0}) for a in angles])
    got, axis, ratio, _ = fitting.fit_anisotropic(rows, [Structure("exponentialC", 1.8, (9.0,))], 0.2, 0.6)
    assert axis == pytest.approx(0.3, abs=0.05) and ratio == pytest.approx(0.5, abs=0.05)
    assert truth[0].model == "sphericalC"


def test_likelihood_and_downscaling():
    rng = np.random.default_rng(3)
    c = rng.random((60, 2)) * 20
    k = covariance_matrix(c, c, [Structure("exponentialC", 2.0, (9.0,))])
    z = np.linalg.cholesky(k) @ rng.standard_normal((60, 40))
    found, best = fitting.fit_likelihood(c, z, [Structure("exponentialC", 1.5, (6.0,))])
    assert found[0].sill == pytest.approx(2.0, rel=0.25) and best >= fitting.log_likelihood(c, z, [Structure("exponentialC", 1.5, (6.0,))])
    fine = fitting.downscale_time(Structure("exponentialC/exponentialC", 2.0, (5.0,), (6.0,)), 1.0)
    assert fine.sill > 2.0


def test_class_curves(points):
    table = ptable.ptable(points[0], [0.0, 1.5, 3.0, 4.5, 6.0, 8.0]).toPandas()
    fitted = fitting.fit_ptable(table, 30)
    assert fitted.groupby("d").p.sum().to_numpy() == pytest.approx(np.ones(30))
    assert fitting.isotonic(np.array([3.0, 1.0, 2.0]), np.ones(3)) == pytest.approx([2, 2, 2])
    assert fitting.empirical_alpha(table) > 0
    x = np.linspace(0, 5, 20)
    assert fitting.kernel_curve(x, 2 * x + 1, np.ones(20), np.array([2.5]), 1.0, 1) == pytest.approx([6.0])


def test_simulation(spark):
    c = np.array([[i * 2.0, j * 2.0] for i in range(5) for j in range(5)])
    model = [Structure("exponentialC", 2.0, (6.0,))]
    wide = simulate.simulate_cholesky(spark, c, model, 400, seed=3).toPandas().pivot(index="rep", columns="i", values="z").to_numpy()
    assert np.cov(wide.T) == pytest.approx(covariance_matrix(c, c, model), abs=0.6) and wide.var() == pytest.approx(2.0, abs=0.2)
    again = simulate.simulate_cholesky(spark, c, model, 400, seed=3).toPandas().pivot(index="rep", columns="i", values="z").to_numpy()
    assert (wide == again).all()
    data, z = np.array([[1.0, 1.0], [5.0, 5.0]]), np.array([2.0, -1.0])
    held = simulate.simulate_conditional(spark, c, data, z, model, 300, seed=1).toPandas().groupby("i").z.mean().to_numpy()
    w = np.linalg.solve(covariance_matrix(data, data, model), z)
    assert held == pytest.approx(covariance_matrix(c, data, model) @ w, abs=0.4)
    with pytest.raises(ValueError):
        simulate.simulate_conditional(spark, c, c[:1], np.zeros(1), model)
    seq = simulate.simulate_sequential(spark, c, model, 8, 6.0, 200, seed=2, c0=data, z0=z).toPandas().groupby("i").z.mean().to_numpy()
    assert seq == pytest.approx(covariance_matrix(c, data, model) @ w, abs=0.6)
    inside = simulate.simulate_sequential(spark, data[:1] + 0.01, model, 8, 6.0, 60, seed=2, cs=data[:1], low=np.array([1.0]), high=np.array([1.5])).toPandas().z
    assert 1.0 < inside.mean() < 1.5
    field, other = simulate.circulant_field(20, 30, lambda dx, dy: np.exp(-np.hypot(dx, dy) / 2), np.random.default_rng(0))
    assert field.shape == other.shape == (20, 30) and 0.3 < field.var() < 2
    made = simulate.random_soft(np.zeros(5), np.array([-1.0, 0.0, 1.0]), np.array([0.0, 1.0, 0.0]))
    assert all(m.limi[0] <= 0 <= m.limi[-1] for m in made)


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 6)) + 0.1 * rng.standard_normal((60, 6))
    rows = [(i, j, float(x[i, j])) for i in range(60) for j in range(6)]
    return spark.createDataFrame(rows, "r long, c long, v double"), x


def test_decompositions(spark, field):
    df, x = field
    values, vectors, scores = multivariate.eof(df)
    want = np.linalg.svd(x - x.mean(axis=0))[1] ** 2 / 59
    assert values == pytest.approx(want) and np.abs(vectors.T @ vectors) == pytest.approx(np.eye(6), abs=1e-9)
    s = scores.toPandas().pivot(index="r", columns="k", values="v").to_numpy()
    assert s == pytest.approx((x - x.mean(axis=0)) @ vectors)
    back = multivariate.eof_mean(df, 0.9999999).toPandas().pivot(index="r", columns="c", values="v").to_numpy()
    assert back == pytest.approx(x, abs=1e-6)
    turned = multivariate.rotated_eof(df, 3)[1]
    assert turned @ turned.T == pytest.approx(vectors[:, :3] * values[:3] @ vectors[:, :3].T, abs=1e-8)
    a, b = df.where("c < 3"), df.where("c >= 3").withColumn("c", F.col("c") - 3)
    sv, u, v, sa, sb = multivariate.mca(a, b)
    xc = x - x.mean(axis=0)
    assert sv == pytest.approx(np.linalg.svd(xc[:, :3].T @ xc[:, 3:] / 59)[1])
    assert multivariate.regression_map(a, sb).count() == 3
    rho, wx, wy = multivariate.cca(a, b)
    assert abs(np.corrcoef(xc[:, :3] @ wx[:, 0], xc[:, 3:] @ wy[:, 0])[0, 1]) == pytest.approx(rho[0], abs=1e-4)
    assert multivariate.columns_of(multivariate.stack_fields([a, b])) == 6
    assert len(multivariate.extended_eof(df, 3, 2)[0]) == 2
    s = np.random.default_rng(0).uniform(-1, 1, (2000, 2))
    found, _ = multivariate.fast_ica(s @ np.array([[1.0, 0.5], [0.3, 1.0]]), 2)
    assert np.abs(np.corrcoef(found.T, s.T)[:2, 2:]).max(axis=1) == pytest.approx([1, 1], abs=0.05)
    assert multivariate.eof_class(df.where("c = 0")).select("cls").distinct().count() <= 2


def test_tensors(spark):
    t = np.arange(24.0).reshape(2, 3, 4)
    rows = [(i, j, k, float(t[i, j, k])) for i in range(2) for j in range(3) for k in range(4)]
    df = spark.createDataFrame(rows, "i0 long, i1 long, i2 long, v double")
    for mode in range(3):
        m = multivariate.unfold(df, (2, 3, 4), mode)
        back = multivariate.fold(m, (2, 3, 4), mode)
        assert sorted(map(tuple, back.select("i0", "i1", "i2", "v").collect())) == sorted(rows)
    factors, core = multivariate.hosvd(df, (2, 3, 4))
    g = np.zeros((2, 3, 4))
    for r in core.collect():
        g[r["i0"], r["i1"], r["i2"]] = r["v"]
    assert np.einsum("abc,ia,jb,kc->ijk", g, *factors) == pytest.approx(t)
    turned = multivariate.permute(df, [2, 0, 1])
    assert sorted(map(tuple, multivariate.permute(turned, [2, 0, 1], inverse=True).select("i0", "i1", "i2", "v").collect())) == sorted(rows)


def test_series(spark):
    t = np.arange(120)
    z = 0.05 * t + np.sin(2 * np.pi * t / 12)
    s, trend, rest = series.stl(z, 12, seasonal=13)
    assert s + trend + rest == pytest.approx(z) and np.abs(rest[12:-12]).max() < 0.15
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, z, strict=True)], "site long, t double, z double")
    assert series.decompose(df, 12).count() == 120
    predict = series.gam(df, "z", ["t"], knots=6)
    fit = predict(df).toPandas().sort_values("t").fit.to_numpy()
    assert np.corrcoef(fit, 0.05 * t)[0, 1] > 0.95
    assert series.gam_formula("z", ["a"], ["t"], ["f"], "g") == "z ~ a + s(t, by=g) + factor(f)"
    cb = series.cross_basis(df, "z", 2, [1.0])
    assert "cb0_0" in cb.columns and cb.count() == 120
    row = cb.orderBy("t").collect()[2]
    assert row["cb0_0"] == pytest.approx(z[2] + z[1] + z[0]) and row["cb0_1"] == pytest.approx(z[1] + 2 * z[0])


def test_densities():
    d = density.maxent_density([0.0, 1.0, 0.0, 3.0])
    x = np.linspace(-3, 3, 13)
    assert d(x) == pytest.approx(np.exp(-x**2 / 2) / math.sqrt(2 * math.pi), abs=1e-6)
    sample = np.random.default_rng(0).gamma(4, 1, 4000)
    g = density.maxent_density(density.sample_moments(sample))
    grid = np.linspace(-3, 14, 4001)
    f = g(grid)
    m = np.trapezoid(grid * f, grid)
    assert np.trapezoid(f, grid) == pytest.approx(1, abs=1e-3) and m == pytest.approx(sample.mean(), abs=1e-2)
    r = np.array([[1.0, 0.6], [0.6, 1.0]])
    both = density.copula_density([d, d], r, np.array([[0.3, -0.2]]))[0]
    q = np.array([0.3, -0.2]) @ np.linalg.inv(r) @ np.array([0.3, -0.2])
    assert both == pytest.approx(math.exp(-q / 2) / (2 * math.pi * 0.8), rel=1e-2)
    cond = density.conditional_copula_density([d, d], r, x, [1.0])
    assert cond == pytest.approx(np.exp(-((x - 0.6) ** 2) / 1.28) / math.sqrt(2 * math.pi * 0.64), abs=1e-2)
    pair = density.maxent_pair(sample[:2000], sample[2000:])
    assert pair(np.array([4.0]), np.array([4.0]))[0] > 0
    nodes, c = density.numeric_cdf(d, 0, 1)
    assert np.interp(0, nodes, c) == pytest.approx(0.5, abs=1e-3)


def test_regions(spark, points):
    c = np.vstack([np.random.default_rng(0).normal(m, 0.3, (20, 2)) for m in (0, 5, 10)])
    d = np.hypot(*(c[:, None] - c[None]).transpose(2, 0, 1))
    for linkage in ("average", "single", "complete", "ward"):
        label = regions.agglomerate(d, 3, linkage=linkage)
        assert [len(set(label[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(label)) == 3
    assert len(set(regions.dbscan(c, 1.0))) == 3
    assert len(set(regions.merge_small(np.array([0] * 30 + [1] * 28 + [2] * 2), c, 5))) == 2
    p = [np.array([[0.4, 0.1], [0.1, 0.4]]), np.array([[0.25, 0.25], [0.25, 0.25]])]
    for metric in ("kl_divergence", "euclidean", "hellinger"):
        assert regions.table_distance(p[0], p[0], metric) == pytest.approx(0, abs=1e-6) and regions.table_distance(p[0], p[1], metric) > 0
    for method in ("kmeans", "hierarchical", "dbscan"):
        out = regions.regions_from_features(points[0], ["x", "y"], 3, method, connect=6 if method == "hierarchical" else None)
        assert out.count() == 80
    about, tables_ = regions.regional_models(points[0], out, [0.0, 3.0, 6.0])
    total = tables_.groupBy("region", "bin").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in total) and about.agg(F.sum("n")).first()[0] == 80


def test_isotropy(spark):
    rng = np.random.default_rng(0)
    c = rng.random((70, 2)) * 20
    z = np.sin(c[:, 0] / 2)
    out = regions.isotropy_test(spark, c, z, [1.0, 2.0, 3.0, 4.0, 6.0], 1.0, [0.0, math.pi / 2], 0.5, replicates=19)
    assert 0 < out["p_value"] <= 1 and regions.likelihood_ratio_test(-100, -103) == (6.0, pytest.approx(math.exp(-3)))


def test_outliers(spark):
    rows = [(s, float(t), 1.0 + 0.01 * ((s * 7 + t * 3) % 5)) for s in range(6) for t in range(40)]
    rows[70] = (1, 30.0, 50.0)
    df = spark.createDataFrame(rows, "site long, t double, z double")
    seq = outlier.sequential_outliers(df, 2.0, 10.0).where("outlier").collect()
    assert [(r["site"], r["t"]) for r in seq] == [(1, 30.0)]
    z = outlier.zscores(df.withColumn("z", F.lit(2.0)))
    assert z.agg(F.max(F.abs("zscore"))).first()[0] == 0


def test_moments_entropy_and_means(spark, points):
    h = entropy.entropy(spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "c string"), ["c"]).first()["h"]
    assert h == pytest.approx(math.log(2))
    m = multivariate.moments(points[0], "z").first()
    assert m["m2"] == pytest.approx(points[1].z.var(ddof=0)) and m["m1"] == pytest.approx(points[1].z.mean())
    prior = interpolate.prior_mean(points[0], points[0].select(F.col("id").alias("k"), "x", "y"), 3.0, "global").first()
    assert prior["m"] == pytest.approx(points[1].z.mean())


def test_streams(spark, tmp_path):
    from terravane.streaming import events

    rows = [(i % 2, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "site long, s string, z double").select("site", F.col("s").cast("timestamp").alias("ts"), "z")
    table = {(r["window"]["start"], r["site"]): r["mean"] for r in events.windowed_stats(df, "10 minutes", "5 minutes").collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.windowed_stats(stream, "10 minutes", "5 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    assert {(r["window"]["start"], r["site"]): r["mean"] for r in spark.table("w").collect()} == table
    q = events.kalman_stream(stream, 0.1, 1.0).writeStream.format("memory").queryName("k").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    last = spark.table("k").where("site = 1").orderBy(F.desc("ts")).first()
    x, p = 0.0, 1e3
    for z in range(1, 40, 2):
        p += 0.1
        g = p / (p + 1.0)
        x, p = x + g * (z - x), (1 - g) * p
    assert last["xf"] == pytest.approx(x)
