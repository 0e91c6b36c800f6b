"""Findings of the second round, each by a case that once failed."""

import datetime as dt
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.functions.covariance import Structure
from terravane.kernels.posterior import Mixture
from terravane.operators import categorical, dependence, interpolate, joins, kriging, outlier, ptable, regions
from terravane.plans.queries import ORACLE_SQL, QUERIES
from terravane.plans.registry import nudged, quick
from tests.test_queries import ordered


def agrees(spark, folder, name: str) -> int:
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    got, want = ordered(QUERIES[name](spark, str(folder)).toPandas()), ordered(c.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)
    return len(got)


def write_events(folder, rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    c.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_windows_of_events_at_their_bounds(spark, tmp_path, zone):
    """The SQL takes a time's nearest second: half a second before a bound is in the next window; events without a time have a null window."""
    bound = dt.datetime(1970, 1, 1) + dt.timedelta(days=19710)
    half = [bound - dt.timedelta(microseconds=m) for m in (400_000, 500_000, 600_000, 1)]
    write_events(tmp_path, [(t, 1, 1.0 + i) for i, t in enumerate(half)] + [(None, 1, 5.0), (None, 2, None), (dt.datetime(1969, 12, 30), 1, 2.0), (dt.datetime(1970, 1, 2), 1, 4.0)])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert agrees(spark, tmp_path, "windowed_events") == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", ["separable_st_cov", "nonseparable_st_cov"])
def test_st_covariances_keep_every_pair(spark, tmp_path, name):
    """Every pair of points at every pair of near sites counts, those without a time too."""
    day = dt.datetime(2024, 1, 1)
    write_events(tmp_path, [(day + dt.timedelta(days=d), s, 1.0 * d + s) for s in range(1, 40) for d in range(s % 4)] + [(None, s, 1.0) for s in (2, 3)])
    assert agrees(spark, tmp_path, name) > 39


def crowded(spark, n=120):
    """Many points at three places, and as many targets at two."""
    at = [(0.0, 0.0), (3.0, 4.0), (6.0, 0.0)]
    points = spark.createDataFrame([(i, *at[i % 3], float(i % 7), "ab"[i % 2]) for i in range(n)], "id long, x double, y double, z double, cls string")
    return points, spark.createDataFrame([(i, *at[i % 2]) for i in range(n)], "k long, x double, y double")


PLACED = {
    "prior_mean": (interpolate, lambda p, t: interpolate.prior_mean(p, t, 2.0)),
    "loocv": (interpolate, lambda p, t: interpolate.loocv_bandwidths(p, [2.0, 4.0], 12.0)),
    "default_bandwidth": (joins, lambda p, t: interpolate.default_bandwidth(p, 9.0)),
    "local_marginal": (joins, lambda p, t: joins.local_marginal(t, p, 5.0, {"a": 0.5, "b": 0.5}, 9.0)),
    "kernel_first_order": (categorical, lambda p, t: categorical.kernel_first_order(t, p, {"a": 0.5, "b": 0.5}, 5.0, 9.0)),
    "knn_join": (joins, lambda p, t: joins.knn_join(t, p, 2, 9.0)),
}


@pytest.mark.parametrize("name", PLACED)
def test_pairs_grow_with_places(spark, monkeypatch, name):
    module, run = PLACED[name]
    join, pairs = module.range_join, []

    def counted(*args, **more):
        out = join(*args, **more)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(module, "range_join", counted)
    points, targets = crowded(spark)
    assert run(points, targets).count() and pairs and max(pairs) <= 36  # 14,400 pairs of points


def test_leave_one_out_of_crowded_places(spark):
    points, _ = crowded(spark, 31)
    p = points.toPandas()
    d = np.hypot(p.x.to_numpy()[:, None] - p.x.to_numpy(), p.y.to_numpy()[:, None] - p.y.to_numpy())
    for reach in (5.5, None):
        for row in interpolate.loocv_bandwidths(points, [2.0, 4.0], reach).collect():
            w = np.exp(-0.5 * (d / row["bandwidth"]) ** 2) * (d <= (reach or 99))
            np.fill_diagonal(w, 0)
            m = w @ p.z.to_numpy() / w.sum(axis=1)
            assert row["n"] == 31 and row["mse"] == pytest.approx(np.mean((p.z - m) ** 2))


def test_mixture_quantiles_meet_their_levels():
    """By few evaluations of the CDF: bisection took 80."""
    m, calls = Mixture(np.array([0.0, 0.1, 50.0]), np.array([0.3, 0.3, 0.4]), 1e-4), []

    class Counted(Mixture):
        def cdf(self, z):
            calls.append(1)
            return super().cdf(z)

    for q in (0.01, 0.3, 0.59, 0.9):
        assert m.cdf(np.array([m.quantile(q)]))[0] == pytest.approx(q, abs=1e-6)
    smooth = Counted(np.linspace(0, 1, 9), np.ones(9) / 9, 0.5)
    assert smooth.cdf(np.array([smooth.quantile(0.1)]))[0] == pytest.approx(0.1, abs=1e-11) and len(calls) < 30


def test_ordered_pairs_are_never_rows(spark, monkeypatch):
    """Covariances, variograms and directions of crowded places: no join of points, results as by all pairs."""
    monkeypatch.setattr(joins, "range_join", None)
    points, _ = crowded(spark, 40)
    points = points.withColumn("z", points.z + points.id % 3)
    p = points.toPandas()
    i, j = np.triu_indices(40)
    d = np.hypot(p.x.to_numpy()[i] - p.x.to_numpy()[j], p.y.to_numpy()[i] - p.y.to_numpy()[j])
    a, b = p.z.to_numpy()[i], p.z.to_numpy()[j]
    for row in dependence.stcov_spatial(points, [(0.0, 0.5), (5.0, 1.5)]).collect():
        s = abs(d - row["lag"]) <= (0.5 if row["bin"] == 0 else 1.5)
        assert row["n"] == s.sum() and row["cov"] == pytest.approx(np.mean(a[s] * b[s]) - a[s].mean() * b[s].mean())
    for row in dependence.stcov_spatial(points, [(5.0, 1.5)], variogram=True).collect():
        s = (abs(d - 5) <= 1.5) & (i < j)
        assert row["n"] == s.sum() and row["gamma"] == pytest.approx(np.mean((a[s] - b[s]) ** 2) / 2)
    for row in dependence.stcov_sectors(points, [(6.0, 0.5)], [0.0, np.pi / 2]).collect():
        assert (row["sector"], row["n"]) == (0, (abs(d - 6) <= 0.5).sum())


@pytest.mark.parametrize("run", [lambda p: ptable.ptable(p, [0.0, 5.0]), lambda p: ptable.ptable_sectors(p, [0.0, 5.0], [0.0], 3.2)])
def test_class_tables_join_no_points(spark, monkeypatch, run):
    monkeypatch.setattr(ptable, "range_join", None)
    points, _ = crowded(spark)
    got = run(points).where("bin = 0").toPandas()
    assert got["n"].tolist() == [3 * 40 * 40] * 4 and got["p"].tolist() == [0.25] * 4


def grid_of(spark, n=120):
    """Many sites at three places, each at four times."""
    at = [(0.0, 0.0), (3.0, 0.0), (0.0, 4.0)]
    return spark.createDataFrame([(i, *at[i % 3], float(t), float((i * 7 + t * i) % 11)) for i in range(n) for t in range(1, 5)], "site long, x double, y double, t double, z double")


def st_targets(grid):
    return grid.select((grid.site * 100 + grid.t.cast("long")).alias("k"), "x", "y", "t")


MET = {
    "quadratic": (interpolate, lambda g: interpolate.smooth_spacetime(g, st_targets(g), 4.0, 3.0, "quadratic")),
    "truncated": (interpolate, lambda g: interpolate.smooth_spacetime(g, st_targets(g), 4.0, 3.0, truncate=True)),
    "idw_outliers": (outlier, lambda g: outlier.idw_outliers(g, 3.0, 10, 1.5, 5.0, 2.0)),
    "knn_spacetime": (joins, lambda g: joins.knn_spacetime(st_targets(g), g.selectExpr("site * 100 + cast(t as bigint) AS id", "x", "y", "t", "z"), 6, 6.0, 4.0, 1.5)),
}


@pytest.mark.parametrize("name", MET)
def test_places_and_times_meet_once(spark, monkeypatch, name):
    """Of 230,400 pairs of values, the 144 of their places and times become rows."""
    module, run = MET[name]
    join, pairs = joins.spacetime_join, []

    def counted(*args):
        out = join(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(module, "range_join", None, raising=False)
    monkeypatch.setattr(module, "spacetime_join", counted)
    assert run(grid_of(spark)).count() and pairs and max(pairs) <= 144


@pytest.mark.parametrize("name", ["kernel_smooth_quadratic", "kernel_smooth_truncated", "outlier_idw", "knn_spacetime"])
def test_crowded_events_agree_with_sql(spark, tmp_path, name):
    """Sites 899 apart lie at one place; some alone."""
    day, near = dt.datetime(2024, 1, 1), [i * 899 for i in range(14)] + [1, 900, 2, 24, 31]
    write_events(tmp_path, [(day + dt.timedelta(days=d), s, float((s * 13 + d * d) % 17)) for s in near for d in range(6) if (s + d) % 5])
    assert agrees(spark, tmp_path, name) > 19


@pytest.mark.parametrize("name", ["spatial_outliers", "factorial_kriging"])
def test_targets_of_a_place_share_a_neighbourhood(spark, monkeypatch, name):
    module = {"spatial_outliers": outlier, "factorial_kriging": kriging}[name]
    join, seen = joins.knn_join, []

    def counted(targets, *args, **more):
        seen.append(targets.count())
        return join(targets, *args, **more)

    monkeypatch.setattr(module, "knn_join", counted)
    points, targets = crowded(spark)
    if name == "spatial_outliers":
        got = outlier.spatial_outliers(points, 9.0, 50, k=0.5).toPandas()
        p = points.toPandas().set_index("id")
        for i, n, flag in got.itertuples(index=False):
            near = p.assign(d=np.hypot(p.x - p.x[i], p.y - p.y[i])).sort_values(["d", "id"], kind="stable").iloc[:50]
            w = np.where(near.d > 0, 1 / np.maximum(near.d, 1e-9) ** 1.5, 0)
            assert n == 50 and flag == (abs(p.z[i] - w @ near.z / w.sum()) > 0.5 * near.z.std(ddof=0))
        assert len(got) == 120 and seen == [3]
    else:
        one = points.where("id < 3")
        got = kriging.factorial_kriging(targets, one, [Structure("exponentialC", 2.0, (8.0,))], 3, 25.0)
        sums = {r["k"]: r["z"] for r in got.groupBy("k").agg(F.sum("zk").alias("z")).collect()}
        assert len(sums) == 120 and seen == [2] and sums == pytest.approx({k: float(k % 2) for k in range(120)}, abs=1e-6)


@pytest.mark.parametrize("radius", [5.5, None])
def test_quantiles_of_pairs_by_place(spark, monkeypatch, radius):
    """No pair of points becomes a row; counts and quantiles as by all pairs."""
    monkeypatch.setattr(dependence, "pair_distances", None)
    points = crowded(spark, 31)[0].withColumn("cls", F.when(F.col("id") != 4, F.col("cls")))
    p = points.toPandas()
    i, j = np.triu_indices(31, 1)
    d = np.hypot(p.x.to_numpy()[i] - p.x.to_numpy()[j], p.y.to_numpy()[i] - p.y.to_numpy()[j])
    use = (d > 0) & (d <= (radius or 99))
    told = use & (i != 4) & (j != 4)
    row = dependence.distance_quantiles(points, radius, [0.5, 0.99], by="cls").first()
    c = p["cls"].to_numpy()
    assert row["n"] == use.sum() and row["same_share"] == pytest.approx((c[i] == c[j])[told].mean())
    assert [row["q50"], row["q99"]] == pytest.approx(np.quantile(d[use], [0.5, 0.99]))


def test_stations_meet_by_place(spark, monkeypatch):
    join, pairs = categorical.range_join, []

    def counted(*args, **more):
        out = join(*args, **more)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(categorical, "range_join", counted)
    points = crowded(spark)[0].withColumn("station", F.col("id") % 2)
    model = spark.createDataFrame([(a, b, 0.0, 0.4 if a == b else 0.1) for a in "ab" for b in "ab"], "ci string, cj string, d double, p double")
    marginal = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "cls string, p double")
    got = {(r["k"], r["cls"]): r["p"] for r in categorical.mcp_stations(points, model, marginal, 2, 9.0, "station").collect()}
    # a point's neighbours are of the other station, whose class is the other one
    assert len(got) == 240 and pairs == [36] and all(got[k, "ab"[1 - k % 2]] == pytest.approx(0.4**2 / (0.4**2 + 0.1**2)) for k in range(120))


@pytest.mark.parametrize("name", ["stcov_spacetime", "stcov_spacetime_symmetric"])
def test_sites_are_never_pairs(spark, tmp_path, monkeypatch, name):
    """Crowded sites over several chunks of time, as by the SQL, without a join of sites."""
    monkeypatch.setattr(dependence, "pair_join", None)
    day = dt.datetime(2024, 1, 1)
    write_events(tmp_path, [(day + dt.timedelta(days=d), s, float((s * 13 + d * d) % 17)) for s in [i * 899 for i in range(9)] + [145, 1044, 24, 31, 62] for d in range(9) if (s + d) % 4])
    assert agrees(spark, tmp_path, name) > 3


def test_regional_folds_go_by_place(spark, monkeypatch):
    seen = []

    def shares(targets, *args):
        seen.append(targets.count())
        return targets.select("k", F.lit("a").alias("cls"), F.lit(1.0).alias("p"))

    monkeypatch.setattr(categorical, "mcp_regional", shares)
    points = crowded(spark)[0].withColumn("station", F.col("id") % 2)
    got = regions.loocv_regional(points, points.select("id", F.lit(0).alias("region")), [0, 1], [0.0, 5.0], ["a", "b"], 2, 6.0).collect()
    assert seen == [3, 3] and sorted((r["k"], r["cls"], r["p"]) for r in got) == [(k, c, p) for k in range(120) for c, p in (("a", 1.0), ("b", 0.5))]


def write_table(folder, name, columns, rows):
    c = duckdb.connect()
    c.execute(f"CREATE TABLE t ({columns})")
    c.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(rows[0]))})", rows)
    c.execute(f"COPY t TO '{folder}/{name}.parquet' (FORMAT parquet)")


def test_distances_of_all_pairs_are_shuffled_once(spark, tmp_path):
    """Crowded places and rows without a key, as by the SQL; neither side is copied to blocks."""
    write_table(tmp_path, "part", "p_partkey BIGINT", [(k,) for k in [*(9797 * i for i in range(600)), 1, 2, None, None]])
    write_table(tmp_path, "supplier", "s_suppkey BIGINT, s_acctbal DOUBLE", [(k, 1.0) for k in [*(9797 * i for i in range(5)), 7, None]])
    assert agrees(spark, tmp_path, "pair_distance") == 604 * 7
    plan = QUERIES["pair_distance"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "sequence" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 2


def test_lags_of_sites_are_not_shuffled(spark, tmp_path):
    """Days are counted pair by pair: no exchange of pairs of points; crowded places and the month's last day as by the SQL."""
    day = dt.datetime(2024, 1, 1)
    write_events(tmp_path, [(day + dt.timedelta(days=d), s, 1.0) for s in [i * 899 for i in range(9)] + [1, 24, 900] for d in (0, 1, 3, 30) if (s + d) % 3] + [(None, s, 1.0) for s in (0, 899, 24, 31)] + [(day, None, 1.0)])
    assert agrees(spark, tmp_path, "nonseparable_st_cov") > 40 and agrees(spark, tmp_path, "separable_st_cov") > 40
    plan = QUERIES["nonseparable_st_cov"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "own#" in plan and "Aggregate" not in plan[: plan.index("Join")]


CROWD = [(k, round((k * 7919 % 1100) / 100 - 1, 2) * 1000 + k % 3 * 0.01, "A") for k in [*(41989 * i for i in range(300)), *(41989 * i + 13333 for i in range(40)), 30173, 2726, *range(60)]]
ODD = [(5, None, "A"), (41989, 250.0, "A"), (41989, 251.0, "B"), (None, 3.0, "A"), (-7, 10.0, "B")]


@pytest.mark.parametrize("name", ["pair_within_radius", "cov_nd_bins"])
def test_customers_of_places_meet_once(spark, tmp_path, monkeypatch, name):
    """Crowded places, ids twice or missing, values missing or a bin's width apart, as by the SQL, without a join of points."""
    monkeypatch.setattr(joins, "pair_join", None)
    write_table(tmp_path, "customer", "c_custkey BIGINT, c_acctbal DOUBLE, c_mktsegment VARCHAR", CROWD + ODD)
    assert agrees(spark, tmp_path, name) >= 4


def test_rounding_of_pairs_is_that_of_the_sql(spark):
    rng = np.random.default_rng(2)
    v = [*(rng.integers(-(10**11), 10**11, 2000) / 1e10), *(rng.integers(-(10**7), 10**7, 2000) / 1e6 + 4.963e-7), 0.0, -1e-9, 3e9, -1e300, None]
    got = spark.createDataFrame([(x,) for x in map(lambda x: None if x is None else float(x), v)], "v double").select(quick(F.col("v")).alias("q")).toPandas()["q"]
    want = duckdb.connect().execute(nudged("SELECT round(v, 6) + 0.0::DOUBLE AS q FROM (SELECT unnest($1::DOUBLE[]) AS v)"), [[None if x is None else float(x) for x in v]]).df()["q"]
    assert got[:4002].tolist() == want[:4002].tolist() and got[4002:4004].tolist() == [3e9, -1e300] and got.isna().sum() == 1
