"""The SQL solver of the checks, score tables, margins, and random fields given data."""

import numpy as np
import pytest

from terravane.functions.covariance import Structure, covariance_matrix
from terravane.functions.special import normal_cdf
from terravane.kernels.linear import gaussian_condition
from terravane.kernels.maxent import scale_margins
from terravane.operators import simulate
from terravane.operators.normalscore import NormalScore
from terravane.plans.linear_sql import solved_sql, system_sql


def test_solver_equals_numpy():
    import duckdb

    rng = np.random.default_rng(3)
    c = duckdb.connect()
    c.execute("CREATE TABLE m (k INT, i INT, x DOUBLE, b DOUBLE)")
    places = {k: rng.uniform(0, 10, k + 1) for k in range(5)}
    right = {k: rng.uniform(0, 1, k + 1) for k in range(5)}
    c.executemany("INSERT INTO m VALUES (?, ?, ?, ?)", [(k, i + 1, float(x), float(right[k][i])) for k, xs in places.items() for i, x in enumerate(xs)])
    sql = f"WITH RECURSIVE {system_sql('m', 'exp(-abs(p.x - q.x))', ['p.b', '0'], [('1', ['1', '1'])])}, {solved_sql('s')} SELECT k, w FROM solved ORDER BY k"
    for k, w in c.execute(sql).fetchall():
        n = k + 1
        a = np.ones((n + 1, n + 1))
        a[:n, :n] = np.exp(-np.abs(places[k][:, None] - places[k][None]))
        a[n, n] = 0
        want = np.linalg.solve(a, np.column_stack([[*right[k], 1.0], [*np.zeros(n), 1.0]]))
        np.testing.assert_allclose(w, want, atol=1e-9)


def test_solver_without_constraints():
    import duckdb

    sql = f"WITH RECURSIVE m(k, i, x, b) AS (VALUES (1, 1, 0.0, 3.0), (1, 2, 1.0, 5.0)), {system_sql('m', 'CASE WHEN p.i = q.i THEN 2 ELSE 1 END', ['p.b'], [])}, {solved_sql('s')} SELECT w FROM solved"
    np.testing.assert_allclose(duckdb.sql(sql).fetchall()[0][0], [[1 / 3], [7 / 3]])


def test_slopes_of_a_normal_table():
    z = np.linspace(-4, 4, 4001)
    score = NormalScore(2 + 3 * z, normal_cdf(z))
    np.testing.assert_allclose(score.slope(), 3, rtol=1e-6)
    assert score.slope() is score.slope()


@pytest.mark.parametrize("off", [1e-1, 1e-4])
def test_margins_of_nearly_diagonal_tables(off):
    p = np.full((4, 4), off) + np.diag([0.1, 0.2, 0.3, 0.4])
    rows = np.array([0.4, 0.3, 0.2, 0.1])
    t = scale_margins(p, rows)
    np.testing.assert_allclose(t.sum(axis=1), rows, atol=1e-9)
    np.testing.assert_allclose(t.sum(axis=0), rows, atol=1e-9)


def test_conditional_fields_scatter_about_the_conditional_mean(spark):
    model = [Structure("exponentialC", 2.0, (8.0,))]
    c0, z0, c = np.array([[0.0, 0.0], [4.0, 0.0]]), np.array([1.0, -1.0]), np.array([[1.0, 0.5], [3.0, 0.5], [9.0, 9.0]])
    mean, cov = gaussian_condition(covariance_matrix(c, c, model), covariance_matrix(c, c0, model), covariance_matrix(c0, c0, model), z0)
    got = simulate.simulate_conditional(spark, c, c0, z0, model, n=4000, seed=2).toPandas().pivot(index="rep", columns="i", values="z").to_numpy()
    np.testing.assert_allclose(got.mean(axis=0), mean, atol=0.1)
    np.testing.assert_allclose(np.cov(got.T), cov, atol=0.2)
