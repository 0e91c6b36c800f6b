import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import covariance as cv
from terravane.functions import special as sp
from terravane.kernels import linear, maxent, optimize, qmc
from terravane.kernels.posterior import BmeOptions, Mixture, SoftDatum, nonnegative, posterior

PARAMS = {"sphericalC": (2.0, 5.0), "exponentialC": (2.0, 5.0), "gaussianC": (2.0, 5.0), "holecosC": (2.0, 5.0), "holesinC": (2.0, 5.0), "nuggetC": (2.0,), "mexicanhatC": (2.0, 0.01, 0.2), "maternC": (2.0, 5.0, 2.5), "nuggetV": (2.0,), "exponentialV": (2.0, 5.0), "sphericalV": (2.0, 5.0), "gaussianV": (2.0, 5.0), "holecosV": (2.0, 5.0), "holesinV": (2.0, 5.0), "linearV": (2.0,), "powerV": (2.0, 1.5)}


@pytest.mark.parametrize("name", list(PARAMS))
def test_column_and_numpy_models_agree(spark, name):
    h = np.concatenate([[0.0], np.linspace(0.1, 12, 40)])
    df = spark.createDataFrame([(float(v),) for v in h], "h double")
    got = [r[0] for r in df.select(cv.model_column(name, F.col("h"), *PARAMS[name]).cast("double")).collect()]
    assert got == pytest.approx(cv.model_values(name, h, *PARAMS[name]), abs=1e-12)


def test_model_names():
    assert cv.isspacetime(["exponentialC/sphericalC", "nuggetC/nuggetC"])[:2] == (True, True)
    assert cv.isspacetime(["exponentialCST"])[:2] == (True, False) and cv.isspacetime(["nuggetC"])[:2] == (False, False)
    with pytest.raises(ValueError):
        cv.isspacetime(["nuggetC", "exponentialCST"])
    with pytest.raises(NameError):
        cv.get_model("nothing")


def test_matern_of_any_order():
    h = np.array([0.0, 0.5, 1.0, 3.0, 8.0])
    half = cv.model_values("maternC", h, 2.0, 5.0, 1.5)
    near = cv.model_values("maternC", h, 2.0, 5.0, 1.5 + 1e-7)
    assert near == pytest.approx(half, abs=1e-5)


def test_gradient():
    h = np.array([0.0, 1.0, 4.0])
    g = cv.model_gradient("exponentialC", h, (2.0, 5.0))
    assert g[0] == pytest.approx(np.exp(-3 * h / 5), abs=1e-7)
    assert g[1] == pytest.approx(2 * np.exp(-3 * h / 5) * 3 * h / 25, abs=1e-6)
    assert cv.model_gradient("exponentialC", h, (2.0, 5.0), second=True)[0] == pytest.approx(np.zeros(3), abs=1e-4)


def test_anisotropy_turns_back():
    c = np.random.default_rng(0).random((20, 2)) * 10
    assert cv.iso2aniso_values(cv.aniso2iso_values(c, 30, 0.4), 30, 0.4) == pytest.approx(c)
    c3 = np.random.default_rng(0).random((20, 3))
    assert cv.iso2aniso_values(cv.aniso2iso_values(c3, [30, 10], [0.4, 0.7]), [30, 10], [0.4, 0.7]) == pytest.approx(c3)
    assert cv.directional_range(8, 0.5, 0.3, 0.3) == pytest.approx(8) and cv.directional_range(8, 0.5, 0.3 + math.pi / 2, 0.3) == pytest.approx(4)


def test_covariance_matrices():
    s = [cv.Structure("nuggetC", 0.5), cv.Structure("exponentialC", 1.0, (10.0,))]
    a, b = np.array([[0.0, 0], [3, 4]]), np.array([[0.0, 0]])
    k = cv.covariance_matrix(a, b, s)
    assert k[:, 0] == pytest.approx([1.5, math.exp(-1.5)])
    assert cv.covariance_matrix(a, np.zeros((0, 2)), s).shape == (2, 0)
    blocks = cv.split_covariance([a, b, None], s)
    assert blocks[0][2] is None and cv.combine_blocks([r[:2] for r in blocks[:2]]).shape == (3, 3)
    st = [cv.Structure("exponentialC/exponentialC", 2.0, (8.0,), (4.0,))]
    assert cv.covariance_matrix(np.array([[0, 0, 0.0]]), np.array([[0, 0, 4.0]]), st)[0, 0] == pytest.approx(2 * math.exp(-3))


def test_normal_and_t():
    p = np.array([0.0, 1e-9, 0.01, 0.3, 0.5, 0.9, 1 - 1e-9, 1.0])
    z = sp.normal_quantile(p)
    assert sp.normal_cdf(z[1:-1]) == pytest.approx(p[1:-1], rel=1e-9) and z[0] == -np.inf and z[-1] == np.inf
    assert sp.erfinv(0.5) == pytest.approx(0.4769362762044699)
    assert sp.t_quantile(0.975, 10) == pytest.approx(2.2281388, abs=1e-5) and sp.t_quantile(0.5, 3) == pytest.approx(0, abs=1e-6)
    assert sp.bessel_k(0.5, np.array([1.0]))[0] == pytest.approx(math.sqrt(math.pi / 2) * math.exp(-1), rel=1e-6)


def test_lattice_cubature():
    """A ball's volume in spherical coordinates, and a vector integrand."""
    def ball(x):
        return x[:, 0] ** 2 * np.sin(x[:, 1])

    value, error, _ = qmc.cubature(ball, [0, 0, 0], [1, math.pi, 2 * math.pi], rel=1e-5, abs_=1e-6, most=14)
    assert value[0] == pytest.approx(4 * math.pi / 3, abs=2e-3) and error[0] < 1e-2
    both, _, n = qmc.cubature(lambda x: np.column_stack([x[:, 0], np.ones(len(x))]), [0], [2])
    assert both == pytest.approx([2, 2], abs=2e-3) and n <= 8 << 15
    full = np.sort(qmc.lattice(1, 0, 64)[:, 0])
    assert full == pytest.approx(np.arange(64) / 64)


def test_optimisers():
    x, v = optimize.bounded_simplex(lambda p: (p[0] + p[1]) ** 2 + 2 * p[1] + 8, [0, 0], [-90, -2], [30, 30])
    assert v == pytest.approx(4, abs=1e-6) and x == pytest.approx([2, -2], abs=1e-3)
    x, v = optimize.particle_swarm(lambda p: (p[0] + p[1]) ** 2 + 2 * p[1] + 8, ([-90, -2], [30, 30]), rounds=60)
    assert v == pytest.approx(4, abs=0.2)
    assert optimize.golden(lambda t: (t - 1.3) ** 2, -5, 5) == pytest.approx(1.3, abs=1e-6)
    found = optimize.descend(lambda p: (float(((p - 3) ** 2 * [1, 50]).sum()), 2 * (p - 3) * [1, 50]), np.zeros(2))
    assert found == pytest.approx([3, 3], abs=1e-5)


def test_orthogonal_bases():
    x = np.random.default_rng(1).random((5, 10))
    q = linear.gram_schmidt(x)
    assert q @ q.T == pytest.approx(np.eye(5), abs=1e-10)
    w = np.random.default_rng(2).random(10) + 0.5
    q, r = linear.weighted_qr(x.T, w)
    assert (q.T * w) @ q == pytest.approx(np.eye(5), abs=1e-10) and q @ r == pytest.approx(x.T)
    k = np.array([[1.0, 1, 0], [1, 1, 0], [0, 0, 1]])
    assert sorted(linear.pivoted_selection(k, np.array([1.0, 0.9, 0.5]), 3)) == [0, 2]
    assert np.linalg.eigvalsh(linear.project_psd(np.array([[1.0, 2], [2, 1]]))).min() >= -1e-12


def test_kalman_matrices():
    x, p = linear.kalman_update(np.array([0.0]), np.array([[4.0]]), np.array([2.0]), np.eye(1), np.array([[1.0]]))
    assert x == pytest.approx([1.6]) and p == pytest.approx(np.array([[0.8]]))


# posterior


def blocks(k, h, s, structures):
    c = [cv.covariance_matrix(a, b, structures) if len(a) and len(b) else np.zeros((len(a), len(b))) for a, b in ((k, k), (k, h), (k, s), (h, h), (h, s), (s, s))]
    return c[0][0, 0], c[1][0], c[2][0], c[3], c[4], c[5]


MODEL = [cv.Structure("exponentialC", 2.0, (10.0,))]
K, H, S = np.array([[0.0, 0.0]]), np.array([[2.0, 1.0], [-3.0, 1.0]]), np.array([[1.0, -1.0]])


def test_hard_data_alone_is_simple_kriging():
    zh = np.array([1.0, -0.5])
    kk, kh, ks, hh, hs, ss = blocks(K, H, S[:0], MODEL)
    m, v, s = posterior(kk, kh, ks, hh, hs, ss, zh, []).moments()
    w = np.linalg.solve(hh, kh)
    assert (m, v, s) == (pytest.approx(w @ zh), pytest.approx(kk - w @ kh), 0.0)


def test_gaussian_soft_data_are_noisy_data():
    zh = np.array([1.0, -0.5])
    b = blocks(K, H, S, MODEL)
    got = posterior(*b, zh, [SoftDatum(10, mean=0.7, var=0.3)], options=BmeOptions(outliers="none")).moments()
    d = np.vstack([H, S])
    kd = cv.covariance_matrix(K, d, MODEL)[0]
    dd = cv.covariance_matrix(d, d, MODEL) + np.diag([0, 0, 0.3])
    w = np.linalg.solve(dd, kd)
    assert got[:2] == (pytest.approx(w @ np.array([1.0, -0.5, 0.7])), pytest.approx(2.0 - w @ kd))


def test_interval_data_by_direct_integration():
    zh = np.array([1.0, -0.5])
    kk, kh, ks, hh, hs, ss = blocks(K, H, S, MODEL)
    soft = SoftDatum(2, np.array([0.2, 1.5]), np.full(2, 1 / 1.3))
    got = posterior(kk, kh, ks, hh, hs, ss, zh, [soft])
    z = np.linspace(0.2, 1.5, 4001)
    d = np.vstack([H, S])
    dd, kd = cv.covariance_matrix(d, d, MODEL), cv.covariance_matrix(K, d, MODEL)[0]
    w = np.linalg.solve(dd, kd)
    ms, vs = hs.T[0] @ np.linalg.solve(hh, zh), ss[0, 0] - hs.T[0] @ np.linalg.solve(hh, hs[:, 0])
    p = np.exp(-0.5 * (z - ms) ** 2 / vs)
    p /= np.trapezoid(p, z)
    mu = w[:2] @ zh + w[2] * z
    m = np.trapezoid(mu * p, z)
    v = 2.0 - w @ kd + np.trapezoid((mu - m) ** 2 * p, z)
    assert got.moments()[0] == pytest.approx(m, abs=2e-3) and got.moments()[1] == pytest.approx(v, abs=4e-3)
    grid = got.grid(400, 6)
    assert np.trapezoid(got.density(grid), grid) == pytest.approx(1, abs=1e-3)
    assert got.cdf(np.array([got.quantile(0.3)]))[0] == pytest.approx(0.3, abs=1e-6)
    assert abs(got.density(np.array([got.mode()]))[0] - got.density(grid).max()) < 1e-3


def test_narrow_soft_data_become_hard():
    zh = np.array([1.0, -0.5])
    b = blocks(K, H, S, MODEL)
    narrow = posterior(*b, zh, [SoftDatum(2, np.array([0.49999, 0.50001]), np.full(2, 5e4))]).moments()
    d = np.vstack([H, S])
    exact = blocks(K, d, S[:0], MODEL)
    assert narrow[0] == pytest.approx(posterior(*exact, np.array([1.0, -0.5, 0.5]), []).moments()[0], abs=1e-3)


def test_contradicted_soft_data():
    zh = np.array([0.0, 0.0])
    b = blocks(K, H, S, MODEL)
    far = [SoftDatum(10, mean=50.0, var=0.01)]
    kept, cut, wide = (posterior(*b, zh, far, options=BmeOptions(outliers=o)).moments()[0] for o in ("none", "exclude", "inflate"))
    assert kept > 5 and abs(cut) < 1e-9 and 0 < wide < kept


def test_soft_datum_forms():
    t = SoftDatum(2, np.array([0.0, 1.0, 3.0]), np.array([0.0, 2 / 3, 0.0]))
    u = np.linspace(0.001, 0.999, 2001)
    assert t.inverse(u).mean() == pytest.approx(t.moments()[0], abs=2e-3) and t.inverse(u).var() == pytest.approx(t.moments()[1], abs=5e-3)
    h = SoftDatum(1, np.array([0.0, 1.0, 2.0]), np.array([0.25, 0.75]))
    assert h.moments()[0] == pytest.approx(1.25) and h.inverse(np.array([0.25]))[0] == pytest.approx(1.0)
    assert nonnegative(-1.0, 1.0)[0] == 0.0 and nonnegative(50.0, 1.0) == (50.0, pytest.approx(1.0))
    assert Mixture(np.array([0.0]), np.ones(1), 4.0).moments() == (0.0, 4.0, 0.0)


# joint tables


def consistent(nc=3, n=3, seed=0):
    t = np.random.default_rng(seed).random((nc,) * n)
    t /= t.sum()
    return {(i, j): t.sum(axis=tuple(a for a in range(n) if a not in (i, j))) for i in range(n) for j in range(i + 1, n)}


@pytest.mark.parametrize("build", [maxent.scaled_table, lambda p, n, c: maxent.scaled_table(p, n, c, 1e-10, 4000, True), lambda p, n, c: maxent.dual_table(p, n, c, reg=1e-7)])
def test_scaling_meets_the_margins(build):
    pairs = consistent()
    t = build(pairs, 3, 3)
    for (i, j), p in pairs.items():
        assert maxent._margin(t, i, j) == pytest.approx(p, abs=2e-4)


def test_product_table_and_posterior():
    pairs = consistent()
    t = maxent.joint_table(pairs, 3, 3)
    want = np.einsum("ab,ac,bc->abc", pairs[0, 1], pairs[0, 2], pairs[1, 2])
    assert t == pytest.approx(want / want.sum())
    post = maxent.target_posterior(t, [np.array([1.0, 0, 0]), np.array([0.2, 0.3, 0.5])])
    assert post.sum() == pytest.approx(1) and post == pytest.approx(np.einsum("abc,b,c->a", t, [1, 0, 0], [0.2, 0.3, 0.5]) / np.einsum("abc,b,c->", t, [1, 0, 0], [0.2, 0.3, 0.5]))
    assert maxent.joint_table(pairs, 3, 3, "MLE_reg", reg=1e6) == pytest.approx(t, abs=1e-3)
    assert maxent.sequential_table([pairs], 3, 3).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        maxent.joint_table(pairs, 3, 3, "nothing")
    with pytest.raises(ValueError):
        maxent.product_table({}, 40, 5)


def test_margins_are_fitted():
    t = maxent.scale_margins(np.random.default_rng(0).random((3, 3)), np.array([0.2, 0.3, 0.5]), np.array([0.1, 0.1, 0.8]))
    assert t.sum(axis=1) == pytest.approx([0.2, 0.3, 0.5]) and t.sum(axis=0) == pytest.approx([0.1, 0.1, 0.8])
