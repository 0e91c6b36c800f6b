"""Model fits on the driver, to tables of a few bins that operators have made."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd

from terravane.functions.covariance import MODELS, Structure, covariance_matrix, directional_range, model_values, nested_values, parse_model
from terravane.functions.special import lgamma
from terravane.kernels.linear import project_psd, stable_cholesky
from terravane.kernels.optimize import bounded_simplex, golden
from terravane.kernels.qmc import cubature


def flatten(structures: Sequence[Structure]) -> np.ndarray:
    """Sills, spatial and temporal parameters and ratios, in order."""
    return np.array([v for s in structures for v in (s.sill, *s.space, *s.time, *([s.ratio] if s.model.endswith("ST") else []))], float)


def unflatten(values: Sequence[float], like: Sequence[Structure]) -> list[Structure]:
    it, out = iter(values), []
    for s in like:
        sill, space, time = next(it), tuple(next(it) for _ in s.space), tuple(next(it) for _ in s.time)
        out.append(Structure(s.model, sill, space, time, next(it) if s.model.endswith("ST") else 0.0))
    return out


def default_bounds(structures: Sequence[Structure]) -> tuple[np.ndarray, np.ndarray]:
    """Sills 0.3 to 2 times (nuggets 0 to the total), ranges 0.3 to 5 times, further shape parameters 0.8 to 1.2 times and 0.5 at least, ratios 0.3 to 5 times."""
    total, low, high = sum(s.sill for s in structures), [], []
    for s in structures:
        nugget = s.model.startswith("nugget")
        low.append(0.0 if nugget else 0.3 * s.sill)
        high.append(total if nugget else 2 * s.sill)
        for group in (s.space, s.time):
            for i, p in enumerate(group):
                low.append(max(0.5, 0.8 * p) if i else 0.3 * p)
                high.append(1.2 * p if i else 5 * p)
        if s.model.endswith("ST"):
            low.append(0.3 * s.ratio)
            high.append(5 * s.ratio)
    return np.array(low), np.maximum(high, low)


def wls_objective(structures: Sequence[Structure], lag: np.ndarray, cov: np.ndarray, n: np.ndarray, time: np.ndarray | None = None) -> float:
    """Weighted squares between bins and model, weights n / (C0² + C²) scaled to sum 1; bins without a value are skipped."""
    model = nested_values(structures, lag, time)
    c0 = float(nested_values(structures, np.zeros(1), None if time is None else np.zeros(1))[0])
    ok = np.isfinite(cov) & (n > 0)
    w = n / (c0**2 + model**2)
    return float((w * (cov - model) ** 2)[ok].sum() / w[ok].sum())


def fit_covariance(bins: pd.DataFrame, start: Sequence[Structure], low=None, high=None, time: str | None = None) -> tuple[list[Structure], float]:
    """Structures that fit bins (lag, cov, n[, time lag]) best by weighted least squares, and the objective."""
    lag, cov, n = (bins[c].to_numpy(float) for c in ("lag", "cov", "n"))
    t = None if time is None else bins[time].to_numpy(float)
    lo, hi = default_bounds(start)
    x, value = bounded_simplex(lambda p: wls_objective(unflatten(p, start), lag, cov, n, t), flatten(start), lo if low is None else low, hi if high is None else high)
    return unflatten(x, start), value


def fit_anisotropic(bins: pd.DataFrame, start: Sequence[Structure], angle0: float, ratio0: float) -> tuple[list[Structure], float, float, float]:
    """The same for directional bins (theta, lag, cov, n): major axis (radians, ±pi/4 about the start), ratio (0.5 to 2 times the start, 1 at most)."""
    groups = [(float(a), g) for a, g in bins.groupby("theta")]

    def objective(p: np.ndarray) -> float:
        base = unflatten(p[:-2], start)
        return sum(wls_objective([Structure(s.model, s.sill, (directional_range(s.space[0], p[-1], a, p[-2]), *s.space[1:]) if s.space else (), s.time, s.ratio) for s in base], g["lag"].to_numpy(float), g["cov"].to_numpy(float), g["n"].to_numpy(float)) for a, g in groups)

    lo, hi = default_bounds(start)
    lo, hi = np.append(lo, [angle0 - math.pi / 4, 0.5 * ratio0]), np.append(hi, [angle0 + math.pi / 4, min(1.0, 2 * ratio0)])
    x, value = bounded_simplex(objective, np.append(flatten(start), [angle0, ratio0]), lo, hi)
    return unflatten(x[:-2], start), float(x[-2]), float(x[-1]), value


def ellipse(angles: Sequence[float], ranges: Sequence[float], weights: Sequence[float] | None = None) -> tuple[float, float, float]:
    """(axis, ratio, major range) of the ellipse nearest to directional ranges; directions without a range are skipped."""
    a, r = np.asarray(angles, float), np.asarray(ranges, float)
    w = np.ones(len(a)) if weights is None else np.asarray(weights, float)
    ok = np.isfinite(r)
    a, r, w = a[ok], r[ok], w[ok]

    def gap(p: np.ndarray) -> float:
        d = a - p[0]
        return float((w * (p[2] * p[1] / np.sqrt(p[1] ** 2 * np.cos(d) ** 2 + np.sin(d) ** 2) - r) ** 2).sum())

    best = min((bounded_simplex(gap, [s, 0.5, r.max()], [-math.pi / 2, 0.01, r.min() / 4], [math.pi / 2, 1.0, r.max() * 4]) for s in np.linspace(-1.2, 1.2, 5)), key=lambda v: v[1])
    return float(best[0][0]), float(best[0][1]), float(best[0][2])


def fit_coregion(lags: np.ndarray, tensor: np.ndarray, n: np.ndarray, models: Sequence[tuple[str, tuple[float, ...]]], rounds: int = 200) -> list[np.ndarray]:
    """Sill matrices of a linear model of coregionalisation, by turns: each is the weighted fit to what the others leave, made positive semi-definite.

    tensor: bins × variables × variables of cross-covariances; n: pairs of each bin.
    """
    g = np.stack([model_values(m, lags, 1.0, *p) for m, p in models])
    w = n / n.sum()
    sills = [np.zeros(tensor.shape[1:]) for _ in models]
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(models)):
            rest = tensor - sum(g[j][:, None, None] * s for j, s in enumerate(sills) if j != i)
            new = project_psd(np.einsum("b,b,bij->ij", w, g[i], rest) / (w * g[i] ** 2).sum())
            moved = max(moved, float(np.abs(new - sills[i]).max()))
            sills[i] = new
        if moved < 1e-10:
            break
    return sills


def log_likelihood(c: np.ndarray, z: np.ndarray, structures: Sequence[Structure]) -> float:
    """Gaussian log likelihood of values (points, or points × samples) with zero mean."""
    factor = stable_cholesky(covariance_matrix(c, c, structures))
    z = z.reshape(len(c), -1)
    a = np.linalg.solve(factor, z)
    return float(-0.5 * (a**2).sum() - z.shape[1] * (np.log(np.diag(factor)).sum() + 0.5 * len(c) * math.log(2 * math.pi)))


def fit_likelihood(c: np.ndarray, z: np.ndarray, start: Sequence[Structure]) -> tuple[list[Structure], float]:
    """Maximum likelihood over points (some hundreds), space-time grids as long points, or replicated fields (points × samples); parameters up to 3 times the start."""
    x0 = flatten(start)
    x, value = bounded_simplex(lambda p: -log_likelihood(c, z, unflatten(p, start)), x0, np.full(len(x0), 1e-6), 3 * np.maximum(x0, 1e-6), rounds=800)
    return unflatten(x, start), -value


def downscale_time(structure: Structure, scale: float) -> Structure:
    """A point-time structure whose average over windows of length `scale` has the given structure's values at multiples of it."""
    lags = scale * np.arange(6)
    name = parse_model(structure.model)[1]
    wanted = structure.sill * model_values(name, lags, 1.0, *structure.time)
    u = (np.arange(24) + 0.5) / 24 * scale
    gaps = np.abs(lags[:, None, None] + u[None, :, None] - u[None, None, :])

    def gap(p: np.ndarray) -> float:
        return float((((p[0] * model_values(name, gaps, 1.0, *p[1:])).mean(axis=(1, 2)) - wanted) ** 2).sum())

    x0 = np.array([structure.sill, *structure.time])
    x, _ = bounded_simplex(gap, x0, 0.2 * x0, 8 * x0)
    return Structure(structure.model, float(x[0]), structure.space, tuple(x[1:].tolist()), structure.ratio)


# class tables


def isotonic(y: np.ndarray, w: np.ndarray, rising: bool = True) -> np.ndarray:
    """The nearest monotone sequence, by pooling neighbours."""
    sign = 1.0 if rising else -1.0
    blocks: list[list[float]] = []
    for v, u in zip(sign * y, w, strict=True):
        blocks.append([v, max(u, 1e-12), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return sign * np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def smooth_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, penalty: float | None = None) -> np.ndarray:
    """Penalised second differences on a fine grid; without a penalty the one of least leave-one-out error."""
    lo, hi = min(x.min(), at.min()), max(x.max(), at.max())
    m = 60
    grid = np.linspace(lo, hi if hi > lo else lo + 1, m)

    def basis(v: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(grid, v, side="right") - 1, 0, m - 2)
        t = (v - grid[i]) / (grid[i + 1] - grid[i])
        b = np.zeros((len(v), m))
        b[np.arange(len(v)), i], b[np.arange(len(v)), i + 1] = 1 - t, t
        return b

    b, d = basis(x), np.diff(np.eye(m), 2, axis=0)
    w = w / w.mean()

    def solve(lam: float) -> tuple[np.ndarray, float]:
        a = (b.T * w) @ b + lam * d.T @ d + 1e-9 * np.eye(m)
        inverse = np.linalg.inv(a)
        coef = inverse @ (b.T @ (w * y))
        lever = np.clip(np.einsum("ij,jk,ik->i", b, inverse, b) * w, 0, 0.999)
        return coef, float((w * ((y - b @ coef) / (1 - lever)) ** 2).sum())

    lam = penalty if penalty is not None else min((10.0**e for e in range(-2, 5)), key=lambda v: solve(v)[1])
    return basis(at) @ solve(lam)[0]


def kernel_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, sd: float, order: int = 0) -> np.ndarray:
    """Local polynomial means with a Gaussian kernel, cut at four deviations."""
    out = []
    for v in at:
        k = w * np.exp(-0.5 * ((x - v) / sd) ** 2) * (np.abs(x - v) <= 4 * sd)
        if k.sum() <= 0:
            out.append(float(y[np.abs(x - v).argmin()]))
            continue
        f = np.vander(x - v, order + 1, increasing=True)
        out.append(float(np.linalg.lstsq((f.T * k) @ f, (f.T * k) @ y, rcond=None)[0][0]))
    return np.array(out)


def fit_ptable(table: pd.DataFrame, nodes: int = 80, method: str = "spline", sd: float | None = None, monotone: bool = True, alpha: float | None = None, regularise: bool = True) -> pd.DataFrame:
    """A smooth table (ci, cj, d, p) from bins (ci, cj, d, n, p): like classes fall with distance, unlike ones rise; then shrunk to independence by alpha (by empirical Bayes if not given)."""
    at = np.linspace(table["d"].min(), table["d"].max(), nodes)
    rows = []
    for (ci, cj), g in table.groupby(["ci", "cj"]):
        g = g.sort_values("d")
        x, y, w = (g[c].to_numpy(float) for c in ("d", "p", "n"))
        if monotone:
            y = isotonic(y, w, rising=ci != cj)
        v = smooth_curve(x, y, w, at) if method == "spline" and len(x) > 3 else kernel_curve(x, y, w, at, sd or max((x.max() - x.min()) / 8, 1e-9))
        v = np.clip(v, 0, 1)
        if monotone:
            v = np.maximum.accumulate(v) if ci != cj else np.minimum.accumulate(v)
        rows.append(pd.DataFrame({"ci": ci, "cj": cj, "d": at, "p": v}))
    fitted = pd.concat(rows)
    fitted["p"] = fitted["p"] / fitted.groupby("d")["p"].transform("sum")
    if not regularise:
        return fitted.reset_index(drop=True)
    a = empirical_alpha(table) if alpha is None else alpha
    pairs = table.groupby("d")["n"].first().sort_index()
    n = np.interp(fitted["d"], pairs.index, pairs.to_numpy())
    first = fitted[fitted["d"] == at[0]].groupby("ci")["p"].sum()
    free = fitted["ci"].map(first).to_numpy() * fitted["cj"].map(first).to_numpy()
    return fitted.assign(p=(n * fitted["p"] + a * free) / (n + a)).reset_index(drop=True)


def empirical_alpha(table: pd.DataFrame) -> float:
    """The shrinkage of largest Dirichlet-multinomial likelihood, its logarithm within [-2, 10]: spread evenly over the cells of a distance, distances of fewer than two pairs left out."""
    table = table[table["n"] >= 2]
    base = 1 / max(1, table["ci"].nunique() * table["cj"].nunique())
    count = (table["n"] * table["p"]).to_numpy(float)
    total = table.groupby("d")["n"].first().to_numpy(float)

    def loss(log: float) -> float:
        a = math.exp(log)
        return -float((lgamma(a) - lgamma(a + total)).sum() + (lgamma(a * base + count) - lgamma(a * base)).sum())

    return math.exp(golden(loss, -2.0, 10.0))


__all__ = ["MODELS", "cubature", "ellipse", "fit_anisotropic", "fit_coregion", "fit_covariance", "fit_likelihood", "fit_ptable", "isotonic", "kernel_curve", "log_likelihood", "smooth_curve", "wls_objective"]
