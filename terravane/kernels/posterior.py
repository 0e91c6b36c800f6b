"""Posterior of a target given hard and soft data: a weighted mixture of normals.

Given hard data the soft points and the target are jointly normal. Each node of a
lattice is pushed through the soft data's inverse CDFs to a point zs; its weight is the
normal density of zs given the hard data, and there the target is normal with a mean
that depends on zs and a variance that does not. Every output (moments, density, mode,
intervals, quantiles) is one of the mixture.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from terravane.functions.special import normal_cdf, normal_pdf, normal_quantile
from terravane.kernels.linear import gaussian_condition
from terravane.kernels.qmc import lattice


@dataclass(frozen=True)
class SoftDatum:
    """Type 1 histogram, 2 linear nodes, 10 Gaussian (mean, var)."""

    kind: int
    limi: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dens: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: float = 0.0
    var: float = 0.0

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Limits, densities at both ends of each segment."""
        if self.kind == 1:
            return self.limi, self.dens, self.dens
        return self.limi, self.dens[:-1], self.dens[1:]

    def moments(self) -> tuple[float, float]:
        if self.kind == 10:
            return self.mean, self.var
        x, p0, p1 = self.nodes()
        a, b = x[:-1], x[1:]
        area = ((b - a) * (p0 + p1) / 2).sum()
        first = ((b - a) * (p0 * (2 * a + b) + p1 * (a + 2 * b)) / 6).sum() / area
        second = ((b - a) * (p0 * (3 * a * a + 2 * a * b + b * b) + p1 * (a * a + 2 * a * b + 3 * b * b)) / 12).sum() / area
        return float(first), float(second - first**2)

    def inverse(self, u: np.ndarray) -> np.ndarray:
        """Exact inverse CDF: quadratic within a segment."""
        if self.kind == 10:
            return normal_quantile(np.clip(u, 1e-12, 1 - 1e-12), self.mean, self.var)
        x, p0, p1 = self.nodes()
        mass = (x[1:] - x[:-1]) * (p0 + p1) / 2
        cdf = np.concatenate([[0.0], np.cumsum(mass)]) / mass.sum()
        i = np.clip(np.searchsorted(cdf, u, side="right") - 1, 0, len(mass) - 1)
        rest = (u - cdf[i]) * mass.sum()
        slope = (p1[i] - p0[i]) / (x[i + 1] - x[i])
        root = np.sqrt(np.maximum(p0[i] ** 2 + 2 * slope * rest, 0))
        return np.minimum(x[i] + 2 * rest / np.maximum(p0[i] + root, 1e-300), x[i + 1])


@dataclass(frozen=True)
class Mixture:
    """Means and weights (sum 1) of normals of one variance."""

    means: np.ndarray
    weights: np.ndarray
    var: float

    def moments(self) -> tuple[float, float, float]:
        """Mean, variance and skewness."""
        m = float(self.weights @ self.means)
        d = self.means - m
        var = float(max(self.var, 0.0) + self.weights @ d**2)
        third = float(self.weights @ (d**3 + 3 * d * self.var))
        return m, var, third / var**1.5 if var > 0 else 0.0

    def grid(self, n: int = 200, width: float = 4.0) -> np.ndarray:
        m, var, _ = self.moments()
        sd = max(var, 1e-18) ** 0.5
        return np.linspace(m - width * sd, m + width * sd, n)

    def density(self, z: np.ndarray) -> np.ndarray:
        return normal_pdf(np.asarray(z)[:, None], self.means[None, :], max(self.var, 1e-18)) @ self.weights

    def cdf(self, z: np.ndarray) -> np.ndarray:
        return normal_cdf(np.asarray(z)[:, None], self.means[None, :], max(self.var, 1e-18)) @ self.weights

    def quantile(self, q: float) -> float:
        """By Newton steps within a bracket; a step that leaves it halves it, as does every other one when ten have not met the level."""
        lo, hi = map(float, self.grid(2, 12.0))
        z, small = (lo + hi) / 2, 1e-13 * (hi - lo)
        for i in range(240):
            at = np.array([z])
            gap, slope = float(self.cdf(at)[0]) - q, float(self.density(at)[0])
            lo, hi = (z, hi) if gap < 0 else (lo, z)
            step = z - gap / slope if slope > 0 and (i < 10 or i % 2) else lo
            newton = lo < step < hi
            last, z = z, step if newton else (lo + hi) / 2
            if hi - lo <= small or (newton and abs(z - last) <= small):
                break
        return z

    def mode(self) -> float:
        if len(self.means) == 1:
            return float(self.means[0])
        z = self.grid(50)
        for _ in range(6):
            i = int(self.density(z).argmax())
            z = np.linspace(z[max(i - 1, 0)], z[min(i + 1, len(z) - 1)], 50)
        return float(z[int(self.density(z).argmax())])


@dataclass(frozen=True)
class BmeOptions:
    """points: lattice sizes to double between; tolerance: of mean and deviation, relative to the deviation; most_soft: above this many non-Gaussian data their first two moments stand for them; outliers: 'inflate', 'exclude' or 'none' for Gaussian soft data that the hard data contradict by `gate` deviations; nonneg: of moments."""

    points: tuple[int, int] = (8, 13)
    tolerance: float = 1e-3
    most_soft: int = 20
    outliers: str = "inflate"
    gate: float = 3.0
    nonneg: bool = False
    seed: int = 1


def posterior(kk: np.ndarray, kh: np.ndarray, ks: np.ndarray, hh: np.ndarray, hs: np.ndarray, ss: np.ndarray, zh: np.ndarray, soft: Sequence[SoftDatum], mean: tuple = (0.0, 0.0, 0.0), options: BmeOptions = BmeOptions()) -> Mixture:
    """Posterior of one target from covariance blocks (kk scalar; kh, ks rows), data, and the means of target, hard and soft points."""
    mk, mh, ms = mean
    n = len(soft)
    joint = np.block([[np.atleast_2d(kk), ks[None, :]], [ks[:, None], ss]])
    cross = np.vstack([kh[None, :], hs.T]) if len(zh) else np.zeros((1 + n, 0))
    shift, c = gaussian_condition(joint, cross, hh, zh - mh)
    centre, var_k = mk + shift[0], float(c[0, 0])
    if not n:
        return Mixture(np.array([centre]), np.ones(1), var_k)
    m_s, c_ks, c_ss = ms + shift[1:], c[0, 1:], c[1:, 1:]
    stats = np.array([s.moments() for s in soft])
    gaussian = np.array([s.kind == 10 for s in soft])
    if gaussian.all() or (~gaussian).sum() > options.most_soft:
        value, noise = stats[:, 0], stats[:, 1].copy()
        far = np.abs(m_s - value) > options.gate * (np.sqrt(np.maximum(np.diag(c_ss), 0)) + np.sqrt(noise))
        if far.any() and len(zh) and options.outliers != "none":
            if options.outliers == "exclude":
                keep = ~far
                value, noise, m_s, c_ks, c_ss = value[keep], noise[keep], m_s[keep], c_ks[keep], c_ss[np.ix_(keep, keep)]
            else:
                noise[far] = ((m_s - value)[far] / options.gate) ** 2
        up, left = gaussian_condition(np.array([[var_k]]), c_ks[None, :], c_ss + np.diag(noise), value - m_s)
        return Mixture(np.array([centre + up[0]]), np.ones(1), float(left[0, 0]))
    # Gaussian soft data go into the conditioning; the others are integrated over
    if gaussian.any():
        g, o = np.flatnonzero(gaussian), np.flatnonzero(~gaussian)
        block = np.block([[np.array([[var_k]]), c_ks[None, o]], [c_ks[o][:, None], c_ss[np.ix_(o, o)]]])
        to = np.vstack([c_ks[None, g], c_ss[np.ix_(o, g)]])
        up, left = gaussian_condition(block, to, c_ss[np.ix_(g, g)] + np.diag(stats[g, 1]), stats[g, 0] - m_s[g])
        centre, var_k, m_s, c_ks, c_ss = centre + up[0], float(left[0, 0]), m_s[o] + up[1:], left[0, 1:], left[1:, 1:]
        soft, n = [soft[i] for i in o], len(o)
    inverse = np.linalg.pinv(c_ss, rcond=1e-12, hermitian=True)
    slope = c_ks @ inverse
    rest = max(var_k - float(slope @ c_ks), 0.0)
    shift_u = np.random.RandomState(options.seed).rand(n)
    last = None
    for m in range(options.points[0], options.points[1] + 1):
        u = (lattice(n, 0, 1 << m) + shift_u) % 1.0
        zs = np.column_stack([s.inverse(u[:, j]) for j, s in enumerate(soft)])
        gap = zs - m_s
        log = -0.5 * np.einsum("ij,jk,ik->i", gap, inverse, gap)
        w = np.exp(log - log.max())
        found = Mixture(centre + gap @ slope, w / w.sum(), rest)
        now = np.array(found.moments()[:2])
        if last is not None and np.abs(now[0] - last[0]) <= options.tolerance * now[1] ** 0.5 and abs(now[1] - last[1]) <= 2 * options.tolerance * now[1]:
            break
        last = now
    return found


def nonnegative(mean: float, var: float) -> tuple[float, float]:
    """Variance of the normal cut off at 0; a negative mean becomes 0."""
    sd = var**0.5
    if sd == 0:
        return max(mean, 0.0), var
    a = -mean / sd
    tail = max(1 - float(normal_cdf(a)), 1e-300)
    lam = float(normal_pdf(a)) / tail
    return max(mean, 0.0), var * min(1.0, max(1 + a * lam - lam**2, 0.0))
