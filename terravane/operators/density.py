"""Maximum-entropy densities from moments, and Gaussian copulas of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from terravane.functions.special import normal_cdf, normal_pdf, normal_quantile


@dataclass(frozen=True)
class MaxEntDensity:
    """exp(sum of multipliers times powers of the standardised variable), on an interval of standard deviations."""

    multipliers: np.ndarray
    mean: float
    sd: float
    nodes: np.ndarray
    weights: np.ndarray
    logs: bool = False

    def __call__(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        if self.logs:
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(x > 0, self._at((np.log(np.maximum(x, 1e-300)) - self.mean) / self.sd) / np.maximum(x, 1e-300), 0.0)
        return self._at((x - self.mean) / self.sd)

    def _at(self, u: np.ndarray) -> np.ndarray:
        log = sum(m * u**k for k, m in enumerate(self.multipliers))
        return np.where((u >= self.nodes[0]) & (u <= self.nodes[-1]), np.exp(log), 0.0) / self.sd

    def cdf(self, n: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and probabilities, 0 and 1 at the ends."""
        u = np.linspace(self.nodes[0], self.nodes[-1], n)
        f = self._at(u) * self.sd
        c = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(u))])
        x = self.mean + self.sd * u
        return (np.exp(x) if self.logs else x), c / c[-1]


def standard_moments(central: Sequence[float]) -> np.ndarray:
    """Moments 0 .. k of the standardised variable from the mean and central moments 2 .. k."""
    sd = central[1] ** 0.5
    return np.array([1.0, 0.0, 1.0, *(m / sd ** (k + 3) for k, m in enumerate(central[2:]))])


def maxent_density(central: Sequence[float], reach: float = 6.0, n: int = 400, logs: bool = False, rounds: int = 200) -> MaxEntDensity:
    """The density of greatest entropy with the given mean and central moments, by Newton steps with backtracking on Gauss-Legendre nodes."""
    goal = standard_moments(central)
    x, w = np.polynomial.legendre.leggauss(n)
    u, w = x * reach, w * reach
    powers = np.vander(u, len(goal), increasing=True)
    scale = np.maximum(np.abs(goal), 1.0)
    mult = np.zeros(len(goal))
    mult[0], mult[2] = -0.5 * np.log(2 * np.pi), -0.5

    def dual(m: np.ndarray) -> float:
        return float((w * np.exp(np.clip(powers @ m, -700, 300))).sum() - m @ goal)

    for _ in range(rounds):
        f = w * np.exp(np.clip(powers @ mult, -700, 300))
        gap = powers.T @ f - goal
        if (np.abs(gap) / scale).max() < 1e-10:
            break
        step = np.linalg.lstsq((powers.T * f) @ powers, gap, rcond=1e-14)[0]
        t, now = 1.0, dual(mult)
        while t > 1e-10 and dual(mult - t * step) > now - 1e-4 * t * (gap @ step):
            t /= 2
        mult = mult - t * step
    return MaxEntDensity(mult, float(central[0]), float(central[1] ** 0.5), u, w, logs)


def sample_moments(z: np.ndarray, order: int = 4, logs: bool = False) -> np.ndarray:
    z = np.log(z) if logs else z
    m = z.mean()
    return np.array([m, *(((z - m) ** k).mean() for k in range(2, order + 1))])


@dataclass(frozen=True)
class PairDensity:
    """Two-variable maximum-entropy density with marginal moments and a cross moment, on a grid of standardised values."""

    grid: np.ndarray
    table: np.ndarray
    means: tuple[float, float]
    sds: tuple[float, float]

    def __call__(self, x, y) -> np.ndarray:
        a, b = (np.asarray(x, float) - self.means[0]) / self.sds[0], (np.asarray(y, float) - self.means[1]) / self.sds[1]
        i, j = (np.clip(np.rint((v - self.grid[0]) / (self.grid[1] - self.grid[0])).astype(int), 0, len(self.grid) - 1) for v in (a, b))
        return self.table[i, j] / (self.sds[0] * self.sds[1])


def maxent_pair(x: np.ndarray, y: np.ndarray, order: int = 4, n: int = 81, reach: float = 5.0) -> PairDensity:
    a, b = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    grid = np.linspace(-reach, reach, n)
    h = grid[1] - grid[0]
    gx, gy = np.meshgrid(grid, grid, indexing="ij")
    terms = [np.ones_like(gx), *(gx**k for k in range(1, order + 1)), *(gy**k for k in range(1, order + 1)), gx * gy]
    goal = np.array([1.0, *((a**k).mean() for k in range(1, order + 1)), *((b**k).mean() for k in range(1, order + 1)), (a * b).mean()])
    p = np.stack([t.ravel() for t in terms], axis=1)
    m = np.zeros(len(goal))
    m[0], m[2], m[order + 2] = -np.log(2 * np.pi), -0.5, -0.5

    def dual(v: np.ndarray) -> float:
        return float(np.exp(np.clip(p @ v, -700, 300)).sum() * h * h - v @ goal)

    for _ in range(200):
        f = np.exp(np.clip(p @ m, -700, 300)) * h * h
        gap = p.T @ f - goal
        if np.abs(gap / np.maximum(np.abs(goal), 1)).max() < 1e-9:
            break
        step = np.linalg.lstsq((p.T * f) @ p, gap, rcond=1e-13)[0]
        t, now = 1.0, dual(m)
        while t > 1e-10 and dual(m - t * step) > now - 1e-4 * t * (gap @ step):
            t /= 2
        m = m - t * step
    return PairDensity(grid, np.exp(p @ m).reshape(n, n), (float(x.mean()), float(y.mean())), (float(x.std()), float(y.std())))


def copula_density(margins: Sequence[MaxEntDensity], r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Joint density at points (n × variables) of a Gaussian copula with correlation r."""
    z, single = [], np.ones(len(x))
    for k, m in enumerate(margins):
        nodes, c = m.cdf()
        z.append(normal_quantile(np.clip(np.interp(x[:, k], nodes, c), 1e-9, 1 - 1e-9)))
        single = single * m(x[:, k])
    z = np.column_stack(z)
    q = np.einsum("ij,jk,ik->i", z, np.linalg.inv(r) - np.eye(len(r)), z)
    return single * np.exp(-0.5 * q) / np.sqrt(np.linalg.det(r))


def conditional_copula_density(margins: Sequence[MaxEntDensity], r: np.ndarray, x: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Density of the first variable at x given the others' values."""
    z = []
    for m, v in zip(margins[1:], given, strict=True):
        nodes, c = m.cdf()
        z.append(float(normal_quantile(np.clip(np.interp(v, nodes, c), 1e-9, 1 - 1e-9))))
    w = np.linalg.solve(r[1:, 1:], r[1:, 0])
    mean, var = float(w @ np.array(z)), float(r[0, 0] - w @ r[1:, 0])
    nodes, c = margins[0].cdf()
    z0 = normal_quantile(np.clip(np.interp(x, nodes, c), 1e-9, 1 - 1e-9))
    return margins[0](x) * normal_pdf(z0, mean, var) / normal_pdf(z0)


def numeric_cdf(pdf, mean: float, sd: float, reach: float = 6.0, n: int = 100) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(mean - reach * sd, mean + reach * sd, n)
    f = pdf(x)
    c = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(x))])
    return x, np.clip(c / c[-1], 0, 1)


__all__ = ["MaxEntDensity", "conditional_copula_density", "copula_density", "maxent_density", "maxent_pair", "normal_cdf", "numeric_cdf", "sample_moments"]
