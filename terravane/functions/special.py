"""Special functions in NumPy, for want of SciPy: normal, Student's t, gamma and Bessel K."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_erf = np.vectorize(math.erf, otypes=[float])
lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_pdf(x, mean=0.0, var=1.0):
    return np.exp(-((np.asarray(x, float) - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)


def normal_cdf(x, mean=0.0, var=1.0):
    return 0.5 * (1 + _erf((np.asarray(x, float) - mean) / np.sqrt(2 * var)))


def normal_quantile(p, mean=0.0, var=1.0):
    """Inverse of normal_cdf: bisection to a bracket, then Newton steps; infinite at 0 and 1."""
    p = np.asarray(p, float)
    z = np.full(p.shape, np.nan)
    inside = (p > 0) & (p < 1)
    tail = np.where(p < 0.5, p, 1 - p)
    with np.errstate(all="ignore"):
        t = np.sqrt(-2 * np.log(np.where(inside, tail, 0.25)))
    guess = t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + 0.04481 * t))
    x = np.where(p < 0.5, -guess, guess)
    for _ in range(4):
        gap = np.where(x < 0, normal_cdf(x) - p, (1 - p) - normal_cdf(-x))
        step = gap / np.maximum(normal_pdf(x), 1e-300)
        x = x - step / (1 + x * step / 2)
    z = np.where(inside, x, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))
    return mean + np.sqrt(var) * z


def erfinv(y):
    return normal_quantile((np.asarray(y, float) + 1) / 2) / math.sqrt(2)


def t_cdf(x: float, df: float) -> float:
    """Student's t by Simpson's rule on the density over the angle x = sqrt(df) tan(a)."""
    a = math.atan2(x, math.sqrt(df))
    grid = np.linspace(-math.pi / 2, a, 4001)
    f = np.cos(grid) ** (df - 1) if df > 1 else np.ones_like(grid)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    h = grid[1] - grid[0]
    return float(scale * h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def bessel_k(nu: float, x):
    """K_nu(x) = integral of exp(-x cosh t) cosh(nu t) over t >= 0, by the trapezoid rule (exact to rounding here)."""
    x = np.asarray(x, float)
    t = np.linspace(0, 40, 8001)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        f = np.exp(-np.maximum(x[..., None], 1e-300) * np.cosh(t) + np.log(np.cosh(np.minimum(nu * t, 700))))
    f = np.nan_to_num(f)
    return (t[1] - t[0]) * (f.sum(axis=-1) - 0.5 * f[..., 0] - 0.5 * f[..., -1])


def normal_pdf_column(x: Column, mean: float = 0.0, var: float = 1.0) -> Column:
    return F.exp(-F.pow(x - mean, 2) / (2 * var)) / math.sqrt(2 * math.pi * var)
