"""Randomly shifted rank-1 lattice cubature in base 2.

The generating vector is a Korobov one, z_j = a**j modulo the largest point count, with
its multiplier found here by the worst-case error of order 2 (product weights); so no
table of constants is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np


def bit_reverse(n: int, bits: int) -> np.ndarray:
    """0 .. n-1 with their bits reversed: the radical inverse times 2**bits."""
    out = np.zeros(n, dtype=np.int64)
    k = np.arange(n, dtype=np.int64)
    for _ in range(bits):
        out = (out << 1) | (k & 1)
        k >>= 1
    return out


@lru_cache(maxsize=64)
def generating_vector(dims: int, most: int = 20, tried: int = 48) -> tuple[int, ...]:
    """A Korobov vector for up to 2**most points, chosen by its error on 2**10 of them."""
    n, best = 1 << 10, None
    k = np.arange(n, dtype=np.int64)
    rng = np.random.default_rng(20)
    for a in (rng.integers(1, 1 << (most - 1), tried) * 2 + 1).tolist():
        z, vector = 1, []
        for _ in range(dims):
            vector.append(z)
            z = z * a % (1 << most)
        error = np.ones(n)
        for j, v in enumerate(vector):
            x = (k * (v % n) % n) / n
            error *= 1 + (2 * np.pi**2 * (x * x - x + 1 / 6)) / (j + 1) ** 2
        found = (error.mean() - 1, tuple(vector))
        best = found if best is None or found < best else best
    return best[1]


def lattice(dims: int, start: int, stop: int, most: int = 20) -> np.ndarray:
    """Points start .. stop-1 of the sequence: any first 2**m points are a full lattice."""
    z = np.array(generating_vector(dims, most), dtype=np.int64)
    inverse = bit_reverse(stop, most)[start:stop]
    return (inverse[:, None] * z % (1 << most)) / (1 << most)


def cubature(f: Callable[[np.ndarray], np.ndarray], low, high, shifts: int = 8, least: int = 3, most: int = 15, rel: float = 1e-3, abs_: float = 1e-4, k: float = 2.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Integral over a box of a vector-valued f (points × dims -> points × outputs), its Chebyshev error bound and points used.

    Doubles the lattice until k standard errors over the random shifts are within tolerance.
    """
    low, high = np.atleast_1d(np.asarray(low, float)), np.atleast_1d(np.asarray(high, float))
    dims, volume = len(low), float(np.prod(high - low))
    move = np.random.RandomState(seed).rand(shifts, dims)
    total, start = None, 0
    for m in range(least, most + 1):
        x = lattice(dims, start, 1 << m)
        sums = np.stack([np.atleast_2d(np.asarray(f(low + (high - low) * ((x + s) % 1.0))).reshape(len(x), -1)).sum(axis=0) for s in move])
        total = sums if total is None else total + sums
        start = 1 << m
        each = total * volume / start
        mean = each.mean(axis=0)
        error = k * each.std(axis=0, ddof=1) / np.sqrt(shifts)
        if (error <= np.maximum(abs_, rel * np.abs(mean))).all():
            break
    return mean, error, start * shifts
