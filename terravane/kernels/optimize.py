"""Small bounded optimisers in NumPy, for fits to tables of a few bins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def bounded_simplex(f: Callable, x0, low, high, rounds: int = 3000, ftol: float = 1e-10, xtol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Nelder-Mead with points clipped to the box, restarted until it no longer improves."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(x0, float), low, high)
    width = np.where(np.isfinite(high - low), high - low, np.maximum(np.abs(x), 1.0))
    best, used = float(f(x)), 1
    for restart in range(6):
        step = 0.15 * width / (1 + restart)
        points = [x] + [np.clip(x + np.where(np.arange(len(x)) == i, step if x[i] + step[i] <= high[i] else -step, 0), low, high) for i in range(len(x))]
        values = [float(f(p)) for p in points]
        while used < rounds:
            order = np.argsort(values, kind="stable")
            points, values = [points[i] for i in order], [values[i] for i in order]
            if abs(values[-1] - values[0]) <= ftol * (abs(values[0]) + ftol) or np.abs(points[-1] - points[0]).max() <= xtol:
                break
            centre = np.mean(points[:-1], axis=0)

            def at(c: float) -> tuple[np.ndarray, float]:
                p = np.clip(centre + c * (points[-1] - centre), low, high)
                return p, float(f(p))

            p, v = at(-1.0)
            used += 1
            if v < values[0]:
                p2, v2 = at(-2.0)
                used += 1
                p, v = (p2, v2) if v2 < v else (p, v)
            elif v >= values[-2]:
                p2, v2 = at(0.5 if v >= values[-1] else -0.5)
                used += 1
                if v2 < min(v, values[-1]):
                    p, v = p2, v2
                elif v >= values[-1]:
                    points = [points[0]] + [points[0] + 0.5 * (q - points[0]) for q in points[1:]]
                    values = [values[0]] + [float(f(q)) for q in points[1:]]
                    used += len(points) - 1
                    continue
            points[-1], values[-1] = p, v
        i = int(np.argmin(values))
        if best - values[i] <= ftol * (abs(best) + ftol) and restart:
            break
        x, best = points[i], values[i]
    return x, best


def golden(f: Callable[[float], float], low: float, high: float, rounds: int = 80) -> float:
    """The minimiser of a unimodal function."""
    g = (5**0.5 - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def particle_swarm(f: Callable, bounds, goal: str = "min", particles: int = 100, rounds: int = 10, inertia: float = 0.3, social: float = 1.0, own: float = 1.3, seed: int = 0) -> tuple[np.ndarray, float]:
    """Swarm search in a box (low, high); `f` takes one point."""
    rng = np.random.default_rng(seed)
    low, high = np.asarray(bounds[0], float), np.asarray(bounds[1], float)
    sign = 1.0 if goal.startswith("min") else -1.0
    x = rng.uniform(low, high, (particles, len(low)))
    v = np.zeros_like(x)
    best, value = x.copy(), sign * np.array([f(p) for p in x])
    for _ in range(rounds):
        lead = best[value.argmin()]
        v = inertia * v + social * rng.random(x.shape) * (lead - x) + own * rng.random(x.shape) * (best - x)
        x = np.clip(x + v, low, high)
        now = sign * np.array([f(p) for p in x])
        better = now < value
        best[better], value[better] = x[better], now[better]
    i = int(value.argmin())
    return best[i], sign * float(value[i])


def descend(f: Callable, x0: np.ndarray, rounds: int = 200, memory: int = 8, tol: float = 1e-9) -> np.ndarray:
    """Limited-memory BFGS with backtracking; `f` gives value and gradient."""
    x = np.asarray(x0, float).copy()
    value, grad = f(x)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(grad).max(initial=0) < tol:
            break
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(history):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if history:
            s, y, _ = history[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(history, reversed(alphas), strict=True):
            q += (a - rho * (y @ q)) * s
        step, slope = 1.0, grad @ q
        if slope <= 0:
            q, slope, history = grad.copy(), grad @ grad, []
        while step > 1e-12:
            new, (nv, ng) = x - step * q, f(x - step * q)
            if nv <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, ng - grad
        if s @ y > 1e-14:
            history = [*history[-memory + 1 :], (s, y, 1 / (s @ y))]
        if abs(value - nv) <= 1e-15 * (abs(value) + 1e-15):
            x, value, grad = new, nv, ng
            break
        x, value, grad = new, nv, ng
    return x
