"""Dense linear algebra of neighbourhoods, batched, and orthogonalisation."""

from __future__ import annotations

import numpy as np


def stable_cholesky(k: np.ndarray) -> np.ndarray:
    """Lower factor, with growing jitter (relative to the mean diagonal) where the matrix isn't positive definite."""
    scale = float(np.mean(np.diag(k))) if len(k) else 1.0
    for jitter in (0.0, *(10.0**e for e in range(-12, 0))):
        try:
            return np.linalg.cholesky(k + jitter * scale * np.eye(len(k)))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("not positive definite")


def solve(k: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a stack of symmetric systems; by least squares where one is singular."""
    try:
        return np.linalg.solve(k, b)
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(m, r, rcond=None)[0] for m, r in zip(k, b, strict=True)])


def gram_schmidt(x: np.ndarray, rows: bool = True, normalise: bool = True) -> np.ndarray:
    v = np.array(x if rows else x.T, float)
    for i in range(len(v)):
        for j in range(i):
            v[i] -= v[j] * (v[j] @ v[i]) / (v[j] @ v[j])
    if normalise:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v if rows else v.T


def weighted_qr(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """q, r with x = q r and qᵀ diag(weights) q = I."""
    w = np.sqrt(np.ones(len(x)) if weights is None else np.asarray(weights, float))
    q, r = np.linalg.qr(x * w[:, None])
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign / w[:, None], r * sign[:, None]


def project_psd(m: np.ndarray, floor: float = 0.0) -> np.ndarray:
    value, vector = np.linalg.eigh((m + m.T) / 2)
    return (vector * np.maximum(value, floor)) @ vector.T


def pivoted_selection(k: np.ndarray, relevance: np.ndarray, n: int, least: float = 1e-8) -> list[int]:
    """Greedy choice of n points by relevance times the variance that chosen ones leave (pivoted Cholesky)."""
    rest, factor, chosen = np.diag(k).astype(float).copy(), np.zeros((0, len(k))), []
    top = rest.max(initial=0)
    while len(chosen) < min(n, len(k)):
        gain = np.where(np.isin(np.arange(len(k)), chosen), -np.inf, relevance * rest)
        i = int(gain.argmax())
        if rest[i] <= least * top:
            break
        row = (k[i] - factor[:, i] @ factor) / np.sqrt(rest[i])
        factor = np.vstack([factor, row])
        rest = np.maximum(rest - row**2, 0)
        chosen.append(i)
    return chosen


def gaussian_condition(k_tt: np.ndarray, k_td: np.ndarray, k_dd: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean shift and covariance of targets given data gaps from their mean."""
    if not len(gap):
        return np.zeros(len(k_tt)), k_tt
    w = np.linalg.lstsq(k_dd, k_td.T, rcond=None)[0].T if np.linalg.cond(k_dd) > 1e14 else np.linalg.solve(k_dd, k_td.T).T
    return w @ gap, k_tt - w @ k_td.T


def kalman_gain(p: np.ndarray, h: np.ndarray, r: np.ndarray) -> np.ndarray:
    return p @ h.T @ np.linalg.pinv(h @ p @ h.T + r)


def kalman_update(x: np.ndarray, p: np.ndarray, d: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = kalman_gain(p, h, r)
    return x + k @ (d - h @ x), (np.eye(len(p)) - k @ h) @ p
