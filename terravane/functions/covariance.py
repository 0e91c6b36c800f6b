"""Covariance and variogram models, each as a Spark Column and as a NumPy function.

All ranges are practical ranges: at h = a the exponential model is at exp(-3) of its sill.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions.special import bessel_k


class _Np:
    """The few operations that models need, on arrays."""

    exp, cos, sin, abs = np.exp, np.cos, np.sin, np.abs

    @staticmethod
    def when(cond, yes, no):
        return np.where(cond, yes, no)

    @staticmethod
    def pow(x, p):
        return np.power(x, p)


class _Sql:
    exp, cos, sin, abs = F.exp, F.cos, F.sin, F.abs

    @staticmethod
    def when(cond, yes, no):
        return F.when(cond, F.lit(yes) if not isinstance(yes, Column) else yes).otherwise(no)

    @staticmethod
    def pow(x, p):
        return F.pow(x, F.lit(float(p)))


def _matern(op, h, sill: float, a: float, nu: float):
    """Range scaled as sqrt(12 nu) (3/2)**(1/(4 nu)) h / a; half-integer orders have closed forms."""
    c = math.sqrt(12 * nu) * 1.5 ** (1 / (4 * nu)) / a
    p = round(nu - 0.5)
    if abs(nu - 0.5 - p) < 1e-12 and p >= 0:
        total, x = 0.0, h * c
        for i in range(p + 1):
            total = op.pow(x * 2.0, p - i) * (math.factorial(p + i) / (math.factorial(i) * math.factorial(p - i))) + total
        return op.exp(-x) * total * (sill * math.factorial(p) / math.factorial(2 * p))
    if op is _Sql:
        raise ValueError("Matérn models of other than half-integer order need the NumPy form")
    x = np.asarray(h, float) * c
    safe = np.where(x > 0, x, 1.0)
    return np.where(x > 0, sill * 2 ** (1 - nu) / math.gamma(nu) * safe**nu * bessel_k(nu, safe), sill)


#: name -> f(op, h, *params). C: covariance, V: variogram.
MODELS: dict[str, Callable] = {
    "exponentialC": lambda op, h, s, a: op.exp(h * (-3.0 / a)) * s,
    "gaussianC": lambda op, h, s, a: op.exp(op.pow(h / a, 2) * -3.0) * s,
    "sphericalC": lambda op, h, s, a: op.when(h > a, 0.0, (h * (-1.5 / a) + op.pow(h / a, 3) * 0.5 + 1.0) * s),
    "holecosC": lambda op, h, s, p: op.cos(h * (math.pi / p)) * s,
    "holesinC": lambda op, h, s, p: op.when(h == 0, s, op.sin(h * (math.pi / p)) / (op.when(h == 0, 1.0, h) * (math.pi / p)) * s),
    "nuggetC": lambda op, h, s, *_: op.when(h == 0, s, h * 0.0),
    "mexicanhatC": lambda op, h, s, b, c: (op.pow(h, 2) * -b + 1.0) * op.exp(-op.pow(h * c, 2)) * s,
    "maternC": _matern,
    "nuggetV": lambda op, h, s, *_: op.when(h > 0, s, h * 0.0),
    "exponentialV": lambda op, h, s, a: (1.0 - op.exp(h * (-3.0 / a))) * s,
    "sphericalV": lambda op, h, s, a: op.when(h > a, s, (h * (1.5 / a) - op.pow(h / a, 3) * 0.5) * s),
    "gaussianV": lambda op, h, s, a: (1.0 - op.exp(op.pow(h / a, 2) * -3.0)) * s,
    "holecosV": lambda op, h, s, p: (1.0 - op.cos(h * (math.pi / p))) * s,
    "holesinV": lambda op, h, s, p: op.when(h == 0, 0.0, (1.0 - op.sin(h * (math.pi / p)) / (op.when(h == 0, 1.0, h) * (math.pi / p))) * s),
    "linearV": lambda op, h, b, *_: h * b,
    "powerV": lambda op, h, b, e: op.pow(h, e) * b,
}


def get_model(name: str) -> Callable:
    """The model of this name; `...CST` names are the spatial models on a combined lag."""
    plain = name[:-2] if name.endswith("CST") else name
    if plain not in MODELS:
        raise NameError(f"unknown model {name}")
    return MODELS[plain]


def model_column(name: str, h: Column, *params: float) -> Column:
    return get_model(name)(_Sql, h, *params)


def model_values(name: str, h, *params: float) -> np.ndarray:
    return np.asarray(get_model(name)(_Np, np.asarray(h, float), *params), float)


def model_gradient(name: str, h, params: Sequence[float], second: bool = False) -> np.ndarray:
    """Derivatives of a model in its parameters (a row each), or its second ones, by central differences of step 1e-4 relative."""
    out = []
    for k, p in enumerate(params):
        d = 1e-4 * max(1.0, abs(p))
        up, down = list(params), list(params)
        up[k], down[k] = p + d, p - d
        hi, lo = model_values(name, h, *up), model_values(name, h, *down)
        out.append((hi - 2 * model_values(name, h, *params) + lo) / d**2 if second else (hi - lo) / (2 * d))
    return np.array(out)


def parse_model(name: str) -> tuple[str, str | None]:
    """`aC/bC` is separable (spatial, temporal), `aCST` is non-separable ('ST'), `aC` is spatial (None)."""
    if "/" in name:
        space, time = name.split("/")
        return space, time
    return (name, "ST") if name.endswith("ST") else (name, None)


def isspacetime(names: Sequence[str]) -> tuple[bool, bool, list]:
    """(space-time?, separable?, parsed); kinds must not be mixed."""
    parsed = [parse_model(n) for n in names]
    kinds = {"spatial" if t is None else "non-separable" if t == "ST" else "separable" for _, t in parsed}
    if len(kinds) > 1:
        raise ValueError("spatial, separable and non-separable models can't be mixed")
    kind = kinds.pop() if kinds else "spatial"
    return kind != "spatial", kind == "separable", parsed


@dataclass(frozen=True)
class Structure:
    """One part of a nested model: sill, spatial parameters, and temporal ones or the space-time ratio."""

    model: str
    sill: float
    space: tuple[float, ...] = ()
    time: tuple[float, ...] = ()
    ratio: float = 0.0


def _nested(op, structures: Sequence[Structure], hs, ht=None):
    parts = []
    for s in structures:
        space, time = parse_model(s.model)
        if time is None:
            parts.append(get_model(space)(op, hs, s.sill, *s.space))
        elif time == "ST":
            parts.append(get_model(space)(op, hs + ht * s.ratio, s.sill, *s.space))
        else:
            parts.append(get_model(space)(op, hs, s.sill, *s.space) * get_model(time)(op, ht, 1.0, *s.time))
    return parts


def nested_column(structures: Sequence[Structure], hs: Column, ht: Column | None = None) -> Column:
    return sum(_nested(_Sql, structures, hs, ht)[1:], _nested(_Sql, structures, hs, ht)[0])


def nested_values(structures: Sequence[Structure], hs, ht=None) -> np.ndarray:
    return sum(_nested(_Np, structures, np.asarray(hs, float), None if ht is None else np.asarray(ht, float)))


def nested_parts(structures: Sequence[Structure], hs, ht=None) -> list[np.ndarray]:
    return [np.asarray(p, float) for p in _nested(_Np, structures, np.asarray(hs, float), None if ht is None else np.asarray(ht, float))]


def distance_matrix(a: np.ndarray, b: np.ndarray, p: float = 2) -> np.ndarray:
    return (np.abs(a[:, None, :] - b[None, :, :]) ** p).sum(axis=-1) ** (1 / p)


def covariance_matrix(a: np.ndarray, b: np.ndarray, structures: Sequence[Structure], angle=None, ratio=None) -> np.ndarray:
    """Covariances of points (n × d, the last column time for space-time models); empty sets give empty matrices. Optional geometric anisotropy."""
    st = isspacetime([s.model for s in structures])[0]
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    if not a.size or not b.size:
        return np.zeros((len(a) if a.size else 0, len(b) if b.size else 0))
    sa, sb = (a[:, :-1], b[:, :-1]) if st else (a, b)
    if angle is not None:
        sa, sb = aniso2iso_values(sa, angle, ratio), aniso2iso_values(sb, angle, ratio)
    ht = np.abs(a[:, None, -1] - b[None, :, -1]) if st else None
    return nested_values(structures, distance_matrix(sa, sb), ht)


def split_covariance(sets: Sequence[np.ndarray | None], structures: Sequence[Structure], **aniso) -> list[list[np.ndarray | None]]:
    """Blocks of the covariance between targets, hard and soft points; None for absent sets."""
    return [[None if a is None or b is None else covariance_matrix(a, b, structures, **aniso) for b in sets] for a in sets]


def combine_blocks(blocks: Sequence[Sequence[np.ndarray | None]]) -> np.ndarray:
    rows = [np.hstack([b for b in row if b is not None]) for row in blocks if any(b is not None for b in row)]
    return np.vstack(rows)


def _turns(angle, ratio, dims: int):
    angle, ratio = np.atleast_1d(angle).astype(float), np.atleast_1d(ratio).astype(float)
    a = np.deg2rad(angle)
    turn = np.array([[np.cos(a[0]), np.sin(a[0])], [-np.sin(a[0]), np.cos(a[0])]])
    if dims == 2:
        return turn, np.array([1.0, ratio[0]])
    first = np.eye(3)
    first[:2, :2] = turn
    second = np.array([[np.cos(a[1]), 0, np.sin(a[1])], [0, 1, 0], [-np.sin(a[1]), 0, np.cos(a[1])]])
    return second @ first, np.array([1.0, ratio[0], ratio[1]])


def aniso2iso_values(c: np.ndarray, angle, ratio) -> np.ndarray:
    """Rotates the major axis (degrees from x) to x and stretches the minor ones by 1 / ratio."""
    turn, scale = _turns(angle, ratio, c.shape[1])
    return c @ turn.T / scale


def iso2aniso_values(c: np.ndarray, angle, ratio) -> np.ndarray:
    turn, scale = _turns(angle, ratio, c.shape[1])
    return (c * scale) @ turn


def aniso2iso_columns(x: Column, y: Column, angle: float, ratio: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return x * c + y * s, (y * c - x * s) / ratio


def iso2aniso_columns(x: Column, y: Column, angle: float, ratio: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return x * c - y * ratio * s, x * s + y * ratio * c


def directional_range(a: float, ratio: float, theta: float, axis: float) -> float:
    """The range of an ellipse with major range a along `axis`, in direction theta (radians)."""
    d = theta - axis
    return a * ratio / math.sqrt(ratio**2 * math.cos(d) ** 2 + math.sin(d) ** 2)
