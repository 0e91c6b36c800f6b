"""Local kriging, factorial kriging and cokriging: a kNN join, then batched solves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.covariance import Structure, aniso2iso_values, covariance_matrix, distance_matrix, isspacetime, model_values, nested_parts
from terravane.kernels.linear import solve
from terravane.operators.joins import knn_join, knn_spacetime
from terravane.operators.neighbourhood import gather, matrix, solve_rows


def _is_simple(order: float | None) -> bool:
    return order is None or (isinstance(order, float) and math.isnan(order))


def trend_basis(c: np.ndarray, order: float | None) -> np.ndarray:
    """No columns (simple kriging), ones, or for order 1 and 2 ones and powers of each coordinate."""
    if _is_simple(order):
        return np.zeros((len(c), 0))
    return np.hstack([np.ones((len(c), 1)), *(c**p for p in range(1, int(order) + 1))])


def _systems(ck: np.ndarray, ch: list[np.ndarray], zh: list[np.ndarray], order, cov) -> list[tuple[np.ndarray, ...]]:
    """Weights, covariances to the target and among data, by targets with as many neighbours at once."""
    out: list = [None] * len(ck)
    for n in {len(c) for c in ch}:
        at = [i for i, c in enumerate(ch) if len(c) == n]
        if n == 0:
            continue
        k = np.stack([cov(ch[i], ch[i]) for i in at])
        k0 = np.stack([cov(ch[i], ck[i : i + 1])[:, 0] for i in at])
        f = np.stack([trend_basis(ch[i] - ck[i], order) for i in at])
        f0 = trend_basis(np.zeros((1, ck.shape[1])), order)[0]
        m = f.shape[2]
        big = np.zeros((len(at), n + m, n + m))
        big[:, :n, :n], big[:, :n, n:], big[:, n:, :n] = k, f, f.transpose(0, 2, 1)
        right = np.concatenate([k0, np.broadcast_to(f0, (len(at), m))], axis=1)
        w = solve(big, right[..., None])[..., 0][:, :n]
        for j, i in enumerate(at):
            out[i] = (w[j], k0[j], k[j], big[j])
    return out


def place_means(points: DataFrame, by: Sequence[str] = ("x", "y")) -> DataFrame:
    """(id, *by, z): one row a place with the mean of its values and the smallest of its ids; null and NaN values don't count.

    Collocated data make a kriging system singular, so they meet before it.
    """
    return points.where("z is not null and not isnan(z)").groupBy(*by).agg(F.min("id").alias("id"), F.avg("z").alias("z")).select("id", *by, "z")


def kriging(targets: DataFrame, points: DataFrame, structures: Sequence[Structure], nmax: int, dmax: float | Sequence[float], order: float | None = None, angle=None, ratio=None) -> DataFrame:
    """(k, zk, vk): local simple (order None or NaN, zero mean) or ordinary (0) kriging; targets without neighbours have nulls.

    Space-time models take dmax = (ds, dt, ratio) and a column t. Values that are null or
    NaN don't count as data.
    """
    st = isspacetime([s.model for s in structures])[0]
    dims = ("x", "y", "t") if st else ("x", "y")
    data = points.where("z is not null and not isnan(z)")
    near = knn_spacetime(targets, data, nmax, *dmax) if st else knn_join(targets, data, nmax, dmax)
    rows = targets.select("k", *dims).join(gather(near, [*dims, "z"], "hard"), "k", "left")

    def cov(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return covariance_matrix(a, b, structures, angle, ratio)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ck = pdf[list(dims)].to_numpy(float)
        hard = [matrix(h, [*dims, "z"]) for h in pdf["hard"]]
        found = _systems(ck, [h[:, :-1] for h in hard], [h[:, -1] for h in hard], order, cov)
        zk, vk = np.full(len(ck), np.nan), np.full(len(ck), np.nan)
        for i, s in enumerate(found):
            if s is not None:
                w, k0, k, _ = s
                zk[i] = w @ hard[i][:, -1]
                vk[i] = cov(ck[i : i + 1], ck[i : i + 1])[0, 0] - 2 * w @ k0 + w @ k @ w
        return pd.DataFrame({"k": pdf["k"], "zk": pd.Series(zk).where(~np.isnan(zk), None), "vk": pd.Series(vk).where(~np.isnan(vk), None)})

    return solve_rows(rows, kernel, "k long, zk double, vk double").select("k", F.nanvl("zk", F.lit(None)).alias("zk"), F.nanvl("vk", F.lit(None)).alias("vk"))


def kriging_loocv(points: DataFrame, structures: Sequence[Structure], nmax: int, dmax: float, order: float | None = None) -> DataFrame:
    """(k, z, zk, vk): each point estimated from the others."""
    targets = points.select(F.col("id").alias("k"), "x", "y")
    near = knn_join(targets, points, nmax + 1, dmax).where("k <> id").where(F.col("place") <= nmax + 1)
    rows = targets.join(gather(near, ["x", "y", "z"], "hard"), "k", "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ck = pdf[["x", "y"]].to_numpy(float)
        hard = [matrix(h, ["x", "y", "z"])[:nmax] for h in pdf["hard"]]
        found = _systems(ck, [h[:, :2] for h in hard], [h[:, 2] for h in hard], order, lambda a, b: covariance_matrix(a, b, structures))
        zk = [None if s is None else float(s[0] @ h[:, 2]) for s, h in zip(found, hard, strict=True)]
        c0 = covariance_matrix(ck[:1], ck[:1], structures)[0, 0]
        vk = [None if s is None else float(c0 - 2 * s[0] @ s[1] + s[0] @ s[2] @ s[0]) for s in found]
        return pd.DataFrame({"k": pdf["k"], "zk": zk, "vk": vk})

    return solve_rows(rows, kernel, "k long, zk double, vk double").join(points.select(F.col("id").alias("k"), "z"), "k")


def factorial_kriging(targets: DataFrame, points: DataFrame, structures: Sequence[Structure], nmax: int, dmax: float, order: float | None = 0) -> DataFrame:
    """(k, part, zk): the estimate of each nested structure, and of the mean ('mean'). Targets at one place share one system."""
    places = targets.groupBy("x", "y").agg(F.min("k").alias("k"))
    near = knn_join(places, points, nmax, dmax)
    rows = places.select("k", "x", "y").join(gather(near, ["x", "y", "z"], "hard"), "k")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ck = pdf[["x", "y"]].to_numpy(float)
        hard = [matrix(h, ["x", "y", "z"]) for h in pdf["hard"]]
        found = _systems(ck, [h[:, :2] for h in hard], [h[:, 2] for h in hard], order, lambda a, b: covariance_matrix(a, b, structures))
        out = []
        for i, s in enumerate(found):
            n, big = len(hard[i]), s[3]
            parts = nested_parts(structures, distance_matrix(hard[i][:, :2], ck[i : i + 1])[:, 0])
            right = [np.concatenate([p, np.zeros(len(big) - n)]) for p in parts]
            right.append(np.concatenate([np.zeros(n), np.ones(min(1, len(big) - n)), np.zeros(max(0, len(big) - n - 1))]))
            w = np.linalg.lstsq(big, np.array(right).T, rcond=None)[0][:n]
            names = [f"{j}:{s.model}" for j, s in enumerate(structures)] + ["mean"]
            out.extend((pdf["k"].iloc[i], name, float(w[:, j] @ hard[i][:, 2])) for j, name in enumerate(names))
        return pd.DataFrame(out, columns=["k", "part", "zk"])

    found = solve_rows(rows, kernel, "k long, part string, zk double").withColumnRenamed("k", "first")
    own = targets.select("k", "x", "y").join(places.withColumnRenamed("k", "first"), ["x", "y"])
    return own.join(found, "first").select("k", "part", "zk")


@dataclass(frozen=True)
class Coregion:
    """One structure of a linear model of coregionalisation: model, its spatial parameters, sill matrix."""

    model: str
    space: tuple[float, ...]
    sills: tuple[tuple[float, ...], ...]


def coregion_covariance(a: np.ndarray, va: np.ndarray, b: np.ndarray, vb: np.ndarray, lmc: Sequence[Coregion]) -> np.ndarray:
    h = distance_matrix(a, b)
    return sum(np.array(c.sills)[np.ix_(va, vb)] * model_values(c.model, h, 1.0, *c.space) for c in lmc)


def cokriging(targets: DataFrame, points: DataFrame, lmc: Sequence[Coregion], nmax: int, dmax: float, target_var: int = 0, order: float | None = 0) -> DataFrame:
    """(k, zk, vk): cokriging of one variable from points with a column var; weights of the target's variable sum to 1, of others to 0 (order 0).

    The nmax nearest data of each variable take part.
    """
    near = None
    for v in range(len(lmc[0].sills)):
        part = knn_join(targets, points.where(F.col("var") == v), nmax, dmax).withColumn("place", F.col("place") + v * nmax)
        near = part if near is None else near.unionByName(part)
    rows = targets.select("k", "x", "y").join(gather(near, ["x", "y", "var", "z"], "hard"), "k", "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, x, y, items in zip(pdf["k"], pdf["x"], pdf["y"], pdf["hard"], strict=True):
            h = matrix(items, ["x", "y", "var", "z"])
            if not len(h):
                out.append((key, None, None))
                continue
            c, v, z, c0, v0 = h[:, :2], h[:, 2].astype(int), h[:, 3], np.array([[x, y]]), np.array([target_var])
            k, k0 = coregion_covariance(c, v, c, v, lmc), coregion_covariance(c, v, c0, v0, lmc)[:, 0]
            present = sorted(set(v.tolist())) if not _is_simple(order) else []
            f = np.array([[float(i == j) for j in present] for i in v]).reshape(len(v), len(present))
            f0 = np.array([float(j == target_var) for j in present])
            big = np.block([[k, f], [f.T, np.zeros((len(present), len(present)))]])
            w = np.linalg.lstsq(big, np.concatenate([k0, f0]), rcond=None)[0][: len(v)]
            out.append((key, float(w @ z), float(coregion_covariance(c0, v0, c0, v0, lmc)[0, 0] - 2 * w @ k0 + w @ k @ w)))
        return pd.DataFrame(out, columns=["k", "zk", "vk"])

    return solve_rows(rows, kernel, "k long, zk double, vk double")


def cokriging_transformed(targets: DataFrame, points: DataFrame, lmc: Sequence[Coregion], nmax: int, dmax: float, scores: Sequence, target_var: int = 0, nodes: int = 200) -> DataFrame:
    """(k, yk, vk): values through each variable's normal scores (fitted NormalScore objects), cokriging, and back: mean and variance of the back-transformed normal."""
    from terravane.operators.normalscore import transform_column

    parts = [transform_column(points.where(F.col("var") == v), s, "z") for v, s in enumerate(scores)]
    z = parts[0]
    for p in parts[1:]:
        z = z.unionByName(p)
    found = cokriging(targets, z, lmc, nmax, dmax, target_var)
    score = scores[target_var]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, m, v in zip(pdf["k"], pdf["zk"], pdf["vk"], strict=True):
            out.append((key, *score.back_moments(m, v, nodes)) if m is not None and not np.isnan(m) else (key, None, None))
        return pd.DataFrame(out, columns=["k", "yk", "vk"])

    return solve_rows(found, kernel, "k long, yk double, vk double")


__all__ = ["Coregion", "aniso2iso_values", "cokriging", "cokriging_transformed", "factorial_kriging", "kriging", "kriging_loocv", "place_means", "trend_basis"]
