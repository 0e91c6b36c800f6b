"""Bayesian maximum entropy on tables: two kNN joins, then the posterior kernel on batches of rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.covariance import Structure, covariance_matrix, isspacetime
from terravane.kernels.linear import pivoted_selection
from terravane.kernels.posterior import BmeOptions, Mixture, SoftDatum, nonnegative, posterior
from terravane.operators.joins import knn_join
from terravane.operators.neighbourhood import gather, matrix, solve_rows
from terravane.operators.normalscore import NormalScore


def _near(targets: DataFrame, data: DataFrame, nmax: int, dmax: float | Sequence[float], st: bool) -> DataFrame:
    """Space-time: time is an axis scaled by the ratio, and one Euclidean radius holds."""
    if not st:
        return knn_join(targets, data, nmax, dmax)
    ds, dt, ratio = dmax
    scale = F.col("t") * ratio
    return knn_join(targets.withColumn("__ts", scale), data.withColumn("__ts", scale), nmax, math.hypot(ds, ratio * dt), ("x", "y", "__ts")).drop("__ts")


def soft_datum(item) -> SoftDatum:
    s = item["soft"]
    if s["type"] == 10:
        return SoftDatum(10, mean=float(s["mean"]), var=float(s["var"]))
    limi, kind = np.array(s["limi"], float), int(s["type"])
    if kind in (3, 4):
        limi, kind = np.arange(limi[0], limi[2] + limi[1] / 2, limi[1]), kind - 2
    return SoftDatum(kind, limi, np.array(s["probdens"], float))


def bme(
    targets: DataFrame, hard: DataFrame | None, soft: DataFrame | None, structures: Sequence[Structure], nhmax: int, nsmax: int, dmax: float | Sequence[float],
    emit: Callable[[int, Mixture | None], list[tuple]], schema: str, order: float | None = None, options: BmeOptions = BmeOptions(), prior: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Runs the posterior kernel for every target (k, x, y[, t]) and emits rows from each.

    hard: (id, x, y[, t], z); soft: (id, x, y[, t], soft) with soft(type, limi, probdens)
    or soft(type 10, mean, var). order None or NaN: zero mean; 0: the mean of the
    neighbourhood's hard values and soft means. `prior` names mean columns of the three
    tables instead. Targets without any neighbour have the prior alone.
    """
    st = isspacetime([s.model for s in structures])[0]
    dims = ["x", "y", "t"] if st else ["x", "y"]
    shared = None if prior else targets.groupBy(F.struct(*dims).alias("__p")).agg(F.min("k").alias("__k"))
    all_targets = targets
    if shared is not None:  # targets at one place have one posterior
        targets = shared.select(F.col("__k").alias("k"), "__p.*")
    rows = targets.select("k", *dims, *([prior[0]] if prior else []))
    if hard is not None and nhmax:
        extra = [prior[1]] if prior else []
        rows = rows.join(gather(_near(targets, hard.select("id", *dims, "z", *extra), nhmax, dmax, st), [*dims, "z", *extra], "hard"), "k", "left")
    if soft is not None and nsmax:
        extra = [prior[2]] if prior else []
        rows = rows.join(gather(_near(targets, soft.select("id", *dims, "soft", *extra), nsmax, dmax, st), [*dims, "soft", *extra], "soft_data"), "k", "left")
    local = not (order is None or (isinstance(order, float) and math.isnan(order)))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            ck = np.array([[row[d] for d in dims]], float)
            h = matrix(row.get("hard"), [*dims, "z", *([prior[1]] if prior else [])])
            items = row.get("soft_data")
            items = [] if items is None or (isinstance(items, float)) else list(items)
            s = matrix(items, [*dims, *([prior[2]] if prior else [])])
            ch, zh, cs, data = h[:, : len(dims)], h[:, len(dims)], s[:, : len(dims)], [soft_datum(i) for i in items]

            def cov(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return covariance_matrix(a, b, structures) if len(a) and len(b) else np.zeros((len(a), len(b)))

            mean: tuple = (0.0, 0.0, 0.0)
            if prior:
                mean = (row[prior[0]], h[:, -1], s[:, -1])
            elif local and (len(zh) or data):
                m = float(np.mean([*zh, *(d.moments()[0] for d in data)]))
                mean = (m, m, m)
            found = posterior(cov(ck, ck)[0, 0], cov(ck, ch)[0], cov(ck, cs)[0], cov(ch, ch), cov(ch, cs), cov(cs, cs), zh, data, mean, options)
            out.extend(emit(row["k"], found))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    found = solve_rows(rows, kernel, schema)
    if shared is None:
        return found
    own = all_targets.select("k", F.struct(*dims).alias("__p")).join(shared, "__p").select("k", "__k")
    return own.join(found.withColumnRenamed("k", "__k"), "__k").select("k", *found.columns[1:])


def bme_moments(targets, hard, soft, structures, nhmax, nsmax, dmax, order=None, options: BmeOptions = BmeOptions(), **more) -> DataFrame:
    """(k, mean, var, skew)."""

    def emit(k, f):
        m, v, s = f.moments()
        return [(k, *(nonnegative(m, v) if options.nonneg else (m, v)), s)]

    return bme(targets, hard, soft, structures, nhmax, nsmax, dmax, emit, "k long, mean double, var double, skew double", order, options, **more)


def bme_pdf(targets, hard, soft, structures, nhmax, nsmax, dmax, order=None, options: BmeOptions = BmeOptions(), nodes: int = 200, grid: Sequence[float] | None = None, **more) -> DataFrame:
    """(k, i, z, density): on ±4 deviations about each mean, or on a given grid."""

    def emit(k, f):
        z = f.grid(nodes) if grid is None else np.asarray(grid, float)
        return list(zip([k] * len(z), range(len(z)), z.tolist(), f.density(z).tolist(), strict=True))

    return bme(targets, hard, soft, structures, nhmax, nsmax, dmax, emit, "k long, i int, z double, density double", order, options, **more)


def bme_mode(targets, hard, soft, structures, nhmax, nsmax, dmax, order=None, options: BmeOptions = BmeOptions(), **more) -> DataFrame:
    """(k, mode)."""
    return bme(targets, hard, soft, structures, nhmax, nsmax, dmax, lambda k, f: [(k, f.mode())], "k long, mode double", order, options, **more)


def bme_quantiles(targets, hard, soft, structures, nhmax, nsmax, dmax, order=None, options: BmeOptions = BmeOptions(), levels: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9), **more) -> DataFrame:
    """(k, q, z)."""
    return bme(targets, hard, soft, structures, nhmax, nsmax, dmax, lambda k, f: [(k, q, f.quantile(q)) for q in levels], "k long, q double, z double", order, options, **more)


def bme_intervals(targets, hard, soft, structures, nhmax, nsmax, dmax, order=None, options: BmeOptions = BmeOptions(), levels: Sequence[float] = (0.68,), **more) -> DataFrame:
    """(k, level, low, high, low_density, high_density): equal tails."""

    def emit(k, f):
        out = []
        for p in levels:
            low, high = f.quantile((1 - p) / 2), f.quantile((1 + p) / 2)
            out.append((k, p, low, high, *f.density(np.array([low, high])).tolist()))
        return out

    return bme(targets, hard, soft, structures, nhmax, nsmax, dmax, emit, "k long, level double, low double, high double, low_density double, high_density double", order, options, **more)


def score_soft(soft: DataFrame, score: NormalScore) -> DataFrame:
    """Soft data in normal scores."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        def one(s):
            kind, limi, dens = score.soft_forward(s["type"], s["limi"], s["probdens"])
            return {"type": kind, "limi": limi.tolist(), "probdens": dens.tolist()}

        return pdf.assign(soft=[one(s) for s in pdf["soft"]])

    return solve_rows(soft.select("id", "x", "y", "soft"), kernel, "id long, x double, y double, soft struct<type:int,limi:array<double>,probdens:array<double>>")


def bme_transformed(targets, hard, soft, structures, nhmax, nsmax, dmax, score: NormalScore, levels: Sequence[float] = (0.95,), order=None, options: BmeOptions = BmeOptions()) -> DataFrame:
    """(k, mode, level, low, high) in the original scale: data through normal scores, posterior there, its mode and bounds back."""
    from terravane.operators.normalscore import transform_column

    zhard = transform_column(hard, score, "z").where("z is not null") if hard is not None else None
    zsoft = score_soft(soft, score) if soft is not None else None

    def emit(k, f):
        return [(k, float(score.inverse(f.mode())), p, *(float(score.inverse(f.quantile(q))) for q in ((1 - p) / 2, (1 + p) / 2))) for p in levels]

    return bme(targets, zhard, zsoft, structures, nhmax, nsmax, dmax, emit, "k long, mode double, level double, low double, high double", order, options)


def bme_transformed_pdf(targets, hard, soft, structures, nhmax, nsmax, dmax, score: NormalScore, grid: Sequence[float], order=None, options: BmeOptions = BmeOptions()) -> DataFrame:
    """(k, i, y, density) in the original scale; 0 outside the table."""
    from terravane.operators.normalscore import transform_column

    y = np.asarray(grid, float)

    def emit(k, f):
        z = f.grid(400, 8.0)
        dens = np.nan_to_num(score.density(y, z, f.density(z)))
        return list(zip([k] * len(y), range(len(y)), y.tolist(), dens.tolist(), strict=True))

    zhard = transform_column(hard, score, "z").where("z is not null") if hard is not None else None
    return bme(targets, zhard, score_soft(soft, score) if soft is not None else None, structures, nhmax, nsmax, dmax, emit, "k long, i int, y double, density double", order, options)


def bme_covmat(covmat: np.ndarray, nk: int, zh: np.ndarray, soft: Sequence[SoftDatum], nhmax: int, nsmax: int, options: BmeOptions = BmeOptions()) -> np.ndarray:
    """Moments (nk × 3) from a given covariance of targets, hard and soft points, in this order; neighbours are those of largest covariance, thinned where they repeat each other.

    The matrix is a driver-side array: some thousands of points.
    """
    nh, out = len(zh), np.zeros((nk, 3))
    for k in range(nk):
        h, s = nk + np.arange(nh), nk + nh + np.arange(len(soft))
        h = h[np.argsort(-np.abs(covmat[k, h]), kind="stable")[: 4 * nhmax]]
        s = s[np.argsort(-np.abs(covmat[k, s]), kind="stable")[: 4 * nsmax]]
        h = h[sorted(pivoted_selection(covmat[np.ix_(h, h)], covmat[k, h] ** 2, nhmax))] if len(h) else h
        s = s[sorted(pivoted_selection(covmat[np.ix_(s, s)], covmat[k, s] ** 2, nsmax))] if len(s) else s
        found = posterior(covmat[k, k], covmat[k, h], covmat[k, s], covmat[np.ix_(h, h)], covmat[np.ix_(h, s)], covmat[np.ix_(s, s)], zh[h - nk], [soft[i - nk - nh] for i in s], options=options)
        out[k] = found.moments()
    return out
