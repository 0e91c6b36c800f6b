"""Fields and series: Gram matrices by Spark, decompositions of them on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gram(field: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(i, j, g) = sum over rows of products of columns of long fields (r, c, v); within one field i <= j."""
    two = field if other is None else other
    rows = field.alias("a").join(two.alias("b"), F.col("a.r") == F.col("b.r"))
    rows = rows.where(F.col("a.c") <= F.col("b.c")) if other is None else rows
    return rows.groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("g"))


def covariance(field: DataFrame) -> DataFrame:
    """(i, j, cov), i <= j: sample covariances of columns."""
    rows = field.alias("a").join(field.alias("b"), (F.col("a.r") == F.col("b.r")) & (F.col("a.c") <= F.col("b.c")))
    return rows.groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.covar_samp("a.v", "b.v").alias("cov"))


def standardise(field: DataFrame, norm: int = 0) -> DataFrame:
    """0: columns centred; 1: also scaled to unit deviation; 2: scaled to [0, 1]."""
    s = field.groupBy("c").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = {0: F.col("v") - F.col("m"), 1: (F.col("v") - F.col("m")) / F.col("s"), 2: (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))}[norm]
    return field.join(s, "c").select("r", "c", v.alias("v"))


def matrix_of(pairs: DataFrame, n: int, m: int | None = None, value: str = "g") -> np.ndarray:
    """A Gram matrix on the driver: columns squared, not rows."""
    out = np.zeros((n, m or n))
    for r in pairs.collect():
        out[r["i"], r["j"]] = r[value]
        if m is None:
            out[r["j"], r["i"]] = r[value]
    return out


def columns_of(field: DataFrame) -> int:
    return int(field.agg(F.max("c")).first()[0]) + 1


def project(field: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(r, k, v): rows of a long field times a small matrix (columns × k)."""
    rows = [(i, k, float(vectors[i, k])) for i in range(vectors.shape[0]) for k in range(vectors.shape[1])]
    small = field.sparkSession.createDataFrame(rows, "c long, k int, w double")
    return field.join(F.broadcast(small), "c").groupBy("r", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def eof(field: DataFrame, n: int | None = None, norm: int = 0) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Variances, patterns (columns × n, the largest entry of each positive) and expansion coefficients (r, k, v) of a long field."""
    centred = standardise(field, norm)
    size, rows = columns_of(field), field.select("r").distinct().count()
    value, vector = np.linalg.eigh(matrix_of(gram(centred), size) / (rows - 1))
    order = np.argsort(-value, kind="stable")[: n or size]
    vector = _signed(vector[:, order])
    return value[order], vector, project(centred, vector)


pca = eof


def explained_rank(values: np.ndarray, share: float = 0.9) -> int:
    """How many patterns explain more than a share of the variance."""
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share, side="right") + 1)


def eof_mean(field: DataFrame, share: float = 0.9) -> DataFrame:
    """(r, c, v): the field rebuilt from as many patterns as explain the share."""
    values, vectors, _ = eof(field)
    k = min(explained_rank(values, share), len(values))
    small = [(i, c, float((vectors[:, :k] @ vectors[:, :k].T)[i, c])) for i in range(len(vectors)) for c in range(len(vectors))]
    spark = field.sparkSession
    w = spark.createDataFrame(small, "c long, d long, w double")
    mean = field.groupBy("c").agg(F.avg("v").alias("m"))
    rebuilt = standardise(field).join(F.broadcast(w), "c").groupBy("r", "d").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return rebuilt.join(mean.withColumnRenamed("c", "d"), "d").select("r", F.col("d").alias("c"), (F.col("v") + F.col("m")).alias("v"))


def lag_embedding(field: DataFrame, window: int) -> DataFrame:
    """Columns of `window` successive rows side by side, for extended EOF; r counts rows in time order."""
    size = columns_of(field)
    shifted = field.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    rows = shifted.select((F.col("r") - F.col("s")).alias("r"), (F.col("s") * size + F.col("c")).alias("c"), "v")
    whole = Window.partitionBy("r")  # columns × window cells
    return rows.withColumn("__n", F.count("*").over(whole)).where(F.col("__n") == size * window).drop("__n")


def extended_eof(field: DataFrame, window: int, n: int | None = None, rotate: bool = True) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    values, vectors, scores = eof(lag_embedding(field, window), n)
    return (values, varimax(vectors), scores) if rotate else (values, vectors, scores)


def varimax(loadings: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Rotates columns to the largest variance of squared loadings; the largest entry of each is positive."""
    p, k = loadings.shape
    turn, last = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).sum(axis=0) / p))
        turn = u @ v
        if s.sum() <= last * (1 + tol):
            break
        last = s.sum()
    return _signed(loadings @ turn)


def rotated_eof(field: DataFrame, n: int, norm: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Varimax-rotated patterns of the first n, scaled by their deviations, and their variances."""
    values, vectors, _ = eof(field, n, norm)
    turned = varimax(vectors * np.sqrt(values))
    return (turned**2).sum(axis=0), turned


def stack_fields(fields: Sequence[DataFrame]) -> DataFrame:
    """Several fields side by side, for multi-field EOF."""
    out, at = None, 0
    for f in fields:
        part = f.withColumn("c", F.col("c") + at)
        at += columns_of(f)
        out = part if out is None else out.unionByName(part)
    return out


def mca(x: DataFrame, y: DataFrame, n: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame, DataFrame]:
    """Singular values, left and right patterns of the cross-covariance of two fields, and both expansion coefficients."""
    a, b = standardise(x), standardise(y)
    rows = x.select("r").distinct().count()
    u, s, vt = np.linalg.svd(matrix_of(gram(a, b), columns_of(x), columns_of(y)) / (rows - 1), full_matrices=False)
    sign = np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    u, v = (u * sign)[:, :n], (vt.T * sign)[:, :n]
    return s[:n], u, v, project(a, u), project(b, v)


def regression_map(field: DataFrame, scores: DataFrame, k: int = 0) -> DataFrame:
    """(c, beta): regression of each column on a standardised expansion coefficient: homogeneous with the field's own, heterogeneous with the other's."""
    s = scores.where(F.col("k") == k).select("r", F.col("v").alias("s"))
    return field.join(s, "r").groupBy("c").agg((F.covar_samp("v", "s") / F.stddev_samp("s")).alias("beta"))


def cca(x: DataFrame, y: DataFrame, n: int = 2, ridge: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical correlations and weights of two fields."""
    a, b = standardise(x), standardise(y)
    p, q = columns_of(x), columns_of(y)
    xx, yy, xy = matrix_of(gram(a), p), matrix_of(gram(b), q), matrix_of(gram(a, b), p, q)
    lx, ly = (np.linalg.cholesky(m + ridge * np.trace(m) / len(m) * np.eye(len(m))) for m in (xx, yy))
    u, s, vt = np.linalg.svd(np.linalg.solve(lx, xy) @ np.linalg.inv(ly).T)
    return s[:n], np.linalg.solve(lx.T, u[:, :n]), np.linalg.solve(ly.T, vt.T[:, :n])


def fast_ica(scores: np.ndarray, n: int, seed: int = 0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Independent components (rows × n) and the unmixing matrix, by the symmetric fixed point of log cosh on whitened scores."""
    x = scores - scores.mean(axis=0)
    value, vector = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-value)[:n]
    white = vector[:, order] / np.sqrt(value[order])
    z = x @ white
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g**2).mean(axis=0)) @ w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-9
        w = new
        if done:
            break
    return z @ w.T, w @ white.T


def unfold(tensor: DataFrame, shape: Sequence[int], mode: int) -> DataFrame:
    """Mode-n matrix (r, c, v) of a long tensor (i0, i1, ..., v): other indices in order, the first fastest."""
    others = [m for m in range(len(shape)) if m != mode]
    c, step = F.lit(0).cast("long"), 1
    for m in others:
        c, step = c + F.col(f"i{m}") * step, step * shape[m]
    return tensor.select(F.col(f"i{mode}").cast("long").alias("r"), c.alias("c"), "v")


def fold(matrix: DataFrame, shape: Sequence[int], mode: int) -> DataFrame:
    """The inverse of unfold."""
    others, step, columns = [m for m in range(len(shape)) if m != mode], 1, {f"i{mode}": F.col("r")}
    for m in others:
        columns[f"i{m}"] = F.floor(F.col("c") / step) % shape[m]
        step *= shape[m]
    return matrix.select(*(columns[f"i{m}"].cast("long").alias(f"i{m}") for m in range(len(shape))), "v")


def tensor_times_matrix(tensor: DataFrame, matrix: DataFrame, dims: int, mode: int) -> DataFrame:
    """Mode product with a matrix (r, c, v): index `mode` meets its columns."""
    m = matrix.select(F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("v").alias("__u"))
    keys = [F.col("__r").alias(f"i{k}") if k == mode else F.col(f"i{k}") for k in range(dims)]
    return tensor.join(m, F.col(f"i{mode}") == F.col("__c")).groupBy(*keys).agg(F.sum(F.col("v") * F.col("__u")).alias("v"))


def permute(tensor: DataFrame, order: Sequence[int], inverse: bool = False) -> DataFrame:
    pairs = [(o, n) if not inverse else (n, o) for n, o in enumerate(order)]
    return tensor.select(*(F.col(f"i{o}").alias(f"i{n}") for o, n in sorted(pairs, key=lambda p: p[1])), "v")


def hosvd(tensor: DataFrame, shape: Sequence[int]) -> tuple[list[np.ndarray], DataFrame]:
    """Factor matrices of each mode and the core tensor; modes are small, the tensor may be long."""
    spark, factors, core = tensor.sparkSession, [], tensor
    for mode, size in enumerate(shape):
        m = unfold(tensor, shape, mode)
        rows = gram(m.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"))
        _, vector = np.linalg.eigh(matrix_of(rows, size))
        factors.append(_signed(vector[:, ::-1]))
        u = spark.createDataFrame([(k, i, float(factors[-1][i, k])) for i in range(size) for k in range(size)], "r long, c long, v double")
        core = tensor_times_matrix(core, F.broadcast(u), len(shape), mode)
    return factors, core


def eof_class(patterns: DataFrame, seed: int = 0) -> DataFrame:
    """(…, cls): a two-component Gaussian mixture of a pattern's values (column v)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["v"], outputCol="__f").transform(patterns)
    return GaussianMixture(k=2, featuresCol="__f", predictionCol="cls", seed=seed).fit(data).transform(data).drop("__f", "probability")


def moments(rows: DataFrame, column: str, order: int = 4) -> DataFrame:
    """Mean and central moments 2 .. order: one row."""
    m = rows.agg(F.avg(column).alias("m"))
    gaps = rows.crossJoin(F.broadcast(m))  # one row is broadcast
    return gaps.agg(F.first("m").alias("m1"), *(F.avg(F.pow(F.col(column) - F.col("m"), float(k))).alias(f"m{k}") for k in range(2, order + 1)))


def kalman_series(series: DataFrame, q: float, r: float, x0: float, p0: float, by: str = "site") -> DataFrame:
    """(…, xf, pf): a scalar random-walk filter along t in each series; a series is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, p, out = pdf.sort_values("t"), x0, p0, []
        for z in pdf["z"]:
            p += q
            if z == z:
                gain = p / (p + r)
                x, p = x + gain * (z - x), (1 - gain) * p
            out.append((x, p))
        return pdf.assign(xf=[a for a, _ in out], pf=[b for _, b in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema) + ", xf double, pf double"
    return series.groupBy(by).applyInPandas(run, schema)
