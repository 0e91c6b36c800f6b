"""Seasonal decomposition, additive models and lag bases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loess(y: np.ndarray, span: int, degree: int = 1, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression over positions with tricube weights of the `span` nearest."""
    n = len(y)
    x = np.arange(n, dtype=float)
    at = x if at is None else at
    w0 = np.ones(n) if weights is None else weights
    out = np.empty(len(at))
    q = min(span, n)
    for i, v in enumerate(at):
        d = np.abs(x - v)
        h = np.partition(d, q - 1)[q - 1] * (max(span, n) / n if span > n else 1.0)
        w = w0 * np.where(d < max(h, 1e-12) * 1.0000001, (1 - np.minimum(d / max(h, 1e-12), 1) ** 3) ** 3, 0)
        if w.sum() <= 0:
            w = np.where(d == d.min(), 1.0, 0.0)
        m = (w * x).sum() / w.sum()
        s = (w * (x - m) ** 2).sum() / w.sum()
        out[i] = (w * y).sum() / w.sum()
        if degree and s > 1e-9:
            out[i] += (v - m) * (w * (x - m) * y).sum() / w.sum() / s
    return out


def stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low: int | None = None, inner: int = 2, outer: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal, trend and remainder by loess; `outer` rounds weigh outliers down by the bisquare of the remainder."""
    n = len(y)
    trend = trend or int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    low = low or period | 1
    t, weights = np.zeros(n), np.ones(n)
    s = np.zeros(n)
    for round_ in range(outer + 1):
        for _ in range(inner):
            free, cycle = y - t, np.zeros(n + 2 * period)
            for k in range(period):
                own = np.arange(k, n, period)
                if len(own):
                    cycle[k::period][: len(own) + 2] = loess(free[own], seasonal, 1, weights[own], np.arange(-1, len(own) + 1, dtype=float))
            smooth = np.convolve(np.convolve(np.convolve(cycle, np.ones(period) / period, "valid"), np.ones(period) / period, "valid"), np.ones(3) / 3, "valid")
            s = cycle[period : period + n] - loess(smooth, low, 1)[:n]
            t = loess(y - s, trend, 1, weights)
        if round_ < outer:
            r = np.abs(y - s - t)
            weights = (1 - np.minimum(r / max(6 * np.median(r), 1e-12), 1) ** 2) ** 2
    return s, t, y - s - t


def decompose(series: DataFrame, period: int, by: str = "site", **options) -> DataFrame:
    """(…, seasonal, trend, remainder): each series (t, z) by itself, one group each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        if len(pdf) < 2 * period:
            return pdf.assign(seasonal=0.0, trend=pdf["z"].mean(), remainder=pdf["z"] - pdf["z"].mean())
        s, t, r = stl(pdf["z"].to_numpy(float), period, **options)
        return pdf.assign(seasonal=s, trend=t, remainder=r)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema) + ", seasonal double, trend double, remainder double"
    return series.groupBy(by).applyInPandas(run, schema)


def stl_mean(grid: DataFrame, period: int) -> DataFrame:
    """(site, t, m): site mean plus the seasonal and trend parts of the time means, less the grand mean."""
    clean = grid.where("z is not null and not isnan(z)")
    time = decompose(clean.groupBy("t").agg(F.avg("z").alias("z")).withColumn("one", F.lit(1)), period, "one").select("t", (F.col("seasonal") + F.col("trend")).alias("mt"))
    site = clean.groupBy("site").agg(F.avg("z").alias("ms"))
    return clean.select("site", "t").join(site, "site").join(time, "t").crossJoin(F.broadcast(clean.agg(F.avg("z").alias("mg")))).select("site", "t", (F.col("ms") + F.col("mt") - F.col("mg")).alias("m"))  # one row is broadcast


def hinge_basis(column: str, knots: Sequence[float], prefix: str | None = None) -> dict[str, Column]:
    """Cubic hinges (x - knot)+³ and x, x², x³, for additive models."""
    x, name = F.col(column), prefix or f"s_{column}"
    out = {f"{name}_{p}": F.pow(x, float(p)) for p in (1, 2, 3)}
    return out | {f"{name}_k{i}": F.pow(F.greatest(x - float(k), F.lit(0.0)), 3.0) for i, k in enumerate(knots)}


def gam(train: DataFrame, y: str, smooth: Sequence[str], factors: Sequence[str] = (), knots: int = 4, family: str = "gaussian", penalty: float = 1e-3):
    """An additive model y ~ s(smooth) + factor(factors) as a spark.ml pipeline on spline columns; returns predict(df) -> df with `fit`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    places = {c: train.approxQuantile(c, [(i + 1) / (knots + 1) for i in range(knots)], 0.001) for c in smooth}

    def widen(df: DataFrame) -> DataFrame:
        for c in smooth:
            df = df.withColumns({f"__{k}": v for k, v in hinge_basis(c, places[c]).items()})
        return df

    columns = [f"__{k}" for c in smooth for k in hinge_basis(c, places[c])]
    stages = [*(StringIndexer(inputCol=f, outputCol=f"__i_{f}", handleInvalid="keep") for f in factors), *(OneHotEncoder(inputCol=f"__i_{f}", outputCol=f"__o_{f}") for f in factors)]
    stages += [VectorAssembler(inputCols=columns, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True), VectorAssembler(inputCols=["__scaled", *(f"__o_{f}" for f in factors)], outputCol="__x")]
    stages.append(GeneralizedLinearRegression(labelCol=y, featuresCol="__x", family=family, regParam=penalty, predictionCol="fit"))
    model = Pipeline(stages=stages).fit(widen(train))
    return lambda df: model.transform(widen(df)).select(*df.columns, "fit")


def gam_formula(y: str, x: Sequence[str] = (), smooth: Sequence[str] = (), factors: Sequence[str] = (), by: str | None = None) -> str:
    """The formula's text: y ~ x + s(a, by=...) + factor(b)."""
    terms = [*x, *(f"s({c}, by={by})" if by else f"s({c})" for c in smooth), *(f"factor({c})" for c in factors)]
    return f"{y} ~ {' + '.join(terms) if terms else '1'}"


def cross_basis(series: DataFrame, column: str, lags: int, knots: Sequence[float], lag_degree: int = 2, by: str = "site") -> DataFrame:
    """Cross-basis columns cb<i>_<j>: sum over lags l of basis_i(x at t - l) · l**j."""
    w = Window.partitionBy(by).orderBy("t")
    out = series
    for i, (_, f) in enumerate(hinge_basis(column, knots).items()):
        name = f"__b{i}"
        out = out.withColumn(name, f)
        for j in range(lag_degree + 1):
            total = sum((F.coalesce(F.lag(name, lag).over(w), F.lit(0.0)) * float(lag**j) for lag in range(1, lags + 1)), F.col(name) * float(0**j))
            out = out.withColumn(f"cb{i}_{j}", total)
        out = out.drop(name)
    return out
