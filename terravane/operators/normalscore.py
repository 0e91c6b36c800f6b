"""Normal-score transforms by a table of the CDF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.special import normal_cdf, normal_pdf, normal_quantile


@dataclass(frozen=True)
class NormalScore:
    """A CDF table: y strictly rising, f its probabilities."""

    y: np.ndarray
    f: np.ndarray

    def check(self, data: np.ndarray | None = None) -> None:
        """Raises ValueError unless y and f rise strictly, f begins at 0.001 or below and ends at 0.999 or above, and data lie inside."""
        if (np.diff(self.y) <= 0).any() or (np.diff(self.f) <= 0).any():
            raise ValueError("the table must rise strictly")
        if self.f[0] > 0.001 or self.f[-1] < 0.999:
            raise ValueError("the table must cover probabilities from 0.001 to 0.999")
        if data is not None and len(data) and (np.min(data) < self.y[0] or np.max(data) > self.y[-1]):
            raise ValueError("data lie outside the table")

    def forward(self, y) -> np.ndarray:
        y = np.asarray(y, float)
        return np.where((y < self.y[0]) | (y > self.y[-1]), np.nan, normal_quantile(np.interp(y, self.y, self.f)))

    def inverse(self, z) -> np.ndarray:
        return np.interp(normal_cdf(z), self.f, self.y)

    @cached_property
    def _slope(self) -> np.ndarray:
        return np.maximum(np.gradient(self.y, normal_quantile(self.f)), 1e-30)

    def slope(self) -> np.ndarray:
        """dy/dz at the nodes, by central differences, 1e-30 at least."""
        return self._slope

    def density(self, y, z, zpdf) -> np.ndarray:
        """The density of y from one of z = forward(y): f_z / (dy/dz); NaN outside the table."""
        y = np.asarray(y, float)
        inside = (y >= self.y[0]) & (y <= self.y[-1])
        fz = np.interp(self.forward(np.clip(y, self.y[0], self.y[-1])), z, zpdf, left=0, right=0)
        return np.where(inside, fz / np.interp(y, self.y, self.slope()), np.nan)

    def soft_forward(self, kind: int, limi, dens) -> tuple[int, np.ndarray, np.ndarray]:
        """A soft density in scores: limits through the table, densities by dy/dz, area 1. Grid types 3 and 4 are expanded first."""
        limi, dens = np.asarray(limi, float), np.asarray(dens, float)
        if kind in (3, 4):
            limi, kind = np.arange(limi[0], limi[2] + limi[1] / 2, limi[1]), kind - 2
        limi = np.clip(limi, self.y[0], self.y[-1])
        z = np.clip(self.forward(limi), -8, 8)
        if kind == 1:
            mass = dens * np.diff(limi)
            dens = mass / np.maximum(np.diff(z), 1e-12)
            return 1, z, dens / max((dens * np.diff(z)).sum(), 1e-300)
        dens = dens * np.interp(limi, self.y, self.slope())
        return 2, z, dens / max(np.trapezoid(dens, z), 1e-300)

    def back_moments(self, mean: float, var: float, nodes: int = 200) -> tuple[float, float]:
        """Mean and variance of y where z is normal."""
        if not var > 1e-12:
            return float(self.inverse(mean)), 0.0
        p = (np.arange(nodes) + 0.5) / nodes
        y = self.inverse(normal_quantile(p, mean, var))
        return float(y.mean()), float(y.var())


def cdf_table(points: DataFrame, column: str = "z", nodes: int = 1000, eps: float = 1e-4) -> DataFrame:
    """(y, f): distinct quantiles at `nodes` probabilities in [eps, 1 - eps]."""
    probs = np.linspace(eps, 1 - eps, nodes).tolist()
    row = points.agg(F.percentile(column, F.array(*map(F.lit, probs))).alias("q"))
    pairs = row.select(F.explode(F.arrays_zip("q", F.array(*map(F.lit, probs)).alias("f"))).alias("p")).select(F.col("p.q").alias("y"), F.col("p.f").alias("f"))
    return pairs.groupBy("y").agg(F.max("f").alias("f"))


def fit(points: DataFrame, column: str = "z", nodes: int = 1000, eps: float = 1e-4) -> NormalScore:
    """The transform from a table of at most `nodes` rows; its ends take the least and greatest value."""
    pdf = cdf_table(points, column, nodes, eps).toPandas().sort_values("y")
    return NormalScore(pdf["y"].to_numpy(), pdf["f"].to_numpy())


def transform_column(df: DataFrame, score: NormalScore, column: str, inverse: bool = False) -> DataFrame:
    """The column through the transform; outside the table it becomes null."""
    schema = df.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = (score.inverse if inverse else score.forward)(pdf[column].to_numpy(float))
            yield pdf.assign(**{column: v})

    return df.mapInPandas(run, schema).withColumn(column, F.when(~F.isnan(column), F.col(column)))


__all__ = ["NormalScore", "cdf_table", "fit", "normal_pdf", "transform_column"]
