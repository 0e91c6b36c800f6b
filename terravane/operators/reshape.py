"""Long tables and space-time grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_to_grid(rows: DataFrame, times: Sequence[float] | None = None, sites: DataFrame | None = None) -> DataFrame:
    """One row per site with a column t<i> for each time; duplicates are averaged, gaps are null; optionally at given sites and times."""
    clean = rows.where("z is not null and not isnan(z)")
    times = sorted(r["t"] for r in clean.select("t").distinct().collect()) if times is None else list(times)
    wide = clean.groupBy("x", "y").agg(*(F.avg(F.when(F.col("t") == t, F.col("z"))).alias(f"t{i}") for i, t in enumerate(times)))
    return wide if sites is None else sites.select("x", "y").distinct().join(wide, ["x", "y"], "left")


def mean_by_cell(rows: DataFrame) -> DataFrame:
    """The long form of the grid: means by site and time."""
    return rows.where("z is not null and not isnan(z)").groupBy("x", "y", "t").agg(F.avg("z").alias("z"))


def complete_grid(rows: DataFrame, sites: DataFrame, times: DataFrame) -> DataFrame:
    """Means at the given sites and times, null where there is none."""
    return sites.select("x", "y").distinct().join(times.select("t").distinct(), how="cross").join(mean_by_cell(rows), ["x", "y", "t"], "left")


def grid_to_long(wide: DataFrame, times: Sequence[float]) -> DataFrame:
    """The inverse of long_to_grid, missing cells included."""
    cells = F.array(*(F.struct(F.lit(float(t)).alias("t"), F.col(f"t{i}").alias("z")) for i, t in enumerate(times)))
    return wide.select("x", "y", F.explode(cells).alias("c")).select("x", "y", "c.t", "c.z")


def lookup_grid(raw: DataFrame, grid: DataFrame) -> DataFrame:
    """Each raw row's grid value at its x, y, t; null if absent, or if more than one raw row asks for the cell."""
    alone = raw.groupBy("x", "y", "t").agg(F.count("*").alias("__n"))
    return raw.join(alone, ["x", "y", "t"]).join(grid.select("x", "y", "t", F.col("z").alias("__z")), ["x", "y", "t"], "left").withColumn("z", F.when(F.col("__n") == 1, F.col("__z"))).drop("__n", "__z")
