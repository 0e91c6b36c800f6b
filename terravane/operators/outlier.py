"""Outlier tests over groups, time windows and neighbourhoods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.joins import knn_join, nearest_cells, spacetime_join


def zscores(rows: DataFrame, by: str = "site") -> DataFrame:
    """(…, zscore) with sample deviations of each group; a missing or zero deviation counts as 1."""
    stats = rows.groupBy(by).agg(F.avg("z").alias("__m"), F.stddev_samp("z").alias("__s"))
    sd = F.when(F.col("__s").isNull() | F.isnan("__s") | (F.col("__s") == 0), 1.0).otherwise(F.col("__s"))
    return rows.join(stats, by).withColumn("zscore", (F.col("z") - F.col("__m")) / sd).drop("__m", "__s")


def spatial_outliers(points: DataFrame, radius: float, nmax: int = 100, power: float = 1.5, k: float = 3.0) -> DataFrame:
    """(id, n, outlier): whether |z - IDW| is above k population deviations of the nmax nearest within the radius (self included in the deviation, not in the IDW); a single place is no outlier."""
    places = points.select(F.struct("x", "y").alias("k"), "x", "y").distinct()  # the points of a place share their neighbourhood
    near = knn_join(places, points, nmax, radius)
    w = F.when(F.col("d") > 0, 1 / F.pow(F.greatest(F.col("d"), F.lit(1e-300)), power)).otherwise(0.0)
    rows = near.groupBy("k").agg(F.count("*").alias("n"), F.stddev_pop("z").alias("sd"), F.sum(w * F.col("z")).alias("wz"), F.sum(w).alias("sw"))
    rows = points.select("id", F.struct("x", "y").alias("k"), F.col("z").alias("own")).join(rows, "k")
    return rows.select("id", "n", F.when(F.col("sw") == 0, False).otherwise(F.abs(F.col("own") - F.try_divide(F.col("wz"), F.col("sw"))) > k * F.col("sd")).alias("outlier"))


def window_outliers(rows: DataFrame, bucket: float, bandwidth: float, k: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """One pass over (…, t, z): per bucket of length `bucket`, mean and population deviation of values in [start - bandwidth, end); adds outlier = |z - mean| > k sd.

    Counts, sums and squares per bucket slide over a window of whole buckets, so bandwidths are multiples of buckets.
    """
    steps = round(bandwidth / bucket)
    keyed = rows.withColumn("__b", F.floor(F.col("t") / bucket))
    sums = keyed.groupBy(*by, "__b").agg(F.count("z").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    slide = Window.partitionBy(*by).orderBy("__b").rangeBetween(-steps, 0)
    sums = sums.select(*by, "__b", *(F.sum(c).over(slide).alias(f"__{c}") for c in ("n", "s", "q")))
    mean = F.col("__s") / F.col("__n")
    sd = F.sqrt(F.greatest(F.col("__q") / F.col("__n") - mean * mean, F.lit(0.0)))
    return keyed.join(sums, [*by, "__b"]).withColumn("outlier", F.abs(F.col("z") - mean) > k * sd).drop("__b", "__n", "__s", "__q")


def sequential_outliers(rows: DataFrame, bucket: float, bandwidth: float, by: str = "site", k: float = 3.0, most: int = 100) -> DataFrame:
    """The same with memory: buckets in order, values flagged earlier leave later windows, and windows grow by the bandwidth until `most` values are in or the data ends. One series is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        t, z = pdf["t"].to_numpy(), pdf["z"].to_numpy()
        bad = pd.Series(False, index=pdf.index).to_numpy()
        for b in sorted(set((t // bucket).tolist())):
            inside = t // bucket == b
            reach = bandwidth
            while True:
                seen = (t >= b * bucket - reach) & (t < (b + 1) * bucket) & ~bad
                if seen.sum() >= min(most, len(t)) or b * bucket - reach <= t[0]:
                    break
                reach += bandwidth
            if seen.sum() > 1:
                bad |= inside & (abs(z - z[seen].mean()) > k * z[seen].std())
        return pdf.assign(outlier=bad)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", outlier boolean"
    return rows.groupBy(by).applyInPandas(run, schema)


def spacetime_outliers(grid: DataFrame, radius: float, nmax: int, bucket: float, bandwidth: float, k: float = 3.0) -> DataFrame:
    """(site, t, outlier): by the spatial test at each time and by the temporal test of each site."""
    cells = grid.withColumn("t", F.col("t"))
    # times as a third axis that is wider apart than the radius: a neighbourhood stays within its time
    points = cells.select(F.struct("site", "t").alias("id"), F.col("x"), (F.col("y") + F.col("t") * (radius * 1e3)).alias("y"), "z")
    space = spatial_outliers(points, radius, nmax, k=k).select("id.site", "id.t", F.col("outlier").alias("__space"))
    time = window_outliers(cells.select("site", "t", "z"), bucket, bandwidth, k, by=("site",))
    return time.join(space, ["site", "t"]).select("site", "t", (F.col("outlier") & F.col("__space")).alias("outlier"))


def idw_outliers(rows: DataFrame, bandwidth: float, nmax: int, ratio: float, reach: float, k: float = 3.0, by: str = "site") -> DataFrame:
    """(…, zscore, predicted, outlier): z-scores against the inverse-distance prediction from the nmax nearest values of other sites within `reach` and the time before, up to `bandwidth` back; an outlier differs by more than k. Values without neighbours are none.

    One pass: windows don't exclude earlier outliers (sequential_outliers does). A site has
    one row a time at most. The rows of one place and time share a list of neighbours, long
    enough for any of them to leave its own site out: pairs grow with places and times.
    """
    scored = zscores(rows, by)
    dims = ("x", "y", "t")
    few = scored.where("x is not null and y is not null and t is not null").select(*dims, F.col(by).alias("__by"), F.col("zscore").alias("z"))
    few = few.withColumn("__r", F.row_number().over(Window.partitionBy(*dims).orderBy("__by"))).where(F.col("__r") <= nmax + 1)
    cells = few.groupBy(*dims).agg(F.count("*").alias("n")).withColumn("k", F.struct(*dims))
    met = spacetime_join(cells.drop("n"), cells.drop("k"), reach, bandwidth).where((F.col("b.t") <= F.col("a.t")) & (F.col("b.t") >= F.col("a.t") - bandwidth))
    gap = F.sqrt(F.pow("d", 2.0) + F.pow((F.col("a.t") - F.col("b.t")) * ratio, 2.0))
    near = met.select("a.k", F.struct(*(F.col(f"b.{c}").alias(c) for c in dims)).alias("__c"), gap.alias("g"), "b.n")
    # a row's own site takes one of the neighbours at each time
    near = nearest_cells(near, nmax, "t").join(few.withColumn("__c", F.struct(*dims)), "__c")
    near = near.withColumn("__p", F.row_number().over(Window.partitionBy("k").orderBy("g", "__by", "t"))).where(F.col("__p") <= nmax + F.col("__less"))
    w = 1 / F.pow(F.greatest(F.col("g"), F.lit(1e-10)), 2.0)
    lists = near.groupBy(F.col("k").alias("__k")).agg(F.sort_array(F.collect_list(F.struct("__p", "__by", w.alias("w"), "z"))).alias("__l"))
    out = scored.withColumn("__k", F.struct(*dims)).join(lists, "__k", "left")
    out = out.withColumn("__l", F.slice(F.filter("__l", lambda e: e["__by"] != F.col(by)), 1, nmax))
    wz, sw = F.aggregate("__l", F.lit(0.0), lambda s, e: s + F.coalesce(e["w"] * e["z"], F.lit(0.0))), F.aggregate("__l", F.lit(0.0), lambda s, e: s + e["w"])
    out = out.withColumn("predicted", F.when(F.exists("__l", lambda e: e["z"].isNotNull()), wz / sw)).select(*scored.columns, "predicted")
    return out.withColumn("outlier", F.coalesce(F.abs(F.col("zscore") - F.col("predicted")) > k, F.lit(False)))
