"""Entropies (nats) and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entropy(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Joint Shannon entropy of discrete columns: one row."""
    counts = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    total = F.sum("n")
    # -sum p ln p = ln N - sum n ln n / N
    return counts.agg((F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("h"))


def equal_bins(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Adds <column>_bin: equal widths from the least value to the greatest, which the last bin holds."""
    ends = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    place = F.floor((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)
    return rows.crossJoin(F.broadcast(ends)).withColumn(f"{column}_bin", F.least(place, F.lit(bins - 1)).cast("int")).drop("__lo", "__hi")  # one row is broadcast


def entropy_binned(rows: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    for c in columns:
        rows = equal_bins(rows, c, bins)
    return entropy(rows, [f"{c}_bin" for c in columns])


def conditional_entropy(rows: DataFrame, y: str, x: str, bins: int = 20) -> DataFrame:
    """H(Y | X) = H(X, Y) - H(X) and the information that X gives, H(Y) - H(Y | X): one row."""
    both = equal_bins(equal_bins(rows, x, bins), y, bins)
    counts = both.groupBy(f"{x}_bin", f"{y}_bin").agg(F.count("*").alias("n"))
    hxy, hx, hy = entropy_of(counts, None), entropy_of(counts, f"{x}_bin"), entropy_of(counts, f"{y}_bin")
    row = hxy.withColumnRenamed("h", "hxy").crossJoin(hx.withColumnRenamed("h", "hx")).crossJoin(hy.withColumnRenamed("h", "hy"))
    return row.select((F.col("hxy") - F.col("hx")).alias("h_y_given_x"), (F.col("hy") - F.col("hxy") + F.col("hx")).alias("information"))


def entropy_of(counts: DataFrame, by: str | None) -> DataFrame:
    c = counts if by is None else counts.groupBy(by).agg(F.sum("n").alias("n"))
    return c.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    return equal_bins(rows, column, bins).groupBy(F.col(f"{column}_bin").alias("bin")).agg(F.count("*").alias("n"))


def ecdf(rows: DataFrame, column: str, bins: int = 1024) -> DataFrame:
    """(value, f): the empirical CDF at each distinct value. Counts are summed within equal-width bins, and the bins' own sums over at most `bins` rows, so no window runs over all values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"), F.sum("n").alias("__n"))
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1)), F.lit(0))
    binned = counts.crossJoin(F.broadcast(ends)).withColumn("__b", place)  # one row is broadcast
    sums = binned.groupBy("__b").agg(F.sum("n").alias("k"))
    before = sums.select("__b", F.coalesce(F.sum("k").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    upto = Window.partitionBy("__b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return binned.withColumn("__own", F.sum("n").over(upto)).join(F.broadcast(before), "__b").select("value", ((F.col("__before") + F.col("__own")) / F.col("__n").cast("double")).alias("f"))  # at most `bins` rows
