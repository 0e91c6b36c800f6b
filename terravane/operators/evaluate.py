"""Classification metrics over rows (y_true, y_pred) or (y_true, probabilities)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(rows: DataFrame, normalize: str | None = "true", categories: Sequence | None = None) -> DataFrame:
    """(y_true, y_pred, n, share): shares of the true class, the predicted one, all, or none; unknown labels drop out."""
    if categories is not None:
        rows = rows.where(F.col("y_true").isin(*categories) & F.col("y_pred").isin(*categories))
    counts = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    by = {"true": ["y_true"], "pred": ["y_pred"], "all": []}.get(normalize)
    share = F.col("n").cast("double") if by is None else F.col("n") / F.sum("n").over(Window.partitionBy(*by)).cast("double")
    return counts.withColumn("share", share)


def class_counts(rows: DataFrame) -> DataFrame:
    """(cls, tp, support, predicted) for every class that is true or predicted."""
    sides = F.explode(F.array(F.struct(F.col("y_true").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    each = rows.select(sides.alias("s"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"))
    return each.groupBy("s.cls").agg(F.sum(F.col("s.t") * F.col("hit")).alias("tp"), F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"))


def classification_report(rows: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1, support); undefined figures are 0."""
    c = class_counts(rows)
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return c.select("cls", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a report: one row."""
    w = F.col("support") / F.sum("support").over(Window.partitionBy()).cast("double")
    rows = report.withColumn("w", w)
    return rows.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.sum(F.col(c) * F.col("w")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    """Mean recall over the classes that are present."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return rows.groupBy("y_true").agg(F.avg(hit).alias("r")).agg(F.avg("r").alias("balanced_accuracy"))


def brier_score(rows: DataFrame, classes: Sequence, prob: str = "p") -> DataFrame:
    """Mean over rows of the sum of squared gaps between probabilities and the one-hot truth."""
    gaps = F.zip_with(F.col(prob), F.array(*map(F.lit, classes)), lambda p, c: F.pow(p - F.when(c == F.col("y_true"), 1.0).otherwise(0.0), 2.0))
    return rows.agg(F.avg(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)).alias("brier"))


def true_probability(classes: Sequence, prob: str = "p") -> Column:
    return F.element_at(F.col(prob), F.array_position(F.array(*map(F.lit, classes)), F.col("y_true")).cast("int"))


def mean_log_likelihood(rows: DataFrame, classes: Sequence, prob: str = "p", eps: float = 1e-15) -> DataFrame:
    return rows.agg(F.avg(F.log(F.greatest(true_probability(classes, prob), F.lit(eps)))).alias("mean_log_likelihood"))


def tempered_class(classes: Sequence, reference: Sequence[float], tau: Column | float, prob: str = "p") -> Column:
    """The first class with the largest p / reference**tau."""
    tau = F.lit(float(tau)) if isinstance(tau, (int, float)) else tau
    score = F.zip_with(F.col(prob), F.array(*map(F.lit, map(float, reference))), lambda p, r: p / F.pow(r, tau))
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(score, F.array_max(score)).cast("int"))


def tune_temper(rows: DataFrame, classes: Sequence, reference: Sequence[float], taus: Sequence[float] | None = None, prob: str = "p") -> DataFrame:
    """(tau, balanced_accuracy) over a grid, by default 31 values from 0 to 1.5."""
    grid = [i * 0.05 for i in range(31)] if taus is None else taus
    each = rows.select("y_true", prob, F.explode(F.array(*map(F.lit, map(float, grid)))).alias("tau"))
    each = each.withColumn("y_pred", tempered_class(classes, reference, F.col("tau"), prob))
    recalls = each.groupBy("tau", "y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("r"))
    return recalls.groupBy("tau").agg(F.avg("r").alias("balanced_accuracy"))


def loocv_stations(points: DataFrame, step: int = 1, station: str = "id") -> DataFrame:
    """(station, place): stations in order of the angle about the centroid, every step-th. Stations are rows of one window: some thousands of ids."""
    sites = points.groupBy(station).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    middle = sites.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    angle = F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx"))
    placed = sites.crossJoin(F.broadcast(middle)).withColumn("place", F.row_number().over(Window.orderBy(F.round(angle, 9), station)) - 1)  # one row is broadcast
    return placed.where(F.col("place") % step == 0).select(station, "place")


def regression_scores(rows: DataFrame, truth: str = "z", estimate: str = "zk") -> DataFrame:
    """rmse, mae, bias and r2 of estimates: one row."""
    gap = F.col(estimate) - F.col(truth)
    return rows.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap).alias("bias"), (1 - F.sum(gap * gap) / (F.var_pop(truth) * F.count(truth))).alias("r2"))
