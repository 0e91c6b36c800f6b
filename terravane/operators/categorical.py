"""Class posteriors from neighbours: relational where labels are hard, joint-table kernels otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.kernels.maxent import joint_table, scale_margins, target_posterior
from terravane.operators.joins import knn_join, nearest_cells, range_join
from terravane.operators.neighbourhood import gather, solve_rows
from terravane.operators.ptable import interpolate


def model_function(model: DataFrame | pd.DataFrame, classes: Sequence[str]):
    """A table (ci, cj, d, p) as f(distance) -> classes × classes, linear between distances and constant beyond. The model is a few hundred rows."""
    pdf = model if isinstance(model, pd.DataFrame) else model.select("ci", "cj", "d", "p").toPandas()
    place = {c: i for i, c in enumerate(classes)}
    d = np.sort(pdf.groupby(["ci", "cj"])["d"].apply(lambda s: tuple(sorted(s))).iloc[0]) if len(pdf) else np.zeros(1)
    grid = np.full((len(d), len(classes), len(classes)), 1e-12)
    for (ci, cj), rows in pdf.groupby(["ci", "cj"]):
        rows = rows.sort_values("d")
        grid[:, place[ci], place[cj]] = np.interp(d, rows["d"], rows["p"])

    def at(x: float) -> np.ndarray:
        i = int(np.clip(np.searchsorted(d, x) - 1, 0, max(len(d) - 2, 0)))
        if len(d) == 1 or x <= d[0]:
            return grid[0]
        if x >= d[-1]:
            return grid[-1]
        return grid[i] + (grid[i + 1] - grid[i]) * (x - d[i]) / (d[i + 1] - d[i])

    return at


def separable_table(tables: Sequence[np.ndarray], marginal: np.ndarray, mode: str = "product") -> np.ndarray:
    """Joint table of independent components: P1 diag(1/p) P2 ..., or additive about independence."""
    out = tables[0]
    if mode == "product":
        for t in tables[1:]:
            out = out @ np.diag(1 / np.maximum(marginal, 1e-12)) @ t
    else:
        free = np.outer(marginal, marginal)
        out = free + sum(t - free for t in tables)
    out = np.maximum(out, 0)
    return out / out.sum()


def _log_table(neighbours: DataFrame, model: DataFrame, label: str) -> DataFrame:
    """(k, cls, n, l): sum over a target's neighbours of ln P(cls, their class; distance)."""
    at = neighbours.select("k", "d", F.col(label).alias("seen"))
    rows = interpolate(model, at).where("cj = seen")
    return rows.groupBy("k", F.col("ci").alias("cls")).agg(F.count("*").alias("n"), F.sum(F.log(F.greatest("p", F.lit(1e-10)))).alias("l"))


def _softmax(rows: DataFrame, score: str) -> DataFrame:
    each = Window.partitionBy("k")  # a row for each class
    e = F.exp(F.col(score) - F.max(score).over(each))
    return rows.withColumn("__e", e).select("k", "cls", (F.col("__e") / F.sum("__e").over(each)).alias("p"))


def mcp(targets: DataFrame, points: DataFrame, model: DataFrame, marginal: DataFrame, nmax: int, dmax: float, label: str = "cls", exclude_own: bool = False) -> DataFrame:
    """(k, cls, p): maximum conditional probability with hard labels: prior · prod P(c, c_k; d_k) / p(c)."""
    near = knn_join(targets, points, nmax + int(exclude_own), dmax, strict=True)
    if exclude_own:
        near = near.where("k <> id").withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= nmax)
    sums = _log_table(near, model, label).join(F.broadcast(marginal.select("cls", F.col("p").alias("m"))), "cls")
    return _softmax(sums.withColumn("s", F.log("m") - F.col("n") * F.log("m") + F.col("l")), "s")


def mcp_soft(targets: DataFrame, points: DataFrame, model: DataFrame, marginal: DataFrame, classes: Sequence[str], nmax: int, dmax: float, soft: str = "ps") -> DataFrame:
    """(k, cls, p): the same with class probabilities as data: each neighbour gives ln sum over its classes of P(c, c_k; d_k) ps(c_k)."""
    near = knn_join(targets, points, nmax, dmax, strict=True).select("k", "id", "d", F.explode(F.arrays_zip(F.array(*map(F.lit, classes)).alias("seen"), F.col(soft).alias("w"))).alias("s")).select("k", "id", "d", "s.seen", "s.w")
    each = interpolate(model, near).where("cj = seen").groupBy("k", "id", F.col("ci").alias("cls")).agg(F.log(F.greatest(F.sum(F.col("p") * F.col("w")), F.lit(1e-10))).alias("l"))
    sums = each.groupBy("k", "cls").agg(F.count("*").alias("n"), F.sum("l").alias("l")).join(F.broadcast(marginal.select("cls", F.col("p").alias("m"))), "cls")
    return _softmax(sums.withColumn("s", F.log("m") - F.col("n") * F.log("m") + F.col("l")), "s")


def mcp_stations(points: DataFrame, model: DataFrame, marginal: DataFrame, nmax: int, dmax: float, station: str, label: str = "cls") -> DataFrame:
    """(k, cls, p): every point from the points of other stations: leave-one-station-out in one join instead of a loop over folds."""
    # the points of a station at a place share their neighbours, and only the nmax smallest ids of such can be among these
    by = ("x", "y", "__s")
    known = points.withColumn("__s", F.col(station)).where("x is not null and y is not null and __s is not null")
    few = known.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("__n") <= nmax)
    cells = few.groupBy(*by).agg(F.count("*").alias("n"))
    own = cells.select(F.struct(*by).alias("k"), *by).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y")  # small rows, long work: not to be coalesced
    met = range_join(own, cells, dmax, strict=True).where("a.__s != b.__s")
    near = nearest_cells(met.select("a.k", F.struct(*(F.col(f"b.{c}").alias(c) for c in by)).alias("__c"), F.col("d").alias("g"), "b.n"), nmax)
    near = near.join(few.withColumn("__c", F.struct(*by)), "__c").select("k", "id", F.col(label).alias(label), F.col("g").alias("d"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= nmax)
    sums = _log_table(near, model, label).join(F.broadcast(marginal.select("cls", F.col("p").alias("m"))), "cls")
    found = _softmax(sums.withColumn("s", F.log("m") - F.col("n") * F.log("m") + F.col("l")), "s").withColumnRenamed("k", "__p")
    return known.select(F.col("id").alias("k"), F.struct(*by).alias("__p")).join(found, "__p").select("k", "cls", "p")


def mcp_regional(targets: DataFrame, points: DataFrame, blended: DataFrame, bins: DataFrame, marginal: DataFrame, nmax: int, dmax: float, label: str = "cls") -> DataFrame:
    """(k, cls, p): with each target's own blend of regional tables (k, bin, ci, cj, p); bins (bin, lo, hi) say which bin a distance is in."""
    near = knn_join(targets, points, nmax, dmax, strict=True).select("k", "id", "d", F.col(label).alias("cj"))
    near = near.join(F.broadcast(bins), (F.col("d") > F.col("lo")) & (F.col("d") <= F.col("hi")))
    rows = near.join(blended, ["k", "bin", "cj"]).groupBy("k", F.col("ci").alias("cls")).agg(F.count("*").alias("n"), F.sum(F.log(F.greatest("p", F.lit(1e-10)))).alias("l"))
    sums = rows.join(F.broadcast(marginal.select("cls", F.col("p").alias("m"))), "cls")
    return _softmax(sums.withColumn("s", F.log("m") - F.col("n") * F.log("m") + F.col("l")), "s")


def bme_cat_regional(targets: DataFrame, points: DataFrame, regions: DataFrame, models: Mapping[int, pd.DataFrame], classes: Sequence[str], nmax: int, dmax: float, scale_alpha: float = 0.2, soft: str = "ps") -> DataFrame:
    """(k, ps): bme_cat with each target's blend of regional table functions, weights exp(-d² / (2 s²)) n**alpha of regions (region, x, y, s, n): some tens of rows."""
    about = {r["region"]: r for r in regions.collect()}
    at = {r: model_function(m, classes) for r, m in models.items()}
    nc = len(classes)
    told = points.where(F.array_max(soft) - F.array_min(soft) > 1e-12)
    rows = targets.select("k", "x", "y").join(gather(knn_join(targets, told, nmax, dmax, strict=True), ["x", "y", "d", soft], "near"), "k", "left")
    spots = [(r, float(a["x"]), float(a["y"]), float(a["s"]), float(a["n"])) for r, a in about.items()]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            items = row["near"] if isinstance(row["near"], (list, np.ndarray)) else []
            w = np.array([np.exp(-((row["x"] - x) ** 2 + (row["y"] - y) ** 2) / (2 * s * s)) * n**scale_alpha for _, x, y, s, n in spots])
            w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
            c = np.array([[row["x"], row["y"]], *([i["x"], i["y"]] for i in items)])
            n = len(c)
            pairs = {(i, j): sum(v * at[s[0]](float(np.hypot(*(c[i] - c[j])))) for v, s in zip(w, spots, strict=True)) for i in range(n) for j in range(i + 1, n)}
            p = target_posterior(joint_table(pairs, n, nc), [np.asarray(i[soft], float) for i in items]) if n > 1 else np.full(nc, 1 / nc)
            out.append((row["k"], p.tolist()))
        return pd.DataFrame(out, columns=["k", "ps"])

    return solve_rows(rows, kernel, "k long, ps array<double>")


def tune_regularisation(points: DataFrame, model: DataFrame, classes: Sequence[str], nmax: int, dmax: float, grid: Sequence[float], soft: str = "ps") -> list[tuple[float, float]]:
    """(reg, score) by leave-one-out: sums of ps · ln(estimate) under the penalised estimator; the best first."""
    own = points.select(F.col("id").alias("k"), "x", "y", F.col(soft).alias("__truth"))
    at, nc = model_function(model, classes), len(classes)
    near = range_join(own, points, dmax, strict=True).where(F.col("a.k") != F.col("b.id")).select(F.col("a.k").alias("k"), F.col("b.id").alias("id"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col(f"b.{soft}").alias(soft), "d")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= nmax)
    rows = own.join(gather(near, ["x", "y", "d", soft], "near"), "k")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            items = [i for i in row["near"] if i["d"] > 0]
            c = np.array([[row["x"], row["y"]], *([i["x"], i["y"]] for i in items)])
            pairs = {(i, j): at(float(np.hypot(*(c[i] - c[j])))) for i in range(len(c)) for j in range(i + 1, len(c))}
            for reg in grid:
                p = target_posterior(joint_table(pairs, len(c), nc, "MLE_reg", reg=reg), [np.asarray(i[soft], float) for i in items]) if pairs else np.full(nc, 1 / nc)
                out.append((float(reg), float(np.asarray(row["__truth"]) @ np.log(np.maximum(p, 1e-15)))))
        return pd.DataFrame(out, columns=["reg", "score"])

    scores = solve_rows(rows, kernel, "reg double, score double").groupBy("reg").agg(F.sum("score").alias("score")).collect()
    return sorted(((r["reg"], r["score"]) for r in scores), key=lambda v: -v[1])


def feature_prior_loocv(points: DataFrame, features: Sequence[str], classes: Sequence[str], station: str, folds: int = 5, **options) -> DataFrame:
    """(…, prior): priors of each point from a model without its station; stations are dealt to folds by hash, one fit each."""
    fold = F.pmod(F.xxhash64(station), F.lit(folds))
    out = None
    for k in range(folds):
        part = feature_prior(points.where(fold == k), points.where(fold != k), features, classes, **options)
        out = part if out is None else out.unionByName(part)
    return out


def tune_bins(points: DataFrame, candidates: Sequence[Sequence[float]], nmax: int, dmax: float, label: str = "cls") -> list[tuple[tuple[float, ...], float]]:
    """(edges, mean log likelihood) of class tables with each set of bin edges, by leave-one-out conditional probabilities; the best first."""
    from terravane.operators.ptable import marginals, ptable

    own, out = points.select(F.col("id").alias("k"), "x", "y"), []
    for edges in candidates:
        model = ptable(points, edges, label)
        post = mcp(own, points, model, marginals(model), nmax, dmax, label, exclude_own=True)
        hit = post.join(points.select(F.col("id").alias("k"), F.col(label).alias("cls")), ["k", "cls"])
        out.append((tuple(edges), hit.agg(F.avg(F.log(F.greatest("p", F.lit(1e-15))))).first()[0]))
    return sorted(out, key=lambda v: -(v[1] if v[1] is not None else float("-inf")))


def maxent_product(targets: DataFrame, points: DataFrame, model: DataFrame, nmax: int, dmax: float, label: str = "cls") -> DataFrame:
    """(k, cls, p): the pseudo-likelihood table with hard labels, where factors between neighbours cancel: prod P(c, c_k; d_k)."""
    return _softmax(_log_table(knn_join(targets, points, nmax, dmax, strict=True), model, label), "l")


def bme_cat(targets: DataFrame, points: DataFrame, model: DataFrame, classes: Sequence[str], nmax: int, dmax: float, estimator: str = "MPL", prior: str | None = None, base: Sequence[float] | None = None, soft: str = "ps", **options) -> DataFrame:
    """(k, ps): class probabilities from a joint table of target and neighbours with soft labels.

    points have an array of class probabilities; uniform ones say nothing and are left
    out. A collocated datum multiplies in. Targets without neighbours have the prior, or
    uniform shares. A table has len(classes) ** (nmax + 1) cells at most.
    """
    at, nc = model_function(model, classes), len(classes)
    told = points.where(F.array_max(soft) - F.array_min(soft) > 1e-12)
    near = gather(knn_join(targets, told, nmax, dmax, strict=True), ["x", "y", "d", soft], "near")
    rows = targets.select("k", "x", "y", *([prior] if prior else [])).join(near, "k", "left")
    shares = None if base is None else np.asarray(base, float)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            items = row["near"] if isinstance(row["near"], (list, np.ndarray)) else []
            own = np.asarray(row[prior], float) if prior else None
            same = [np.asarray(i[soft], float) for i in items if i["d"] == 0]
            items = [i for i in items if i["d"] > 0]
            if items:
                c = np.array([[row["x"], row["y"]], *([i["x"], i["y"]] for i in items)])
                n = len(c)
                pairs = {(i, j): at(float(np.hypot(*(c[i] - c[j])))) for i in range(n) for j in range(i + 1, n)}
                p = target_posterior(joint_table(pairs, n, nc, estimator, **options), [np.asarray(i[soft], float) for i in items], own, shares)
            else:
                p = own if own is not None else np.full(nc, 1 / nc)
            for s in same:
                p = p * s if (p * s).sum() > 0 else p
            out.append((row["k"], (p / p.sum()).tolist()))
        return pd.DataFrame(out, columns=["k", "ps"])

    return solve_rows(rows, kernel, "k long, ps array<double>")


def hbme_cat(targets: DataFrame, points: DataFrame, model: DataFrame, marginal: DataFrame, classes: Sequence[str], nmax: int, dmax: float, ring: float, ring_nmax: int, label: str = "cls", soft: str = "ps", **options) -> DataFrame:
    """(k, ps): a prior from the ring dmax < d <= ring by conditional probabilities, smoothed by 1 / classes, then bme_cat within dmax."""
    far = range_join(targets, points, ring).where(F.col("d") > dmax).select(F.col("a.k").alias("k"), F.col("b.id").alias("id"), F.col(f"b.{label}").alias(label), "d")
    far = far.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("d", "id"))).where(F.col("place") <= ring_nmax)
    sums = _log_table(far, model, label).join(F.broadcast(marginal.select("cls", F.col("p").alias("m"))), "cls")
    share = _softmax(sums.withColumn("s", F.log("m") - F.col("n") * F.log("m") + F.col("l")), "s")
    nc = len(classes)
    arrays = share.groupBy("k").agg(*(F.max(F.when(F.col("cls") == c, F.col("p"))).alias(f"p{i}") for i, c in enumerate(classes)))
    arrays = arrays.select("k", F.array(*((F.coalesce(f"p{i}", F.lit(0.0)) + 1 / nc) / 2 for i in range(nc))).alias("prior"))
    flat = F.array(*[F.lit(1 / nc)] * nc)
    with_prior = targets.join(arrays, "k", "left").withColumn("prior", F.coalesce("prior", flat))
    return bme_cat(with_prior, points, model, classes, nmax, dmax, prior="prior", soft=soft, **options)


def kernel_first_order(targets: DataFrame, points: DataFrame, reference: Mapping[str, float], sigma: float, reach: float, n0: float = 2.0, label: str = "cls") -> DataFrame:
    """(k, cls, p): class shares of station cells (coordinates to 1e-3) under a Gaussian kernel, shrunk by n0 to the reference."""
    cells = points.groupBy(F.round("x", 3).alias("x"), F.round("y", 3).alias("y")).agg(F.count("*").alias("n"), *(F.avg((F.col(label) == c).cast("double")).alias(f"c{i}") for i, c in enumerate(reference)))
    w = F.exp(F.pow(F.col("d") / sigma, 2.0) * -0.5)
    own = targets.select("k", F.struct("x", "y").alias("__p"))
    places = own.select("__p").distinct().select(F.col("__p").alias("k"), "__p.*")  # targets at one place share their sums
    near = range_join(places, cells, reach).select(F.col("a.k").alias("__p"), w.alias("w"), *(F.col(f"b.c{i}").alias(f"c{i}") for i in range(len(reference))))
    sums = near.groupBy("__p").agg(F.sum("w").alias("sw"), *(F.sum(F.col("w") * F.col(f"c{i}")).alias(f"s{i}") for i in range(len(reference))))
    full = own.join(sums, "__p", "left").drop("__p").fillna(0.0)
    shares = F.array(*(F.struct(F.lit(c).alias("cls"), ((F.col(f"s{i}") + n0 * p) / (F.col("sw") + n0)).alias("p")) for i, (c, p) in enumerate(reference.items())))
    return full.select("k", F.explode(shares).alias("s")).select("k", "s.cls", "s.p")


def uniform_prior(targets: DataFrame, classes: Sequence[str]) -> DataFrame:
    return targets.withColumn("prior", F.array(*[F.lit(1 / len(classes))] * len(classes)))


def feature_prior(targets: DataFrame, points: DataFrame, features: Sequence[str], classes: Sequence[str], label: str = "cls", trees: int = 20, depth: int = 5, seed: int = 0, method: str = "forest") -> DataFrame:
    """(…, prior): class probabilities from features by a random forest or multinomial logistic regression of spark.ml."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    data = VectorAssembler(inputCols=list(features), outputCol="__f").transform(points.withColumn("__y", place.cast("double")).where("__y >= 0"))
    # a row of every class with no weight keeps the number of classes
    kind = RandomForestClassifier(labelCol="__y", featuresCol="__f", numTrees=trees, maxDepth=depth, seed=seed) if method == "forest" else LogisticRegression(labelCol="__y", featuresCol="__f", family="multinomial", regParam=1e-4)
    model = kind.fit(data)
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="__f").transform(targets))
    padded = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), len(classes)))
    return scored.withColumn("prior", F.slice(padded, 1, len(classes))).select(*targets.columns, "prior")


def recenter(model: pd.DataFrame, rows: Mapping[str, float], columns: Mapping[str, float] | None = None) -> pd.DataFrame:
    """Each distance slice of a table fitted to class sums."""
    classes = list(rows)
    out = []
    for d, part in model.groupby("d"):
        t = part.pivot(index="ci", columns="cj", values="p").reindex(index=classes, columns=classes).fillna(1e-12).to_numpy()
        t = scale_margins(t, np.array([rows[c] for c in classes]), None if columns is None else np.array([columns[c] for c in classes]))
        out.extend((a, b, d, t[i, j]) for i, a in enumerate(classes) for j, b in enumerate(classes))
    return pd.DataFrame(out, columns=["ci", "cj", "d", "p"])


def recenter_distributed(model: DataFrame, rows: Mapping[str, float]) -> DataFrame:
    return model.groupBy("d").applyInPandas(lambda pdf: recenter(pdf, rows), "ci string, cj string, d double, p double")
