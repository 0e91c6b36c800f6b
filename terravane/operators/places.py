"""Sums over ordered pairs of points by place: work grows with the points and the places around each, not with the pairs.

Of a pair, a is the point of the smaller id. Tiles as wide as the reach hold their own
points and those of the eight around; at each place of a tile, the points of the places
in a group (a lag, a sector) lie in order of id, and running sums give every point the
sums of those before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The groups that hold a displacement: masks, one a group, from the arrays dx, dy and distance.
Groups = Callable[[np.ndarray, np.ndarray, np.ndarray], Sequence[np.ndarray]]


def lag_groups(lags: Sequence[tuple[float, float]]) -> Groups:
    return lambda dx, dy, d: [(d >= m - t) & (d <= m + t) for m, t in lags]


def sector_groups(lags: Sequence[tuple[float, float]], sectors: Sequence[tuple[float, float]]) -> Groups:
    """Group i * lags + j: sector i (centre, tolerance), as `joins.in_sector`, and lag j."""

    def masks(dx: np.ndarray, dy: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        angle = np.where(dx == 0, np.pi / 2, np.arctan(dy / np.where(dx == 0, 1.0, dx)))
        out, bins = [], lag_groups(lags)(dx, dy, d)
        for centre, tolerance in sectors:
            lo, hi, half = centre - tolerance, centre + tolerance, np.pi / 2
            inside = ((angle > lo) & (angle <= hi)) | ((dx == 0) & (dy == 0))
            if lo < -half:
                inside |= angle > lo + np.pi
            if hi > half:
                inside |= angle <= hi - np.pi
            out.extend(inside & b for b in bins)
        return out

    return masks


def _tile_sums(pdf: pd.DataFrame, reach: float, groups: Groups, m: int, own: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    ids, v = pdf["id"].to_numpy(), pdf[[f"v{i}" for i in range(m)]].to_numpy(float)
    xy, of = np.unique(pdf[["x", "y"]].to_numpy(float), axis=0, return_inverse=True)
    of = of.ravel()
    core = np.zeros(len(xy), bool)
    core[of[pdf["core"].to_numpy(bool)]] = True
    by_place = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by_place], np.arange(len(xy) + 1))
    total: dict[int, list] = {}
    for q in np.flatnonzero(core):
        mine = by_place[starts[q] : starts[q + 1]]
        dx, dy = xy[:, 0] - xy[q, 0], xy[:, 1] - xy[q, 1]
        d = np.sqrt(dx * dx + dy * dy)
        close = np.flatnonzero(d <= reach)
        around = np.sort(np.concatenate([by_place[starts[p] : starts[p + 1]] for p in close])) if len(close) < len(xy) else np.arange(len(ids))
        place = np.searchsorted(close, of[around])
        for g, mask in enumerate(groups(dx[close], dy[close], d[close])):
            at = around[mask[place]]
            if not len(at):
                continue
            pos = np.searchsorted(ids[at], ids[mine], side="right" if own else "left")
            before = np.vstack([np.zeros((1, m)), np.cumsum(v[at], axis=0)])[pos]
            sums = total.setdefault(g, [0, np.zeros(m), np.zeros(m), np.zeros((m, m))])
            sums[0] += int(pos.sum())
            sums[1] += before.sum(axis=0)
            sums[2] += pos @ v[mine]
            sums[3] += before.T @ v[mine]
    rows = [(g, n, *a, *b, *p.ravel()) for g, (n, a, b, p) in total.items() if n]
    return pd.DataFrame(rows, columns=["g", "n", *_names(m)])


def _names(m: int) -> list[str]:
    return [f"a{i}" for i in range(m)] + [f"b{i}" for i in range(m)] + [f"p{i}_{j}" for i in range(m) for j in range(m)]


def _width(points: DataFrame, reach: float, some: int = 300) -> float:
    """Of tiles: the reach, or more where `some` points a tile need it. One row comes to the driver."""
    row = points.agg(F.count("*").alias("n"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    tiles, (a, b) = max(1.0, row["n"] / some), (max(float(e or 0), 0.0) for e in row[1:])
    wanted = math.sqrt(a * b / tiles) if a * b > 0 else max(a, b) / tiles
    return max(reach, 1e-9, wanted if math.isfinite(wanted) else 0.0)


def _tiled(rows: DataFrame, reach: float) -> DataFrame:
    """Rows in their tile (i, j; core) and in the eight around it."""
    width = _width(rows, reach)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    own = [(F.floor(F.col(c) / width) + F.col(f"s.{t}")).alias(t) for c, t in (("x", "i"), ("y", "j"))]
    tiled = rows.withColumn("s", F.explode(steps)).select(*rows.columns, *own, ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("core"))
    return tiled.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i", "j")  # small rows, long work: not to be coalesced


def ordered_sums(points: DataFrame, values: Sequence[Column], reach: float, groups: Groups, own: bool = True) -> DataFrame:
    """(g, n, a0, ..., b0, ..., p0_0, ...): of the pairs in a group, their number, sums of each value over their first and their second points, and of the products of value i of the first and j of the second.

    Points (id, x, y) with values that are never null. With `own`, each point with itself.
    """
    m = len(values)
    rows = points.where("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(v.cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    dealt = _tiled(rows, float(reach))

    def run(key: tuple, batches: pd.DataFrame) -> pd.DataFrame:
        return _tile_sums(batches, float(reach), groups, m, own)

    found = dealt.groupBy("i", "j").applyInPandas(run, "g int, n long, " + ", ".join(f"{c} double" for c in _names(m)))
    return found.groupBy("g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _names(m)))


def _lower(r: np.ndarray, v: np.ndarray, pos: np.ndarray, c: np.ndarray, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each query, of the first pos elements, the number and sum of v of those with r < c: a prefix is a block of each power of two in pos, and blocks are searched in order of r."""
    at = (pos >> least << least)[:, None] + np.arange(1 << least)
    held = at < pos[:, None]
    at = np.minimum(at, len(r) - 1)
    held &= r[at] < c[:, None]
    count, total, wide = held.sum(axis=1), (held * v[at]).sum(axis=1), int(r.max()) + 2
    c = np.minimum(c, wide - 1)
    for level in range(least, len(r).bit_length()):
        use = np.flatnonzero(pos >> level & 1)
        if not len(use):
            continue
        size = 1 << level
        whole = len(r) >> level << level
        blocks, values = r[:whole].reshape(-1, size)[::2], v[:whole].reshape(-1, size)[::2]
        order = np.argsort(blocks, axis=1, kind="stable")
        keys = np.take_along_axis(blocks, order, 1) + np.arange(len(blocks))[:, None] * wide
        sums = np.zeros((len(blocks), size + 1))
        np.cumsum(np.take_along_axis(values, order, 1), axis=1, out=sums[:, 1:])
        block = pos[use] >> level >> 1
        n = np.searchsorted(keys.ravel(), block * wide + c[use]) - block * size
        count[use] += n
        total[use] += sums[block, n]
    return count, total


def _cuts(values: np.ndarray, z: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values u, for each z the number with u - z <= gap, and the number with z - u > gap: as the differences are in floating point."""
    out = []
    for start, inside in ((np.searchsorted(values, z + gap, side="right"), lambda u: u - z <= gap), (np.searchsorted(values, z - gap), lambda u: z - u > gap)):
        while True:
            more = (start < len(values)) & inside(values[np.minimum(start, len(values) - 1)])
            less = (start > 0) & ~inside(values[np.maximum(start - 1, 0)])
            if not (more | less).any():
                break
            start = start + more - less
        out.append(start)
    return out[0], out[1]


def _tile_gaps(pdf: pd.DataFrame, reach: float, groups: Groups, bands: Sequence[tuple[float, float]]) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    ids, z = pdf["id"].to_numpy(), pdf["z"].to_numpy(float)
    xy, of = np.unique(pdf[["x", "y"]].to_numpy(float), axis=0, return_inverse=True)
    of = of.ravel()
    values, rank = np.unique(z, return_inverse=True)
    rank = rank.ravel()
    edges = sorted({e for band in bands for e in band})
    cuts = np.vstack([c for e in edges for c in _cuts(values, z, e)])
    core = np.unique(of[pdf["core"].to_numpy(bool)])
    by_place = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by_place], np.arange(len(xy) + 1))
    total: dict[tuple[int, int], np.ndarray] = {}
    for q in core:
        mine = by_place[starts[q] : starts[q + 1]]
        dx, dy = xy[:, 0] - xy[q, 0], xy[:, 1] - xy[q, 1]
        d = np.sqrt(dx * dx + dy * dy)
        for g, mask in enumerate(groups(dx, dy, d)):
            close = np.flatnonzero(mask & (d <= reach))
            if not len(close):
                continue
            at = np.sort(np.concatenate([by_place[starts[p] : starts[p + 1]] for p in close]))
            pos = np.searchsorted(ids[at], ids[mine], side="right")
            n, s = (a.reshape(-1, 2, len(mine)) for a in _lower(rank[at], z[at], np.tile(pos, len(cuts)), cuts[:, mine].ravel()))
            for band, (lo, hi) in enumerate(bands):
                i, j = edges.index(lo), edges.index(hi)
                count, before = (v[j, 0] - v[i, 0] + v[i, 1] - v[j, 1] for v in (n, s))
                total[g, band] = total.get((g, band), 0) + np.array([count.sum(), before.sum(), count @ z[mine], before @ z[mine]])
    rows = [(g, band, int(round(t[0])), *t[1:]) for (g, band), t in total.items() if t[0]]
    return pd.DataFrame(rows, columns=["g", "band", "n", "a", "b", "ab"])


def gap_sums(points: DataFrame, reach: float, groups: Groups, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """(g, band, n, a, b, ab): of the ordered pairs in a group whose values differ by more than lo and at most hi, for bands (lo, hi) from 0, their number and sums of the first values, the second and the products.

    Work grows with the points and the places around each, and the logarithm of the points around.
    """
    if not all(0 <= lo < hi for lo, hi in bands):
        raise ValueError("bands must be of positive differences")
    known = points.where("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    rows = known.select("id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z"))).where(F.abs("z") < math.inf)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_gaps(pdf, float(reach), groups, bands)

    found = _tiled(rows, float(reach)).groupBy("i", "j").applyInPandas(run, "g int, band int, n long, a double, b double, ab double")
    return found.groupBy("g", "band").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "ab")))


def _tile_classes(pdf: pd.DataFrame, reach: float, groups: Groups) -> pd.DataFrame:
    xy, of = np.unique(pdf[["x", "y"]].to_numpy(float), axis=0, return_inverse=True)
    label, names = pd.factorize(pdf["cls"], use_na_sentinel=False)
    w = np.zeros((len(xy), len(names)))
    np.add.at(w, (of.ravel(), label), pdf["m"].to_numpy(float))
    core = np.unique(of.ravel()[pdf["core"].to_numpy(bool)])
    total: dict[int, tuple] = {}
    step = max(1, 2_000_000 // len(xy))
    for part in (core[i : i + step] for i in range(0, len(core), step)):
        dx, dy = xy[None, :, 0] - xy[part, None, 0], xy[None, :, 1] - xy[part, None, 1]
        d = np.sqrt(dx * dx + dy * dy)
        for g, mask in enumerate(groups(dx, dy, d)):
            mask = (mask & (d <= reach)).astype(float)
            c, sd = w[part].T @ (mask @ w), w[part].T @ ((mask * d) @ w)
            before = total.get(g, (0.0, 0.0))
            total[g] = (before[0] + c, before[1] + sd)
    rows = [(g, names[i], names[j], int(round(c[i, j])), float(sd[i, j])) for g, (c, sd) in total.items() for i, j in zip(*np.nonzero(c), strict=True)]
    out = pd.DataFrame(rows, columns=["g", "ci", "cj", "c", "sd"])
    return out.astype(object).where(out.notna(), None)


def class_sums(points: DataFrame, label: str, reach: float, groups: Groups) -> DataFrame:
    """(g, ci, cj, c, sd): ordered pairs of points in a group, own ones included, by their labels, with the sum of their distances."""
    kind = dict(points.dtypes)[label]
    known = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    cells = known.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(label).alias("cls")).agg(F.count("*").alias("m"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_classes(pdf, float(reach), groups)

    found = _tiled(cells, float(reach)).groupBy("i", "j").applyInPandas(run, f"g int, ci {kind}, cj {kind}, c long, sd double")
    return found.groupBy("g", "ci", "cj").agg(F.sum("c").alias("c"), F.sum("sd").alias("sd"))


def edge_groups(edges: Sequence[float]) -> Groups:
    """Bins of `ptable.distance_bin`: no distance, then (edges[i-1], edges[i]]."""
    return lambda dx, dy, d: [d == 0] + [(d != 0) & (d > a) & (d <= b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def sector_edge_groups(edges: Sequence[float], sectors: Sequence[tuple[float, float]]) -> Groups:
    """Group i * edges + bin of sector i."""
    every = sector_groups([(0.0, np.inf)], sectors)
    return lambda dx, dy, d: [s & b for s in every(dx, dy, d) for b in edge_groups(edges)(dx, dy, d)]


#: Places of a block; two blocks' distances are one task's matrix, by parts of so many.
BLOCK, PART = 1500, 2_000_000


def _distance_counts(a: pd.DataFrame, b: pd.DataFrame, reach: float) -> pd.DataFrame:
    """(d, n, told, same) of two frames of cells (x, y, cls, m): pairs of points of either at each positive distance within reach, those with both labels, and with equal ones."""
    names = pd.Index(a["cls"].dropna().unique())
    sides = []
    for pdf in (a, b):
        xy, of = np.unique(pdf[["x", "y"]].to_numpy(float), axis=0, return_inverse=True)
        m = pdf["m"].to_numpy(float)
        sides.append((xy, of.ravel(), m, names.get_indexer(pdf["cls"]), np.bincount(of.ravel(), m), np.bincount(of.ravel(), m * pdf["cls"].notna().to_numpy())))
    (xy, *_, n, told), (xy2, *_, n2, told2) = sides
    out, step = [], max(1, PART // len(xy2))
    for lo in range(0, len(xy), step):
        part = slice(lo, lo + step)
        dx, dy = xy[part, None, 0] - xy2[None, :, 0], xy[part, None, 1] - xy2[None, :, 1]
        d = np.sqrt(dx * dx + dy * dy)
        same = np.zeros(d.shape)
        for first in range(0, len(names), 256):  # a chunk of labels
            w = []
            for pxy, of, m, label, *_ in sides:
                held = (label >= first) & (label < first + 256)
                w.append(np.zeros((len(pxy), min(256, len(names) - first))))
                np.add.at(w[-1], (of[held], label[held] - first), m[held])
            same += w[0][part] @ w[1].T
        use = (d > 0) & (d <= reach)
        values, at = np.unique(d[use], return_inverse=True)
        out.append(pd.DataFrame({"d": values, **{c: np.bincount(at, v[use], len(values)) for c, v in (("n", n[part, None] * n2), ("told", told[part, None] * told2), ("same", same))}}))
    return pd.concat(out).groupby("d", as_index=False).sum()


def distance_counts(points: DataFrame, radius: float | None = None, by: str | None = None) -> DataFrame:
    """(d, n, told, same): unordered pairs of points at each positive distance (within the radius), those with both groups known, and with equal ones.

    Points meet at their places: tiles of them with the tiles around, or without a radius
    blocks of them with all blocks. Without a radius the number of blocks comes to the driver.
    """
    known = points.where("id is not null and x is not null and y is not null")
    cells = known.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col(by) if by else F.lit(0)).alias("cls")).agg(F.count("*").alias("m"))
    if radius is None:
        blocks = max(1, math.ceil(cells.select("x", "y").distinct().count() / BLOCK))
        rows = cells.withColumn("block", F.pmod(F.xxhash64("x", "y"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = rows.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o")
        dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i", "j")
    else:
        dealt = _tiled(cells, float(radius))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # both orders of a pair are met but for two blocks
        if radius is None:
            a, b = (pdf[pdf["block"] == k] for k in key)
            twice = key[0] == key[1]
        else:
            a, b, twice = pdf[pdf["core"]], pdf, True
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("d", "n", "told", "same")}, dtype=float)
        out = _distance_counts(a, b, math.inf if radius is None else float(radius))
        return out if twice else out.assign(n=out["n"] * 2, told=out["told"] * 2, same=out["same"] * 2)

    found = dealt.groupBy("i", "j").applyInPandas(run, "d double, n double, told double, same double").groupBy("d")
    return found.agg(*((F.sum(c) / 2).cast("long").alias(c) for c in ("n", "told", "same")))


def _time_sums(pdf: pd.DataFrame, reach: float, groups: Groups, time_lags: Sequence[tuple[float, float]], chunk: int, width: float, symmetric: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    ids, first, of_id = np.unique(pdf["id"].to_numpy(), return_index=True, return_inverse=True)
    xy, of = np.unique(pdf[["x", "y"]].to_numpy(float)[first], axis=0, return_inverse=True)
    of, of_id = of.ravel(), of_id.ravel()
    times, at_time = np.unique(pdf["t"].to_numpy(float), return_inverse=True)
    m = len(times)
    v = np.zeros((len(ids), 2 * m))  # a site's number of values at each time, and their sums
    np.add.at(v, (of_id, at_time.ravel()), 1.0)
    np.add.at(v, (of_id, m + at_time.ravel()), pdf["z"].to_numpy(float))
    core = np.unique(of[of_id[pdf["core"].to_numpy(bool)]])
    by_place = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by_place], np.arange(len(xy) + 1))
    total: dict[int, np.ndarray] = {}
    for q in core:
        mine = by_place[starts[q] : starts[q + 1]]
        dx, dy = xy[:, 0] - xy[q, 0], xy[:, 1] - xy[q, 1]
        d = np.sqrt(dx * dx + dy * dy)
        for g, mask in enumerate(groups(dx, dy, d)):
            close = np.flatnonzero(mask & (d <= reach))
            if not len(close):
                continue
            at = np.sort(np.concatenate([by_place[starts[p] : starts[p + 1]] for p in close]))
            before = np.vstack([np.zeros((1, 2 * m)), np.cumsum(v[at], axis=0)])[np.searchsorted(at, mine, side="right")]
            total[g] = total.get(g, 0) + before.T @ v[mine]
    own = np.floor(times / width) == chunk  # of the second sites, times of the chunk
    gap = times[None, :] - times[:, None]
    rows = []
    for g, p in total.items():
        for tbin, (lag, tol) in enumerate(time_lags):
            u = np.abs(gap)
            use = (u >= lag - tol) & (u <= lag + tol) & own[None, :] & (symmetric | (gap >= 0))
            n, b, a, ab = (part[use].sum() for part in (p[:m, :m], p[:m, m:], p[m:, :m], p[m:, m:]))
            if n:
                rows.append((g, tbin, int(round(n)), a, b, ab))
    return pd.DataFrame(rows, columns=["g", "tbin", "n", "a", "b", "ab"])


def time_sums(values: DataFrame, reach: float, groups: Groups, time_lags: Sequence[tuple[float, float]], symmetric: bool) -> DataFrame:
    """(g, tbin, n, a, b, ab): of the pairs of values of sites i <= j in a group, the first not after the second (`symmetric`: in any order), by bins of their time lag.

    Values (id, x, y, t, z), a site at one place, are dealt to tiles of space and chunks of
    time, with the chunks beside: work grows with the values and the places around each.
    """
    longest = max(m + t for m, t in time_lags)
    width = max(longest, 1e-9)
    cell = F.floor(F.col("t") / width)
    rows = values.withColumn("chunk", F.explode(F.array(*([cell - 1] * symmetric), cell, cell + 1)))
    dealt = _tiled(rows, float(reach)).repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i", "j", "chunk")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _time_sums(pdf, float(reach), groups, time_lags, key[2], width, symmetric)

    found = dealt.groupBy("i", "j", "chunk").applyInPandas(run, "g int, tbin int, n long, a double, b double, ab double")
    return found.groupBy("g", "tbin").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "ab")))
