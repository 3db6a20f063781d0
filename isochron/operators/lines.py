"""Polylines as rows (line, seq, x, y): arcs, sampling, runs, smoothing.

Each operator is a window over one line; lines of any number spread over the
cluster, one line is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import geo


def arc_length(points: DataFrame, line: list[str], seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``arc``, the length from the line's first point."""
    w = W.partitionBy(*line).orderBy(seq)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("arc", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def turns(points: DataFrame, line: list[str], seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``turn``, degrees of heading change; null at both ends."""
    w = W.partitionBy(*line).orderBy(seq)
    (ax, bx, cx), (ay, by, cy) = [(F.lag(v).over(w), F.col(v), F.lead(v).over(w)) for v in (x, y)]
    return points.withColumn("turn", F.when(ax.isNotNull() & cx.isNotNull(), geo.turn_degrees(ax, ay, bx, by, cx, cy)))


def segments(points: DataFrame, line: list[str], seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """(line, seq, ax, ay, bx, by) of consecutive points."""
    w = W.partitionBy(*line).orderBy(seq)
    out = points.select(*line, seq, F.col(x).alias("ax"), F.col(y).alias("ay"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by"))
    return out.where("bx IS NOT NULL")


def islands(rows: DataFrame, group: list[str], order: list[str], flag: str, out: str = "run") -> DataFrame:
    """Rows with a true ``flag``, numbered from 0 by the maximal run of consecutive true rows they are in."""
    w = W.partitionBy(*group).orderBy(*order)
    start = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    numbered = rows.withColumn("_start", start).withColumn(out, F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return numbered.where(F.col(flag)).drop("_start")


def clip_lines(points: DataFrame, line: str, keep: Column, least_km: float = 1.0, suffix: str = "#clip") -> DataFrame:
    """Runs of points (lon, lat) where ``keep`` holds and that are ``least_km`` long, each a line named ``<line>#clipN``.

    A line that is kept whole keeps its name.
    """
    flagged = points.withColumn("_in", F.coalesce(keep, F.lit(False)))
    whole = F.min("_in").over(W.partitionBy(line))
    runs = islands(flagged.withColumn("_whole", whole), [line], ["seq"], "_in")
    w = W.partitionBy(line, "run").orderBy("seq")
    step = F.coalesce(geo.distance_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    sized = runs.withColumn("_km", step).withColumn("_len", F.sum("_km").over(W.partitionBy(line, "run")))
    kept = sized.where(F.col("_whole") | (F.col("_len") >= least_km))
    name = F.when(F.col("_whole"), F.col(line)).otherwise(F.concat(F.col(line), F.lit(suffix), F.col("run").cast("string")))
    return kept.withColumn(line, name).drop("_in", "_whole", "_km", "_len", "run")


def exclude_lines(points: DataFrame, line: str, boxes: list[list[float]], least_km: float = 1.0) -> DataFrame:
    """The runs outside all boxes."""
    outside = F.lit(True)
    for b in boxes:
        outside &= ~geo.in_box(F.col("lon"), F.col("lat"), b)
    return clip_lines(points, line, outside, least_km, "#exc")


def trim_segments(points: DataFrame, seg: str, kind: str, keep: Column, least: float = 1.0) -> DataFrame:
    """Drawn segments (seg, kind, seq, x, y) cut to where ``keep`` holds: runs become pieces ``<seg>#N`` at least ``least`` long.

    Transitions stay whole or go by their middle point.
    """
    n = F.count("*").over(W.partitionBy(seg))
    i = F.row_number().over(W.partitionBy(seg).orderBy("seq")) - 1
    df = points.withColumn("_in", F.coalesce(keep, F.lit(False))).withColumns({"_n": n, "_i": i})
    middle = F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("_in"))).over(W.partitionBy(seg))
    whole = df.where(F.col(kind) == "transition").withColumn("_mid", middle).where("_mid").drop("_in", "_n", "_i", "_mid")
    runs = islands(df.where(F.col(kind) != "transition"), [seg], ["seq"], "_in").withColumn("_k", F.concat(F.col(seg), F.lit("#"), F.col("run").cast("string")))
    sized = arc_length(runs, ["_k"]).withColumn("_len", F.max("arc").over(W.partitionBy("_k"))).where(F.col("_len") >= least)
    pieces = sized.withColumn(seg, F.col("_k")).drop("_in", "_n", "_i", "_k", "_len", "arc", "run")
    return pieces.unionByName(whole)


def resample(points: DataFrame, line: list[str], step: float) -> DataFrame:
    """(line, i, x, y, arc): points at equal spacing of about ``step`` along each line, both ends kept."""
    withend = arc_length(points, line)
    w = W.partitionBy(*line).orderBy("seq")
    seg = withend.select(
        *line, "arc", "x", "y", F.lead("arc").over(w).alias("arc2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"),
        F.max("arc").over(W.partitionBy(*line)).alias("total"),
    )
    n = F.greatest(F.lit(1), F.ceil(F.col("total") / step - 1e-9)).cast("int")
    gap = F.col("total") / n
    lo, hi = F.ceil(F.col("arc") / gap - 1e-9).cast("int"), F.ceil(F.col("arc2") / gap - 1e-9).cast("int") - 1
    last = F.col("arc2") >= F.col("total")
    hi = F.when(last, n).otherwise(hi)
    inner = seg.where("arc2 IS NOT NULL AND arc2 > arc").withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_gap", gap).where("_hi >= _lo")
    out = inner.withColumn("i", F.explode(F.sequence("_lo", "_hi")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("i") * F.col("_gap") - F.col("arc")) / (F.col("arc2") - F.col("arc"))))
    return out.select(*line, "i", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"), (F.col("i") * F.col("_gap")).alias("arc"))


def densify(points: DataFrame, line: list[str], step: float, most: int | None = None) -> DataFrame:
    """(line, seq, k, x, y): vertices kept, with points between so that none are more than ``step`` apart.

    ``most`` drops segments that would need more points than that.
    """
    seg = segments(points, line)
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / step)).cast("int")
    seg = seg.withColumn("n", n)
    if most is not None:
        seg = seg.where(F.col("n") <= most)
    last = F.lead("seq").over(W.partitionBy(*line).orderBy("seq")).isNull()
    seg = seg.withColumn("_last", last)
    k = F.explode(F.sequence(F.lit(0), F.when(F.col("_last"), F.col("n")).otherwise(F.col("n") - 1)))
    out = seg.withColumn("k", k)
    t = F.col("k") / F.col("n")
    return out.select(*line, "seq", "k", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def median_filter(rows: DataFrame, group: list[str], order: str, value: str, width: int, out: str = "median") -> DataFrame:
    """Adds the upper median of the values present within ``width`` rows on either side; null if there are none."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-width, width)
    vals = F.array_sort(F.collect_list(value).over(w))  # collect_list leaves nulls out
    return rows.withColumn(out, F.try_element_at(vals, F.floor(F.size(vals) / 2).cast("int") + 1))


def gaussian_series(rows: DataFrame, group: list[str], order: str, value: str, sigma: float, out: str = "smooth") -> DataFrame:
    """Adds the Gaussian-weighted mean of the values present within three sigma (in rows); null if there are none."""
    reach = int(np.ceil(3 * sigma))
    w = W.partitionBy(*group).orderBy(order)
    total, weight = F.lit(0.0), F.lit(0.0)
    for d in range(-reach, reach + 1):
        k = float(np.exp(-d * d / (2 * sigma * sigma)))
        v = F.lag(value, -d).over(w) if d else F.col(value)
        total = total + F.coalesce(v * k, F.lit(0.0))
        weight = weight + F.when(v.isNotNull(), k).otherwise(0.0)
    return rows.withColumn(out, F.when(weight > 0, total / weight))


def fill_gaps(rows: DataFrame, group: list[str], order: str, value: str, hold_start: bool = False, hold_end: bool = False, out: str = "filled") -> DataFrame:
    """Adds the value, linear between the present ones; beyond the ends the nearest if held, else 0."""
    w = W.partitionBy(*group).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    n = F.row_number().over(w)
    at = F.when(F.col(value).isNotNull(), F.col("_n"))
    df = rows.withColumn("_n", n)
    df = df.select(
        "*",
        F.last(value, True).over(back).alias("_a"), F.last(at, True).over(back).alias("_i"),
        F.first(value, True).over(ahead).alias("_b"), F.first(at, True).over(ahead).alias("_j"),
    )
    lerp = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_n") - F.col("_i")) / F.nullif(F.col("_j") - F.col("_i"), F.lit(0))
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("_i").isNull(), F.coalesce(F.col("_b"), F.lit(0.0)) if hold_start else F.lit(0.0))
        .when(F.col("_j").isNull(), F.coalesce(F.col("_a"), F.lit(0.0)) if hold_end else F.lit(0.0))
        .otherwise(lerp)
    )
    return df.withColumn(out, filled).drop("_n", "_a", "_b", "_i", "_j")


def _per_line(points: DataFrame, line: str, cols: str, kernel) -> DataFrame:
    """Apply a numpy kernel (n x 2 array -> m x 2 array) to each line's ordered points."""
    kind = points.schema[line].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        out = kernel(g[["x", "y"]].to_numpy(float))
        return pd.DataFrame({line: [g[line].iloc[0]] * len(out), "seq": range(len(out)), "x": out[:, 0], "y": out[:, 1]})

    return points.select(line, "seq", "x", "y").groupBy(line).applyInPandas(run, cols or f"`{line}` {kind}, seq bigint, x double, y double")


def thin(points: DataFrame, line: str, least: float) -> DataFrame:
    """Points at least ``least`` from the one kept before, and both ends."""

    def kernel(p: np.ndarray) -> np.ndarray:
        keep = [0]
        for i in range(1, len(p)):
            if i == len(p) - 1 or np.hypot(*(p[i] - p[keep[-1]])) >= least:
                keep.append(i)
        return p[keep]

    return _per_line(points, line, "", kernel)


def simplify_points(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's simplification, without recursion."""
    keep = np.zeros(len(p), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        n = float(d @ d)
        rel = p[a + 1 : b] - p[a]
        t = np.clip(rel @ d / n, 0, 1)[:, None] if n else 0.0
        off = np.hypot(*(rel - t * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep]


def simplify(points: DataFrame, line: str, tolerance: float) -> DataFrame:
    return _per_line(points, line, "", lambda p: simplify_points(p, tolerance) if len(p) > 2 else p)


def smooth(points: DataFrame, line: str, sigma: float, step: float = 1.0) -> DataFrame:
    """Gaussian-smoothed positions along the arc (``sigma`` in the points' unit), both ends fixed."""

    def kernel(p: np.ndarray) -> np.ndarray:
        arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        if len(p) < 3 or arc[-1] == 0:
            return p
        n = max(2, int(round(arc[-1] / step)) + 1)
        s = np.linspace(0, arc[-1], n)
        q = np.stack([np.interp(s, arc, p[:, k]) for k in (0, 1)], axis=1)
        reach = max(1, int(3 * sigma / (s[1] or 1)))
        k = np.exp(-((np.arange(-reach, reach + 1) * s[1]) ** 2) / (2 * sigma**2))
        pad = np.concatenate([2 * q[0] - q[reach:0:-1], q, 2 * q[-1] - q[-2 : -reach - 2 : -1]]) if n > reach + 1 else np.pad(q, ((reach, reach), (0, 0)), mode="edge")
        out = np.stack([np.convolve(pad[:, j], k / k.sum(), "valid") for j in (0, 1)], axis=1)
        out[[0, -1]] = q[[0, -1]]
        return out

    return _per_line(points, line, "", kernel)


def slope_limit(values: np.ndarray, present: np.ndarray, most: float) -> np.ndarray:
    """Mean of a forward and a backward pass that hold each value within ``most`` of its neighbour."""
    fwd, bwd = values.astype(float).copy(), values.astype(float).copy()
    idx = np.flatnonzero(present)
    for a, b in zip(idx, idx[1:], strict=False):
        if b == a + 1:
            fwd[b] = np.clip(fwd[b], fwd[a] - most, fwd[a] + most)
    for a, b in zip(idx[::-1][1:], idx[::-1], strict=False):
        if b == a + 1:
            bwd[a] = np.clip(bwd[a], bwd[b] - most, bwd[b] + most)
    return np.where(present, (fwd + bwd) / 2, values)


def limit_slope(rows: DataFrame, group: str, order: str, value: str, most: float) -> DataFrame:
    """(group, order, value) with ``slope_limit`` applied to each group; null values are absent."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (group, order))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        v = g[value].to_numpy(float)
        here = ~np.isnan(v)
        return pd.DataFrame({group: g[group], order: g[order], value: np.where(here, slope_limit(np.where(here, v, 0), here, most), np.nan)})

    return rows.select(group, order, value).groupBy(group).applyInPandas(run, f"{kinds}, `{value}` double")


def iter_lines(points: pd.DataFrame, line: str) -> Iterator[tuple[object, np.ndarray]]:
    """(line, ordered points) of a small local table."""
    for k, g in points.sort_values([line, "seq"]).groupby(line, sort=True):
        yield k, g[["x", "y"]].to_numpy(float)


def points_at(points: DataFrame, line: list[str], arcs: DataFrame) -> DataFrame:
    """(line, arc, x, y): the place at each arc of ``arcs`` (line, arc); arcs beyond the ends give the ends."""
    w = W.partitionBy(*line).orderBy("seq")
    seg = arc_length(points, line).select(
        *line, F.col("arc").alias("_a"), F.lead("arc").over(w).alias("_b"), "x", "y", F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y"),
        (F.row_number().over(w) == 1).alias("_first"), F.lead("arc", 2).over(w).isNull().alias("_last"),
    ).where("_b IS NOT NULL")
    at = F.col("arc")
    here = ((at >= F.col("_a")) | F.col("_first")) & ((at < F.col("_b")) | F.col("_last"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    return arcs.join(seg, line).where(here).select(*line, "arc", (F.col("x") + t * (F.col("_x") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("_y") - F.col("y"))).alias("y"))


def tangents(samples: DataFrame, line: list[str], order: str = "i") -> DataFrame:
    """Adds unit ``tx``, ``ty`` from the sample before to the one after."""
    w = W.partitionBy(*line).orderBy(order)
    ax, ay = F.coalesce(F.lag("x").over(w), F.col("x")), F.coalesce(F.lag("y").over(w), F.col("y"))
    bx, by = F.coalesce(F.lead("x").over(w), F.col("x")), F.coalesce(F.lead("y").over(w), F.col("y"))
    n = F.nullif(F.hypot(bx - ax, by - ay), F.lit(0.0))
    return samples.withColumns({"tx": (bx - ax) / n, "ty": (by - ay) / n})


def cross_sections(samples: DataFrame, segs: DataFrame, reach: float) -> DataFrame:
    """Pairs of a sample (x, y, tx, ty) and a segment that its perpendicular meets within ``reach``, with signed ``offset``."""
    from isochron.operators import spatial

    near = spatial.near_segments(samples, segs, reach)
    nx, ny = -F.col("ty"), F.col("tx")
    dx, dy = F.col("bx_r") - F.col("ax_r"), F.col("by_r") - F.col("ay_r")
    den = dx * ny - dy * nx
    t = ((F.col("x") - F.col("ax_r")) * ny - (F.col("y") - F.col("ay_r")) * nx) / F.nullif(den, F.lit(0.0))
    off = (F.col("ax_r") + t * dx - F.col("x")) * nx + (F.col("ay_r") + t * dy - F.col("y")) * ny
    return near.withColumn("_t", t).withColumn("offset", off).where(F.col("_t").between(0, 1) & (F.abs("offset") <= reach)).drop("_t", "dist", "t")


def strand_clusters(offsets: DataFrame, key: list[str], gap: float = 4.5) -> DataFrame:
    """(key, strands): means of runs of a sample's sorted offsets that are at most ``gap`` apart."""
    w = W.partitionBy(*key).orderBy("offset")
    new = F.when(F.coalesce(F.col("offset") - F.lag("offset").over(w) > gap, F.lit(True)), 1).otherwise(0)
    g = offsets.select(*key, "offset").withColumn("_new", new).withColumn("_c", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    means = g.groupBy(*key, "_c").agg(F.avg("offset").alias("m"))
    return means.groupBy(*key).agg(F.array_sort(F.collect_list("m")).alias("strands"))
