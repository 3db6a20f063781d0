"""Patterns of a feed: the distinct ways a route's trips run, trimmed, pruned and windowed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.operators.coverage import keep_coverage
from isochron.sources import gtfs


@dataclass(frozen=True)
class ShapeConfig:
    """Thresholds in metres of shape trimming and of loops without a stop."""

    snap: float = 45.0
    margin: float = 40.0
    least_span: float = 500.0
    close: float = 60.0
    least_ring: float = 250.0
    most_ring: float = 2500.0
    stop_reach: float = 70.0
    passes: int = 4


def _metric(lonlat: np.ndarray, lat0: float) -> np.ndarray:
    return lonlat * np.array([111_320 * np.cos(np.radians(lat0)), 111_320.0])


def trim_to_stops(pts: np.ndarray, first: np.ndarray | None, last: np.ndarray | None, cfg: ShapeConfig = ShapeConfig()) -> np.ndarray:
    """Points (lon, lat) between the earliest arrivals at two stops, with a margin; all of them if that is too short."""
    if len(pts) < 2 or first is None or last is None or not np.any(first) or not np.any(last):
        return pts
    xy = _metric(pts, pts[0, 1])
    arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])

    def arrival(stop: np.ndarray) -> float:
        d = np.hypot(*(xy - _metric(stop, pts[0, 1])).T)
        near = np.flatnonzero(d <= cfg.snap)
        return float(arc[near[0] if len(near) else d.argmin()])

    lo, hi = sorted((arrival(first), arrival(last)))
    lo, hi = lo - cfg.margin, hi + cfg.margin
    kept = pts[(arc >= lo) & (arc <= hi)]
    return pts if hi - lo < cfg.least_span or len(kept) < 2 else kept


def excise_loops(pts: np.ndarray, stops: np.ndarray, cfg: ShapeConfig = ShapeConfig()) -> np.ndarray:
    """Points without rings that return to their start and serve no stop; the first ring of each pass goes."""
    for _ in range(cfg.passes):
        if len(pts) < 4:
            break
        xy = _metric(pts, pts[0, 1])
        arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
        at = _metric(stops.reshape(-1, 2), pts[0, 1])
        served = np.array([bool(len(at)) and bool((np.hypot(*(at - p).T) <= cfg.stop_reach).any()) for p in xy])
        cut = None
        for i in range(len(pts) - 2):
            ring = arc[i + 2 :] - arc[i]
            js = i + 2 + np.flatnonzero((ring >= cfg.least_ring) & (ring <= cfg.most_ring))
            js = js[np.hypot(*(xy[js] - xy[i]).T) <= cfg.close] if len(js) else js
            cut = next(((i, j) for j in js if not served[i + 1 : j].any()), None)
            if cut:
                break
        if not cut:
            break
        pts = np.concatenate([pts[: cut[0] + 1], pts[cut[1] :]])
    return pts


_POINT = "struct<lon:double,lat:double>"
_SHAPE = "shape_id string, points array<struct<lon:double,lat:double>>"


def shape_lines(feed: gtfs.Feed, ends: DataFrame, stops_of: DataFrame, cfg: ShapeConfig = ShapeConfig()) -> DataFrame:
    """(shape_id, points): ordered points, trimmed to the terminals and without stop-less loops; one shape a task row.

    ``ends`` (shape_id, first, last: point or null), ``stops_of`` (shape_id, at: points).
    """
    pts = gtfs.shape_points(feed).groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("points"))
    df = pts.join(ends, "shape_id", "left").join(stops_of, "shape_id", "left").select("shape_id", "points", "first", "last", "at")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                p = np.array([[x["lon"], x["lat"]] for x in r.points], dtype=float)
                if r.first is not None or r.last is not None:
                    point = lambda v: None if v is None else np.array([v["lon"], v["lat"]])
                    p = trim_to_stops(p, point(r.first), point(r.last), cfg)
                    at = np.array([[x["lon"], x["lat"]] for x in (r.at if r.at is not None else [])], dtype=float)
                    p = excise_loops(p, at, cfg)
                if len(p) >= 2:
                    rows.append((r.shape_id, [{"lon": a, "lat": c} for a, c in p.tolist()]))
            yield pd.DataFrame(rows, columns=["shape_id", "points"])

    return df.mapInPandas(run, _SHAPE)


def load_patterns(feed: gtfs.Feed, cover: float = 0.99, keep: Column | None = None, prefix: str = "", cfg: ShapeConfig = ShapeConfig()) -> DataFrame:
    """Patterns with route_id, shape_id, trips, stop_ids (sorted), stop_seq, term_a, term_b (stop ids), points.

    A pattern is a route with a shape, or without a shapes table a route with a
    distinct order of stops. ``keep`` is a predicate over ``gtfs.routes``, applied
    before the large tables are read. Each route keeps its most frequent patterns
    until they cover ``cover`` of its trips (above 1: all).
    """
    routes = gtfs.routes(feed)
    wanted = routes.where(keep) if keep is not None else routes
    trips = feed.table("trips").join(wanted.select("route_id"), "route_id", "left_semi").select("route_id", "shape_id", "trip_id")
    times = feed.table("stop_times").select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq")).where("seq IS NOT NULL")
    if not feed.has("shapes"):
        # Of one trip's rows with the same number the largest stop id stands.
        per = times.groupBy("trip_id", "seq").agg(F.max("stop_id").alias("stop_id")).groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))).alias("s"))
        order = per.where(F.size("s") > 1).select("trip_id", F.transform("s", lambda x: x["stop_id"]).alias("stop_seq"))
        out = trips.join(order, "trip_id").groupBy("route_id", "stop_seq").agg(F.count("*").alias("trips"))
        out = out.withColumn("shape_id", F.concat(F.lit("seq:"), F.substring(F.sha2(F.array_join("stop_seq", "\x1f"), 256), 1, 16)))
        out = out.withColumn("points", F.array().cast(f"array<{_POINT}>"))
    else:
        used = trips.where("shape_id <> ''")
        count = used.groupBy("route_id", "shape_id").agg(F.count("*").alias("trips"))
        calls = times.join(used.select("trip_id", "shape_id"), "trip_id").groupBy("shape_id", "seq").agg(F.max("stop_id").alias("stop_id"), F.collect_set("stop_id").alias("all"))
        s = calls.groupBy("shape_id").agg(
            F.array_sort(F.collect_list(F.struct("seq", "stop_id"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))).alias("stop_ids")
        )
        s = s.select("shape_id", "stop_ids", F.transform("s", lambda x: x["stop_id"]).alias("stop_seq"))
        at = gtfs.stops(feed).select("stop_id", F.struct("lon", "lat").alias("p"))
        ends = (
            s.select("shape_id", F.element_at("stop_seq", 1).alias("a"), F.element_at("stop_seq", -1).alias("b"))
            .join(at.select(F.col("stop_id").alias("a"), F.col("p").alias("first")), "a", "left")
            .join(at.select(F.col("stop_id").alias("b"), F.col("p").alias("last")), "b", "left")
            .select("shape_id", "first", "last")
        )
        stops_of = s.select("shape_id", F.explode("stop_ids").alias("stop_id")).join(at, "stop_id").groupBy("shape_id").agg(F.collect_list("p").alias("at"))
        out = count.join(shape_lines(feed, ends, stops_of, cfg), "shape_id").join(s, "shape_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("stop_seq", F.coalesce("stop_seq", none))
    if "stop_ids" not in out.columns:
        out = out.withColumn("stop_ids", F.array_sort(F.array_distinct("stop_seq")))
    out = keep_coverage(out, ["route_id"], "trips", ["shape_id"], cover)
    p = F.lit(prefix)
    own = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: F.concat(p, x))
    term = lambda i: F.concat(p, F.try_element_at("stop_seq", F.lit(i)))
    return out.select(
        F.concat(p, "route_id").alias("route_id"), F.concat(p, "shape_id").alias("shape_id"), "trips",
        own("stop_ids").alias("stop_ids"), own("stop_seq").alias("stop_seq"), term(1).alias("term_a"), term(-1).alias("term_b"), "points",
    )


def load_patterns_of(feeds: list[gtfs.Feed], cover: float = 0.99, keep: Column | None = None) -> DataFrame:
    """Patterns of several feeds; ids of the second on are prefixed ``f1:``, ``f2:``, terminals too."""
    out = load_patterns(feeds[0], cover, keep)
    for i, f in enumerate(feeds[1:], 1):
        out = out.unionByName(load_patterns(f, cover, keep, f"f{i}:"))
    return out


def direct_segments(paths: DataFrame, quantum: float = 1.0) -> DataFrame:
    """(path, run, points): steps between vertices that no earlier path drew, as maximal runs.

    ``paths``: (path, seq, x, y), paths in order of their number. A step is an
    unordered pair of quantised vertices; the lowest path owns it.
    """
    from pyspark.sql import Window as W

    from isochron.operators import lines

    seg = lines.segments(paths, ["path"]).withColumn("_a", F.struct(F.round(F.col("ax") / quantum).alias("i"), F.round(F.col("ay") / quantum).alias("j")))
    seg = seg.withColumn("_b", F.struct(F.round(F.col("bx") / quantum).alias("i"), F.round(F.col("by") / quantum).alias("j"))).where("_a <> _b")
    owner = F.row_number().over(W.partitionBy(F.least("_a", "_b"), F.greatest("_a", "_b")).orderBy("path", "seq")) == 1
    runs = lines.islands(seg.withColumn("own", owner), ["path"], ["seq"], "own")
    g = runs.groupBy("path", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "ax", "ay", "bx", "by"))).alias("s"))
    end = F.element_at("s", -1)
    pts = F.concat(F.transform("s", lambda x: F.struct(x["ax"].alias("x"), x["ay"].alias("y"))), F.array(F.struct(end["bx"].alias("x"), end["by"].alias("y"))))
    return g.select("path", "run", pts.alias("points"))


def match_gate(paths: DataFrame, share: float = 0.25, metres: float = 2000.0) -> DataFrame:
    """Paths (path, route_type, length, gap) that were matched too poorly: gaps above both limits; ferries are exempt."""
    from isochron.functions import modes

    return paths.where((modes.route_class(F.col("route_type")) != "ferry") & (F.col("gap") > share * F.col("length")) & (F.col("gap") > metres))
