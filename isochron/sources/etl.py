"""Preparing extracts: map dumps to track and stops, shapes to windows, pseudo-track and corridor graphs."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import geo
from isochron.operators.lines import simplify_points

_ELEMENTS = "elements array<struct<type:string,id:bigint,tags:map<string,string>,lon:double,lat:double,center:struct<lon:double,lat:double>,geometry:array<struct<lon:double,lat:double>>>>"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, tags, lon, lat, center, geometry) of the elements of map query results."""
    return spark.read.schema(_ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def resolve_lifecycle(tags: Column) -> Column:
    """Tags of disused track and track under construction with the class it has in use (plain rail if unnamed)."""
    rw = F.coalesce(F.try_element_at(tags, F.lit("railway")), F.lit(""))
    real = F.try_element_at(tags, F.concat(rw, F.lit(":railway")))
    fixed = F.map_concat(F.map_filter(tags, lambda k, _: k != "railway"), F.create_map(F.lit("railway"), F.coalesce(F.nullif(real, F.lit("")), F.lit("rail"))))
    return F.when(rw.isin("disused", "construction"), fixed).otherwise(tags)


def element_ways(elements: DataFrame) -> DataFrame:
    """(id, tags, points) of ways with a geometry."""
    w = elements.where("type = 'way' AND size(geometry) >= 2")
    return w.select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("id"), resolve_lifecycle(F.coalesce("tags", F.create_map().cast("map<string,string>"))).alias("tags"), F.col("geometry").alias("points"))


def representative_point(lon: Column, lat: Column, center: Column, geometry: Column) -> Column:
    """The element's own point, its centre, or the mean of its vertices."""
    n = F.size(geometry)
    mean = lambda k: F.aggregate(geometry, F.lit(0.0), lambda acc, p: acc + p[k]) / n
    pt = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    return F.when(lon.isNotNull() & lat.isNotNull(), pt(lon, lat)).when(center.isNotNull(), pt(center["lon"], center["lat"])).when(n > 0, pt(mean("lon"), mean("lat")))


def element_stops(elements: DataFrame) -> DataFrame:
    """(id, tags, lon, lat) of named elements of any kind, one point each."""
    p = representative_point(*[F.col(c) for c in ("lon", "lat", "center", "geometry")])
    named = elements.where(F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")) != "").withColumn("_p", p).where("_p IS NOT NULL")
    return named.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("id"), "tags", F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"))


def crop(lines: DataFrame, box: list[float]) -> DataFrame:
    """Lines with a vertex inside the window."""
    return lines.where(F.exists("points", lambda p: geo.in_box(p["lon"], p["lat"], box)))


def coverage_windows(points: DataFrame, cell: float = 0.5) -> DataFrame:
    """(west, south, east, north): boxes of horizontal runs of the cells around points, one cell wider on every side."""
    own = points.select(F.floor(F.col("lon") / cell).cast("int").alias("cx"), F.floor(F.col("lat") / cell).cast("int").alias("cy")).distinct()
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    pad = own.withColumn("d", around).select((F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")).distinct()
    runs = pad.withColumn("_run", F.col("cx") - F.row_number().over(W.partitionBy("cy").orderBy("cx")))
    box = runs.groupBy("cy", "_run").agg(F.min("cx").alias("a"), F.max("cx").alias("b"))
    return box.select((F.col("a") * cell).alias("west"), (F.col("cy") * cell).alias("south"), ((F.col("b") + 1) * cell).alias("east"), ((F.col("cy") + 1) * cell).alias("north"))


def pseudo_track(shapes: DataFrame, tolerance_deg: float = 25 / 111_320) -> DataFrame:
    """(shape_id, points): shapes simplified, as a stand-in where no track is mapped. ``shapes``: shape_id, points (lon, lat)."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                p = np.array([[x["lon"], x["lat"]] for x in r.points], dtype=float)
                q = simplify_points(p, tolerance_deg) if len(p) > 2 else p
                if len(q) > 1:
                    rows.append((r.shape_id, [{"lon": x, "lat": y} for x, y in q.tolist()]))
            yield pd.DataFrame(rows, columns=["shape_id", "points"])

    return shapes.select("shape_id", "points").mapInPandas(run, "shape_id string, points array<struct<lon:double,lat:double>>")


def corridor_graph_of(shapes: list[tuple[str, np.ndarray]], tolerance: float = 50 / 111_320, canon: float = 45 / 111_320) -> tuple[list[tuple], list[tuple]]:
    """Nodes (id, lon, lat) and edges (from, to, routes, points) of route shapes (route, points), longest first.

    Vertices snap to the first one seen within ``canon``; nodes are shape ends and
    places where the routes or the number of branches change. The order of the
    shapes decides who is first, so it is fixed: number of points, then route.
    """
    seen: dict[tuple[int, int], tuple[float, float]] = {}

    def snap(p: tuple[float, float]) -> tuple[float, float]:
        cx, cy = int(p[0] / canon), int(p[1] / canon)
        near = [v for i in (-1, 0, 1) for j in (-1, 0, 1) if (v := seen.get((cx + i, cy + j))) and np.hypot(v[0] - p[0], v[1] - p[1]) < canon]
        if near:
            return min(near, key=lambda v: np.hypot(v[0] - p[0], v[1] - p[1]))
        seen[cx, cy] = p
        return p

    routes: dict[tuple, set[str]] = defaultdict(set)
    near: dict[tuple, set[tuple]] = defaultdict(set)
    ends: set[tuple] = set()
    for route, pts in sorted(shapes, key=lambda s: (-len(s[1]), s[0])):
        line: list[tuple[float, float]] = []
        for p in simplify_points(pts, tolerance).tolist() if len(pts) > 2 else pts.tolist():
            q = snap(tuple(p))
            if not line or line[-1] != q:
                line.append(q)
        if len(line) < 2:
            continue
        ends |= {line[0], line[-1]}
        for a, b in zip(line, line[1:], strict=False):
            routes[min(a, b), max(a, b)].add(route)
            near[a].add(b)
            near[b].add(a)
    of = lambda a, b: routes[min(a, b), max(a, b)]
    nodes = sorted(v for v, ns in near.items() if v in ends or len(ns) != 2 or of(v, min(ns)) != of(v, max(ns)))
    name = {v: f"n{i}" for i, v in enumerate(nodes)}
    edges, done = [], set()
    for v in nodes:
        for n in sorted(near[v]):
            chain = [v, n]
            while chain[-1] not in name:
                (nxt,) = near[chain[-1]] - {chain[-2]}
                chain.append(nxt)
            key = min(tuple(chain), tuple(chain[::-1]))
            if key not in done:
                done.add(key)
                edges.append((name[chain[0]], name[chain[-1]], sorted(of(v, n)), chain))
    return [(name[v], *v) for v in nodes], edges
