"""Authored corridor graphs: validation, assembly, and the ways of routes over them."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.functions import masks
from isochron.operators import tables
from isochron.operators.components import connected_components


def graph_problems(nodes: DataFrame, edges: DataFrame, routes: DataFrame) -> DataFrame:
    """(problem, id, n): duplicate node ids, ends that name no node, routes that no table has, edges without routes.

    The first three make a graph unusable.
    """
    dup = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate_node").alias("problem"), F.col("node").alias("id"), F.col("count").alias("n"))
    ends = edges.select("edge", F.explode(F.array("from", "to")).alias("node")).where("node <> ''")
    dangling = ends.join(nodes.select("node").distinct(), "node", "left_anti").groupBy("node").count()
    ridden = edges.select(F.explode(F.array_distinct("routes")).alias("route_id")).join(routes.select("route_id").distinct(), "route_id", "left_anti").groupBy("route_id").count()
    empty = edges.where(F.size("routes") == 0).select(F.lit("no_routes").alias("problem"), F.col("edge").alias("id"), F.lit(1).cast("bigint").alias("n"))
    return (
        dup.unionByName(dangling.select(F.lit("dangling_end").alias("problem"), F.col("node").alias("id"), F.col("count").alias("n")))
        .unionByName(ridden.select(F.lit("unknown_route").alias("problem"), F.col("route_id").alias("id"), F.col("count").alias("n")))
        .unionByName(empty)
    )


def snap_ends(ends: DataFrame, nodes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(end, node): the nearest node within ``tolerance`` of each unnamed end (x, y), of equals the first id; others make new nodes.

    New nodes are shared by ends of one cell of the tolerance.
    """
    from isochron.operators import spatial

    hit = spatial.nearest(spatial.radius_join(ends, nodes, tolerance).select("end", F.col("node_r").alias("node"), "dist"), ["end"], ["node"]).select("end", "node")
    new = ends.join(hit, "end", "left_anti")
    cell = F.concat(F.lit("new:"), F.floor(F.col("x") / tolerance).cast("string"), F.lit(":"), F.floor(F.col("y") / tolerance).cast("string"))
    return hit.unionByName(new.select("end", cell.alias("node")))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """(lo, hi, n, divided): node pairs with several edges; divided ones are one-way in both directions, others duplicates."""
    own = edges.where("NOT gap").select(F.least("from", "to").alias("lo"), F.greatest("from", "to").alias("hi"), "from", "oneway")
    along = F.when(F.col("oneway") == "", 0).when((F.col("oneway") == "forward") == (F.col("from") == F.col("lo")), 1).otherwise(-1)
    g = own.withColumn("_d", along).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("_d").alias("_a"), F.max("_d").alias("_b"))
    return g.where("n > 1").select("lo", "hi", "n", ((F.col("_a") == -1) & (F.col("_b") == 1)).alias("divided"))


def graph_components(edges: DataFrame) -> DataFrame:
    """(component, edges): connected parts by number of edges, largest first."""
    comp = connected_components(edges.select(F.col("from").alias("u"), F.col("to").alias("v")))
    return edges.join(comp, F.col("from") == F.col("node")).groupBy("component").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "component")


def route_filter(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """The routes that some edge names, with or without a feed prefix."""
    from isochron.functions import names

    used = edges.select(F.explode("routes").alias("_r")).distinct()
    either = F.explode(F.array_distinct(F.array("route_id", names.bare_id(F.col("route_id")))))
    named = routes.select("route_id", either.alias("_r")).join(used, "_r", "left_semi").select("route_id")
    return routes.join(named, "route_id", "left_semi")


def edge_masks(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(edge, route_id, mask): the union of the masks of a route's patterns, on every edge it rides."""
    per_route = patterns.groupBy("route_id").agg(masks.merge_masks(F.col("mask")).alias("mask"))
    return edges.select("edge", F.explode(F.array_distinct("routes")).alias("route_id")).join(per_route, "route_id")


def restrict_routes(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges with only active routes (route_id); edges that lose all are dropped."""
    keep = edges.select("edge", F.explode("routes").alias("route_id")).join(active.select("route_id").distinct(), "route_id", "left_semi")
    left = keep.groupBy("edge").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))
    return edges.drop("routes").join(left, "edge")


def structural_walk(edges: list[tuple[str, str, str]]) -> list[str] | None:
    """Edge ids of a simple path or cycle over (edge, from, to), from its smaller end; None if it branches or is split."""
    at = defaultdict(list)
    for e, a, b in edges:
        at[a].append((e, b))
        at[b].append((e, a))
    if not edges or any(len(v) > 2 for v in at.values()):
        return None
    ends = sorted(n for n, v in at.items() if len(v) == 1)
    node, used, out = (ends[0] if ends else min(at)), set(), []
    while nxt := min(((e, b) for e, b in at[node] if e not in used), default=None):
        used.add(nxt[0])
        out.append(nxt[0])
        node = nxt[1]
    return out if len(out) == len(edges) else None


def shortest_path(edges: list[tuple[str, str, str, float]], source: str, target: str) -> list[str] | None:
    """Edge ids of the shortest way over (edge, from, to, length); ties by edge id; None if there is none."""
    out = defaultdict(list)
    for e, a, b, n in edges:
        out[a].append((e, b, n))
        out[b].append((e, a, n))
    queue: list[tuple[float, tuple[str, ...], str]] = [(0.0, (), source)]
    done = set()
    while queue:
        cost, path, node = heapq.heappop(queue)
        if node == target:
            return list(path)
        if node in done:
            continue
        done.add(node)
        for e, b, n in out[node]:
            if b not in done:
                heapq.heappush(queue, (cost + n, (*path, e), b))
    return None


def traversals(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id, evidence, edge_ids): how each route runs over the edges that name it.

    ``edges``: edge, from, to, length, routes; ``calls``: route_id, nodes (the
    nearest node of each stop in order). Stops give shortest rides from call to
    call; else the structure must be one path or cycle; else there is none. A
    route's subgraph is in one task.
    """
    sub = edges.select(F.explode(F.array_distinct("routes")).alias("route_id"), F.struct("edge", "from", "to", "length").alias("e"))
    g = sub.groupBy("route_id").agg(F.array_sort(F.collect_list("e")).alias("edges")).join(calls, "route_id", "left").select("route_id", "edges", "nodes")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                es = [(e["edge"], e["from"], e["to"], e["length"]) for e in r.edges]
                nodes = list(r.nodes) if r.nodes is not None else []
                legs = [shortest_path(es, a, c) for a, c in zip(nodes, nodes[1:], strict=False) if a != c]
                if len(nodes) > 1 and legs and all(x is not None for x in legs):
                    rows.append((r.route_id, "stops", [e for leg in legs for e in leg]))
                elif walk := structural_walk([e[:3] for e in es]):
                    rows.append((r.route_id, "structure", walk))
                else:
                    rows.append((r.route_id, "none", []))
            yield pd.DataFrame(rows, columns=["route_id", "evidence", "edge_ids"])

    return g.mapInPandas(run, "route_id string, evidence string, edge_ids array<string>")


def station_patterns(edges: DataFrame, stops: DataFrame, reach: float = 120.0) -> DataFrame:
    """(route_id, stop_ids): stops (stop_id, x, y) within reach of the segments (route_id, edge, at, ax, ay, bx, by) of a route, by place along it."""
    from isochron.operators import spatial

    arc = F.col("at_r") + F.col("t") * F.hypot(F.col("bx_r") - F.col("ax_r"), F.col("by_r") - F.col("ay_r"))
    asked = spatial.near_groups(stops, edges, reach, "route_id")
    near = spatial.nearest_segment(asked, edges, reach, ["at"], ["route_id"], arc).select("route_id", "stop_id", "dist", arc.alias("arc"))
    best = spatial.nearest(near, ["route_id", "stop_id"], ["arc"])
    g = best.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("arc", "stop_id"))).alias("s"))
    return g.select("route_id", F.transform("s", lambda x: x["stop_id"]).alias("stop_ids"))


def sole_overlays(groups: DataFrame, key: str) -> DataFrame:
    """Overlay feeds of a group that no other group has."""
    x = groups.select("group", F.explode("overlays").alias("feed"))
    return tables.missing_rows(x.where(F.col("group") != key).select("feed"), x.where(F.col("group") == key), "feed")


def arc_of(points: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
