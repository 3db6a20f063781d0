"""Stations from stops: grouping, naming, transfers, ranking, and matches with mapped stops."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.functions import geo, masks, modes, names
from isochron.operators import coverage, similarity, spatial
from isochron.operators.components import connected_components
from isochron.plans.runtime import cut_lineage


@dataclass(frozen=True)
class StationConfig:
    """Merge distances in metres, and the weights of the importance score."""

    same_feed_m: float = 150.0
    cross_feed_m: float = 300.0
    window_margin: float = 0.02
    routes: float = 1.0
    lines: float = 1.5
    transfers: float = 2.0
    markers: float = 0.5
    terminus: float = 6.0


def stop_routes(patterns: DataFrame, routes: DataFrame, stops: DataFrame, bbox: list[float] | None = None, cfg: StationConfig = StationConfig()) -> DataFrame:
    """(stop_id, name, lon, lat, parent, routes) of stops that a drawn pattern other than a bus serves inside the window."""
    drawn = routes.where(modes.route_class(F.col("route_type")) != "bus").select("route_id")
    served = patterns.join(drawn, "route_id", "left_semi").select("route_id", F.explode("stop_ids").alias("stop_id")).distinct()
    inside = stops if bbox is None else stops.where(geo.in_box(F.col("lon"), F.col("lat"), bbox, cfg.window_margin))
    per_stop = served.groupBy("stop_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))
    return inside.join(per_stop, "stop_id")


def build_stations(served: DataFrame, stops: DataFrame, transfers: DataFrame, termini: DataFrame, cfg: StationConfig = StationConfig()) -> DataFrame:
    """Stations with name, lon, lat, stop_ids, routes, transfers, terminus.

    ``served`` from ``stop_routes``, all ``stops``, ``transfers`` (from_stop,
    to_stop), ``termini`` (stop_id). Stops group by parent; groups of the same
    normal name merge if a transfer links them, if their feed has no transfers and
    they are near, or if they are near and of different feeds.
    """
    key = F.when(F.col("parent") != "", F.col("parent")).otherwise(F.col("stop_id"))
    member = served.withColumn("key", key)
    vote = coverage.majority(member, ["key"], "name", out="voted").drop("votes")
    own = stops.where("parent = '' AND name <> ''").select(F.col("stop_id").alias("key"), F.col("name").alias("own"))
    group = member.groupBy("key").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).join(vote, "key").join(own, "key", "left")
    group = group.select("key", F.coalesce("own", "voted").alias("name"), "lon", "lat", names.feed_prefix(F.col("key")).alias("feed"))
    group = cut_lineage(group.withColumn("norm", names.normal_name(F.col("name"))))

    parent_of = stops.select("stop_id", F.when(F.col("parent") != "", F.col("parent")).otherwise(F.col("stop_id")).alias("k"))
    t = (
        transfers.join(parent_of.select(F.col("stop_id").alias("from_stop"), F.col("k").alias("ka")), "from_stop", "left")
        .join(parent_of.select(F.col("stop_id").alias("to_stop"), F.col("k").alias("kb")), "to_stop", "left")
        .select(F.coalesce("ka", "from_stop").alias("a"), F.coalesce("kb", "to_stop").alias("b"), names.feed_prefix(F.col("from_stop")).alias("feed"))
    )
    norm = lambda k: group.select(F.col("key").alias(k), F.col("norm").alias(f"n_{k}"))
    linked = t.where("a <> b").join(norm("a"), "a").join(norm("b"), "b").where("n_a = n_b").select("a", "b")
    has_transfers = t.select("feed").distinct().withColumn("_t", F.lit(True))
    g = group.join(has_transfers, "feed", "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    x, y = g, g.select(*[F.col(c).alias(f"{c}_b") for c in g.columns])
    # Same-named groups meet by name; a name that is very frequent is a skewed key, which AQE splits.
    pairs = x.join(y, (F.col("norm") == F.col("norm_b")) & (F.col("key") < F.col("key_b")))
    same = F.col("feed") == F.col("feed_b")
    dist = geo.distance_mean_lat(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b"))
    near = pairs.where(~(same & F.col("_t")) & (dist <= F.when(same, cfg.same_feed_m).otherwise(cfg.cross_feed_m))).select(F.col("key").alias("a"), F.col("key_b").alias("b"))
    comp = connected_components(linked.union(near).select(F.col("a").alias("u"), F.col("b").alias("v")))
    station = cut_lineage(group.join(comp, F.col("key") == F.col("node"), "left").select("key", "name", F.coalesce("component", "key").alias("station")))

    full = member.drop("name").join(station, "key")
    title = coverage.majority(full, ["station"], "name").drop("votes").withColumnRenamed("winner", "name")
    ids = full.select("station", "stop_id").union(station.join(stops.select(F.col("stop_id").alias("key")), "key", "left_semi").select("station", "key"))
    out = full.groupBy("station").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("routes"))
    both = t.where("a <> b").select("a", "b").union(t.where("a <> b").select("b", "a"))
    outside = both.join(station.select(F.col("key").alias("a"), "station"), "a").join(station.select(F.col("key").alias("b"), F.col("station").alias("other")), "b", "left")
    degree = outside.where(F.col("other").isNull() | (F.col("other") != F.col("station"))).groupBy("station").agg(F.count_distinct("b").alias("transfers"))
    ends = full.join(termini.select("stop_id").distinct(), "stop_id", "left_semi").select("station").distinct().withColumn("terminus", F.lit(True))
    return (
        out.join(title, "station")
        .join(ids.groupBy("station").agg(F.array_sort(F.collect_set("stop_id")).alias("stop_ids")), "station")
        .join(degree, "station", "left")
        .join(ends, "station", "left")
        .select("station", "name", "lon", "lat", "stop_ids", "routes", F.coalesce("transfers", F.lit(0)).alias("transfers"), F.coalesce("terminus", F.lit(False)).alias("terminus"))
    )


def station_lines(stations: DataFrame, routes: DataFrame, style: modes.Style = modes.Style()) -> DataFrame:
    """(station, lines, line_colors): distinct trunks and the majority colour of each."""
    color = names.display_color(modes.color_override(style, F.col("route_id"), F.col("short_name"), F.col("long_name"), F.col("agency")), F.lit(""), F.col("color"))
    trunk = modes.trunk_key(style, *[F.col(c) for c in ("route_id", "short_name", "long_name", "agency", "color", "route_type")])
    r = routes.select("route_id", color.alias("hex"), trunk.alias("trunk"))
    per = stations.select("station", F.explode("routes").alias("route_id")).join(r, "route_id")
    vote = coverage.majority(per, ["station", "trunk"], "hex")
    return vote.groupBy("station").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list("winner")).alias("line_colors"))


def station_activity(stations: DataFrame, patterns: DataFrame, pattern_masks: DataFrame) -> DataFrame:
    """(station, route_id, mask): hours in which a route's patterns call at one of the station's stops."""
    calls = patterns.select("route_id", names.shape_of_piece(F.col("shape_id")).alias("shape_id"), F.explode("stop_ids").alias("stop_id")).distinct()
    at = stations.select("station", F.explode("stop_ids").alias("stop_id"))
    return calls.join(at, "stop_id").select("station", "route_id", "shape_id").distinct().join(pattern_masks, ["route_id", "shape_id"]).groupBy("station", "route_id").agg(masks.merge_masks(F.col("mask")).alias("mask"))


def rank_stations(stations: DataFrame, cfg: StationConfig = StationConfig()) -> DataFrame:
    """Adds ``score`` and ``importance`` (percentile, ties at the lowest); columns routes, lines, transfers, markers, terminus."""
    score = (
        cfg.routes * F.size("routes") + cfg.lines * F.col("lines") + cfg.transfers * F.col("transfers") + cfg.markers * F.col("markers") + F.when(F.col("terminus"), cfg.terminus).otherwise(0.0)
    )
    return coverage.importance(stations.withColumn("score", score), "score")


def order_bullets(stations: DataFrame, labels: DataFrame, policy: str = "color") -> DataFrame:
    """(station, routes) in the order their bullets are shown.

    ``labels``: route_id, label, hex, sort_order. Policies: color (letters first by
    each colour's first label), feed (by the feed's order), natural (by label).
    """
    x = stations.select("station", F.explode("routes").alias("route_id")).join(labels, "route_id")
    nat = names.natural_key(F.col("label"))
    if policy == "feed":
        key = F.struct(F.when(F.col("sort_order") < 0, 2147483647).otherwise(F.col("sort_order")).alias("o"), nat.alias("n"), F.col("route_id"))
    elif policy == "natural":
        key = F.struct(nat.alias("n"), F.col("route_id"))
    else:
        rep = x.groupBy("station", "hex").agg(F.min_by("label", nat).alias("rep"))
        x = x.join(rep, ["station", "hex"])
        key = F.struct(names.letters_first_key(F.col("rep")).alias("r"), F.col("hex"), nat.alias("n"), F.col("route_id"))
    g = x.groupBy("station").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("route_id").alias("r")))).alias("s"))
    return g.select("station", F.transform("s", lambda v: v["r"]).alias("routes"))


def upstream_ids(stations: DataFrame, known: DataFrame) -> DataFrame:
    """(station, ids): ``upstream:stop`` of its stops, sorted and joined by ``;``. ``known``: prefix, upstream."""
    s = stations.select("station", F.explode("stop_ids").alias("stop_id")).withColumn("prefix", names.feed_prefix(F.col("stop_id")))
    j = s.join(known.where("upstream <> ''"), "prefix").select("station", F.concat("upstream", F.lit(":"), names.bare_id(F.col("stop_id"))).alias("p"))
    return j.groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("p")), ";").alias("ids"))


def match_map_stops(stations: DataFrame, stops: DataFrame, frame: geo.Frame, reach: float = 250.0) -> DataFrame:
    """(station, stop, dist, sim, lost): one-to-one matches of stations with mapped stops, best first.

    ``stations``: id (integer), name, lon, lat, classes; ``stops``: id (integer),
    name, lon, lat, classes, tokens. A pair must be in reach, share a class and be
    as similar as its distance asks.
    """
    a = stations.select("id", F.col("name").alias("feed_name"), "classes", names.name_tokens(F.col("name")).alias("tokens"), frame.x(F.col("lon")).alias("x"), frame.y(F.col("lat")).alias("y"))
    b = stops.select("id", F.col("name").alias("map_name"), "classes", "tokens", frame.x(F.col("lon")).alias("x"), frame.y(F.col("lat")).alias("y"))
    idf = cut_lineage(similarity.idf_weights(a, b))
    near = spatial.radius_join(a, b, reach).where(F.arrays_overlap("classes", "classes_r"))
    pairs = near.select("id", "id_r", "feed_name", "map_name_r", "tokens", "tokens_r", "dist")
    sim = similarity.weigh_pairs(pairs, idf, ["id", "id_r"], "tokens", "tokens_r").where(F.col("sim") >= similarity.needed_similarity(F.col("dist")))
    cands = cut_lineage(sim.withColumn("score", similarity.match_score(F.col("dist"), F.col("sim"), reach)))
    won = similarity.greedy_assignment(cands.select("id", "id_r", "score"), "id", "id_r").drop("score")
    best = cands.join(won, ["id", "id_r"])
    known = b.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct().withColumn("_known", F.lit(True))
    tok = best.select("id", "tokens_r", F.col("tokens").alias("own"), F.explode(F.array_distinct("tokens")).alias("token")).join(idf, "token").join(known, "token", "left")
    dropped = F.col("_known") & ~F.array_contains("tokens_r", F.col("token"))
    part = tok.groupBy("id").agg(F.sum("idf").alias("_all"), F.sum(F.when(dropped, F.col("idf")).otherwise(0.0)).alias("_out"))
    says_more = F.size(F.array_except("tokens_r", "tokens")) > 0
    lost = F.when(says_more | F.col("_all").isNull() | (F.col("_all") <= 0), 0.0).otherwise(F.col("_out") / F.col("_all"))
    return best.join(part, "id", "left").select(
        F.col("id").alias("station"), F.col("id_r").alias("stop"), "feed_name", F.col("map_name_r").alias("map_name"), "dist", "sim", lost.alias("lost")
    )


def adopt_names(stations: pd.DataFrame, matches: pd.DataFrame, better: pd.Series, near_m: float = 60.0) -> pd.DataFrame:
    """Stations (id, name, lon, lat) renamed where all holders of a name agree on a better one.

    ``matches`` (station, map_name) in order; ``better`` tells which of them improve.
    A name moves only if every station that has it moves with it, and a target
    that others hold already is taken only if they all stand within ``near_m``.
    The order matters, as each move changes who holds a name; run it on one
    map's stations at a time (``applyInPandas`` by map).
    """
    out = stations.copy()
    name = dict(zip(out["id"], out["name"], strict=True))
    groups: dict[str, tuple[set, list]] = {}
    for (sid, new), ok in zip(matches[["station", "map_name"]].itertuples(index=False), better, strict=True):
        if ok:
            targets, ids = groups.setdefault(name[sid], (set(), []))
            targets.add(new)
            ids.append(sid)
    held = out["name"].value_counts().to_dict()
    pos = {i: (a, b) for i, a, b in zip(out["id"], out["lon"], out["lat"], strict=True)}

    def apart(i, j) -> float:
        import math

        (x1, y1), (x2, y2) = pos[i], pos[j]
        return math.hypot((x1 - x2) * 111_320 * math.cos(math.radians(y1)), (y1 - y2) * 111_320)

    for old, (targets, ids) in groups.items():
        (new, *more) = sorted(targets)
        if more or new == old or len(ids) != held.get(old, 0):
            continue
        holders = [i for i, n in name.items() if n == new]
        if holders and not all(any(apart(h, i) <= near_m for i in ids) for h in holders):
            continue
        for i in ids:
            name[i] = new
        del held[old]
        held[new] = len(ids)
    out["name"] = out["id"].map(name)
    return out


def snap_to_ribbons(stations: DataFrame, segs: DataFrame, reach: float = 150.0) -> DataFrame:
    """(station, route, dist, t, x, y): the nearest segment that carries each of a station's routes.

    ``stations``: station, x, y, routes; ``segs``: seg, route, ax, ay, bx, by of the widest band.
    """
    pts = stations.select("station", "x", "y", F.explode("routes").alias("route"))
    pairs = spatial.nearest_segment(pts, segs, reach, ["seg"], ["route"])
    best = spatial.nearest(pairs, ["station", "route"], ["seg_r"])
    return best.select(
        "station", "route", "dist", "t",
        (F.col("ax_r") + F.col("t") * (F.col("bx_r") - F.col("ax_r"))).alias("x"), (F.col("ay_r") + F.col("t") * (F.col("by_r") - F.col("ay_r"))).alias("y"),
    )


def cluster_snaps(snaps: DataFrame, reach: float = 20.0) -> DataFrame:
    """(station, marker, x, y, routes): snapped points of a station joined by single linkage within ``reach``."""

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("route").reset_index(drop=True)
        label = list(range(len(g)))
        for i in range(len(g)):
            for j in range(i):
                if ((g.x[i] - g.x[j]) ** 2 + (g.y[i] - g.y[j]) ** 2) ** 0.5 <= reach:
                    a, b = label[i], label[j]
                    label = [min(a, b) if v in (a, b) else v for v in label]
        rows = []
        for k, v in enumerate(sorted(set(label))):
            m = g[[x == v for x in label]]
            rows.append((g.station[0], k, m.x.mean(), m.y.mean(), sorted(m.route)))
        return pd.DataFrame(rows, columns=["station", "marker", "x", "y", "routes"])

    kind = snaps.schema["station"].dataType.simpleString()
    return snaps.select("station", "route", "x", "y").groupBy("station").applyInPandas(join, f"station {kind}, marker int, x double, y double, routes array<string>")
