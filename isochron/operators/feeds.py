"""Feeds that share corridors: overlap, duplicates, groups, and what a change rebuilds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import geo
from isochron.operators import tables
from isochron.operators.components import connected_components
from isochron.plans.runtime import cut_lineage


@dataclass(frozen=True)
class GroupConfig:
    """Thresholds of feed grouping; lengths in metres, areas in square degrees."""

    cell_m: float = 60.0
    shared_m: float = 900.0
    step_m: float = 30.0
    most_samples: int = 4000
    member_area: float = 20.0
    duplicate_share: float = 0.85
    m_per_lon: float = 111_320.0
    m_per_lat: float = 110_540.0


def sample_shapes(points: DataFrame, line: list[str], cfg: GroupConfig = GroupConfig()) -> DataFrame:
    """(line, lon, lat) about every ``step_m`` along each line (columns seq, lon, lat); jumps of too many steps are left out."""
    w = W.partitionBy(*line).orderBy("seq")
    seg = points.select(*line, "seq", "lon", "lat", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    dx = (F.col("lon2") - F.col("lon")) * cfg.m_per_lon * F.cos(F.radians("lat"))
    dy = (F.col("lat2") - F.col("lat")) * cfg.m_per_lat
    n = F.greatest(F.lit(1), (F.hypot(dx, dy) / cfg.step_m).cast("int"))
    seg = seg.withColumn("n", F.when(F.col("lon2").isNull(), 1).otherwise(n)).where(F.col("n") <= cfg.most_samples)
    out = seg.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("j") / F.col("n")
    at = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    return out.select(*line, at("lon", "lon2").alias("lon"), at("lat", "lat2").alias("lat"))


def occupied_cells(samples: DataFrame, cfg: GroupConfig = GroupConfig()) -> DataFrame:
    """Distinct (feed, cell) of samples (feed, lon, lat); cells are truncated toward zero."""
    cell = F.struct(geo.cell_trunc(F.col("lon"), cfg.cell_m / cfg.m_per_lon).alias("x"), geo.cell_trunc(F.col("lat"), cfg.cell_m / cfg.m_per_lat).alias("y"))
    return samples.select("feed", cell.alias("cell")).distinct()


def shared_cells(cells: DataFrame) -> DataFrame:
    """(a, b, shared): cells that two feeds, a < b, both occupy.

    A cell's feeds are gathered once and paired inside the cell; their number is
    the number of feeds at one place, not of rows.
    """
    by_cell = cells.groupBy("cell").agg(F.array_sort(F.collect_set("feed")).alias("f")).where(F.size("f") > 1)
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return by_cell.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def duplicates(cells: DataFrame, share: float = 0.85) -> DataFrame:
    """(a, b, shared, held_out): pairs that share more than ``share`` of both; the smaller is held out (of equals the later)."""
    own = cells.groupBy("feed").agg(F.count("*").alias("n"))
    p = shared_cells(cells)
    p = p.join(own.select(F.col("feed").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("feed").alias("b"), F.col("n").alias("nb")), "b")
    p = p.where((F.col("shared") > share * F.col("na")) & (F.col("shared") > share * F.col("nb")))
    return p.withColumn("held_out", F.when(F.col("na") < F.col("nb"), F.col("a")).otherwise(F.col("b")))


def derive_groups(samples: DataFrame, drawn: DataFrame, boxes: DataFrame | None = None, cfg: GroupConfig = GroupConfig()) -> DataFrame:
    """(members, overlays, west, south, east, north) of feeds that belong on one map, largest first.

    ``samples`` (feed, lon, lat), ``drawn`` (feed) that have a build, ``boxes``
    (feed, west, south, east, north) their configured windows. Members are drawn
    feeds of regional extent that no other feed duplicates, connected by shared
    corridors; wide feeds that share with a member ride along as overlays.
    """
    samples = cut_lineage(samples)
    ext = samples.groupBy("feed").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    cells = cut_lineage(occupied_cells(samples, cfg))
    pairs = cut_lineage(shared_cells(cells).where(F.col("shared") * cfg.cell_m >= cfg.shared_m).select("a", "b"))
    dup = duplicates(cells, cfg.duplicate_share).join(pairs, ["a", "b"], "left_semi").select(F.col("held_out").alias("feed")).distinct()
    usable = ext.join(dup, "feed", "left_anti").join(drawn.select("feed").distinct(), "feed", "left_semi")
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    role = cut_lineage(usable.withColumn("member", area <= cfg.member_area))
    members = role.where("member")
    both = pairs.union(pairs.select("b", "a"))
    m = members.select(F.col("feed").alias("a"))
    links = pairs.join(m, "a", "left_semi").join(m.withColumnRenamed("a", "b"), "b", "left_semi")
    comp = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = members.join(comp, F.col("feed") == F.col("node"), "left").select("feed", F.coalesce("component", "feed").alias("root"), "west", "south", "east", "north")
    over = both.join(role.where("NOT member").select(F.col("feed").alias("a")), "a", "left_semi").join(root.select(F.col("feed").alias("b"), "root"), "b")
    overlays = over.groupBy("root").agg(F.array_sort(F.collect_set("a")).alias("overlays"))
    if boxes is not None:
        root = root.unionByName(root.select("feed", "root").join(boxes, "feed"))
    none = F.array().cast("array<string>")
    grouped = root.groupBy("root").agg(
        F.array_sort(F.collect_set("feed")).alias("members"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    )
    out = grouped.join(overlays, "root", "left").withColumn("overlays", F.coalesce("overlays", none)).drop("root")
    return out.where(F.size("members") + F.size("overlays") >= 2).orderBy(F.size("members").desc(), F.element_at("members", 1))


def changed_feeds(manifest: DataFrame, upstream: DataFrame) -> DataFrame:
    """(feed, change) between the stored and the upstream content hashes (feed, sha)."""
    return tables.snapshot_diff(manifest, upstream, "feed", "sha")


def window_closure(feeds: DataFrame, changed: DataFrame, cfg: GroupConfig = GroupConfig()) -> DataFrame:
    """(node): feeds whose window a changed feed reaches over overlapping windows.

    ``feeds`` (feed, west, south, east, north; null: everywhere). A wide feed is
    reached, but passes nothing on unless it changed itself.
    """
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    carrier = feeds.join(changed.select("feed", F.lit(True).alias("c")), "feed", "left").where(F.col("c") | F.col("west").isNull() | (area <= cfg.member_area)).drop("c")
    a, b = carrier.select(*[F.col(k).alias(f"{k}_a") for k in feeds.columns]), feeds
    meet = F.col("west_a").isNull() | F.col("west").isNull() | geo.boxes_meet(*[F.col(k + s) for s in ("_a", "") for k in ("west", "south", "east", "north")])
    # One row a feed on either side: a join of two registries, not of data.
    edges = cut_lineage(a.join(b, meet).select(F.col("feed_a").alias("src"), F.col("feed").alias("dst")).where("src <> dst"))
    return tables.closure(changed.join(feeds, "feed", "left_semi").select(F.col("feed").alias("node")), edges)


def affected_feeds(changed: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(feed): changed feeds, feeds that share with one, and everyone in a group (members, overlays) with one."""
    c = changed.select("feed").distinct()
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    partners = both.join(c.withColumnRenamed("feed", "a"), "a", "left_semi").select(F.col("b").alias("feed"))
    tied = groups.select("group", F.explode(F.concat("members", "overlays")).alias("feed"))
    hit = tied.join(c, "feed", "left_semi").select("group").distinct()
    return c.union(partners).union(tied.join(hit, "group", "left_semi").select("feed")).distinct()


def plan_groups(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """(group, action): create, delete, rebuild (entry changed or an input did) or keep, of keyed registries (group, members, overlays, window)."""
    entry = F.to_json(F.struct(F.array_sort("members"), F.array_sort("overlays"), "window"))
    diff = tables.snapshot_diff(before.select("group", entry.alias("e")), after.select("group", entry.alias("e")), "group", "e")
    inputs = after.select("group", F.explode(F.concat("members", "overlays")).alias("feed")).join(changed.select("feed").distinct(), "feed", "left_semi").select("group").distinct().withColumn("_hit", F.lit(True))
    action = F.when(F.col("change") == "created", "create").when(F.col("change") == "deleted", "delete").when((F.col("change") == "modified") | F.col("_hit"), "rebuild").otherwise("keep")
    return diff.join(inputs, "group", "left").select("group", action.alias("action"))


def ceded_windows(groups: DataFrame, key: str, primary: str) -> DataFrame:
    """(group, window) of the groups that carry ``primary`` though it isn't their member, but for ``key``."""
    g = groups.where(F.col("group") != key)
    return g.where(F.array_contains("overlays", primary) & ~F.array_contains("members", primary)).select("group", "window")


def window_sets(groups: DataFrame) -> DataFrame:
    """(overlay, windows): the sorted set of windows of the groups an overlay rides in, as one text."""
    return groups.select(F.explode("overlays").alias("overlay"), F.to_json("window").alias("w")).groupBy("overlay").agg(F.array_join(F.array_sort(F.collect_set("w")), ";").alias("windows"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, each closed by a line break."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\n")) for p in parts]), 256)


def stale_builds(specs: DataFrame, state: DataFrame) -> DataFrame:
    """(feed, fingerprint) of the builds whose fingerprint isn't the stored one."""
    s = state.select("feed", F.col("fingerprint").alias("_old"))
    return specs.join(s, "feed", "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).select("feed", "fingerprint")


def world_index(feeds: DataFrame, groups: DataFrame) -> DataFrame:
    """Feeds with a pyramid that no group contains, and the groups, by key."""
    inside = groups.select(F.explode("members").alias("feed")).distinct()
    return feeds.join(inside, "feed", "left_anti").orderBy("feed")
