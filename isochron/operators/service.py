"""When patterns run: calendars, trip spans, weekly activity, masks and scenarios."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha1

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.functions import clock, masks, modes
from isochron.operators.coverage import keep_coverage
from isochron.sources import gtfs

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
KEY = ["route_id", "shape_id"]


@dataclass(frozen=True)
class ScenarioConfig:
    cover: float = 0.99
    floor: float = 0.05
    cell_m: float = 100.0
    dilate_m: float = 60.0
    most_difference: int = 12
    least_cells: int = 3
    thin_m: float = 40.0


def service_weights(feed: gtfs.Feed) -> DataFrame:
    """(service_id, weekday, weight): 1 for a day set in the calendar, else the number of added dates on it.

    A service with any day set in the calendar ignores its dates.
    """
    cal = feed.table("calendar").withColumn("_row", F.monotonically_increasing_id())
    # of repeated services the last row with a day set
    flags = F.array(*[(F.col(d) == "1").cast("int") for d in DAYS])
    cal = cal.select("service_id", "_row", flags.alias("days")).where(F.exists("days", lambda x: x == 1)).groupBy("service_id").agg(F.max_by("days", "_row").alias("days"))
    regular = cal.select("service_id", F.posexplode("days").alias("weekday", "weight")).where("weight > 0")
    dated = (
        feed.table("calendar_dates")
        .where("exception_type = '1'")
        .select("service_id", clock.service_date_weekday(F.col("date")).alias("weekday"))
        .where("weekday IS NOT NULL")
        .join(cal, "service_id", "left_anti")
        .groupBy("service_id", "weekday")
        .agg(F.count("*").cast("int").alias("weight"))
    )
    return regular.unionByName(dated)


def trip_spans(feed: gtfs.Feed, trips: DataFrame) -> DataFrame:
    """(trip_id, first, last) seconds over the arrivals and departures of ``trips``, frequencies applied in file order."""
    times = feed.need("stop_times").join(trips.select("trip_id").distinct(), "trip_id", "left_semi")
    a, d = clock.parse_clock(F.col("arrival_time")), clock.parse_clock(F.col("departure_time"))
    spans = times.groupBy("trip_id").agg(F.min(F.least(a, d)).alias("first"), F.max(F.greatest(a, d)).alias("last")).where("first IS NOT NULL")
    if not feed.has("frequencies"):
        return spans
    freq = (
        feed.table("frequencies")
        .withColumn("_row", F.monotonically_increasing_id())
        .select("trip_id", "_row", clock.parse_clock(F.col("start_time")).alias("a"), clock.parse_clock(F.col("end_time")).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND b >= a")
        .groupBy("trip_id")
        .agg(F.array_sort(F.collect_list(F.struct("_row", "a", "b"))).alias("windows"))
    )
    start = F.struct(F.col("first").alias("a"), F.col("last").alias("b"), F.lit(False).alias("set"))

    def widen(acc: Column, w: Column) -> Column:
        end = w["b"] + acc["b"] - acc["a"]  # the run time is measured on the span so far
        return F.struct(
            F.when(acc["set"], F.least(acc["a"], w["a"])).otherwise(w["a"]).alias("a"),
            F.when(acc["set"], F.greatest(acc["b"], end)).otherwise(end).alias("b"),
            F.lit(True).alias("set"),
        )

    none = F.array().cast("array<struct<_row:bigint,a:int,b:int>>")
    folded = F.aggregate(F.coalesce("windows", none), start, widen)
    return spans.join(freq, "trip_id", "left").select("trip_id", folded["a"].alias("first"), folded["b"].alias("last"))


def activity(spans: DataFrame, weights: DataFrame) -> DataFrame:
    """(keys of ``spans``, cell 0..167, weight): rows of ``spans`` have service_id, first, last and key columns."""
    keys = [c for c in spans.columns if c not in ("service_id", "first", "last", "trip_id")]
    per_service = spans.select(*keys, "service_id", F.explode(clock.span_hours(F.col("first"), F.col("last"))).alias("hour"))
    # trips that share service and hour are added up before they meet the weekdays
    summed = per_service.groupBy(*keys, "service_id", "hour").agg(F.count("*").alias("n"))
    cell = clock.hour_of_week(F.col("weekday"), F.col("hour"))
    return summed.join(weights, "service_id").groupBy(*keys, cell.alias("cell")).agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))


def load_activity(feed: gtfs.Feed, prefix: str = "", drawable: Column | None = None) -> DataFrame:
    """(route_id, shape_id, cell, weight) of a feed's patterns; ``drawable`` is over ``gtfs.routes``."""
    if not (feed.has("calendar") or feed.has("calendar_dates")):
        raise gtfs.FeedError(f"{feed.path} has neither a calendar nor dated service")
    keep = modes.is_drawable(F.col("route_type")) if drawable is None else drawable
    wanted = gtfs.routes(feed).where(keep).select("route_id")
    weights = service_weights(feed)
    trips = feed.need("trips").where("shape_id <> ''").join(wanted, "route_id", "left_semi").join(weights.select("service_id").distinct(), "service_id", "left_semi")
    spans = trip_spans(feed, trips).join(trips, "trip_id").select("trip_id", "service_id", F.concat(F.lit(prefix), "route_id").alias("route_id"), "shape_id", "first", "last")
    return activity(spans, weights)


def load_activity_of(feeds: list[gtfs.Feed], drawable: Column | None = None) -> DataFrame:
    """Activity of several feeds, the first bare and the others with ids prefixed ``f1:``, ``f2:``; a broken overlay is left out."""
    out = load_activity(feeds[0], "", drawable)
    for i, f in enumerate(feeds[1:], 1):
        try:
            out = out.unionByName(load_activity(f, f"f{i}:", drawable))
        except gtfs.FeedError:
            continue
    return out


def pattern_masks(act: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, mask) with a bit for each cell of positive weight."""
    on = act.where("weight > 0")
    return on.groupBy(*(keys or KEY)).agg(masks.collect_mask(F.floor(F.col("cell") / 24), F.col("cell") % 24).alias("mask"))


def route_masks(act: DataFrame) -> DataFrame:
    """(route_id, acts): the hexadecimal union of a route's patterns."""
    m = pattern_masks(act, ["route_id"])
    return m.select("route_id", masks.to_hex(F.col("mask")).alias("acts"))


def select_patterns(act: DataFrame, cells: list[int] | None = None, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """(route_id, shape_id, weight) of the patterns that cover a route's activity in some cells (None: all)."""
    some = act if cells is None else act.where(F.col("cell").isin(cells))
    summed = some.groupBy(*KEY).agg(F.sum("weight").alias("weight")).where("weight > 0")
    return keep_coverage(summed, ["route_id"], "weight", ["shape_id"], cfg.cover, cfg.floor)


def select_by_cell(act: DataFrame, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """``select_patterns`` of each cell by itself, with the cell."""
    return keep_coverage(act.where("weight > 0"), ["cell", "route_id"], "weight", ["shape_id"], cfg.cover, cfg.floor)


def key_hash(keys: list[str]) -> str:
    """SHA-1 of sorted ``route|shape`` lines."""
    return sha1("\n".join(sorted(keys)).encode()).hexdigest()


def footprint(points: DataFrame, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """Distinct grid cells (columns of ``points`` but x and y, then cx, cy) within reach of metric points.

    The cell of a point is truncated toward zero, like the cells around it.
    """
    keys = [c for c in points.columns if c not in ("x", "y")]
    c = cfg.cell_m
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = points.select(*keys, "x", "y", near.alias("d")).select(
        *keys, "x", "y", ((F.col("x") / c).cast("int") + F.col("d.dx")).alias("cx"), ((F.col("y") / c).cast("int") + F.col("d.dy")).alias("cy")
    )
    gap = lambda v, k: F.greatest(F.col(k) * c - F.col(v), F.col(v) - (F.col(k) + 1) * c, F.lit(0.0))
    dx, dy = gap("x", "cx"), gap("y", "cy")
    return spread.where(dx * dx + dy * dy <= cfg.dilate_m**2).select(*keys, "cx", "cy").distinct()


def symmetric_difference(a: DataFrame, b: DataFrame, group: list[str], cell: list[str]) -> DataFrame:
    """(group, diff): cells of a group that only one of two distinct cell tables has; groups without a difference have 0."""
    x = a.select(*group, *cell).withColumn("_a", F.lit(1))
    y = b.select(*group, *cell).withColumn("_b", F.lit(1))
    return x.join(y, group + cell, "full").groupBy(*group).agg(F.sum(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1).otherwise(0)).alias("diff"))


def _label(cells: list[int]) -> str:
    names = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
    by_hours: dict[tuple[int, ...], list[int]] = {}
    for d in range(7):
        hours = tuple(h for h in range(24) if d * 24 + h in set(cells))
        if hours:
            by_hours.setdefault(hours, []).append(d)
    return "; ".join(f"{day_runs(days, names)} {hour_runs(hours)}" for hours, days in by_hours.items())


def day_runs(days: list[int], names: tuple[str, ...]) -> str:
    """Runs of consecutive weekdays as text."""
    runs: list[list[int]] = []
    for d in days:
        if runs and runs[-1][1] == d - 1:
            runs[-1][1] = d
        else:
            runs.append([d, d])
    return ",".join(names[a] if a == b else f"{names[a]}–{names[b]}" for a, b in runs)


def hour_runs(hours: tuple[int, ...]) -> str:
    """Runs of hours around the clock as text."""
    if len(hours) == 24:
        return "all day"
    on, out = set(hours), []
    for h in sorted(on):
        if (h - 1) % 24 not in on:
            end = h
            while (end + 1) % 24 in on:
                end = (end + 1) % 24
            out.append(f"{h:02d}–{(end + 1) % 24:02d}")
    return ",".join(out)


def build_scenarios(act: DataFrame, points: DataFrame, colors: DataFrame, cfg: ScenarioConfig = ScenarioConfig()) -> list[dict]:
    """Distinct service states of the week: id, label, cells, patterns and keys, largest first.

    ``act`` holds the patterns that may start a scenario, ``points`` (shape_id, x, y)
    their thinned metric shapes, ``colors`` (route_id, color). The relational part
    (selection by cell, footprints) runs on Spark; the merge works on at most 168
    hours and on which cells each pattern colours.
    """
    by_key = act.where("weight > 0").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("cell", "weight"))).alias("w"))
    weights = {(r["route_id"], r["shape_id"]): dict(r["w"]) for r in by_key.collect()}  # one row a pattern
    color = {r[0]: r[1] for r in colors.select("route_id", "color").collect()}
    ink = {r[0]: {(x["cx"], x["cy"]) for x in r[1]} for r in footprint(points, cfg).groupBy("shape_id").agg(F.collect_list(F.struct("cx", "cy"))).collect()}

    def select(cells: set[int]) -> frozenset[tuple[str, str]]:
        by_route: dict[str, list[tuple[int, str]]] = {}
        for (route, shape), w in weights.items():
            n = sum(w.get(c, 0) for c in cells)
            if n:
                by_route.setdefault(route, []).append((-n, shape))
        kept = set()
        for route, rows in by_route.items():
            total, seen = -sum(n for n, _ in rows), 0
            for i, (n, shape) in enumerate(sorted(rows)):
                if seen >= cfg.cover * total or i and -n < cfg.floor * total:
                    break
                kept.add((route, shape))
                seen -= n
        return frozenset(kept)

    def raster(keys: frozenset[tuple[str, str]]) -> dict[str, set[tuple[int, int]]]:
        out: dict[str, set[tuple[int, int]]] = {}
        for route, shape in keys:
            out.setdefault(color.get(route) or route, set()).update(ink.get(shape, ()))
        return out

    def gaps(a: dict, b: dict) -> list[int]:
        return [len(a.get(k, set()) ^ b.get(k, set())) for k in a.keys() | b.keys()]

    same = lambda a, b: all(x <= cfg.most_difference for x in gaps(a, b))
    hours = [select({c}) for c in range(168)]
    groups = {k: raster(k) for k in set(hours) if k}
    root = {k: k for k in groups}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for c in range(168):
        a, b = hours[c], hours[(c + 1) % 168]
        if a and b and find(a) != find(b) and same(groups[a], groups[b]):
            root[find(a)] = find(b)
    joined: dict[frozenset, set[int]] = {}
    for c in range(168):
        if hours[c]:
            joined.setdefault(find(hours[c]), set()).add(c)
    cells = sorted(joined.values(), key=min)
    keys = [select(c) for c in cells]
    ras = [raster(k) for k in keys]

    def merge(i: int, j: int) -> None:
        cells[i] |= cells.pop(j)
        keys.pop(j)
        ras.pop(j)
        keys[i] = select(cells[i])
        ras[i] = raster(keys[i])

    while pair := next(((i, j) for i in range(len(cells)) for j in range(i + 1, len(cells)) if same(ras[i], ras[j])), None):
        merge(*pair)
    while len(cells) > 1 and (small := min((len(c), i) for i, c in enumerate(cells)))[0] < cfg.least_cells:
        i = small[1]
        near = min((sum(gaps(ras[i], ras[j])), j) for j in range(len(cells)) if j != i)[1]
        merge(min(i, near), max(i, near))
    out = [
        {"id": key_hash([f"{r}|{s}" for r, s in k])[:8], "label": _label(sorted(c)), "patterns": len(k), "cells": sorted(c), "keys": sorted(k)}
        for c, k in zip(cells, keys, strict=True)
    ]
    return sorted(out, key=lambda s: (-len(s["cells"]), s["id"]))


def scenario_grid(scenarios: list[dict]) -> list[list[str]]:
    """7 x 24 scenario ids, "" where nothing runs."""
    grid = [[""] * 24 for _ in range(7)]
    for s in scenarios:
        for c in s["cells"]:
            grid[c // 24][c % 24] = s["id"]
    return grid


def metric_shapes(points: DataFrame, cfg: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """(shape_id, seq, x, y): shapes (shape_id, seq, lon, lat) in metres, thinned.

    The cosine is a polynomial at the first point of the smallest shape id, so
    footprints, and the ids made of them, can be reproduced.
    """
    from isochron.functions import geo
    from isochron.operators import lines

    lat0 = points.agg(F.min(F.struct("shape_id", "seq", "lat")).alias("m")).select(F.col("m.lat").alias("_lat0"))
    xy = points.crossJoin(F.broadcast(lat0)).select(  # one row
        "shape_id", "seq", (F.col("lon") * geo.M_PER_DEG * geo.cos_polynomial(F.col("_lat0"))).alias("x"), (F.col("lat") * geo.M_PER_DEG).alias("y")
    )
    return lines.thin(xy, "shape_id", cfg.thin_m)
