"""What of a drawn map is visible at an instant, and where survivors move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import masks


def filter_band(segments: DataFrame, band: int) -> DataFrame:
    """Segments visible in a zoom band; bands are half open."""
    return segments.where((F.col("band_min") <= band) & (F.lit(band) < F.col("band_max")))


def parse_band(text: str) -> int:
    """A band name: ``union`` (-1) or the first zoom of a band."""
    if text in ("", "union"):
        return -1
    if text in ("15", "14", "13", "0"):
        return int(text)
    raise ValueError(f"band {text!r}: union, 15, 14, 13 or 0")


def _mask_on(mask: Column, day: Column, hour: Column) -> Column:
    """Whether a 42-digit mask has the hour; null if it isn't a mask."""
    return masks.is_active(masks.from_hex(mask), day, hour)


def route_active(acts: Column, fallback: Column, day: Column, hour: Column) -> Column:
    """One route: its own mask decides, then the route-wide one; without either it is active."""
    return F.coalesce(_mask_on(acts, day, hour), _mask_on(fallback, day, hour), F.lit(True))


def active_routes(routes: Column, acts: Column, fallback: Column, day: Column, hour: Column, modes: Column | None = None, off: list[str] | None = None) -> Column:
    """Indices (from 0) of the routes that are on; arrays are aligned, ``fallback`` maps a route to its mask."""
    def on(r: Column, i: Column) -> Column:
        ok = route_active(F.get(acts, i), F.try_element_at(fallback, r), day, hour)
        if modes is not None and off:
            ok &= ~F.coalesce(F.get(modes, i).isin(off), F.lit(False))
        return ok

    marked = F.transform(routes, lambda r, i: F.struct(i.alias("i"), on(r, i).alias("on")))
    return F.transform(F.filter(marked, lambda x: x["on"]), lambda x: x["i"])


def is_visible(routes: Column, active: Column) -> Column:
    """Features without routes always show; others while a route is on."""
    return (F.size(routes) == 0) | (F.size(active) > 0)


def infer_pitch(rows: DataFrame, group: list[str], offset: str, least: float = 0.01) -> DataFrame:
    """(group, pitch): the smallest gap above ``least`` between the sorted offsets of a bundle; null if there is none."""
    w = W.partitionBy(*group).orderBy(offset)
    gap = rows.select(*group, (F.col(offset) - F.lag(offset).over(w)).alias("_gap"))
    return gap.groupBy(*group).agg(F.min(F.when(F.col("_gap") > least, F.col("_gap"))).alias("pitch"))


def recenter(rows: DataFrame, group: list[str], slot: str, visible: str, pitch: Column) -> DataFrame:
    """Visible rows with ``offset``, their place among the visible of a bundle, centred, times the pitch."""
    vis = rows.where(F.col(visible))
    by = W.partitionBy(*group)
    i = F.row_number().over(by.orderBy(slot)) - 1
    return vis.withColumn("offset", (i - (F.count("*").over(by) - 1) / F.lit(2.0)) * pitch)


def apply_instant(segments: DataFrame, default_pitch: float = 6.0) -> DataFrame:
    """Hide inactive segments and move the rest of their bundles together.

    ``segments``: id, kind, color, bundle (null for transitions), slot, nslots,
    offset_px, off_from_px, off_to_px, active, and the end keys and directions
    (start_key, end_key, sx, sy, ex, ey). Bundles that lose nothing or all keep
    their offsets; transitions follow the steady pieces they touch, with the sign
    flipped where they run against them.
    """
    bundled = segments.where(F.col("kind").isin("steady", "bridge"))
    by = W.partitionBy("bundle")
    size, seen = F.count("*").over(by), F.sum(F.col("active").cast("int")).over(by)
    partly = bundled.withColumn("_size", size).withColumn("_seen", seen).where((F.col("_size") > 1) & (F.col("_seen") > 0) & (F.col("_seen") < F.col("_size")))
    pitch = infer_pitch(partly, ["bundle"], "offset_px")
    new = recenter(partly.join(pitch, "bundle"), ["bundle"], "slot", "active", F.coalesce("pitch", F.lit(default_pitch)))
    new = new.withColumn("_slot", (F.row_number().over(W.partitionBy("bundle").orderBy("slot")) - 1).cast("int"))
    new = new.select("id", "color", "start_key", "end_key", "sx", "sy", "ex", "ey", "offset_px", F.col("offset").alias("_off"), "_slot", F.col("_seen").cast("int").alias("_n"))
    moved = new.where(F.abs(F.col("_off") - F.col("offset_px")) > 0.01)
    ends = moved.select(F.col("start_key").alias("key"), "color", F.col("sx").alias("dx"), F.col("sy").alias("dy"), "_off", "id").unionByName(
        moved.select(F.col("end_key").alias("key"), "color", F.col("ex").alias("dx"), F.col("ey").alias("dy"), "_off", "id")
    )
    joint = ends.groupBy("key", "color").agg(F.max_by(F.struct("dx", "dy", F.col("_off").alias("off")), "id").alias("m"))
    at = lambda name, key: joint.select(F.col("key").alias(key), "color", F.col("m").alias(name))
    sign = lambda m, x, y: F.when(F.col(f"{m}.dx") * F.col(x) + F.col(f"{m}.dy") * F.col(y) >= 0, 1).otherwise(-1) * F.col(f"{m}.off")
    out = segments.where("active").join(new.select("id", "_off", "_slot", "_n"), "id", "left")
    out = out.join(at("_from", "start_key"), ["start_key", "color"], "left").join(at("_to", "end_key"), ["end_key", "color"], "left")
    turn = F.col("kind") == "transition"
    return out.select(
        "id", "kind", "color", "bundle",
        F.coalesce("_slot", "slot").alias("slot"), F.coalesce("_n", "nslots").alias("nslots"), F.coalesce("_off", "offset_px").alias("offset_px"),
        F.when(turn & F.col("_from").isNotNull(), sign("_from", "sx", "sy")).otherwise(F.col("off_from_px")).alias("off_from_px"),
        F.when(turn & F.col("_to").isNotNull(), sign("_to", "ex", "ey")).otherwise(F.col("off_to_px")).alias("off_to_px"),
    )


def serve_band(features: DataFrame, band: int) -> DataFrame:
    """Features that begin in a band, and those without one (``band_min`` null)."""
    return features.where(F.col("band_min").isNull() | (F.col("band_min") == band))
