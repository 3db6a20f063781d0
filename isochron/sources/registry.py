"""The feed registry and curated styles: small documents kept on the driver, as tables where they meet data."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions import modes

FEEDS = (
    "feed string, name string, gtfs string, rail string, streets string, stops string, out string, network string, bbox array<double>, corridors string, "
    "streets_from array<string>, members array<string>, overlays array<string>, derived boolean, chart_args string, onestop string"
)
_LISTS = ("streets_from", "members", "overlays")


def load_document(path: str) -> dict:
    """A JSON document; its keys keep their order."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def feed_table(spark: SparkSession, document: Mapping) -> DataFrame:
    """One row a feed or group, absent texts "" and absent lists empty; bbox null if it isn't four numbers."""
    rows = []
    for key, e in document.get("feeds", {}).items():
        box = [float(x) for x in e.get("bbox") or []]
        row = [key, *[str(e.get(c) or "") for c in ("name", "gtfs", "rail", "streets", "stops", "out", "network")], box if len(box) == 4 else None, str(e.get("corridors") or "")]
        row += [*[list(e.get(c) or []) for c in _LISTS], bool(e.get("derived")), str(e.get("chart_args") or ""), str(e.get("onestop") or "")]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, FEEDS)


def primary(feeds: DataFrame) -> DataFrame:
    """Adds ``primary``, the first file of the feed list."""
    return feeds.withColumn("primary", F.trim(F.get(F.split("gtfs", ","), 0)))


def upstream_pairs(feeds: DataFrame, files: list[str]) -> str:
    """``name=upstream`` for each listed file whose feed knows its upstream id, comma-joined in the files' order."""
    known = {r["primary"]: r["onestop"] for r in primary(feeds).where("size(members) = 0 AND onestop <> '' AND primary <> ''").select("primary", "onestop").collect()}
    out: dict[str, str] = {}
    for f in files:
        if f in known:
            out.setdefault(f.rsplit("/", 1)[-1].removesuffix(".zip"), known[f])
    return ",".join(f"{k}={v}" for k, v in out.items())


def upstream_by_prefix(files: list[str], pairs: str) -> dict[str, str]:
    """Feed prefix ("" for the first, ``f1``...) -> upstream id."""
    known = dict(p.split("=", 1) for p in pairs.split(",") if "=" in p)
    names = [f.rsplit("/", 1)[-1].removesuffix(".zip") for f in files]
    return {"" if i == 0 else f"f{i}": known[n] for i, n in enumerate(names) if n in known}


def rewrite_groups(document: dict, groups: list[dict], scope: set[str] | None = None) -> list[str]:
    """Put derived groups (members, overlays, bbox) into a registry document; returns their keys.

    A group takes over the key and name of the derived entry it shares most
    members with; derived entries in scope that no group takes over go.
    """
    feeds = document["feeds"]
    old = {k: set(e.get("members") or ()) for k, e in feeds.items() if e.get("derived") and (scope is None or set(e.get("members") or ()) & scope)}
    keys, taken = [], set()
    for g in groups:
        best = max((k for k in old if k not in taken and old[k] & set(g["members"])), key=lambda k: (len(old[k] & set(g["members"])), k), default=None)
        key = best or "-".join(["group", *g["members"][:1]])
        taken.add(key)
        entry = dict(feeds.get(key, {"name": g.get("name", key)}))
        entry |= {"members": list(g["members"]), "overlays": list(g["overlays"]), "bbox": [round(float(x), 4) for x in g["bbox"]], "derived": True}
        feeds[key] = entry
        keys.append(key)
    for k in old:
        if k not in taken:
            del feeds[k]
    return keys


@dataclass(frozen=True)
class StyleOptions:
    bullet_order: str = "color"
    caterpillars: bool = True
    map_stop_names: bool = True


def merge_styles(*documents: Mapping) -> tuple[modes.Style, StyleOptions]:
    """One style of several documents, later ones over earlier ones field by field; base is the class defaults."""
    style = modes.Style(dict(modes.DEFAULT_CLASSES))
    options = StyleOptions()
    for d in documents:
        classes = dict(style.classes)
        for name, c in (d.get("modes") or {}).items():
            base = classes.get(name, modes.ClassStyle())
            given = {a: c[b] for a, b in (("trunk", "trunk"), ("hidden", "hidden"), ("band_floor", "band_floor"), ("color", "color")) if c.get(b) is not None}
            classes[name] = replace(base, **given)
        pick = lambda table, key: {k.strip().lower(): e[key] for k, e in (d.get(table) or {}).items() if e.get(key) not in (None, "")}  # noqa: B023,E731
        hexes = lambda table: {k: v.strip().removeprefix("#") for k, v in pick(table, "color").items()}  # noqa: B023,E731
        agencies = d.get("agencies") or {}
        style = replace(
            style,
            classes=classes,
            route_trunk=style.route_trunk | pick("routes", "trunk"),
            route_color=style.route_color | hexes("routes"),
            agency_color=style.agency_color | hexes("agencies"),
            route_type=style.route_type | pick("routes", "route_type"),
            route_name=style.route_name | pick("routes", "name"),
            hidden_routes=style.hidden_routes | {k for k, v in pick("routes", "hidden").items() if v},
            line_agencies=style.line_agencies | {k for k, e in agencies.items() if e.get("line_colors")},
        )
        o = d.get("options") or {}
        options = StyleOptions(o.get("bullet_order") or options.bullet_order, o.get("caterpillars", options.caterpillars), o.get("osm_stop_names", options.map_stop_names))
    return style, options


def repair_routes(routes: DataFrame, style: modes.Style) -> DataFrame:
    """Curated route types in place, hidden routes and routes of hidden classes dropped; before any other filter."""
    fixed = modes.lookup(style.route_type, F.col("route_id"), F.col("short_name"), F.col("long_name")).cast("int")
    r = routes.withColumn("route_type", F.coalesce(fixed, F.col("route_type")))
    hidden = modes.lookup({k: True for k in style.hidden_routes}, F.col("route_id"), F.col("short_name"), F.col("long_name")).cast("boolean")
    return r.where(~F.coalesce(hidden, F.lit(False)) & ~modes.is_hidden(modes.route_class(F.col("route_type")), style))
