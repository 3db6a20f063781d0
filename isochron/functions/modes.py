"""Route types, physical layers and curated style as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The basic route types of the schedule format, and the ranges of its extended ones.
BASIC_TYPES = {0: "tram", 1: "metro", 2: "regional", 3: "bus", 4: "ferry", 5: "cable", 6: "aerial", 7: "funicular", 11: "bus", 12: "monorail"}
TYPE_RANGES = (
    (405, 406, "monorail"),
    (100, 300, "regional"),
    (400, 500, "metro"),
    (700, 900, "bus"),
    (900, 1000, "tram"),
    (1000, 1300, "ferry"),
    (1300, 1400, "aerial"),
    (1400, 1500, "funicular"),
    (1700, 1800, "cable"),
)
CLASSES = ("unknown", "metro", "tram", "regional", "monorail", "funicular", "cable", "aerial", "ferry", "bus")


def route_class(route_type: Column) -> Column:
    """One of CLASSES for a route type; ``unknown`` for null and anything unlisted."""
    out = F.when(F.lit(False), "")
    for k, v in BASIC_TYPES.items():
        out = out.when(route_type == k, v)
    for lo, hi, v in TYPE_RANGES:
        out = out.when((route_type >= lo) & (route_type < hi), v)
    return out.otherwise("unknown")


def is_drawable(route_type: Column) -> Column:
    return route_class(route_type) != "unknown"


@dataclass(frozen=True)
class ClassStyle:
    """Policy of a class: how its routes are grouped, whether hidden, from which zoom band on, and how they are drawn."""

    trunk: str = "color"  # color, agency, route, intercity or none
    hidden: bool = False
    band_floor: int = 0
    color: str = ""
    width: float = 1.0
    opacity: float = 1.0


# Policies of the classes before any curation.
DEFAULT_CLASSES = {
    "metro": ClassStyle("color"),
    "tram": ClassStyle("color", width=0.75),
    "regional": ClassStyle("agency"),
    "monorail": ClassStyle("color", width=0.85),
    "funicular": ClassStyle("route", width=0.7),
    "cable": ClassStyle("route", width=0.75),
    "aerial": ClassStyle("route", width=0.6, opacity=0.75),
    "ferry": ClassStyle("route", band_floor=13, color="4A9EDB", width=0.7, opacity=0.65),
    "bus": ClassStyle("none", band_floor=15, color="888888", width=0.5, opacity=0.9),
    "unknown": ClassStyle("color"),
}


@dataclass(frozen=True)
class Style:
    """Class policies and curated overrides; passed explicitly wherever it matters."""

    classes: dict[str, ClassStyle] = field(default_factory=dict)
    route_trunk: dict[str, str] = field(default_factory=dict)
    route_color: dict[str, str] = field(default_factory=dict)
    agency_color: dict[str, str] = field(default_factory=dict)
    route_type: dict[str, int] = field(default_factory=dict)
    route_name: dict[str, str] = field(default_factory=dict)
    hidden_routes: frozenset[str] = frozenset()
    line_agencies: frozenset[str] = frozenset()

    def of(self, name: str) -> ClassStyle:
        return self.classes.get(name, ClassStyle())


def _by_class(cls: Column, style: Style, value) -> Column:
    out = F.when(F.lit(False), F.lit(value(ClassStyle())))
    for name in CLASSES:
        out = out.when(cls == name, F.lit(value(style.of(name))))
    return out


def is_hidden(cls: Column, style: Style) -> Column:
    return _by_class(cls, style, lambda s: s.hidden)


def band_floor(cls: Column, style: Style) -> Column:
    return _by_class(cls, style, lambda s: s.band_floor)


def is_trunked(cls: Column, style: Style) -> Column:
    return _by_class(cls, style, lambda s: s.trunk) != "none"


def lookup(table: dict[str, object], *identifiers: Column) -> Column:
    """The first non-empty identifier found (lower-cased, then without its feed prefix) wins; null if none is."""
    if not table:
        return F.lit(None)
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.lower(), v)])
    tries = [f(F.lower(c)) for c in identifiers for f in (lambda x: x, lambda x: F.regexp_replace(x, "^f[0-9]+:", ""))]
    return F.coalesce(*[F.try_element_at(pairs, F.when(t != "", t)) for t in tries])


def color_override(style: Style, route_id: Column, short: Column, long: Column, agency: Column) -> Column:
    return F.coalesce(lookup(style.route_color, route_id, short, long).cast("string"), lookup(style.agency_color, agency).cast("string"))


def trunk_key(style: Style, route_id: Column, short: Column, long: Column, agency: Column, color: Column, route_type: Column) -> Column:
    """The key under which routes are drawn as one line."""
    cls = route_class(route_type)
    trunk = F.coalesce(lookup(style.route_trunk, route_id, short, long).cast("string"), _by_class(cls, style, lambda s: s.trunk))
    own_lines = (agency == "") | agency.isin(*(style.line_agencies or {""}))
    trunk = F.when((trunk == "agency") & own_lines, "color").otherwise(trunk)
    route = F.concat(F.lit("route:"), route_id)
    by_agency = F.when(agency != "", F.concat(F.lit("agency:"), agency)).otherwise(route)
    return (
        F.when(trunk.isin("route", "none"), route)
        .when(trunk == "agency", by_agency)
        .when(trunk == "intercity", "intercity:rail")
        .otherwise(F.coalesce(color_override(style, route_id, short, long, agency), F.when(color != "", color), by_agency))
    )


# Tag values that make a way usable track, street or lane.
RAIL_VALUES = ("rail", "subway", "light_rail", "tram", "monorail", "funicular", "narrow_gauge")
AERIAL_VALUES = ("cable_car", "gondola", "mixed_lift")
STREET_VALUES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "busway", "bus_guideway",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
)


def track_class(railway: Column, aerialway: Column, route: Column) -> Column:
    """Class of a way from its tags; null if it isn't usable track."""
    return F.when(railway.isin(*RAIL_VALUES), railway).when(aerialway.isin(*AERIAL_VALUES), "aerial").when(route == "ferry", "seaway")


def way_layer(cls: Column) -> Column:
    return F.when(cls == "street", "street").when(cls == "seaway", "seaway").otherwise("rail")


def pattern_layer(route_type: Column) -> Column:
    """Physical layer a route runs on."""
    cls = route_class(route_type)
    return F.when(cls == "bus", "street").when(cls == "ferry", "seaway").otherwise("rail")


# Track classes a route class may ride; a class that isn't listed rides anything.
RIDES = {
    "metro": ("subway",),
    "tram": ("light_rail", "tram", "aerial", "monorail"),
    "cable": ("light_rail", "tram", "aerial", "monorail"),
    "regional": ("rail", "narrow_gauge", "light_rail"),
    "monorail": ("monorail",),
    "funicular": ("funicular",),
    "aerial": ("aerial",),
    "bus": ("street",),
    "ferry": ("seaway",),
}


def rides_on(route_type: Column, track: Column) -> Column:
    """Whether a route of that type may ride a track class; an empty class fits all."""
    cls = route_class(route_type)
    out = F.when(track == "", True)
    for k, v in RIDES.items():
        out = out.when(cls == k, track.isin(*v))
    return out.otherwise(True)


def level_class(bridge: Column, tunnel: Column, layer: Column) -> Column:
    """-1 below ground, 1 above, 0 level, from tags (null tags are absent)."""
    on = lambda c: F.coalesce((c != "") & (c != "no"), F.lit(False))
    n = F.coalesce(F.trim(layer).try_cast("int"), F.lit(0))
    return F.when(on(bridge), 1).when(on(tunnel), -1).when(n < 0, -1).when(n > 0, 1).otherwise(0)


def stop_classes(tags: Column) -> Column:
    """Sorted set of classes that a mapped stop serves, from its tag map."""
    v = lambda k: F.coalesce(F.lower(F.trim(F.try_element_at(tags, F.lit(k)))), F.lit(""))
    yes = lambda k: v(k).isin("yes", "true")
    rail, station = v("railway"), v("station")
    rules = (
        ("tram", (rail == "tram_stop") | (station == "light_rail") | yes("light_rail") | yes("tram")),
        ("regional", (rail == "halt") | (station == "train") | yes("train")),
        ("metro", (station == "subway") | (station == "light_rail") | yes("subway") | yes("light_rail")),
        ("monorail", (station == "monorail") | yes("monorail")),
        ("funicular", (station == "funicular") | yes("funicular")),
        ("aerial", v("aerialway") == "station"),
        ("cable", v("aerialway") == "station"),
        ("ferry", v("amenity") == "ferry_terminal"),
    )
    found = F.array_sort(F.array_compact(F.array(*[F.when(c, k) for k, c in rules])))
    plain = F.when(rail == "station", F.array(*map(F.lit, ("metro", "monorail", "regional", "tram")))).otherwise(F.array(F.lit("bus")))
    return F.when(F.size(found) > 0, found).otherwise(plain)
