"""Planar geometry as Column expressions.

The distance functions differ in where they take the cosine of the latitude and
in metres per degree; results depend on which one a caller uses, so each has its
own name.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_DEG = 111_320.0


@dataclass(frozen=True)
class Frame:
    """Local metric frame: x, y = degrees from the origin times metres per degree, x shrunk by cos(latitude)."""

    lon0: float
    lat0: float

    @property
    def kx(self) -> float:
        return M_PER_DEG * cos(radians(self.lat0))

    def x(self, lon: Column) -> Column:
        return (lon - self.lon0) * self.kx

    def y(self, lat: Column) -> Column:
        return (lat - self.lat0) * M_PER_DEG

    def lon(self, x: Column) -> Column:
        return x / self.kx + self.lon0

    def lat(self, y: Column) -> Column:
        return y / M_PER_DEG + self.lat0


def frame_of(west: float, south: float, east: float, north: float, anchor: tuple[float, float] | None = None) -> Frame:
    """Frame of an extent: its centre, or a given anchor."""
    return Frame(*anchor) if anchor else Frame((west + east) / 2, (south + north) / 2)


def cos_polynomial(degrees: Column) -> Column:
    """Cosine by its Taylor polynomial of fourth order."""
    x = degrees * 3.14159265358979 / 180
    return 1 - x * x / 2 + x * x * x * x / 24


def distance_mean_lat(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres, the cosine at the mean latitude."""
    return F.hypot((lon1 - lon2) * M_PER_DEG * F.cos(F.radians((lat1 + lat2) / 2)), (lat1 - lat2) * M_PER_DEG)


def distance_first_lat(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres, the cosine at the first latitude."""
    return F.hypot((lon1 - lon2) * M_PER_DEG * F.cos(F.radians(lat1)), (lat1 - lat2) * M_PER_DEG)


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Kilometres with 111.32 and 110.54 a degree."""
    return F.hypot((lon1 - lon2) * 111.32 * F.cos(F.radians(lat1)), (lat1 - lat2) * 110.54)


def clamp_distance(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - v, v - hi, F.lit(0.0))


def segment_param(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a-b (0 to 1) the point nearest to p lies; 0 for a segment of no length."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(n, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_param(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def segment_intersection(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column, tol: float = 1e-9) -> Column:
    """struct(x, y) where a-b and c-d meet (ends may miss by ``tol`` of their length); null if parallel or apart."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    den = rx * sy - ry * sx
    t = ((cx - ax) * sy - (cy - ay) * sx) / F.nullif(den, F.lit(0.0))
    u = ((cx - ax) * ry - (cy - ay) * rx) / F.nullif(den, F.lit(0.0))
    inside = t.between(-tol, 1 + tol) & u.between(-tol, 1 + tol)
    return F.when(inside, F.struct((ax + t * rx).alias("x"), (ay + t * ry).alias("y")))


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Change of heading at b on the way a, b, c, 0 to 180; 0 where a step has no length."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    cross, dot = ux * vy - uy * vx, ux * vx + uy * vy
    still = (F.hypot(ux, uy) == 0) | (F.hypot(vx, vy) == 0)
    return F.when(still, 0.0).otherwise(F.degrees(F.abs(F.atan2(cross, dot))))


def median_strand(centers: Column) -> Column:
    """Mean of the two middle values of the sorted array (the middle one of an odd number); 0 for an empty one."""
    a, n = F.array_sort(centers), F.size(centers)
    lo, hi = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(a, lo) + F.try_element_at(a, hi)) / 2).otherwise(0.0)


def boxes_meet(w1: Column, s1: Column, e1: Column, n1: Column, w2: Column, s2: Column, e2: Column, n2: Column) -> Column:
    """Whether two closed boxes share a point."""
    return (w1 <= e2) & (w2 <= e1) & (s1 <= n2) & (s2 <= n1)


def in_box(lon: Column, lat: Column, box: list[float], margin: float = 0.0) -> Column:
    w, s, e, n = box
    return lon.between(w - margin, e + margin) & lat.between(s - margin, n + margin)


def cell_trunc(v: Column, size: float) -> Column:
    """Grid cell truncated toward zero."""
    return (v / size).cast("int")


def cell_floor(v: Column, size: float) -> Column:
    """Grid cell rounded down."""
    return F.floor(v / size).cast("int")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Position in the unit square of the web map, origin north-west."""
    y = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    return (lon + 180) / 360, (1 - F.ln(F.tan(y) + 1 / F.cos(y)) / 3.141592653589793) / 2


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Tile column and row at a zoom."""
    x, y = mercator(lon, lat)
    n = 1 << zoom
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v * n))).cast("int")
    return at(x), at(y)


def clip_params(a: tuple[Column, Column], b: tuple[Column, Column], lo: float, hi: float) -> tuple[Column, Column]:
    """Entry and exit (0 to 1) of segment a-b in the square [lo, hi]; entry > exit where it misses."""
    t0, t1 = F.lit(0.0), F.lit(1.0)
    for p, q in ((a[0], b[0]), (a[1], b[1])):
        d = q - p
        near, far = (F.lit(lo) - p) / F.nullif(d, F.lit(0.0)), (F.lit(hi) - p) / F.nullif(d, F.lit(0.0))
        outside = (d == 0) & ((p < lo) | (p > hi))
        t0 = F.greatest(t0, F.when(outside, 2.0).when(d != 0, F.least(near, far)).otherwise(0.0))
        t1 = F.least(t1, F.when(outside, -1.0).when(d != 0, F.greatest(near, far)).otherwise(1.0))
    return t0, t1
