"""Vector tile pyramids: addressing, clipping, simplification, encoding."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.operators.lines import simplify_points

TOP_ZOOM = 18
MOST_ACROSS = 8192
BUFFER = 256
EXTENT = 4096


def world(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Unit-square web map positions."""
    y = np.radians(np.clip(lat, -85.05112878, 85.05112878))
    return np.stack([(lon + 180) / 360, (1 - np.log(np.tan(y) + 1 / np.cos(y)) / np.pi) / 2], axis=1)


def zoom_range(band_min: Column, band_max: Column, top: int) -> tuple[Column, Column]:
    """First and last tile zoom of a half-open band; the deepest band reaches to the top."""
    last = F.when(band_max >= 24, F.lit(top)).otherwise(F.least(band_max - 1, F.lit(top)))
    return F.least(band_min, F.lit(top)), last


def extent_zoom(dx: float, dy: float, want: int) -> int:
    """The deepest zoom up to ``want`` at which an extent (unit square) is at most MOST_ACROSS tiles across."""
    while want > 0 and max(dx, dy) * (1 << want) > MOST_ACROSS:
        want -= 1
    return want


def clip_parts(p: np.ndarray, lo: float, hi: float) -> list[np.ndarray]:
    """The parts of a polyline inside the square [lo, hi]."""
    parts: list[list[np.ndarray]] = []
    for a, b in zip(p, p[1:], strict=False):
        d = b - a
        t0, t1 = 0.0, 1.0
        for k in (0, 1):
            if d[k] == 0:
                if not lo <= a[k] <= hi:
                    t0, t1 = 1.0, 0.0
            else:
                near, far = sorted(((lo - a[k]) / d[k], (hi - a[k]) / d[k]))
                t0, t1 = max(t0, near), min(t1, far)
        if t0 > t1:
            continue
        s, e = a + t0 * d, a + t1 * d
        if parts and t0 == 0 and np.array_equal(parts[-1][-1], s):
            parts[-1].append(e)
        else:
            parts.append([s, e])
    return [np.array(x) for x in parts]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _zigzag(n: int) -> int:
    return n << 1 ^ n >> 31 if n >= 0 else (-n << 1) - 1


def _geometry(parts: list[np.ndarray], point: bool) -> bytes:
    cmd, x, y = [], 0, 0
    if point:
        cmd.append(len(parts) << 3 | 1)
    for p in parts:
        q = p.tolist()
        if not point:
            cmd.append(1 << 3 | 1)
        cmd += [_zigzag(q[0][0] - x), _zigzag(q[0][1] - y)]
        x, y = q[0]
        if not point:
            cmd.append((len(q) - 1) << 3 | 2)
            for a, b in q[1:]:
                cmd += [_zigzag(a - x), _zigzag(b - y)]
                x, y = a, b
    return b"".join(map(_varint, cmd))


def _value(v: object) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(6 << 3) + _varint(_zigzag(v))
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def encode_layer(name: str, features: list[tuple[dict, list[np.ndarray], bool]], extent: int = EXTENT) -> bytes:
    """A layer of the vector tile format (version 2); features are (properties, integer parts, is point)."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = b""
    for properties, parts, point in features:
        tags = []
        for k, v in properties.items():
            if v is None or v == "":
                continue
            tags += [keys.setdefault(k, len(keys)), values.setdefault(_value(v), len(values))]
        f = _field(2, b"".join(map(_varint, tags))) if tags else b""
        f += _varint(3 << 3) + _varint(1 if point else 2) + _field(4, _geometry(parts, point))
        body += _field(2, f)
    out = _field(1, name.encode()) + body
    out += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values)
    return _field(3, out + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(2))


def assign_tiles(features: DataFrame, top: int, pad: float = BUFFER / EXTENT) -> DataFrame:
    """Features repeated for each tile (z, tx, ty) that a segment's buffered box touches in its zooms.

    ``features``: id, layer, zoom_min, zoom_max, points (lon, lat), properties.
    """
    from isochron.functions import geo

    w = features.withColumn("_w", F.transform("points", lambda p: F.struct(geo.mercator(p["lon"], p["lat"])[0].alias("x"), geo.mercator(p["lon"], p["lat"])[1].alias("y"))))
    z = w.withColumn("z", F.explode(F.sequence(F.col("zoom_min"), F.least(F.col("zoom_max"), F.lit(top)))))
    n = F.call_function("shiftleft", F.lit(1), F.col("z"))
    ends = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b")))).otherwise(
        F.array(F.struct(F.get("_w", F.lit(0)).alias("a"), F.get("_w", F.lit(0)).alias("b")))
    )
    at = lambda v, d: F.greatest(F.lit(0), F.least(n - 1, F.floor(v * n + d).cast("int")))

    def box(s: Column) -> Column:
        lo = lambda k: at(F.least(s["a"][k], s["b"][k]), -pad)
        hi = lambda k: at(F.greatest(s["a"][k], s["b"][k]), pad)
        return F.flatten(F.transform(F.sequence(lo("x"), hi("x")), lambda i: F.transform(F.sequence(lo("y"), hi("y")), lambda j: F.struct(i.alias("tx"), j.alias("ty")))))

    tiles = F.explode(F.array_distinct(F.flatten(F.transform(ends, box))))
    return z.withColumn("t", tiles).select("id", "layer", "properties", "points", "z", "t.tx", "t.ty")


def build_tiles(features: DataFrame, top: int, tolerance: float = 1.0) -> DataFrame:
    """(z, tx, ty, blob): one encoded tile each; ``properties`` is a JSON object."""
    import json

    placed = assign_tiles(features, top)

    def encode(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        z, tx, ty = (int(k) for k in key)
        blob = b""
        for layer, rows in g.sort_values(["layer", "id"]).groupby("layer", sort=True):
            out = []
            for r in rows.itertuples(index=False):
                p = world(np.array([q["lon"] for q in r.points]), np.array([q["lat"] for q in r.points]))
                local = (p * (1 << z) - [tx, ty]) * EXTENT
                if len(local) == 1:
                    if ((-BUFFER <= local) & (local <= EXTENT + BUFFER)).all():
                        out.append((json.loads(r.properties), [np.rint(local).astype(int)], True))
                    continue
                parts = []
                for part in clip_parts(local, -BUFFER, EXTENT + BUFFER):
                    q = np.rint(simplify_points(part, tolerance) if z < top else part).astype(int)
                    q = q[np.concatenate([[True], (np.diff(q, axis=0) != 0).any(axis=1)])]
                    if len(q) > 1:
                        parts.append(q)
                if parts:
                    out.append((json.loads(r.properties), parts, False))
            if out:
                blob += encode_layer(str(layer), out)
        return pd.DataFrame([(z, tx, ty, blob)] if blob else [], columns=["z", "tx", "ty", "blob"])

    return placed.groupBy("z", "tx", "ty").applyInPandas(encode, "z int, tx int, ty int, blob binary")


def tile_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(z, tx, ty, action): write, keep or prune, comparing blob hashes."""
    key = ["z", "tx", "ty"]
    a = old.select(*key, F.sha1("blob").alias("_a"))
    b = new.select(*key, F.sha1("blob").alias("_b"))
    action = F.when(F.col("_b").isNull(), "prune").when(F.col("_a").eqNullSafe(F.col("_b")), "keep").otherwise("write")
    return a.join(b, key, "full").select(*key, action.alias("action"))


def tile_manifest(features: DataFrame, top: int, template: str) -> dict:
    """Bounds and zooms of the features as a manifest."""
    p = features.select(F.explode("points").alias("p"))
    r = p.agg(F.min("p.lon"), F.min("p.lat"), F.max("p.lon"), F.max("p.lat")).first()
    low = features.agg(F.min("zoom_min")).first()[0] or 0
    return {"tilejson": "3.0.0", "tiles": [template], "minzoom": int(low), "maxzoom": top, "bounds": [round(v, 6) for v in r] if r[0] is not None else []}
