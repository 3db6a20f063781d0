"""Writing results: GeoJSON, the compact binary, vector tiles, adjusted feeds, manifests."""

from __future__ import annotations

import csv
import io
import json
import os
import struct
import tempfile
import zipfile
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.functions import names, props


def feature(properties: Column, kind: str, coordinates: Column) -> Column:
    """One GeoJSON feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def line_coordinates(points: Column, digits: int = 7) -> Column:
    """Array of [lon, lat] of an array of (lon, lat)."""
    return F.transform(points, lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits)))


def segment_features(segs: DataFrame) -> DataFrame:
    """(json) of segments with the output properties, ``acts`` joined by ``;`` and ``ridx`` where masks are given."""
    hexes = F.array_distinct("acts")
    index = F.transform("acts", lambda a: F.array_position(hexes, a).cast("int") - 1)
    p = F.struct(
        "kind", "color", "route_color", F.array_join("routes", ",").alias("routes"), "label", "route_type", "mode", "slot", "nslots",
        "offset_px", "off_from_px", "off_to_px", "band_min", "band_max", F.round("len_m", 1).alias("len_m"),
        F.array_join("acts", ";").alias("acts"), props.acts_index(F.col("routes"), index).alias("ridx"),
    )
    return segs.select(feature(p, "LineString", line_coordinates(F.col("points"))).alias("json"))


def write_feature_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel; ``features`` has one ``json`` column."""
    features.select("json").write.mode("overwrite").text(path)


def write_collection(features: Iterable[str], path: str) -> None:
    """One FeatureCollection file, streamed feature by feature; ``null`` features for none."""
    def parts():
        first = True
        yield '{"type":"FeatureCollection","features":'
        for f in features:
            yield ("[" if first else ",") + f
            first = False
        yield "null}" if first else "]}"

    atomic_write(path, (p.encode() for p in parts()))


def iter_json(features: DataFrame, order: list[str] | None = None) -> Iterable[str]:
    """The ``json`` column in order, fetched partition by partition."""
    df = features.orderBy(*order) if order else features
    return (r[0] for r in df.select("json").toLocalIterator())


def atomic_write(path: str, chunks: Iterable[bytes]) -> None:
    """Write beside the target, then rename over it."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


# Layout of the compact segment file, version 1. Little-endian; a header
# of 32 bytes (magic, version u16, flags u16, features, positions, band i32, offset of the
# strings, two zeros), positions as i32 pairs, starts, kinds u8, colours u32, then blocks
# interleaved by feature: three f32, five i16, four u32; kinds and i16 padded to 4 bytes;
# last the strings, counted and each with its length, the first one empty.
BINARY_MAGIC = 0x424E4C50
BINARY_VERSION = 1
BINARY_HEADER = "<IHHIIiIII"
DEGREE_SCALE = 10_000_000
KIND_CODES = {"steady": 0, "transition": 1, "bridge": 2}
F32_BLOCK = ("offset_px", "off_from_px", "off_to_px")
I16_BLOCK = ("slot", "nslots", "band_min", "band_max", "route_type")
U32_BLOCK = ("label", "mode", "routes", "acts")


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 4)


def encode_segments(rows: Iterable[Mapping], band: int = -1) -> bytes:
    """Segments (points, kind, color, the block columns; routes and acts as lists) as one binary block."""
    strings = {"": 0}
    put = lambda v: strings.setdefault(v or "", len(strings))
    pos: list[int] = []
    starts, kinds, colors, floats, shorts, refs = [0], bytearray(), [], [], [], []
    for r in rows:
        for p in r["points"]:
            pos += (round(p["lon"] * DEGREE_SCALE), round(p["lat"] * DEGREE_SCALE))
        starts.append(len(pos) // 2)
        kinds.append(KIND_CODES.get(r["kind"], 255))
        h = (r["color"] or "").strip().removeprefix("#")
        colors.append(int(h, 16) if len(h) == 6 and set(h) <= set("0123456789abcdefABCDEF") else 0)
        floats += [float(r[k] or 0) for k in F32_BLOCK]
        shorts += [int(r[k] or 0) for k in I16_BLOCK]
        refs += [put(r["label"]), put(r["mode"]), put(",".join(r["routes"] or ())), put(";".join(r["acts"] or ()))]
    pack = lambda code, v: struct.pack(f"<{len(v)}{code}", *v)
    body = pack("i", pos) + pack("I", starts) + _padded(bytes(kinds)) + pack("I", colors) + pack("f", floats) + _padded(pack("h", shorts)) + pack("I", refs)
    size = struct.calcsize(BINARY_HEADER)
    head = struct.pack(BINARY_HEADER, BINARY_MAGIC, BINARY_VERSION, 0, len(kinds), starts[-1], band, size + len(body), 0, 0)
    table = struct.pack("<I", len(strings)) + b"".join(struct.pack("<I", len(t.encode())) + t.encode() for t in strings)
    return head + body + table


def decode_segments(data: bytes) -> list[dict]:
    """Inverse of ``encode_segments``, positions to 1e-7 degree and colours as six hex digits."""
    magic, version, _, n, points, _, at_strings, _, _ = struct.unpack_from(BINARY_HEADER, data)
    if magic != BINARY_MAGIC or version != BINARY_VERSION:
        raise ValueError("not a segment block of version 1")
    at = struct.calcsize(BINARY_HEADER)

    def take(code: str, count: int) -> tuple:
        nonlocal at
        out = struct.unpack_from(f"<{count}{code}", data, at)
        at += -(-struct.calcsize(f"<{count}{code}") // 4) * 4
        return out

    xy, starts, kinds, colors = take("i", 2 * points), take("I", n + 1), take("B", n), take("I", n)
    floats, shorts, refs = take("f", 3 * n), take("h", 5 * n), take("I", 4 * n)
    at, texts = at_strings, []
    (count,) = take("I", 1)
    for _ in range(count):
        (size,) = struct.unpack_from("<I", data, at)
        texts.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    name = {v: k for k, v in KIND_CODES.items()}
    out = []
    for i in range(n):
        r = dict(zip(F32_BLOCK, floats[3 * i : 3 * i + 3], strict=True)) | dict(zip(I16_BLOCK, shorts[5 * i : 5 * i + 5], strict=True))
        label, mode, routes, acts = (texts[j] for j in refs[4 * i : 4 * i + 4])
        r |= {"label": label, "mode": mode, "routes": routes.split(",") if routes else [], "acts": acts.split(";") if acts else []}
        r |= {"kind": name.get(kinds[i], ""), "color": f"{colors[i]:06x}"}
        r["points"] = [{"lon": xy[2 * j] / DEGREE_SCALE, "lat": xy[2 * j + 1] / DEGREE_SCALE} for j in range(starts[i], starts[i + 1])]
        out.append(r)
    return out


def write_segments(segs: DataFrame, path: str, order: list[str], band: int = -1) -> None:
    """One file of segments in order: binary for ``.segb``, else GeoJSON; a band drops what it doesn't show."""
    from isochron.operators.dynamic import filter_band

    segs = segs if band < 0 else filter_band(segs, band)
    if path.endswith(".segb"):
        rows = (r.asDict(recursive=True) for r in segs.orderBy(*order).toLocalIterator())
        atomic_write(path, [encode_segments(rows, band)])
    else:
        json_rows = segment_features(segs.orderBy(*order))
        write_collection((r[0] for r in json_rows.toLocalIterator()), path)


def adjusted_shapes(shapes: DataFrame, new: DataFrame) -> DataFrame:
    """A feed's shape rows with those of matched shapes replaced; ``new`` (shape_id, points) in feed ids."""
    kept = shapes.join(new.select("shape_id").distinct(), "shape_id", "left_anti")
    rows = new.select("shape_id", F.posexplode("points").alias("i", "p"))
    fmt = lambda c: F.format_string("%.7f", c)
    added = rows.select("shape_id", fmt(F.col("p.lat")).alias("shape_pt_lat"), fmt(F.col("p.lon")).alias("shape_pt_lon"), (F.col("i") + 1).cast("string").alias("shape_pt_sequence"))
    return kept.unionByName(added)


def feed_shapes(paths: DataFrame, feed: int) -> DataFrame:
    """(shape_id, points) of one source feed: ids without prefix and piece suffix, whole shapes only."""
    own = paths.where(names.feed_index(F.col("route_id")) == feed)
    whole = own.where(names.shape_of_piece(F.col("shape_id")) == F.col("shape_id"))
    return whole.select(names.bare_id(F.col("shape_id")).alias("shape_id"), "points").dropDuplicates(["shape_id"])


def rewrite_zip(source: str, target: str, table: str, rows: Iterable[tuple], columns: list[str]) -> None:
    """Copy a zip, one table replaced; its columns keep their order in the file, others are empty."""
    with zipfile.ZipFile(source) as z:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as out:
            for name in z.namelist():
                if name.rsplit("/", 1)[-1] != f"{table}.txt":
                    out.writestr(name, z.read(name))
                    continue
                with z.open(name) as f:
                    header = [h.strip() for h in next(csv.reader(io.TextIOWrapper(f, "utf-8-sig")))]
                text = io.StringIO()
                w = csv.writer(text, lineterminator="\n")
                w.writerow(header)
                for r in rows:
                    d = dict(zip(columns, r, strict=True))
                    w.writerow([d.get(h, "") for h in header])
                out.writestr(name, text.getvalue())
    atomic_write(target, [buf.getvalue()])


def content_hashes(zips: DataFrame) -> DataFrame:
    """(path, sha) over name, size and bytes of the sorted text members; ``zips`` is a binaryFile frame."""
    import hashlib

    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                h = hashlib.sha256()
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in sorted(n for n in z.namelist() if n.endswith(".txt")):
                            raw = z.read(name)
                            h.update(f"{name}\0{len(raw)}\0".encode())
                            h.update(raw)
                    out.append((path, h.hexdigest()))
                except zipfile.BadZipFile:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "sha"])

    return zips.select("path", "content").mapInPandas(run, "path string, sha string")


def geometry_hash(coordinates: Column) -> Column:
    """18 hex digits of the SHA-1 of coordinate JSON."""
    return F.substring(F.sha1(coordinates.cast("binary")), 1, 18)


def marshal(document: object) -> bytes:
    """JSON with two-blank indents, ASCII only, keys in their order, a final line break."""
    return (json.dumps(document, indent=2, ensure_ascii=True) + "\n").encode()


def load_state(path: str, version: int = 1) -> dict:
    """A manifest; a missing file is an empty one, another version an error."""
    try:
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
    except FileNotFoundError:
        return {"version": version, "last_check": "", "feeds": {}}
    if state.get("version") != version:
        raise ValueError(f"{path}: manifest version {state.get('version')}; this reads {version}")
    return state


def save_state(state: dict, path: str) -> None:
    atomic_write(path, [marshal(state)])
