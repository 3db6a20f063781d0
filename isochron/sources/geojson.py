"""Track, street, stop and corridor extracts, and drawn networks, from GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions import modes, names, props

_FEATURES = "type string, features array<struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>>"
_LINE = "array<array<double>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, properties as JSON, kind, coordinates as JSON) of every feature of the collections at ``path``."""
    fc = spark.read.schema(_FEATURES).json(path, multiLine=True)
    f = fc.select(F.posexplode("features").alias("pos", "f"))
    return f.select("pos", "f.id", "f.properties", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates")


def features_of(spark: SparkSession, text: str) -> DataFrame:
    """``read_features`` of a collection held in memory."""
    one = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", _FEATURES).alias("fc"))
    return one.select(F.posexplode("fc.features").alias("pos", "f")).select("pos", "f.id", "f.properties", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates")


def _line(coords: Column) -> Column:
    """Array of (lon, lat) of LineString coordinates; null if they aren't two points or more."""
    pts = F.transform(F.from_json(coords, _LINE), lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))
    good = (F.size(pts) >= 2) & F.forall(pts, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.when(good, pts)


def _tags(properties: Column) -> Column:
    """Text properties as a map."""
    kept = F.map_filter(F.from_json(properties, "map<string,string>"), lambda _, v: v.isNotNull())
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def _tag(key: str) -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit(key)), F.lit(""))


def tracks(features: DataFrame) -> DataFrame:
    """(id, cls, level, tags, points) of usable track: rail, aerial and ferry ways without a service tag other than crossover."""
    w = features.where("kind = 'LineString'").withColumn("tags", _tags(F.col("properties"))).withColumn("points", _line(F.col("coordinates")))
    w = w.withColumn("cls", modes.track_class(_tag("railway"), _tag("aerialway"), _tag("route"))).where("cls IS NOT NULL AND points IS NOT NULL")
    w = w.where(_tag("service").isin("", "crossover"))
    ident = F.when(F.col("id").isNull() | (F.col("id") == ""), F.concat(F.lit("f"), F.col("pos").cast("string"))).otherwise(F.col("id"))
    return w.select(ident.alias("id"), "cls", modes.level_class(_tag("bridge"), _tag("tunnel"), _tag("layer")).alias("level"), "tags", "points")


def streets(features: DataFrame) -> DataFrame:
    """(id, cls = street, tags, points) of ways that buses ride."""
    w = features.where("kind = 'LineString'").withColumn("tags", _tags(F.col("properties"))).withColumn("points", _line(F.col("coordinates")))
    w = w.where(_tag("highway").isin(*modes.STREET_VALUES) & F.col("points").isNotNull())
    ident = F.when(F.col("id").isNull() | (F.col("id") == ""), F.concat(F.lit("s"), F.col("pos").cast("string"))).otherwise(F.col("id"))
    return w.select(ident.alias("id"), F.lit("street").alias("cls"), "tags", "points")


def map_stops(features: DataFrame) -> DataFrame:
    """(id, name, lon, lat, classes, tokens) of named points."""
    s = features.withColumn("tags", _tags(F.col("properties"))).withColumn("p", F.from_json("coordinates", "array<double>"))
    s = s.where((F.trim(_tag("name")) != "") & (F.size("p") >= 2) & F.get("p", 1).isNotNull())
    return s.select("id", _tag("name").alias("name"), F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"), modes.stop_classes(F.col("tags")).alias("classes"), names.name_tokens(_tag("name")).alias("tokens"))


def corridor_graph(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authored nodes (node, lon, lat) and edges (edge, from, to, routes, tracks, gap, oneway, points).

    Points without a ``node`` property take the feature's id; lines without ``edge`` too.
    """
    p = F.col("properties")
    named = lambda key: F.coalesce(F.when(props.any_string(p, key) != "", props.any_string(p, key)), F.col("id"), F.col("pos").cast("string"))
    pt = F.from_json("coordinates", "array<double>")
    nodes = features.where("kind = 'Point'").select(named("node").alias("node"), F.get(pt, 0).alias("lon"), F.get(pt, 1).alias("lat"))
    edges = features.where("kind = 'LineString'").select(
        named("edge").alias("edge"),
        props.any_string(p, "from").alias("from"),
        props.any_string(p, "to").alias("to"),
        props.route_list(props.any_string(p, "routes")).alias("routes"),
        props.any_int(p, "tracks").alias("tracks"),
        props.any_bool(p, "gap").alias("gap"),
        props.any_string(p, "oneway").alias("oneway"),
        _line(F.col("coordinates")).alias("points"),
    )
    return nodes, edges.where("points IS NOT NULL")


def drawn_network(spark: SparkSession, path: str) -> DataFrame:
    """(line, points, routes) of a hand-drawn reference."""
    schema = "lines array<struct<coords:array<array<double>>,routes:array<struct<label:string,color:string>>>>"
    n = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("lines").alias("line", "l"))
    return n.select("line", F.transform("l.coords", lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat"))).alias("points"), "l.routes")


def segment_features(features: DataFrame) -> DataFrame:
    """Typed columns of segment features; ``routes`` as an array, bands as ints."""
    p = F.col("properties")
    text = {k: props.any_string(p, k).alias(k) for k in ("kind", "color", "route_color", "label", "mode", "acts", "ridx")}
    num = {k: props.any_string(p, k).try_cast("double").alias(k) for k in ("offset_px", "off_from_px", "off_to_px", "len_m")}
    whole = {k: props.any_int(p, k).alias(k) for k in ("route_type", "slot", "nslots", "band_min", "band_max")}
    f = features.where("kind = 'LineString'").withColumnRenamed("kind", "_k")
    return f.select("pos", "id", *text.values(), *num.values(), *whole.values(), props.route_list(props.any_string(p, "routes")).alias("routes"), _line(F.col("coordinates")).alias("points")).where("points IS NOT NULL")


def build_features(features: DataFrame, band: int = 15, classes: tuple[str, ...] = ("metro", "tram")) -> DataFrame:
    """Segments of a band and of classes, for scoring."""
    s = segment_features(features)
    return s.where((F.col("band_min") <= band) & (F.col("band_max") >= band) & F.col("mode").isin(*classes))


def review_areas(spark: SparkSession, text: str) -> DataFrame:
    """(key, title, lat, lon, feed, bbox) of a list of review areas."""
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", "array<array<string>>")).alias("r"))
    at = lambda i: F.get("r", i)
    return rows.select(at(0).alias("key"), at(1).alias("title"), at(2).try_cast("double").alias("lat"), at(3).try_cast("double").alias("lon"), at(4).alias("feed"), F.from_json(at(5), "array<double>").alias("bbox"))
