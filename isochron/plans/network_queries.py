"""Corridor, line, station and extract operators over graphs and tracks made of the shared tables, each with the SQL it must equal.

Parts are edges, customers nodes, suppliers routes; a user's events in time are
a track, and the coordinates of vectors are points and segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import geo, masks, modes, names
from isochron.operators import corridor, dynamic, lines, stations
from isochron.plans.catalog import register, table
from isochron.plans.feed_queries import _HEX
from isochron.plans.spatial_queries import _PAIR, _PTS, _SEGS, _TRACK, _points, _track
from isochron.sources import etl, registry


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_EDGES = """e AS (SELECT 'e' || p_partkey AS edge, CASE WHEN p_size = 1 THEN '' ELSE 'n' || (p_partkey % 1450) END AS a, 'n' || (p_partkey * 7 % 1450) AS b,
  CASE WHEN p_size % 10 = 0 THEN []::VARCHAR[] ELSE ['R' || (p_size % 13), 'R' || (p_size % 7)] END AS routes FROM part)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        _text("e", k).alias("edge"), F.when(size == 1, "").otherwise(_text("n", k % 1450)).alias("from"), _text("n", k * 7 % 1450).alias("to"),
        F.when(size % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(_text("R", size % 13), _text("R", size % 7))).alias("routes"),
    )


@register("graph_problems", f"""WITH {_EDGES}, n AS (SELECT 'n' || (c_custkey % 1400) AS node FROM customer)
SELECT 'duplicate_node' AS problem, node AS id, count(*) AS n FROM n GROUP BY node HAVING count(*) > 1
UNION ALL SELECT 'dangling_end', x, count(*) FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) WHERE x <> '' AND x NOT IN (SELECT node FROM n) GROUP BY x
UNION ALL SELECT 'unknown_route', r, count(*) FROM (SELECT unnest(list_distinct(routes)) AS r FROM e) WHERE r NOT IN (SELECT 'R' || s_suppkey FROM supplier) GROUP BY r
UNION ALL SELECT 'no_routes', edge, 1 FROM e WHERE len(routes) = 0""")
def graph_problems(spark: SparkSession, d: str) -> DataFrame:
    """Repeated nodes, ends without a node, routes without a table row, edges without routes."""
    nodes = table(spark, d, "customer").select(_text("n", F.col("c_custkey") % 1400).alias("node"))
    return corridor.graph_problems(nodes, _edges(spark, d), table(spark, d, "supplier").select(_text("R", F.col("s_suppkey")).alias("route_id")))


@register("graph_routes", f"""WITH {_EDGES}, u AS (SELECT DISTINCT unnest(routes) AS r FROM e)
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'f1:' ELSE '' END || 'R' || s_suppkey AS route_id FROM supplier WHERE 'R' || s_suppkey IN (SELECT r FROM u)""")
def graph_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes that some edge names, with or without their feed's prefix."""
    k = F.col("s_suppkey")
    return corridor.route_filter(table(spark, d, "supplier").select(_text(F.when(k % 2 == 0, "f1:").otherwise(""), "R", k).alias("route_id")), _edges(spark, d))


@register("edge_route_masks", f"""WITH {_EDGES}, p AS (SELECT 'R' || (o_custkey % 13) AS route_id, (o_orderkey % 5 * 24 + o_custkey % 13 + o_orderkey % 4)::INTEGER AS cell FROM orders),
m AS (SELECT route_id, {_HEX} AS acts FROM p GROUP BY route_id)
SELECT edge, route_id, acts FROM (SELECT edge, unnest(list_distinct(routes)) AS route_id FROM e) JOIN m USING (route_id)""")
def edge_route_masks(spark: SparkSession, d: str) -> DataFrame:
    """The hours of a route's patterns on each edge it rides."""
    r, k = F.col("o_custkey") % 13, F.col("o_orderkey")
    mask = masks.set_hour(F.array_repeat(F.lit(0), 7), (k % 5).cast("int"), (r + k % 4).cast("int"))
    own = table(spark, d, "orders").select(_text("R", r).alias("route_id"), mask.alias("mask"))
    return corridor.edge_masks(_edges(spark, d), own).select("edge", "route_id", masks.to_hex(F.col("mask")).alias("acts"))


@register("restricted_edges", f"""WITH {_EDGES} SELECT edge, a AS "from", b AS "to", string_agg(r, ',' ORDER BY r) AS routes FROM (SELECT edge, a, b, unnest(list_distinct(routes)) AS r FROM e)
WHERE r IN (SELECT 'R' || s_suppkey FROM supplier WHERE s_acctbal > 3000) GROUP BY ALL""")
def restricted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the routes of a scenario, here suppliers of some balance; edges that lose all are dropped."""
    active = table(spark, d, "supplier").where("s_acctbal > 3000").select(_text("R", F.col("s_suppkey")).alias("route_id"))
    return corridor.restrict_routes(_edges(spark, d), active).withColumn("routes", F.array_join("routes", ","))


@register("graph_parts", """WITH RECURSIVE l AS (SELECT DISTINCT 'n' || (p_partkey % 60) AS a, 'n' || ((p_partkey + 12) % 60) AS b FROM part),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a), c AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT component, count(*) AS edges FROM part JOIN c ON c.a = 'n' || (p_partkey % 60) GROUP BY component""")
def graph_parts(spark: SparkSession, d: str) -> DataFrame:
    """Connected parts of a graph by their number of edges."""
    k = F.col("p_partkey")
    return corridor.graph_components(table(spark, d, "part").select(_text("n", k % 60).alias("from"), _text("n", (k + 12) % 60).alias("to")))


@register("route_traversals", """WITH e AS (SELECT c_custkey AS k, c_custkey // 10 AS r FROM customer WHERE NOT ((c_custkey // 10) % 3 = 0 AND c_custkey % 10 = 5)),
g AS (SELECT r, r % 3 = 0 AND min(k) % 10 < 5 AND max(k) % 10 > 5 AS gap, string_agg('e' || lpad(k::VARCHAR, 9, '0'), ',' ORDER BY k) AS ids FROM e GROUP BY r)
SELECT 'R' || r AS route_id, CASE WHEN gap THEN 'none' WHEN r % 4 = 1 THEN 'stops' ELSE 'structure' END AS evidence, CASE WHEN gap THEN '' ELSE ids END AS edge_ids FROM g""")
def route_traversals(spark: SparkSession, d: str) -> DataFrame:
    """Ways of routes of ten edges in a row: by their calls, by structure, or none where an edge is missing."""
    k = F.col("c_custkey")
    pad = lambda mark, c: _text(mark, F.lpad(c.cast("string"), 9, "0"))
    e = table(spark, d, "customer").select(k.alias("k"), F.floor(k / 10).alias("r")).where("NOT (r % 3 = 0 AND k % 10 = 5)")
    edges = e.select(pad("e", F.col("k")).alias("edge"), pad("n", F.col("k")).alias("from"), pad("n", F.col("k") + 1).alias("to"), F.lit(1.0).alias("length"), F.array(_text("R", F.col("r"))).alias("routes"))
    ends = e.where("r % 4 = 1").groupBy(_text("R", F.col("r")).alias("route_id")).agg(F.array(pad("n", F.min("k")), pad("n", F.max("k") + 1)).alias("nodes"))
    return corridor.traversals(edges, ends).withColumn("edge_ids", F.array_join("edge_ids", ","))


@register("snapped_ends", f"""WITH p AS ({_PTS}), h AS (SELECT a.id, arg_min('n' || b.id, (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 'n' || b.id)) AS node FROM p a JOIN p b ON a.id % 2 = 1 AND b.id % 2 = 0 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05 GROUP BY a.id)
SELECT p.id AS "end", coalesce(node, 'new:' || floor(x / 0.05)::BIGINT || ':' || floor(y / 0.05)::BIGINT) AS node FROM p LEFT JOIN h USING (id) WHERE p.id % 2 = 1""")
def snapped_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends (odd points) at the nearest node (even points) within reach, others at new nodes."""
    p = _points(spark, d)
    return corridor.snap_ends(p.where("id % 2 = 1").withColumnRenamed("id", "end"), p.where("id % 2 = 0").select(_text("n", F.col("id")).alias("node"), "x", "y"), 0.05)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i, c: F.col("embedding")[i].cast("double").alias(c)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("seg"), at(2, "ax"), at(3, "ay"), at(4, "bx"), at(5, "by"))


@register("ribbon_snaps", f"{_PAIR} SELECT id AS station, 'r' || (seg % 3) AS route, round(min(dist), 9) AS dist FROM d WHERE dist <= 0.1 AND seg % 3 <> (id + 2) % 3 GROUP BY ALL")
def ribbon_snaps(spark: SparkSession, d: str) -> DataFrame:
    """The nearest segment that carries each of a station's routes."""
    k = F.col("id")
    own = _points(spark, d).select(k.alias("station"), "x", "y", F.array(_text("r", k % 3), _text("r", (k + 1) % 3)).alias("routes"))
    got = stations.snap_to_ribbons(own, _segments(spark, d).withColumn("route", _text("r", F.col("seg") % 3)), 0.1)
    return got.select("station", "route", F.round("dist", 9).alias("dist"))


@register("station_orders", f"""{_PAIR}, q AS (SELECT id, seg, sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2)) AS dist, seg + t * sqrt(dx * dx + dy * dy) AS arc FROM t),
b AS (SELECT seg % 5 AS r, id, arg_min(arc, dist) AS arc FROM q WHERE dist <= 0.05 GROUP BY ALL)
SELECT 'r' || r AS route_id, string_agg('s' || id, ',' ORDER BY arc, 's' || id) AS stops FROM b GROUP BY r""")
def station_orders(spark: SparkSession, d: str) -> DataFrame:
    """Stops within reach of a route's segments, by place along them."""
    segs = _segments(spark, d).withColumns({"route_id": _text("r", F.col("seg") % 5), "edge": F.col("seg"), "at": F.col("seg").cast("double")})
    got = corridor.station_patterns(segs, _points(spark, d).select(_text("s", F.col("id")).alias("stop_id"), "x", "y"), 0.05)
    return got.select("route_id", F.array_join("stop_ids", ",").alias("stops"))


@register("cross_sections", f"""WITH p AS (SELECT *, cos(id) AS tx, sin(id) AS ty FROM ({_PTS})), s AS ({_SEGS}),
j AS (SELECT id, x, y, ax, ay, bx - ax AS dx, b_y - ay AS dy, -ty AS nx, tx AS n_y FROM p, s),
t AS (SELECT *, ((x - ax) * n_y - (y - ay) * nx) / nullif(dx * n_y - dy * nx, 0) AS t FROM j),
o AS (SELECT id, (ax + t * dx - x) * nx + (ay + t * dy - y) * n_y AS off FROM t WHERE t BETWEEN 0 AND 1)
SELECT id, count(*) AS n, round(sum(off), 6) AS total FROM o WHERE abs(off) <= 0.1 GROUP BY id""")
def cross_sections(spark: SparkSession, d: str) -> DataFrame:
    """Segments that the perpendicular of a sample meets within reach, with the signed offset."""
    p = _points(spark, d).withColumns({"tx": F.cos("id"), "ty": F.sin("id")})
    return lines.cross_sections(p, _segments(spark, d), 0.1).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("offset"), 6).alias("total"))


@register("strand_medians", """WITH o AS (SELECT l_orderkey, l_quantity, CASE WHEN l_quantity - lag(l_quantity) OVER w <= 4.5 THEN 0 ELSE 1 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)),
c AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS c FROM o), m AS (SELECT l_orderkey, c, avg(l_quantity) AS m FROM c GROUP BY ALL)
SELECT l_orderkey, count(*)::INTEGER AS strands, round(median(m), 6) AS middle FROM m GROUP BY l_orderkey""")
def strand_medians(spark: SparkSession, d: str) -> DataFrame:
    """Offsets that lie close together as one strand, and the middle strand."""
    s = lines.strand_clusters(table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("offset")), ["l_orderkey"])
    return s.select("l_orderkey", F.size("strands").alias("strands"), F.round(geo.median_strand(F.col("strands")), 6).alias("middle"))


@register("places_on_lines", f"""WITH p AS ({_TRACK}), s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
l AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY seq) AS arc FROM s),
g AS (SELECT user_id, x, y, arc AS a, lead(arc) OVER w AS b, lead(x) OVER w AS x2, lead(y) OVER w AS y2, seq = 1 AS head, lead(arc, 2) OVER w IS NULL AS tail FROM l WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
q AS (SELECT user_id, unnest([-1.0, 0.0, 500.0, 2500.0, 1e9])::DOUBLE AS arc FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT g.*, q.arc, coalesce(greatest(0, least(1, (q.arc - a) / nullif(b - a, 0))), 0) AS t FROM q JOIN g USING (user_id) WHERE b IS NOT NULL AND (q.arc >= a OR head) AND (q.arc < b OR tail))
SELECT user_id, arc, round(x + t * (x2 - x), 5) AS x, round(y + t * (y2 - y), 5) AS y FROM r""")
def places_on_lines(spark: SparkSession, d: str) -> DataFrame:
    """Where arcs before, on and beyond a track lie."""
    t = _track(spark, d)
    arcs = t.select("user_id").distinct().withColumn("arc", F.explode(F.array(*[F.lit(float(a)) for a in (-1, 0, 500, 2500, 1e9)])))
    return lines.points_at(t, ["user_id"], arcs).withColumns({"x": F.round("x", 5), "y": F.round("y", 5)})


@register("line_tangents", f"""WITH n AS (SELECT user_id, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, seq, round(dx / nullif(sqrt(dx * dx + dy * dy), 0), 8) AS tx, round(dy / nullif(sqrt(dx * dx + dy * dy), 0), 8) AS ty FROM n""")
def line_tangents(spark: SparkSession, d: str) -> DataFrame:
    """Unit directions from the point before to the one after."""
    return lines.tangents(_track(spark, d), ["user_id"], "seq").select("user_id", "seq", F.round("tx", 8).alias("tx"), F.round("ty", 8).alias("ty"))


_PATH = "SELECT 'u' || user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq, value / 1000 AS lon, hour(ts) / 1000 AS lat FROM events"


def _path(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(_text("u", F.col("user_id")).alias("line"), seq.alias("seq"), (F.col("value") / 1000).alias("lon"), (F.hour("ts") / 1000).alias("lat"))


_KM = "sqrt(pow((lon - lag(lon) OVER w) * 111.32 * cos(radians(lag(lat) OVER w)), 2) + pow((lat - lag(lat) OVER w) * 110.54, 2))"


@register("run_lengths", f"WITH s AS (SELECT line, {_KM} AS km FROM ({_PATH}) WINDOW w AS (PARTITION BY line ORDER BY seq)) SELECT line, round(coalesce(sum(km), 0), 5) AS km FROM s GROUP BY line")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Kilometres of each track."""
    w = W.partitionBy("line").orderBy("seq")
    s = _path(spark, d).select("line", geo.distance_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")).alias("km"))
    return s.groupBy("line").agg(F.round(F.coalesce(F.sum("km"), F.lit(0.0)), 5).alias("km"))


_RUNS = """f AS (SELECT *, bool_and(keep) OVER (PARTITION BY line) AS whole, seq - row_number() OVER (PARTITION BY line, keep ORDER BY seq) AS g FROM p),
k AS (SELECT *, dense_rank() OVER (PARTITION BY line ORDER BY g) - 1 AS run FROM f WHERE keep)"""


@register("clipped_lines", f"""WITH p AS (SELECT *, lon > 0.05 AS keep FROM ({_PATH})), {_RUNS},
s AS (SELECT *, {_KM} AS km FROM k WINDOW w AS (PARTITION BY line, run ORDER BY seq))
SELECT CASE WHEN whole THEN line ELSE line || '#clip' || run END AS line, count(*) AS points, min(seq)::INTEGER AS first FROM s GROUP BY line, run, whole HAVING whole OR sum(km) >= 30""")
def clipped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Runs of tracks inside a window that are long enough, each a line of its own."""
    return lines.clip_lines(_path(spark, d), "line", F.col("lon") > 0.05, 30.0).groupBy("line").agg(F.count("*").alias("points"), F.min("seq").alias("first"))


@register("trimmed_segments", f"""WITH p AS (SELECT 'u' || user_id AS line, seq, x, y, user_id % 4 = 0 AS turn, y > 50 AS keep FROM ({_TRACK})), {_RUNS},
s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM k WHERE NOT turn WINDOW w AS (PARTITION BY line, run ORDER BY seq)),
m AS (SELECT line, count(*) AS n FROM p WHERE turn GROUP BY line)
SELECT line || '#' || run AS seg, count(*) AS points, min(seq)::INTEGER AS first FROM s GROUP BY line, run HAVING sum(step) >= 200
UNION ALL SELECT line, n, 1 FROM m WHERE (line, n // 2 + 1) IN (SELECT (line, seq) FROM p WHERE keep)""")
def trimmed_segments(spark: SparkSession, d: str) -> DataFrame:
    """Steady segments cut to runs, transitions kept whole by their middle point."""
    t = _track(spark, d)
    pts = t.select(_text("u", F.col("user_id")).alias("seg"), F.when(F.col("user_id") % 4 == 0, "transition").otherwise("steady").alias("kind"), "seq", "x", "y")
    return lines.trim_segments(pts, "seg", "kind", F.col("y") > 50, 200.0).groupBy("seg").agg(F.count("*").alias("points"), F.min("seq").alias("first"))


@register("cropped_lines", f"SELECT line, count(*) AS points FROM ({_PATH}) GROUP BY line HAVING bool_or(lon BETWEEN 0.2 AND 0.3 AND lat BETWEEN 0.003 AND 0.004)")
def cropped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a vertex inside a window."""
    whole = _path(spark, d).groupBy("line").agg(F.collect_list(F.struct("lon", "lat")).alias("points"))
    return etl.crop(whole, [0.2, 0.003, 0.3, 0.004]).select("line", F.size("points").cast("bigint").alias("points"))


@register("element_stops", """SELECT 'node/' || c_custkey AS id, c_name AS name, round(CASE c_custkey % 3 WHEN 2 THEN 1.5 ELSE 1 END + c_nationkey, 9)::DOUBLE AS lon, round(c_acctbal / 1000 + CASE c_custkey % 3 WHEN 2 THEN 0.25 ELSE 0 END, 9) AS lat FROM customer WHERE c_custkey % 5 <> 0""")
def element_stops(spark: SparkSession, d: str) -> DataFrame:
    """Named mapped elements as one point: their own, their centre, or the mean of their outline."""
    k, lon, lat = F.col("c_custkey"), F.col("c_nationkey") + 1.0, F.col("c_acctbal") / 1000
    pt = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    e = table(spark, d, "customer").select(
        F.lit("node").alias("type"), k.alias("id"), F.create_map(F.lit("name"), F.when(k % 5 == 0, "").otherwise(F.col("c_name"))).alias("tags"),
        F.when(k % 3 == 0, lon).alias("lon"), F.when(k % 3 == 0, lat).alias("lat"), F.when(k % 3 == 1, pt(lon, lat)).alias("center"),
        F.when(k % 3 == 2, F.array(pt(lon, lat), pt(lon + 1, lat + 0.5))).alias("geometry"),
    )
    return etl.element_stops(e).select("id", F.col("tags")["name"].alias("name"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


_ONE = "list_aggregate([printf('%06x', {}) for i in range(7)], 'string_agg', '')"


@register("merged_mask_maps", f"""SELECT p_partkey, {_ONE.format("CASE WHEN i = p_size % 7 THEN 1 << (p_partkey % 24)::INTEGER WHEN i = (p_size + 1) % 7 AND p_size % 2 = 0 THEN 8 ELSE 0 END")} AS x,
CASE WHEN p_size % 2 = 1 THEN {_ONE.format("CASE WHEN i = (p_size + 1) % 7 THEN 8 ELSE 0 END")} END AS y FROM part""")
def merged_mask_maps(spark: SparkSession, d: str) -> DataFrame:
    """Hours by route of two edges that become one; masks of a shared route are united."""
    size, none = F.col("p_size"), F.array_repeat(F.lit(0), 7)
    a = F.create_map(F.lit("x"), masks.set_hour(none, (size % 7).cast("int"), (F.col("p_partkey") % 24).cast("int")))
    b = F.create_map(F.when(size % 2 == 0, "x").otherwise("y"), masks.set_hour(none, ((size + 1) % 7).cast("int"), F.lit(3)))
    m = table(spark, d, "part").select("p_partkey", masks.merge_mask_maps(a, b).alias("m"))
    return m.select("p_partkey", *[masks.to_hex(F.try_element_at("m", F.lit(k))).alias(k) for k in ("x", "y")])


@register("served_band", "SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR 10 + p_size % 6 = 13")
def served_band(spark: SparkSession, d: str) -> DataFrame:
    """Features that begin in a band, and those without one."""
    band = F.when(F.col("p_size") % 4 != 0, 10 + F.col("p_size") % 6)
    return dynamic.serve_band(table(spark, d, "part").select("p_partkey", band.alias("band_min")), 13).select("p_partkey")


@register("visible_features", "SELECT p_partkey, p_size % 5 = 0 OR p_size % 2 = 0 AS visible FROM part")
def visible_features(spark: SparkSession, d: str) -> DataFrame:
    """Features without routes, or with one that is on."""
    some = F.array(_text("R", F.col("p_size")))
    none = F.array().cast("array<string>")
    routes = F.when(F.col("p_size") % 5 == 0, none).otherwise(some)
    return table(spark, d, "part").select("p_partkey", dynamic.is_visible(routes, F.when(F.col("p_size") % 2 == 0, some).otherwise(none)).alias("visible"))


@register("repaired_routes", "SELECT 'R' || s_suppkey AS route_id, CASE WHEN s_suppkey = 3 THEN 2 ELSE s_suppkey % 5 END::INTEGER AS route_type FROM supplier WHERE s_suppkey <> 5 AND (s_suppkey = 3 OR s_suppkey % 5 <> 4)")
def repaired_routes(spark: SparkSession, d: str) -> DataFrame:
    """Curated types set, hidden routes and routes of hidden classes dropped."""
    style, _ = registry.merge_styles({"modes": {"ferry": {"hidden": True}}, "routes": {"r3": {"route_type": 2}, "R5": {"hidden": True}}})
    k = F.col("s_suppkey")
    routes = table(spark, d, "supplier").select(_text("R", k).alias("route_id"), F.lit("").alias("short_name"), F.lit("").alias("long_name"), (k % 5).cast("int").alias("route_type"))
    return registry.repair_routes(routes, style).select("route_id", "route_type")


@register("accents", "SELECT p_partkey, (2 + p_size % 4)::INTEGER AS accents FROM part")
def accents(spark: SparkSession, d: str) -> DataFrame:
    """Letters with a mark, in any case."""
    text = F.concat(F.lit("Ünter ärger "), F.expr("repeat('é', p_size % 4)"))
    return table(spark, d, "part").select("p_partkey", names.accent_count(text).alias("accents"))


@register("way_layers", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'street' WHEN 1 THEN 'seaway' ELSE 'rail' END AS layer FROM part")
def way_layers(spark: SparkSession, d: str) -> DataFrame:
    """What a mapped way is: street, seaway or, any other class, rail."""
    cls = F.when(F.col("p_size") % 3 == 0, "street").when(F.col("p_size") % 3 == 1, "seaway").otherwise("tram")
    return table(spark, d, "part").select("p_partkey", modes.way_layer(cls).alias("layer"))
