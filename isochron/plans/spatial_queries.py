"""Geometry, entity and scalar operators over the shared tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import clock, geo, masks, modes, names, props
from isochron.operators import coverage, dynamic, feeds, lines, ranking, similarity, spatial
from isochron.plans.catalog import register, table
from isochron.sources import etl

_PTS = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"
_SEGS = "SELECT vec_id AS seg, embedding[3]::DOUBLE AS ax, embedding[4]::DOUBLE AS ay, embedding[5]::DOUBLE AS bx, embedding[6]::DOUBLE AS b_y FROM embeddings"
_PAIR = f"""
WITH p AS ({_PTS}), s AS ({_SEGS}),
j AS (SELECT id, seg, x, y, ax, ay, bx - ax AS dx, b_y - ay AS dy FROM p, s),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM j),
d AS (SELECT id, seg, sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2)) AS dist FROM t)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_LL = "SELECT c_custkey AS id, (c_custkey % 360) - 180.0 AS lon, c_acctbal / 120 AS lat FROM customer"


def _lonlat(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 360) - 180.0).alias("lon"), (F.col("c_acctbal") / 120).alias("lat"))


@register("frame_projection", f"WITH p AS ({_LL}) SELECT id, round((lon - 10.0) * 111320 * cos(radians(20.0)), 4) AS x, round((lat - 20.0) * 111320, 4) AS y, round(1 - pow(lat * 3.14159265358979 / 180, 2) / 2 + pow(lat * 3.14159265358979 / 180, 4) / 24, 9) AS cheap_cos FROM p")
def frame_projection(spark: SparkSession, d: str) -> DataFrame:
    f = geo.frame_of(0, 10, 20, 30)
    p = _lonlat(spark, d)
    return p.select("id", F.round(f.x(F.col("lon")), 4).alias("x"), F.round(f.y(F.col("lat")), 4).alias("y"), F.round(geo.cos_polynomial(F.col("lat")), 9).alias("cheap_cos"))


@register("grid_cells", f"WITH p AS ({_LL}) SELECT trunc(lon / 7)::INTEGER AS tx, floor(lon / 7)::INTEGER AS fx, count(*) AS n, count(DISTINCT trunc(lat / 3)::INTEGER) * 60 AS run_m FROM p GROUP BY 1, 2")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    p = _lonlat(spark, d)
    g = p.groupBy(geo.cell_trunc(F.col("lon"), 7).alias("tx"), geo.cell_floor(F.col("lon"), 7).alias("fx"))
    return g.agg(F.count("*").alias("n"), (F.count_distinct(geo.cell_trunc(F.col("lat"), 3)) * 60).alias("run_m"))


_TRACK = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq, day(ts) * 24.0 + hour(ts) AS x, value AS y FROM events"


def _track(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), (F.dayofmonth("ts") * 24.0 + F.hour("ts")).alias("x"), F.col("value").alias("y"))


@register("densify", f"WITH s AS (SELECT user_id, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS n FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT user_id, cast(sum(greatest(1, ceil(n / 50))) + 1 AS BIGINT) AS points FROM s WHERE n IS NOT NULL GROUP BY user_id")
def densify(spark: SparkSession, d: str) -> DataFrame:
    return lines.densify(_track(spark, d), ["user_id"], 50.0).groupBy("user_id").agg(F.count("*").alias("points"))


@register("sharpest_turns", f"""WITH s AS (SELECT user_id, seq, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
t AS (SELECT user_id, CASE WHEN (ux = 0 AND uy = 0) OR (vx = 0 AND vy = 0) THEN 0 ELSE abs(degrees(atan2(ux * vy - uy * vx, ux * vx + uy * vy))) END AS turn FROM s WHERE ux IS NOT NULL AND vx IS NOT NULL)
SELECT user_id, round(max(turn), 6) AS max_turn, count(*) FILTER (turn > 25) AS spikes FROM t GROUP BY user_id""")
def sharpest_turns(spark: SparkSession, d: str) -> DataFrame:
    t = lines.turns(_track(spark, d), ["user_id"]).where("turn IS NOT NULL")
    return t.groupBy("user_id").agg(F.round(F.max("turn"), 6).alias("max_turn"), F.sum((F.col("turn") > 25).cast("bigint")).alias("spikes"))


@register("window_runs", """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 10 AS keep, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
f AS (SELECT l_orderkey, i, i - row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM o WHERE keep)
SELECT l_orderkey, min(i)::INTEGER AS first, max(i)::INTEGER AS last FROM f GROUP BY l_orderkey, g""")
def window_runs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    o = li.select("l_orderkey", (F.col("l_quantity") > 10).alias("keep"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("i"))
    return lines.islands(o, ["l_orderkey"], ["i"], "keep").groupBy("l_orderkey", "run").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("run")


@register("same_name_pairs", f"WITH s AS (SELECT s_suppkey AS id, s_nationkey AS name, s_suppkey % 3 AS feed, s_acctbal AS x FROM supplier) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.name = b.name AND a.id < b.id AND abs(a.x - b.x) <= CASE WHEN a.feed = b.feed THEN 1500 ELSE 3000 END AND NOT (a.feed = b.feed AND a.feed = 0)")
def same_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Same name and near: closer inside a feed than across feeds, and never inside the feed that has transfers."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("name"), (F.col("s_suppkey") % 3).alias("feed"), F.col("s_acctbal").alias("x"))
    t = s.select(*[F.col(c).alias(f"{c}_b") for c in s.columns])
    same = F.col("feed") == F.col("feed_b")
    near = F.abs(F.col("x") - F.col("x_b")) <= F.when(same, 1500).otherwise(3000)
    return s.join(t, (F.col("name") == F.col("name_b")) & (F.col("id") < F.col("id_b"))).where(near & ~(same & (F.col("feed") == 0))).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


@register("centroids", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS x, round(avg(c_custkey), 6) AS y, count(*) AS platforms FROM customer GROUP BY c_nationkey")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("x"), F.round(F.avg("c_custkey"), 6).alias("y"), F.count("*").alias("platforms"))


@register("trunk_lines", """WITH v AS (SELECT o_custkey, o_orderstatus AS trunk, o_orderpriority AS hex, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT o_custkey, trunk, hex FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey, trunk ORDER BY n DESC, hex) = 1)
SELECT o_custkey, count(*) AS lines, string_agg(hex, ',' ORDER BY hex) AS colors FROM w GROUP BY o_custkey""")
def trunk_lines(spark: SparkSession, d: str) -> DataFrame:
    v = coverage.majority(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority")
    return v.groupBy("o_custkey").agg(F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_list("winner")), ",").alias("colors"))


@register("bullet_order", """WITH s AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE chr((65 + s_suppkey % 26)::INTEGER) END AS label FROM supplier)
SELECT s_nationkey, string_agg(label, ' ' ORDER BY try_cast(label AS BIGINT) IS NOT NULL, CASE WHEN try_cast(label AS BIGINT) IS NULL THEN label ELSE '' END, try_cast(label AS BIGINT), s_suppkey) AS bullets FROM s GROUP BY s_nationkey""")
def bullet_order(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    label = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.char((65 + F.col("s_suppkey") % 26).cast("bigint")))
    k = s.select("s_nationkey", F.struct(names.letters_first_key(label).alias("k"), "s_suppkey", label.alias("label")).alias("x"))
    return k.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["label"]), " ").alias("bullets"))


@register("similarity_ramp", "WITH p AS (SELECT p_partkey, p_retailprice % 300 AS dist, p_size / 50.0 AS sim FROM part) SELECT p_partkey, round(CASE WHEN dist <= 45 THEN 0 ELSE (dist - 45) / 205.0 * 0.6 END, 9) AS needed, round(0.65 * (1 - dist / 250) + 0.35 * sim, 9) AS score FROM p")
def similarity_ramp(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") % 300).alias("dist"), (F.col("p_size") / 50.0).alias("sim"))
    return p.select("p_partkey", F.round(similarity.needed_similarity(F.col("dist")), 9).alias("needed"), F.round(similarity.match_score(F.col("dist"), F.col("sim")), 9).alias("score"))


@register("better_names", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN false WHEN p_partkey % 4 = 1 THEN true WHEN p_size / 60.0 <= 0.45 THEN true ELSE false END AS better FROM part")
def better_names(spark: SparkSession, d: str) -> DataFrame:
    """Equal, shouted, and differently worded names, the last by the information they lose."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    feed = F.when(k == 1, F.concat(F.lit("AB "), F.upper(name))).otherwise(name)
    other = F.when(k == 0, name).when(k == 1, F.concat(F.lit("Ab "), F.lower(name))).otherwise(F.concat(F.lit("zz "), name))
    return table(spark, d, "part").select("p_partkey", names.better_name(feed, other, F.col("p_size") / 60.0).alias("better"))


@register("labels", "SELECT p_partkey, replace(CASE WHEN p_size % 3 = 0 THEN p_type || ', ' || p_brand WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END, ',', ' ') AS label, CASE WHEN p_size % 3 = 1 THEN '888888' ELSE 'abcdef' END AS color FROM part")
def labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    over = F.when(k == 0, F.concat_ws(", ", "p_type", "p_brand")).otherwise("")
    short = F.when(k == 1, F.col("p_brand")).otherwise("")
    return table(spark, d, "part").select("p_partkey", names.display_label(over, short, F.col("p_name")).alias("label"), names.display_color(F.lit(None).cast("string"), F.lit(""), F.when(k == 1, "").otherwise("abcdef")).alias("color"))


@register("bullet_like", "SELECT p_partkey, length(b) <= 2 OR (length(b) <= 4 AND regexp_matches(b, '[0-9]')) OR (length(b) = 3 AND p_size % 4 <= 2) AS bullet FROM (SELECT p_partkey, p_size, substr(p_type, 1, (p_size % 5 + 1)::INTEGER) AS b FROM part)")
def bullet_like(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", names.is_bullet(F.substring(F.col("p_type"), F.lit(1), F.col("p_size") % 5 + 1), F.col("p_size") % 4).alias("bullet"))


@register("variant_labels", "WITH o AS (SELECT l_orderkey, list(DISTINCT l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN 'X' ELSE '' END) AS ls FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len([x for x in ls if ends_with(x, 'X') AND length(x) > 1 AND list_contains(ls, substr(x, 1, length(x) - 1))]) AS hidden FROM o")
def variant_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, "X").otherwise(""))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(label).alias("ls"))
    return o.select("l_orderkey", F.size(F.filter("ls", lambda x: names.variant_hidden(x, F.col("ls")))).cast("bigint").alias("hidden"))


@register("shape_pieces", "SELECT p_partkey, 's' || p_partkey AS shape FROM part")
def shape_pieces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    sid = F.concat(F.lit("s"), F.col("p_partkey").cast("string"), F.when(k == 0, "#clip12").when(k == 1, "#exc3#clip0").otherwise(""))
    return table(spark, d, "part").select("p_partkey", names.shape_of_piece(sid).alias("shape"))


@register("class_rides", "SELECT p_partkey, CASE WHEN p_partkey % 13 = 1 THEN t = 'subway' WHEN p_partkey % 13 IN (0, 5) THEN t = 'tram' WHEN p_partkey % 13 = 2 THEN t IN ('rail', 'narrow_gauge') WHEN p_partkey % 13 IN (3, 11) THEN t = 'street' WHEN p_partkey % 13 IN (4, 6, 7, 12) THEN false ELSE true END AS rides, CASE WHEN p_partkey % 13 IN (3, 11) THEN 'street' WHEN p_partkey % 13 = 4 THEN 'seaway' ELSE 'rail' END AS layer FROM (SELECT p_partkey, ['subway', 'tram', 'rail', 'narrow_gauge', 'street'][p_size % 5 + 1] AS t FROM part)")
def class_rides(spark: SparkSession, d: str) -> DataFrame:
    track = F.get(F.array(*map(F.lit, ("subway", "tram", "rail", "narrow_gauge", "street"))), F.col("p_size") % 5)
    kind = (F.col("p_partkey") % 13).cast("int")
    return table(spark, d, "part").select("p_partkey", modes.rides_on(kind, track).alias("rides"), modes.pattern_layer(kind).alias("layer"))


@register("active_routes", "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_shipdate::DATE - DATE '1970-01-01') % 24 AS h FROM lineitem) SELECT l_orderkey, count(*) FILTER (h <= 11) AS on_routes, count(*) AS routes FROM s GROUP BY l_orderkey")
def active_routes(spark: SparkSession, d: str) -> DataFrame:
    """Each line runs from its own hour on; which run at eleven on a Monday."""
    h = F.unix_date(F.to_date("l_shipdate")) % 24
    bits = F.call_function("shiftleft", F.lit(16777215), h).bitwiseAND(F.lit(16777215))
    acts = masks.to_hex(F.concat(F.array(bits), F.array_repeat(F.lit(0), 6)))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(acts).alias("acts"))
    routes = F.transform("acts", lambda x, i: i.cast("string"))
    idx = dynamic.active_routes(routes, F.col("acts"), F.create_map().cast("map<string,string>"), F.lit(0), F.lit(11))
    return o.select("l_orderkey", F.size(idx).cast("bigint").alias("on_routes"), F.size("acts").cast("bigint").alias("routes"))


@register("first_cells", "WITH c AS (SELECT DISTINCT user_id, (isodow(ts) - 1) * 24 + hour(ts) AS cell FROM events) SELECT user_id, cast(min(cell) AS INTEGER) AS first, count(*) AS cells FROM c GROUP BY user_id")
def first_cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(clock.hour_of_week(F.weekday("ts"), F.hour("ts"))).alias("s"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(167)), lambda i: F.array_contains("s", i))
    return c.select("user_id", masks.first_cell(cells).alias("first"), masks.cell_count(cells).cast("bigint").alias("cells"))


@register("world_index", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def world_index(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("feed"))
    g = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_orderkey").agg(F.collect_set("o_custkey").alias("members"))
    return feeds.world_index(f, g).select(F.col("feed").alias("c_custkey"))


@register("stale_builds", "SELECT p_partkey AS feed, sha256(p_name || chr(10) || p_brand || chr(10)) AS fingerprint FROM part WHERE p_partkey % 4 <> 0")
def stale_builds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("feed"), feeds.fingerprint(F.col("p_name"), F.col("p_brand")).alias("fingerprint"))
    state = p.where("feed % 4 < 2").select("feed", F.when(F.col("feed") % 4 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"))
    return feeds.stale_builds(p, state)


@register("geometry_hash", "SELECT o_orderkey, substr(sha1('[' || o_custkey || ',' || o_orderkey || ']'), 1, 18) AS hash FROM orders")
def geometry_hash(spark: SparkSession, d: str) -> DataFrame:
    from isochron.sources import sinks

    o = table(spark, d, "orders")
    return o.select("o_orderkey", sinks.geometry_hash(F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(","), F.col("o_orderkey").cast("string"), F.lit("]"))).alias("hash"))


@register("upstream_ids", "SELECT s_nationkey, string_agg(DISTINCT 'u' || (s_suppkey % 3) || ':' || s_name, ';' ORDER BY 'u' || (s_suppkey % 3) || ':' || s_name) AS ids FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY s_nationkey")
def upstream_ids(spark: SparkSession, d: str) -> DataFrame:
    from isochron.operators import stations

    s = table(spark, d, "supplier")
    sid = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string"), F.lit(":"), F.col("s_name")))
    st = s.groupBy(F.col("s_nationkey").alias("station")).agg(F.collect_list(sid).alias("stop_ids"))
    up = spark.createDataFrame([("", "u0"), ("f1", "u1"), ("f2", "")], "prefix string, upstream string")
    return stations.upstream_ids(st, up).select(F.col("station").alias("s_nationkey"), "ids")


@register("match_gate", "SELECT p_partkey FROM part WHERE p_size % 13 <> 4 AND p_retailprice * 10 > 2000 AND p_retailprice * 10 > 0.25 * p_partkey * 40")
def match_gate(spark: SparkSession, d: str) -> DataFrame:
    from isochron.operators import patterns

    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 13).alias("route_type"), (F.col("p_partkey") * 40).alias("length"), (F.col("p_retailprice") * 10).alias("gap"))
    return patterns.match_gate(p).select("p_partkey")


@register("clamp_distance", "SELECT c_custkey, greatest(1000 - c_acctbal, c_acctbal - 5000, 0) AS gap FROM customer")
def clamp_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", geo.clamp_distance(F.col("c_acctbal"), F.lit(1000.0), F.lit(5000.0)).alias("gap"))


@register("kind_codes", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 255 END AS code FROM orders")
def kind_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("o_orderstatus") == "O", "steady").when(F.col("o_orderstatus") == "F", "transition").otherwise("other")
    return table(spark, d, "orders").select("o_orderkey", props.kind_code(k).alias("code"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i, n: F.col("embedding")[i].cast("double").alias(n)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("seg"), at(2, "ax"), at(3, "ay"), at(4, "bx"), at(5, "by"))


@register("near_lines", f"{_PAIR} SELECT id, seg, round(dist, 9) AS dist FROM d WHERE dist <= 0.02")
def near_lines(spark: SparkSession, d: str) -> DataFrame:
    j = spatial.near_segments(_points(spark, d), _segments(spark, d), 0.02)
    return j.select("id", F.col("seg_r").alias("seg"), F.round("dist", 9).alias("dist"))


@register("nearest_line", f"{_PAIR} SELECT id, arg_min(seg, (dist, seg)) AS seg, round(min(dist), 9) AS dist FROM d WHERE dist <= 0.05 GROUP BY id")
def nearest_line(spark: SparkSession, d: str) -> DataFrame:
    j = spatial.nearest_segment(_points(spark, d), _segments(spark, d), 0.05, ["seg"]).select("id", F.col("seg_r").alias("seg"), "dist")
    return spatial.nearest(j, ["id"], ["seg"]).select("id", "seg", F.round("dist", 9).alias("dist"))


@register("ink_retention", f"{_PAIR} SELECT label, count(*) AS samples, sum(CASE WHEN near THEN 1 ELSE 0 END)::BIGINT AS hits FROM (SELECT e.label, coalesce(min(d.dist) <= 0.02, false) AS near FROM embeddings e JOIN d ON d.id = e.vec_id GROUP BY e.vec_id, e.label) GROUP BY label")
def ink_retention(spark: SparkSession, d: str) -> DataFrame:
    pts = _points(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return spatial.coverage_share(pts, _segments(spark, d), 0.02, ["label"], ["id"]).select("label", "samples", "hits")


@register(
    "segment_crossings",
    f"""WITH s AS ({_SEGS}), j AS (SELECT a.seg AS a, b.seg AS b, a.bx - a.ax AS rx, a.b_y - a.ay AS ry, b.bx - b.ax AS sx, b.b_y - b.ay AS sy, b.ax - a.ax AS qx, b.ay - a.ay AS qy FROM s a JOIN s b ON a.seg < b.seg),
k AS (SELECT a, b, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u FROM j WHERE rx * sy - ry * sx <> 0)
SELECT a, b FROM k WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""",
)
def segment_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Crossing pairs among all segments. Pairs meet in the cells of their boxes and count in the first cell they share."""
    size, slack = 0.1, 1e-9
    lo = lambda p, q: F.floor((F.least(p, q) - slack) / size).cast("bigint")
    hi = lambda p, q: F.floor((F.greatest(p, q) + slack) / size).cast("bigint")
    s = _segments(spark, d).withColumns({"i0": lo("ax", "bx"), "j0": lo("ay", "by")})
    s = s.withColumn("i", F.explode(F.sequence("i0", hi("ax", "bx")))).withColumn("j", F.explode(F.sequence("j0", hi("ay", "by"))))
    a = s.select(*[F.col(c).alias(f"{c}1") for c in s.columns])
    first = (F.col("i") == F.greatest("i0", "i01")) & (F.col("j") == F.greatest("j0", "j01"))
    x = geo.segment_intersection(*[F.col(c) for c in ("ax1", "ay1", "bx1", "by1", "ax", "ay", "bx", "by")], 0.0)
    met = a.join(s, (F.col("i1") == F.col("i")) & (F.col("j1") == F.col("j")) & (F.col("seg1") < F.col("seg")) & first)
    return met.where(x.isNotNull()).select(F.col("seg1").alias("a"), F.col("seg").alias("b"))


@register(
    "planar_distances",
    f"""WITH p AS ({_LL}), q AS (SELECT *, lead(lon) OVER (ORDER BY id) AS lon2, lead(lat) OVER (ORDER BY id) AS lat2 FROM p)
SELECT id, round(sqrt(pow((lon - lon2) * 111320 * cos(radians((lat + lat2) / 2)), 2) + pow((lat - lat2) * 111320, 2)), 3) AS mean_lat,
  round(sqrt(pow((lon - lon2) * 111320 * cos(radians(lat)), 2) + pow((lat - lat2) * 111320, 2)), 3) AS first_lat,
  round(sqrt(pow((lon - lon2) * 111.32 * cos(radians(lat)), 2) + pow((lat - lat2) * 110.54, 2)), 6) AS km FROM q WHERE lon2 IS NOT NULL""",
)
def planar_distances(spark: SparkSession, d: str) -> DataFrame:
    p = ranking.running_total(_lonlat(spark, d).withColumn("one", F.lit(1)), ["id"], "one", "at")
    nxt = p.select((F.col("at") - 1).alias("at"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    args = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    return p.join(nxt, "at").select("id", F.round(geo.distance_mean_lat(*args), 3).alias("mean_lat"), F.round(geo.distance_first_lat(*args), 3).alias("first_lat"), F.round(geo.distance_km(*args), 6).alias("km"))


@register(
    "coverage_windows",
    f"""WITH c AS (SELECT DISTINCT floor(lon / 10)::INTEGER AS cx, floor(lat / 10)::INTEGER AS cy FROM ({_LL})),
p AS (SELECT DISTINCT cx + dx AS cx, cy + dy AS cy FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
r AS (SELECT *, cx - row_number() OVER (PARTITION BY cy ORDER BY cx) AS g FROM p)
SELECT min(cx) * 10.0::DOUBLE AS west, cy * 10.0::DOUBLE AS south, (max(cx) + 1) * 10.0::DOUBLE AS east, (cy + 1) * 10.0::DOUBLE AS north FROM r GROUP BY cy, g""",
)
def coverage_windows(spark: SparkSession, d: str) -> DataFrame:
    return etl.coverage_windows(_lonlat(spark, d), 10.0)


@register(
    "box_overlap",
    """WITH b AS (SELECT c_nationkey AS k, min(c_custkey) AS w, max(c_custkey) - 40 AS e, min(c_acctbal) AS s, max(c_acctbal) AS n FROM customer GROUP BY c_nationkey)
SELECT a.k AS a, b.k AS b FROM b a JOIN b ON a.k < b.k AND a.w <= b.e AND b.w <= a.e AND a.s <= b.n AND b.s <= a.n""",
)
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    b = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("w"), (F.max("c_custkey") - 40).alias("e"), F.min("c_acctbal").alias("s"), F.max("c_acctbal").alias("n"))
    x = b.select(*[F.col(k).alias(f"{k}1") for k in b.columns])  # 25 nations
    meet = geo.boxes_meet(*[F.col(k + i) for i in ("1", "") for k in ("w", "s", "e", "n")])
    return x.join(b, (F.col("k1") < F.col("k")) & meet).select(F.col("k1").alias("a"), F.col("k").alias("b"))


@register("gaussian_series", f"""WITH t AS ({_TRACK}), k(d) AS (SELECT unnest(range(-3, 4)))
SELECT a.user_id, a.seq, round(sum(b.y * exp(-d * d / 2.0)) / sum(exp(-d * d / 2.0)), 6) AS smooth FROM t a, k JOIN t b ON b.user_id = a.user_id AND b.seq = a.seq + d GROUP BY a.user_id, a.seq""")
def gaussian_series(spark: SparkSession, d: str) -> DataFrame:
    g = lines.gaussian_series(_track(spark, d), ["user_id"], "seq", "y", 1.0)
    return g.select("user_id", "seq", F.round("smooth", 6).alias("smooth"))


@register("acts_index", "SELECT l_orderkey, CASE WHEN bool_or(r) THEN '' ELSE string_agg(l_linestatus || l_partkey || '=' || lpad((l_partkey % 50)::VARCHAR, 2, '0'), ',' ORDER BY l_partkey, l_linestatus) END AS ridx FROM (SELECT l_orderkey, l_partkey, l_linestatus, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def acts_index(spark: SparkSession, d: str) -> DataFrame:
    """Route ids with a separator in them make the index empty; a route named twice in an order is one."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linestatus").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    one = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linestatus", "r"))).alias("s"))
    ids = F.transform("s", lambda x: F.concat(x["l_linestatus"], x["l_partkey"].cast("string"), F.when(x["r"], ";").otherwise("")))
    idx = F.transform("s", lambda x: (x["l_partkey"] % 50).cast("int"))
    pairs = F.transform(F.arrays_zip(ids.alias("r"), idx.alias("k")), lambda x: F.concat(x["r"], F.lit("="), F.lpad(x["k"].cast("string"), 2, "0")))
    safe = props.acts_index(ids, idx) != ""
    return one.select("l_orderkey", F.when(safe, F.array_join(pairs, ",")).otherwise("").alias("ridx"))
