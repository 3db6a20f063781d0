"""Feed, service, station and group operators over a schedule made of the shared tables, each with the SQL it must equal.

Suppliers are routes and stops, orders trips and dated service, line items stop
times; what a row is (its type, whether it has frequencies) follows from its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import masks, modes, names
from isochron.operators import feeds, patterns, service, stations, tiles
from isochron.plans.catalog import register, table
from isochron.sources import gtfs


def _feed(spark: SparkSession, d: str) -> gtfs.Feed:
    s, o, li = (table(spark, d, t) for t in ("supplier", "orders", "lineitem"))
    key = F.col("s_suppkey")
    routes = s.select(
        F.concat(F.lit("R"), key).alias("route_id"),
        F.col("s_name").alias("route_short_name"),
        F.when(key % 4 == 0, "").otherwise(F.lower(F.lpad(F.hex(key * 7919 % 16777216), 6, "0"))).alias("route_color"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("A"), F.col("s_nationkey") % 5)).alias("agency_id"),
        F.when(key % 10 == 9, "x").otherwise((key % 9).cast("string")).alias("route_type"),
        F.when(key % 2 == 0, key.cast("string")).otherwise("").alias("route_sort_order"),
    )
    stops = s.select(
        F.concat(F.lit("P"), key).alias("stop_id"),
        F.col("s_name").alias("stop_name"),
        F.when(key % 7 == 0, "?").otherwise((key % 40 / 100).cast("string")).alias("stop_lon"),
        (F.col("s_acctbal") / 100000).cast("string").alias("stop_lat"),
        F.when(key % 5 == 0, F.concat(F.lit("P"), key - 1)).otherwise("").alias("parent_station"),
    )
    trip = F.concat(F.lit("T"), F.col("o_orderkey"))
    trips = o.select(
        F.concat(F.lit("R"), 1 + F.col("o_custkey") % 10).alias("route_id"),
        F.when(F.col("o_custkey") % 17 == 0, "").otherwise(F.concat(F.lit("S"), F.col("o_custkey") % 10, F.substring("o_orderpriority", 1, 1))).alias("shape_id"),
        trip.alias("trip_id"),
        F.col("o_orderstatus").alias("service_id"),
    )
    hour = 4 + F.col("l_orderkey") % 20 + F.col("l_linenumber")
    at = lambda sec: F.format_string(f"%d:%02d:{sec}", hour, F.col("l_partkey") % 60)
    times = li.select(
        F.concat(F.lit("T"), F.col("l_orderkey")).alias("trip_id"), F.concat(F.lit("P"), 1 + F.col("l_suppkey") % 8).alias("stop_id"),
        F.col("l_linenumber").alias("stop_sequence"), at("00").alias("arrival_time"), at("30").alias("departure_time"),
    )
    week = spark.createDataFrame([("O", 1, 1, 1, 1, 1, 0, 0), ("P", 0, 0, 0, 0, 0, 0, 0)], ", ".join(["service_id string", *[f"{x} int" for x in service.DAYS]]))
    dates = o.select(F.col("o_orderstatus").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("1").alias("exception_type"))
    often = o.where("o_orderkey % 5 = 0").select(trip.alias("trip_id"), F.lit("05:00:00").alias("start_time"), F.format_string("%d:00:00", 6 + F.col("o_orderkey") % 10).alias("end_time"))
    agency = table(spark, d, "region").select(F.concat(F.lit("A"), F.col("r_regionkey")).alias("agency_id"), F.col("r_name").alias("agency_name"))
    walk = s.select(F.concat(F.lit("P"), key).alias("from_stop_id"), F.concat(F.lit("P"), key + 1).alias("to_stop_id"), (key % 4).cast("string").alias("transfer_type"))
    frames = {"agency": agency, "routes": routes, "stops": stops, "trips": trips, "stop_times": times, "calendar": week, "calendar_dates": dates, "frequencies": often, "transfers": walk}
    return gtfs.open_feed(spark, frames)


_ROUTES = """routes AS (SELECT 'R' || s_suppkey AS route_id, s_name AS short_name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE printf('%06x', (s_suppkey * 7919) % 16777216) END AS color,
  CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE (s_suppkey % 9)::INTEGER END AS route_type, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'A' || (s_nationkey % 5) END AS agency,
  CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::INTEGER ELSE -1 END AS sort_order FROM supplier)"""
_TRIPS = """trips AS (SELECT 'R' || (1 + o_custkey % 10) AS route_id, CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'S' || (o_custkey % 10) || substr(o_orderpriority, 1, 1) END AS shape_id, 'T' || o_orderkey AS trip_id, o_orderstatus AS service_id, o_orderkey FROM orders)"""
_TIMES = """times AS (SELECT 'T' || l_orderkey AS trip_id, 'P' || (1 + l_suppkey % 8) AS stop_id, l_linenumber::INTEGER AS seq, (4 + l_orderkey % 20 + l_linenumber) * 3600 + (l_partkey % 60) * 60 AS tm FROM lineitem)"""
_WEIGHTS = """weights AS (SELECT 'O' AS service_id, d::INTEGER AS weekday, 1 AS weight FROM range(5) r(d) UNION ALL
  SELECT o_orderstatus, (isodow(o_orderdate) - 1)::INTEGER, count(*)::INTEGER FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 <> 0 GROUP BY 1, 2)"""
_SPANS = f"""{_ROUTES}, {_TRIPS}, {_TIMES}, {_WEIGHTS},
used AS (SELECT * FROM trips WHERE shape_id <> '' AND route_id IN (SELECT route_id FROM routes WHERE route_type <> 8) AND service_id IN (SELECT service_id FROM weights)),
plain AS (SELECT trip_id, min(tm) AS a, max(tm) + 30 AS b FROM times GROUP BY trip_id),
spans AS (SELECT u.*, CASE WHEN o_orderkey % 5 = 0 THEN 18000 ELSE a END AS first, CASE WHEN o_orderkey % 5 = 0 THEN (6 + o_orderkey % 10) * 3600 + b - a ELSE b END AS last FROM used u JOIN plain USING (trip_id))"""
_ACT = f"""{_SPANS},
hours AS (SELECT *, unnest(range(first // 3600, CASE WHEN last > first THEN (last - 1) // 3600 ELSE first // 3600 END + 1)) AS h FROM spans),
act AS (SELECT route_id, shape_id, ((weekday * 24 + h) % 168)::INTEGER AS cell, sum(weight)::BIGINT AS weight FROM hours JOIN weights USING (service_id) GROUP BY ALL)"""


@register("feed_routes", f"WITH {_ROUTES} SELECT * FROM routes")
def feed_routes(spark: SparkSession, d: str) -> DataFrame:
    """Typed routes; a type that is no number is 0, a missing order -1."""
    return gtfs.routes(_feed(spark, d)).drop("long_name", "text_color")


@register("feed_stops", "SELECT 'P' || s_suppkey AS stop_id, s_name AS name, round((s_suppkey % 40) / 100.0, 9) AS lon, round(s_acctbal / 100000, 9) AS lat, CASE WHEN s_suppkey % 5 = 0 THEN 'P' || (s_suppkey - 1) ELSE '' END AS parent FROM supplier WHERE s_suppkey % 7 <> 0")
def feed_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops; those whose longitude is no number are dropped."""
    return gtfs.stops(_feed(spark, d)).withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9)})


@register("feed_transfers", "SELECT 'P' || s_suppkey AS from_stop, 'P' || (s_suppkey + 1) AS to_stop FROM supplier WHERE s_suppkey % 4 <> 3")
def feed_transfers(spark: SparkSession, d: str) -> DataFrame:
    return gtfs.transfers(_feed(spark, d))


@register("service_weights", f"WITH {_WEIGHTS} SELECT * FROM weights")
def service_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays of the calendar where any is set, else added dates counted."""
    return service.service_weights(_feed(spark, d))


@register("service_spans", f"WITH {_SPANS} SELECT trip_id, first::INTEGER AS first, last::INTEGER AS last FROM spans")
def service_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the drawable trips with service, frequencies applied."""
    feed = _feed(spark, d)
    wanted = gtfs.routes(feed).where(modes.is_drawable(F.col("route_type"))).select("route_id")
    trips = feed.table("trips").where("shape_id <> ''").join(wanted, "route_id", "left_semi").join(service.service_weights(feed).select("service_id").distinct(), "service_id", "left_semi")
    return service.trip_spans(feed, trips)


@register("feed_activity", f"WITH {_ACT} SELECT * FROM act")
def feed_activity(spark: SparkSession, d: str) -> DataFrame:
    return service.load_activity(_feed(spark, d))


@register("feeds_activity", f"WITH {_ACT} SELECT * FROM act UNION ALL SELECT 'f1:' || route_id, shape_id, cell, weight FROM act")
def feeds_activity(spark: SparkSession, d: str) -> DataFrame:
    """A feed and an overlay; a second overlay without trips is left out."""
    feed = _feed(spark, d)
    broken = gtfs.open_feed(spark, {"routes": feed.frames["routes"]})
    return service.load_activity_of([feed, feed, broken])


_HEX = "list_aggregate([" + ", ".join(f"printf('%06x', coalesce(bit_or(CASE WHEN cell // 24 = {i} THEN 1 << (cell % 24) END), 0))" for i in range(7)) + "], 'string_agg', '')"


@register("feed_route_masks", f"WITH {_ACT} SELECT route_id, {_HEX} AS acts FROM act WHERE weight > 0 GROUP BY route_id")
def feed_route_masks(spark: SparkSession, d: str) -> DataFrame:
    return service.route_masks(service.load_activity(_feed(spark, d)))


_KEEP = "before < 0.99 * total AND (rank = 1 OR weight >= 0.05 * total)"


def _ranked(rows: str, group: str) -> str:
    w = f"PARTITION BY {group} ORDER BY weight DESC, shape_id"
    return f"SELECT *, coalesce(sum(weight) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY {group}) AS total, row_number() OVER ({w}) AS rank FROM {rows}"


@register("feed_selection", f"WITH {_ACT}, s AS (SELECT route_id, shape_id, sum(weight)::BIGINT AS weight FROM act GROUP BY ALL) SELECT route_id, shape_id, weight FROM ({_ranked('s', 'route_id')}) WHERE {_KEEP}")
def feed_selection(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that cover a route's week."""
    return service.select_patterns(service.load_activity(_feed(spark, d)))


@register("feed_morning_selection", f"WITH {_ACT}, s AS (SELECT route_id, shape_id, sum(weight)::BIGINT AS weight FROM act WHERE cell BETWEEN 6 AND 9 GROUP BY ALL) SELECT route_id, shape_id, weight FROM ({_ranked('s', 'route_id')}) WHERE {_KEEP}")
def feed_morning_selection(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that cover some hours of a scenario."""
    return service.select_patterns(service.load_activity(_feed(spark, d)), [6, 7, 8, 9])


@register("feed_cell_selection", f"WITH {_ACT} SELECT route_id, shape_id, cell, weight FROM ({_ranked('act', 'cell, route_id')}) WHERE {_KEEP}")
def feed_cell_selection(spark: SparkSession, d: str) -> DataFrame:
    return service.select_by_cell(service.load_activity(_feed(spark, d)))


_PATTERNS = f"""{_ROUTES}, {_TRIPS}, {_TIMES}, one AS (SELECT trip_id, seq, max(stop_id) AS stop_id FROM times GROUP BY ALL),
orders_of AS (SELECT trip_id, list(stop_id ORDER BY seq) AS s FROM one GROUP BY trip_id HAVING count(*) > 1),
raw AS (SELECT route_id, s, count(*) AS weight, 'seq:' || substr(sha256(array_to_string(s, chr(31))), 1, 16) AS shape_id FROM trips JOIN orders_of USING (trip_id) WHERE route_id IN (SELECT route_id FROM routes) GROUP BY route_id, s),
patterns AS (SELECT route_id, shape_id, weight AS trips, list_sort(list_distinct(s)) AS ids, s FROM ({_ranked('raw', 'route_id')}) WHERE before < 0.99 * total)"""
_SHOWN = "trips, array_to_string(ids, ',') AS stop_ids, array_to_string(s, ',') AS stop_seq, s[1] AS term_a, s[-1] AS term_b"


@register("feed_patterns", f"WITH {_PATTERNS} SELECT route_id, shape_id, {_SHOWN} FROM patterns")
def feed_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders of stops of each route (the feed has no shapes) that cover its trips, with their terminals."""
    p = patterns.load_patterns(_feed(spark, d))
    return p.withColumns({c: F.array_join(c, ",") for c in ("stop_ids", "stop_seq")}).drop("points")


@register("feeds_patterns", f"WITH {_PATTERNS} SELECT route_id, shape_id, trips, s[1] AS term_a, len(ids)::INTEGER AS stops FROM patterns UNION ALL SELECT 'f1:' || route_id, 'f1:' || shape_id, trips, 'f1:' || s[1], len(ids)::INTEGER FROM patterns")
def feeds_patterns(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d)
    return patterns.load_patterns_of([feed, feed]).select("route_id", "shape_id", "trips", "term_a", F.size("stop_ids").alias("stops"))


@register("feed_patterns_kept", f"WITH {_PATTERNS} SELECT route_id, shape_id, {_SHOWN} FROM patterns JOIN routes USING (route_id) WHERE route_type = 2 OR route_type = 4")
def feed_patterns_kept(spark: SparkSession, d: str) -> DataFrame:
    """Only some classes of route, filtered before the large tables are read."""
    p = patterns.load_patterns(_feed(spark, d), keep=modes.route_class(F.col("route_type")).isin("regional", "ferry"))
    return p.withColumns({c: F.array_join(c, ",") for c in ("stop_ids", "stop_seq")}).drop("points")


@register("stop_routes", f"""WITH {_PATTERNS},
c AS (SELECT DISTINCT route_id, unnest(ids) AS stop_id FROM patterns JOIN routes USING (route_id) WHERE route_type <> 3)
SELECT c.stop_id, s_name AS name, string_agg(route_id, ',' ORDER BY route_id) AS routes FROM c JOIN supplier ON c.stop_id = 'P' || s_suppkey WHERE s_suppkey % 7 <> 0 GROUP BY ALL""")
def stop_routes(spark: SparkSession, d: str) -> DataFrame:
    """Stops of drawn patterns other than buses, with their routes."""
    feed = _feed(spark, d)
    s = stations.stop_routes(patterns.load_patterns(feed), gtfs.routes(feed), gtfs.stops(feed))
    return s.select("stop_id", "name", F.array_join("routes", ",").alias("routes"))


@register("station_hours", f"""WITH {_ACT}, calls AS (SELECT DISTINCT route_id, shape_id, stop_id FROM trips JOIN times USING (trip_id)),
st AS (SELECT s_nationkey AS station, 'P' || s_suppkey AS stop_id FROM supplier),
x AS (SELECT DISTINCT station, route_id, cell FROM calls JOIN st USING (stop_id) JOIN act USING (route_id, shape_id) WHERE weight > 0)
SELECT station, route_id, {_HEX} AS acts FROM x GROUP BY ALL""")
def station_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours in which a route calls at a station, here the stops of a nation."""
    feed = _feed(spark, d)
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("station")).agg(F.collect_set(F.concat(F.lit("P"), "s_suppkey")).alias("stop_ids"))
    calls = feed.table("trips").join(feed.table("stop_times"), "trip_id").groupBy("route_id", "shape_id").agg(F.collect_set("stop_id").alias("stop_ids"))
    a = stations.station_activity(s, calls, service.pattern_masks(service.load_activity(feed)))
    return a.select("station", "route_id", masks.to_hex(F.col("mask")).alias("acts"))


_GROUPS = """g AS (SELECT c_nationkey AS grp, list_sort(list('c' || c_custkey) FILTER (c_custkey % 2 = 0)) AS members, list_sort(list('c' || c_custkey) FILTER (c_custkey % 2 = 1)) AS overlays, c_nationkey % 3 AS west FROM customer GROUP BY c_nationkey)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("c"), F.col("c_custkey"))
    some = lambda k: F.array_sort(F.collect_list(F.when(F.col("c_custkey") % 2 == k, name)))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("group")).agg(some(0).alias("members"), some(1).alias("overlays"))
    return c.withColumn("window", F.struct((F.col("group") % 3).alias("west")))


@register("affected_feeds", f"""WITH {_GROUPS}, ch AS (SELECT 'c' || c_custkey AS feed, c_nationkey FROM customer WHERE c_acctbal < -600),
p AS (SELECT DISTINCT 'c' || o_custkey AS a, 'c' || (o_custkey + 1) AS b FROM orders),
hit AS (SELECT DISTINCT grp FROM (SELECT grp, unnest(list_concat(coalesce(members, []), coalesce(overlays, []))) AS feed FROM g) WHERE feed IN (SELECT feed FROM ch))
SELECT feed FROM ch UNION SELECT b FROM p WHERE a IN (SELECT feed FROM ch) UNION SELECT a FROM p WHERE b IN (SELECT feed FROM ch)
UNION SELECT unnest(list_concat(coalesce(members, []), coalesce(overlays, []))) FROM g WHERE grp IN (SELECT grp FROM hit)""")
def affected_feeds(spark: SparkSession, d: str) -> DataFrame:
    """What a change of some feeds touches: themselves, partners, and everyone in a group with one."""
    changed = table(spark, d, "customer").where("c_acctbal < -600").select(F.concat(F.lit("c"), "c_custkey").alias("feed"))
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("b")).distinct()
    return feeds.affected_feeds(changed, o, _groups(spark, d))


@register("group_plan", f"""WITH {_GROUPS}, ch AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal < -900)
SELECT grp AS "group", CASE WHEN grp >= 20 THEN 'create' WHEN grp < 3 THEN 'delete' WHEN grp % 4 = 0 OR grp IN (SELECT c_nationkey FROM ch) THEN 'rebuild' ELSE 'keep' END AS action FROM g""")
def group_plan(spark: SparkSession, d: str) -> DataFrame:
    """Groups that come, go, change their window, or hold a changed feed."""
    g = _groups(spark, d)
    before = g.where("group < 20")
    after = g.where("group >= 3").withColumn("window", F.when(F.col("group") % 4 == 0, F.struct(F.lit(99).alias("west"))).otherwise(F.col("window")))
    changed = table(spark, d, "customer").where("c_acctbal < -900").select(F.concat(F.lit("c"), "c_custkey").alias("feed"))
    return feeds.plan_groups(before, after, changed)


@register("changed_feeds", "SELECT p_partkey AS feed, CASE WHEN p_size > 40 THEN 'created' WHEN p_size < 5 THEN 'deleted' WHEN p_size % 3 = 0 THEN 'modified' ELSE 'same' END AS change FROM part")
def changed_feeds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("feed"), "p_size", F.sha2("p_name", 256).alias("sha"))
    now = p.where("p_size >= 5").select("feed", F.when(F.col("p_size") % 3 == 0, "new").otherwise(F.col("sha")).alias("sha"))
    return feeds.changed_feeds(p.where("p_size <= 40").select("feed", "sha"), now).select("feed", "change")


@register("ceded_windows", f"WITH {_GROUPS} SELECT grp AS \"group\", west FROM g WHERE grp <> 7 AND list_contains(overlays, 'c1')")
def ceded_windows(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d)
    return feeds.ceded_windows(g, 7, "c1").select("group", "window.west")


@register("window_sets", f"WITH {_GROUPS} SELECT overlay, '{{\"west\":' || west || '}}' AS windows FROM (SELECT unnest(overlays) AS overlay, west FROM g)")
def window_sets(spark: SparkSession, d: str) -> DataFrame:
    """The windows of the groups an overlay rides in; here each is in one."""
    return feeds.window_sets(_groups(spark, d))


@register("shape_samples", """WITH p AS (SELECT user_id, value / 10000 AS lon, hour(ts) / 1000 AS lat, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
s AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
n AS (SELECT user_id, CASE WHEN lon2 IS NULL THEN 1 ELSE greatest(1, trunc(sqrt(pow((lon2 - lon) * 111320 * cos(radians(lat)), 2) + pow((lat2 - lat) * 110540, 2)) / 30)) END AS n FROM s)
SELECT user_id, sum(n)::BIGINT AS samples FROM n WHERE n <= 4000 GROUP BY user_id""")
def shape_samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return feeds.sample_shapes(e.select("user_id", seq.alias("seq"), (F.col("value") / 10000).alias("lon"), (F.hour("ts") / 1000).alias("lat")), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("samples"))


@register("route_policy", "WITH t AS (SELECT p_partkey, p_partkey % 9 AS t FROM part) SELECT p_partkey, t = 5 AS hidden, CASE t WHEN 4 THEN 13 WHEN 3 THEN 15 ELSE 0 END AS floor, t <> 3 AS trunked, CASE WHEN t = 3 THEN 'street' WHEN t = 4 THEN 'seaway' ELSE 'rail' END AS layer FROM t")
def route_policy(spark: SparkSession, d: str) -> DataFrame:
    """Whether a class is hidden, from which band it is drawn, whether it is trunked, and what it runs on."""
    style = modes.Style(modes.DEFAULT_CLASSES | {"cable": modes.ClassStyle("route", hidden=True)})
    t = (F.col("p_partkey") % 9).cast("int")
    cls = modes.route_class(t)
    return table(spark, d, "part").select("p_partkey", modes.is_hidden(cls, style).alias("hidden"), modes.band_floor(cls, style).alias("floor"), modes.is_trunked(cls, style).alias("trunked"), modes.pattern_layer(t).alias("layer"))


@register("color_rules", """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'ff0000' WHEN p_size = 7 THEN '00ff00' WHEN p_type = 'X' THEN '' ELSE NULL END AS override, trim(p_brand) AS text, p_size % 3 <> 2 AS same FROM part""")
def color_rules(spark: SparkSession, d: str) -> DataFrame:
    """Curated colours by route or agency, text colours without a mark, and colours equal but for case and mark."""
    style = modes.Style(route_color={"brand#1": "ff0000"}, agency_color={"a7": "00ff00"})
    agency = F.concat(F.lit("A"), F.col("p_size").cast("string"))
    over = modes.color_override(style, F.concat(F.lit("f2:"), "p_brand"), F.lit(""), F.lit(""), agency)
    other = F.when(F.col("p_size") % 3 == 0, "#ABCDEF").when(F.col("p_size") % 3 == 1, "abcdef").otherwise("abcdee")
    return table(spark, d, "part").select("p_partkey", over.alias("override"), names.text_color(F.concat(F.lit(" #"), "p_brand", F.lit(" "))).alias("text"), names.same_color(F.lit("AbCdEf"), other).alias("same"))


@register("same_words", "SELECT p_partkey, p_size % 2 = 0 AS same FROM part")
def same_words(spark: SparkSession, d: str) -> DataFrame:
    """Names equal but for case, accents and punctuation, and others."""
    other = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Ünter-"), F.upper("p_name"), F.lit("!"))).otherwise(F.concat("p_name", F.lit(" x")))
    return table(spark, d, "part").select("p_partkey", names.same_folded(F.concat(F.lit("unter "), "p_name"), other).alias("same"))


@register("stop_classes", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'tram' WHEN 1 THEN 'metro,tram' WHEN 2 THEN 'ferry,regional' WHEN 3 THEN 'metro,monorail,regional,tram' WHEN 4 THEN 'aerial,cable' ELSE 'bus' END AS classes FROM part")
def stop_classes(spark: SparkSession, d: str) -> DataFrame:
    tags = (("railway", "tram_stop"), ("station", "light_rail"), ("railway", "Halt"), ("railway", "station"), ("aerialway", "station"), ("highway", "stop"))
    t = F.when(F.lit(False), F.create_map(F.lit("a"), F.lit("b")))
    for i, (k, v) in enumerate(tags):
        more = [F.lit("amenity"), F.lit("ferry_terminal")] if i == 2 else []
        t = t.when(F.col("p_size") % 6 == i, F.create_map(F.lit(k), F.lit(v), *more))
    return table(spark, d, "part").select("p_partkey", F.array_join(modes.stop_classes(t), ",").alias("classes"))


@register("zoom_ranges", "SELECT p_partkey, least(p_size % 20, 14)::INTEGER AS first, CASE WHEN p_size >= 24 THEN 14 ELSE least(p_size - 1, 14) END::INTEGER AS last FROM part")
def zoom_ranges(spark: SparkSession, d: str) -> DataFrame:
    a, b = tiles.zoom_range((F.col("p_size") % 20).cast("int"), F.col("p_size").cast("int"), 14)
    return table(spark, d, "part").select("p_partkey", a.cast("int").alias("first"), b.cast("int").alias("last"))


@register("mask_edits", "SELECT p_partkey, list_aggregate([CASE WHEN i = p_size % 7 THEN printf('%06x', 1 << (p_partkey % 24)::INTEGER) ELSE '000000' END for i in range(7)], 'string_agg', '') AS mask, p_size % 2 = 0 AS empty FROM part")
def mask_edits(spark: SparkSession, d: str) -> DataFrame:
    """An hour set in an empty mask, and which masks are empty."""
    none = F.array_repeat(F.lit(0), 7)
    one = masks.set_hour(none, (F.col("p_size") % 7).cast("int"), (F.col("p_partkey") % 24).cast("int"))
    return table(spark, d, "part").select("p_partkey", masks.to_hex(one).alias("mask"), masks.is_empty(F.when(F.col("p_size") % 2 == 0, none).otherwise(one)).alias("empty"))
