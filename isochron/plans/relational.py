"""The relational operators over the shared tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import clock, geo, masks, modes, names, props
from isochron.operators import coverage, lines, service, similarity, spatial, tables
from isochron.operators.components import connected_components
from isochron.plans.catalog import register, table


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """events with ``day`` (Monday 0), ``hour`` and ``cell``."""
    e = table(spark, d, "events")
    return e.withColumns({"day": F.weekday("ts"), "hour": F.hour("ts")}).withColumn("cell", clock.hour_of_week(F.col("day"), F.col("hour")))


_CELLS = "SELECT *, (isodow(ts) - 1)::INTEGER AS day, hour(ts)::INTEGER AS hour, ((isodow(ts) - 1) * 24 + hour(ts))::INTEGER AS cell FROM events"


@register("activity_histogram", f"SELECT event_type, day, hour, count(*) AS n FROM ({_CELLS}) GROUP BY ALL")
def activity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("event_type", "day", "hour").agg(F.count("*").alias("n"))


@register(
    "span_spill",
    """
WITH s AS (SELECT event_type, isodow(ts) - 1 AS day, hour(ts) * 3600 AS a, hour(ts) * 3600 + cast(floor(value * 60) AS BIGINT) AS b FROM events),
h AS (SELECT event_type, day, unnest(generate_series(a // 3600, CASE WHEN b > a THEN (b - 1) // 3600 ELSE a // 3600 END)) AS hour FROM s)
SELECT event_type, cast((day * 24 + hour) % 168 AS INTEGER) AS cell, count(*) AS weight FROM h GROUP BY ALL""",
)
def span_spill(spark: SparkSession, d: str) -> DataFrame:
    """Each event lasts ``value`` minutes from the start of its hour; its hours spill into the next days."""
    e = _cells(spark, d)
    first = F.col("hour") * 3600
    spans = e.select("event_type", F.col("day").alias("service_id"), first.alias("first"), (first + F.floor(F.col("value") * 60)).alias("last"))
    weights = spark.createDataFrame([(i, i, 1) for i in range(7)], "service_id int, weekday int, weight int")
    return service.activity(spans, weights)


_MASK = """SELECT event_type, list_aggregate([printf('%06x', coalesce(bit_or(CASE WHEN day = 0 THEN 1 << hour END), 0)), {rest}], 'string_agg', '') AS acts
FROM ({cells}) GROUP BY event_type"""
_MASK_REST = ", ".join(f"printf('%06x', coalesce(bit_or(CASE WHEN day = {i} THEN 1 << hour END), 0))" for i in range(1, 7))


@register("weekly_mask_hex", _MASK.format(rest=_MASK_REST, cells=_CELLS + " WHERE value > 400"))
def weekly_mask_hex(spark: SparkSession, d: str) -> DataFrame:
    act = _cells(spark, d).where("value > 400").groupBy("event_type", "cell").agg(F.count("*").alias("weight"))
    m = service.pattern_masks(act, ["event_type"])
    return m.select("event_type", masks.to_hex(F.col("mask")).alias("acts"))


@register("mask_round_trip", f"SELECT event_type, acts, true AS same FROM ({_MASK.format(rest=_MASK_REST, cells=_CELLS + ' WHERE value > 400')})")
def mask_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = weekly_mask_hex(spark, d)
    return m.select("event_type", "acts", (masks.to_hex(masks.from_hex(F.col("acts"))) == F.col("acts")).alias("same"))


@register("mask_active_at", f"SELECT event_type, max(CASE WHEN day = 2 AND hour = 9 THEN 1 ELSE 0 END) = 1 AS active FROM ({_CELLS} WHERE value > 480) GROUP BY event_type")
def mask_active_at(spark: SparkSession, d: str) -> DataFrame:
    act = _cells(spark, d).where("value > 480").groupBy("event_type", "cell").agg(F.count("*").alias("weight"))
    m = service.pattern_masks(act, ["event_type"])
    return m.select("event_type", masks.is_active(F.col("mask"), F.lit(2), F.lit(9)).alias("active"))


@register(
    "mask_and_or",
    f"""
WITH t AS (SELECT DISTINCT event_type, day, hour FROM ({_CELLS}) WHERE value > 400),
u AS (SELECT a.event_type AS a, b.event_type AS b FROM (SELECT DISTINCT event_type FROM t) a, (SELECT DISTINCT event_type FROM t) b WHERE a.event_type < b.event_type)
SELECT u.a, u.b,
  (SELECT count(*) FROM (SELECT day, hour FROM t WHERE event_type IN (u.a, u.b) GROUP BY day, hour)) AS in_either,
  (SELECT count(*) FROM (SELECT day, hour FROM t WHERE event_type IN (u.a, u.b) GROUP BY day, hour HAVING count(*) = 2)) AS in_both
FROM u""",
)
def mask_and_or(spark: SparkSession, d: str) -> DataFrame:
    act = _cells(spark, d).where("value > 400").groupBy("event_type", "cell").agg(F.count("*").alias("weight"))
    m = service.pattern_masks(act, ["event_type"])
    a, b = m.select(F.col("event_type").alias("a"), F.col("mask").alias("x")), m.select(F.col("event_type").alias("b"), F.col("mask").alias("y"))
    bits = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, x: acc + F.bit_count(x))
    return a.join(b, F.col("a") < F.col("b")).select(
        "a", "b", bits(masks.mask_or(F.col("x"), F.col("y"))).alias("in_either"), bits(masks.mask_and(F.col("x"), F.col("y"))).alias("in_both")
    )


@register(
    "mask_explains",
    f"""WITH c AS (SELECT DISTINCT user_id % 50 AS u, day * 24 + hour AS cell, day FROM ({_CELLS})), k AS (SELECT DISTINCT u FROM c),
m AS (SELECT a.u, count(*) FILTER (x.cell IS NULL) AS missing FROM c a LEFT JOIN c x ON x.u = a.u - 1 AND x.cell = a.cell GROUP BY a.u),
w AS (SELECT a.u, bool_and(a.day < 5) AS weekly FROM c a GROUP BY a.u)
SELECT k.u, k.u - 1 IN (SELECT u FROM k) AND missing = 0 AS by_neighbour, weekly AS by_weekdays FROM k JOIN m USING (u) JOIN w USING (u)""",
)
def mask_explains(spark: SparkSession, d: str) -> DataFrame:
    """Is a group's mask within its neighbour's, and within that of all hours of the weekdays; both answers occur."""
    c = _cells(spark, d).groupBy((F.col("user_id") % 50).alias("u")).agg(masks.collect_mask(F.col("day"), F.col("hour")).alias("m"))
    n = c.select((F.col("u") + 1).alias("u"), F.col("m").alias("n"))
    days = F.array(*[F.lit(0xFFFFFF if i < 5 else 0) for i in range(7)])
    j = c.join(n, "u", "left")
    return j.select("u", F.coalesce(masks.explains(F.col("n"), F.col("m")), F.lit(False)).alias("by_neighbour"), masks.explains(days, F.col("m")).alias("by_weekdays"))


@register("route_mask_union", f"SELECT 'all' AS grp, list_aggregate([{', '.join(f'''printf('%06x', coalesce(bit_or(CASE WHEN day = {i} THEN 1 << hour END), 0))''' for i in range(7))}], 'string_agg', '') AS acts FROM ({_CELLS} WHERE value > 470) GROUP BY 1")
def route_mask_union(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).where("value > 470")
    m = c.groupBy("event_type").agg(masks.collect_mask(F.col("day"), F.col("hour")).alias("mask"))
    return m.groupBy(F.lit("all").alias("grp")).agg(masks.to_hex(masks.merge_masks(F.col("mask"))).alias("acts"))


@register("dated_weights", "SELECT o_orderpriority, (isodow(o_orderdate) - 1)::INTEGER AS weekday, count(*) AS weight FROM orders GROUP BY ALL")
def dated_weights(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyyMMdd").alias("date"))
    return o.groupBy("o_orderpriority", clock.service_date_weekday(F.col("date")).alias("weekday")).agg(F.count("*").alias("weight"))


@register("trip_spans", "SELECT l_orderkey, min(least(l_linenumber * 60, l_partkey)) AS first, max(greatest(l_linenumber * 60, l_partkey)) AS last FROM lineitem GROUP BY l_orderkey")
def trip_spans(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = F.col("l_linenumber") * 60, F.col("l_partkey")
    return li.groupBy("l_orderkey").agg(F.min(F.least(a, b)).alias("first"), F.max(F.greatest(a, b)).alias("last"))


_COVER = """
WITH g AS (SELECT l_suppkey, l_partkey, cast(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank FROM g)
SELECT l_suppkey, l_partkey, n FROM w WHERE before < {cover} * total AND (rank = 1 OR n >= {floor} * total)"""


def _supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("n"))


@register("coverage_topk", _COVER.format(cover=0.5, floor=0.0))
def coverage_topk(spark: SparkSession, d: str) -> DataFrame:
    return coverage.keep_coverage(_supplier_parts(spark, d), ["l_suppkey"], "n", ["l_partkey"], 0.5)


@register("coverage_floor", _COVER.format(cover=0.9, floor=0.005))
def coverage_floor(spark: SparkSession, d: str) -> DataFrame:
    return coverage.keep_coverage(_supplier_parts(spark, d), ["l_suppkey"], "n", ["l_partkey"], 0.9, 0.005)


@register(
    "cell_selection",
    f"""
WITH g AS (SELECT cell, event_type, user_id, count(*) AS n FROM ({_CELLS}) GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cell, event_type ORDER BY n DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n) OVER (PARTITION BY cell, event_type) AS total, row_number() OVER (PARTITION BY cell, event_type ORDER BY n DESC, user_id) AS rank FROM g)
SELECT cell, event_type, user_id, n FROM w WHERE before < 0.8 * total AND (rank = 1 OR n >= 0.05 * total)""",
)
def cell_selection(spark: SparkSession, d: str) -> DataFrame:
    g = _cells(spark, d).groupBy("cell", "event_type", "user_id").agg(F.count("*").alias("n"))
    return coverage.keep_coverage(g, ["cell", "event_type"], "n", ["user_id"], 0.8, 0.05)


@register(
    "importance_percentile",
    """WITH s AS (SELECT o_custkey, count(*) AS score FROM orders GROUP BY o_custkey)
SELECT o_custkey, score, cast(round(100 * percent_rank() OVER (ORDER BY score)) AS INTEGER) AS importance FROM s""",
)
def importance_percentile(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("score"))
    return coverage.importance(s, "score")


@register(
    "majority_vote",
    """WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS votes FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority AS winner, votes FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, o_orderpriority) = 1""",
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return coverage.majority(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@register("first_last_by_seq", "SELECT l_orderkey, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS first_part, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS last_part, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def first_last_by_seq(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first_part"),
        F.max(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("last_part"),
        F.size(F.collect_set("l_partkey")).cast("bigint").alias("parts")
    )


@register(
    "ordered_sequence_patterns",
    """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, string_agg(cast(s % 5 AS VARCHAR), '>' ORDER BY l_linenumber) AS seq FROM l GROUP BY l_orderkey)
SELECT seq, count(*) AS trips FROM s GROUP BY seq""",
)
def ordered_sequence_patterns(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    seq = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("s") % 5).cast("string").alias("k")))).alias("x"))
    return seq.groupBy(F.array_join(F.transform("x", lambda r: r["k"]), ">").alias("seq")).agg(F.count("*").alias("trips"))


@register("key_set_hash", "SELECT r_name, sha1(string_agg(DISTINCT n_name || '|' || r_name, chr(10) ORDER BY n_name || '|' || r_name)) AS hash FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def key_set_hash(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    return tables.canonical_hash(j, ["r_name"], ["n_name", "r_name"])


@register(
    "symdiff_cells",
    f"""
WITH a AS (SELECT DISTINCT user_id, cell FROM ({_CELLS}) WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, cell FROM ({_CELLS}) WHERE event_type = 'click')
SELECT coalesce(a.user_id, b.user_id) AS user_id, sum(CASE WHEN a.cell IS NULL OR b.cell IS NULL THEN 1 ELSE 0 END)::BIGINT AS diff
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.cell = b.cell GROUP BY 1""",
)
def symdiff_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    a, b = (c.where(F.col("event_type") == k).select("user_id", "cell").distinct() for k in ("view", "click"))
    return service.symmetric_difference(a, b, ["user_id"], ["cell"])


@register(
    "footprint_cells",
    """
WITH p AS (SELECT vec_id, embedding[1] * 1000 AS x, embedding[2] * 1000 AS y FROM embeddings),
g AS (SELECT p.*, trunc(x / 100)::INT + dx AS cx, trunc(y / 100)::INT + dy AS cy FROM p, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
e AS (SELECT *, greatest(cx * 100 - x, x - (cx + 1) * 100, 0) AS gx, greatest(cy * 100 - y, y - (cy + 1) * 100, 0) AS gy FROM g)
SELECT vec_id, count(*) AS cells, cast(sum(cx) AS BIGINT) AS sx, cast(sum(cy) AS BIGINT) AS sy FROM e WHERE gx * gx + gy * gy <= 3600 GROUP BY vec_id""",
)
def footprint_cells(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d, 1000.0)
    return service.footprint(p).groupBy("vec_id").agg(F.count("*").alias("cells"), F.sum("cx").alias("sx"), F.sum("cy").alias("sy"))


def _points(spark: SparkSession, d: str, scale: float = 1.0) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("embedding")[0].cast("double") * scale).alias("x"), (F.col("embedding")[1].cast("double") * scale).alias("y"))


@register(
    "islands_runs",
    """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS grp FROM o WHERE value > 100)
SELECT user_id, count(DISTINCT grp) AS runs, max(n) AS longest FROM (SELECT user_id, grp, count(*) AS n FROM f GROUP BY ALL) GROUP BY user_id""",
)
def islands_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("_on", F.col("value") > 100)
    runs = lines.islands(e, ["user_id"], ["ts", "event_id"], "_on").groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def _track(spark: SparkSession, d: str) -> DataFrame:
    """A line for each user: hour of the month against value, in time order."""
    e = table(spark, d, "events")
    return e.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), (F.dayofmonth("ts") * 24.0 + F.hour("ts")).alias("x"), F.col("value").alias("y"))


_TRACK = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq, day(ts) * 24.0 + hour(ts) AS x, value AS y FROM events"


@register(
    "arc_length",
    f"""WITH s AS (SELECT user_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, round(coalesce(sum(step), 0), 4) AS length FROM s GROUP BY user_id""",
)
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    return lines.arc_length(_track(spark, d), ["user_id"]).groupBy("user_id").agg(F.round(F.max("arc"), 4).alias("length"))


@register(
    "turn_angle",
    f"""WITH s AS (SELECT user_id, seq, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, seq, round(CASE WHEN (ux = 0 AND uy = 0) OR (vx = 0 AND vy = 0) THEN 0 ELSE abs(degrees(atan2(ux * vy - uy * vx, ux * vx + uy * vy))) END, 6) AS turn FROM s WHERE ux IS NOT NULL AND vx IS NOT NULL""",
)
def turn_angle(spark: SparkSession, d: str) -> DataFrame:
    return lines.turns(_track(spark, d), ["user_id"]).where("turn IS NOT NULL").select("user_id", "seq", F.round("turn", 6).alias("turn"))


@register(
    "resample_points",
    f"""
WITH t AS ({_TRACK}), s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
tot AS (SELECT user_id, sum(step) AS total FROM s GROUP BY user_id)
SELECT user_id, cast(greatest(1, ceil(total / 500 - 1e-9)) AS BIGINT) + 1 AS points, round(total / greatest(1, ceil(total / 500 - 1e-9)), 4) AS gap FROM tot""",
)
def resample_points(spark: SparkSession, d: str) -> DataFrame:
    r = lines.resample(_track(spark, d), ["user_id"], 500.0)
    return r.groupBy("user_id").agg(F.count("*").alias("points"), F.round(F.max("arc") / (F.count("*") - 1), 4).alias("gap"))


@register(
    "median_filter",
    f"""WITH l AS (SELECT user_id, seq, list_sort(list(y) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS a FROM ({_TRACK}))
SELECT user_id, seq, a[len(a) // 2 + 1] AS median FROM l""",
)
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    return lines.median_filter(_track(spark, d), ["user_id"], "seq", "y", 2).select("user_id", "seq", "median")


@register(
    "gap_fill",
    f"""
WITH t AS (SELECT user_id, seq, CASE WHEN y > 60 THEN y END AS v FROM ({_TRACK})),
s AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS i,
  first_value(v IGNORE NULLS) OVER f AS c, first_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER f AS j FROM t
  WINDOW b AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, seq, round(CASE WHEN v IS NOT NULL THEN v WHEN i IS NULL OR j IS NULL THEN 0 ELSE a + (c - a) * (seq - i) / (j - i) END, 6) AS filled FROM s""",
)
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    t = _track(spark, d).select("user_id", "seq", F.when(F.col("y") > 60, F.col("y")).alias("v"))
    return lines.fill_gaps(t, ["user_id"], "seq", "v").select("user_id", "seq", F.round("filled", 6).alias("filled"))


@register(
    "p90_floor",
    """WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_totalprice AS p90 FROM r WHERE i = floor(0.9 * (n - 1))""",
)
def p90_floor(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return g.select("o_custkey", coverage.floor_quantile(F.col("v"), 0.9).alias("p90"))


@register(
    "median_label_length",
    """WITH r AS (SELECT p_brand, length(p_name) AS len, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name)) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, cast(len AS INTEGER) AS median FROM r WHERE i = n // 2""",
)
def median_label_length(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(F.length("p_name")).alias("v"))
    return g.select("p_brand", coverage.upper_median(F.col("v")).alias("median"))


_PTS = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


@register(
    "radius_join",
    f"""WITH p AS ({_PTS}) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS dist
FROM p a, p b WHERE a.vec_id < b.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02""",
)
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    j = spatial.radius_join(p, p, 0.02).where("vec_id < vec_id_r")
    return j.select(F.col("vec_id").alias("a"), F.col("vec_id_r").alias("b"), F.round("dist", 9).alias("dist"))


@register(
    "nearest",
    f"""WITH p AS ({_PTS}), j AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a, p b WHERE a.vec_id <> b.vec_id)
SELECT a, b, round(dist, 9) AS dist FROM j WHERE dist <= 0.05 QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b) = 1""",
)
def nearest(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    j = spatial.radius_join(p, p, 0.05).where("vec_id <> vec_id_r").select(F.col("vec_id").alias("a"), F.col("vec_id_r").alias("b"), "dist")
    return spatial.nearest(j, ["a"], ["b"]).select("a", "b", F.round("dist", 9).alias("dist"))


@register(
    "nearest_n",
    f"""WITH p AS ({_PTS}), j AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a, p b WHERE a.vec_id <> b.vec_id)
SELECT a, b FROM j WHERE dist <= 0.05 QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b) <= 3""",
)
def nearest_n(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    j = spatial.radius_join(p, p, 0.05).where("vec_id <> vec_id_r").select(F.col("vec_id").alias("a"), F.col("vec_id_r").alias("b"), "dist")
    return spatial.nearest_n(j, ["a"], ["b"], 3).select("a", "b")


_OWN = "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem"


@register("pair_overlap", f"WITH o AS ({_OWN}) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM o a JOIN o b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 2")
def pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    return spatial.pair_overlap(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", 2)


@register(
    "duplicate_pairs",
    f"""WITH o AS ({_OWN}), n AS (SELECT l_suppkey, count(*) AS own FROM o GROUP BY l_suppkey),
p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM o a JOIN o b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)
SELECT a, b, shared, CASE WHEN x.own < y.own OR (x.own = y.own AND a > b) THEN a ELSE b END AS held_out FROM p JOIN n x ON x.l_suppkey = a JOIN n y ON y.l_suppkey = b
WHERE shared > 0.3 * x.own AND shared > 0.3 * y.own""",
)
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    from isochron.operators import feeds

    o = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("feed"), F.col("l_partkey").alias("cell")).distinct()
    return feeds.duplicates(o, 0.3).select("a", "b", "shared", "held_out")


@register(
    "name_similarity",
    """WITH a AS (SELECT p_partkey AS id, p_brand, list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS t FROM part),
n AS (SELECT count(*)::DOUBLE AS n FROM a), idf AS (SELECT token, ln(1 + (SELECT n FROM n) / count(*)) AS w FROM (SELECT unnest(t) AS token FROM a) GROUP BY token),
tw AS (SELECT id, p_brand, token, w FROM (SELECT id, p_brand, unnest(t) AS token FROM a) JOIN idf USING (token)),
own AS (SELECT id, sum(w) AS total FROM tw GROUP BY id),
s AS (SELECT x.id AS a, y.id AS b, sum(x.w) AS shared FROM tw x JOIN tw y ON x.token = y.token AND x.p_brand = y.p_brand AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(least(1, shared / least(p.total, q.total)), 9) AS sim FROM s JOIN own p ON p.id = a JOIN own q ON q.id = b WHERE shared / least(p.total, q.total) > 0.4""",
)
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Names are compared once for all parts that bear them; parts are paired in blocks of ids with one name."""
    blocks = similarity.id_blocks(table(spark, d, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"], "p_partkey")
    blocks = blocks.withColumn("kind", F.array_sort(F.array_distinct(names.name_tokens(F.col("p_name")))))
    idf = similarity.idf_weights(blocks, tokens="kind", times="n")
    alike = similarity.similar_kinds(blocks, idf, "p_brand").where("sim > 0.4").withColumn("sim", F.round("sim", 9))
    return similarity.pairs_of_blocks(blocks, alike, "p_brand")


@register(
    "greedy_match",
    """WITH RECURSIVE p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
j AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND abs(a.x - b.x) <= 0.05 AND abs(a.y - b.y) <= 0.05),
c AS (SELECT a, b, row_number() OVER (ORDER BY dist, a, b) AS i FROM j WHERE dist <= 0.05),
r(i, used, a, b) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
  SELECT c.i, CASE WHEN list_contains(used, c.a) OR list_contains(used, c.b) THEN used ELSE list_concat(used, [c.a, c.b]) END,
    CASE WHEN list_contains(used, c.a) OR list_contains(used, c.b) THEN NULL ELSE c.a END, CASE WHEN list_contains(used, c.a) OR list_contains(used, c.b) THEN NULL ELSE c.b END
  FROM r JOIN c ON c.i = r.i + 1)
SELECT a, b FROM r WHERE a IS NOT NULL""",
)
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one pairs of even and odd vectors within reach, best score first; tested against a plain loop, too."""
    p = _points(spark, d)
    a, b = p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1")
    j = spatial.radius_join(a, b, 0.05).select(F.col("vec_id").alias("a"), F.col("vec_id_r").alias("b"), (-F.col("dist")).alias("score"))
    return similarity.greedy_assignment(j).select("a", "b")


@register(
    "first_wins_union",
    "SELECT doc_id, coalesce(lang, '-') AS tag FROM documents UNION ALL SELECT doc_id, 'label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
)
def first_wins_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("tag"))
    b = table(spark, d, "labels").select("doc_id", F.lit("label").alias("tag"))
    return tables.first_wins_union([a, b], "doc_id")


@register("first_filled", "SELECT o_custkey, arg_min(nullif(o_orderpriority, '1-URGENT'), o_orderkey) AS priority FROM (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') GROUP BY o_custkey UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT')")
def first_filled(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("priority", F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")))
    return tables.first_filled(o, ["o_custkey"], ["o_orderkey"], ["priority"])


@register(
    "semi_cascade",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN
(SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))))""",
)
def semi_cascade(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "region").where("r_name = 'ASIA'")
    for name, key, own in (("nation", "n_regionkey", "r_regionkey"), ("customer", "c_nationkey", "n_nationkey"), ("orders", "o_custkey", "c_custkey"), ("lineitem", "l_orderkey", "o_orderkey")):
        t = table(spark, d, name)
        keep = t.join(keep.select(own), F.col(key) == F.col(own), "left_semi")
    return keep.select("l_orderkey", "l_linenumber")


@register("anti_delta", "SELECT doc_id, sha1(text) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = 'src1' AND e.text = d.text)")
def anti_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("hash"))
    return tables.missing_rows(docs.where("source = 'src1'"), docs, "hash").select("doc_id", "hash")


@register("snapshot_diff", "SELECT coalesce(a.c_custkey, b.o_custkey) AS id, CASE WHEN a.c_custkey IS NULL THEN 'created' WHEN b.o_custkey IS NULL THEN 'deleted' WHEN a.v = b.v THEN 'same' ELSE 'modified' END AS change FROM (SELECT c_custkey, c_nationkey::BIGINT AS v FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT o_custkey, count(*) AS v FROM orders GROUP BY o_custkey) b ON a.c_custkey = b.o_custkey")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("v"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("v"))
    return tables.snapshot_diff(a, b, "id", "v")


@register(
    "window_closure",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + 3) % 100 AS b FROM lineitem),
r(node) AS (SELECT 1 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT cast(node AS BIGINT) AS node FROM r""",
)
def window_closure(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + 3) % 100).alias("dst")).distinct()
    return tables.closure(spark.createDataFrame([(1,)], "node bigint"), e)


@register("divided_edges", "SELECT least(l_suppkey, l_partkey % 100) AS lo, greatest(l_suppkey, l_partkey % 100) AS hi, count(*) AS n, bool_and(l_suppkey <= l_partkey % 100) OR bool_and(l_suppkey >= l_partkey % 100) AS one_way FROM lineitem GROUP BY 1, 2")
def divided_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"))
    return tables.unordered_pairs(li, "a", "b")


@register("json_props", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS text, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS number, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER) <> 0, false) AS truth FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return table(spark, d, "events").select("event_id", props.any_string(p, "k").alias("text"), props.any_int(p, "k").alias("number"), props.any_bool(p, "k").alias("truth"))


@register("route_list", "SELECT p_partkey, list_aggregate([trim(x) for x in string_split(replace(p_type, ' ', ','), ',') if x <> ''], 'string_agg', '|') AS routes FROM part")
def route_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(props.route_list(F.translate("p_type", " ", ",")), "|").alias("routes"))


@register("name_normalise", "SELECT p_partkey, trim(regexp_replace(translate(regexp_replace(lower(trim(p_type || ', ' || p_brand)), '[.,''’]', '', 'g'), '-–/', '   '), '\\s+', ' ', 'g')) AS name FROM part")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", names.normal_name(F.concat_ws(", ", "p_type", "p_brand")).alias("name"))


@register("name_tokens", "SELECT item_id, list_aggregate([x for x in string_split(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 's')), '[^a-z0-9]+', ' ', 'g')), ' ') if x <> ''], 'string_agg', ' ') AS tokens, length(lower(text)) - length(regexp_replace(lower(text), '[áàâäéèêëíìîïóòôöúùûüçñß]', '', 'g')) AS accents FROM benchmark")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", F.array_join(names.name_tokens(t), " ").alias("tokens"), names.accent_count(t).cast("bigint").alias("accents"))


@register("slug", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[ _–-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", names.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@register(
    "shouting",
    """WITH t AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'l' || doc_id || ':' || i, ls[i] FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT id, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) > 1 AND length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) = length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS shouting FROM t""",
)
def shouting(spark: SparkSession, d: str) -> DataFrame:
    """The test on every text and on each of its lines."""
    t = table(spark, d, "documents").select("doc_id", "text")
    rows = t.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    every = t.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").union(
        rows.select(F.concat(F.lit("l"), F.col("doc_id").cast("string"), F.lit(":"), (F.col("i") + 1).cast("string")).alias("id"), "text")
    )
    return every.select("id", names.is_shouting(F.col("text")).alias("shouting"))


@register(
    "natural_sort",
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE cast(s_suppkey * 7 AS VARCHAR) END AS label, s_nationkey FROM supplier)
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY try_cast(label AS BIGINT) IS NULL, try_cast(label AS BIGINT), label, s_suppkey)::INTEGER AS place FROM s""",
)
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("label", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise((F.col("s_suppkey") * 7).cast("string")))
    w = W.partitionBy("s_nationkey").orderBy(names.natural_key(F.col("label")), "s_suppkey")
    return s.select("s_suppkey", F.row_number().over(w).alias("place"))


_CLASS_SQL = "CASE " + " ".join(f"WHEN t = {k} THEN '{v}'" for k, v in modes.BASIC_TYPES.items()) + " " + " ".join(f"WHEN t >= {a} AND t < {b} THEN '{v}'" for a, b, v in modes.TYPE_RANGES) + " ELSE 'unknown' END"


@register("route_class", f"WITH r AS (SELECT p_partkey, p_partkey % 2000 AS t FROM part) SELECT p_partkey, {_CLASS_SQL} AS class FROM r")
def route_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", modes.route_class(F.col("p_partkey") % 2000).alias("class"))


@register("try_parse", "SELECT c_custkey, try_cast(regexp_extract(c_name, '[0-9]+$') AS INTEGER) AS n, try_cast(c_name AS INTEGER) IS NULL AS bad FROM customer")
def try_parse(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.regexp_extract("c_name", "[0-9]+$", 0).try_cast("int").alias("n"), F.col("c_name").try_cast("int").isNull().alias("bad"))


@register(
    "parse_clock",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x:00:00' ELSE printf('%d:%02d:%02d', o_orderkey % 30, o_custkey % 60, o_orderkey % 60) END AS s FROM orders)
SELECT o_orderkey, CASE WHEN try_cast(split_part(s, ':', 1) AS INTEGER) >= 0 THEN try_cast(split_part(s, ':', 1) AS INTEGER) * 3600 + try_cast(split_part(s, ':', 2) AS INTEGER) * 60 + try_cast(split_part(s, ':', 3) AS INTEGER) END AS seconds FROM t""",
)
def parse_clock(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    s = F.when(F.col("o_orderkey") % 7 == 0, "x:00:00").otherwise(F.format_string("%d:%02d:%02d", F.col("o_orderkey") % 30, F.col("o_custkey") % 60, F.col("o_orderkey") % 60))
    return o.select("o_orderkey", clock.parse_clock(s).alias("seconds"))


@register("hex_color", "SELECT p_partkey, p_size AS number FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_partkey % 5 = 0")
def hex_color(spark: SparkSession, d: str) -> DataFrame:
    h = F.when(F.col("p_partkey") % 5 == 0, "nope").otherwise(F.concat(F.lit("#"), F.lpad(F.hex("p_size"), 6, "0")))
    return table(spark, d, "part").select("p_partkey", names.color_number(h).alias("number"))


@register("feed_ids", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 'f' || s_suppkey % 4 ELSE '' END AS prefix, cast(s_suppkey % 4 AS INTEGER) AS feed, s_name AS bare FROM supplier")
def feed_ids(spark: SparkSession, d: str) -> DataFrame:
    i = F.concat(F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("f"), (F.col("s_suppkey") % 4).cast("string"), F.lit(":"))).otherwise(""), F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", names.feed_prefix(i).alias("prefix"), names.feed_index(i).alias("feed"), names.bare_id(i).alias("bare"))


@register("level_class", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 1 WHEN p_partkey % 5 = 2 THEN -1 WHEN p_size < 20 THEN -1 WHEN p_size > 20 THEN 1 ELSE 0 END AS level FROM part")
def level_class(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    layer = (F.col("p_size") - 20).cast("string")
    return table(spark, d, "part").select("p_partkey", modes.level_class(F.when(k == 1, "yes").otherwise("no"), F.when(k == 2, "yes"), layer).alias("level"))


@register(
    "tile_address",
    """WITH c AS (SELECT c_custkey, (c_custkey % 3600) / 10.0 - 180 AS lon, (c_acctbal / 200) AS lat FROM customer),
m AS (SELECT c_custkey, (lon + 180) / 360 AS x, (1 - ln(tan(radians(greatest(-85.05112878, least(85.05112878, lat)))) + 1 / cos(radians(greatest(-85.05112878, least(85.05112878, lat))))) / 3.141592653589793) / 2 AS y FROM c)
SELECT c_custkey, cast(greatest(0, least(1023, floor(x * 1024))) AS INTEGER) AS tx, cast(greatest(0, least(1023, floor(y * 1024))) AS INTEGER) AS ty FROM m""",
)
def tile_address(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    tx, ty = geo.tile_of((F.col("c_custkey") % 3600) / 10.0 - 180, F.col("c_acctbal") / 200, 10)
    return c.select("c_custkey", tx.alias("tx"), ty.alias("ty"))


@register(
    "tile_clip",
    f"""WITH s AS (SELECT user_id, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
t AS (SELECT *, x2 - x AS dx, y2 - y AS dy FROM s WHERE x2 IS NOT NULL),
c AS (SELECT user_id, seq,
  greatest(0, CASE WHEN dx = 0 THEN CASE WHEN x < 100 OR x > 300 THEN 2 ELSE 0 END ELSE least((100 - x) / dx, (300 - x) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN y < 100 OR y > 300 THEN 2 ELSE 0 END ELSE least((100 - y) / dy, (300 - y) / dy) END) AS t0,
  least(1, CASE WHEN dx = 0 THEN CASE WHEN x < 100 OR x > 300 THEN -1 ELSE 1 END ELSE greatest((100 - x) / dx, (300 - x) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN y < 100 OR y > 300 THEN -1 ELSE 1 END ELSE greatest((100 - y) / dy, (300 - y) / dy) END) AS t1 FROM t)
SELECT user_id, seq, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM c WHERE t0 <= t1""",
)
def tile_clip(spark: SparkSession, d: str) -> DataFrame:
    s = lines.segments(_track(spark, d), ["user_id"])
    t0, t1 = geo.clip_params((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), 100.0, 300.0)
    return s.withColumns({"t0": t0, "t1": t1}).where("t0 <= t1").select("user_id", "seq", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@register(
    "recenter",
    """WITH v AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_discount > 0.03 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber, (r - 1 - (n - 1) / 2.0) * 3.0 AS offset_px FROM v""",
)
def recenter(spark: SparkSession, d: str) -> DataFrame:
    from isochron.operators import dynamic

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.03).alias("visible"))
    return dynamic.recenter(li, ["l_orderkey"], "l_linenumber", "visible", F.lit(3.0)).select("l_orderkey", "l_linenumber", F.col("offset").alias("offset_px"))


@register(
    "pitch_inference",
    """WITH g AS (SELECT l_orderkey, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS gap FROM lineitem)
SELECT l_orderkey, round(min(CASE WHEN gap > 0.01 THEN gap END), 4) AS pitch FROM g GROUP BY l_orderkey""",
)
def pitch_inference(spark: SparkSession, d: str) -> DataFrame:
    from isochron.operators import dynamic

    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("offset"))
    return dynamic.infer_pitch(li, ["l_orderkey"], "offset").select("l_orderkey", F.round("pitch", 4).alias("pitch"))


@register("transfer_degree", "SELECT l_suppkey, count(DISTINCT l_partkey) AS degree FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey")
def transfer_degree(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_partkey")), "l_partkey", "left_anti")
    return out.groupBy("l_suppkey").agg(F.count("*").alias("degree"))


@register("extents", "SELECT c_nationkey, min(c_acctbal) AS west, max(c_acctbal) AS east, round((max(c_acctbal) - min(c_acctbal)) * (max(c_custkey) - min(c_custkey)), 4) AS area FROM customer GROUP BY c_nationkey")
def extents(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    e = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("west"), F.max("c_acctbal").alias("east"), F.min("c_custkey").alias("s"), F.max("c_custkey").alias("n"))
    return e.select("c_nationkey", "west", "east", F.round((F.col("east") - F.col("west")) * (F.col("n") - F.col("s")), 4).alias("area"))


@register("lane_affinity", "WITH o AS (SELECT l_orderkey, l_suppkey % 10 AS k, max(l_quantity) AS len FROM lineitem GROUP BY 1, 2) SELECT a.k AS a, b.k AS b, round(sum(a.len), 4) AS shared FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.k < b.k GROUP BY 1, 2")
def lane_affinity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 10).alias("k")).agg(F.max("l_quantity").alias("len"))
    a, b = o.select("l_orderkey", F.col("k").alias("a"), "len"), o.select("l_orderkey", F.col("k").alias("b"))
    return a.join(b, "l_orderkey").where("a < b").groupBy("a", "b").agg(F.round(F.sum("len"), 4).alias("shared"))


@register("route_sets", "SELECT l_orderkey, list_aggregate(list_sort(list_distinct(list(l_returnflag || l_linestatus))), 'string_agg', ',') AS routes, list_contains(list(l_returnflag), 'R') AND list_contains(list(l_returnflag), 'A') AS both FROM lineitem GROUP BY l_orderkey")
def route_sets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("r"), F.collect_set("l_returnflag").alias("f"))
    need = F.array(F.lit("A"), F.lit("R"))
    return li.select("l_orderkey", F.array_join(F.array_sort("r"), ",").alias("routes"), (F.size(F.array_except(need, "f")) == 0).alias("both"))


@register("viewport", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 3000 AND c_custkey BETWEEN 100 AND 900")
def viewport(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(geo.in_box(F.col("c_acctbal"), F.col("c_custkey"), [1000, 100, 3000, 900])).select("c_custkey")


@register("band_filter", "SELECT p_partkey FROM part WHERE p_size <= 15 AND 15 < p_size + 10")
def band_filter(spark: SparkSession, d: str) -> DataFrame:
    from isochron.operators import dynamic

    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("band_min"), (F.col("p_size") + 10).alias("band_max"))
    return dynamic.filter_band(p, 15).select("p_partkey")


@register(
    "components",
    """WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, n_regionkey + 1000 AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON r.node = u.a)
SELECT cast(node AS BIGINT) AS node, cast(min(c) AS BIGINT) AS component FROM r GROUP BY node""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey").distinct()
    e = s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return connected_components(e.select(F.col("s_nationkey").cast("bigint").alias("u"), (F.col("n_regionkey") + 1000).cast("bigint").alias("v")))


@register(
    "idf_tokens",
    rf"""WITH a AS (SELECT list_distinct(string_split(trim(regexp_replace(translate(lower(p_name), '{names._FROM}', '{names._TO}'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' ')) AS t FROM part),
b AS (SELECT list_distinct(string_split(trim(regexp_replace(translate(lower(text), '{names._FROM}', '{names._TO}'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' ')) AS t FROM benchmark),
da AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM a) WHERE token <> '' GROUP BY token),
db AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM b) WHERE token <> '' GROUP BY token)
SELECT token, round(least(ln(1 + (SELECT count(*) FROM a) / coalesce(da.n, 0.5)), ln(1 + (SELECT count(*) FROM b) / coalesce(db.n, 0.5))), 9) AS idf FROM da FULL JOIN db USING (token)""",
)
def idf_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token weights over part names and benchmark texts."""
    a = table(spark, d, "part").select(names.name_tokens(F.col("p_name")).alias("tokens"))
    b = table(spark, d, "benchmark").select(names.name_tokens(F.col("text")).alias("tokens"))
    return similarity.idf_weights(a, b).select("token", F.round("idf", 9).alias("idf"))


@register("trunk_key", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 2 AND p_brand <> '' THEN 'agency:' || p_brand WHEN p_partkey % 10 = 3 THEN 'route:' || p_partkey WHEN p_size > 25 THEN printf('%06x', p_size) ELSE 'agency:' || p_brand END AS trunk FROM part")
def trunk_key(spark: SparkSession, d: str) -> DataFrame:
    style = modes.Style({"regional": modes.ClassStyle("agency"), "bus": modes.ClassStyle("route")})
    color = F.when(F.col("p_size") > 25, F.lower(F.lpad(F.hex("p_size"), 6, "0"))).otherwise("")
    key = modes.trunk_key(style, F.col("p_partkey").cast("string"), F.lit(""), F.lit(""), F.col("p_brand"), color, F.col("p_partkey") % 10)
    return table(spark, d, "part").select("p_partkey", key.alias("trunk"))
