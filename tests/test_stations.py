"""Station grouping, ranking and matching, feed groups, planning and scoring."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from isochron.functions import geo, names
from isochron.operators import feeds, score, spatial, stations

STOP = "stop_id string, name string, lon double, lat double, parent string"


def station_tables(spark):
    m = 1 / 111_320
    stops = [
        ("P", "Central Sq.", -74.0, 40.0, ""), ("p1", "Central North", -74.0, 40.0, "P"), ("p2", "Central South", -74.0, 40.0 + 50 * m, "P"),
        ("f1:c", "central sq", -74.0, 40.0 + 100 * m, ""), ("t1", "Twin", -74.1, 40.0, ""), ("t2", "Twin", -74.1, 40.0 + 260 * m, ""), ("b", "Bus Only", -74.2, 40.0, ""),
    ]
    pats = [("1", ["p1", "t1"], "t1"), ("2", ["p2", "t2"], "t2"), ("f1:9", ["f1:c"], "f1:c"), ("B", ["b"], "b")]
    routes = [("1", "1", "", "", "ff0000", 1), ("2", "2", "", "", "ff0000", 1), ("f1:9", "9", "", "", "", 2), ("B", "B", "", "", "", 3)]
    s = spark.createDataFrame(stops, STOP)
    p = spark.createDataFrame([(r, f"s{r}", ids, end) for r, ids, end in pats], "route_id string, shape_id string, stop_ids array<string>, term string")
    r = spark.createDataFrame(routes, "route_id string, short_name string, long_name string, agency string, color string, route_type int")
    return s, p, r


def build(spark, transfers=()):
    s, p, r = station_tables(spark)
    t = spark.createDataFrame(list(transfers), "from_stop string, to_stop string")
    served = stations.stop_routes(p, r, s)
    return stations.build_stations(served, s, t, p.select(F.col("term").alias("stop_id"))), p, r


def test_grouping(spark):
    st, _, r = build(spark)
    got = {tuple(x["stop_ids"]): x for x in st.collect()}
    assert set(got) == {("P", "f1:c", "p1", "p2"), ("t1",), ("t2",)}
    c = got["P", "f1:c", "p1", "p2"]
    assert c["name"] == "Central Sq." and c["routes"] == ["1", "2", "f1:9"] and c["terminus"] and c["transfers"] == 0
    lines = {x["station"]: (x["lines"], x["line_colors"]) for x in stations.station_lines(st, r).collect()}
    assert lines[c["station"]] == (2, ["888888", "ff0000"])


def test_transfers_are_authoritative_in_their_feed(spark):
    st, _, _ = build(spark, [("t1", "t2"), ("p1", "t1")])
    got = {tuple(x["stop_ids"]): x["transfers"] for x in st.collect()}
    assert got == {("P", "f1:c", "p1", "p2"): 1, ("t1", "t2"): 1}


def test_ranking_ties_take_the_lowest(spark):
    df = spark.createDataFrame([("a", ["1"], 1, 0, 0, False), ("b", ["1"], 1, 0, 0, False), ("c", ["1", "2"], 2, 1, 0, True), ("d", ["1"], 1, 0, 2, False)], "station string, routes array<string>, lines int, transfers int, markers int, terminus boolean")
    assert {r["station"]: r["importance"] for r in stations.rank_stations(df).collect()} == {"a": 0, "b": 0, "d": 67, "c": 100}


def test_bullets_by_policy(spark):
    st = spark.createDataFrame([("s", ["10", "2", "A", "C", "B"])], "station string, routes array<string>")
    lab = spark.createDataFrame([("10", "10", "red", 3), ("2", "2", "red", 2), ("A", "A", "blue", -1), ("C", "C", "blue", 1), ("B", "B", "green", 0)], "route_id string, label string, hex string, sort_order int")
    order = {p: stations.order_bullets(st, lab, p).first()["routes"] for p in ("color", "feed", "natural")}
    assert order == {"color": ["A", "C", "B", "2", "10"], "feed": ["B", "C", "2", "10", "A"], "natural": ["2", "10", "A", "B", "C"]}


def test_map_stop_matching_and_renaming(spark):
    m = 1 / 111_320
    s = spark.createDataFrame([(1, "MAIN ST", 0.0, 0.0, ["metro"]), (2, "Oak", 0.0, 2000 * m, ["metro"]), (3, "Elm Park", 0.0, 4000 * m, ["bus"])], "id long, name string, lon double, lat double, classes array<string>")
    o = [(11, "Main St", 0.0, 20 * m, ["metro"]), (12, "Other", 0.0, 200 * m, ["metro"]), (13, "Oak", 0.0, 2100 * m, ["metro"]), (14, "Elm Park", 0.0, 4010 * m, ["metro"])]
    o = spark.createDataFrame(o, "id long, name string, lon double, lat double, classes array<string>").withColumn("tokens", names.name_tokens(F.col("name")))
    got = stations.match_map_stops(s, o, geo.Frame(0.0, 0.0)).collect()
    assert {(r["station"], r["stop"]) for r in got} == {(1, 11), (2, 13)}
    better = spark.createDataFrame([(r["station"], r["feed_name"], r["map_name"], r["lost"]) for r in got], "station long, a string, b string, lost double")
    b = {r["station"]: r["ok"] for r in better.select("station", names.better_name(F.col("a"), F.col("b"), F.col("lost")).alias("ok")).collect()}
    assert b == {1: True, 2: False}


def test_names_move_together_or_not_at_all():
    st = pd.DataFrame({"id": [1, 2, 3], "name": ["A", "A", "X"], "lon": [0.0, 0.0, 1.0], "lat": [0.0, 0.0, 0.0]})
    ms = pd.DataFrame({"station": [1], "map_name": ["B"]})
    assert list(stations.adopt_names(st, ms, pd.Series([True]))["name"]) == ["A", "A", "X"]
    both = pd.DataFrame({"station": [1, 2], "map_name": ["B", "B"]})
    assert list(stations.adopt_names(st, both, pd.Series([True, True]))["name"]) == ["B", "B", "X"]
    clash = pd.DataFrame({"station": [1, 2], "map_name": ["X", "X"]})
    assert list(stations.adopt_names(st, clash, pd.Series([True, True]))["name"]) == ["A", "A", "X"]


def test_snapping_and_clusters(spark):
    st = spark.createDataFrame([("s", 0.0, 0.0, ["a", "b", "c"])], "station string, x double, y double, routes array<string>")
    segs = spark.createDataFrame([(1, "a", -50.0, 5.0, 50.0, 5.0), (2, "a", -50.0, 9.0, 50.0, 9.0), (3, "b", -50.0, 15.0, 50.0, 15.0), (4, "c", -50.0, -90.0, 50.0, -90.0)], "seg int, route string, ax double, ay double, bx double, by double")
    snaps = stations.snap_to_ribbons(st, segs)
    assert {r["route"]: (r["x"], r["y"]) for r in snaps.collect()} == {"a": (0, 5), "b": (0, 15), "c": (0, -90)}
    assert [r["routes"] for r in stations.cluster_snaps(snaps).orderBy("marker").collect()] == [["a", "b"], ["c"]]


def test_snaps_are_found_without_all_pairs(spark, monkeypatch):
    r = random.Random(9)
    segs = spark.createDataFrame([(i, f"r{i % 3}", *(r.gauss(0, 50) for _ in range(4))) for i in range(600)], "seg int, route string, ax double, ay double, bx double, by double")
    st = spark.createDataFrame([(i, r.gauss(0, 50), r.gauss(0, 50), [f"r{i % 3}", f"r{(i + 1) % 3}"]) for i in range(300)], "station int, x double, y double, routes array<string>")
    made, near = [], spatial.near_segments
    monkeypatch.setattr(spatial, "near_segments", lambda *a: made.append(near(*a)) or made[-1])
    got = {(x["station"], x["route"]): x["dist"] for x in stations.snap_to_ribbons(st, segs).collect()}
    assert len(made) > 1 and sum(m.count() for m in made) < 600 * 200 / 4
    want = near(st.select("station", "x", "y", F.explode("routes").alias("route")), segs, 150.0, ["route"]).groupBy("station", "route").agg(F.min("dist").alias("d"))
    assert got == {(x["station"], x["route"]): x["d"] for x in want.collect()} and len(got) == 600


def feed_samples(spark):
    """Straight feeds: a and b share 1.5 km, c and d 300 m, f is nearly e, g is wide and shares with a, h is not drawn."""
    lon = lambda m: m / 111_320
    lines = {"a": (0, 3000, 0), "b": (1500, 6000, 0), "c": (20_000, 23_000, 0), "d": (22_700, 26_000, 0), "e": (40_000, 44_000, 0), "f": (40_000, 43_900, 0), "h": (0, 3000, 0.0)}
    rows = [(k, lon(x), float(y)) for k, (p, q, y) in lines.items() for x in range(p, q, 30)]
    rows += [("g", lon(x), 0.0) for x in range(0, 2000, 30)] + [("g", 20.0, 20.0)]
    return spark.createDataFrame(rows, "feed string, lon double, lat double")


def test_groups(spark):
    s = feed_samples(spark)
    drawn = spark.createDataFrame([(k,) for k in "abcdefg"], "feed string")
    got = [(r["members"], r["overlays"]) for r in feeds.derive_groups(s, drawn).collect()]
    assert got == [(["a", "b"], ["g"])]
    cells = feeds.occupied_cells(s)
    assert {(r["a"], r["b"], r["held_out"]) for r in feeds.duplicates(cells).collect()} == {("a", "h", "h"), ("e", "f", "f")}


def test_sampling_skips_jumps(spark):
    pts = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.001, 0.0), ("a", 2, 90.0, 0.0)], "feed string, seq int, lon double, lat double")
    got = sorted(r["lon"] for r in feeds.sample_shapes(pts, ["feed"]).collect())
    assert len(got) == 4 and got[0] == 0 and got[-1] == 90.0


def test_window_closure_and_affected(spark):
    rows = [("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.5, 0.5, 2.0, 2.0), ("c", 1.5, 1.5, 3.0, 3.0), ("far", 9.0, 9.0, 10.0, 10.0), ("wide", 2.5, 2.5, 50.0, 50.0), ("far2", 30.0, 30.0, 31.0, 31.0)]
    f = spark.createDataFrame(rows, "feed string, west double, south double, east double, north double")
    c = spark.createDataFrame([("a",)], "feed string")
    assert {r["node"] for r in feeds.window_closure(f, c).collect()} == {"a", "b", "c", "wide"}
    g = spark.createDataFrame([("G", ["b", "x"], ["o"], "w"), ("H", ["q"], [], "w")], "`group` string, members array<string>, overlays array<string>, window string")
    pairs = spark.createDataFrame([("a", "b"), ("m", "n")], "a string, b string")
    assert {r["feed"] for r in feeds.affected_feeds(c, pairs, g).collect()} == {"a", "b"}
    assert {r["feed"] for r in feeds.affected_feeds(spark.createDataFrame([("b",)], "feed string"), pairs, g).collect()} == {"a", "b", "x", "o"}


def test_plan_and_incremental_equal_full(spark):
    schema = "`group` string, members array<string>, overlays array<string>, window string"
    before = spark.createDataFrame([("A", ["a", "b"], [], "w"), ("B", ["c", "d"], [], "w"), ("C", ["x", "y"], [], "w")], schema)
    after = spark.createDataFrame([("A", ["b", "a"], [], "w"), ("B", ["c", "d"], ["o"], "w"), ("D", ["n", "m"], [], "w")], schema)
    none = spark.createDataFrame([], "feed string")
    got = {r["group"]: r["action"] for r in feeds.plan_groups(before, after, none).collect()}
    assert got == {"A": "keep", "B": "rebuild", "C": "delete", "D": "create"}
    hit = {r["group"]: r["action"] for r in feeds.plan_groups(before, after, spark.createDataFrame([("a",)], "feed string")).collect()}
    assert hit["A"] == "rebuild"
    assert {r["feed"]: r["change"] for r in feeds.changed_feeds(spark.createDataFrame([("a", "1"), ("b", "2")], "feed string, sha string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "feed string, sha string")).collect()} == {"a": "same", "b": "modified", "c": "created"}


def line_rows(name, pts):
    return [(name, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]


def test_forward_score(spark):
    drawn = spark.createDataFrame(line_rows("red", [(0, 0), (1000, 0)]) + line_rows("lost", [(0, 5000), (1000, 5000)]), "line string, seq int, x double, y double")
    colors = spark.createDataFrame([("red", "#FF0000"), ("lost", "0000ff")], "line string, color string")
    feats = spark.createDataFrame(line_rows("f", [(0, 4), (1000, 4)]) + line_rows("g", [(0, -4), (500, -4)]), "feat string, seq int, x double, y double")
    routes = spark.createDataFrame([("f", "ff0000", ["1"]), ("g", "ff0000", ["1"])], "feat string, color string, routes array<string>")
    got = {r["line"]: r for r in score.forward(drawn, colors, feats, routes).collect()}
    assert abs(got["red"]["mean"] - 4) < 1e-9 and got["red"]["cover_pct"] == 100 and got["red"]["color_pct"] == 100 and 45 < got["red"]["doubled_pct"] < 55 and got["red"]["fail"]
    assert got["lost"]["p90"] == 120 and got["lost"]["cover_pct"] == 0 and got["lost"]["fail"]


def test_reverse_score_and_retention(spark):
    drawn = spark.createDataFrame(line_rows("d", [(0, 0), (1000, 0)]), "line string, seq int, x double, y double")
    zig = [(10 * i, 5 * (i % 2)) for i in range(60)]
    feats = spark.createDataFrame(line_rows("z", zig) + line_rows("away", [(0, 900), (500, 900)]), "feat string, seq int, x double, y double")
    r = score.reverse(drawn, feats).first()
    assert 1 < r["wobble_mean"] < 5 and r["wobble_p90"] <= 5 and r["km"] < 1 and r["max_turn"] > 0
    assert score.failures(score.forward(drawn, spark.createDataFrame([("d", "x")], "line string, color string"), feats, spark.createDataFrame([("z", "x", ["1"])], "feat string, color string, routes array<string>")), score.reverse(drawn, feats)).first()[0] >= 0
    m = spark.createDataFrame([("f", *x) for x in line_rows("d", [(0, 10), (1000, 10)])] + [("g", *x) for x in line_rows("d", [(0, 10), (100, 10), (100, 400)])], "feed string, line string, seq int, x double, y double")
    got = {x["feed"]: x["ok"] for x in score.retention(m, drawn).collect()}
    assert got == {"f": True, "g": False}
    assert math.isclose(score.spikes(feats).first()["turn"], score.reverse(drawn, feats).first()["max_turn"])
