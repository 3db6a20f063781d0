"""Extract preparation, registry, styles and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from isochron.functions import modes
from isochron.operators import lines
from isochron.sources import etl, geojson, gtfs, registry
from isochron.streaming import feeds as stream


def test_elements_become_ways_and_stops(spark, tmp_path):
    data = {"elements": [
        {"type": "way", "id": 1, "tags": {"railway": "disused", "disused:railway": "tram", "name": "T"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 2, "lat": 4}]},
        {"type": "way", "id": 2, "tags": {"railway": "construction"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 1}]},
        {"type": "node", "id": 3, "lon": 5, "lat": 6, "tags": {"name": "S"}},
        {"type": "relation", "id": 4, "center": {"lon": 7, "lat": 8}, "tags": {"name": "R"}},
        {"type": "node", "id": 5, "lon": 5, "lat": 6},
    ]}
    (tmp_path / "e.json").write_text(json.dumps(data))
    e = etl.read_elements(spark, str(tmp_path / "e.json"))
    assert {r["id"]: r["tags"]["railway"] for r in etl.element_ways(e).collect()} == {"way/1": "tram", "way/2": "rail"}
    assert {r["id"]: (r["lon"], r["lat"]) for r in etl.element_stops(e).collect()} == {"way/1": (1, 2), "node/3": (5, 6), "relation/4": (7, 8)}
    assert {r["id"] for r in etl.crop(etl.element_ways(e), [1.5, 3, 3, 5]).collect()} == {"way/1"}


def test_windows_cover_and_merge(spark):
    pts = spark.createDataFrame([(0.1, 0.1), (0.6, 0.1), (5.2, 0.2)], "lon double, lat double")
    got = {tuple(r) for r in etl.coverage_windows(pts).collect()}
    assert got == {(a, s, b, s + 0.5) for a, b in ((-0.5, 1.5), (4.5, 6.0)) for s in (-0.5, 0.0, 0.5)}


def test_pseudo_track_and_corridors(spark):
    line = [{"lon": i * 0.001, "lat": 0.0} for i in range(50)]
    t = etl.pseudo_track(spark.createDataFrame([("s", line)], "shape_id string, points array<struct<lon:double,lat:double>>")).first()
    assert len(t["points"]) == 2
    a = np.array([(0.0, 0.0), (0.01, 0.0), (0.02, 0.0), (0.03, 0.01)])
    b = np.array([(0.0, 0.0001), (0.01, 0.0), (0.02, 0.0), (0.03, -0.01)])
    nodes, edges = etl.corridor_graph_of([("1", a), ("2", b)])
    assert {(tuple(r), len(c)) for _, _, r, c in edges} >= {(("1",), 2), (("2",), 2)} and any(r == ["1", "2"] for _, _, r, _ in edges)
    assert len(nodes) >= 4


REG = {"feeds": {"a": {"name": "A", "gtfs": "x/a.zip, x/o.zip", "onestop": "f-a", "bbox": [0, 0, 1, 1]}, "b": {"gtfs": "b.zip", "bbox": [1]}, "g1": {"name": "Old", "members": ["a", "b"], "derived": True}, "g2": {"members": ["q", "r"], "derived": True}}}


def test_registry(spark):
    t = {r["feed"]: r for r in registry.primary(registry.feed_table(spark, REG)).collect()}
    assert t["a"]["primary"] == "x/a.zip" and t["a"]["bbox"] == [0, 0, 1, 1] and t["b"]["bbox"] is None and t["g1"]["members"] == ["a", "b"]
    pairs = registry.upstream_pairs(registry.feed_table(spark, REG), ["x/a.zip", "b.zip"])
    assert pairs == "a=f-a" and registry.upstream_by_prefix(["x/a.zip", "b.zip"], pairs) == {"": "f-a"}
    doc = json.loads(json.dumps(REG))
    keys = registry.rewrite_groups(doc, [{"members": ["a", "b", "c"], "overlays": ["o"], "bbox": [0, 0, 2, 2]}])
    assert keys == ["g1"] and doc["feeds"]["g1"]["name"] == "Old" and doc["feeds"]["g1"]["members"] == ["a", "b", "c"] and "g2" not in doc["feeds"]
    kept = json.loads(json.dumps(REG))
    registry.rewrite_groups(kept, [], {"a"})
    assert "g2" in kept["feeds"] and "g1" not in kept["feeds"]


def test_styles_layer_and_apply(spark):
    style, options = registry.merge_styles(
        {"modes": {"bus": {"hidden": True}}, "routes": {"R1": {"color": "#ABCDEF", "route_type": 2}}, "agencies": {"RER": {"line_colors": True, "color": "111111"}}},
        {"modes": {"bus": {"band_floor": 14}}, "routes": {"R1": {"trunk": "route"}, "gone": {"hidden": True}}, "options": {"bullet_order": "feed"}},
    )
    assert style.of("bus") == modes.ClassStyle("none", True, 14, "888888", 0.5, 0.9) and options.bullet_order == "feed" and style.line_agencies == {"RER"}
    rows = [("f2:r1", "R", "", "", "", 1), ("x", "X", "", "op", "00ff00", 2), ("b", "B", "", "", "", 3), ("gone", "G", "", "", "", 1), ("y", "Y", "", "", "", 4)]
    r = spark.createDataFrame(rows, "route_id string, short_name string, long_name string, agency string, color string, route_type int")
    cols = [F.col(c) for c in ("route_id", "short_name", "long_name", "agency", "color", "route_type")]
    got = {x["route_id"]: (x["route_type"], x["t"]) for x in registry.repair_routes(r, style).select("route_id", "route_type", modes.trunk_key(style, *cols).alias("t")).collect()}
    assert got == {"f2:r1": (2, "route:f2:r1"), "x": (2, "agency:op"), "y": (4, "route:y")}


def test_drawn_segments_are_trimmed(spark):
    rows = [("s", "steady", i, float(i), 0.0) for i in range(10)] + [("t", "transition", i, float(i), 0.0) for i in range(3)] + [("u", "transition", i, 4.0 + i, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "seg string, kind string, seq int, x double, y double")
    got = {}
    for r in lines.trim_segments(df, "seg", "kind", (F.col("x") < 3) | (F.col("x") > 5)).collect():
        got.setdefault(r["seg"], []).append(r["x"])
    assert {k: sorted(v) for k, v in got.items()} == {"s#0": [0, 1, 2], "s#1": [6, 7, 8, 9], "t": [0, 1, 2]}


def test_review_areas_and_subset(spark):
    a = geojson.review_areas(spark, '[["k","Title",1.5,"2",  "feed",[0,1,2,3]],["m","N",0,0,"f"]]').collect()
    assert (a[0]["lat"], a[0]["lon"], a[0]["bbox"]) == (1.5, 2.0, [0, 1, 2, 3]) and a[1]["bbox"] is None
    feed = gtfs.open_feed(spark, {
        "agency": "agency_id,agency_name\nA,a\nB,b\n", "routes": "route_id,agency_id,route_type\n1,A,1\n2,B,1\n", "trips": "route_id,trip_id,service_id,shape_id\n1,t,w,s\n2,u,x,v\n",
        "stop_times": "trip_id,stop_id,stop_sequence\nt,c,1\nu,d,1\n", "stops": "stop_id,stop_name,parent_station\nc,C,p\np,P,\nd,D,\n", "shapes": "shape_id,shape_pt_sequence\ns,1\nv,1\n",
        "transfers": "from_stop_id,to_stop_id,transfer_type\nc,p,2\nc,d,2\n",
    })
    sub = gtfs.subset_by_agency(feed, ["A"])
    ids = {k: sorted(r[0] for r in v.collect()) for k, v in sub.items() if k in ("agency", "routes", "stops", "stop_times", "shapes", "transfers")}
    assert ids == {"agency": ["A"], "routes": ["1"], "stops": ["c", "p"], "stop_times": ["t"], "shapes": ["s"], "transfers": ["c"]}


def test_rail_shapes_are_ordered(spark):
    feed = gtfs.open_feed(spark, {"routes": "route_id,route_type\n1,1\n2,3\n", "trips": "route_id,trip_id,shape_id\n1,t,s\n2,u,v\n", "shapes": "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\ns,2,0,1\ns,1,0,0\nv,1,0,0\nv,2,1,1\ns,x,0,0\n"})
    (r,) = gtfs.rail_shapes(feed, F.col("route_type").isin(0, 1, 2)).collect()
    assert r["shape_id"] == "s" and [p["lon"] for p in r["points"]] == [0, 1]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", "1", "2024-01-01 00:00:00"), ("a", "2", "2024-01-02 00:00:00"), ("b", "9", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "feed string, sha string, seen_at string").write.json(str(src / "x"))
    versions = spark.readStream.schema("feed string, sha string, seen_at string").json(str(src / "*"))
    seen = []
    q = stream.on_changed_feeds(versions, lambda: spark.createDataFrame([("b", "9")], "feed string, sha string"), lambda df, i: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [("a", "2")]
    (tmp_path / "ev").mkdir()
    ev = spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "ev"))
    assert stream.activity_stream(ev, "k").columns == ["window", "k", "cell", "weight"]
