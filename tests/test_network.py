"""Corridor graphs, matching, splitting, lane order, drawing, sinks and tiles."""

import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.operators import corridor, dynamic, mapmatch, network, tiles
from isochron.sources import geojson, sinks


def net_of(*paths):
    return network.split_paths([(r, np.array(p, dtype=float), m) for r, p, m in paths])


TRUNK = [(0, 0), (100, 0), (200, 0)]


def test_split_is_where_routes_part():
    net = net_of(("r1", [*TRUNK, (300, 0)], (1,) * 7), ("r2", [*TRUNK, (200, 100)], (2,) * 7), ("r1", [(300, 0), *TRUNK[::-1]], (4,) * 7))
    got = {frozenset(e.routes): e.masks for e in net.edges.values()}
    assert got == {frozenset({"r1", "r2"}): {"r1": (5,) * 7, "r2": (2,) * 7}, frozenset({"r1"}): {"r1": (5,) * 7}, frozenset({"r2"}): {"r2": (2,) * 7}}


def test_contraction_keeps_length_and_rings_are_kept():
    net = net_of(("r", [(0, 0), (50, 0), (50, 50), (0, 50), (0, 0)], None))
    assert len(net.edges) == 1 and next(iter(net.edges.values())).routes == {"r"}
    chain = net_of(("r", TRUNK, None), ("r", [(200, 0), (400, 0)], None))
    network.contract_chains(chain)
    assert [corridor.arc_of(e.points)[-1] for e in chain.edges.values()] == [400.0]


def test_lenses_merge_and_far_edges_stay():
    tails = [("r", [(-500, 0), (0, 0)], None), ("r", [(1000, 0), (1500, 0)], None)]
    near = net_of(*tails, ("r", [(0, 0), (500, 20), (1000, 0)], None), ("r", [(0, 0), (500, -20), (1000, 0)], None))
    assert network.merge_lenses(near) == 1 and len(near.edges) == 3
    far = net_of(*tails, ("r", [(0, 0), (500, 400), (1000, 0)], None), ("r", [(0, 0), (500, -400), (1000, 0)], None))
    assert network.merge_lenses(far) == 0


def test_parallel_edges_bundle_and_unite_routes():
    net = net_of(("a", [(0, 0), (500, 3), (1000, 0)], None), ("b", [(0, 0), (500, -3), (1000, 0)], None))
    assert network.bundle_parallel(net) == 1
    (e,) = net.edges.values()
    assert e.routes == {"a", "b"} and abs(e.points[:, 1]).max() < 1e-9


def test_lane_order_is_the_best_of_all_orders():
    rng = random.Random(2)
    for _ in range(10):
        hub = [(0, 0), (100, 0), (200, 0)]
        ends = [(300, 50 * k) for k in range(-2, 3)]
        paths = [(f"r{k}", [*hub, e], None) for k, e in enumerate(rng.sample(ends, 3))]
        net = net_of(*paths)
        slots = network.order_lanes(net, {})
        orders = [list(itertools.permutations(slots[k])) for k in sorted(slots)]
        best = min(network.order_cost(net, dict(zip(sorted(slots), map(list, o), strict=True)), {}) for o in itertools.product(*orders))
        assert network.order_cost(net, slots, {}) == best


def test_chain_order_does_not_depend_on_edge_direction():
    a = net_of(("x", TRUNK, None), ("y", TRUNK, None))
    b = net_of(("x", TRUNK[::-1], None), ("y", TRUNK, None))
    assert network.order_lanes(a, {}) == network.order_lanes(b, {})


def test_drawing_offsets_bands_and_transitions():
    net = net_of(("r1", [*TRUNK, (400, 0)], (3,) * 7), ("r2", [*TRUNK, (200, 300)], (1,) * 7))
    slots = network.order_lanes(net, {})
    out = network.draw(net, slots, {})
    steady = [s for s in out if s["kind"] == "steady" and s["band_min"] == 15 and s["nslots"] == 2]
    assert sorted(s["offset_px"] for s in steady) == [-1.5, 1.5]
    bands = {(s["band_min"], s["band_max"]) for s in out}
    assert bands == {(15, 24), (14, 15), (13, 14), (0, 13)}
    turns = {(s["group"], tuple(map(tuple, [m or () for m in s["masks"]]))) for s in out if s["kind"] == "transition"}
    assert turns == {("r1", ((3,) * 7,)), ("r2", ((1,) * 7,))}


def test_refinement_moves_to_the_median_strand_and_keeps_ends():
    line = np.array([[0.0, 0.0], [300.0, 0.0]])
    strands = [np.array([[-50.0, y], [350.0, y]]) for y in (2.0, 10.0, 18.0)]
    out = network.refine_centerline(line, strands)
    assert np.allclose(out[[0, -1]], line) and np.allclose(out[5:-5, 1], 10.0, atol=0.2)
    assert list(network.cluster_strands(np.array([9.0, 1.0, 2.0, 10.0]), 4.5)) == [1.5, 9.5]


def test_terminal_cuts_keep_unexplained_hours():
    line = np.array([[0.0, 0.0], [1000.0, 0.0]])
    pieces = network.cut_at_terminals(line, [500, 520, 20])
    assert [corridor.arc_of(p)[-1] for p in pieces] == [500.0, 500.0]
    whole = {"r": (3,) * 7}
    full = [("r", line, (1,) * 7), ("r", line[:1].repeat(2, 0) + [[0, 0], [450, 0]], (2,) * 7)]
    assert network.piece_masks(pieces[0], full, whole) == {"r": (3,) * 7}
    assert network.piece_masks(pieces[1], full, whole) == {"r": (1,) * 7}
    assert network.piece_masks(pieces[1], full[:1], whole) == whole  # hours that no path explains stay


def test_matching_follows_track_and_falls_into_a_gap(spark):
    ways = [("w1", "subway", 0, [(0, 0), (100, 0), (200, 0)]), ("w2", "subway", 0, [(200, 0), (400, 0)]), ("w3", "rail", 0, [(0, 30), (400, 30)])]
    xy = lambda p: [{"x": float(a), "y": float(b)} for a, b in p]
    w = spark.createDataFrame([("c", k, c, z, xy(p)) for k, c, z, p in ways], "city string, id string, cls string, level int, points array<struct<x:double,y:double>>")
    pats = [("c", "m", "s", 5, "red", 1, xy([(5, 20), (390, 20)])), ("c", "far", "t", 1, "red", 1, xy([(5, 8), (190, 9), (195, 900)]))]
    p = spark.createDataFrame(pats, "city string, route_id string, shape_id string, trips int, color string, route_type int, points array<struct<x:double,y:double>>")
    got = {r["route_id"]: r for r in mapmatch.match_patterns(p, w).collect()}
    assert got["m"]["way_ids"] == ["w1", "w2"] and got["m"]["gap"] == 0 and abs(got["m"]["length"] - 400) < 1
    assert got["far"]["gap"] > 400 and got["far"]["way_ids"][0] == "w1"
    routes = spark.createDataFrame([("c", "m", "T", "ff0000"), ("c", "far", "T", "ff0000")], "city string, route_id string, trunk string, color string")
    paths = mapmatch.match_patterns(p, w).select("city", "route_id", "points", F.array(*[F.lit(1)] * 7).alias("mask"))
    segs = network.build_segments(paths, routes).collect()
    again = network.build_segments(paths.repartition(3), routes).collect()
    assert segs and sorted(map(str, segs)) == sorted(map(str, again)) and {r["color"] for r in segs} == {"ff0000"}


GRAPH = """{"type":"FeatureCollection","features":[
{"type":"Feature","properties":{"node":"a"},"geometry":{"type":"Point","coordinates":[0,0]}},
{"type":"Feature","properties":{"node":"b"},"geometry":{"type":"Point","coordinates":[1,0]}},
{"type":"Feature","properties":{"node":"b"},"geometry":{"type":"Point","coordinates":[1,0]}},
{"type":"Feature","properties":{"edge":"e1","from":"a","to":"b","routes":"1, 2","tracks":"2"},"geometry":{"type":"LineString","coordinates":[[0,0],[1,0]]}},
{"type":"Feature","id":"e2","properties":{"from":"b","to":"zz","routes":["1","x"],"gap":true},"geometry":{"type":"LineString","coordinates":[[1,0],[2,0]]}},
{"type":"Feature","properties":{"edge":"bad"},"geometry":{"type":"LineString","coordinates":[[1,0]]}}]}"""


def test_corridor_graph_is_read_and_checked(spark):
    nodes, edges = geojson.corridor_graph(geojson.features_of(spark, GRAPH))
    assert {(r["edge"], tuple(r["routes"]), r["tracks"], r["gap"]) for r in edges.collect()} == {("e1", ("1", "2"), 2, False), ("e2", ("1", "x"), 0, True)}
    routes = spark.createDataFrame([("1",), ("2",)], "route_id string")
    found = {(r["problem"], r["id"]) for r in corridor.graph_problems(nodes, edges, routes).collect()}
    assert found == {("duplicate_node", "b"), ("dangling_end", "zz"), ("unknown_route", "x")}
    kept = corridor.restrict_routes(edges, spark.createDataFrame([("2",)], "route_id string")).collect()
    assert [(r["edge"], r["routes"]) for r in kept] == [("e1", ["2"])]


def test_divided_edges_are_not_duplicates(spark):
    rows = [("1", "a", "b", "forward", False), ("2", "b", "a", "forward", False), ("3", "c", "d", "", False), ("4", "c", "d", "", False)]
    e = spark.createDataFrame(rows, "edge string, `from` string, `to` string, oneway string, gap boolean")
    assert {(r["lo"], r["divided"]) for r in corridor.parallel_edges(e).collect()} == {("a", True), ("c", False)}
    assert [r["edges"] for r in corridor.graph_components(e).collect()] == [2, 2]


def test_traversals_by_stops_then_structure_then_nothing(spark):
    rows = [("e1", "a", "b", 1.0, ["p", "s"]), ("e2", "b", "c", 1.0, ["p", "s"]), ("e3", "a", "c", 5.0, ["s", "t"]), ("e4", "x", "y", 1.0, ["t"])]
    e = spark.createDataFrame(rows, "edge string, `from` string, `to` string, length double, routes array<string>")
    calls = spark.createDataFrame([("s", ["a", "c"])], "route_id string, nodes array<string>")
    got = {r["route_id"]: (r["evidence"], r["edge_ids"]) for r in corridor.traversals(e, calls).collect()}
    assert got == {"s": ("stops", ["e1", "e2"]), "p": ("structure", ["e1", "e2"]), "t": ("none", [])}


TRACK = """{"features":[
{"id":"way/1","properties":{"railway":"subway","bridge":"yes","n":3},"geometry":{"type":"LineString","coordinates":[[0,0],[1,0]]}},
{"properties":{"aerialway":"gondola"},"geometry":{"type":"LineString","coordinates":[[0,0],[1,0]]}},
{"id":"way/3","properties":{"railway":"rail","service":"yard"},"geometry":{"type":"LineString","coordinates":[[0,0],[1,0]]}},
{"id":"way/4","properties":{"highway":"busway","railway":"rail","service":"crossover"},"geometry":{"type":"LineString","coordinates":[[0,0],[1,0]]}},
{"id":"node/5","properties":{"name":"Gare É","railway":"station"},"geometry":{"type":"Point","coordinates":[2,3]}},
{"id":"node/6","properties":{"name":" "},"geometry":{"type":"Point","coordinates":[2,3]}}]}"""


def test_map_extracts(spark):
    f = geojson.features_of(spark, TRACK)
    assert [(r["id"], r["cls"], r["level"]) for r in geojson.tracks(f).orderBy("id").collect()] == [("f1", "aerial", 0), ("way/1", "subway", 1), ("way/4", "rail", 0)]
    assert [r["id"] for r in geojson.streets(f).collect()] == ["way/4"]
    (s,) = geojson.map_stops(f).collect()
    assert s["tokens"] == ["gare", "e"] and s["classes"] == ["metro", "monorail", "regional", "tram"] and (s["lon"], s["lat"]) == (2, 3)


def segment(**more):
    base = {"kind": "steady", "color": "#ff0000", "route_color": "", "routes": ["a", "b"], "label": "A", "mode": "metro", "acts": ["0" * 42, "f" * 42], "route_type": 1, "slot": 0, "nslots": 2}
    base |= {"offset_px": 1.5, "off_from_px": 0.0, "off_to_px": -2.0, "band_min": 15, "band_max": 24, "len_m": 10.0, "points": [{"lon": -73.9876543, "lat": 40.1}, {"lon": 1.6, "lat": 2.5}]}
    return base | more


def test_binary_round_trip_and_layout():
    rows = [segment(), segment(kind="odd", color="zzz", routes=[], acts=[], label="")]
    raw = sinks.encode_segments(rows, 15)
    assert int.from_bytes(raw[:4], "little") == sinks.BINARY_MAGIC and int.from_bytes(raw[8:12], "little") == 2 and int.from_bytes(raw[12:16], "little") == 4
    a, b = sinks.decode_segments(raw)
    assert a["points"] == rows[0]["points"] and a["color"] == "ff0000" and a["routes"] == ["a", "b"] and a["acts"] == rows[0]["acts"] and a["off_to_px"] == -2.0
    assert b["color"] == "000000" and b["kind"] == "" and b["routes"] == []
    with pytest.raises(ValueError):
        sinks.decode_segments(b"XXXX" + raw[4:])


SEG = (
    "kind string, color string, route_color string, routes array<string>, label string, mode string, acts array<string>, route_type int, slot int, nslots int, "
    "offset_px double, off_from_px double, off_to_px double, band_min int, band_max int, len_m double, points array<struct<lon:double,lat:double>>"
)


def test_geojson_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([segment(), segment(slot=1, band_min=13, band_max=14)], SEG)
    path = str(tmp_path / "out.geojson")
    sinks.write_segments(df, path, ["slot"])
    back = geojson.segment_features(geojson.read_features(spark, path)).orderBy("slot").collect()
    assert [r["slot"] for r in back] == [0, 1] and back[0]["routes"] == ["a", "b"] and back[0]["ridx"] == "a=00,b=01"
    sinks.write_segments(df, str(tmp_path / "b.segb"), ["slot"], 13)
    assert len(sinks.decode_segments((tmp_path / "b.segb").read_bytes())) == 1
    sinks.write_collection([], path)
    assert (tmp_path / "out.geojson").read_text() == '{"type":"FeatureCollection","features":null}'


def test_feed_export_replaces_shapes(spark, tmp_path):
    src, dst = tmp_path / "a.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(src, "w") as z:
        z.writestr("routes.txt", "route_id\n1\n")
        z.writestr("shapes.txt", "shape_pt_sequence,shape_id,extra,shape_pt_lat,shape_pt_lon\n1,old,q,1,2\n1,keep,q,3,4\n")
    cols = ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"]
    shapes = spark.createDataFrame([("old", "1", "2", "1"), ("keep", "3", "4", "1")], ", ".join(f"{c} string" for c in cols))
    new = spark.createDataFrame([("old", [{"lon": 5.0, "lat": 6.0}])], "shape_id string, points array<struct<lon:double,lat:double>>")
    rows = [tuple(r) for r in sinks.adjusted_shapes(shapes, new).select(*cols).orderBy("shape_id").collect()]
    sinks.rewrite_zip(str(src), str(dst), "shapes", rows, cols)
    with zipfile.ZipFile(dst) as z:
        assert z.read("routes.txt") == b"route_id\n1\n"
        assert z.read("shapes.txt").decode().splitlines() == ["shape_pt_sequence,shape_id,extra,shape_pt_lat,shape_pt_lon", "1,keep,,3,4", "1,old,,6.0000000,5.0000000"]
    h = sinks.content_hashes(spark.read.format("binaryFile").load([str(src), str(dst)])).collect()
    assert len({r["sha"] for r in h}) == 2


def test_state_files(tmp_path):
    p = str(tmp_path / "state.json")
    s = sinks.load_state(p)
    s["feeds"]["x"] = {"sha1": "1"}
    sinks.save_state(s, p)
    assert sinks.load_state(p) == s
    sinks.save_state({"version": 9}, p)
    with pytest.raises(ValueError):
        sinks.load_state(p)


def read_varints(b):
    out, n, shift = [], 0, 0
    for x in b:
        n |= (x & 0x7F) << shift
        shift += 7
        if x < 0x80:
            out.append(n)
            n = shift = 0
    return out


def test_tiles_decode_to_the_clipped_lines(spark):
    f = spark.createDataFrame(
        [(1, "ribbons", 3, 4, [{"lon": -100.0, "lat": 40.0}, {"lon": 100.0, "lat": 41.0}], '{"color":"f00","n":3}'), (2, "stops", 4, 4, [{"lon": 0.5, "lat": 0.5}], '{"name":"x"}')],
        "id int, layer string, zoom_min int, zoom_max int, points array<struct<lon:double,lat:double>>, properties string",
    )
    got = {(r["z"], r["tx"], r["ty"]): r["blob"] for r in tiles.build_tiles(f, 4).collect()}
    xs = {z: {x for zz, x, _ in got if zz == z} for z in (3, 4)}
    assert xs[3] == set(range(1, 7)) and xs[4] >= set(range(3, 13))
    assert all(b[0] == 0x1A and b"ribbons" in b or b"stops" in b for b in got.values())
    assert tiles._geometry([np.array([[2, 2], [2, 10], [10, 10]])], False) == bytes([9, 4, 4, 18, 0, 16, 16, 0])
    assert read_varints(tiles._varint(300)) == [300]
    parts = tiles.clip_parts(np.array([[-5.0, 5], [5, 5], [15, 5], [5, 5]]), 0, 10)
    assert [p.tolist() for p in parts] == [[[0, 5], [5, 5], [10, 5]], [[10, 5], [5, 5]]]
    changes = {r["action"] for r in tiles.tile_changes(tiles.build_tiles(f, 4), tiles.build_tiles(f.where("id = 1"), 4)).collect()}
    assert changes <= {"keep", "write", "prune"} and "keep" in changes


def test_instant_hides_and_recenters(spark):
    cols = "id int, kind string, color string, bundle string, slot int, nslots int, offset_px double, off_from_px double, off_to_px double, active boolean, start_key string, end_key string, sx double, sy double, ex double, ey double"
    rows = [(i, "steady", c, "g", i, 3, (i - 1) * 6.0, 0.0, 0.0, i != 1, "p", "q", 1.0, 0.0, 1.0, 0.0) for i, c in enumerate(("r", "g", "b"))]
    rows += [(9, "steady", "x", "solo", 0, 1, 4.0, 0.0, 0.0, True, "m", "n", 1.0, 0.0, 1.0, 0.0)]
    rows += [(10, "transition", "r", None, 0, 3, 0.0, -6.0, 1.0, True, "q", "z", -1.0, 0.0, 0.0, 1.0)]
    got = {r["id"]: r for r in dynamic.apply_instant(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {0, 2, 9, 10}
    assert (got[0]["offset_px"], got[2]["offset_px"], got[9]["offset_px"]) == (-3.0, 3.0, 4.0)
    assert got[2]["slot"] == 1 and got[2]["nslots"] == 2
    assert (got[10]["off_from_px"], got[10]["off_to_px"]) == (3.0, 1.0)  # it runs against the steady piece


def test_route_visibility(spark):
    on, off = "000001" + "0" * 36, "0" * 42
    df = spark.createDataFrame([(1, ["a", "b", "c"], [off, "", on]), (2, [], [])], "id int, routes array<string>, acts array<string>")
    fb = F.create_map(F.lit("b"), F.lit(off))
    idx = dynamic.active_routes(F.col("routes"), F.col("acts"), fb, F.lit(0), F.lit(0))
    got = {r["id"]: (r["i"], r["v"]) for r in df.select("id", idx.alias("i"), dynamic.is_visible(F.col("routes"), idx).alias("v")).collect()}
    assert got == {1: ([2], True), 2: ([], True)}
    assert dynamic.parse_band("union") == -1
    with pytest.raises(ValueError):
        dynamic.parse_band("7")
