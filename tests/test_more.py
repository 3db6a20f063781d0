"""Chaining, snapping, cross-sections, fillets, audits and plan execution."""

import math

import numpy as np

from isochron.operators import corridor, dynamic, lines, mapmatch, network, score, service, similarity
from isochron.plans.execute import run_plan


def test_ways_chain_at_plain_joints_only():
    p = lambda *v: np.array(v, dtype=float)
    ways = [("b", p((10, 0), (5, 0))), ("a", p((0, 0), (5, 0))), ("c", p((10, 0), (20, 0))), ("d", p((20, 0), (30, 0))), ("e", p((20, 0), (20, 9)))]
    got = {tuple(sorted(ids)): corridor.arc_of(pts)[-1] for ids, pts in mapmatch.chain_ways(ways)}
    assert got == {("a", "b", "c"): 20.0, ("d",): 10.0, ("e",): 9.0}


def test_endpoints_snap_into_segments_and_breaks_heal():
    p = lambda *v: np.array(v, dtype=float)
    out = dict(mapmatch.snap_endpoints([("m", p((0, 0), (100, 0))), ("t", p((50, 1), (50, 80)))]))
    assert out["m"].tolist() == [[0, 0], [50, 1], [100, 0]] and len(out["t"]) == 2
    ends = [(p(0, 0), p(1, 0)), (p(3, 0), p(-1, 0)), (p(4, 0), p(-1, 0)), (p(2, 0), p(1, 0))]
    assert mapmatch.heal_breaks(ends) == [(0, 1), (2, 3)]


def test_points_at_arcs_equal_interpolation(spark):
    pts = [("a", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (3, 4), (3, 4), (10, 4)])]
    df = spark.createDataFrame(pts, "line string, seq int, x double, y double")
    arcs = [-1.0, 0.0, 2.5, 5.0, 8.0, 12.0, 99.0]
    got = {r["arc"]: (r["x"], r["y"]) for r in lines.points_at(df, ["line"], spark.createDataFrame([("a", a) for a in arcs], "line string, arc double")).collect()}
    s = np.array([0, 5, 5, 12.0])
    assert len(got) == len(arcs)
    for a in arcs:
        assert np.allclose(got[a], (np.interp(a, [0, 5, 12], [0, 3, 10]), np.interp(a, [0, 5, 12], [0, 4, 4]))), (a, s)


def test_cross_sections_and_audit(spark):
    built = spark.createDataFrame([("l", 0, 0.0, 0.0), ("l", 1, 200.0, 0.0)], "line string, seq int, x double, y double")
    track = spark.createDataFrame([(k, i, x, y) for k, y in (("t1", 4.0), ("t2", 5.0), ("t3", 14.0)) for i, x in enumerate((-50.0, 250.0))], "track string, seq int, x double, y double")
    r = score.centering_audit(built, track).first()
    assert r["strands"] == {2: r["samples"]} and abs(r["mean_error"] - (4.5 + 14) / 2) < 1e-9


def test_kernels():
    square = np.array([[0.0, 0.0], [100.0, 0.0], [100.0, 100.0]])
    f = network.fillet_corners(square, 20.0)
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    turn = [math.degrees(abs(math.atan2(cross(b - a, c - b), (b - a) @ (c - b)))) for a, b, c in zip(f, f[1:], f[2:], strict=False)]
    assert max(turn) < 35 and np.array_equal(f[[0, -1]], square[[0, -1]])
    line = np.array([[0.0, 0.0], [300.0, 0.0]])
    strands = [line + [0, 5], line[:1].repeat(2, 0) + [[0, 5], [100, 5]], line + [0, 50]]
    assert len(network.through_members(line, strands)) == 1 and network.edge_mates(line, strands) == [0, 1]
    assert network.cover_interval(line, strands[1]) is not None and network.cover_interval(line, strands[2]) is None
    net = network.split_paths([("r", np.array([[0.0, 0], [50, 1], [100, 0]]), None)])
    network.trim_edge_ends(net)
    assert len(net.edges) == 1


def test_metric_shapes_anchor_on_the_smallest_id(spark):
    pts = spark.createDataFrame([("b", 1, 1.0, 60.0), ("b", 2, 2.0, 60.0), ("a", 5, 0.0, 0.0), ("a", 6, 0.0001, 0.0), ("a", 7, 1.0, 0.0)], "shape_id string, seq int, lon double, lat double")
    got = {(r["shape_id"], round(r["x"])) for r in service.metric_shapes(pts).collect()}
    assert got == {("a", 0), ("a", 111320), ("b", 111320), ("b", 222640)}


def test_serve_band(spark):
    df = spark.createDataFrame([(1, 15), (2, 14), (3, None)], "id int, band_min int")
    assert {r["id"] for r in dynamic.serve_band(df, 15).collect()} == {1, 3}


def test_plan_skips_resumes_and_cascades():
    state = {"feeds": {"clean": {"fingerprint": "c"}}}
    saved, built = [], []

    def build(k):
        if k == "boom":
            raise RuntimeError("no track")
        built.append(k)

    tasks = {"clean": "c", "a": "1", "boom": "2", "G": "g", "H": "h"}
    members = {"G": ["m1", "m2"], "H": ["a"]}
    r = run_plan(tasks, members, state, build, lambda g: g != "G", lambda s: saved.append(len(s["feeds"])), 1)
    assert r.skipped == ["clean"] and set(r.failed) == {"boom", "G"} and r.dropped == ["G"]
    assert set(r.built) == {"H", "a", "m1", "m2"} and saved
    again = run_plan({"a": "1", "H": "h"}, members, state, build, lambda g: True, lambda s: None)
    assert again.skipped == ["H", "a"] and not again.built




def _greedy(rows):
    left, right, out = set(), set(), set()
    for s, a, b in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b, s))
    return out


def test_assignment_is_the_same_where_large_components_go_in_rounds(spark):
    rng = np.random.default_rng(4)
    rows = {(int(a), int(b)): float(s) for a, b, s in zip(rng.integers(0, 30, 120), rng.integers(0, 30, 120), rng.integers(0, 6, 120), strict=True)}  # ties abound
    cands = spark.createDataFrame([(a, b, s) for (a, b), s in rows.items()], "a bigint, b bigint, score double")
    want = _greedy([(s, a, b) for (a, b), s in rows.items()])
    for most in (10, 1_000_000):
        got = [tuple(r) for r in similarity.greedy_assignment(cands, most=most).select("a", "b", "score").collect()]
        assert len(got) == len(want) and set(got) == want
    assert similarity.greedy_assignment(cands.limit(0), most=10).count() == 0


def test_routes_named_with_or_without_prefix(spark):
    routes = spark.createDataFrame([("f1:x",), ("y",), ("z",), ("f2:y",)], "route_id string")
    edges = spark.createDataFrame([(["x", "y"],), (["f2:y", "x"],)], "routes array<string>")
    assert sorted(r[0] for r in corridor.route_filter(routes, edges).collect()) == ["f1:x", "f2:y", "y"]
