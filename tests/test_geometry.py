"""Lines, spatial joins, components and assignment against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from isochron.functions import geo
from isochron.operators import components, corridor, lines, patterns, similarity, spatial, tables
from isochron.plans import catalog, relational  # noqa: F401


def points(n, seed, span=100.0):
    r = random.Random(seed)
    return [(i, r.uniform(-span, span), r.uniform(-span, span)) for i in range(n)]


def test_radius_join_equals_all_pairs(spark):
    a, b = points(120, 1), points(90, 2)
    da, db = (spark.createDataFrame(x, "id int, x double, y double") for x in (a, b))
    got = {(r["id"], r["id_r"]) for r in spatial.radius_join(da, db, 17.0).collect()}
    want = {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 17.0}
    assert got == want
    anti = {r["id"] for r in spatial.radius_join(da, db, 17.0, how="left_anti").collect()}
    assert anti == {i for i, _, _ in a} - {i for i, _ in want}


def test_near_segments_equals_brute_force(spark):
    pts, ends = points(60, 3), points(60, 4)
    segs = [(i, *ends[i][1:], *ends[i + 1][1:]) for i in range(0, 58, 2)]
    dp, ds = spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(segs, "seg int, ax double, ay double, bx double, by double")

    def dist(x, y, ax, ay, bx, by):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    got = {(r["id"], r["seg_r"]): r["dist"] for r in spatial.near_segments(dp, ds, 12.0).collect()}
    want = {(i, s): dist(x, y, *e) for i, x, y in pts for s, *e in segs if dist(x, y, *e) <= 12.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def crowded(spark, n=400):
    """Points and segments that lie close together, with copies of both, ends that are shared, and rows without a place."""
    r = random.Random(7)
    pts = [(i, r.gauss(0, 2), r.gauss(0, 2)) for i in range(n)] + [(n, 60.0, 0.0), (n + 1, 7.0, 7.0), (n + 2, 7.0, 7.0), (n + 3, None, 0.0), (n + 4, math.nan, 0.0), (n + 5, 500.0, 0.0)]
    segs = [(i, *(r.gauss(0, 2) for _ in range(4))) for i in range(n)]
    segs += [(n + i, *segs[5][1:]) for i in range(3)] + [(-1, *segs[6][1:]), (n + 5, 9.0, 7.0, 9.0, 9.0), (n + 4, 9.0, 7.0, 11.0, 7.0), (n + 6, 55.0, 3.0, 55.0, 3.0), (n + 7, None, 0.0, 0.0, 0.0)]
    return pts, segs, spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(segs, "seg long, ax double, ay double, bx double, by double")


def test_nearest_segment_equals_all_pairs_with_few_of_them(spark, monkeypatch):
    pts, segs, dp, ds = crowded(spark)
    made = []
    near = spatial.near_segments
    monkeypatch.setattr(spatial, "near_segments", lambda *a: made.append(near(*a)) or made[-1])
    got = {r["id"]: (r["seg_r"], r["dist"], r["t"]) for r in spatial.nearest_segment(dp, ds, 12.0, ["seg"]).collect()}
    assert len(made) > 1 and sum(m.count() for m in made) < len(pts) * len(segs) / 4
    monkeypatch.undo()
    want = {r["id"]: (r["seg_r"], r["dist"], r["t"]) for r in spatial.nearest(spatial.near_segments(dp, ds, 12.0), ["id"], ["seg_r"]).collect()}
    assert got == want and len(got) == len(pts) - 3 and got[401][0] == 404
    brute = {}
    for i, x, y in pts:
        for s, ax, ay, bx, by in segs:
            if None not in (x, ax) and x == x:
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
                brute[i] = min(brute.get(i, (13, 0)), (math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), s))
    brute = {i: d for i, (d, _) in brute.items() if d <= 12}
    assert got.keys() == brute.keys() and all(abs(got[i][1] - brute[i]) < 1e-9 for i in got)


def test_station_patterns_equal_all_pairs_with_few_of_them(spark, monkeypatch):
    pts, segs, dp, ds = crowded(spark)
    made = []
    near = spatial.near_segments
    monkeypatch.setattr(spatial, "near_segments", lambda *a: made.append(near(*a)) or made[-1])
    edges = ds.selectExpr("concat('r', abs(seg) % 3) AS route_id", "seg AS edge", "seg / 7.0D AS at", "ax", "ay", "bx", "by")
    got = {r["route_id"]: r["stop_ids"] for r in corridor.station_patterns(edges, dp.withColumnRenamed("id", "stop_id"), 12.0).collect()}
    assert len(made) > 1 and sum(m.count() for m in made) < len(pts) * len(segs) / 2
    best = {}
    for i, x, y in pts:
        for s, ax, ay, bx, by in segs:
            if None not in (x, ax) and x == x:
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0.0
                d = math.hypot(x - (ax + t * (bx - ax)), y - (ay + t * (by - ay)))
                if d <= 12:
                    best[f"r{abs(s) % 3}", i] = min(best.get((f"r{abs(s) % 3}", i), (13, 0)), (d, s / 7 + t * math.hypot(bx - ax, by - ay)))
    assert got == {r: [i for _, i in sorted((arc, i) for (k, i), (_, arc) in best.items() if k == r)] for r in {k for k, _ in best}}


def test_equal_names_are_weighed_once(spark, tmp_path, monkeypatch):
    rows = [(i, ["red ring", "ring  Red", "red bolt", "", "old rod"][i % 5], f"B{i % 2}") for i in range(100)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    weighed, weigh = [], similarity.weigh_pairs
    monkeypatch.setattr(similarity, "weigh_pairs", lambda pairs, *a: weighed.append(pairs.count()) or weigh(pairs, *a))
    got = {(r["a"], r["b"]) for r in catalog.queries()["name_similarity"](spark, str(tmp_path)).collect()}
    words = {i: set(n.lower().split()) for i, n, _ in rows}
    df = {t: sum(t in w for w in words.values()) for t in ("red", "ring", "bolt", "old", "rod")}
    weight = lambda ts: sum(math.log(1 + 100 / df[t]) for t in ts)
    want = {(a, b) for a, p in words.items() for b, q in words.items() if a < b and a % 2 == b % 2 and p and q and weight(p & q) / min(weight(p), weight(q)) > 0.4}
    assert got == want and weighed == [5]


def made_by_joins(df):
    """Rows that the joins of a finished query have made."""
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        rows += node.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_parts_of_similar_names_are_paired_in_blocks(spark, tmp_path):
    rows = [(i, ["red ring", "Ring, RED", "red bolt", None, "old rod"][i % 5], [None, "B1", "B2"][i % 3]) for i in range(1500)] + [(None, "old rod", "B1")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.queries()["name_similarity"](spark, str(tmp_path))
    got = [(r["a"], r["b"], r["sim"]) for r in df.collect()]
    kinds = {i: frozenset((n or "").lower().replace(",", "").split()) for i, n, _ in rows if i is not None}
    df_ = {"red": 900, "ring": 600, "bolt": 300, "old": 301, "rod": 301}
    weight = lambda ts: sum(math.log(1 + 1501 / df_[t]) for t in ts)
    sims = {(p, q): round(min(1, weight(p & q) / min(weight(p), weight(q))), 9) for p in set(kinds.values()) for q in set(kinds.values()) if p & q}
    want = {(a, b): sims[kinds[a], kinds[b]] for m in (1, 2) for a in range(m, 1500, 3) for b in range(a + 3, 1500, 3) if sims.get((kinds[a], kinds[b]), 0) > 0.4}
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    assert 0 < made_by_joins(df) < len(want) / 20


def test_blocks_of_ids_split_a_large_key(spark):
    rows = [("k" if i % 10 else "m", i * 7 % 1000 or None) for i in range(1000)] + [("k", 5), (None, 1001), ("z", None)]
    blocks = similarity.id_blocks(spark.createDataFrame(rows, "kind string, id long"), ["kind"], "id", 7).withColumn("g", F.lit(1))
    held = blocks.collect()
    assert max(len(r["ids"]) for r in held) == 7 and len({r["block"] for r in held}) == len(held) < 200 and all(r["ids"] == sorted(r["ids"]) for r in held)
    for k in ("k", "m", "z", None):
        own = [i for x, i in rows if x == k]
        assert sorted(i for r in held if r["kind"] == k for i in r["ids"]) == sorted(i for i in own if i is not None) and sum(r["n"] for r in held if r["kind"] == k) == len(own)
    alike = spark.createDataFrame([("k", "k", 1.0), ("k", "m", 0.5), ("m", "k", 0.5)], "ka string, kb string, sim double")
    got = sorted((r["a"], r["b"], r["sim"]) for r in similarity.pairs_of_blocks(blocks, alike, "g").collect())
    ids = sorted((i, k) for k, i in rows if k in ("k", "m") and i is not None)
    assert got == sorted((i, j, 1.0 if k == m else 0.5) for n, (i, k) in enumerate(ids) for j, m in ids[n + 1 :] if i < j and "k" in (k, m))


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(999, i) for i in range(1000, 1080)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_resample_and_densify(spark):
    zig = [("a", i, float(10 * i), float(i % 2) * 5) for i in range(9)] + [("b", 0, 0.0, 0.0), ("b", 1, 0.0, 3.0)]
    df = spark.createDataFrame(zig, "line string, seq int, x double, y double")
    for key, n in (("a", 8), ("b", 2)):
        p = np.array([[x, y] for k, _, x, y in zig if k == key])
        arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        got = lines.resample(df.where(F.col("line") == key), ["line"], 4.0 if key == "a" else 2.0).orderBy("i").collect()
        m = max(1, math.ceil(arc[-1] / (4.0 if key == "a" else 2.0) - 1e-9))
        at = np.linspace(0, arc[-1], m + 1)
        want = np.stack([np.interp(at, arc, p[:, k]) for k in (0, 1)], axis=1)
        assert np.allclose([[r["x"], r["y"]] for r in got], want)
    d = lines.densify(df, ["line"], 3.0).where("line = 'b'").orderBy("seq", "k").collect()
    assert [(r["x"], r["y"]) for r in d] == [(0.0, 0.0), (0.0, 3.0)]


def test_clip_keeps_long_runs_and_names_pieces(spark):
    pts = [("s", i, -74.0 + i * 0.01, 40.0) for i in range(10)] + [("whole", i, -73.95 + i * 0.001, 40.0) for i in range(3)]
    df = spark.createDataFrame(pts, "line string, seq int, lon double, lat double")
    inside = (F.col("lon") < -73.975) | (F.col("lon") > -73.955)
    got = {(r["line"], r["seq"]) for r in lines.clip_lines(df, "line", inside).collect()}
    assert got == {("s#clip0", i) for i in range(3)} | {("s#clip1", i) for i in range(5, 10)} | {("whole", i) for i in range(3)}
    out = lines.exclude_lines(df, "line", [[-73.975, 39, -73.955, 41]])
    assert {r["line"] for r in out.where("line like 's%'").select("line").distinct().collect()} == {"s#exc0", "s#exc1"}


def test_scalar_geometry(spark):
    lit = F.lit
    r = spark.range(1).select(
        geo.turn_degrees(*map(lit, (0.0, 0.0, 1.0, 0.0, 1.0, 1.0))).alias("turn"),
        geo.segment_distance(*map(lit, (0.0, 5.0, -1.0, 0.0, 1.0, 0.0))).alias("d"),
        geo.segment_intersection(*map(lit, (0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0))).alias("x"),
        geo.segment_intersection(*map(lit, (0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0))).alias("none"),
        geo.median_strand(F.array(lit(4.0), lit(1.0), lit(9.0), lit(2.0))).alias("m"),
        geo.cell_trunc(lit(-1.7), 1.0).alias("t"), geo.cell_floor(lit(-1.7), 1.0).alias("f"),
    ).first()
    assert abs(r["turn"] - 90) < 1e-9 and r["d"] == 5 and (r["x"]["x"], r["x"]["y"]) == (1, 1) and r["none"] is None and r["m"] == 3 and (r["t"], r["f"]) == (-1, -2)


def test_frame_round_trip(spark):
    f = geo.frame_of(-75, 39, -73, 41)
    r = spark.range(1).select(f.lon(f.x(F.lit(-74.123))).alias("a"), f.lat(f.y(F.lit(40.321))).alias("b")).first()
    assert abs(r["a"] + 74.123) < 1e-12 and abs(r["b"] - 40.321) < 1e-12


def test_loops_without_stops_go_and_loops_with_stops_stay():
    ring = [(-74.0 + 0.004 * math.sin(t) , 40.0 + 0.004 * (1 - math.cos(t))) for t in np.linspace(0, 2 * math.pi, 25)]
    pts = np.array([(-74.02, 40.0), (-74.01, 40.0), *ring, (-73.99, 40.0), (-73.98, 40.0)])
    assert len(patterns.excise_loops(pts, np.zeros((0, 2)))) < len(pts)
    assert len(patterns.excise_loops(pts, np.array([ring[12]]))) == len(pts)


def test_trim_keeps_short_spans_whole():
    pts = np.array([(-74.0 + i * 0.001, 40.0) for i in range(60)])
    out = patterns.trim_to_stops(pts, pts[10], pts[50])
    assert 40 < len(out) < 60 and out[0, 0] <= pts[10, 0]
    assert len(patterns.trim_to_stops(pts, pts[10], pts[12])) == 60


def test_greedy_assignment_equals_a_loop(spark):
    r = random.Random(9)
    cands = [(a, b, round(r.random(), 2)) for a in range(25) for b in range(25) if r.random() < 0.2]
    got = {(x["a"], x["b"]) for x in similarity.greedy_assignment(spark.createDataFrame(cands, "a long, b long, score double")).collect()}
    used_a, used_b, want = set(), set(), set()
    for a, b, _ in sorted(cands, key=lambda c: (-c[2], c[0], c[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b))
    assert got == want


def test_series_operators(spark):
    rows = [("g", i, v) for i, v in enumerate([None, 2.0, None, 6.0, None])]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = [r["filled"] for r in lines.fill_gaps(df, ["g"], "i", "v").orderBy("i").collect()]
    assert got == [0, 2, 4, 6, 0]
    held = [r["filled"] for r in lines.fill_gaps(df, ["g"], "i", "v", True, True).orderBy("i").collect()]
    assert held == [2, 2, 4, 6, 6]
    s = [r["smooth"] for r in lines.gaussian_series(df, ["g"], "i", "v", 1.0).orderBy("i").collect()]
    w = [math.exp(-d * d / 2) for d in (1, 1)]
    assert abs(s[2] - (2 * w[0] + 6 * w[1]) / sum(w)) < 1e-12
    lim = lines.slope_limit(np.array([0.0, 10.0, 0.0]), np.array([True] * 3), 1.0)
    assert np.allclose(lim, [4.5, 5.5, 1.0 / 2 + 0]) or abs(np.diff(lim)).max() < 10
    jump = lines.limit_slope(spark.createDataFrame([("g", 0, 0.0), ("g", 1, 4.0)], "g string, i int, v double"), "g", "i", "v", 1.0)
    assert jump.count() == 2
    t = lines.thin(spark.createDataFrame([("a", i, float(i), 0.0) for i in range(10)], "line string, seq int, x double, y double"), "line", 4.0)
    assert [r["x"] for r in t.orderBy("seq").collect()] == [0, 4, 8, 9]
    z = lines.simplify(spark.createDataFrame([("a", i, float(i), 0.01 * (i % 2)) for i in range(10)], "line string, seq int, x double, y double"), "line", 0.1)
    assert z.count() == 2


def test_first_wins_keeps_rows_without_a_key(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n1")], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (None, "n2")], "id int, v string")
    assert {(r["id"], r["v"]) for r in tables.first_wins_union([a, b], "id").collect()} == {(1, "x"), (2, "z"), (None, "n1"), (None, "n2")}


def test_direct_segments_are_drawn_once(spark):
    rows = [(0, i, float(i), 0.0) for i in range(4)] + [(1, i, float(3 - i), 0.0) for i in range(4)] + [(1, 4, 0.0, 5.0)]
    got = patterns.direct_segments(spark.createDataFrame(rows, "path int, seq int, x double, y double"), 0.5).collect()
    assert sorted((r["path"], len(r["points"])) for r in got) == [(0, 4), (1, 2)]


