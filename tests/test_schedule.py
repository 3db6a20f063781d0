"""Calendars, spans, masks, feeds and scenarios on small made-up feeds."""

import zipfile

import pytest
from pyspark.sql import functions as F

from isochron.functions import masks
from isochron.operators import patterns, service
from isochron.sources import gtfs


def tables(**more):
    base = {
        "agency": "agency_id,agency_name\nA,Metro Co\n",
        "routes": "﻿route_id, route_short_name,route_type,route_color\n7,Seven,1,ff0000\nB,Bus,3,\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon,parent_station\na,Alpha,40.0,-74.0,\nb,Beta,40.01,-74.0,\nx,Bad,nope,-74,\n",
        "trips": "route_id,shape_id,trip_id,service_id\n7,s,t1,wk\n7,s,t2,wk\nB,s2,t3,wk\n",
        "stop_times": "trip_id,stop_sequence,stop_id,arrival_time,departure_time\nt1,1,a,09:00:00,09:00:00\nt1,2,b,09:30:00,09:30:00\nt2,1,a,23:30:00,\nt2,2,b,25:10:00,\nt3,1,a,05:00:00,\n",
        "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns,40.01,-74.0,2\ns,40.0,-74.0,1\ns2,40.0,-74.0,1\ns2,40.2,-74,2\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nwk,1,0,0,0,0,0,1\n",
    }
    return base | more


def cells(act):
    return {(r["route_id"], r["cell"]): r["weight"] for r in act.collect()}


def test_histogram_spills_over_midnight_and_over_the_week(spark):
    got = cells(service.load_activity(gtfs.open_feed(spark, tables())))
    assert got["7", 9] == 1 and got["7", 6 * 24 + 23] == 1
    assert got["7", 0] == 1 and got["7", 1] == 1  # Sunday's trip on Monday
    assert got["7", 24] == 1  # Monday's trip on Tuesday
    assert ("7", 10) not in got and got["B", 5] == 1


def test_added_dates_weigh_weekdays_and_the_calendar_wins(spark):
    dates = "service_id,date,exception_type\nd,20240101,1\nd,20240108,1\nd,20240115,1\nd,20240106,1\nd,bad,1\nd,20240102,2\nwk,20240103,1\n"
    w = service.service_weights(gtfs.open_feed(spark, tables(calendar_dates=dates)))
    assert {(r[0], r[1]): r[2] for r in w.collect()} == {("wk", 0): 1, ("wk", 6): 1, ("d", 0): 3, ("d", 5): 1}


def test_frequencies_replace_then_extend_the_span(spark):
    f = "trip_id,start_time,end_time\nt1,05:00:00,23:00:00\nt1,03:00:00,04:00:00\n"
    feed = gtfs.open_feed(spark, tables(frequencies=f))
    spans = {r["trip_id"]: (r["first"], r["last"]) for r in service.trip_spans(feed, feed.table("trips")).collect()}
    assert spans["t1"] == (3 * 3600, 23 * 3600 + 1800)  # 4:00 plus the replaced run time of 18:30 ends before 23:30


def test_sources_agree(spark, tmp_path):
    t = tables()
    folder, z = tmp_path / "feed", tmp_path / "feed.zip"
    folder.mkdir()
    with zipfile.ZipFile(z, "w") as f:
        for k, v in t.items():
            (folder / f"{k}.txt").write_text(v, encoding="utf-8")
            f.writestr(f"inner/{k}.txt", v)
    feeds = [gtfs.open_feed(spark, x) for x in (t, str(folder), str(z))]
    for name in t:
        rows = [sorted(map(tuple, f.table(name).collect())) for f in feeds]
        assert rows[0] == rows[1] == rows[2], name
    assert gtfs.stops(feeds[0]).count() == 2
    assert {r["agency"] for r in gtfs.routes(feeds[2]).collect()} == {"A"}


def test_ragged_rows_and_required_tables(spark, tmp_path):
    with pytest.raises(gtfs.FeedError):
        gtfs.open_feed(spark, {"stops": "stop_id\n"})
    (tmp_path / "empty").mkdir()
    with pytest.raises(gtfs.FeedError):
        gtfs.open_feed(spark, str(tmp_path / "empty"))
    loose = gtfs.open_feed(spark, {"routes.txt": 'route_id,route_short_name,route_type\nx\ny,"a ""b""",2\n'})
    assert [(r["route_id"], r["route_short_name"], r["route_type"]) for r in loose.table("routes").collect()] == [("x", "", ""), ("y", 'a "b"', "2")]
    strict = gtfs.open_feed(spark, {"routes": "route_id,route_short_name,route_type\nx\ny,b,2\n"}, strict=True)
    assert [r["route_id"] for r in strict.table("routes").collect()] == ["y"]


def test_patterns_with_and_without_shapes(spark):
    p = {r["route_id"]: r for r in patterns.load_patterns(gtfs.open_feed(spark, tables()), 1.01).collect()}
    assert p["7"]["trips"] == 2 and p["7"]["stop_seq"] == ["a", "b"] and (p["7"]["term_a"], p["7"]["term_b"]) == ("a", "b")
    assert [round(q["lat"], 2) for q in p["7"]["points"]] == [40.0, 40.01]
    t = tables()
    del t["shapes"]
    q = patterns.load_patterns_of([gtfs.open_feed(spark, t)] * 2, 1.01).collect()
    assert {(r["route_id"], r["trips"], tuple(r["stop_seq"])) for r in q} == {("7", 2, ("a", "b")), ("f1:7", 2, ("f1:a", "f1:b"))}
    only = patterns.load_patterns(gtfs.open_feed(spark, t), 1.01, F.col("route_type") == 2)
    assert only.count() == 0


def test_overlays_are_prefixed(spark):
    a = gtfs.open_feed(spark, tables())
    broken = gtfs.open_feed(spark, {"routes": "route_id\n"})
    ids = {r["route_id"] for r in service.load_activity_of([a, a, broken]).select("route_id").distinct().collect()}
    assert ids == {"7", "B", "f1:7", "f1:B"}


def test_masks_round_trip(spark):
    m = masks.set_hour(masks.set_hour(masks.empty_mask(), F.lit(0), F.lit(5)), F.lit(6), F.lit(23))
    r = spark.range(1).select(
        masks.to_hex(m).alias("h"), masks.is_active(m, F.lit(6), F.lit(23)).alias("on"), masks.is_active(m, F.lit(1), F.lit(5)).alias("off"),
        masks.to_hex(masks.from_hex(masks.to_hex(m))).alias("again"), masks.from_hex(F.lit("xyz")).alias("bad"), masks.is_empty(masks.empty_mask()).alias("empty"),
        masks.explains(m, masks.set_hour(masks.empty_mask(), F.lit(0), F.lit(5))).alias("ex"),
    ).first()
    assert r["h"] == "000020" + "000000" * 5 + "800000" == r["again"]
    assert r["on"] and not r["off"] and r["bad"] is None and r["empty"] and r["ex"]


def scenario_inputs(spark):
    rows = [("day", "d", c, 5) for d in range(7) for c in range(d * 24 + 6, d * 24 + 22)] + [("night", "n", c, 2) for d in range(7) for c in (*range(d * 24, d * 24 + 6), d * 24 + 22, d * 24 + 23)]
    rows += [("day", "rare", 9, 1)]
    act = spark.createDataFrame(rows, "route_id string, shape_id string, cell int, weight int")
    pts = spark.createDataFrame([(s, float(100 * i + 50), y) for s, y in (("d", 0.0), ("n", 9000.0), ("rare", 300.0)) for i in range(40)], "shape_id string, x double, y double")
    colors = spark.createDataFrame([("day", "red"), ("night", "blue")], "route_id string, color string")
    return act, pts, colors


def test_scenarios_do_not_depend_on_row_order_or_partitions(spark):
    act, pts, colors = scenario_inputs(spark)
    a = service.build_scenarios(act, pts, colors)
    b = service.build_scenarios(act.orderBy(F.rand(3)).repartition(7), pts.repartition(5), colors)
    assert a == b and len(a) == 2
    assert sorted(c for s in a for c in s["cells"]) == list(range(168))
    grid = service.scenario_grid(a)
    assert grid[0][7] == grid[6][21] != grid[0][3]
    assert a[0]["label"].startswith("Mon–Sun 06–22")


def test_cell_selection_equals_the_whole_selection(spark):
    act, _, _ = scenario_inputs(spark)
    cell = {(r["route_id"], r["shape_id"]) for r in service.select_by_cell(act).where("cell = 9").collect()}
    whole = {(r["route_id"], r["shape_id"]) for r in service.select_patterns(act, [9]).collect()}
    assert cell == whole == {("day", "d"), ("day", "rare")}
    assert {r["shape_id"] for r in service.select_patterns(act).collect()} == {"d", "n"}
