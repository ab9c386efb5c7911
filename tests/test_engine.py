"""The engine, captures, rings over ranges, archives' boxes, masks and covers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vexel.engine import Engine, on_screen
from vexel.operators import frames, ordered, tiles
from vexel.plans import box_query
from vexel.sources import capture, pmtiles
from vexel.spatial import cluster, cover, geometry
from vexel.streaming import state


def engine(spark, **view) -> Engine:
    e = Engine(spark, cover.View(lon=0.0, lat=0.0, zoom=2.0, width=800, height=600, **view))
    e.set_style({"version": 8, "sources": {"s": {"type": "geojson", "data": {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": 1, "properties": {"a": 3}, "geometry": {"type": "Point", "coordinates": [10, 20]}},
        {"type": "Feature", "id": 2, "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[-10, -10], [10, -10], [10, 10], [-10, 10], [-10, -10]]]}},
    ]}}}, "layers": [{"id": "area", "type": "fill", "source": "s", "filter": ["==", "$type", "Polygon"]}, {"id": "dot", "type": "circle", "source": "s", "filter": ["==", "$type", "Point"], "paint": {"circle-radius": ["get", "a"]}}]})
    return e


@pytest.mark.parametrize(("bearing", "pitch"), [(0.0, 0.0), (40.0, 0.0), (-75.0, 45.0)])
def test_columns_and_view_agree_on_the_screen(spark, bearing, pitch):
    v = cover.View(lon=3.0, lat=-4.0, zoom=3.5, width=640, height=480, bearing=bearing, pitch=pitch)
    rng = random.Random(1)
    places = [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(50)]
    x, y, w = on_screen(v, F.col("lon"), F.col("lat"))
    for r in spark.createDataFrame(places, "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y"), w.alias("w")).collect():
        if r.w > 1e-9:
            sx, sy = v.geo_to_screen(r.lon, r.lat)[:2]
            assert math.isclose(sx, r.x, abs_tol=1e-6) and math.isclose(sy, r.y, abs_tol=1e-6)


def test_engine_answers(spark):
    e = engine(spark)
    assert e.status()["layers"] == ["area", "dot"] and e.status()["rejected"] == {}
    sx, sy = e.view.geo_to_screen(10, 20)[:2]
    assert [(r.layer, r.id) for r in e.query(sx - 1, sy - 1, sx + 1, sy + 1).collect()] == [("dot", "1")]
    both = box_query.ordered(e.query(0, 0, 800, 600)).collect()
    assert [r.layer for r in both] == ["dot", "area"]
    assert e.query(0, 0, 800, 600, ["area"]).count() == 1
    assert e.query_geojson(0, 0, 800, 600).count() == 2
    e.set_view(zoom=3.0)
    assert set(e.frame()) == {"area", "dot"} and e.tiles().count() > 0
    e.set_annotations(spark.createDataFrame([(5, 1.0, 1.0, "pin")], "id long, lon double, lat double, icon string"))
    assert [r.id for r in e.annotation_tile(0, 0, 0).collect()] == [5]


def test_capture_round_trip_and_damage():
    records = [(1, b"abc", b""), (7, b"", b"payload"), (2, b"", b"")]
    data = capture.encode(records, [(0, 4), (4, 2)], b"region")
    assert capture.decode(data) == (records, [(0, 4), (4, 2)], b"region")
    for bad in (b"", data[:-1], b"X" + data[1:], data + b"x"):
        with pytest.raises(capture.CaptureError):
            capture.decode(bad)
    # a record whose lengths don't fit ends the reading
    broken = bytearray(data)
    broken[32 + 16 + 3 + 4] = 255
    assert capture.decode(bytes(broken))[0] == records[:1]


def test_state_is_carried_over_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rng = random.Random(3)
        rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.random() < 0.5, 100.0) for i in range(400)]
        got = {(r.key, r.seq): r for r in state.fades(spark.createDataFrame(rows, "key string, seq long, placed boolean, elapsed_ms double").repartition(5)).collect()}
        held = {}
        for key, seq, placed, ms in rows:
            held[key] = state.faded(held.get(key, 0.0), placed, ms)
            assert math.isclose(got[key, seq].opacity, held[key], abs_tol=1e-9)
        df = spark.createDataFrame([(k, s, int(p), s * 7919 % 101) for k, s, p, _ in rows], "k string, t long, p int, seq int")
        numbered = ordered.numbered(df, ["t"], "n", ["k"]).collect()
        for k in ("a", "b", None):
            assert sorted((r.t, r.n) for r in numbered if r.k == k) == [(t, i + 1) for i, t in enumerate(sorted(r[1] for r in rows if r[0] == k))]
        landed, most = set(), {}
        for k, t, _, _ in rows:
            if t * 7919 % 101 >= most.get(k, -1):
                landed.add(t)
            most[k] = max(most.get(k, -1), t * 7919 % 101)
        assert {r.t for r in state.landed(df, ["k"], "t", "seq").collect()} == landed
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_boxes_of_an_archive_hold_all_their_tiles():
    rng = random.Random(5)
    for _ in range(40):
        z = rng.randrange(1, 7)
        x0, y0 = rng.randrange(1 << z), rng.randrange(1 << z)
        x1, y1 = min((1 << z) - 1, x0 + rng.randrange(9)), min((1 << z) - 1, y0 + rng.randrange(9))
        ranges = pmtiles.box_numbers(z, x0, y0, x1, y1, 4)
        assert all(a < b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        held = {n for a, b in ranges for n in range(a, b)}
        assert all(pmtiles.tile_number(z, x, y) in held for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))


def test_masks_know_no_depth(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (5, 3, 3, 0), (0, 0, 0, 1)], "z int, x int, y int, wrap int")
    got = {}
    for r in tiles.masks(df).collect():
        got.setdefault((r.wrap, r.tz), set()).add((r.z, r.x, r.y))
    assert got[1, 0] == {(0, 0, 0)} and got[0, 5] == {(5, 3, 3)}
    # three siblings at each of five levels, and together with the covered tile they are the whole
    assert len(got[0, 0]) == 15 and sum(4.0 ** -z for z, _, _ in got[0, 0]) == 1 - 4.0**-5


def test_overlapping_rings_of_one_winding_have_no_hole():
    a = [(0.5, 0.5), (4.5, 0.5), (4.5, 4.5), (0.5, 4.5), (0.5, 0.5)]
    b = [(x + 2, y + 2) for x, y in a]
    rows = {y: (x0, x1) for y, x0, x1 in geometry.polygon_tiles([a, b])}
    assert rows[3] == (0, 6)
    hole = [(1.2, 1.2), (1.2, 3.8), (3.8, 3.8), (3.8, 1.2), (1.2, 1.2)]
    assert [r for r in geometry.polygon_tiles([a, hole]) if r[0] == 2] == [(2, 0, 1), (2, 3, 4)]


def test_clusters_by_rounds_are_those_of_one_task(spark):
    rng = random.Random(8)
    rows = [(i, rng.uniform(-3, 3) if i % 3 else 1.0 + rng.uniform(0, 0.01), rng.uniform(-3, 3) if i % 3 else 2.0) for i in range(300)]
    df = spark.createDataFrame(rows, "index long, lon double, lat double")
    o = cluster.Options(min_zoom=5, max_zoom=6)
    key = lambda d: sorted(map(str, d.select("z", "index", "id", "x", "y", "n", "parent_id").collect()))
    assert key(cluster.hierarchy(df, "lon", "lat", "index", o)) == key(cluster.hierarchy(df, "lon", "lat", "index", o, task_points=0))


def test_states_set_and_cleared(spark):
    c = spark.createDataFrame([(1, "s", "1", "a", "1"), (2, "s", "1", "b", "2"), (3, "s", "1", None, None), (4, "s", "1", "b", '"x"'), (5, "s", "2", "a", "1"), (6, "s", "2", "a", None)], "seq long, source string, id string, key string, value string")
    assert [(r.id, r.state) for r in frames.feature_states(c).collect()] == [("1", '{"b":"x"}')]
