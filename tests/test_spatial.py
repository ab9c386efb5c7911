"""Projection, tiles, joins, clusters and geometry against closed forms and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vexel.operators import tiles
from vexel.spatial import cluster, geometry, joins, projection


def points(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-180, 180), rng.uniform(-88, 88)) for i in range(n)] + [(n, 10.0, 10.0), (n + 1, 10.0, 10.0), (n + 2, 180.0, 0.0), (n + 3, -180.0, 85.06)]
    return spark.createDataFrame(rows, "i long, lon double, lat double")


def test_projection_round_trip(spark):
    x, y = projection.project(F.col("lon"), F.col("lat"), 512.0)
    lon, lat = projection.unproject(x, y, 512.0)
    for r in points(spark).where("abs(lat) < 85").select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.lon - r.a) < 1e-9 and abs(r.lat - r.b) < 1e-9


def test_tiles_hold_their_points(spark):
    for z in (0, 1, 5, 12):
        x, y = projection.tile_of(F.col("lon"), F.col("lat"), z)
        u, v = projection.tile_local(F.col("lon"), F.col("lat"), z, F.col("x"), F.col("y"))
        rows = points(spark).withColumns({"x": x, "y": y}).withColumns({"u": u, "v": v}).collect()
        assert all(0 <= r.x < 1 << z and 0 <= r.y < 1 << z for r in rows)
        assert all(-1e-6 <= r.u <= 8192 and -1e-6 <= r.v <= 8192 + 1e-6 for r in rows)


def test_tile_numbers_are_a_curve(spark):
    from vexel.sources.pmtiles import tile_at, tile_number

    df = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    got = {(r.x, r.y): r.t for r in df.select("x", "y", projection.tile_id(3, F.col("x"), F.col("y")).alias("t")).collect()}
    assert sorted(got.values()) == list(range(21, 85))
    assert all(tile_number(3, x, y) == t and tile_at(t) == (3, x, y) for (x, y), t in got.items())
    path = sorted(got, key=got.get)
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))
    assert tile_number(3, 8, 0) is None
    assert spark.range(1).select(projection.tile_id(3, F.lit(8), F.lit(0)).alias("t")).first().t is None


def test_box_cover(spark):
    assert projection.tile_count(-180, -85.05, 180, 85.05, 3) == 64
    assert projection.tile_count(170, -10, -170, 10, 3) == projection.box_cover(spark, 170, -10, -170, 10, 3).count() == 4
    assert projection.box_cover(spark, 0, 86, 10, 89, 4).count() == 0
    assert [tuple(r) for r in projection.box_cover(spark, 0, -80, 10, 80, 0).collect()] == [(0, 0, 0)]
    with pytest.raises(projection.CoverTooLarge):
        projection.box_cover(spark, -180, -80, 180, 80, 9, limit=100)
    # an east edge on a border doesn't take the next column
    assert {r.x for r in projection.box_cover(spark, 0, 1, 45, 2, 3).collect()} == {4}


def test_joins_against_nested_loops(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(150)] + [(200, 0.0, 0.0), (201, 0.0, 0.0)]
    b = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(150)] + [(300, 0.5, 0.0)]
    left, right = spark.createDataFrame(a, "i long, ax double, ay double"), spark.createDataFrame(b, "j long, bx double, by double")
    want = {(p[0], q[0]) for p in a for q in b if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 0.25}
    got = [(r.i, r.j) for r in joins.radius_join(left, right, 0.5, "ax", "ay", "bx", "by").collect()]
    assert sorted(got) == sorted(want)
    semi = {r.i for r in joins.radius_join(left, right, 0.5, "ax", "ay", "bx", "by", "left_semi").collect()}
    anti = {r.i for r in joins.radius_join(left, right, 0.5, "ax", "ay", "bx", "by", "left_anti").collect()}
    assert semi == {i for i, _ in want} and anti == {p[0] for p in a} - semi
    boxes = spark.createDataFrame([(k, x, y, x + 1.3, y + 0.7) for k, x, y in b], "k long, x0 double, y0 double, x1 double, y1 double")
    got = [(r.i, r.k) for r in joins.box_join(left, boxes, 0.6, "ax", "ay").collect()]
    assert sorted(got) == sorted((p[0], q[0]) for p in a for q in b if q[1] <= p[1] <= q[1] + 1.3 and q[2] <= p[2] <= q[2] + 0.7)


def test_overlapping_boxes_once(spark):
    rng = random.Random(3)
    box = lambda i: (0, i, x := rng.randrange(20), y := rng.randrange(20), x + rng.randrange(6), y + rng.randrange(6))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    left = spark.createDataFrame(a, "k int, l int, l_x0 int, l_y0 int, l_x1 int, l_y1 int")
    right = spark.createDataFrame(b, "k int, r int, r_x0 int, r_y0 int, r_x1 int, r_y1 int")
    got = sorted((r.l, r.r) for r in joins.box_box_join(left, right, 4.0, ["k"]).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])


def test_touching(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(joins.circles_collide(lit(0, 0, 1), lit(2, 0, 1)).alias("c"), joins.boxes_overlap(lit(0, 0, 1, 1), lit(1, 1, 2, 2)).alias("b"), joins.circle_meets_box(lit(0, 0, 1), lit(1, -1, 2, 1)).alias("m")).first()
    assert (r.c, r.b, r.m) == (False, True, True)


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (1, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 4, "b"), (2, 10, "c")], "k int, t int, v string")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None, (1, 3): "a"}


# -- clusters


def test_rounds_and_tasks_cluster_alike(spark):
    p = points(spark, 250, seed=4)
    o = cluster.Options(max_zoom=3, min_points=2)
    key = lambda df: sorted((r.z, r["index"], r.id, r.n, r.parent_id, round(r.x, 9), round(r.y, 9)) for r in df.collect())
    one = key(cluster.hierarchy(p, "lon", "lat", "i", o))
    many = key(cluster.hierarchy(p, "lon", "lat", "i", o, task_points=60))
    assert one == many
    assert sum(n for z, _, _, n, _, _, _ in one if z == 0) == p.count()


def test_levels_against_the_rule(spark):
    p = points(spark, 120, seed=5)
    o = cluster.Options(max_zoom=1, min_points=2)
    levels = cluster.hierarchy(p, "lon", "lat", "i", o).cache()
    for z in (2, 1):
        level = sorted(levels.where(F.col("z") == z).collect(), key=lambda r: r["index"])
        r, taken, groups = o.reach(z - 1), set(), []
        for a in level:
            if a["index"] in taken:
                continue
            own = [b for b in level if b["index"] not in taken and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= r * r]
            taken |= {b["index"] for b in own}
            groups.append(sum(b.n for b in own))
        up = sorted(levels.where(F.col("z") == z - 1).collect(), key=lambda r: r["index"])
        assert [u.n for u in up] == groups


def test_drill_down(spark):
    rows = [(i, 10.0 + 0.001 * i, 10.0) for i in range(12)] + [(12, -100.0, 0.0)]
    df = spark.createDataFrame(rows, "i long, lon double, lat double")
    o = cluster.Options(max_zoom=6)
    levels = cluster.hierarchy(df, "lon", "lat", "i", o).cache()
    top = levels.where("z = 0 and n > 1").collect()
    assert len(top) == 1 and top[0].n == 12
    assert [r.id for r in cluster.leaves(levels, top[0].id, 5, 3).collect()] == [3, 4, 5, 6, 7]
    assert cluster.expansion_zoom(levels, top[0].id, o) == 7
    assert sum(r.n for r in cluster.children(levels, top[0].id).collect()) == 12
    shown = cluster.with_properties(cluster.tile(levels, 0, 0, 0, o)).collect()
    assert {r.point_count for r in shown} == {12, None}


def test_abbreviations(spark):
    got = spark.range(1, 20_000).select("id", cluster.abbreviated(F.col("id")).alias("a")).collect()
    for r in got:
        n = r.id
        assert r.a == (str(n) if n < 1000 else f"{n / 1000:.1f}k" if n < 10_000 else f"{n / 1000:.0f}k"), n


# -- tile sets


def tile_frame(spark, rows):
    return spark.createDataFrame(rows, "z int, x int, y int")


def test_substitution(spark):
    ideal = tile_frame(spark, [(3, 0, 0), (3, 2, 2), (3, 4, 4), (3, 7, 7)])
    kids = [(4, 4 + i, 4 + j) for i in (0, 1) for j in (0, 1)]
    loaded = tile_frame(spark, [(3, 0, 0), *kids, (4, 8, 8), (1, 1, 1), (0, 0, 0)])
    got = {}
    for r in tiles.substituted(ideal, loaded).collect():
        got.setdefault((r.ideal_x, r.ideal_y), set()).add((r.z, r.x, r.y))
    assert got == {(0, 0): {(3, 0, 0)}, (2, 2): set(kids), (4, 4): {(4, 8, 8), (1, 1, 1)}, (7, 7): {(1, 1, 1)}}


def test_masks(spark):
    got = {}
    for r in tiles.masks(tile_frame(spark, [(0, 0, 0), (1, 0, 0), (2, 3, 3), (2, 0, 0)])).collect():
        got.setdefault((r.tz, r.tx, r.ty), set()).add((r.z, r.x, r.y))
    assert got[0, 0, 0] == {(1, 0, 1), (1, 1, 0), (2, 2, 2), (2, 2, 3), (2, 3, 2)}
    assert got[1, 0, 0] == {(2, 0, 1), (2, 1, 0), (2, 1, 1)} and got[2, 3, 3] == {(2, 3, 3)}


# -- geometry


def test_areas_and_lengths(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    df = spark.createDataFrame([(ring,), ([(1.0, 1.0)],), ([],)], "p array<struct<x:double,y:double>>")
    got = df.select(geometry.signed_area(F.col("p")).alias("a"), geometry.line_length(F.col("p")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(6.0, 12.0), (0.0, 0.0), (0.0, 0.0)]


def test_clipping():
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert abs(geometry.ring_area(geometry.clip_ring(square, 0, 2, 5))) == 30
    assert geometry.clip_ring(square, 0, 20, 30) == [] and geometry.clip_ring(square, 1, -5, 50) == square
    line = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert geometry.clip_line(line, 0, 2, 5) == [[(2, 0), (5, 0)], [(5, 10), (2, 10)]]
    assert [(a, b) for _, a, b in geometry.clip_line_measured(line, 0, 2, 5)] == [(2, 5), (25, 28)]
    assert geometry.clip_line(line, 0, 0, 10) == [line] and geometry.clip_line(line, 0, 20, 30) == []


def test_simplification():
    assert geometry.importances([]) == [] and geometry.importances([(0, 0), (1, 1)]) == [1.0, 1.0]
    w = geometry.importances([(0, 0), (1, 0), (2, 5), (3, 0), (4, 0)])
    assert w[0] == w[-1] == 1.0 and w[2] == 25.0 and 0 < w[1] < 25
    assert geometry.importances([(0, 0), (1, 0), (2, 0)]) == [1.0, 0.0, 1.0]
    # equally far points: the one nearest the middle splits
    assert geometry.importances([(0, 0), (1, 2), (2, 2), (3, 2), (4, 0)])[2] == 4.0


def test_simplified_column(spark):
    line = [(float(i), math.sin(i / 3)) for i in range(40)]
    df = spark.createDataFrame([(line,)], "p array<struct<x:double,y:double>>").withColumn("w", geometry.importance_column(F.col("p")))
    r = df.select("w", geometry.simplified(F.col("p"), F.col("w"), 0.3).alias("s")).first()
    assert 2 <= len(r.s) < 40 and r.s[0].x == 0 and r.s[-1].x == 39 and r.w == geometry.importances(line)


def test_rings():
    outer, hole, other = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)], [(20, 0), (30, 0), (30, 10), (20, 0)]
    assert geometry.classified([outer, hole, other]) == [[outer, hole], [other]]
    assert geometry.classified([outer, hole, [(1, 1), (1, 9), (9, 9), (1, 1)]], most_holes=1) == [[outer, [(1, 1), (1, 9), (9, 9), (1, 1)]]]
    again = geometry.wound([hole[::-1], outer[::-1], other[:-1]])
    assert [geometry.ring_area(r) > 0 for r in again] == [True, False, True] and len(again) == 3
    x, y = geometry.label_point([[(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10), (0, 0)]], 0.01)
    assert geometry.contains([[(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10), (0, 0)]], x, y) and max(x, y) < 1.5
    assert geometry.label_point([]) is None


def test_polygon_cells():
    diamond = [(2.5, 0.2), (4.8, 2.5), (2.5, 4.8), (0.2, 2.5), (2.5, 0.2)]
    cells = {(x, y) for y, a, b in geometry.polygon_tiles([diamond]) for x in range(a, b + 1)}
    assert (2, 2) in cells and (0, 0) not in cells and (4, 2) in cells
    # every sampled inner point lies in a cell
    for i in range(50):
        for j in range(50):
            if geometry.contains([diamond], i / 10 + 0.01, j / 10 + 0.01):
                assert (i // 10, j // 10) in cells


def test_anchors():
    line = [(0.0, 0.0), (100.0, 0.0)]
    assert [a[0] for a in geometry.anchors(line, 30, 10, 10, 1)] == [10, 40, 70, 100]
    bent = [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0)]
    assert [a[:2] for a in geometry.anchors(bent, 25, 0, 20, 1.0)] == [(0, 0), (25, 0), (50, 25), (50, 50)]
