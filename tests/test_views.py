"""Views, annotations, sheets, sizes and lights."""

import math

import pytest
from pyspark.sql import functions as F

from vexel.plans import extras
from vexel.sources import annotations, geojson, sheets
from vexel.sources.protobuf import put
from vexel.spatial.cover import NotOnTheMap, View, as_frame, gaps, pitched_tiles, polygon_cover, view_tiles


@pytest.mark.parametrize("view", [View(-0.11, 51.505, 13, 1024, 768), View(10, 20, 5.5, 600, 400, bearing=37), View(-100, -30, 9.2, 800, 600, bearing=-120, pitch=50)])
def test_views_round_trip_and_are_covered(view):
    for sx, sy in ((view.width / 2, view.height / 2), (10, view.height - 5), (view.width - 1, view.height / 2)):
        assert view.geo_to_screen(*view.screen_to_geo(sx, sy)) == pytest.approx((sx, sy))
    assert view.screen_to_geo(view.width / 2, view.height / 2) == pytest.approx((view.lon, view.lat))
    assert gaps(view, view_tiles(view)) == []


def test_the_center_comes_first():
    t = view_tiles(View(0.1, 0.1, 4, 512, 512))
    assert t[0][:3] == (4, 8, 7) and len(t) == len(set(t))


def test_world_copies():
    wide = View(179, 0, 1, 1500, 300)
    assert {t[3] for t in view_tiles(wide)} >= {0, 1} and {t[3] for t in view_tiles(wide, copies=False)} == {0}
    assert gaps(wide, view_tiles(wide)) == []


def test_pitched_views_get_coarser_far_off():
    v = View(5, 45, 12, 1600, 1600, pitch=70)
    t = pitched_tiles(v)
    assert len({x[0] for x in t}) > 1 and max(x[0] for x in t) == 12 and len(t) < len(view_tiles(v))
    flat = View(5, 45, 3, 800, 600)
    assert set(pitched_tiles(flat)) == set(view_tiles(flat))


def test_the_sky_is_not_on_the_map():
    with pytest.raises(NotOnTheMap):
        View(0, 0, 5, 800, 1600, pitch=80).screen_to_geo(400, 0)


def test_polygon_cover(spark):
    g = [[[(1.0, 1.0), (60.0, 1.0), (60.0, 40.0), (1.0, 1.0)]]]
    df = spark.createDataFrame([(1, g)], "id long, geom array<array<array<struct<x:double,y:double>>>>")
    got = {(r.x, r.y) for r in polygon_cover(df, 3).collect()}
    assert got == {(4, 3), (5, 3), (4, 3), (5, 3)} | {c for c in got if c in {(4, 3), (5, 3), (5, 2), (4, 2)}} and (5, 3) in got and (4, 3) in got
    assert as_frame(spark, [(1, 0, 0, 0)]).count() == 1


def test_annotations(spark):
    a = spark.createDataFrame([(0, 1.0, 1.0, "x")], "id long, lon double, lat double, icon string")
    a = annotations.added(a, spark.createDataFrame([(2, -10.0, 1.0, "b"), (1, 5.0, 5.0, "a")], "ord int, lon double, lat double, icon string"))
    assert {r.id: r.icon for r in a.collect()} == {0: "x", 1: "a", 2: "b"}
    a = annotations.updated(a, spark.createDataFrame([(1, 6.0, 6.0, "new"), (9, 0.0, 0.0, "no")], a.schema))
    assert {r.id: r.icon for r in a.collect()} == {0: "x", 1: "new", 2: "b"}
    assert [r.id for r in annotations.tile_symbols(a, 1, 1, 0).collect()] == [0, 1]
    assert annotations.removed(a, a.where("id = 0")).count() == 2
    doc = spark.createDataFrame([('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"icon":"p"},"geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}},{"type":"Feature","properties":null,"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}}]}',)], "doc string")
    symbols, shapes = annotations.from_features(geojson.features(doc))
    assert sorted((r.lon, r.icon) for r in symbols.collect()) == [(1.0, "p"), (3.0, "p")] and shapes.count() == 1


def test_sprites(spark):
    doc = '{"a":{"x":0,"y":0,"width":8,"height":8,"pixelRatio":2,"sdf":true},"b":{"x":30,"y":0,"width":8,"height":8},"c":{"width":0,"height":4},"d":{"width":4,"height":4,"pixelRatio":-1}}'
    df = spark.createDataFrame([(doc,)], "doc string")
    assert {r.name for r in sheets.sprites(df).collect()} == {"a", "b"}
    r = sheets.sprites(df, 32, 32).collect()
    assert len(r) == 1 and r[0].sdf and r[0].pixel_ratio == 2.0
    assert sheets.sheet_urls("u/s?k=1", 2.0) == ("u/s@2x.json?k=1", "u/s@2x.png?k=1")


def test_glyphs(spark):
    g = put(1, 65) + put(2, bytes(8 * 9)) + put(3, 2) + put(4, 3) + put(5, 1) + put(6, 4) + put(7, 11)
    data = put(1, put(1, "Sans") + put(2, "0-255") + put(3, g) + put(3, put(1, 32) + put(7, 5)))
    df = spark.createDataFrame([(bytearray(data),), (None,)], "data binary")
    assert [(r.stack, r.id, r.left, r.top, r.advance) for r in sheets.glyphs(df).collect()] == [("Sans", 65, -1, 2, 11), ("Sans", 32, 0, 0, 5)]
    with pytest.raises(Exception):
        sheets.decode_glyphs(put(1, put(3, put(2, b"x") + put(3, 2) + put(4, 2))))


def test_sizes_lights_and_fades(spark):
    from vexel.lang.values import Fields

    df = spark.createDataFrame([(2.0, "x")], "k double, s string")
    at = lambda z: Fields.of(df, zoom=z)
    pick = lambda e: tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(extras.size_range(e, at, 3.5, 16))]).first())
    assert pick(["interpolate", ["linear"], ["zoom"], 0, 0, 10, ["*", 10, ["get", "k"]]]) == (6.0, 8.0)
    assert pick(["get", "k"]) == (2.0, 2.0) and pick(["number", ["get", "nope"]]) == (16.0, 16.0)
    assert extras.faded(lambda z: z, 5.5, 5) == (4.5, 5.5) and extras.faded(lambda z: z, 4.5, 5) == (5.5, 4.5)
    assert extras.pattern_names([lambda z: "a" if z < 3 else "b", lambda z: None], 3) == ["a", "b"]
    d = extras.light(None)["direction"]
    assert math.isclose(math.hypot(*d), 1.15) and extras.light({"anchor": "map"})["anchor"] == "map"
    with pytest.raises(Exception):
        extras.light({"position": [1]})
    assert df.select(F.lit(1)).count() == 1


def test_world_copies_reach(spark):
    from vexel.spatial.joins import reaches

    rows = [(1, 170.0, 190.0), (2, -10.0, 10.0)]
    df = spark.createDataFrame(rows, "i int, low double, high double")
    at = lambda x, wrap: {r.i for r in df.where(reaches(F.col("low"), F.col("high"), 2, x, wrap)).collect()}
    assert at(0, 1) == {1} and at(3, 0) == {1} and at(1, 0) == {2} and at(2, 0) == {2} and at(0, 0) == set()


def test_elevation_of_places(spark):
    from vexel.sources import dem

    px = [(0, 0, 0, i, j, float(i)) for i in range(-1, 5) for j in range(-1, 5)]
    pixels = spark.createDataFrame(px, "z int, x int, y int, px int, py int, h double")
    got = dem.elevations(spark.createDataFrame([(0.0, 0.0), (90.0, 0.0)], "lon double, lat double"), pixels, 0, 4).orderBy("lon").collect()
    assert [round(r.h, 9) for r in got] == [1.5, 2.5]
    cells = spark.createDataFrame([(x, y, float(x), float(x + y)) for x in range(8) for y in range(8)], "cx int, cy int, low double, high double")
    r = dem.range_over_box(dem.pyramid(cells, 3), 3, 3, 4, 4).first()
    assert (r.low, r.high) == (3.0, 8.0)
    r = dem.range_over_box(dem.pyramid(cells, 3), 1, 1, 5, 2).first()
    assert r.low <= 1.0 and r.high >= 7.0
    m = spark.range(1).select(dem.invisible_relief(10, F.lit(0.0), 1.0, 1.0).alias("a"), dem.invisible_relief(11, F.lit(0.0), 1.0, 1.0).alias("b")).first()
    assert m.a == pytest.approx(2 * m.b)


def test_collision_shapes(spark):
    from vexel.operators import labels

    e = {"top": F.lit(-1.0), "bottom": F.lit(1.0), "left": F.lit(-4.0), "right": F.lit(4.0)}
    flat = labels.collision_box(e, F.lit(10.0), F.lit(20.0), F.lit(2.0), F.lit(1.0))
    turned = labels.collision_box(e, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(90.0))
    r = spark.range(1).select(*[c.alias(f"a{i}") for i, c in enumerate(flat)], *[c.alias(f"b{i}") for i, c in enumerate(turned)]).first()
    assert tuple(r)[:4] == (1.0, 17.0, 19.0, 23.0) and tuple(r)[4:] == pytest.approx((-1, -4, 1, 4))
    c = labels.line_circles([(0, 0), (10, 0), (10, 10)], 10, 8, 2)
    assert len(c) == 4 and c[0] == (7.0, 0.0, 1.0) and c[-1] == (10.0, 3.0, 1.0)
    assert labels.line_circles([(0, 0), (5, 0)], 2, 8, 2) == []


def test_images_and_replaced_sources(spark):
    from vexel.plans.document import Style, images_used, replaced

    s = Style.parse({"version": 8, "layers": [{"id": "a", "type": "symbol", "layout": {"icon-image": ["match", ["get", "k"], "key", "one", "two"]}}, {"id": "b", "type": "fill", "paint": {"fill-pattern": "dots"}}]})
    assert images_used(s) == {"one", "two", "dots"}
    held = replaced(None, spark.createDataFrame([(1,)], "i int"), "x", 1)
    held = replaced(held, spark.createDataFrame([(2,)], "i int"), "y", 1)
    held = replaced(held, spark.createDataFrame([(3,), (4,)], "i int"), "x", 2)
    assert {(r.i, r.source, r.revision) for r in held.collect()} == {(2, "y", 1), (3, "x", 2), (4, "x", 2)}
