"""GeoJSON, vector tiles, archives, elevation and URLs, malformed input included."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vexel.sources import dem, geojson, mvt, pmtiles, urls


def docs(spark, *d):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in d], "doc string")


def feature(geometry, **more):
    return {"type": "Feature", "geometry": geometry, "properties": {"a": 1}} | more


def test_geojson_kinds(spark):
    d = {
        "type": "FeatureCollection",
        "features": [
            feature({"type": "Point", "coordinates": [1, 2]}, id=7),
            feature({"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, id="x"),
            feature({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, id=None),
            feature({"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, properties=None),
            feature({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}),
            feature({"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}),
        ],
    }
    rows = geojson.features(docs(spark, d)).orderBy("feature_index").select("*", F.to_json("id").alias("i"), F.to_json("props").alias("p")).collect()
    assert [r.geom_type for r in rows] == ["Point", "Point", "LineString", "LineString", "Polygon", "Polygon"]
    assert [r.i for r in rows] == ["7", '"x"', None, None, None, None]
    assert rows[3].p == "{}" and rows[0].p == '{"a":1}'
    assert len(rows[5].geom) == 2 and rows[1].geom[0][0][1].y == 4.0


def test_geojson_documents(spark):
    bare, one = {"type": "Point", "coordinates": [1, 2]}, feature({"type": "Point", "coordinates": [3, 4]})
    assert geojson.features(docs(spark, bare, one)).count() == 2
    bad = docs(spark, "not json", {"type": "Nope"}, feature(None), feature({"type": "GeometryCollection", "geometries": []}), feature({"type": "Point", "coordinates": ["x"]}), one)
    kept = geojson.features(bad, on_error="keep").collect()
    assert len(kept) == 6 and sum(r.error is None for r in kept) == 1
    assert geojson.features(bad, on_error="drop").count() == 1
    with pytest.raises(Exception, match="null|GeoJSON|unsupported|malformed"):
        geojson.features(bad).collect()


def test_geojson_file_and_winding(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text(json.dumps(feature({"type": "Polygon", "coordinates": [[[0, 0], [0, 9], [9, 9], [9, 0], [0, 0]], [[1, 1], [1, 2], [2, 2], [1, 1]]]})))
    rings = geojson.read(spark, str(p), wind=True).first().geom[0]
    from vexel.spatial.geometry import ring_area

    assert [ring_area([(q.x, q.y) for q in r]) > 0 for r in rings] == [True, False]


LAYERS = [
    {"name": "roads", "version": 2, "extent": 4096, "features": [{"id": 5, "type": "LineString", "geom": [[(0, 0), (10, -5), (7, 7)], [(1, 1), (2, 2)]], "props": {"k": "v", "n": 1.5, "b": True}}, {"id": None, "type": "Point", "geom": [[(3, 4)], [(5, 6)]], "props": {}}]},
    {"name": "water", "version": 1, "extent": 512, "features": [{"id": 1 << 40, "type": "Polygon", "geom": [[(0, 0), (10, 0), (10, 10), (0, 0)], [(2, 2), (2, 3), (3, 3), (2, 2)]], "props": {"k": "v", "m": -2.0}}]},
]


def test_tile_round_trip():
    assert mvt.decode(mvt.encode(LAYERS)) == LAYERS
    assert mvt.decode(b"") == []


def test_tile_values():
    from vexel.sources.protobuf import put, put_varint

    value = lambda body: put(3, put(15, 2) + put(1, "l") + put(2, put(2, bytes([0, 0])) + put(3, 1)) + put(3, "k") + put(4, body))
    cases = [(put(1, "s"), "s"), (put_varint(2 << 3 | 5) + struct.pack("<f", 0.5), 0.5), (put(3, 2.5), 2.5), (put(4, -3), -3.0), (put(5, 7), 7.0), (put(6, 5), -3.0), (put(7, 1), True)]
    for body, want in cases:
        assert mvt.decode(value(body))[0]["features"][0]["props"] == {"k": want}
    for body in (b"", put(4, 1) + put(5, 1)):
        with pytest.raises(mvt.TileError):
            mvt.decode(value(body))


def test_tiles_that_break_the_format():
    from vexel.sources.protobuf import put, put_packed

    layer = lambda *parts: put(3, put(1, "l") + put(15, 2) + b"".join(parts))
    feature_of = lambda *parts: put(2, b"".join(parts))
    for bad in (put(3, put(15, 2)), put(3, put(1, "l") + put(15, 3)), layer() + layer(), layer(feature_of(put_packed(2, [0]))), layer(feature_of(put_packed(2, [0, 0]))), layer(feature_of(put_packed(4, [9]), put_packed(4, [9]))), layer(feature_of(put(3, 2), put_packed(4, [10, 1, 1]))), layer(feature_of(put(3, 3), put_packed(4, [15]))), layer(feature_of(put_packed(4, [9 + 8, 0]))), b"\x1a\xff"):
        with pytest.raises(mvt.TileError):
            mvt.decode(bad)


def test_mutated_tiles_decode_or_fail_cleanly():
    rng, data = random.Random(1), mvt.encode(LAYERS)
    for _ in range(1500):
        bad = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            mvt.decode(bytes(bad[: rng.randrange(1, len(bad) + 1)]))
        except mvt.TileError:
            pass


def test_tiles_as_rows(spark):
    tiles = spark.createDataFrame([(1, 0, 1, bytearray(mvt.encode(LAYERS))), (1, 1, 1, bytearray(b"\x1a\xff")), (1, 0, 0, None)], "z int, x int, y int, data binary")
    rows = mvt.features(tiles, on_error="drop").collect()
    assert len(rows) == 3 and {r.source_layer for r in rows} == {"roads", "water"}
    assert [r.error for r in mvt.features(tiles, on_error="keep").where("error is not null").collect()] != []
    with pytest.raises(Exception, match="truncated|varint"):
        mvt.features(tiles).collect()
    again = mvt.build(mvt.features(tiles, on_error="drop").withColumn("props_json", F.to_json("props"))).collect()
    assert len(again) == 1 and {x["name"] for x in mvt.decode(bytes(again[0].data))} == {"roads", "water"}


def archive_tiles():
    return {(z, x, y): f"{z}/{x}/{y % 2}".encode() * 3 for z in range(4) for x in range(1 << z) for y in range(1 << z)}


@pytest.mark.parametrize("leaf", [None, 7])
def test_archives(spark, tmp_path, leaf):
    import io

    t = archive_tiles()
    data = pmtiles.build(t, leaf_size=leaf)
    a = pmtiles.Archive(io.BytesIO(data))
    assert all(a.tile(*k) == v for k, v in t.items()) and a.tile(4, 0, 0) is None and a.tile(2, 9, 0) is None
    assert (a.header.min_zoom, a.header.max_zoom) == (0, 3)
    p = tmp_path / "a.pmtiles"
    p.write_bytes(data)
    pmtiles.register(spark)
    got = spark.read.format("vexel_pmtiles").option("path", str(p)).load()
    assert {(r.z, r.x, r.y): bytes(r.data) for r in got.collect()} == t
    some = spark.read.format("vexel_pmtiles").option("path", str(p)).option("minz", 2).option("maxz", 2).load()
    assert {(r.z, r.x, r.y) for r in some.collect()} == {k for k in t if k[0] == 2}
    with pytest.raises(pmtiles.ArchiveError):
        pmtiles.Archive(io.BytesIO(b"x" * 200))


def test_directory_round_trip():
    entries = [pmtiles.Entry(1, 0, 5, 1), pmtiles.Entry(2, 5, 3, 4), pmtiles.Entry(9, 0, 5, 0)]
    assert pmtiles.directory(pmtiles.put_directory(entries)) == entries
    assert pmtiles.find(entries, 5).tile_id == 2 and pmtiles.find(entries, 6) is None and pmtiles.find(entries, 99).run == 0 and pmtiles.find(entries, 0) is None


def test_elevation(spark):
    px = [(1, x, y, i, j, float(100 * x + 10 * y + i + j)) for x in (0, 1) for y in (0, 1) for i in range(2) for j in range(2)]
    d = spark.createDataFrame(px, "z int, x int, y int, px int, py int, h double")
    b = {(r.x, r.y, r.px, r.py): r.h for r in dem.bordered(d, 2).collect()}
    assert len(b) == 4 * 16
    assert b[0, 0, 2, 0] == 100.0 and b[0, 0, 0, 2] == 10.0 and b[0, 0, 2, 2] == 110.0
    # around the world, and the nearest own pixel beyond the poles
    assert b[0, 0, -1, 0] == 101.0 and b[0, 0, 0, -1] == 0.0
    p = spark.createDataFrame([(1, 0, 0, 0.5, 0.5), (1, 0, 0, 9.0, 9.0)], "z int, x int, y int, u double, v double")
    assert [r.h for r in dem.sampled(p, d).orderBy("u").collect()] == [1.0, None]
    plane = spark.createDataFrame([(0, 0, 0, i, j, 3.0 * i + 2.0 * j) for i in range(4) for j in range(4)], d.schema)
    s = dem.slopes(plane, 10.0).collect()
    assert len(s) == 4 and all(abs(r.dzdx - 0.3) < 1e-12 and abs(r.dzdy - 0.2) < 1e-12 for r in s)
    assert spark.range(1).select(dem.elevation(F.lit(1), F.lit(134), F.lit(160)).alias("h")).first().h == pytest.approx(0.0)
    r = dem.coarsest_within(dem.pyramid(spark.createDataFrame([(0, 0, 0.0, 1.0), (1, 0, 5.0, 6.0), (8, 8, 0.0, 0.0)], "cx int, cy int, low double, high double"), 3), 1.0).first()
    assert r.level == 0


def png(width, height, rows, kind=6, filters=None):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(bytes([0]) + bytes(r) for r in rows) if filters is None else filters
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png():
    assert dem.read_png(png(1, 2, [[1, 2, 3, 4], [5, 6, 7, 8]])) == (1, 2, bytes([1, 2, 3, 4, 5, 6, 7, 8]))
    assert dem.read_png(png(2, 1, [[1, 2, 3, 9, 9, 9]], kind=2))[2] == bytes([1, 2, 3, 255, 9, 9, 9, 255])
    up = bytes([0, 10, 20, 30, 40]) + bytes([2, 1, 1, 1, 1])
    assert dem.read_png(png(1, 2, None, filters=up))[2][4:] == bytes([11, 21, 31, 41])
    sub = bytes([1, 1, 2, 3, 4, 1, 1, 1, 1])
    assert dem.read_png(png(2, 1, None, filters=sub))[2] == bytes([1, 2, 3, 4, 2, 3, 4, 5])
    for bad in (b"x", png(1, 1, [[1]])):
        with pytest.raises(dem.ImageError):
            dem.read_png(bad)


def test_urls(spark):
    one = spark.range(1).select(F.lit(5).alias("x"), F.lit(9).alias("y"))
    u = lambda t, **k: one.select(urls.expand(t, 4, F.col("x"), F.col("y"), **k).alias("u")).first().u
    assert u("{z}/{x}/{y}{ratio}.p", ratio=2.0) == "4/5/9@2x.p" and u("{y}", scheme="tms") == "6"
    assert u("{quadkey}|{prefix}|{nope}|{x") == "2103|59|{nope}|{x"
    assert [float(v) for v in u("{bbox-epsg-3857}").split(",")] == pytest.approx([-7514065.628545966, -5009377.085697312, -5009377.085697312, -2504688.542848654])
    assert one.select(urls.percent_encoded(F.lit("a b/é~")).alias("u")).first().u == "a%20b%2f%c3%a9~"
    assert urls.canonical("https://a/b?key=1&x=2&access_token=3") == "https://a/b?x=2" and urls.canonical("https://a/b?key=1") == "https://a/b"
    r = urls.Router([(lambda s: s.startswith("mb:"), 1)], fallback=2)
    assert (r("mb:x"), r("y")) == (1, 2)
    with pytest.raises(LookupError):
        urls.Router([])("z")
    with pytest.raises(ValueError):
        urls.tile_set({"tiles": []})
