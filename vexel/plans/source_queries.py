"""Registered queries over what sources read: the driver's tables are written in a source's format, read back, and
compared by SQL with the tables themselves."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import scratch_dir
from ..sources import annotations, dem, geojson, mvt, pmtiles, sheets, urls
from ..sources.protobuf import put
from ..spatial import geometry, projection
from .registry import query
from .tables import _PLACES, _tile_sql, dealt, places, table, tile_assign

_POINT = "struct<x:double,y:double>"


def _arrays(df: DataFrame, f, schema: str) -> DataFrame:
    """f over each row, as a dict, to a list of dicts, in Arrow batches."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for r in batch.to_pylist() for x in f(r)], schema=arrow)

    return df.mapInArrow(run, schema)


# -- vector tiles


def _tiled(spark, sf) -> DataFrame:
    """Customers as features of tiles of zoom 3, at positions in units of the extent."""
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 3)
    point = F.struct((F.col("c_custkey") % 4096).cast("double").alias("x"), (F.col("c_custkey") * 7 % 4096).cast("double").alias("y"))
    props = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), (F.col("c_nationkey") % 2 == 0).alias("even")))
    return places(spark, sf).select(F.lit(3).alias("z"), x.alias("x"), y.alias("y"), F.col("c_mktsegment").alias("source_layer"), F.col("c_custkey").alias("feature_index"), F.col("c_custkey").alias("id"), F.lit("Point").alias("geom_type"), F.array(F.array(F.array(point))).alias("geom"), props.alias("props_json"))


def _part(c: str, i: int = 0, j: int = 0, k: int = 0):
    return F.col(f"{c}")[i][j][k]


@query("mvt_points", f"SELECT 3::INT AS z, {_tile_sql(3)[0]} AS x, {_tile_sql(3)[1]} AS y, c_mktsegment AS source_layer, 4096::INT AS extent, c_custkey AS id, 'Point' AS geom_type, (c_custkey % 4096)::DOUBLE AS px, (c_custkey * 7 % 4096)::DOUBLE AS py, c_name AS name, c_acctbal AS balance, c_nationkey % 2 = 0 AS even FROM {_PLACES}")
def mvt_points(spark, sf):
    rows = mvt.features(mvt.build(_tiled(spark, sf)))
    get = lambda k, t: F.try_variant_get("props", f"$.{k}", t).alias(k)
    return rows.select("z", "x", "y", "source_layer", "extent", "id", "geom_type", _part("geom")["x"].alias("px"), _part("geom")["y"].alias("py"), get("name", "string"), get("balance", "double"), get("even", "boolean"))


@query("mvt_layer_order", f"SELECT x, y, source_layer, (row_number() OVER (PARTITION BY x, y, source_layer ORDER BY c_custkey) - 1)::BIGINT AS feature_index, c_custkey AS id FROM (SELECT c_custkey, c_mktsegment AS source_layer, {_tile_sql(3)[0]} AS x, {_tile_sql(3)[1]} AS y FROM {_PLACES})")
def mvt_layer_order(spark, sf):
    return mvt.features(mvt.build(_tiled(spark, sf))).select("x", "y", "source_layer", "feature_index", "id")


def _rings(spark, sf) -> DataFrame:
    """Parts as polygons with a hole, in tiles of their own: an outer square and, of even keys, a hole."""
    a, s = (F.col("p_partkey") % 100 * 10).cast("double"), (F.col("p_size") * 8 + 40).cast("double")

    def square(o, n, back: bool):
        at = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)] if back else [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.array(*[F.struct((o + n * i).alias("x"), (o + n * j).alias("y")) for i, j in at])

    hole = F.when(F.col("p_partkey") % 2 == 0, F.array(F.array(square(a, s, False), square(a + 10, s - 20, True)))).otherwise(F.array(F.array(square(a, s, False))))
    return table(spark, sf, "part").select(F.lit(9).alias("z"), (F.col("p_partkey") % 37).cast("int").alias("x"), (F.col("p_partkey") % 11).cast("int").alias("y"), F.lit("parts").alias("source_layer"), F.col("p_partkey").alias("feature_index"), F.col("p_partkey").alias("id"), F.lit("Polygon").alias("geom_type"), hole.alias("geom"), F.lit("{}").alias("props_json"), "p_size")


_HOLE = "CASE WHEN p_partkey % 2 = 0 THEN (p_size * 8 + 20) * (p_size * 8 + 20) ELSE 0 END"


@query("mvt_polygons", f"SELECT p_partkey AS id, 'Polygon' AS geom_type, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::INT AS rings, 5::INT AS points, ((p_size * 8 + 40) * (p_size * 8 + 40) - {_HOLE})::DOUBLE AS area FROM part")
def mvt_polygons(spark, sf):
    rows = mvt.features(mvt.build(_rings(spark, sf)))
    rings = F.flatten("geom")
    area = F.aggregate(F.transform(rings, geometry.signed_area), F.lit(0.0), lambda a, v: a + v)
    return rows.select("id", "geom_type", F.size(rings).alias("rings"), F.size(rings[0]).alias("points"), area.alias("area"))


@query("mvt_rescaled", f"SELECT p_partkey AS id, (((p_size * 8 + 40) * 2) * ((p_size * 8 + 40) * 2) - 4 * {_HOLE})::DOUBLE AS area FROM part")
def mvt_rescaled(spark, sf):
    rings = geometry.rescaled(F.flatten("geom"), 4096, 8192)
    return _rings(spark, sf).select("id", F.aggregate(F.transform(rings, geometry.signed_area), F.lit(0.0), lambda a, v: a + v).alias("area"))


@query("mvt_lines", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::INT AS parts, (CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END * 5 * p_size)::DOUBLE AS length FROM part")
def mvt_lines(spark, sf):
    line = lambda o: F.array(F.struct(o.alias("x"), o.alias("y")), F.struct((o + 3 * F.col("p_size")).alias("x"), (o + 4 * F.col("p_size")).alias("y")))
    o = (F.col("p_partkey") % 500).cast("double")
    geom = F.when(F.col("p_partkey") % 3 == 0, F.array(F.array(line(o), line(o + 7)))).otherwise(F.array(F.array(line(o))))
    rows = _rings(spark, sf).withColumnRenamed("id", "p_partkey").select("z", "x", "y", "source_layer", "feature_index", F.col("p_partkey").alias("id"), F.lit("LineString").alias("geom_type"), geom.alias("geom"), "props_json")
    back = mvt.features(mvt.build(rows))
    lengths = F.transform(F.flatten("geom"), geometry.line_length)
    return back.select("id", F.size(lengths).alias("parts"), F.aggregate(lengths, F.lit(0.0), lambda a, v: a + v).alias("length"))


#: Values of each type of the format: field, wire bytes.
def _typed_tile(r: dict) -> list[dict]:
    n = r["s_suppkey"]
    raw = [put(1, f"t{n}"), b"\x15" + struct.pack("<f", n / 4), b"\x19" + struct.pack("<d", n / 8), put(4, n), put(5, n + 1), put(6, max(0, 2 * n - 1)), put(7, n % 2)]
    keys = b"".join(put(3, k) for k in ("text", "single", "double", "int", "uint", "sint", "flag"))
    tags = put(2, bytes(x for i in range(7) for x in (i, i)))
    body = put(1, n) + tags + put(3, 1) + put(4, bytes([9, 2, 4]))
    layer = put(15, 2) + put(1, "typed") + put(2, body) + keys + b"".join(put(4, v) for v in raw) + put(5, 512)
    broken = {0: b"", 1: put(15, 3), 2: put(5, 1)[:-1]}[n % 3] if n % 4 == 0 else b""
    return [{"z": 0, "x": n, "y": 0, "data": put(3, layer + broken)}]


def _typed(spark, sf) -> DataFrame:
    return _arrays(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("s_suppkey")), _typed_tile, "z int, x int, y int, data binary")


@query("mvt_values", "SELECT s_suppkey AS id, 512::INT AS extent, 't' || s_suppkey AS text, s_suppkey / 4.0::DOUBLE AS single, s_suppkey / 8.0::DOUBLE AS double, s_suppkey::DOUBLE AS int, (s_suppkey + 1)::DOUBLE AS uint, (-s_suppkey)::DOUBLE AS sint, s_suppkey % 2 = 1 AS flag, 1::DOUBLE AS px, 2::DOUBLE AS py FROM supplier WHERE NOT (s_suppkey % 4 = 0 AND s_suppkey % 3 > 0)")
def mvt_values(spark, sf):
    rows = mvt.features(_typed(spark, sf), on_error="drop")
    get = lambda k, t: F.try_variant_get("props", f"$.{k}", t).alias(k)
    return rows.select("id", "extent", get("text", "string"), *[get(k, "double") for k in ("single", "double", "int", "uint", "sint")], get("flag", "boolean"), _part("geom")["x"].alias("px"), _part("geom")["y"].alias("py"))


@query("mvt_broken", "SELECT s_suppkey::INT AS x, s_suppkey % 4 = 0 AND s_suppkey % 3 > 0 AS broken FROM supplier")
def mvt_broken(spark, sf):
    return mvt.features(_typed(spark, sf), on_error="keep").select("x", F.col("error").isNotNull().alias("broken"))


# -- GeoJSON


def _documents(spark, sf) -> DataFrame:
    """A FeatureCollection a market segment and nation, of its customers as points, in order of their keys."""
    f = F.struct(
        F.lit("Feature").alias("type"),
        F.col("c_custkey").alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("balance")).alias("properties"),
    )
    g = places(spark, sf).groupBy("c_mktsegment", "c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", f.alias("f")))), lambda x: x["f"]).alias("features"))
    return g.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("doc"))


@query("geojson_points", f"SELECT c_custkey AS id, (row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1)::BIGINT AS feature_index, 'Point' AS geom_type, lon, lat, c_name AS name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS balance FROM {_PLACES}")
def geojson_points(spark, sf):
    get = lambda c, t: F.try_variant_get("props", f"$.{c}", t).alias(c)
    return geojson.features(_documents(spark, sf)).select(F.try_variant_get("id", "$", "long").alias("id"), "feature_index", "geom_type", _part("geom")["x"].alias("lon"), _part("geom")["y"].alias("lat"), get("name", "string"), get("balance", "double"))


def _square_json(back: bool) -> str:
    at = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)] if back else [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return "[" + ",".join(f"[{'%1$d' if not i else '%2$d'},{'%1$d' if not j else '%2$d'}]" for i, j in at) + "]"


@query("geojson_wound", "SELECT p_partkey AS id, true AS outer_first, p_size::DOUBLE * p_size * 16 - 4 AS area FROM part")
def geojson_wound(spark, sf):
    """Polygons whose rings wind either way and of which the hole may come first."""
    n = F.col("p_size") * 4
    ring = lambda low, high, back: F.format_string(_square_json(back), low, high)
    outer, hole = ring(F.lit(0), n, False), ring(F.lit(1), F.lit(3), False)
    turned = ring(F.lit(0), n, True)
    rings = F.when(F.col("p_partkey") % 3 == 0, F.concat(outer, F.lit(","), hole)).when(F.col("p_partkey") % 3 == 1, F.concat(hole, F.lit(","), turned)).otherwise(F.concat(turned, F.lit(","), hole))
    doc = F.concat(F.format_string('{"type":"Feature","id":%d,"properties":null,"geometry":{"type":"Polygon","coordinates":[', "p_partkey"), rings, F.lit("]}}"))
    rows = geojson.features(dealt(table(spark, sf, "part").where("p_size > 0").select("p_partkey", "p_size"), "p_partkey").select(doc.alias("doc")), wind=True)
    areas = F.transform(F.flatten("geom"), geometry.signed_area)
    return rows.select(F.try_variant_get("id", "$", "long").alias("id"), (F.abs(areas[0]) > F.abs(areas[1])).alias("outer_first"), F.abs(areas[0] + areas[1]).alias("area"))


_KINDS = [
    ("Point", "[%d,2]"), ("MultiPoint", "[[%d,2],[3,4]]"), ("LineString", "[[%d,0],[3,4]]"), ("MultiLineString", "[[[%d,0],[1,1]],[[2,2],[3,3]]]"), ("Polygon", "[[[%d,0],[9,0],[9,9],[0,0]]]"),
    ("MultiPolygon", "[[[[%d,0],[9,0],[9,9],[0,0]]],[[[1,1],[2,1],[2,2],[1,1]]]]"), ("GeometryCollection", "[]"), ("Point", '["x",2]'), ("Polygon", "[[%d,0]]"), ("Nothing", "[%d]"),
]


@query("geojson_kinds", "SELECT s_suppkey AS id, ['Point', 'Point', 'LineString', 'LineString', 'Polygon', 'Polygon', NULL, NULL, NULL, NULL][s_suppkey % 10 + 1] AS geom_type, [1, 1, 1, 1, 1, 2, NULL, NULL, NULL, NULL][s_suppkey % 10 + 1]::INT AS parts, [1, 2, 2, 4, 4, 8, NULL, NULL, NULL, NULL][s_suppkey % 10 + 1]::INT AS points, s_suppkey % 10 >= 6 AS bad FROM supplier")
def geojson_kinds(spark, sf):
    """Each kind of geometry, bare or in a feature, and malformed ones, which are kept as errors."""
    k = F.col("s_suppkey") % 10
    g = F.lit(None).cast("string")
    for i, (kind, c) in enumerate(_KINDS):
        g = F.when(k == i, F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.format_string(c, "s_suppkey") if "%" in c else F.lit(c), F.lit("}"))).otherwise(g)
    doc = F.concat(F.format_string('{"type":"Feature","id":%d,"properties":{"a":1},"geometry":', "s_suppkey"), g, F.lit("}"))
    rows = geojson.features(table(spark, sf, "supplier").select(doc.alias("doc")), on_error="keep")
    good = F.col("error").isNull()
    return rows.select(F.try_variant_get("id", "$", "long").alias("id"), F.when(good, F.col("geom_type")).alias("geom_type"), F.when(good, F.size("geom")).alias("parts") if False else F.when(good, F.when(F.col("geom_type") == "Polygon", F.size("geom")).otherwise(F.lit(1))).alias("parts"), F.when(good, F.size(F.flatten(F.flatten("geom")))).alias("points"), (~good).alias("bad"))


# -- archives


def _archive(spark, sf) -> str:
    """An archive, in the shared folder, of the tiles up to zoom 5 that hold a supplier's place."""
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 5)
    rows = table(spark, sf, "supplier").select(((F.col("s_suppkey") * 37) % 360 - 180).cast("double").alias("lon"), ((F.col("s_suppkey") * 53) % 170 - 85).cast("double").alias("lat")).select(x.alias("x"), y.alias("y"))
    up = rows.select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("z"), "x", "y")
    up = up.select("z", F.call_function("shiftright", "x", 5 - F.col("z")).alias("x"), F.call_function("shiftright", "y", 5 - F.col("z")).alias("y")).distinct()
    # no more than the 1365 tiles of these zooms; an archive is one file that one writer lays out
    tiles = {(r.z, r.x, r.y): json.dumps({"zoom": r.z, "low": r.z < 3}).encode() for r in up.collect()}
    path = f"{scratch_dir(spark)}/archive-{uuid.uuid4().hex}.pmtiles"
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(own) as out:
        out.write(pmtiles.build(tiles, leaf_size=64))
    return path


_TILES = " UNION ".join(f"SELECT {z}::INT AS z, (x >> {5 - z})::INT AS x, (y >> {5 - z})::INT AS y FROM (SELECT {_tile_sql(5)[0]} AS x, {_tile_sql(5)[1]} AS y FROM (SELECT ((s_suppkey * 37) % 360 - 180)::DOUBLE AS lon, ((s_suppkey * 53) % 170 - 85)::DOUBLE AS lat FROM supplier))" for z in range(6))


@query("pmtiles_scan", f"SELECT z, x, y, '{{\"zoom\": ' || z || ', \"low\": ' || CASE WHEN z < 3 THEN 'true' ELSE 'false' END || '}}' AS text FROM ({_TILES})")
def pmtiles_scan(spark, sf):
    return pmtiles.scan(spark, _archive(spark, sf)).select("z", "x", "y", F.col("data").cast("string").alias("text"))


@query("pmtiles_box", f"SELECT z, x, y FROM ({_TILES}) WHERE z = 5 AND x >= 8 AND x < 20 AND y = 17 OR z = 4 AND x = 3")
def pmtiles_box(spark, sf):
    """Two boxes of one archive; directories of other tiles aren't read."""
    path = _archive(spark, sf)
    return pmtiles.scan(spark, path, (5, 5), (8, 19), (17, 17)).select("z", "x", "y").unionByName(pmtiles.scan(spark, path, (4, 4), (3, 3)).select("z", "x", "y"))


@query("pmtiles_tile_ids", "SELECT z::INT AS z, count(*) AS tiles, min(id)::BIGINT AS first, max(id)::BIGINT AS last, count(DISTINCT id) AS distinct_ids FROM (SELECT z, ((1 << (2 * z)) - 1) // 3 + i AS id FROM (SELECT unnest(range(0, 5)) AS z), LATERAL (SELECT unnest(range(0, 1 << (2 * z))) AS i)) GROUP BY z")
def pmtiles_tile_ids(spark, sf):
    """All tiles of the first zooms: numbers along the curve have neither gaps nor repeats."""
    z = spark.range(5).select(F.col("id").cast("int").alias("z"))
    side = F.call_function("shiftleft", F.lit(1), F.col("z")) - 1
    t = z.withColumn("x", F.explode(F.sequence(F.lit(0), side))).withColumn("y", F.explode(F.sequence(F.lit(0), side)))
    t = t.withColumn("id", projection.tile_id(F.col("z"), F.col("x"), F.col("y")))
    return t.groupBy("z").agg(F.count("*").alias("tiles"), F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("id").alias("distinct_ids"))


# -- urls

_SET = {"tiles": ["https://a/{z}/{x}/{y}.mvt", "https://b/{z}/{x}/{y}.mvt", "https://c/{z}/{x}/{y}.mvt"], "minzoom": 2, "maxzoom": 9, "scheme": "tms"}


@query("tilejson_urls", f"SELECT c_custkey, 'https://' || ['a', 'b', 'c'][(x + y) % 3 + 1] || '/9/' || x || '/' || (511 - y) || '.mvt' AS url FROM (SELECT c_custkey, {_tile_sql(9)[0]} AS x, {_tile_sql(9)[1]} AS y FROM {_PLACES})")
def tilejson_urls(spark, sf):
    """Places to the urls of their tiles, by a tile set's templates, zooms and scheme."""
    s = urls.tile_set(_SET)
    x, y = F.col("x"), F.col("y")
    each = F.array(*[urls.expand(t, s["maxzoom"], x, y, s["scheme"]) for t in s["tiles"]])
    return tile_assign(spark, sf).select("c_custkey", F.element_at(each, F.pmod(x + y, F.lit(len(s["tiles"]))) + 1).alias("url"))


@query("url_tokens", f"SELECT c_custkey, printf('%x%x', x % 16, y % 16) || '/@2x/' || x || '{{other}}' AS url FROM (SELECT c_custkey, {_tile_sql(9)[0]} AS x, {_tile_sql(9)[1]} AS y FROM {_PLACES})")
def url_tokens(spark, sf):
    return tile_assign(spark, sf).select("c_custkey", urls.expand("{prefix}/{ratio}/{x}{other}", 9, F.col("x"), F.col("y"), ratio=2.0).alias("url"))


@query("percent_encoded", "SELECT p_partkey, regexp_replace(url_encode(p_type), '%20', '%20', 'g') AS kind, url_encode('é ' || p_brand) = replace(replace(encoded, '%c3', '%C3'), '%a9', '%A9') AS same FROM (SELECT p_partkey, p_type, p_brand, '%c3%a9%20' || replace(replace(p_brand, '#', '%23'), ' ', '%20') AS encoded FROM part)")
def percent_encoded(spark, sf):
    own = urls.percent_encoded(F.concat(F.lit("é "), F.col("p_brand")))
    plain = F.concat(F.lit("%c3%a9%20"), F.replace(F.replace(F.col("p_brand"), F.lit("#"), F.lit("%23")), F.lit(" "), F.lit("%20")))
    return table(spark, sf, "part").select("p_partkey", urls.percent_encoded(F.col("p_type")).alias("kind"), (own == plain).alias("same"))


@query("canonical_urls", "SELECT page_id, h || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM (SELECT page_id, split_part(u, '?', 1) AS h, list_filter(string_split(CASE WHEN strpos(u, '?') > 0 THEN substring(u, strpos(u, '?') + 1) ELSE '' END, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('access_token', 'key', 'api_key')) AS kept FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '?access_token=a' || page_id || '&b=1&&key=2' WHEN page_id % 3 = 1 THEN '?keys=1&api_key' ELSE '' END AS u FROM pages))")
def canonical_urls(spark, sf):
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("?access_token=a"), F.col("page_id").cast("string"), F.lit("&b=1&&key=2"))).when(F.col("page_id") % 3 == 1, F.lit("?keys=1&api_key")).otherwise(F.lit(""))
    return table(spark, sf, "pages").select("page_id", urls.canonical_column(F.concat("url", more)).alias("url"))


@query("routed_urls", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'tls' WHEN contains(url, '/en/') THEN 'english' ELSE 'other' END AS route FROM pages WHERE url IS NOT NULL")
def routed_urls(spark, sf):
    """The first route whose test takes a url."""
    route = urls.Router([(lambda u: u.startswith("https://"), "tls"), (lambda u: u.contains("/en/"), "english")], "other")
    return table(spark, sf, "pages").where("url is not null").select("page_id", route.column(F.col("url")).alias("route"))


# -- images and elevations


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """RGBA as a PNG whose lines are stored as differences to the pixel before (filter 1)."""
    lines = b""
    for y in range(height):
        row = rgba[y * width * 4 : (y + 1) * width * 4]
        lines += b"\x01" + bytes((v - (row[i - 4] if i >= 4 else 0)) & 255 for i, v in enumerate(row))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def _pictured(r: dict) -> list[dict]:
    n = r["n"]
    return [{"n": n, "data": png(4, 3, bytes((n * (c + 1) + x * 5 + y * 11) % 256 for y in range(3) for x in range(4) for c in range(4)))}]


def _pixels(r: dict) -> list[dict]:
    width, height, raw = dem.read_png(r["data"])
    return [{"n": r["n"], "px": i % width, "py": i // width, **dict(zip("rgba", raw[4 * i : 4 * i + 4]))} for i in range(width * height)]


def _images(spark, sf) -> DataFrame:
    made = _arrays(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("n")), _pictured, "n int, data binary")
    return _arrays(made, _pixels, "n int, px int, py int, r int, g int, b int, a int")


_CHANNELS = ", ".join(f"((s_suppkey * {c + 1} + px * 5 + py * 11) % 256)::INT AS {n}" for c, n in enumerate("rgba"))
_PIXELS = f"(SELECT s_suppkey::INT AS n, px::INT AS px, py::INT AS py, {_CHANNELS} FROM supplier, (SELECT unnest(range(4)) AS px), (SELECT unnest(range(3)) AS py))"


@query("png_pixels", f"SELECT * FROM {_PIXELS}")
def png_pixels(spark, sf):
    return _images(spark, sf)


@query("png_premultiplied", f"SELECT n, px, py, ((r * a + 127) // 255)::INT AS r, ((g * a + 127) // 255)::INT AS g, ((b * a + 127) // 255)::INT AS b FROM {_PIXELS}")
def png_premultiplied(spark, sf):
    r, g, b = dem.premultiplied(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    return _images(spark, sf).select("n", "px", "py", r.alias("r"), g.alias("g"), b.alias("b"))


@query("dem_scan", f"SELECT n, px, py, round(r * 6553.6 + g * 25.6 + b * 0.1 - 10000, 4) AS metres, round(r * 256.0 + g + b / 256.0 - 32768, 4)::DOUBLE AS terrarium FROM {_PIXELS}")
def dem_scan(spark, sf):
    h = lambda e: F.round(dem.elevation(F.col("r"), F.col("g"), F.col("b"), e), 4)
    # a height is a whole number of tenths, which SQL's literals make a decimal
    return _images(spark, sf).select("n", "px", "py", h("mapbox").cast("decimal(18,1)").alias("metres"), h("terrarium").alias("terrarium"))


def _ground(spark) -> DataFrame:
    """Elevation tiles of zoom 2, four pixels wide, without the one at (1, 1): a height for each pixel of the world."""
    side = spark.range(16).select(F.col("id").cast("int").alias("i"))
    g = side.select(F.col("i").alias("gx")).hint("broadcast").crossJoin(side.select(F.col("i").alias("gy")))
    h = (F.col("gx") * F.col("gx") * 3 + F.col("gy") * 10 + F.col("gx") * F.col("gy")).cast("double")
    t = g.select(F.lit(2).alias("z"), F.floor(F.col("gx") / 4).cast("int").alias("x"), F.floor(F.col("gy") / 4).cast("int").alias("y"), (F.col("gx") % 4).alias("px"), (F.col("gy") % 4).alias("py"), h.alias("h"))
    return t.where("not (x = 1 and y = 1)")


_H = "(gx * gx * 3 + gy * 10 + gx * gy)::DOUBLE"
_GROUND = f"(SELECT gx, gy, {_H} AS h FROM (SELECT unnest(range(16)) AS gx), (SELECT unnest(range(16)) AS gy) WHERE NOT (gx // 4 = 1 AND gy // 4 = 1))"
#: Each pixel of a bordered tile: the world's pixel there, wrapped east and west, or the tile's own nearest one.
_BORDERED = f"""(SELECT t.x, t.y, b.px, c.py, coalesce(g.h, o.h) AS h FROM (SELECT DISTINCT gx // 4 AS x, gy // 4 AS y FROM {_GROUND}) t, (SELECT unnest(range(-1, 5)) AS px) b, (SELECT unnest(range(-1, 5)) AS py) c
  LEFT JOIN {_GROUND} g ON g.gx = (t.x * 4 + b.px + 16) % 16 AND g.gy = t.y * 4 + c.py
  JOIN {_GROUND} o ON o.gx = t.x * 4 + greatest(0, least(3, b.px)) AND o.gy = t.y * 4 + greatest(0, least(3, c.py)))"""


@query("dem_bordered", f"SELECT 2::INT AS z, x::INT AS x, y::INT AS y, px::INT AS px, py::INT AS py, h FROM {_BORDERED}")
def dem_bordered(spark, sf):
    return dem.bordered(_ground(spark), 4)


@query("dem_slopes", f"""WITH b AS {_BORDERED}, s AS (SELECT *, lag(h) OVER r AS w, lead(h) OVER r AS e FROM b WINDOW r AS (PARTITION BY x, y, py ORDER BY px)),
  t AS (SELECT *, w + 2 * h + e AS a, e - w AS c FROM s), u AS (SELECT *, lead(a) OVER k - lag(a) OVER k AS dy, lag(c) OVER k + 2 * c + lead(c) OVER k AS dx FROM t WINDOW k AS (PARTITION BY x, y, px ORDER BY py))
  SELECT x::INT AS x, y::INT AS y, px::INT AS px, py::INT AS py, dx / 80 AS dzdx, dy / 80 AS dzdy FROM u WHERE dx IS NOT NULL AND dy IS NOT NULL""")
def dem_slopes(spark, sf):
    return dem.slopes(dem.bordered(_ground(spark), 4), 10.0).select("x", "y", "px", "py", "dzdx", "dzdy")


@query("dem_sampled", f"""WITH b AS {_BORDERED}, p AS (SELECT s_suppkey, (s_suppkey % 4)::INT AS x, (s_suppkey % 3)::INT AS y, (s_suppkey % 9) / 2.0 - 0.5 AS u, (s_suppkey % 7) / 2.0 - 0.5 AS v FROM supplier)
  SELECT s_suppkey, CASE WHEN count(b.h) = 4 THEN round(sum(b.h * (1 - abs(u - b.px)) * (1 - abs(v - b.py))), 6) END::DOUBLE AS h FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)
  LEFT JOIN b ON b.x = p.x AND b.y = p.y AND b.px = floor(u) + i AND b.py = floor(v) + j GROUP BY s_suppkey""")
def dem_sampled(spark, sf):
    n = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select("s_suppkey", F.lit(2).alias("z"), (n % 4).cast("int").alias("x"), (n % 3).cast("int").alias("y"), ((n % 9) / 2 - 0.5).alias("u"), ((n % 7) / 2 - 0.5).alias("v"))
    return dem.sampled(p, dem.bordered(_ground(spark), 4)).select("s_suppkey", F.round("h", 6).alias("h"))


_CELLS = "(SELECT 0 AS level, cx, cy, low, high FROM (SELECT (c_custkey % 64)::INT AS cx, (c_nationkey % 32)::INT AS cy, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1, 2))"


def _cells(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").groupBy((F.col("c_custkey") % 64).cast("int").alias("cx"), (F.col("c_nationkey") % 32).cast("int").alias("cy")).agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("dem_box_range", f"SELECT min(low) AS low, max(high) AS high FROM {_CELLS} WHERE (cx >> 3) BETWEEN (5 >> 3) AND (14 >> 3) AND (cy >> 3) BETWEEN (3 >> 3) AND (9 >> 3)")
def dem_box_range(spark, sf):
    """The box (5, 3) to (14, 9) spans two cells an axis at most from level 3 on."""
    return dem.range_over_box(dem.pyramid(_cells(spark, sf), 6), 5, 3, 14, 9)


@query("dem_coarsest", f"WITH c AS {_CELLS}, w AS ({' UNION ALL '.join(f'SELECT {k}::INT AS level, max(high - low) AS worst FROM (SELECT min(low) AS low, max(high) AS high FROM c GROUP BY cx >> {k}, cy >> {k})' for k in range(7))}) SELECT max(level)::INT AS level, max_by(worst, level) AS worst FROM w WHERE worst <= 10500")
def dem_coarsest(spark, sf):
    return dem.coarsest_within(dem.pyramid(_cells(spark, sf), 6), 10500.0)


@query("elevation_at_places", """WITH g AS (SELECT s_suppkey, ((s_suppkey * 37) % 360 - 180)::DOUBLE AS lon FROM supplier)
  SELECT s_suppkey, CASE WHEN x = 1 THEN NULL ELSE round(a * (1 - t) + b * t, 6) END::DOUBLE AS h FROM (SELECT s_suppkey, x, u - floor(u) AS t,
    greatest(0, least(3, floor(u))) * 100 + x AS a, greatest(0, least(3, floor(u) + 1)) * 100 + x AS b FROM (SELECT s_suppkey, least(3, floor((180 + lon) / 90))::INT AS x, ((180 + lon) / 90 - least(3, floor((180 + lon) / 90))) * 4 - 0.5 AS u FROM g))""")
def elevation_at_places(spark, sf):
    """Places along the equator over tiles whose heights rise from west to east, each clamped to itself."""
    t = spark.range(96).select(F.lit(2).alias("z"), F.floor(F.col("id") / 24).cast("int").alias("x"), F.explode(F.array(F.lit(1), F.lit(2))).alias("y"), (F.col("id") % 6 - 1).cast("int").alias("px"), (F.floor(F.col("id") / 6) % 4).cast("int").alias("py"))
    t = t.withColumn("py", F.explode(F.when(F.col("py") == 0, F.array(F.lit(-1), F.lit(0))).when(F.col("py") == 3, F.array(F.lit(3), F.lit(4))).otherwise(F.array("py")))).where("x <> 1")
    t = t.withColumn("h", (F.greatest(F.lit(0), F.least(F.lit(3), "px")) * 100 + F.col("x")).cast("double"))
    p = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 360 - 180).cast("double").alias("lon"), F.lit(1e-9).alias("lat"))
    return dem.elevations(p, t, 2, 4).select("s_suppkey", F.round("h", 6).alias("h"))


# -- sheets, glyphs, annotations


@query("sprite_index", "SELECT p_brand AS sheet, 'icon-' || p_partkey AS name, p_size::INT AS width, (p_size + 1)::INT AS height, (p_partkey % 3)::DOUBLE AS pixel_ratio, p_partkey % 2 = 0 AS sdf FROM part WHERE p_partkey % 3 > 0 AND (p_partkey % 200) + p_size <= 210")
def sprite_index(spark, sf):
    """An index a brand; images of ratio 0, and those that don't lie on the sheet, are left out."""
    entry = F.struct((F.col("p_partkey") % 200).cast("int").alias("x"), F.lit(0).alias("y"), F.col("p_size").alias("width"), (F.col("p_size") + 1).alias("height"), (F.col("p_partkey") % 3).cast("double").alias("pixelRatio"), (F.col("p_partkey") % 2 == 0).alias("sdf"))
    docs = table(spark, sf, "part").groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("icon-"), F.col("p_partkey").cast("string")), entry)))).alias("doc"))
    found = None
    rows = sheets.sprites(docs, 210, 1024)
    brand = table(spark, sf, "part").select(F.concat(F.lit("icon-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("sheet"))
    return rows.join(brand, "name").select("sheet", "name", "width", "height", "pixel_ratio", "sdf")


def _glyph_file(r: dict) -> list[dict]:
    n = r["n"]
    glyph = lambda c: put(1, c) + put(2, bytes((n + c) % 256 for _ in range((c % 3 + 6) * 8))) + put(3, c % 3) + put(4, 2) + put(5, 2 * c) + put(6, 2 * n - 1) + put(7, c + n)
    glyph0 = lambda c: put(1, c) + put(3, 0) + put(4, 0) + put(7, c)
    stack = put(1, f"font {n}") + put(2, "0-255") + b"".join(put(3, glyph(c) if c % 3 else glyph0(c)) for c in range(60, 66))
    return [{"data": put(1, stack)}]


@query("glyph_scan", "SELECT 'font ' || n_nationkey AS stack, '0-255' AS range, c::INT AS id, CASE WHEN c % 3 > 0 THEN c % 3 ELSE 0 END::INT AS width, CASE WHEN c % 3 > 0 THEN c ELSE 0 END::INT AS left_, CASE WHEN c % 3 > 0 THEN -n_nationkey ELSE 0 END::INT AS top_, CASE WHEN c % 3 > 0 THEN c + n_nationkey ELSE c END::INT AS advance, CASE WHEN c % 3 > 0 THEN (c % 3 + 6) * 8 ELSE 0 END::INT AS pixels FROM nation, (SELECT unnest(range(60, 66)) AS c) WHERE n_nationkey > 0")
def glyph_scan(spark, sf):
    files = _arrays(table(spark, sf, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("int").alias("n")), _glyph_file, "data binary")
    g = sheets.glyphs(files)
    return g.select("stack", "range", "id", "width", F.col("left").alias("left_"), F.col("top").alias("top_"), "advance", F.coalesce(F.octet_length("bitmap"), F.lit(0)).alias("pixels"))


def _symbols(spark, sf) -> DataFrame:
    return places(spark, sf).where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), "lon", "lat", F.col("c_mktsegment").alias("icon"))


@query("annotations_kept", f"""WITH a AS (SELECT c_custkey AS id, lon, lat, c_mktsegment AS icon FROM {_PLACES} WHERE c_custkey % 3 = 0), t AS (SELECT max(id) AS top FROM a),
  n AS (SELECT top + row_number() OVER (ORDER BY c_custkey) AS id, lon, lat, 'new' AS icon FROM {_PLACES}, t WHERE c_custkey % 3 = 1 AND c_custkey < 200)
  SELECT id, lon, lat, CASE WHEN id % 2 = 0 AND id < 300 THEN 'moved' ELSE icon END AS icon FROM (SELECT * FROM a UNION ALL SELECT * FROM n) WHERE id % 9 <> 0""")
def annotations_kept(spark, sf):
    """Annotations added, changed and removed; a change of one that isn't there does nothing."""
    new = places(spark, sf).where("c_custkey % 3 = 1 and c_custkey < 200").select("lon", "lat", F.lit("new").alias("icon"), F.col("c_custkey").alias("ord"))
    a = annotations.added(_symbols(spark, sf), new)
    moved = a.where("id % 2 = 0 and id < 300").withColumn("icon", F.lit("moved"))
    absent = moved.limit(1).withColumn("id", F.lit(-5).cast("long"))
    a = annotations.updated(a, moved.unionByName(absent))
    return annotations.removed(a, a.where("id % 9 = 0").select("id").unionByName(absent.select("id")))


@query("annotation_tile", f"""SELECT c_custkey AS id, round((u - 1) * 8192)::INT AS tile_x, round((v - 1) * 8192)::INT AS tile_y FROM (SELECT c_custkey, (180 + lon) * (4.0 / 360) AS u,
  (180 - ln(tan(pi() / 4 + greatest(-{projection.LATITUDE_MAX!r}, least({projection.LATITUDE_MAX!r}, lat)) * pi() / 360)) * 180 / pi()) * (4.0 / 360) AS v FROM {_PLACES} WHERE c_custkey % 3 = 0) WHERE u >= 0.9 AND u < 2.1 AND v >= 0.9 AND v < 2.1""")
def annotation_tile(spark, sf):
    return annotations.tile_symbols(_symbols(spark, sf), 2, 1, 1, 0.1).select("id", "tile_x", "tile_y")


@query("annotations_from_geojson", f"SELECT lon, lat, 'default_marker' AS icon FROM {_PLACES}")
def annotations_from_geojson(spark, sf):
    symbols, _ = annotations.from_features(geojson.features(_documents(spark, sf)))
    return symbols.select("lon", "lat", "icon")
