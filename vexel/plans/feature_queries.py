"""Registered queries over features: filters on their parts, properties of layers, expressions that read the feature and
the camera, and where features lie."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import result_column
from ..lang import color
from ..lang.compiler import Compiler, compile_expression
from ..lang.filters import admitted
from ..operators import catalog, labels, ordered, tiles
from ..spatial import contain, cover, geometry, joins, projection
from ..streaming import state
from . import extras
from .document import Plan, Style, feature_fields, label_template, replaced
from .properties import SPECS, at_two_zooms, resolve
from .ramps import elevation_stops
from .registry import query
from .tables import _PLACES, _tile_sql, dealt, places, table


def _features(spark, sf) -> DataFrame:
    """Customers as canonical features: an id, a kind, a geometry, properties as VARIANT, and a state of some."""
    n = F.col("c_custkey")
    p = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    q = F.struct((F.col("lon") + 4).alias("x"), F.col("lat").alias("y"))
    kind = F.element_at(F.array(F.lit("Point"), F.lit("LineString"), F.lit("Polygon")), (n % 3 + 1).cast("int"))
    geom = F.when(n % 3 == 0, F.array(F.array(F.array(p)))).otherwise(F.array(F.array(F.array(p, q))))
    props = F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.when(n % 4 > 0, F.col("c_mktsegment")).alias("segment"), F.array(n, n + 1).alias("pair"), (n % 2 == 0).alias("even"), F.struct(n.alias("a"), F.lit("x").alias("b")).alias("inner"))
    hover = F.when(n % 5 == 0, F.parse_json(F.to_json(F.struct((n % 10 == 0).alias("hover"), n.alias("weight")))))
    return places(spark, sf).select(n.alias("feature_index"), n.alias("id"), kind.alias("geom_type"), geom.alias("geom"), F.parse_json(F.to_json(props)).alias("props"), hover.alias("state"), "c_custkey", "lon", "lat")


_FEATURES = f"(SELECT *, ['Point', 'LineString', 'Polygon'][c_custkey % 3 + 1] AS kind, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM {_PLACES})"


def _canonical(spark, sf, **parts):
    df = _features(spark, sf)
    fields = feature_fields(df.drop("c_custkey", "lon", "lat"))
    for name, value in parts.items():
        setattr(fields, name, value)
    return df, fields


# -- filters


def _parts(name: str, f, where: str):
    @query(name, f"SELECT c_custkey FROM {_FEATURES} WHERE {where}")
    def run(spark, sf):
        df, fields = _canonical(spark, sf)
        return admitted(df, f, fields).select("c_custkey")


_parts("filter_type_and_id", ["all", ["in", "$type", "Point", "Polygon"], [">=", "$id", 20], ["has", "$id"], ["has", "$type"]], "kind IN ('Point', 'Polygon') AND c_custkey >= 20")
_parts("filter_dialect_legacy", ["any", ["!has", "segment"], ["==", "segment", "BUILDING"]], "segment IS NULL OR segment = 'BUILDING'")
_parts("filter_dialect_expression", ["any", ["!", ["has", "segment"]], ["==", ["get", "segment"], "BUILDING"], ["==", ["geometry-type"], "Polygon"]], "segment IS NULL OR segment = 'BUILDING' OR kind = 'Polygon'")
_parts("filter_empty", ["all", ["all"], ["none"], ["!", ["any", False]]], "true")
_parts("filter_none_given", None, "true")
_parts("filter_errors_reject", [">", ["number", ["get", "segment"]], 0], "false")


@query("layer_zooms", "SELECT n_nationkey AS layer, z::INT AS z, floor(n_nationkey / 2.0) <= z AND z < ceil(n_nationkey / 2.0 + 3.25) AS built, n_nationkey / 2.0 <= z + 0.5 AND z + 0.5 <= n_nationkey / 2.0 + 3.25 AS shown FROM nation, (SELECT unnest(range(16)) AS z)")
def layer_zooms(spark, sf):
    """At which zooms a tile holds a layer, and a view shows it. A style's layers are few; each is a row a zoom."""
    keys = [r.n_nationkey for r in table(spark, sf, "nation").select("n_nationkey").collect()]
    style = Style.parse({"version": 8, "layers": [{"id": str(k), "type": "circle", "source": "s", "minzoom": k / 2, "maxzoom": k / 2 + 3.25} for k in keys]})
    return spark.createDataFrame([(int(x.id), z, x.built_at(z), x.shown_at(z + 0.5)) for x in style.layers for z in range(16)], "layer int, z int, built boolean, shown boolean")


@query("layer_source_layers", f"SELECT 'buildings' AS layer, c_custkey FROM {_FEATURES} WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'rest', c_custkey FROM {_FEATURES} WHERE c_mktsegment = 'MACHINERY' AND kind = 'Point'")
def layer_source_layers(spark, sf):
    """Each layer draws its own source layer of one source."""
    df = _features(spark, sf).join(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("source_layer")), "c_custkey").drop("lon", "lat")
    style = Style.parse({"version": 8, "sources": {"s": {}}, "layers": [{"id": "buildings", "type": "circle", "source": "s", "source-layer": "BUILDING"}, {"id": "rest", "type": "circle", "source": "s", "source-layer": "MACHINERY", "filter": ["==", "$type", "Point"]}]})
    plan = Plan(style, {"s": df}, 3.0)
    rows = [plan.layer(n).select(F.lit(n).alias("layer"), "c_custkey") for n in ("buildings", "rest")]
    return rows[0].unionByName(rows[1])


@query("world_copies_reached", f"SELECT c_custkey, w::INT AS wrap FROM {_PLACES}, (SELECT unnest([-1, 0, 1]) AS w) WHERE lon <= w * 360 + 90 + 90.0 / 8192 * 128 AND lon + 300 >= w * 360 - 90.0 / 8192 * 128")
def world_copies_reached(spark, sf):
    """Features 300 degrees wide against the tile (2, 2) of each copy of the world, which begins at 0 degrees."""
    p = places(spark, sf)
    found = [p.where(joins.reaches(F.col("lon"), F.col("lon") + 300, 2, 2, w)).select("c_custkey", F.lit(w).alias("wrap")) for w in (-1, 0, 1)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("fetch_zooms", "SELECT p_partkey, CASE WHEN p_size >= 5 THEN least(p_size, 14) END::INT AS z FROM part")
def fetch_zooms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", projection.fetch_zoom(F.col("p_size"), 5, 14).cast("int").alias("z"))


# -- properties


@query("properties_resolved", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 5.0 ELSE 3.0 END::DOUBLE AS radius, CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS red, 1.0::DOUBLE AS opacity, 'map' AS pitch_scale, 4.5::DOUBLE AS stroke FROM customer")
def properties_resolved(spark, sf):
    """Written, computed and default properties of a layer; an expression that fails gives the default."""
    df, fields = _canonical(spark, sf, zoom=4.0)
    written = {"circle-radius": ["case", ["has", "segment"], 3, ["number", ["get", "segment"], ["get", "absent"]]], "circle-color": ["case", [">", ["get", "balance"], 0], "red", "blue"], "circle-stroke-width": ["interpolate", ["linear"], ["zoom"], 3, 4, 5, 5]}
    own = {n: resolve(SPECS["circle", "paint"][n], written.get(n), fields).column() for n in ("circle-radius", "circle-color", "circle-opacity", "circle-pitch-scale", "circle-stroke-width")}
    return df.select("c_custkey", own["circle-radius"].alias("radius"), own["circle-color"]["r"].alias("red"), own["circle-opacity"].alias("opacity"), own["circle-pitch-scale"].alias("pitch_scale"), own["circle-stroke-width"].alias("stroke"))


@query("property_bindings", "SELECT * FROM (VALUES ('circle-blur', 'constant'), ('circle-color', 'feature'), ('circle-opacity', 'zoom'), ('circle-radius', 'composite'), ('circle-stroke-color', 'feature'), ('circle-translate', 'refused')) v(name, binding)")
def property_bindings(spark, sf):
    """What each property's value depends on; one that can't depend on the feature refuses to."""
    _, fields = _canonical(spark, sf, zoom=4.0)
    written = {"circle-color": ["get", "segment"], "circle-opacity": ["step", ["zoom"], 0, 3, 1], "circle-radius": ["interpolate", ["linear"], ["zoom"], 0, ["get", "balance"], 9, 2], "circle-stroke-color": ["case", ["boolean", ["feature-state", "hover"], False], "red", "blue"], "circle-translate": ["get", "pair"]}
    rows = []
    for n in ("circle-blur", "circle-color", "circle-opacity", "circle-radius", "circle-stroke-color", "circle-translate"):
        try:
            rows.append((n, resolve(SPECS["circle", "paint"][n], written.get(n), fields).binding))
        except ValueError:
            rows.append((n, "refused"))
    return spark.createDataFrame(rows, "name string, binding string")


@query("property_two_zooms", "SELECT c_custkey, c_acctbal * 0.5 + 1.0 AS low, c_acctbal * 0.25 + 1.5 AS high FROM customer")
def property_two_zooms(spark, sf):
    df, fields = _canonical(spark, sf)
    x = ["interpolate", ["linear"], ["zoom"], 4, ["get", "balance"], 8, 2]

    def at(step: int):
        own = feature_fields(df.drop("c_custkey", "lon", "lat"))
        own.zoom = 6.0 + step
        return own

    low, high = at_two_zooms(SPECS["circle", "paint"]["circle-radius"], x, at)
    return df.select("c_custkey", low.alias("low"), high.alias("high"))


@query("label_sizes", "SELECT c_custkey, CASE WHEN kind = 'Point' THEN 8.0 * 2 ELSE 10.0 END::DOUBLE AS low, CASE WHEN kind = 'Point' THEN 10.0 * 2 ELSE 10.0 END::DOUBLE AS high, 16.0::DOUBLE AS plain FROM " + _FEATURES)
def label_sizes(spark, sf):
    """Sizes at the integer zooms around 4.5; an error gives the default."""
    df, fields = _canonical(spark, sf)

    def at(z: float):
        own = feature_fields(df.drop("c_custkey", "lon", "lat"))
        own.zoom = z
        return own

    low, high = extras.size_range(["case", ["==", ["geometry-type"], "Point"], ["*", 2, ["interpolate", ["linear"], ["zoom"], 0, 0, 10, 20]], 10], at, 4.5, 12)
    plain, _ = extras.size_range(["number", ["get", "segment"], 16], at, 4.5, 16)
    return df.select("c_custkey", low.alias("low"), high.alias("high"), plain.alias("plain"))


@query("config_substituted", "SELECT c_custkey, c_acctbal * 3 AS radius FROM customer WHERE c_custkey % 2 = 0")
def config_substituted(spark, sf):
    """Options of a style's schema, one of them overridden, stand in filters and properties before these are compiled."""
    style = Style.parse(
        {"version": 8, "schema": {"even": {"default": False}, "times": {"default": 3}}, "sources": {"s": {}},
         "layers": [{"id": "c", "type": "circle", "source": "s", "filter": ["==", ["get", "even"], ["config", "even"]], "paint": {"circle-radius": ["*", ["get", "balance"], ["config", "times"]]}}]},
        {"even": True},
    )
    return Plan(style, {"s": _features(spark, sf).drop("lon", "lat")}, 3.0).layer("c").select("c_custkey", F.col("circle-radius").alias("radius"))


@query("relief_ramp", "SELECT * FROM (VALUES (0::BIGINT, -100.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (1, 0.0, 0.0, 0.0), (2, 1500.5, 1.0, 0.0)) v(stop, elevation, red, blue)")
def relief_ramp(spark, sf):
    stops = [(a, color.parse(c)) for a, c in elevation_stops(["interpolate", ["linear"], ["elevation"], -100, "blue", 0, "black", 1500.5, "#f00"])]
    return spark.createDataFrame([(i, a, float(c[0]), float(c[2])) for i, (a, c) in enumerate(stops)], "stop long, elevation double, red double, blue double")


@query("label_transformed", "SELECT c_custkey, upper(c_name) || ': ' || coalesce(segment, '') AS upper, lower(c_mktsegment) AS lower FROM " + _FEATURES)
def label_transformed(spark, sf):
    """Label texts by a template, with the layer's text-transform."""
    df, fields = _canonical(spark, sf)
    text = extras.transformed(label_template("{name}: {segment}", fields), F.lit("uppercase"))
    names = table(spark, sf, "customer").select("c_custkey", extras.transformed(F.col("c_mktsegment"), F.lit("lowercase")).alias("lower"))
    return df.select("c_custkey", text.alias("upper")).join(names, "c_custkey")


@query("label_sections", f"SELECT c_custkey, 1::INT AS section, c_name AS text, 0.8::DOUBLE AS scale, 'Bold' AS font FROM {_FEATURES} UNION ALL SELECT c_custkey, 2, chr(10) || coalesce(segment, ''), NULL, NULL FROM {_FEATURES}")
def label_sections(spark, sf):
    """A formatted label's sections, each with its own scale and font."""
    df, fields = _canonical(spark, sf)
    v = compile_expression(["format", ["get", "name"], {"font-scale": 0.8, "text-font": ["literal", ["Bold", "Regular"]]}, ["concat", "\n", ["coalesce", ["get", "segment"], ""]]], fields)
    rows = df.select("c_custkey", F.posexplode(v.col).alias("section", "s"))
    return rows.select("c_custkey", (F.col("section") + 1).alias("section"), "s.text", F.col("s.scale").alias("scale"), F.col("s.font")[0].alias("font"))


@query("label_fonts_and_icons", "SELECT c_custkey, CASE WHEN kind = 'Point' THEN 'Bold,Regular' ELSE 'Regular' END AS fonts, 'icon-' || lower(segment) AS icon FROM " + _FEATURES)
def label_fonts_and_icons(spark, sf):
    """Font stacks and icon names by feature; a name that can't be made is null."""
    df, fields = _canonical(spark, sf)
    fonts = compile_expression(["case", ["==", ["geometry-type"], "Point"], ["literal", ["Bold", "Regular"]], ["literal", ["Regular"]]], fields)
    icon = compile_expression(["concat", "icon-", ["downcase", ["string", ["get", "segment"]]]], fields)
    return df.select("c_custkey", F.array_join(fonts.col, ",").alias("fonts"), result_column(icon).alias("icon"))


# -- expressions that read the feature and the camera


def _read(name: str, expressions: dict, sql: dict[str, str], **parts):
    @query(name, f"SELECT c_custkey, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM {_FEATURES}")
    def run(spark, sf):
        df, fields = _canonical(spark, sf, **parts)
        return df.select("c_custkey", *[result_column(compile_expression(x, fields)).alias(n) for n, x in expressions.items()])


_read("expr_id", {"v": ["to-number", ["id"]], "t": ["typeof", ["id"]]}, {"v": "c_custkey::DOUBLE", "t": "'number'"})
_read("expr_geometry_type", {"v": ["geometry-type"], "n": ["match", ["geometry-type"], "Point", 0, ["LineString", "Polygon"], 2, -1]}, {"v": "kind", "n": "CASE WHEN kind = 'Point' THEN 0 ELSE 2 END::DOUBLE"})
_read("expr_feature_state", {"hover": ["boolean", ["feature-state", "hover"], False], "weight": ["number", ["feature-state", "weight"], -1]}, {"hover": "c_custkey % 10 = 0", "weight": "CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE -1 END::DOUBLE"})
_read("expr_camera", {"pitch": ["+", ["pitch"], ["zoom"]], "far": [">", ["distance-from-center"], 0.5]}, {"pitch": "52.5::DOUBLE", "far": "false"}, pitch=45.0, zoom=7.5, distance_from_center=0.25)
_read("expr_properties", {"n": ["to-string", ["get", "name", ["properties"]]], "has": ["has", "segment", ["properties"]], "in": ["get", "a", ["object", ["get", "inner"]]]}, {"n": "c_name", "has": "segment IS NOT NULL", '"in"': "c_custkey::VARCHAR"})
_read("expr_error", {"v": ["case", ["has", "segment"], ["to-string", ["get", "segment"]], ["error", "no segment"]], "w": ["coalesce", ["get", "absent"], ["to-string", ["get", "name"]]]}, {"v": "segment", "w": "'\"' || c_name || '\"'"})
_read("expr_assertions", {"s": ["string", ["get", "balance"], ["get", "name"]], "n": ["number", ["get", "name"], ["get", "balance"]], "b": ["boolean", ["get", "name"], ["get", "even"]], "bad": ["number", ["get", "name"]]}, {"s": "c_name", "n": "c_acctbal", "b": "c_custkey % 2 = 0", "bad": "NULL::DOUBLE"})
_read("expr_array_assertion", {"first": ["at", 0, ["array", "number", 2, ["get", "pair"]]], "n": ["length", ["array", ["get", "pair"]]], "bad": ["length", ["array", "string", ["get", "pair"]]], "size": ["length", ["array", "number", 3, ["get", "pair"]]]}, {"first": "c_custkey::DOUBLE", "n": "2::DOUBLE", "bad": "NULL::DOUBLE", "size": "NULL::DOUBLE"})
_read("expr_json_writer", {"v": ["to-string", ["get", "inner"]], "e": ["to-string", ["literal", {"b": "q\"\\\n", "a": [1, True, None]}]], "p": ["to-string", ["get", "pair"]]}, {"v": "'{\"a\":' || c_custkey || ',\"b\":\"x\"}'", "e": "'{\"a\":[1,true,null],\"b\":\"q\\\"\\\\\\n\"}'", "p": "'[' || c_custkey || ',' || c_custkey + 1 || ']'"})
_read("expr_object_access", {"a": ["number", ["get", "a", ["get", "inner"]]], "b": ["has", "b", ["object", ["get", "inner"]]], "c": ["has", "c", ["object", ["get", "inner"]]]}, {"a": "c_custkey::DOUBLE", "b": "true", "c": "false"})
_read("expr_resolved_locale", {"v": ["resolved-locale", ["collator", {}]]}, {"v": "''"})
_read("expr_match_labels", {"v": ["match", ["get", "segment"], ["BUILDING", "MACHINERY"], 1, "AUTOMOBILE", 2, 0], "n": ["match", ["at", 0, ["array", "number", ["get", "pair"]]], [1, 2, 3], "few", 10, "ten", "many"]}, {"v": "CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 1 WHEN segment = 'AUTOMOBILE' THEN 2 ELSE 0 END::DOUBLE", "n": "CASE WHEN c_custkey IN (1, 2, 3) THEN 'few' WHEN c_custkey = 10 THEN 'ten' ELSE 'many' END"})


@query("expr_to_color", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 16 / 255.0 ELSE NULL END::DOUBLE AS r, CASE c_custkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 ELSE NULL END::DOUBLE AS a FROM customer")
def expr_to_color(spark, sf):
    """Texts of colors and arrays of channels as colors; what is neither is an error."""
    df, fields = _canonical(spark, sf)
    df = dealt(df.select("c_custkey", "props"), "c_custkey")
    written = ["match", ["%", ["number", ["at", 0, ["array", ["get", "pair"]]]], 4], 0, "rgba(255, 0, 0, 0.5)", 1, "lime", 2, "#102030", "no color"]
    v = compile_expression(["to-color", written], fields)
    return df.select("c_custkey", F.when(v.ok, v.col).alias("c")).select("c_custkey", F.col("c.r").alias("r"), F.col("c.a").alias("a"))


_COLORS = [("red", 1, 0, 0, 1), ("#0f0", 0, 1, 0, 1), ("#0000ff80", 0, 0, 1, 128 / 255), ("rgb(0, 51, 102)", 0, 0.2, 0.4, 1), ("rgba(255,255,255,0.25)", 1, 1, 1, 0.25), ("hsl(120, 100%, 50%)", 0, 1, 0, 1), ("hsla(240, 100%, 50%, 0.5)", 0, 0, 1, 0.5), ("transparent", 0, 0, 0, 0)]


@query("color_parse", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE, {a!r}::DOUBLE)" for t, r, g, b, a in _COLORS) + ", ('no', NULL, NULL, NULL, NULL)) v(text, r, g, b, a)")
def color_parse(spark, sf):
    rows = [(t, *([None] * 4 if color.parse(t) is None else map(float, color.parse(t)))) for t in [*(x[0] for x in _COLORS), "no"]]
    return spark.createDataFrame(rows, "text string, r double, g double, b double, a double")


@query("expr_format_and_image", "SELECT c_custkey, 'icon-' || coalesce(segment, 'none') AS image, coalesce(segment = 'BUILDING', false) AS available FROM " + _FEATURES)
def expr_format_and_image(spark, sf):
    """Images by name, and whether the sheet holds them; a formatted text may hold one."""
    df, fields = _canonical(spark, sf, images={"icon-BUILDING"})
    image = compile_expression(["image", ["concat", "icon-", ["coalesce", ["get", "segment"], "none"]]], fields)
    return df.select("c_custkey", image.col["name"].alias("image"), image.col["available"].alias("available"))


# -- where features lie

_REGION = {"type": "Polygon", "coordinates": [[[-120.0, -60.0], [100.0, -60.0], [100.0, 50.0], [-120.0, 50.0], [-120.0, -60.0]], [[-20.0, -20.0], [30.0, -20.0], [30.0, 20.0], [-20.0, 20.0], [-20.0, -20.0]]]}
_IN = "(x > -120 AND x < 100 AND lat > -60 AND lat < 50 AND NOT (x > -20 AND x < 30 AND lat > -20 AND lat < 20))"


@query("expr_within", f"SELECT c_custkey, CASE kind WHEN 'Point' THEN {_IN.replace('x', 'lon').replace('leon', 'lon')} WHEN 'LineString' THEN {_IN.replace('x', 'lon')} AND {_IN.replace('x', '(lon + 4)')} AND NOT (lat > -20 AND lat < 20 AND lon < 30 AND lon + 4 > -20) ELSE false END AS v FROM {_FEATURES} WHERE lon NOT IN (-120, 100, -20, 30, -124, 96, -24, 26) AND lat NOT IN (-60, 50, -20, 20)")
def expr_within(spark, sf):
    """Points and lines within a polygon with a hole; polygons never are. Places on its edges are left out."""
    df, fields = _canonical(spark, sf)
    v = compile_expression(["within", _REGION], fields)
    return df.where("lon not in (-120, 100, -20, 30, -124, 96, -24, 26) and lat not in (-60, 50, -20, 20)").select("c_custkey", v.col.alias("v"))


@query("within_rings", "SELECT 2::INT AS rings, 8::INT AS edges")
def within_rings(spark, sf):
    """An argument of within, bare or in a feature or a collection, is its rings and edges."""
    found = {(len(contain.polygon_rings(g)), len(contain.edges(contain.polygon_rings(g)))) for g in (_REGION, {"type": "Feature", "geometry": _REGION}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": _REGION}]}, {"type": "MultiPolygon", "coordinates": [_REGION["coordinates"]]})}
    return spark.createDataFrame(sorted(found), "rings int, edges int")


@query("unprojected", f"SELECT c_custkey, round(lon, 7) AS lon, round(greatest(-{projection.LATITUDE_MAX!r}, least({projection.LATITUDE_MAX!r}, lat)), 7) AS lat FROM {_PLACES}")
def unprojected(spark, sf):
    x, y = projection.project(F.col("lon"), F.col("lat"), 512.0 * 16)
    lon, lat = projection.unproject(F.col("px"), F.col("py"), 512.0 * 16)
    return places(spark, sf).select("c_custkey", x.alias("px"), y.alias("py")).select("c_custkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _mercator(z: int) -> tuple[str, str]:
    lat = f"greatest(-{projection.LATITUDE_MAX!r}, least({projection.LATITUDE_MAX!r}, lat))"
    return f"((180 + lon) * ({float(1 << z)} / 360))", f"((180 - ln(tan(pi() / 4 + {lat} * pi() / 360)) * 180 / pi()) * ({float(1 << z)} / 360))"


@query("tile_units", f"SELECT c_custkey, round(({_mercator(6)[0]} - {_tile_sql(6)[0]}) * 8192, 4) AS u, round(({_mercator(6)[1]} - {_tile_sql(6)[1]}) * 8192, 4) AS v FROM {_PLACES}")
def tile_units(spark, sf):
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 6)
    u, v = projection.tile_local(F.col("lon"), F.col("lat"), 6, x, y)
    return places(spark, sf).select("c_custkey", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query("cluster_positions", f"SELECT c_custkey, round(lon / 360 + 0.5, 9) AS x, round(greatest(0, least(1, 0.5 - 0.25 * ln((1 + sin(lat * pi() / 180)) / (1 - sin(lat * pi() / 180))) / pi())), 9) AS y FROM {_PLACES}")
def cluster_positions(spark, sf):
    x, y = projection.cluster_position(F.col("lon"), F.col("lat"))
    return places(spark, sf).select("c_custkey", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query("tile_boxes", f"SELECT DISTINCT x, y, round(-{projection.HALF_EQUATOR!r} + x * {2 * projection.HALF_EQUATOR / 64!r}, 3)::DOUBLE AS x0, round({projection.HALF_EQUATOR!r} - (y + 1) * {2 * projection.HALF_EQUATOR / 64!r}, 3)::DOUBLE AS y0 FROM (SELECT {_tile_sql(6)[0]} AS x, {_tile_sql(6)[1]} AS y FROM {_PLACES})")
def tile_boxes(spark, sf):
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 6)
    t = places(spark, sf).select(x.alias("x"), y.alias("y")).distinct()
    x0, y0, _, _ = projection.tile_bbox(6, F.col("x"), F.col("y"))
    return t.select("x", "y", F.round(x0, 3).alias("x0"), F.round(y0, 3).alias("y0"))


def _squares(spark, sf) -> DataFrame:
    """Parts as squares in units of cells, each with a second ring of the same winding that overlaps the first one."""
    a, n = (F.col("p_partkey") % 20).cast("double") + 0.25, (F.col("p_size") % 7 + 1).cast("double")

    def square(o, s):
        return F.array(*[F.struct((o + s * i).alias("x"), (o + s * j).alias("y")) for i, j in [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]])

    return dealt(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.array(square(a, n), square(a + 1, n)).alias("rings"))


@query("polygon_cells", "SELECT DISTINCT p_partkey, x::BIGINT AS x, y::BIGINT AS y FROM (SELECT p_partkey, p_partkey % 20 + r AS o, p_size % 7 + 1 AS n FROM part, (SELECT unnest([0, 1]) AS r)), (SELECT unnest(range(30)) AS x), (SELECT unnest(range(30)) AS y) WHERE x BETWEEN o AND o + n AND y BETWEEN o AND o + n")
def polygon_cells(spark, sf):
    """Cells that a polygon touches; where rings of one winding overlap, inside stays inside."""
    return _squares(spark, sf).select("p_partkey", F.explode(geometry.polygon_cover_column("rings")).alias("c")).select("p_partkey", "c.x", "c.y")


@query("polygon_tiles", "SELECT s_suppkey AS id, 4::INT AS z, x::INT AS x, y::INT AS y FROM supplier, (SELECT unnest(range(16)) AS x), (SELECT unnest(range(16)) AS y) WHERE x BETWEEN s_suppkey % 12 AND s_suppkey % 12 + 2 AND y BETWEEN 7 AND 8")
def polygon_tiles(spark, sf):
    """Tiles of boxes along the equator, from a tenth of a tile's width within their first tile on."""
    w = 22.5
    lon, lat = -180 + (F.col("s_suppkey") % 12 + 0.1) * w, F.lit(5.0)
    ring = F.array(*[F.struct((lon + dx * w).alias("x"), (lat * s).alias("y")) for dx, s in [(0, -1), (2, -1), (2, 1), (0, 1), (0, -1)]])
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.array(ring)).alias("geom"))
    return cover.polygon_cover(rows, 4).select("id", F.col("z").cast("int").alias("z"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def _walks(spark, sf) -> DataFrame:
    """Parts as lines that go east in steps of 10, up and down."""
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 10.0).alias("x"), F.when(i % 2 == 0, F.col("p_size").cast("double")).otherwise(0.0).alias("y")))
    return dealt(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", "p_size", line.alias("line"))


@query("clip_points", "SELECT p_partkey, 4::INT AS n FROM part")
def clip_points(spark, sf):
    return _walks(spark, sf).select("p_partkey", F.size(geometry.clip_points(F.col("line"), "x", 20.0, 55.0)).alias("n"))


@query("clip_lines", "SELECT p_partkey, 1::INT AS pieces, 35.0::DOUBLE AS width, round(sqrt(100 + p_size * p_size) * 3.5, 6) AS length FROM part")
def clip_lines(spark, sf):
    pieces = geometry.clip_lines_column(F.array("line"), 20.0, -100.0, 55.0, 100.0)
    d = _walks(spark, sf).select("p_partkey", pieces.alias("p"))
    p = F.col("p")[0]
    return d.select("p_partkey", F.size("p").alias("pieces"), (p[F.size(p) - 1]["x"] - p[0]["x"]).alias("width"), F.round(geometry.line_length(p), 6).alias("length"))


@query("clip_lines_apart", "SELECT p_partkey, i::INT AS piece, CASE WHEN i = 0 THEN 5.0 ELSE 10.0 END::DOUBLE AS width FROM part, (SELECT unnest(range(5)) AS i) WHERE p_size > 0")
def clip_lines_apart(spark, sf):
    """A line that leaves a band again and again is as many pieces; lines of half height and less, each with its width."""
    half = F.col("p_size") / 2
    flat = F.transform("line", lambda p: F.struct(p["x"].alias("x"), (p["y"] / F.col("p_size") - 0.5).alias("y")))
    pieces = geometry.clip_lines_column(F.array(flat), -1000.0, 0.0, 1000.0, 10.0)
    d = _walks(spark, sf).where(half > 0).select("p_partkey", F.posexplode(pieces).alias("piece", "p"))
    return d.select("p_partkey", "piece", F.round(F.col("p")[F.size("p") - 1]["x"] - F.col("p")[0]["x"], 6).alias("width"))


@query("clip_lines_measured", "SELECT p_partkey, 20.0::DOUBLE AS start, 55.0::DOUBLE AS stop FROM part")
def clip_lines_measured(spark, sf):
    """Where along a straight line its piece within a band begins and ends."""
    straight = F.transform("line", lambda p: F.struct(p["x"].alias("x"), F.lit(1.0).alias("y")))
    d = _walks(spark, sf).select("p_partkey", F.explode(geometry.clip_measured_column(straight, "x", 20.0, 55.0)).alias("p"))
    return d.select("p_partkey", "p.start", "p.stop")


@query("simplified_lines", "SELECT p_partkey, CASE WHEN p_size > 4.000001 THEN 10 ELSE 2 END::INT AS points FROM part WHERE p_size < 4 OR p_size > 9")
def simplified_lines(spark, sf):
    """Zigzags keep their points where they are higher than the tolerance, else only their ends."""
    small = F.transform("line", lambda p: F.struct((p["x"] / 100).alias("x"), (p["y"] / 100).alias("y")))
    d = _walks(spark, sf).where("p_size < 4 or p_size > 9").select("p_partkey", small.alias("line"))
    return d.withColumn("w", geometry.importance_column(F.col("line"))).select("p_partkey", F.size(geometry.simplified(F.col("line"), F.col("w"), 0.04)).alias("points"))


@query("tolerances", "SELECT p_partkey, 16 * 0.375 / 8192 / pow(2, p_size % 20) AS tolerance FROM part")
def tolerances(spark, sf):
    return table(spark, sf, "part").select("p_partkey", geometry.tolerance_at(F.col("p_size") % 20).alias("tolerance"))


@query("rings_classified", "SELECT p_partkey, 2::INT AS polygons, 2::INT AS first_rings, 1::INT AS last_rings FROM part")
def rings_classified(spark, sf):
    """An outer ring, two holes of which the larger one stays, and another outer ring."""

    def square(o, s, back: bool):
        at = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)] if back else [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.array(*[F.struct((o + s * i).alias("x"), (o + s * j).alias("y")) for i, j in at])

    n = (F.col("p_size") + 20).cast("double")
    rings = F.array(square(F.lit(0.0), n, False), square(F.lit(1.0), F.lit(2.0), True), square(F.lit(4.0), F.lit(5.0), True), square(n * 2, n, False))
    d = dealt(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", geometry.classified_column(rings, 1).alias("g"))
    return d.select("p_partkey", F.size("g").alias("polygons"), F.size(F.col("g")[0]).alias("first_rings"), F.size(F.col("g")[1]).alias("last_rings"))


@query("line_anchors", "SELECT p_partkey, i::INT AS anchor, (10 + i * 25)::DOUBLE AS x, 1::DOUBLE AS y, 0::DOUBLE AS angle FROM part, (SELECT unnest(range(4)) AS i) WHERE 10 + i * 25 <= 85")
def line_anchors(spark, sf):
    straight = F.transform("line", lambda p: F.struct(p["x"].alias("x"), F.lit(1.0).alias("y")))
    a = geometry.anchors_column(straight, 25.0, 10.0, 8.0, 0.5, 5.0)
    return _walks(spark, sf).select("p_partkey", F.posexplode(a).alias("anchor", "a")).select("p_partkey", "anchor", "a.x", "a.y", "a.angle")


@query("line_anchors_turning", "SELECT p_partkey, CASE WHEN 2 * atan(p_size / 10.0) <= 0.5 THEN 8 ELSE 0 END::INT AS anchors FROM part WHERE abs(2 * atan(p_size / 10.0) - 0.5) > 0.001")
def line_anchors_turning(spark, sf):
    """Anchors at the turns of a zigzag stand only where it turns less than the limit."""
    n = F.col("p_size")
    step = F.sqrt(n * n + 100.0)
    d = _walks(spark, sf).where(F.abs(2 * F.atan(n / 10.0) - 0.5) > 0.001)
    unit = F.transform("line", lambda p: F.struct((p["x"] / step).alias("x"), (p["y"] / step).alias("y")))
    return d.select("p_partkey", F.size(geometry.anchors_column(unit, 1.0, 1.0, 0.5, 0.5, 0.5)).alias("anchors"))


@query("collision_boxes", "SELECT p_partkey, 100 - p_size * 2 - 1::DOUBLE AS x0, 50 - p_size - 1::DOUBLE AS y0, 100 + p_size * 2 + 1::DOUBLE AS x1, 50 + p_size * 0.5 + 1::DOUBLE AS y1 FROM part")
def collision_boxes(spark, sf):
    n = F.col("p_size").cast("double")
    box = labels.collision_box({"top": -n, "bottom": n / 2, "left": -2 * n, "right": 2 * n}, F.lit(100.0), F.lit(50.0), F.lit(1.0), F.lit(1.0))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(a) for c, a in zip(box, ("x0", "y0", "x1", "y1"))])


# -- joins and grids


def _boxes(spark, sf, name: str, key: str, p: str) -> DataFrame:
    a, b = (F.col(key) * 17 % 500).cast("double"), (F.col(key) * 29 % 300).cast("double")
    return table(spark, sf, name).select(key, a.alias(f"{p}x0"), b.alias(f"{p}y0"), (a + F.col(key) % 13).alias(f"{p}x1"), (b + F.col(key) % 7).alias(f"{p}y1"))


def _boxes_sql(name: str, key: str) -> str:
    return f"(SELECT {key}, ({key} * 17 % 500)::DOUBLE AS x0, ({key} * 29 % 300)::DOUBLE AS y0, ({key} * 17 % 500 + {key} % 13)::DOUBLE AS x1, ({key} * 29 % 300 + {key} % 7)::DOUBLE AS y1 FROM {name})"


@query("box_box_join", f"SELECT a.p_partkey, b.s_suppkey FROM {_boxes_sql('part', 'p_partkey')} a JOIN {_boxes_sql('supplier', 's_suppkey')} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def box_box_join(spark, sf):
    return joins.box_box_join(_boxes(spark, sf, "part", "p_partkey", "l_"), _boxes(spark, sf, "supplier", "s_suppkey", "r_"), 32.0, []).select("p_partkey", "s_suppkey")


@query("box_exists", f"SELECT c_custkey FROM {_PLACES} p WHERE EXISTS (SELECT 1 FROM {_boxes_sql('supplier', 's_suppkey')} b WHERE lon BETWEEN b.x0 AND b.x1 AND lat BETWEEN b.y0 AND b.y1)")
def box_exists(spark, sf):
    """Points that any box holds, without a row a pair."""
    return joins.box_join(places(spark, sf), _boxes(spark, sf, "supplier", "s_suppkey", "r_"), 16.0, "lon", "lat", ("r_x0", "r_y0", "r_x1", "r_y1"), "left_semi").select("c_custkey")


@query("circles_and_boxes", f"SELECT p_partkey, (greatest(0, x0 - 250) + greatest(0, 250 - x1)) ** 2 + (greatest(0, y0 - 150) + greatest(0, 150 - y1)) ** 2 <= 400 AS meets, (x0 - 250) ** 2 + (y0 - 150) ** 2 < (20 + p_partkey % 13) ** 2 AS collides, x0 <= 260 AND x1 >= 240 AND y0 <= 160 AND y1 >= 140 AS overlaps FROM {_boxes_sql('part', 'p_partkey')}")
def circles_and_boxes(spark, sf):
    b = _boxes(spark, sf, "part", "p_partkey", "")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    c = [F.lit(250.0), F.lit(150.0), F.lit(20.0)]
    return b.select("p_partkey", joins.circle_meets_box(c, box).alias("meets"), joins.circles_collide(c, [F.col("x0"), F.col("y0"), (F.col("p_partkey") % 13).cast("double")]).alias("collides"), joins.boxes_overlap([F.lit(240.0), F.lit(140.0), F.lit(260.0), F.lit(160.0)], box).alias("overlaps"))


@query("region_lines", f"SELECT c_custkey FROM {_PLACES} WHERE {_IN.replace('x', 'lon')} AND {_IN.replace('x', '(lon + 4)')} AND NOT (lat > -20 AND lat < 20 AND lon < 30 AND lon + 4 > -20) AND lon NOT IN (-120, 100, -20, 30, -124, 96, -24, 26) AND lat NOT IN (-60, 50, -20, 20)")
def region_lines(spark, sf):
    """Lines whose ends and segments lie within a polygon with a hole."""
    p = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    q = F.struct((F.col("lon") + 4).alias("x"), F.col("lat").alias("y"))
    d = places(spark, sf).where("lon not in (-120, 100, -20, 30, -124, 96, -24, 26) and lat not in (-60, 50, -20, 20)")
    return d.where(contain.within_column(F.lit("LineString"), F.array(F.array(F.array(p, q))), contain.polygon_rings(_REGION))).select("c_custkey")


# -- order, sets, labels, catalog


@query("world_copies_folded", f"SELECT DISTINCT 4::INT AS z, x, y FROM (SELECT {_tile_sql(4)[0]} AS x, {_tile_sql(4)[1]} AS y FROM {_PLACES})")
def world_copies_folded(spark, sf):
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 4)
    t = places(spark, sf).select(F.lit(4).alias("z"), x.alias("x"), y.alias("y"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("wrap"))
    return tiles.folded(t).select("z", "x", "y")


@query("tiles_wanted", f"SELECT DISTINCT 4::INT AS z, x, y FROM (SELECT {_tile_sql(4)[0]} AS x, {_tile_sql(4)[1]} AS y FROM {_PLACES}) WHERE NOT (x % 2 = 0 AND y % 3 = 0)")
def tiles_wanted(spark, sf):
    """Ideal tiles that aren't held."""
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 4)
    t = places(spark, sf).select(F.lit(4).alias("z"), x.alias("x"), y.alias("y")).distinct()
    return tiles.wanted(t, t.where("x % 2 = 0 and y % 3 = 0"))


@query("circles_thinned", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 10 ELSE 5 END::INT AS kept FROM part")
def circles_thinned(spark, sf):
    """Circles a step of 2 apart: those of radius 1 stay, of radius 2 each second one goes."""
    r = F.when(F.col("p_size") % 3 == 0, 1.0).otherwise(2.0)
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 2.0).alias("x"), F.lit(0.0).alias("y"), r.alias("r")))
    return table(spark, sf, "part").select("p_partkey", F.size(ordered.thinned(line)).alias("kept"))


@query("catalog_sizes", "SELECT count(*) AS resources, sum(length(text))::BIGINT AS bytes, count(*) FILTER (doc_id % 4 = 0) AS pinned, coalesce(sum(length(text)) FILTER (doc_id % 4 = 0), 0)::BIGINT AS pinned_bytes FROM documents")
def catalog_sizes(spark, sf):
    r = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), F.length("text").cast("long").alias("bytes"), (F.col("doc_id") % 4 == 0).cast("int").alias("pins"))
    return catalog.sizes(r)


@query("catalog_refreshed", "SELECT o_orderkey::VARCHAR AS url, CASE WHEN o_orderkey % 3 = 0 THEN 900 ELSE o_orderkey % 100 END::BIGINT AS expires FROM orders")
def catalog_refreshed(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("url"), (F.col("o_orderkey") % 100).cast("long").alias("expires"))
    return catalog.refreshed(r, r.where("cast(url as long) % 3 = 0").select("url", F.lit(900).cast("long").alias("expires")))


@query("catalog_served", "SELECT o_orderkey::VARCHAR AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'fetch' WHEN o_orderkey % 100 > 50 THEN 'serve' ELSE 'revalidate' END AS what FROM orders WHERE o_orderkey % 2 = 0")
def catalog_served(spark, sf):
    """What is to be done for each of the urls asked for, twice each: those that are held and fresh are served."""
    o = table(spark, sf, "orders")
    asked = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("url"))
    held = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").cast("string").alias("url"), (F.col("o_orderkey") % 100).cast("long").alias("expires"), F.lit(0).alias("pins"), F.lit(False).alias("must_revalidate"))
    return catalog.served(asked.unionByName(asked), held, F.lit(50).cast("long")).select("url", F.col("action").alias("what"))


@query("catalog_claims", "SELECT (o_orderkey % 4)::INT AS region_id, o_orderkey::VARCHAR AS url FROM orders WHERE NOT (o_orderkey % 4 = 1 AND o_orderkey % 3 = 0)")
def catalog_claims(spark, sf):
    """Claims, some made twice, and some given up."""
    c = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("region_id"), F.col("o_orderkey").cast("string").alias("url"))
    both = catalog.claimed(c.where("region_id < 3"), c.where("region_id > 1"))
    return catalog.unclaimed(both, c.where("region_id = 1 and cast(url as long) % 3 = 0"))


@query("region_resources", " UNION ALL ".join(f"SELECT 'https://t/{z}/' || x || '/' || y AS url FROM (SELECT unnest(range({1 << z})) AS x), (SELECT unnest(range({1 << z})) AS y)" for z in range(2, 5)) + " UNION ALL SELECT 'https://font/' || n_nationkey FROM nation")
def region_resources(spark, sf):
    """All urls of a region over the whole world, of a source that has the zooms 2 to 4, and other resources."""
    world = lambda z: projection.box_cover(spark, -180.0, -85.06, 180.0, 85.06, z)
    more = table(spark, sf, "nation").select(F.concat(F.lit("https://font/"), F.col("n_nationkey").cast("string")).alias("url"))
    return catalog.region_plan([{"tiles": ["https://t/{z}/{x}/{y}"], "minzoom": 2, "maxzoom": 4, "scheme": "xyz"}], 0, 9, world, more).select("url")


@query("region_estimate", "SELECT 336::BIGINT AS tiles, true AS precise")
def region_estimate(spark, sf):
    n, precise = catalog.estimate([{"tiles": ["https://t/{z}/{x}/{y}"], "minzoom": 2, "maxzoom": 4}], 0, 9, lambda z: projection.tile_count(-180.0, -85.06, 180.0, 85.06, z))
    return spark.createDataFrame([(n, precise)], "tiles long, precise boolean")


@query("glyphs_owed", "SELECT DISTINCT lang AS stack, (ascii(c) // 256)::INT AS range FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' AND ascii(c) // 256 > 0")
def glyphs_owed(spark, sf):
    """Ranges of glyphs that texts need and that aren't loaded: all first ones are."""
    needed = labels.glyph_ranges(table(spark, sf, "documents").select(F.col("lang").alias("stack"), "text"))
    return labels.owed(needed, needed.where("range = 0")).select("stack", "range")


@query("sources_replaced", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END::INT AS revision FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def sources_replaced(spark, sf):
    """Two sources' features, of which one is replaced by new ones with their own revision."""
    c = table(spark, sf, "customer").select("c_custkey")
    held = replaced(replaced(None, c.where("c_custkey % 2 = 0"), "a", 1), c.where("c_custkey % 2 = 1"), "b", 1)
    return replaced(held, c.where("c_custkey % 2 = 1 and c_custkey % 3 = 0"), "b", 2).select("source", "c_custkey", "revision")


@query("dirty_rects", "SELECT * FROM (VALUES (0::INT, 0::INT, 10::INT, 10::INT), (20, 20, 30, 30)) v(x0, y0, x1, y1)")
def dirty_rects(spark, sf):
    return spark.createDataFrame(state.merged_rects([(0, 0, 10, 10), (2, 2, 5, 5), (20, 20, 30, 30), (21, 21, 30, 30)]), "x0 int, y0 int, x1 int, y1 int")


@query("announced_uses", "SELECT o_orderkey AS geometry, o_custkey AS view FROM orders WHERE o_orderkey % 2 = 0")
def announced_uses(spark, sf):
    """All live uses of each announced geometry."""
    o = table(spark, sf, "orders")
    log = o.select((F.col("o_orderkey") * 2).alias("seq"), F.lit("use").alias("kind"), F.col("o_orderkey").alias("geometry"), F.col("o_custkey").alias("view"), F.lit(None).cast("string").alias("payload"))
    told = o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") * 2 + 1).alias("seq"), F.lit("announce").alias("kind"), F.col("o_orderkey").alias("geometry"), F.lit(None).cast("long").alias("view"), F.lit("p").alias("payload"))
    return state.joined(log.unionByName(told)).where("payload is not null").select("geometry", "view")


@query("light_resolved", "SELECT 'map' AS anchor, 0.4::DOUBLE AS intensity, 0.0::DOUBLE AS x, 0.5::DOUBLE AS y, 0.866025::DOUBLE AS z")
def light_resolved(spark, sf):
    w = extras.light({"anchor": "map", "intensity": 0.4, "position": [1, 0, 30]})
    return spark.createDataFrame([(w["anchor"], w["intensity"], *(round(v, 6) + 0.0 for v in w["direction"]))], "anchor string, intensity double, x double, y double, z double")


@query("tile_counts", " UNION ALL ".join(f"SELECT {z}::INT AS z, {(1 << z) * (1 << z)}::BIGINT AS tiles" for z in range(6)))
def tile_counts(spark, sf):
    return spark.createDataFrame([(z, projection.tile_count(-180.0, -85.06, 180.0, 85.06, z)) for z in range(6)], "z int, tiles long")


@query("screen_round_trip", f"SELECT c_custkey, true AS same FROM {_PLACES} WHERE abs(lon) < 20 AND abs(lat) < 20")
def screen_round_trip(spark, sf):
    """Places to the screen of a turned and pitched view and back: a view's places are few."""
    v = cover.View(lon=1.0, lat=2.0, zoom=3.0, width=1024, height=768, bearing=30.0, pitch=20.0)
    rows = []
    for r in places(spark, sf).where("abs(lon) < 20 and abs(lat) < 20").select("c_custkey", "lon", "lat").collect():
        lon, lat = v.screen_to_geo(*v.geo_to_screen(r.lon, r.lat)[:2])
        rows.append((r.c_custkey, math.isclose(lon, r.lon, abs_tol=1e-6) and math.isclose(lat, r.lat, abs_tol=1e-6)))
    return spark.createDataFrame(rows, "c_custkey long, same boolean")
