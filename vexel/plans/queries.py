"""The registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import apply_expressions
from ..lang.filters import admitted
from ..lang.legacy import LegacyFunction
from ..lang.values import Fields, Val
from ..operators import catalog, labels, ordered, tiles
from ..sources import dem
from ..sources.urls import expand
from ..spatial import cluster, geometry, joins, projection
from ..spatial.contain import edge_array, point_in
from ..streaming import state
from . import box_query
from .document import Plan, Style, label_template
from .ramps import bake
from .registry import ORACLES, QUERIES, query
from .tables import _PLACES, _tile_sql, dealt, places, table, tile_assign

__all__ = ["ORACLES", "QUERIES"]


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Fields]:
    """events with the keys of props as dynamic properties."""
    df = table(spark, sf_dir, "events")
    fields = Fields.of(df)
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    fields.props["k"] = Val("value", F.when(~F.is_variant_null(v), v), deps=frozenset({"feature"}))
    return df, fields


_K = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"


# -- layers and filters


@query("layer_events", f"SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value * 2 ELSE value END AS w FROM events WHERE coalesce({_K} >= 50, false)")
def layer_events(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("feature_index"), "event_id", "event_type", "value", F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").alias("k"))
    style = Style.parse({"version": 8, "sources": {"events": {}}, "layers": [{"id": "e", "type": "circle", "source": "events", "filter": [">=", ["get", "k"], 50], "paint": {"circle-radius": ["match", ["get", "event_type"], ["click", "view"], ["*", 2, ["get", "value"]], ["get", "value"]]}}]})
    return Plan(style, {"events": df}, 4.0).layer("e").select("event_id", F.col("circle-radius").alias("w"))


def _filter(name: str, f, where: str):
    @query(name, f"SELECT event_id FROM events WHERE {where}")
    def run(spark, sf, f=f):
        df, fields = events(spark, sf)
        return admitted(df, f, fields).select("event_id")


_filter("filter_legacy_cmp", ["all", [">=", "k", 50], ["==", "event_type", "click"], ["<", "value", 90.5]], f"coalesce({_K} >= 50, false) AND event_type = 'click' AND value < 90.5")
_filter("filter_legacy_ne_missing", ["all", ["!=", "absent", "x"], ["!=", "event_type", "click"], ["!=", "k", 7]], f"event_type <> 'click' AND NOT coalesce({_K} = 7, false)")
_filter("filter_in_notin", ["all", ["in", "event_type", "click", "view"], ["!in", "k", 1, 2, 3]], f"event_type IN ('click', 'view') AND NOT coalesce({_K} IN (1, 2, 3), false)")
_filter("filter_has_nothas", ["all", ["has", "k"], ["!has", "absent"]], "json_extract(props, '$.k') IS NOT NULL")
_filter("filter_none", ["none", [">", "value", 50], ["==", "event_type", "view"]], "NOT (value > 50 OR event_type = 'view')")
_filter("filter_cross_type", ["any", ["<", "event_type", 5], [">", "value", "a"], ["==", "k", "69"]], "false")


@query("filter_expr_all_any_not", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND NOT (o_custkey % 2 = 0)")
def filter_expr(spark, sf):
    df = table(spark, sf, "orders")
    f = ["all", [">", ["get", "o_totalprice"], 100000], ["any", ["==", ["get", "o_orderstatus"], "F"], ["==", ["get", "o_orderpriority"], "1-URGENT"]], ["!", ["==", ["%", ["get", "o_custkey"], 2], 0]]]
    return admitted(df, f, Fields.of(df)).select("o_orderkey")


def _zoomed(name: str, zoom: float, expression, sql: str):
    @query(name, f"SELECT c_custkey, {sql} AS v FROM customer")
    def run(spark, sf):
        return apply_expressions(table(spark, sf, "customer"), ["c_custkey"], {"v": expression}, zoom=zoom)


_zoomed("expr_zoom_step", 7.5, ["step", ["zoom"], ["get", "c_acctbal"], 5, ["*", 2, ["get", "c_acctbal"]], 9, 0], "c_acctbal * 2")
_zoomed("expr_zoom_interpolate", 7.5, ["interpolate", ["linear"], ["zoom"], 5, 0, 10, 100], "CAST(50 AS DOUBLE)")


# -- expressions

_LINE = ["l_orderkey", "l_linenumber"]


def _expression(name: str, source: str, ids: list[str], expressions: dict, sql: dict[str, str] | None):
    @query(name, None if sql is None else f"SELECT {', '.join(ids)}, {', '.join(f'{s} AS {n}' for n, s in sql.items())} FROM {source}")
    def run(spark, sf):
        return apply_expressions(table(spark, sf, source), ids, expressions)


_expression(
    "expr_case", "lineitem", _LINE,
    {"v": ["case", ["<", ["get", "l_quantity"], 10], "low", ["<", ["get", "l_quantity"], 30], ["concat", "mid-", ["get", "l_returnflag"]], "high"]},
    {"v": "CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid-' || l_returnflag ELSE 'high' END"},
)
_expression(
    "expr_match", "lineitem", _LINE,
    {"v": ["match", ["get", "l_returnflag"], "A", 1, ["N", "R"], ["get", "l_tax"], -1], "n": ["match", ["get", "l_linenumber"], [1, 2], "few", 7, "last", "other"]},
    {"v": "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag IN ('N', 'R') THEN l_tax ELSE -1 END::DOUBLE", "n": "CASE WHEN l_linenumber IN (1, 2) THEN 'few' WHEN l_linenumber = 7 THEN 'last' ELSE 'other' END"},
)
_expression("expr_let_var", "lineitem", _LINE, {"v": ["let", "net", ["*", ["get", "l_extendedprice"], ["-", 1, ["get", "l_discount"]]], ["+", ["var", "net"], ["*", ["var", "net"], ["get", "l_tax"]]]]}, {"v": "l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * l_tax"})
_expression("expr_step", "lineitem", _LINE, {"v": ["step", ["get", "l_quantity"], 0, 10, 1, 20, ["get", "l_tax"], 40, 3]}, {"v": "CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN l_tax WHEN l_quantity >= 10 THEN 1 ELSE 0 END::DOUBLE"})
_expression(
    "expr_interpolate_linear", "lineitem", _LINE,
    {"v": ["round", ["*", 1000, ["interpolate", ["linear"], ["get", "l_quantity"], 10, 0, 20, 50, 40, 100]]]},
    {"v": "round(1000 * CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity < 20 THEN 0 * (1 - (l_quantity - 10) / 10) + 50 * ((l_quantity - 10) / 10) WHEN l_quantity < 40 THEN 50 * (1 - (l_quantity - 20) / 20) + 100 * ((l_quantity - 20) / 20) ELSE 100 END)::DOUBLE"},
)
_expression(
    "expr_interpolate_exp", "lineitem", _LINE,
    {"v": ["/", ["round", ["*", 1000, ["interpolate", ["exponential", 1.5], ["get", "l_quantity"], 10, 0, 20, 50]]], 1000]},
    {"v": "round(1000 * CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity < 20 THEN 50 * ((pow(1.5, l_quantity - 10) - 1) / (pow(1.5, 10) - 1)) ELSE 50 END)::DOUBLE / 1000"},
)
# the curve's parameter by halving, to far below the digits that are compared
_BEZIER = "3 * (1 - t) * (1 - t) * t * %s + 3 * (1 - t) * t * t * %s + t * t * t"


@query("expr_bezier", f"""WITH RECURSIVE q AS (SELECT DISTINCT l_quantity, greatest(0, least(1, l_quantity / 50)) AS x FROM lineitem),
  h AS (SELECT l_quantity, x, 0::DOUBLE AS low, 1::DOUBLE AS high, 0 AS n FROM q
    UNION ALL SELECT l_quantity, x, CASE WHEN {_BEZIER % (0.42, 0.58)} < x THEN t ELSE low END, CASE WHEN {_BEZIER % (0.42, 0.58)} < x THEN high ELSE t END, n + 1 FROM (SELECT *, (low + high) / 2 AS t FROM h WHERE n < 50))
  SELECT l_orderkey, l_linenumber, round(({_BEZIER % (0, 1)}) * 10000) AS v FROM lineitem JOIN (SELECT l_quantity, low AS t FROM h WHERE n = 50) USING (l_quantity)""")
def expr_bezier(spark, sf):
    curve = ["interpolate", ["cubic-bezier", 0.42, 0, 0.58, 1], ["get", "l_quantity"], 0, 0, 50, 1]
    return apply_expressions(table(spark, sf, "lineitem"), _LINE, {"v": ["round", ["*", 10000, curve]]})


_expression("expr_coalesce", "part", ["p_partkey"], {"v": ["coalesce", ["get", "absent"], ["get", "p_brand"], "none"]}, {"v": "p_brand"})
_expression(
    "expr_compare", "lineitem", _LINE,
    {"lt": ["<", ["get", "l_returnflag"], ["get", "l_linestatus"]], "eq": ["==", ["get", "l_tax"], ["get", "l_discount"]], "ne": ["!=", ["get", "absent"], ["get", "l_returnflag"]], "nul": ["==", ["get", "absent"], None]},
    {"lt": "l_returnflag < l_linestatus", "eq": "l_tax = l_discount", "ne": "true", "nul": "true"},
)
_expression("expr_collator", "part", ["p_partkey"], {"v": ["==", ["upcase", ["get", "p_type"]], ["get", "p_type"], ["collator", {"case-sensitive": False}]]}, {"v": "true"})
_expression(
    "expr_concat", "part", ["p_partkey"],
    {"v": ["concat", ["get", "p_brand"], ":", ["get", "p_size"], ":", ["get", "absent"], ["==", 1, 1]]},
    {"v": "p_brand || ':' || p_size || ':' || 'true'"},
)
_expression(
    "expr_join_split", "part", ["p_partkey"],
    {"v": ["join", ["split", ["get", "p_name"], " "], "_"], "n": ["length", ["split", ["get", "p_name"], ""]], "first": ["at", 0, ["split", ["get", "p_name"], " "]]},
    {"v": "replace(p_name, ' ', '_')", "n": "length(p_name)::DOUBLE", "first": "split_part(p_name, ' ', 1)"},
)
_expression(
    "expr_slice", "part", ["p_partkey"],
    {"a": ["slice", ["get", "p_name"], 2, 5], "b": ["slice", ["get", "p_name"], -3], "c": ["slice", ["get", "p_name"], 5, 2]},
    {"a": "substr(p_name, 3, 3)", "b": "right(p_name, 3)", "c": "''"},
)
_expression(
    "expr_index_of", "part", ["p_partkey"],
    {"v": ["index-of", "a", ["get", "p_name"]], "w": ["index-of", "e", ["get", "p_name"], 3], "i": ["in", "an", ["get", "p_name"]], "j": ["in", ["get", "p_size"], ["literal", [1, 2, 3]]]},
    {"v": "(instr(p_name, 'a') - 1)::DOUBLE", "w": "CASE WHEN instr(substr(p_name, 4), 'e') > 0 THEN instr(substr(p_name, 4), 'e') + 2 ELSE -1 END::DOUBLE", "i": "contains(p_name, 'an')", "j": "p_size IN (1, 2, 3)"},
)
_expression("expr_case_fold", "part", ["p_partkey"], {"u": ["upcase", ["get", "p_name"]], "d": ["downcase", ["get", "p_type"]]}, {"u": "upper(p_name)", "d": "lower(p_type)"})
_expression("expr_length", "documents", ["doc_id"], {"v": ["length", ["get", "text"]], "s": ["is-supported-script", ["get", "text"]]}, {"v": "length(text)::DOUBLE", "s": "true"})
_expression(
    "expr_to_number", "customer", ["c_custkey"],
    {"v": ["to-number", ["get", "c_name"], ["slice", ["get", "c_name"], 9], -1], "b": ["to-number", [">", ["get", "c_acctbal"], 0]], "z": ["to-number", ["get", "absent"]]},
    {"v": "coalesce(try_cast(c_name AS DOUBLE), try_cast(substr(c_name, 10) AS DOUBLE), -1)", "b": "CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END::DOUBLE", "z": "0::DOUBLE"},
)
_expression(
    "expr_to_string", "part", ["p_partkey"],
    {"v": ["to-string", ["get", "p_size"]], "n": ["to-string", ["get", "absent"]], "f": ["to-string", ["/", ["get", "p_size"], 4]]},
    {"v": "p_size::VARCHAR", "n": "''", "f": "regexp_replace((p_size / 4.0)::DOUBLE::VARCHAR, '\\.0$', '')"},
)
_expression("expr_to_boolean", "customer", ["c_custkey"], {"v": ["to-boolean", ["get", "c_acctbal"]], "s": ["to-boolean", ["get", "c_mktsegment"]], "n": ["to-boolean", ["get", "absent"]]}, {"v": "c_acctbal <> 0", "s": "c_mktsegment <> ''", "n": "false"})
_expression("expr_typeof", "customer", ["c_custkey"], {"v": ["typeof", ["get", "c_acctbal"]], "s": ["typeof", ["get", "c_name"]], "n": ["typeof", ["get", "absent"]], "a": ["typeof", ["split", ["get", "c_name"], "#"]]}, {"v": "'number'", "s": "'string'", "n": "'null'", "a": "'array<string, ' || len(string_split(c_name, '#')) || '>'"})
_expression(
    "expr_rgba", "lineitem", _LINE,
    {"r": ["at", 0, ["to-rgba", ["rgba", ["get", "l_quantity"], 0, 0, 0.5]]], "s": ["to-string", ["rgb", ["get", "l_quantity"], 1, 2]]},
    {"r": "l_quantity / 255 * 255", "s": "'rgba(' || round(l_quantity / 255 * 255)::INT || ',1,2,1)'"},
)
_expression("expr_number_format", "part", ["p_partkey"], {"v": ["number-format", ["get", "p_retailprice"], {"locale": "en-US", "min-fraction-digits": 2, "max-fraction-digits": 2}]}, {"v": "format('{:,.2f}', p_retailprice)"})
_expression("expr_error_default", "lineitem", _LINE, {"v": ["case", [">", ["get", "l_quantity"], 25], ["+", ["get", "l_returnflag_number"], 1], 7]}, {"v": "CASE WHEN l_quantity > 25 THEN NULL ELSE 7 END::DOUBLE"})

#: Arguments with zero and negative values among them, and what each function gives for them.
_X, _Y = "(l_quantity - 25)", "(l_linenumber::DOUBLE - 3)"
_INF, _NAN = "'infinity'::DOUBLE", "'nan'::DOUBLE"
_MATH = {
    "add": (["+", "x", "y", 1], f"{_X} + {_Y} + 1"),
    "sub": (["-", "x", "y"], f"{_X} - {_Y}"),
    "neg": (["-", "x"], f"-{_X}"),
    "mul": (["*", "x", "y"], f"{_X} * {_Y}"),
    "div": (["/", "x", "y"], f"CASE WHEN {_Y} <> 0 THEN {_X} / {_Y} WHEN {_X} = 0 THEN {_NAN} WHEN {_X} > 0 THEN {_INF} ELSE -{_INF} END"),
    "mod": (["%", "x", "y"], f"CASE WHEN {_Y} <> 0 THEN {_X} - {_Y} * trunc({_X} / {_Y}) ELSE {_NAN} END"),
    "pow": (["^", "y", 3], f"pow({_Y}, 3)"),
    "min": (["min", "x", "y", 4], f"least({_X}, {_Y}, 4)"),
    "max": (["max", "x", "y", -4], f"greatest({_X}, {_Y}, -4)"),
    "abs": (["abs", "x"], f"abs({_X})"),
    "floor": (["floor", ["/", "x", 4]], f"floor({_X} / 4)"),
    "ceil": (["ceil", ["/", "x", 4]], f"ceil({_X} / 4)"),
    "round": (["round", ["/", "x", 4]], f"round({_X} / 4)"),
    "sqrt": (["sqrt", "x"], f"CASE WHEN {_X} >= 0 THEN sqrt({_X}) ELSE {_NAN} END"),
    "ln": (["ln", "x"], f"CASE WHEN {_X} > 0 THEN ln({_X}) WHEN {_X} = 0 THEN -{_INF} ELSE {_NAN} END"),
    "log2": (["log2", "x"], f"CASE WHEN {_X} > 0 THEN log2({_X}) WHEN {_X} = 0 THEN -{_INF} ELSE {_NAN} END"),
    "log10": (["log10", "x"], f"CASE WHEN {_X} > 0 THEN log10({_X}) WHEN {_X} = 0 THEN -{_INF} ELSE {_NAN} END"),
    "sin": (["sin", "x"], f"sin({_X})"),
    "cos": (["cos", "x"], f"cos({_X})"),
    "tan": (["tan", ["/", "x", 30]], f"tan({_X} / 30)"),
    "asin": (["asin", ["/", "x", 20]], f"CASE WHEN abs({_X} / 20) <= 1 THEN asin({_X} / 20) ELSE {_NAN} END"),
    "acos": (["acos", ["/", "x", 20]], f"CASE WHEN abs({_X} / 20) <= 1 THEN acos({_X} / 20) ELSE {_NAN} END"),
    "atan": (["atan", "x"], f"atan({_X})"),
    "constants": (["+", ["e"], ["pi"], ["ln2"]], "exp(1) + pi() + ln(2)"),
}


def _named(x):
    if isinstance(x, list):
        return [x[0], *map(_named, x[1:])]
    return {"x": ["-", ["get", "l_quantity"], 25], "y": ["-", ["get", "l_linenumber"], 3]}.get(x, x) if isinstance(x, str) else x


for _name, (_json, _sql) in _MATH.items():

    @query(f"expr_math_{_name}", f"SELECT l_orderkey, l_linenumber, round({_sql}, 9)::DOUBLE + 0 AS v FROM lineitem")
    def _run(spark, sf, x=_named(_json)):
        df = apply_expressions(table(spark, sf, "lineitem"), _LINE, {"v": x})
        return df.withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), F.col("v")).otherwise(F.round("v", 9) + 0.0))


# -- legacy functions


def _legacy(name: str, source: str, ids: list[str], fn: dict, kind: str | None, mixes: bool, sql: str, zoom: float | None = None):
    @query(name, f"SELECT {', '.join(ids)}, {sql} AS v FROM {source}")
    def run(spark, sf):
        df = table(spark, sf, source)
        fields = Fields.of(df, zoom=zoom)
        v = LegacyFunction(fn, fields, kind, mixes).compile()
        return df.select(*ids, (v.col if v.ok is None else F.when(v.ok, v.col)).alias("v"))


_legacy("legacy_interval", "lineitem", _LINE, {"type": "interval", "property": "l_quantity", "stops": [[10, 1], [20, 2], [40, 3]]}, "number", True, "CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 ELSE 1 END::DOUBLE")
_legacy("legacy_exponential", "lineitem", _LINE, {"property": "l_quantity", "stops": [[10, 0], [30, 20], [50, 80]]}, "number", True, "CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 30 THEN 0 * (1 - (l_quantity - 10) / 20) + 20 * ((l_quantity - 10) / 20) WHEN l_quantity < 50 THEN 20 * (1 - (l_quantity - 30) / 20) + 80 * ((l_quantity - 30) / 20) ELSE 80 END")
_legacy("legacy_categorical", "part", ["p_partkey"], {"type": "categorical", "property": "p_size", "stops": [[1, "one"], [2, "two"]], "default": "many"}, "string", False, "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END")
_legacy("legacy_identity", "part", ["p_partkey"], {"type": "identity", "property": "p_brand", "default": "none"}, "string", False, "p_brand")
_legacy("legacy_composite", "lineitem", _LINE, {"type": "exponential", "property": "l_quantity", "stops": [[{"zoom": 0, "value": 0}, 0], [{"zoom": 0, "value": 50}, 50], [{"zoom": 10, "value": 0}, 0], [{"zoom": 10, "value": 50}, 100]]}, "number", True, "CASE WHEN l_quantity >= 50 THEN 50 * 0.5 + 100 * 0.5 ELSE (0 * (1 - l_quantity / 50) + 50 * (l_quantity / 50)) * 0.5 + (0 * (1 - l_quantity / 50) + 100 * (l_quantity / 50)) * 0.5 END", zoom=5.0)


# -- tiles


query("tile_assign", f"SELECT c_custkey, {_tile_sql(9)[0]} AS x, {_tile_sql(9)[1]} AS y FROM {_PLACES}")(tile_assign)

_QUADKEY = " || ".join(f"((x >> {k} & 1) + 2 * (y >> {k} & 1))::VARCHAR" for k in reversed(range(9)))


@query("tile_quadkey", f"SELECT c_custkey, {_QUADKEY} AS quadkey FROM (SELECT c_custkey, {_tile_sql(9)[0]} AS x, {_tile_sql(9)[1]} AS y FROM {_PLACES})")
def tile_quadkey(spark, sf):
    return tile_assign(spark, sf).select("c_custkey", projection.quadkey(9, F.col("x"), F.col("y")).alias("quadkey"))


def _hilbert_sql() -> str:
    sql = f"SELECT c_custkey, x, y, 0::BIGINT AS d FROM (SELECT c_custkey, {_tile_sql(9)[0]} AS x, {_tile_sql(9)[1]} AS y FROM {_PLACES})"
    for k in reversed(range(9)):
        n = 1 << k
        turned = f"CASE WHEN rx = 1 AND ry = 0 THEN {n - 1} - (%s & {n - 1}) ELSE %s & {n - 1} END"
        x, y = (turned.replace("%s", c) for c in "xy")
        sql = f"SELECT c_custkey, CASE WHEN ry = 0 THEN {y} ELSE {x} END AS x, CASE WHEN ry = 0 THEN {x} ELSE {y} END AS y, d + {n * n} * xor(3 * rx, ry) AS d FROM (SELECT *, x >> {k} & 1 AS rx, y >> {k} & 1 AS ry FROM ({sql}))"
    return f"SELECT c_custkey, (d + {((1 << 18) - 1) // 3})::BIGINT AS tile_id FROM ({sql})"


@query("tile_hilbert_id", _hilbert_sql())
def tile_hilbert(spark, sf):
    return tile_assign(spark, sf).select("c_custkey", projection.tile_id(9, F.col("x"), F.col("y")).alias("tile_id"))


@query("tile_url", f"SELECT c_custkey, 'https://t/9/' || x || '/' || (511 - y) || '?q={{foo}}' AS url FROM (SELECT c_custkey, {_tile_sql(9)[0]} AS x, {_tile_sql(9)[1]} AS y FROM {_PLACES})")
def tile_url(spark, sf):
    return tile_assign(spark, sf).select("c_custkey", expand("https://t/{z}/{x}/{y}?q={foo}", 9, F.col("x"), F.col("y"), scheme="tms").alias("url"))


@query("tile_cover_box", "SELECT 5::INT AS z, x::INT AS x, y::INT AS y FROM (SELECT unnest([30, 31, 0, 1]) AS x), (SELECT unnest(range(13, 19)) AS y)")
def tile_cover_box(spark, sf):
    return projection.box_cover(spark, 160.0, -30.0, -160.0, 30.0, 5)


@query("tile_ancestors", f"SELECT c_custkey, 4::INT AS z, (x >> 5)::INT AS x, (y >> 5)::INT AS y FROM (SELECT c_custkey, {_tile_sql(9)[0]} AS x, {_tile_sql(9)[1]} AS y FROM {_PLACES})")
def tile_ancestors(spark, sf):
    z, x, y = projection.ancestor(F.lit(9), F.col("x"), F.col("y"), 4)
    return tile_assign(spark, sf).select("c_custkey", z.alias("z"), x.alias("x"), y.alias("y"))


def _tile_set(spark, sf, z: int, where: str) -> DataFrame:
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), z)
    return places(spark, sf).where(where).select(F.lit(z).alias("z"), x.alias("x"), y.alias("y")).distinct()


_SET = lambda z, w: f"SELECT DISTINCT {z}::INT AS z, {_tile_sql(z)[0]} AS x, {_tile_sql(z)[1]} AS y FROM {_PLACES} WHERE {w}"
_BEFORE, _NOW = "c_acctbal < 7000", "c_acctbal > 2000"


@query("cover_diff", f"WITH b AS ({_SET(4, _BEFORE)}), n AS ({_SET(4, _NOW)}) SELECT 'entered' AS change, * FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT 'left', * FROM (SELECT * FROM b EXCEPT SELECT * FROM n)")
def cover_diff(spark, sf):
    entered, left = ordered.entered_and_left(_tile_set(spark, sf, 4, _BEFORE), _tile_set(spark, sf, 4, _NOW), ["z", "x", "y"])
    return entered.select(F.lit("entered").alias("change"), "z", "x", "y").unionByName(left.select(F.lit("left").alias("change"), "z", "x", "y"))


_LOADED = f"(SELECT * FROM ({_SET(5, 'c_acctbal > 3000')}) UNION SELECT * FROM ({_SET(4, 'c_acctbal < 0')}) UNION SELECT * FROM ({_SET(1, 'true')}))"


@query("tile_substitution", f"""WITH i AS ({_SET(4, 'true')}), l AS {_LOADED}, m AS (SELECT * FROM i EXCEPT SELECT * FROM l),
  k AS (SELECT m.z AS iz, m.x AS ix, m.y AS iy, l.* FROM m JOIN l ON l.z = m.z + 1 AND l.x >> 1 = m.x AND l.y >> 1 = m.y),
  f AS (SELECT iz, ix, iy FROM k GROUP BY ALL HAVING count(*) = 4), o AS (SELECT * FROM m EXCEPT SELECT * FROM f),
  a AS (SELECT o.z AS iz, o.x AS ix, o.y AS iy, l.*, row_number() OVER (PARTITION BY o.z, o.x, o.y ORDER BY l.z DESC) AS n FROM o JOIN l ON l.z < o.z AND o.x >> greatest(0, o.z - l.z) = l.x AND o.y >> greatest(0, o.z - l.z) = l.y)
  SELECT z AS ideal_z, x AS ideal_x, y AS ideal_y, z, x, y FROM (SELECT * FROM i INTERSECT SELECT * FROM l) UNION ALL SELECT * FROM k UNION ALL SELECT iz, ix, iy, z, x, y FROM a WHERE n = 1""")
def tile_substitution(spark, sf):
    loaded = _tile_set(spark, sf, 5, "c_acctbal > 3000").unionByName(_tile_set(spark, sf, 4, "c_acctbal < 0")).unionByName(_tile_set(spark, sf, 1, "true"))
    return tiles.substituted(_tile_set(spark, sf, 4, "true"), loaded)


_DRAWN = f"(SELECT * FROM ({_SET(1, 'true')}) UNION SELECT * FROM ({_SET(2, 'c_nationkey < 5')}) UNION SELECT * FROM ({_SET(7, 'c_acctbal < 0')}))"


@query("tile_masks", f"""WITH RECURSIVE d AS {_DRAWN}, p AS (SELECT z AS tz, x AS tx, y AS ty, z, x, y, false AS stops FROM d
    UNION ALL SELECT tz, tx, ty, (z + 1)::INT, (x * 2 + i)::INT, (y * 2 + j)::INT, EXISTS (SELECT 1 FROM d WHERE d.z = p.z + 1 AND d.x = p.x * 2 + i AND d.y = p.y * 2 + j)
    FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE NOT stops AND z < 8 AND EXISTS (SELECT 1 FROM d WHERE d.z > p.z AND (d.x >> greatest(0, d.z - p.z)) = p.x AND (d.y >> greatest(0, d.z - p.z)) = p.y))
  SELECT tz, tx, ty, z, x, y, ((x - (tx << (z - tz))) * (8192 >> (z - tz)))::INT AS x0 FROM p WHERE NOT stops AND NOT EXISTS (SELECT 1 FROM d WHERE d.z > p.z AND (d.x >> greatest(0, d.z - p.z)) = p.x AND (d.y >> greatest(0, d.z - p.z)) = p.y)""")
def tile_masks(spark, sf):
    drawn = _tile_set(spark, sf, 1, "true").unionByName(_tile_set(spark, sf, 2, "c_nationkey < 5")).unionByName(_tile_set(spark, sf, 7, "c_acctbal < 0"))
    return tiles.mask_quads(tiles.masks(drawn)).drop("y0", "x1", "y1")


@query("tile_refined", f"WITH t AS ({_SET(3, 'true')}) SELECT 4::INT AS z, (x * 2 + i)::INT AS x, (y * 2 + j)::INT AS y FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)")
def tile_refined(spark, sf):
    return tiles.refined(_tile_set(spark, sf, 3, "true"), 1)


# -- spatial joins


@query("join_box_range", f"SELECT a.c_custkey, b.s_suppkey FROM {_PLACES} a JOIN (SELECT s_suppkey, ((s_suppkey * 41) % 300 - 150)::DOUBLE AS x0, ((s_suppkey * 29) % 140 - 80)::DOUBLE AS y0 FROM supplier) b ON a.lon BETWEEN x0 AND x0 + 12 AND a.lat BETWEEN y0 AND y0 + 9")
def join_box_range(spark, sf):
    boxes = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 41) % 300 - 150).cast("double").alias("x0"), ((F.col("s_suppkey") * 29) % 140 - 80).cast("double").alias("y0"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 12, "y1": F.col("y0") + 9})
    return joins.box_join(places(spark, sf).select("c_custkey", "lon", "lat"), boxes, 12.0, "lon", "lat").select("c_custkey", "s_suppkey")


_VEC = "(SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _vectors(spark, sf, p: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(f"{p}_id"), F.col("embedding")[0].cast("double").alias(f"{p}x"), F.col("embedding")[1].cast("double").alias(f"{p}y"), F.col("label").alias(f"{p}_label"))


@query("join_radius", f"SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM {_VEC} a JOIN {_VEC} b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02 * 0.02 AND a.vec_id < b.vec_id")
def join_radius(spark, sf):
    return joins.radius_join(_vectors(spark, sf, "a"), _vectors(spark, sf, "b"), 0.02, "ax", "ay", "bx", "by").where("a_id < b_id").select("a_id", "b_id")


_REGION = [[(-100.0, -40.0), (20.0, -60.0), (90.0, 10.0), (10.0, 50.0), (-100.0, -40.0)]]


def _in_region_sql() -> str:
    ring = _REGION[0]
    hits = [f"CASE WHEN ({a[1]} > lat) <> ({b[1]} > lat) AND lon < ({b[0]} - ({a[0]})) * (lat - ({a[1]})) / ({b[1]} - ({a[1]})) + ({a[0]}) THEN 1 ELSE 0 END" for a, b in zip(ring, ring[1:])]
    return f"({' + '.join(hits)}) % 2 = 1"


@query("join_region_semi", f"SELECT c_custkey FROM {_PLACES} WHERE {_in_region_sql()}")
def join_region_semi(spark, sf):
    return places(spark, sf).where(point_in(F.col("lon"), F.col("lat"), edge_array(_REGION))).select("c_custkey")


@query("join_region_anti", f"SELECT c_custkey FROM {_PLACES} WHERE NOT ({_in_region_sql()})")
def join_region_anti(spark, sf):
    return places(spark, sf).where(~point_in(F.col("lon"), F.col("lat"), edge_array(_REGION))).select("c_custkey")


@query("join_radius_anti", f"SELECT a.vec_id AS a_id FROM {_VEC} a WHERE NOT EXISTS (SELECT 1 FROM {_VEC} b WHERE b.label > 4 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01 * 0.01)")
def join_radius_anti(spark, sf):
    return joins.radius_join(_vectors(spark, sf, "a"), _vectors(spark, sf, "b").where("b_label > 4").drop("b_label"), 0.01, "ax", "ay", "bx", "by", "left_anti").select("a_id")


@query("asof_stops", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 'c' WHEN l_quantity >= 15 THEN 'b' WHEN l_quantity >= 5 THEN 'a' END AS v FROM lineitem")
def asof_stops(spark, sf):
    return table(spark, sf, "lineitem").select(*_LINE, joins.latest_stop(F.col("l_quantity"), [(5, "a"), (15, "b"), (40, "c")]).alias("v"))


@query("asof_join", "SELECT e.event_id, (SELECT max_by(v.event_id, v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.event_id <= e.event_id) AS view_id FROM events e WHERE e.event_type = 'click'")
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id")
    views = e.where("event_type = 'view'").select("event_id", "user_id", F.col("event_id").alias("view_id"))
    return joins.asof_join(clicks, views, "event_id", ["user_id"], ["view_id"]).select("event_id", "view_id")


@query("state_left_join", "SELECT e.event_id, c.c_mktsegment AS segment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 0")
def state_left_join(spark, sf):
    held = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return joins.with_state(table(spark, sf, "events").select("event_id", "user_id"), held, ["user_id"]).select("event_id", "segment")


# -- clusters and pyramids

_CLUSTERS = cluster.Options(max_zoom=4)


def _levels(spark, sf) -> DataFrame:
    p = places(spark, sf).select((F.col("c_custkey") - 1).alias("i"), "lon", "lat")
    return cluster.hierarchy(p, "lon", "lat", "i", _CLUSTERS)


def _cluster_sql() -> str:
    """Each level from the one below it: in order of index, a point that no taker has near takes; each point goes to the least
    taker near it; takers, in order, are the next level."""
    o = _CLUSTERS
    s = "least(1, greatest(0, 0.5 - 0.25 * ln((1 + sin(lat * pi() / 180)) / (1 - sin(lat * pi() / 180))) / pi()))"
    parts = [f"l{o.max_zoom + 1} AS MATERIALIZED (SELECT c_custkey - 1 AS index, c_custkey - 1 AS id, lon / 360 + 0.5 AS x, {s} AS y, 1::HUGEINT AS n FROM {_PLACES})"]
    for z in range(o.max_zoom, o.min_zoom - 1, -1):
        r = repr(o.reach(z))
        near = lambda a, b: f"({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) <= {r} * {r}"
        parts += [
            f"c{z} AS MATERIALIZED (SELECT unnest(list_reduce(list([{{'i': index, 'x': x, 'y': y}}] ORDER BY index), lambda held, p: CASE WHEN len(list_filter(held, lambda c: {near('c', 'p[1]')})) = 0 THEN list_concat(held, p) ELSE held END)) AS c FROM l{z + 1})",
            f"t{z} AS MATERIALIZED (SELECT index, id, n, x, y, min(c.i) AS taker FROM l{z + 1} l, (SELECT c.i AS i, c.x AS x, c.y AS y FROM c{z}) c WHERE {near('l', 'c')} GROUP BY index, id, n, l.x, l.y)".replace("index, id, n, x, y, min", "index, id, n, l.x, l.y, min"),
            f"s{z} AS MATERIALIZED (SELECT taker, sum(n) AS total, sum(floor(x * {2**52})::HUGEINT * n) AS wx, sum(floor(y * {2**52})::HUGEINT * n) AS wy FROM t{z} GROUP BY taker)",
            f"l{z} AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY s.taker) - 1)::BIGINT AS index, CASE WHEN total >= 2 THEN s.taker * 32 + {z + 1} ELSE t.id END AS id, CASE WHEN total >= 2 THEN wx::DOUBLE / total::DOUBLE / {2**52} ELSE t.x END AS x, CASE WHEN total >= 2 THEN wy::DOUBLE / total::DOUBLE / {2**52} ELSE t.y END AS y, total AS n FROM s{z} s JOIN t{z} t ON t.index = s.taker)",
        ]
    return "WITH " + ",\n".join(parts)


@query("cluster_levels", _cluster_sql() + " UNION ALL ".join(f" SELECT {z}::INT AS z, count(*) AS features, sum(n)::BIGINT AS points FROM l{z}" for z in range(_CLUSTERS.min_zoom, _CLUSTERS.max_zoom + 2)))
def cluster_levels(spark, sf):
    return _levels(spark, sf).groupBy("z").agg(F.count("*").alias("features"), F.sum("n").alias("points"))


@query("cluster_tile", _cluster_sql() + f""" SELECT id, round((x * 2 - o) * 512)::INT AS tile_x, round(y * 2 * 512)::INT AS tile_y, CASE WHEN n > 1 THEN n END::BIGINT AS point_count,
  CASE WHEN n <= 1 THEN NULL WHEN n < 1000 THEN n::VARCHAR END AS point_count_abbreviated
  FROM l1, (SELECT unnest([0, 2]) AS o) WHERE y BETWEEN {-40 / 512 / 2!r} AND {(1 + 40 / 512) / 2!r} AND CASE o WHEN 0 THEN x BETWEEN {-40 / 512 / 2!r} AND {(1 + 40 / 512) / 2!r} ELSE x BETWEEN {1 - 40 / 512 / 2!r} AND 1.0 END""")
def cluster_tile(spark, sf):
    return cluster.with_properties(cluster.tile(_levels(spark, sf), 1, 0, 0, _CLUSTERS)).select("id", "tile_x", "tile_y", "point_count", "point_count_abbreviated")


@query("cluster_children", _cluster_sql() + " UNION ALL ".join(f" SELECT {z + 1}::INT AS z, s.taker * 32 + {z + 1} AS parent_id, count(*) AS children, sum(n)::BIGINT AS points FROM t{z} t JOIN s{z} s ON t.taker = s.taker WHERE total >= 2 GROUP BY s.taker" for z in range(_CLUSTERS.min_zoom, _CLUSTERS.max_zoom + 1)))
def cluster_children(spark, sf):
    levels = _levels(spark, sf)
    return levels.where("parent_id <> 0").groupBy("z", "parent_id").agg(F.count("*").alias("children"), F.sum("n").alias("points"))


@query("cluster_abbreviated", "SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN o_orderkey::VARCHAR WHEN o_orderkey < 10000 THEN printf('%.1fk', (o_orderkey / 1000.0)::DOUBLE) ELSE printf('%.0fk', (o_orderkey / 1000.0)::DOUBLE) END AS v FROM orders")
def cluster_abbreviated(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", cluster.abbreviated(F.col("o_orderkey")).alias("v"))


@query("pyramid_minmax", " UNION ALL ".join(f"SELECT {k}::INT AS level, (x >> {k})::INT AS cx, (y >> {k})::INT AS cy, min(c_acctbal) AS low, max(c_acctbal) AS high FROM (SELECT c_acctbal, {_tile_sql(5)[0]} AS x, {_tile_sql(5)[1]} AS y FROM {_PLACES}) GROUP BY 1, 2, 3" for k in range(4)))
def pyramid_minmax(spark, sf):
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 5)
    cells = places(spark, sf).groupBy(x.alias("cx"), y.alias("cy")).agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    return dem.pyramid(cells, 3)


@query("elevation_decode", "SELECT l_orderkey, l_linenumber, round((l_partkey % 256) * 6553.6 + (l_suppkey % 256) * 25.6 + l_quantity * 0.1 - 10000, 6) AS h FROM lineitem")
def elevation_decode(spark, sf):
    h = dem.elevation(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(*_LINE, F.round(h, 6).alias("h"))


# -- order


@query("sort_key_topk", "SELECT o_orderkey, o_custkey, place FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def sort_key_topk(spark, sf):
    return ordered.top_k(table(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice"), 3, "o_orderkey").select("o_orderkey", "o_custkey", F.col("place").cast("long"))


@query("sort_key_reverse_ties", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber DESC) AS place FROM lineitem")
def sort_key_reverse_ties(spark, sf):
    # several rows may share a line number here, so they are told apart first
    df = table(spark, sf, "lineitem").select(*_LINE, "l_discount")
    return ordered.sort_rank(df, F.col("l_discount"), "l_linenumber", ["l_orderkey"], reverse_ties=True).select(*_LINE, F.col("place").cast("long"))


@query("runs_collapse", "WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run, event_type")
def runs_collapse(spark, sf):
    r = ordered.runs(table(spark, sf, "events"), ["user_id"], "event_id", [F.col("event_type")])
    return r.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("lru_running_sum", "SELECT event_id, running FROM (SELECT event_id, sum(length(props)) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events) WHERE running > 20000")
def lru_running_sum(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_id").alias("accessed"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("url"), F.length("props").cast("long").alias("bytes"), F.lit(0).alias("pins"))
    return catalog.evicted(r, 20000).select(F.col("accessed").alias("event_id"), "running")


@query("query_dedupe_order", "SELECT event_id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events) WHERE event_type = 'view' OR n = 1")
def query_dedupe_order(spark, sf):
    e = table(spark, sf, "events").withColumn("name", F.when(F.col("event_type") != "view", F.col("user_id")))
    return ordered.deduplicated(e, ["event_type"], "name", [F.col("event_id")]).select("event_id")


@query("draw_order", "SELECT event_id, pass::VARCHAR AS pass, row_number() OVER (PARTITION BY event_type ORDER BY pass, event_id)::INT AS slot FROM (SELECT event_id, event_type, unnest(CASE WHEN value > 50 THEN ['opaque', 'translucent'] ELSE ['translucent'] END) AS pass FROM events)")
def draw_order(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "layer")
    passes = F.when(F.col("value") > 50, F.array(F.lit("opaque"), F.lit("translucent"))).otherwise(F.array(F.lit("translucent")))
    return ordered.draw_order(e, passes, ["event_id"]).select("event_id", "pass", "slot")


@query("counters_flat", "SELECT user_id, event_type, count(*) AS n, count(*) > 1 AS duplicated FROM events GROUP BY 1, 2")
def counters_flat(spark, sf):
    return ordered.counters(table(spark, sf, "events"), ["user_id", "event_type"])


# -- streams, in batch form


def _log(spark, sf) -> DataFrame:
    """A log of announcements and uses made from lineitem."""
    li = table(spark, sf, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = F.when(F.col("l_linenumber") == 1, "announce").when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "A"), "retire").when(F.col("l_linestatus") == "O", "use").otherwise("release")
    return li.select(seq.alias("seq"), kind.alias("kind"), (F.col("l_partkey") % 500).alias("geometry"), (F.col("l_suppkey") % 4).alias("view"), F.col("l_shipdate").cast("date").cast("string").alias("payload")).groupBy("seq").agg(F.min(F.struct("kind", "geometry", "view", "payload")).alias("r")).select("seq", "r.*")


# rows that share a number count once: the least one
_LOG = "SELECT DISTINCT ON (seq) * FROM (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber = 1 THEN 'announce' WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'retire' WHEN l_linestatus = 'O' THEN 'use' ELSE 'release' END AS kind, l_partkey % 500 AS geometry, l_suppkey % 4 AS view, l_shipdate::DATE::VARCHAR AS payload FROM lineitem) ORDER BY seq, kind, geometry, view, payload"
_LIVE = f"l AS ({_LOG}), r AS (SELECT geometry, max(seq) AS ended FROM l WHERE kind = 'retire' GROUP BY geometry), v AS (SELECT l.* FROM l LEFT JOIN r ON l.geometry = r.geometry WHERE r.ended IS NULL OR l.seq > r.ended)"


@query("latest_wins", "SELECT user_id, max(event_id) AS seq, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_wins(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_id", "seq")
    return state.latest(e, ["user_id"], ["value", "event_type"])


@query("seq_landing", "SELECT event_id FROM (SELECT event_id, (event_id * 7919) % 1000 AS seq, max((event_id * 7919) % 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM events) WHERE held IS NULL OR seq >= held")
def seq_landing(spark, sf):
    e = table(spark, sf, "events").withColumn("seq", (F.col("event_id") * 7919) % 1000)
    return state.landed(e, ["user_id"], "event_id", "seq").select("event_id")


@query("damage_gate", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS n, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR value > 90 OR length(event_type) <> length(b)")
def damage_gate(spark, sf):
    e = table(spark, sf, "events").withColumns({"camera": F.length("event_type").cast("double"), "dirty": F.col("value") > 90})
    return state.gated(e, ["user_id"], "event_id", ["camera"], "dirty").select("event_id")


# opacities in thirds: each frame moves them by one
@query("fades", """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, value > 40 AS placed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT key, seq, placed, n, CASE WHEN placed THEN 1 ELSE 0 END AS thirds FROM e WHERE n = 1
    UNION ALL SELECT e.key, e.seq, e.placed, e.n, CASE WHEN e.placed THEN least(3, r.thirds + 1) ELSE greatest(0, r.thirds - 1) END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
  SELECT key, seq, thirds, NOT placed AND thirds = 0 AS evicted FROM r""")
def fades(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("value") > 40).alias("placed"), F.lit(100.0).alias("elapsed_ms"))
    f = state.fades(e)
    # a step of 100 of 300 ms, three of which may leave a last bit
    return f.select("key", "seq", F.round(F.col("opacity") * 3).cast("int").alias("thirds"), (F.col("evicted") | (F.col("opacity") < 1e-9) & (F.col("opacity") > 0)).alias("evicted"))


@query("frame_changes", "WITH b AS (SELECT c_custkey AS k, c_mktsegment AS c FROM customer WHERE c_acctbal < 7000), n AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'X' ELSE c_mktsegment END AS c FROM customer WHERE c_acctbal > 2000) SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'released' WHEN b.k IS NULL THEN 'announced' WHEN b.c <> n.c THEN 'changed' ELSE 'kept' END AS change FROM b FULL JOIN n ON b.k = n.k")
def frame_changes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("c"), "c_acctbal")
    now = c.where("c_acctbal > 2000").withColumn("c", F.when(F.col("c_acctbal") > 5000, "X").otherwise(F.col("c")))
    return state.frame_changes(c.where("c_acctbal < 7000"), now, ["k"], "c")


@query("stable_ids", "WITH p AS (SELECT c_custkey AS k, (c_custkey * 2)::BIGINT AS id FROM customer WHERE c_acctbal < 6000), t AS (SELECT max(id) AS top FROM p), n AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 1000) SELECT n.k, coalesce(p.id, (SELECT top FROM t) + row_number() OVER (PARTITION BY p.id IS NULL ORDER BY n.k))::BIGINT AS id FROM n LEFT JOIN p ON n.k = p.k")
def stable_ids(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    prior = c.where("c_acctbal < 6000").select("k", (F.col("k") * 2).alias("id"))
    return state.stable_ids(c.where("c_acctbal > 1000").select("k"), prior, ["k"])


# -- the catalog


def _catalog(spark, sf) -> tuple[DataFrame, DataFrame]:
    claims = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("region_id"), F.col("l_orderkey").cast("string").alias("url")).distinct()
    responses = table(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("url"), F.floor("o_totalprice").alias("bytes"))
    return claims, responses


_CLAIMS = "(SELECT DISTINCT l_suppkey % 10 AS region_id, l_orderkey::VARCHAR AS url FROM lineitem)"
_RESPONSES = "(SELECT o_orderkey::VARCHAR AS url, floor(o_totalprice)::BIGINT AS bytes FROM orders WHERE o_orderstatus <> 'O')"


@query("catalog_progress", f"SELECT region_id, count(*) AS required, count(r.url) AS completed, coalesce(sum(r.bytes), 0)::BIGINT AS bytes FROM {_CLAIMS} c LEFT JOIN {_RESPONSES} r ON c.url = r.url GROUP BY region_id")
def catalog_progress(spark, sf):
    return catalog.progress(*_catalog(spark, sf))


@query("catalog_pins", f"SELECT r.url, r.bytes, count(c.url) AS pins FROM {_RESPONSES} r LEFT JOIN {_CLAIMS} c ON r.url = c.url GROUP BY r.url, r.bytes")
def catalog_pins(spark, sf):
    claims, responses = _catalog(spark, sf)
    return catalog.pinned(responses, claims).select("url", "bytes", "pins")


@query("catalog_upsert", f"SELECT r.url, r.bytes FROM {_RESPONSES} r JOIN orders o ON r.url = o.o_orderkey::VARCHAR WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey::VARCHAR, 1::BIGINT FROM orders WHERE o_orderpriority = '1-URGENT'")
def catalog_upsert(spark, sf):
    _, responses = _catalog(spark, sf)
    new = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("url"), F.lit(1).cast("long").alias("bytes"))
    return catalog.upserted(responses, new, ["url"])


@query("catalog_region_delete", f"SELECT r.url, count(c.url) AS pins FROM {_RESPONSES} r LEFT JOIN (SELECT * FROM {_CLAIMS} WHERE region_id <> 3) c ON r.url = c.url GROUP BY r.url")
def catalog_region_delete(spark, sf):
    claims, responses = _catalog(spark, sf)
    regions = claims.select(F.col("region_id").alias("id")).distinct()
    _, left = catalog.region_deleted(regions, claims, 3)
    return catalog.pinned(responses, left).select("url", "pins")


@query("catalog_prune", f"SELECT region_id, url FROM {_CLAIMS} WHERE region_id <> 2 OR url IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_totalprice > 100000)")
def catalog_prune(spark, sf):
    claims, _ = _catalog(spark, sf)
    keep = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").cast("string").alias("url"))
    return catalog.pruned(claims, 2, keep)


# -- geometry, labels, the box query


def _shapes(spark, sf) -> DataFrame:
    """A square ring and a line around each customer's place."""
    p = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    r = (F.col("c_custkey") % 7 + 1).cast("double")
    ring = F.array(p(-r, -r), p(r, -r), p(r, r), p(-r, r), p(-r, -r))
    return places(spark, sf).select("c_custkey", "lon", "lat", r.alias("r"), ring.alias("ring"))


@query("ring_area_length", "SELECT c_custkey, (4 * r * r)::DOUBLE AS area, (8 * r)::DOUBLE AS length FROM (SELECT c_custkey, (c_custkey % 7 + 1)::DOUBLE AS r FROM customer)")
def ring_area_length(spark, sf):
    return _shapes(spark, sf).select("c_custkey", geometry.signed_area(F.col("ring")).alias("area"), geometry.line_length(F.col("ring")).alias("length"))


@query("clip_rings", f"SELECT c_custkey, (least(lon + r, 90) - greatest(lon - r, -90)) * (least(lat + r, 45) - greatest(lat - r, -45)) AS area FROM (SELECT *, (c_custkey % 7 + 1)::DOUBLE AS r FROM {_PLACES}) WHERE lon + r > -90 AND lon - r < 90 AND lat + r > -45 AND lat - r < 45")
def clip_rings(spark, sf):
    c = dealt(_shapes(spark, sf), "c_custkey").select("c_custkey", geometry.clip_rings_column(F.array("ring"), -90.0, -45.0, 90.0, 45.0).alias("rings"))
    return c.where(F.size("rings") > 0).select("c_custkey", geometry.signed_area(F.col("rings")[0]).alias("area")).where("area > 0")


@query("label_point", f"SELECT c_custkey, lon AS x, lat AS y FROM {_PLACES}")
def label_point(spark, sf):
    p = geometry.label_point_column(F.array("ring"), 0.1)
    return dealt(_shapes(spark, sf), "c_custkey").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 1).alias("x"), F.round("p.y", 1).alias("y"))


@query("label_text", "SELECT c_custkey, c_name || ' (' || c_mktsegment || ') {open' AS label FROM customer")
def label_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", label_template("{c_name} ({c_mktsegment}){absent} {open", Fields.of(c)).alias("label"))


_TOUCH = "b.x0 <= p[1].x1 AND p[1].x0 <= b.x1 AND b.y0 <= p[1].y1 AND p[1].y0 <= b.y1"


@query("placement", f"""WITH c AS (SELECT c_custkey % 8 AS view, c_custkey AS ord, c_custkey AS id, {{'id': c_custkey, 'x0': lon, 'y0': lat, 'x1': lon + 12, 'y1': lat + 4, 'allow': c_custkey % 11 = 0}} AS box FROM {_PLACES}),
  g AS (SELECT view, list_reduce(list([box] ORDER BY ord, id), lambda held, p: CASE WHEN p[1].allow OR len(list_filter(held, lambda b: {_TOUCH})) = 0 THEN list_concat(held, p) ELSE held END) AS placed FROM c GROUP BY view)
  SELECT c.view, ord, id, list_contains(list_transform(placed, lambda b: b.id), id) AS placed FROM c JOIN g ON c.view = g.view""")
def placement(spark, sf):
    c = places(spark, sf).select((F.col("c_custkey") % 8).alias("view"), F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("id"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 12).alias("x1"), (F.col("lat") + 4).alias("y1"), (F.col("c_custkey") % 11 == 0).alias("allow_overlap"), F.lit(False).alias("ignore_placement"))
    return labels.placement(c)


@query("merged_lines")
def merged_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    lines = li.select((F.col("l_orderkey") % 20).alias("tile"), F.lit("roads").alias("layer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("text"), F.array(a, b).cast("array<double>").alias("xs"), F.array(b, a).cast("array<double>").alias("ys"))
    return labels.merged_lines(lines).select("tile", "layer", "ord", "text", F.size("xs").alias("points"))


@query("glyph_ranges", "SELECT DISTINCT lang AS stack, (ascii(c) // 256)::INT AS range FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def glyph_ranges(spark, sf):
    return labels.glyph_ranges(table(spark, sf, "documents").select(F.col("lang").alias("stack"), "text"))


@query("ramp_bake", "SELECT i::INT AS i, i / 256.0::DOUBLE AS t, i / 256.0::DOUBLE AS r, 0::DOUBLE AS g, 1 - i / 256.0::DOUBLE AS b, i / 256.0::DOUBLE AS a FROM (SELECT unnest(range(256)) AS i)")
def ramp_bake(spark, sf):
    return bake(spark, ["interpolate", ["linear"], ["heatmap-density"], 0, "rgba(0, 0, 255, 0)", 1, "red"])


def _drawn(spark, sf) -> DataFrame:
    s = _shapes(spark, sf)
    common = lambda layer, index, kind: [F.lit(layer).alias("layer"), F.lit(index).alias("layer_index"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") % 1000).alias("id"), F.lit("customers").alias("source"), F.lit(kind).alias("kind")]
    none = [F.lit(None).cast("double").alias(c) for c in ("line_width", "gap_width", "line_offset")]
    fills = s.select(*common("areas", 0, "fill"), F.lit("Polygon").alias("geom_type"), F.array(F.array("ring")).alias("geom"), *none, F.lit(None).cast("double").alias("radius"), F.lit(None).cast("double").alias("stroke"))
    point = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    circles = s.select(*common("dots", 1, "circle"), F.lit("Point").alias("geom_type"), F.array(F.array(F.array(point))).alias("geom"), *none, F.lit(3.0).alias("radius"), F.lit(1.0).alias("stroke"))
    return fills.unionByName(circles)


_HITS = f"""WITH s AS (SELECT *, (c_custkey % 7 + 1)::DOUBLE AS r, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 1000 END AS id FROM {_PLACES}),
h AS (SELECT 'areas' AS layer, id, c_custkey AS ord FROM s WHERE lon - r <= 30 AND lon + r >= 10 AND lat - r <= 20 AND lat + r >= 5
UNION ALL SELECT 'dots', id, c_custkey FROM s WHERE pow(lon - greatest(10, least(30, lon)), 2) + pow(lat - greatest(5, least(20, lat)), 2) <= 16)
SELECT layer, id, ord FROM (SELECT *, row_number() OVER (PARTITION BY layer, id ORDER BY ord) AS n FROM h) WHERE id IS NULL OR n = 1"""


@query("box_query", _HITS)
def box_query_rows(spark, sf):
    return box_query.query(_drawn(spark, sf), 10, 5, 30, 20).select("layer", "id", "ord")


@query("box_query_geojson", f"""SELECT row_number() OVER (ORDER BY layer DESC, ord) AS place, '{{"type":"Feature","id":' || coalesce(id::VARCHAR, 'null') || ',"geometry":null,"properties":{{"kind":"' || CASE layer WHEN 'dots' THEN 'circle' ELSE 'fill' END || '"}}}}' AS feature FROM ({_HITS})""")
def box_query_geojson(spark, sf):
    return box_query.as_geojson(box_query.query(_drawn(spark, sf), 10, 5, 30, 20), ["kind"])


@query(
    "announce_use_join",
    f"WITH {_LIVE}, a AS (SELECT geometry, arg_max(payload, seq) AS payload FROM v WHERE kind = 'announce' GROUP BY geometry), u AS (SELECT geometry, view, max(seq) AS use_seq FROM v WHERE kind IN ('use', 'release') GROUP BY geometry, view HAVING arg_max(kind, seq) = 'use') SELECT u.geometry, u.view, u.use_seq, a.payload FROM u JOIN a ON u.geometry = a.geometry",
)
def announce_use_join(spark, sf):
    return state.joined(_log(spark, sf))


@query("release_retire", f"WITH {_LIVE} SELECT geometry, count(*) AS live FROM v GROUP BY geometry")
def release_retire(spark, sf):
    return state.unretired(_log(spark, sf)).groupBy("geometry").agg(F.count("*").alias("live"))


@query("sweep_statistics", f"SELECT frame, count(*) AS uses, count(DISTINCT (x, y)) AS distinct_tiles, count(*) - count(DISTINCT (x, y)) AS shared FROM (SELECT c_custkey % 16 AS frame, {_tile_sql(3)[0]} AS x, {_tile_sql(3)[1]} AS y FROM {_PLACES}) GROUP BY frame")
def sweep_statistics(spark, sf):
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 3)
    return tiles.sweep_statistics(places(spark, sf).select((F.col("c_custkey") % 16).alias("frame"), F.lit(0).alias("view"), F.lit(3).alias("z"), x.alias("x"), y.alias("y")))


from . import feature_queries, frame_queries, source_queries  # noqa: E402, F401  register their queries
