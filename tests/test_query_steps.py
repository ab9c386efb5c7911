"""Steps of registered queries that must not grow faster than their input, and queries against their SQL on small tables."""

import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("steps")
    n = range(300)
    pq.write_table(pa.table({"c_custkey": pa.array(n, pa.int64()), "c_name": [f"Customer#{i:09d}" for i in n], "c_nationkey": pa.array([i % 25 for i in n], pa.int32()), "c_acctbal": [i * 1.25 - 90 for i in n], "c_mktsegment": [("BUILDING", "MACHINERY", "AUTOMOBILE")[i % 3] for i in n]}), d / "customer.parquet")
    # pairs of suppliers whose positions repeat, the first two of them 2040 pairs apart
    k = [*range(12), *range(4080, 4092), *range(8160, 8164), 61200, 61201]
    pq.write_table(pa.table({"s_suppkey": pa.array(k, pa.int64())}), d / "supplier.parquet")
    n = range(120)
    pq.write_table(pa.table({"p_partkey": pa.array(n, pa.int64()), "p_size": pa.array([i * 7 % 50 + 1 for i in n], pa.int32())}), d / "part.parquet")
    return str(d)


def agrees(spark, tables, name) -> int:
    """Names and rows of a query are those of its SQL; returns the number of rows."""
    con = pytest.importorskip("duckdb").connect()
    got = e.queries()[name](spark, tables)
    for t in set(re.findall(r"(?:FROM|JOIN|,) (customer|supplier|part|orders|lineitem|events|documents)\b", e.oracle_sql()[name])):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    want = con.execute(e.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description]
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(want.fetchall())
    return len(rows)


def carried(df) -> list[set[str]]:
    """The columns that each unfolding of a plan takes along."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"Generate posexplode\(.*?\), \[(.*?)\]", plan)]


def test_annotations_take_no_document_along(spark, tables):
    """A row a feature that holds its whole document makes the square of a document's size."""
    found = carried(e.queries()["annotations_from_geojson"](spark, tables))
    assert found and not any({"v", "doc"} & c for c in found)
    assert agrees(spark, tables, "annotations_from_geojson") == 300


def test_geojson_points_take_no_document_along(spark, tables):
    found = carried(e.queries()["geojson_points"](spark, tables))
    assert found and not any({"v", "doc"} & c for c in found)
    assert agrees(spark, tables, "geojson_points") == 300


def test_merged_lines_hold_no_objects(spark):
    """The same lines as merge_lines() makes of a tile, without all of a tile's lines as objects in one task."""
    import random

    from vexel.operators import labels

    r = random.Random(5)
    lines = []
    for i in range(400):
        xs = [r.randint(0, 6) + r.random() * 0.9 for _ in range(r.choice([0, 1, 2, 2, 2, 3, 4]))]
        lines.append((i % 3, "roads", i * 7 % 1000, r.choice(["a", "a", "b", "", None]), xs, [float(r.randint(-3, 3)) for _ in xs]))
    df = spark.createDataFrame(lines, "tile long, layer string, ord long, text string, xs array<double>, ys array<double>")
    got = labels.merged_lines(df)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for tile in range(3):
        own = sorted((x for x in lines if x[0] == tile), key=lambda x: x[2])
        want += [(tile, own[i][2], own[i][3], points) for i, points in labels.merge_lines([(x[3], list(zip(x[4], x[5]))) for x in own])]
    assert sorted(want, key=lambda x: x[:2]) == sorted(((x.tile, x.ord, x.text, list(zip(x.xs, x.ys))) for x in got.collect()), key=lambda x: x[:2])
    assert max(len(x[3]) for x in want) > 8 and got.schema == df.schema


def test_cluster_pairs_apart(spark, tables):
    """Pairs stand apart however many suppliers there are."""
    assert agrees(spark, tables, "cluster_pairs") == 3


def test_cluster_pairs_by_rounds_apart(spark, tables):
    assert agrees(spark, tables, "cluster_pairs_by_rounds") == 2


def test_cluster_tile_features_of_repeated_positions(spark, tables):
    """Points of one position are features of their own below all clusters."""
    assert agrees(spark, tables, "cluster_tile_features") == 30


#: Queries whose rows a Python kernel takes one by one, and their rows on the small tables.
KERNELS = {
    "clip_lines_apart": 600,
    "line_anchors_turning": 120,
    "clip_lines_measured": 120,
    "line_anchors": 480,
    "simplified_lines": 105,
    "geojson_wound": 120,
    "polygon_cells": 4308,
    "label_point": 300,
    "rings_subdivided": 120,
    "rings_classified": 120,
}


@pytest.mark.parametrize("name", KERNELS)
def test_kernels_get_rows_dealt_out(spark, tables, name):
    """A table of one row group is read by one task; what a kernel does with each row is for all cores."""
    plan = e.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    python = [at for at, line in enumerate(plan.splitlines()) if "ArrowEvalPython" in line]
    assert python and any("REPARTITION_BY_NUM" in line for line in plan.splitlines()[python[-1] :])
    assert agrees(spark, tables, name) == KERNELS[name]


class Taken(Exception):
    """A function given to Arrow workers, taken in place of running it."""


class Taking:
    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        raise Taken(f)


def test_decoded_tiles_leave_in_batches(spark, tables):
    """Tiles of one batch of input aren't decoded all at once."""
    from vexel.sources import mvt

    with pytest.raises(Taken) as taken:
        mvt.features(Taking())
    tile = mvt.encode([{"name": "a", "features": [{"id": i, "type": "LineString", "geom": [[(0, i), (3, 4)]], "props": {"n": float(i)}} for i in range(5000)]}])
    batch = pa.RecordBatch.from_pydict({"z": [1, 1], "x": [0, 1], "y": [0, 0], "data": [tile, tile]})
    out = list(taken.value.args[0](iter([batch])))
    assert max(b.num_rows for b in out) < 5000 and sum(b.num_rows for b in out) == 10_000
    assert out[-1].to_pylist()[-1] == {"z": 1, "x": 1, "y": 0, "source_layer": "a", "extent": 4096, "feature_index": 4999, "id": 4999, "geom_type": "LineString", "geom": [[[{"x": 0.0, "y": 4999.0}, {"x": 3.0, "y": 4.0}]]], "props_json": '{"n": 4999.0}', "error": None}
    assert agrees(spark, tables, "mvt_lines") == 120


def test_tiles_are_built_in_batches(spark, tables, monkeypatch):
    """Layers in order, features in theirs, over bounds of batches."""
    from vexel.sources import mvt

    monkeypatch.setattr(mvt, "FEATURE_ROWS", 7)
    with pytest.raises(Taken) as taken:
        mvt.build(type("Grouped", (), {"groupBy": lambda self, *_: self, "applyInArrow": Taking.mapInArrow})())
    rows = [{"z": 2, "x": 1, "y": 3, "source_layer": "ba"[i % 2], "feature_index": 99 - i, "id": i, "geom_type": "Polygon", "geom": [[[{"x": float(a), "y": float(b)} for a, b in ((0, 0), (i, 0), (i, 9), (0, 0))]]], "props_json": '{"n": %d}' % (i % 3)} for i in range(50)]
    layers = mvt.decode(taken.value.args[0](pa.Table.from_pylist(rows))["data"][0].as_py())
    assert [x["name"] for x in layers] == ["a", "b"]
    assert [f["id"] for x in layers for f in x["features"]] == [*range(49, 0, -2), *range(48, -1, -2)]
    assert layers[0]["features"][0] == {"id": 49, "type": "Polygon", "geom": [[(0, 0), (49, 0), (49, 9), (0, 0)]], "props": {"n": 1.0}}
    assert agrees(spark, tables, "mvt_polygons") == 120


def test_captures_are_joined_from_pieces(spark, tables, monkeypatch):
    """The same bytes as encode() makes, without a log's records as objects in one task; records leave in batches."""
    from vexel.sources import capture

    rows = [(f"log-{i % 3}", i * 37 % 1000, i * 90_000_017 % (1 << 32), None if i % 5 == 0 else b"r" * (i % 300), None if i % 7 == 0 else bytes([i % 256, 0, 255])) for i in range(1000)]
    got = capture.write(spark.createDataFrame(rows, "name string, seq long, kind long, record binary, payload binary"))
    assert "InArrow" not in got._jdf.queryExecution().executedPlan().toString()
    want = {f"log-{n}": capture.encode([(k, r or b"", p or b"") for name, _, k, r, p in sorted(rows, key=lambda r: r[1]) if name == f"log-{n}"]) for n in range(3)}
    data = {r.name: bytes(r.data) for r in got.collect()}
    assert data == want
    monkeypatch.setattr(capture, "RECORD_ROWS", 100)
    with pytest.raises(Taken) as taken:
        capture.read(Taking())
    out = list(taken.value.args[0](iter([pa.RecordBatch.from_pydict({"name": list(data), "data": list(data.values())})])))
    assert max(b.num_rows for b in out) == 100 and sum(b.num_rows for b in out) == 1000
    assert [r["seq"] for b in out for r in b.to_pylist() if r["name"] == "log-1"] == [*range(333)]


def test_glyph_ranges_unfold_ranges(spark):
    """A row for each range of a text, not for each of its characters."""
    from vexel.operators import labels

    texts = {"a": ["plain", "", None, "\x00\x7fÿ"], "b": ["Ā wide 東京 東", "😀"], "c": ["漢字"], "d": [""]}
    got = labels.glyph_ranges(spark.createDataFrame([(k, t) for k, v in texts.items() for t in v], "stack string, text string"))
    assert "Generate explode(array_distinct(" in got._jdf.queryExecution().executedPlan().toString()
    want = {(k, ord(c) // 256) for k, v in texts.items() for t in v for c in t or ""}
    assert sorted((r.stack, r.range) for r in got.collect()) == sorted(want)


def test_glyphs_covered_by_ranges(spark, tables):
    pq.write_table(pa.table({"lang": ["en", "en", "ja", "xx"], "text": ["aé", "Ā", "a東", None]}), f"{tables}/documents.parquet")
    plan = e.queries()["glyphs_covered"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(array_distinct(" in plan
    assert agrees(spark, tables, "glyphs_covered") == 2


def test_colors_get_rows_dealt_out(spark, tables):
    """What makes a color's text and reads it takes long for a row: all cores share a table of one row group."""
    plan = e.queries()["expr_to_color"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("lower(") <= 4
    assert agrees(spark, tables, "expr_to_color") == 300


def test_bezier_is_found_once(spark):
    """A curve's parameter is found once a row, and is what halving an interval of two ends gives."""
    from vexel.lang.compiler import compile_expression
    from vexel.lang.values import Fields

    df = spark.range(-5, 62).selectExpr("case when id < 61 then cast(id as double) end as x")
    v = compile_expression(["interpolate", ["cubic-bezier", 0.42, 0, 0.58, 1], ["number", ["get", "x"], 7], 0, 0, 50, 1], Fields.of(df))
    rows = df.select("x", v.col.alias("v"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("aggregate(") == 1

    def at(t, a, b):
        return ((1 - 3 * b + 3 * a) * t + (3 * b - 6 * a)) * t * t + 3 * a * t

    for r in rows.collect():
        x, low, high = (7.0 if r.x is None else r.x) / 50, 0.0, 1.0
        for _ in range(30):
            middle = (low + high) / 2
            low, high = (middle, high) if at(middle, 0.42, 0.58) < x else (low, middle)
        assert r.v == (0.0 if x <= 0 else 1.0 if x >= 1 else at((low + high) / 2, 0.0, 1.0))
