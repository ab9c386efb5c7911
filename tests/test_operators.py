"""Streams, the catalog, labels, ordered operators, documents and the box query."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vexel.operators import catalog, labels, ordered
from vexel.plans import box_query
from vexel.plans.document import Plan, Style, StyleError, label_template, substituted
from vexel.plans.properties import SPECS, resolve
from vexel.lang.values import ABSENT, ExpressionError, Fields
from vexel.sources import geojson
from vexel.streaming import state


def run_stream(spark, tmp_path, rows, schema, transform, mode="append", parts=3):
    """Rows in files, one micro-batch a file, through a streaming query to the end."""
    src = tmp_path / "in"
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(src))
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_latest_wins(spark, tmp_path):
    rows = [(i % 3, i, f"p{i}") for i in range(12)]
    schema = "k int, seq long, p string"
    batch = state.latest(spark.createDataFrame(rows, schema), ["k"], ["p"])
    want = {(0, 9, "p9"), (1, 10, "p10"), (2, 11, "p11")}
    assert {tuple(r) for r in batch.collect()} == want
    got = run_stream(spark, tmp_path, rows, schema, lambda s: state.latest(s, ["k"], ["p"]), mode="complete")
    assert {tuple(r) for r in got.collect()} == want


def test_upserts_by_batch(spark, tmp_path):
    sink = state.upsert_sink(str(tmp_path / "s"), ["k"], ["p"])
    a, b = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "k int, seq long, p string"), spark.createDataFrame([(1, 3, "c")], "k int, seq long, p string")
    sink(a, 0)
    sink(b, 1)
    sink(b, 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "s" / "v=1")).select("k", "seq", "p").collect()} == {(1, 3, "c"), (2, 2, "b")}


def test_late_landings_are_dropped(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 4, i, rng.randrange(30)) for i in range(60)]
    schema = "k int, arrival long, seq long"
    want, held = set(), {}
    for k, a, s in rows:
        if k not in held or s >= held[k]:
            want.add(a)
        held[k] = max(s, held.get(k, s))
    assert {r.arrival for r in state.landed(spark.createDataFrame(rows, schema), ["k"], "arrival", "seq").collect()} == want
    # files are read in the order of their names, so all rows come in one batch
    got = run_stream(spark, tmp_path, rows, schema, lambda s: state.landing_stream(s, ["k"], "arrival", "seq"), parts=1)
    assert {r.arrival for r in got.collect()} == want


LOG = [(1, "use", 7, 1, None), (2, "announce", 7, None, "a"), (3, "use", 7, 2, None), (4, "release", 7, 1, None), (5, "announce", 7, None, "b"), (6, "announce", 8, None, "x"), (7, "use", 8, 1, None), (8, "retire", 8, None, None), (9, "use", 8, 3, None), (10, "use", 9, 1, None)]
LOG_SCHEMA = "seq long, kind string, geometry long, view long, payload string"


def test_announcements_meet_uses(spark, tmp_path):
    batch = state.joined(spark.createDataFrame(LOG, LOG_SCHEMA)).collect()
    assert {tuple(r) for r in batch} == {(7, 2, 3, "b")}
    got = [tuple(r) for r in run_stream(spark, tmp_path, LOG, LOG_SCHEMA, state.joining_stream, parts=1).collect()]
    assert sorted(got) == [(7, 1, 1, "a"), (7, 2, 3, "a"), (7, 2, 3, "b"), (8, 1, 7, "x")]


def test_quiet_frames_emit_nothing(spark, tmp_path):
    nan = float("nan")
    rows = [(1, 0, nan, False), (1, 1, nan, False), (1, 2, 1.0, False), (1, 3, 1.0, True), (1, 4, 1.0, False), (2, 0, 5.0, False)]
    schema = "v int, seq long, z double, dirty boolean"
    want = {(1, 0), (1, 2), (1, 3), (2, 0)}
    df = spark.createDataFrame(rows, schema)
    assert {(r.v, r.seq) for r in state.gated(df, ["v"], "seq", ["z"], "dirty").collect()} == want
    got = run_stream(spark, tmp_path, rows, schema, lambda s: state.gating_stream(s, ["v"], "seq", ["z"], "dirty"), parts=1)
    assert {(r.v, r.seq) for r in got.collect()} == want
    parked = spark.createDataFrame([(1, i, 2.0, False) for i in range(50)], schema)
    assert state.gated(parked, ["v"], "seq", ["z"], "dirty").count() == 1


def test_fades(spark, tmp_path):
    rows = [("a", i, i < 4 or i > 8, 100.0) for i in range(11)] + [("b", 0, False, 50.0)]
    schema = "key string, seq long, placed boolean, elapsed_ms double"
    want, opacity = {}, {}
    for k, s, p, ms in rows:
        opacity[k] = state.faded(opacity.get(k, 0.0), p, ms)
        want[k, s] = (round(opacity[k], 9), not p and opacity[k] == 0)
    got = {(r.key, r.seq): (round(r.opacity, 9), r.evicted) for r in state.fades(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and got["a", 3][0] == 1.0
    stream = run_stream(spark, tmp_path, rows, schema, state.fading_stream, parts=1)
    assert {(r.key, r.seq): (round(r.opacity, 9), r.evicted) for r in stream.collect()} == want


def test_rects_and_levels():
    assert state.merged_rects([(0, 0, 2, 2), (1, 1, 2, 2), (0, 0, 5, 5)]) == [(0, 0, 5, 5)]
    assert state.merged_rects([(i * 10, 0, i * 10 + 1, 1) for i in range(5)]) == [(0, 0, 41, 1)]
    assert state.latched([3.5, 4.05, 4.2, 3.95, 3.85]) == [3, 3, 4, 4, 3]


def test_identities(spark):
    now, prior = spark.createDataFrame([("b",), ("a",), ("z",)], "k string"), spark.createDataFrame([("a", 4), ("q", 9)], "k string, id long")
    assert {tuple(r) for r in state.stable_ids(now, prior, ["k"]).collect()} == {("a", 4), ("b", 10), ("z", 11)}
    assert {tuple(r) for r in state.stable_ids(now, prior.limit(0), ["k"]).collect()} == {("a", 0), ("b", 1), ("z", 2)}


# -- the catalog

RESPONSES = "url string, bytes long, expires long, accessed long, must_revalidate boolean"


def test_catalog(spark):
    r = spark.createDataFrame([("a", 10, 5, 1, False), ("b", 20, 50, 2, False), ("c", 30, None, 3, True), ("d", 40, 5, 4, False)], RESPONSES)
    claims = spark.createDataFrame([(1, "a"), (1, "x"), (2, "a"), (2, "c")], "region_id int, url string")
    assert {tuple(x) for x in catalog.progress(claims, r).collect()} == {(1, 2, 1, 10), (2, 2, 2, 40)}
    p = catalog.pinned(r, claims)
    assert {x.url: x.pins for x in p.collect()} == {"a": 2, "b": 0, "c": 1, "d": 0}
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("z",)], "url string")
    assert {x.url: x.action for x in catalog.served(asked, p, F.lit(10)).collect()} == {"a": "serve", "b": "serve", "c": "revalidate", "d": "revalidate", "z": "fetch"}
    assert tuple(catalog.sizes(p).first()) == (4, 100, 2, 40)
    assert {x.url for x in catalog.evicted(p, 45).collect()} == {"b"} and catalog.evicted(p, 60).count() == 0
    new = spark.createDataFrame([("a", 1, 9, 9, False), ("a", 2, 9, 8, False), ("n", 3, 9, 9, False)], RESPONSES)
    assert {x.url: x.bytes for x in catalog.upserted(r, new, ["url"], F.col("accessed")).collect()} == {"a": 1, "b": 20, "c": 30, "d": 40, "n": 3}
    assert {x.url: x.expires for x in catalog.refreshed(r, spark.createDataFrame([("a", 99)], "url string, expires long")).collect()}["a"] == 99
    assert catalog.claimed(claims, spark.createDataFrame([(1, "a"), (1, "new")], "region_id int, url string")).count() == 5
    assert catalog.unclaimed(claims, claims.where("region_id = 1")).count() == 2
    regions, left = catalog.region_deleted(spark.createDataFrame([(1,), (2,)], "id int"), claims, 1)
    assert regions.count() == 1 and {x.url for x in left.collect()} == {"a", "c"}
    assert {(x.region_id, x.url) for x in catalog.pruned(claims, 1, spark.createDataFrame([("x",)], "url string")).collect()} == {(1, "x"), (2, "a"), (2, "c")}


def test_eviction_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(f"u{i:04}", rng.randrange(100), 0, rng.randrange(50), False, 0) for i in range(500)]
    p = spark.createDataFrame(rows, RESPONSES + ", pins int")
    total, want = 0, set()
    for r in sorted(rows, key=lambda r: (r[3], r[0]), reverse=True):
        total += r[1]
        if total > 9000:
            want.add((r[0], total))
    assert {(x.url, x.running) for x in catalog.evicted(p, 9000).collect()} == want


def test_region_plan(spark):
    from vexel.spatial.projection import box_cover, tile_count

    sets = [{"tiles": ["t/{z}/{x}/{y}"], "minzoom": 1, "maxzoom": 2, "scheme": "xyz"}, {"tiles": [], "minzoom": 0, "maxzoom": 9, "scheme": "xyz"}]
    box = (-10.0, -10.0, 10.0, 10.0)
    plan = catalog.region_plan(sets[:1], 0, 5, lambda z: box_cover(spark, *box, z), spark.createDataFrame([("style",), ("style",)], "url string"))
    n, precise = catalog.estimate(sets, 0, 5, lambda z: tile_count(*box, z))
    assert plan.count() == n + 1 == 9 and not precise


# -- labels


def test_greedy_placement_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i % 2, i, i, x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.uniform(1, 90), y + 20, rng.random() < 0.1, rng.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "view long, ord long, id long, x0 double, y0 double, x1 double, y1 double, allow_overlap boolean, ignore_placement boolean")
    got = {r.id: r.placed for r in labels.placement(df).collect()}
    taken = {0: [], 1: []}
    for v, _, i, x0, y0, x1, y1, allow, ignore in rows:
        ok = allow or not any(x0 <= t[2] and t[0] <= x1 and y0 <= t[3] and t[1] <= y1 for t in taken[v])
        assert got[i] == ok
        if ok and not ignore:
            taken[v].append((x0, y0, x1, y1))


def test_optional_parts(spark):
    rows = [(0, 0, 1, "text", 0, 0, 10, 10, False, False, False), (0, 1, 2, "icon", 20, 0, 30, 10, False, False, False), (0, 1, 2, "text", 5, 5, 15, 15, False, False, True), (0, 2, 3, "icon", 40, 0, 50, 10, False, False, False), (0, 2, 3, "text", 5, 5, 15, 15, False, False, False), (0, 3, 4, "icon", 45, 0, 55, 10, False, False, False)]
    df = spark.createDataFrame(rows, "view long, ord long, id long, kind string, x0 int, y0 int, x1 int, y1 int, allow_overlap boolean, ignore_placement boolean, optional boolean")
    got = {(r.id, r.kind): r.placed for r in labels.symbol_placement(df).collect()}
    assert got == {(1, "text"): True, (2, "icon"): True, (2, "text"): False, (3, "icon"): False, (3, "text"): False, (4, "icon"): True}


def test_line_merging():
    a, b, c = [(0, 0), (1, 0)], [(1, 0), (2, 0)], [(2, 0), (3, 0)]
    assert labels.merge_lines([("x", a), ("x", c), ("x", b)]) == [(0, [(0, 0), (1, 0), (2, 0), (3, 0)])]
    assert labels.merge_lines([("x", a), ("y", b), ("", c)]) == [(0, a), (1, b), (2, c)]
    assert len(labels.merge_lines([("x", a), ("x", [(1, 0), (0, 0)])])) >= 1


def test_cross_tile_identities(spark):
    symbols = spark.createDataFrame([("a", 0.0, 0.0, 0), ("a", 1.0, 0.0, 1), ("a", 50.0, 0.0, 2), ("b", 0.0, 0.0, 3)], "key string, x double, y double, ord long")
    prior = spark.createDataFrame([("a", 2.0, 2.0, 10), ("a", 90.0, 0.0, 11)], "key string, x double, y double, cross_id long")
    got = {r.ord: r.cross_id for r in labels.cross_tile_ids(symbols, prior).collect()}
    assert got[0] == 10 and sorted([got[1], got[2], got[3]]) == [12, 13, 14]


def test_line_breaks_are_the_best_ones():
    rng = random.Random(4)

    def cost(w, breaks, target):
        at, total = 0, 0.0
        for b in [*breaks, len(w) - 1]:
            width = sum(w[at : b + 1])
            r = (width - target) ** 2
            total += r / 2 if b == len(w) - 1 and width < target else r
            at = b + 1
        return total

    for _ in range(40):
        w = [rng.randrange(1, 9) for _ in range(9)]
        can = [rng.random() < 0.6 for _ in w]
        most = rng.randrange(8, 30)
        got = labels.line_breaks(w, can, most)
        total = sum(w)
        if total <= most:
            assert got == []
            continue
        target = total / -(-total // most)
        places = [i for i, c in enumerate(can[:-1]) if c]
        best = min(cost(w, [p for k, p in enumerate(places) if m >> k & 1], target) for m in range(1 << len(places)))
        assert math.isclose(cost(w, got, target), best) and all(can[i] for i in got)


def test_shelves():
    assert labels.shelf_pack([(5, 10), (5, 8), (5, 10), (9, 9)], 10, 20) == [(0, 0), (5, 0), (0, 10), None]


def test_glyph_ranges(spark):
    t = spark.createDataFrame([("f", "aé漢"), ("f", ""), ("g", "b")], "stack string, text string")
    need = labels.glyph_ranges(t)
    assert {tuple(r) for r in need.collect()} == {("f", 0), ("f", ord("漢") // 256), ("g", 0)}
    assert {tuple(r) for r in labels.owed(need, spark.createDataFrame([("f", 0)], "stack string, range int")).collect()} == {("f", ord("漢") // 256), ("g", 0)}


# -- order


def test_runs_only_join_neighbors(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", "b", "a", None, None, "a"])], "i int, v string").withColumn("g", F.lit(0))
    assert [r.run for r in ordered.runs(df, ["g"], "i", [F.col("v")]).orderBy("i").collect()] == [1, 1, 2, 3, 4, 4, 5]


def test_thinning(spark):
    c = [(float(x), 0.0, 1.0) for x in (0, 1, 1.2, 5, 5.5, 5.6)]
    df = spark.createDataFrame([(c,)], "c array<struct<x:double,y:double,r:double>>")
    assert [p.x for p in df.select(ordered.thinned(F.col("c")).alias("t")).first().t] == [0.0, 1.2, 5.0, 5.6]


def test_sort_ranks(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan")), (3, 1.0)], "i int, k double").withColumn("g", F.lit(0))
    at = lambda **o: {r.i: r.place for r in ordered.sort_rank(df, F.col("k"), "i", ["g"], **o).collect()}
    assert at() == {1: 1, 0: 2, 3: 3, 2: 4} and at(reverse_ties=True) == {1: 1, 3: 2, 0: 3, 2: 4}


def test_unnamed_rows_are_all_kept(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 2), (4, None, 2)], "i int, name string, o int").withColumn("g", F.lit(0))
    assert {r.i for r in ordered.deduplicated(df, ["g"], "name", [F.col("o")]).collect()} == {2, 3, 4}


# -- documents

STYLE = {
    "version": 8,
    "schema": {"big": {"default": 9}},
    "sources": {"s": {"type": "geojson"}, "unused": {"type": "vector"}},
    "layers": [
        {"id": "bg", "type": "background"},
        {"id": "a", "type": "circle", "source": "s", "filter": [">=", ["get", "k"], 50], "paint": {"circle-radius": ["+", ["get", "k"], ["config", "big"]], "circle-color": ["interpolate", ["linear"], ["zoom"], 0, "black", 10, "white"]}, "layout": {"circle-sort-key": ["-", ["get", "k"]]}},
        {"id": "b", "type": "circle", "source": "s", "filter": ["in", "t", "x"], "maxzoom": 5.5, "paint": {"circle-radius": {"property": "k", "stops": [[0, 1], [100, 11]]}}},
        {"id": "bad", "type": "circle", "source": "s", "paint": {"circle-radius": ["+", "a", 1]}},
        {"id": "notdriven", "type": "line", "source": "s", "paint": {"line-dasharray": ["get", "k"]}},
        {"id": "far", "type": "circle", "source": "s", "minzoom": 9},
    ],
}


def test_plan(spark):
    df = spark.createDataFrame([(0, 60.0, "x"), (1, 70.0, "y"), (2, None, "x")], "feature_index long, k double, t string")
    style = Style.parse(json.dumps(STYLE))
    assert style.used_sources() == ["s"]
    p = Plan(style, {"s": df}, 5.0)
    assert set(p.rejected) == {"bad", "notdriven"} and [c.layer.id for c in p.compiled] == ["a", "b"]
    a = p.layer("a").select("feature_index", F.col("circle-radius").alias("r"), F.col("circle-color.r").alias("c"), F.col("circle-opacity").alias("o")).collect()
    assert {(x.feature_index, x.r, x.c, x.o) for x in a} == {(0, 69.0, 0.5, 1.0), (1, 79.0, 0.5, 1.0)}
    # a missing value is the function's default: the property's own
    assert {x.feature_index: round(x.r, 9) for x in p.layer("b").select("feature_index", F.col("circle-radius").alias("r")).collect()} == {0: 7.0, 2: 5.0}
    assert [(x.layer, x.feature_index) for x in p.draw_order([]).collect()] == [("a", 1), ("a", 0), ("b", 0), ("b", 2)]


def test_documents_that_do_not_parse():
    for bad in ({"version": 7}, {"version": 8, "layers": [{"id": "x", "type": "fill"}, {"id": "x", "type": "line"}]}):
        with pytest.raises(StyleError):
            Style.parse(bad)
    assert substituted(["config", "a", "i"], {"a@i": 1}) == 1 and substituted({"x": [["config", "nope"]]}, {}) == {"x": [None]}


def test_property_table():
    assert len(SPECS["line", "paint"]) == 12 and len(SPECS["symbol", "paint"]) == 14 and len(SPECS["fill-extrusion", "paint"]) == 8
    spec = SPECS["circle", "paint"]["circle-radius"]
    assert resolve(spec, ABSENT, Fields()).binding == "constant"
    assert resolve(spec, ["zoom"], Fields(zoom=1.0)).binding == "zoom"
    assert resolve(spec, ["+", ["get", "x"], 1], Fields()).binding == "feature"
    assert resolve(spec, ["interpolate", ["linear"], ["zoom"], 0, ["get", "x"], 1, 2], Fields(zoom=1.0)).binding == "composite"
    with pytest.raises(ExpressionError):
        resolve(SPECS["heatmap", "paint"]["heatmap-opacity"], ["get", "x"], Fields())


def test_label_templates(spark):
    df = spark.createDataFrame([("A", 2.0), (None, 1.5)], "n string, v double")
    got = [r.t for r in df.select(label_template("{n}-{v} {nope}{", Fields.of(df)).alias("t")).collect()]
    assert got == ["A-2 {", "-1.5 {"]


# -- the box query


def drawn(spark):
    sq = lambda x, y, r: [[[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]]]
    rows = [
        ("fill", 0, 0, 1, "fill", sq(5.0, 5.0, 1.0), None, None, None, None, None),
        ("fill", 0, 1, 2, "fill", sq(5.0, 5.0, 50.0), None, None, None, None, None),
        ("fill", 0, 2, None, "fill", [[[(100.0, 100.0), (101.0, 100.0), (101.0, 101.0), (100.0, 100.0)]]], None, None, None, None, None),
        ("line", 1, 3, 3, "line", [[[(0.0, 13.0), (10.0, 13.0)]]], 6.0, None, None, None, None),
        ("line", 1, 4, 4, "line", [[[(0.0, 13.0), (10.0, 13.0)]]], 1.0, None, None, None, None),
        ("line", 1, 5, 5, "line", [[[(0.0, 13.0), (10.0, 13.0)]]], 1.0, 4.0, None, None, None),
        ("dot", 2, 6, None, "circle", [[[(14.0, 10.0)]]], None, None, None, 3.0, 1.0),
        ("dot", 2, 7, None, "circle", [[[(14.0, 10.0)]]], None, None, None, 3.0, 1.0),
        ("dot", 2, 8, 8, "circle", [[[(14.1, 10.0)]]], None, None, None, 3.0, 1.0),
        ("dot", 2, 9, 9, "circle", [[[(9.0, 9.0)]]], None, None, None, 1.0, 0.0),
        ("dot", 2, 10, 9, "circle", [[[(9.0, 9.0)]]], None, None, None, 1.0, 0.0),
    ]
    s = "layer string, layer_index int, ord long, id long, kind string, geom array<array<array<struct<x:double,y:double>>>>, line_width double, gap_width double, line_offset double, radius double, stroke double"
    return spark.createDataFrame(rows, s).withColumn("source", F.lit("s"))


def test_box_query(spark):
    hits = box_query.query(drawn(spark), 10, 10, 0, 0)
    assert [(r.layer, r.ord) for r in box_query.ordered(hits).collect()] == [("dot", 6), ("dot", 7), ("dot", 9), ("line", 3), ("line", 5), ("fill", 0), ("fill", 1)]
    assert {r.layer for r in box_query.query(drawn(spark), 0, 0, 10, 10, ["line"]).collect()} == {"line"}
    rows = box_query.as_geojson(hits, ["layer"]).orderBy("place").collect()
    doc = json.loads(geojson.collection([r.feature for r in rows]))
    assert [f["properties"]["layer"] for f in doc["features"]] == ["dot"] * 3 + ["line"] * 2 + ["fill"] * 2
    assert all(f["geometry"] is None for f in doc["features"])


def test_registered_queries_are_whole(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


