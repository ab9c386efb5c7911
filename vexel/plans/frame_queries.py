"""Registered queries over frames, captures, the catalog's life cycle, seams, labels, and the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import catalog, frames, labels, tiles
from ..operators.scratch import cut
from ..sources import capture, dem
from ..spatial import cluster, cover, geometry, projection
from .registry import query
from .source_queries import _BORDERED, _ground
from .tables import _PLACES, _tile_sql, dealt, places, table

_COVER = f"SELECT DISTINCT {_tile_sql(4)[0]} AS x, {_tile_sql(4)[1]} AS y FROM {_PLACES}"

# -- logs


def _log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("log-"), (F.col("user_id") % 7).cast("string")).alias("name"), F.col("event_id").alias("seq"), (F.col("event_id") % 13).alias("kind"), F.col("event_type").cast("binary").alias("record"), F.col("props").cast("binary").alias("payload"))


@query("capture_round_trip", "SELECT 'log-' || user_id % 7 AS name, (row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) - 1)::BIGINT AS seq, (event_id % 13)::BIGINT AS kind, event_type AS record, coalesce(props, '') AS payload FROM events")
def capture_round_trip(spark, sf):
    """Logs written as captures and read again."""
    rows = capture.read(capture.write(_log(spark, sf)))
    return rows.select("name", "seq", "kind", F.col("record").cast("string").alias("record"), F.col("payload").cast("string").alias("payload"))


@query("capture_sizes", "SELECT 'log-' || user_id % 7 AS name, (32 + sum(16 + length(event_type) + coalesce(length(props), 0)))::INT AS bytes FROM events GROUP BY user_id % 7")
def capture_sizes(spark, sf):
    return capture.write(_log(spark, sf)).select("name", F.octet_length("data").alias("bytes"))


@query("ring_fifo", "SELECT event_id, (sum(length(event_type)) OVER (ORDER BY event_id) - length(event_type))::BIGINT AS \"offset\", (sum(length(event_type)) OVER (ORDER BY event_id) - 4096)::BIGINT AS waits_for FROM events")
def ring_fifo(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return frames.fifo(e, "event_id", F.length("event_type"), 4096).drop("event_type")


@query("ring_flush", """WITH s AS (SELECT o_orderkey AS key, o_orderkey % 3 > 0 AS dirty, (o_orderkey % 100)::BIGINT AS in_flight_until, length(o_orderpriority) AS n FROM orders),
  r AS (SELECT *, sum(CASE WHEN dirty AND in_flight_until <= 60 THEN n ELSE 0 END) OVER (ORDER BY key) AS through FROM s)
  SELECT key, CASE WHEN NOT dirty THEN 'clean' WHEN in_flight_until > 60 THEN 'deferred' WHEN through <= 5000 THEN 'written' ELSE 'blocked' END AS what FROM r""")
def ring_flush(spark, sf):
    n = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(n.alias("key"), (n % 3 > 0).alias("dirty"), (n % 100).cast("long").alias("in_flight_until"), F.length("o_orderpriority").alias("n"))
    return frames.flushed(s, 60, 5000, F.col("n")).select("key", "what")


@query("ring_groups", "SELECT event_id FROM events e WHERE event_id % 10 BETWEEN 1 AND 8 AND EXISTS (SELECT 1 FROM events c WHERE c.event_id // 10 = e.event_id // 10 AND c.event_id % 10 = 9) AND (event_id // 10) % 4 <> 0")
def ring_groups(spark, sf):
    """Frames of ten records: one begins, one commits or, of each fourth frame, aborts."""
    n = F.col("event_id")
    kind = F.when(n % 10 == 0, "begin").when((n % 10 == 9) & (F.floor(n / 10) % 4 == 0), "abort").when(n % 10 == 9, "commit").otherwise("data")
    return frames.committed(table(spark, sf, "events").select("event_id", F.floor(n / 10).alias("frame"), kind.alias("kind"))).select("event_id")


@query("ring_traffic", "SELECT event_id, (event_id * 7 + event_id // 50 - coalesce(lag(event_id * 7 + event_id // 50) OVER (ORDER BY event_id), 0))::BIGINT AS bytes FROM events")
def ring_traffic(spark, sf):
    n = F.col("event_id")
    return frames.traffic(table(spark, sf, "events").select("event_id", (n * 7 + F.floor(n / 50)).alias("head")), "event_id", "head").select("event_id", "bytes")


@query("feature_states", """WITH c AS (SELECT event_id AS seq, user_id % 50 AS id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS key, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 5)::VARCHAR END AS value FROM events),
  d AS (SELECT id, max(seq) AS cleared FROM c WHERE key IS NULL GROUP BY id), l AS (SELECT id, key, max(seq) AS seq, arg_max(value, seq) FILTER (true) AS v, arg_max_null(value, seq) AS value FROM c WHERE key IS NOT NULL GROUP BY id, key)
  SELECT l.id::VARCHAR AS id, '{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}' AS state FROM l LEFT JOIN d ON l.id = d.id WHERE value IS NOT NULL AND (cleared IS NULL OR seq > cleared) GROUP BY l.id""")
def feature_states(spark, sf):
    n = F.col("event_id")
    c = table(spark, sf, "events").select(n.alias("seq"), F.lit("s").alias("source"), (F.col("user_id") % 50).cast("string").alias("id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("key"), F.when(n % 7 != 0, (n % 5).cast("string")).alias("value"))
    return frames.feature_states(c).select("id", "state")


@query("states_restated", "SELECT c_custkey::VARCHAR AS id FROM customer WHERE (c_custkey % 3 = 0) <> (c_custkey % 2 = 0) OR (c_custkey % 6 = 0 AND c_custkey % 4 = 0)")
def states_restated(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("s").alias("source"), F.col("c_custkey").cast("string").alias("id"), "c_custkey")
    before = c.where("c_custkey % 3 = 0").withColumn("state", F.lit('{"a":1}'))
    now = c.where("c_custkey % 2 = 0").withColumn("state", F.when(F.col("c_custkey") % 4 == 0, F.lit('{"a":2}')).otherwise(F.lit('{"a":1}')))
    return frames.restated(before, now).select("id")


@query("content_displaceable", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 AND ((o_orderkey % 20) / 20.0 BETWEEN 0.01 AND 0.29 OR ((o_orderkey + 1) % 20) / 20.0 BETWEEN 0.01 AND 0.29)")
def content_displaceable(spark, sf):
    n = F.col("o_orderkey")
    live = table(spark, sf, "orders").select(n.alias("key"), n.alias("id"), F.when(n % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("users"), F.array((n % 20).cast("int"), ((n + 1) % 20).cast("int")).alias("refs"))
    slabs = spark.range(20).select(F.col("id").cast("int").alias("slab"), (F.col("id") / 20).alias("fraction"))
    return frames.displaceable(live, live.where("key % 5 = 0"), slabs, 1, 0.3).select("key")


@query("indexes_current", "SELECT 'kept' AS what, c_custkey AS cross_id FROM customer WHERE c_nationkey < 20 UNION ALL SELECT 'released', c_custkey FROM customer WHERE c_nationkey >= 20")
def indexes_current(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("bucket"), F.col("c_custkey").alias("cross_id"))
    kept, released = frames.current(c, c.where("bucket < 20").select("bucket").distinct())
    return kept.select(F.lit("kept").alias("what"), "cross_id").unionByName(released.select(F.lit("released").alias("what"), "cross_id"))


@query("content_acknowledged", "SELECT event_id FROM events WHERE event_id * 3 <= 9000")
def content_acknowledged(spark, sf):
    return frames.acknowledged(table(spark, sf, "events").withColumn("written_until", F.col("event_id") * 3), 9000).select("event_id")


@query("depth_slots", "SELECT p_partkey, greatest(0, 9 - least(9, greatest(0, p_size - 3)))::INT AS slot FROM part")
def depth_slots(spark, sf):
    return table(spark, sf, "part").select("p_partkey", frames.depth_slot(F.col("p_size") - 3, F.lit(10)).cast("int").alias("slot"))


# -- the catalog's life cycle


def _responses(spark, sf) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf, "orders").select(n.cast("string").alias("url"), (n % 1000).cast("long").alias("bytes"), F.lit(200).alias("status"), (n % 500).cast("long").alias("expires"), (n % 200).cast("long").alias("accessed"))


_RESPONSES = "(SELECT o_orderkey, o_orderkey::VARCHAR AS url, (o_orderkey % 1000)::BIGINT AS bytes, (o_orderkey % 500)::BIGINT AS expires, (o_orderkey % 200)::BIGINT AS accessed FROM orders)"


@query("catalog_lookup", f"SELECT 'found' AS what, url, accessed FROM {_RESPONSES} WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'kept', url, CASE WHEN o_orderkey % 10 = 0 AND 200 - accessed > 60 THEN 200 ELSE accessed END FROM {_RESPONSES}")
def catalog_lookup(spark, sf):
    """Responses by url; their access times move only where they are older than the granularity."""
    r = _responses(spark, sf)
    found, kept = catalog.looked_up(r, r.where("cast(url as long) % 10 = 0").select("url"), 200)
    return found.select(F.lit("found").alias("what"), "url", "accessed").unionByName(kept.select(F.lit("kept").alias("what"), "url", "accessed"))


@query("catalog_deleted", f"SELECT url FROM {_RESPONSES} WHERE o_orderkey % 7 <> 0")
def catalog_deleted(spark, sf):
    r = _responses(spark, sf)
    return catalog.deleted(r, r.where("cast(url as long) % 7 = 0")).select("url")


@query("regions_created", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey), r_name FROM region")
def regions_created(spark, sf):
    held = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    new = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"))
    return catalog.listed(catalog.regions_created(held, new))


@query("catalog_stored", f"SELECT url, CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE bytes END::BIGINT AS bytes, (CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS pins FROM {_RESPONSES}")
def catalog_stored(spark, sf):
    """What a region has fetched is stored and claimed at once; what it claims of others' counts as well."""
    r = _responses(spark, sf)
    claims = r.where("cast(url as long) % 6 = 0").select(F.lit(1).alias("region_id"), "url")
    stored, _ = catalog.stored(r, claims, r.where("cast(url as long) % 4 = 0").withColumn("bytes", F.lit(7).cast("long")), 2)
    return stored.select("url", "bytes", F.col("pins").cast("long").alias("pins"))


@query("catalog_migrated", "SELECT count(*) AS n, count(*) FILTER (true) AS plain, 0::BIGINT AS pins FROM orders")
def catalog_migrated(spark, sf):
    m = catalog.migrated(_responses(spark, sf).drop("expires"), {"must_revalidate": ("boolean", False), "pinned": ("long", 0), "bytes": ("long", -1), "expires": ("long", None)})
    return m.where("bytes >= 0 and expires is null").agg(F.count("*").alias("n"), F.count(F.when(~F.col("must_revalidate"), 1)).alias("plain"), F.sum("pinned").alias("pins"))


@query("region_downloaded", f"SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'complete' END AS state, count(*) AS n FROM {_RESPONSES} GROUP BY 1")
def region_downloaded(spark, sf):
    r = _responses(spark, sf)
    n = F.col("url").cast("long")
    answers = r.where(n % 3 > 0).withColumn("status", F.when(n % 5 == 0, 404).otherwise(200))
    return catalog.downloaded(r, answers).groupBy("state").agg(F.count("*").alias("n"))


@query("region_refreshed", f"SELECT 'response' AS what, url, CASE WHEN o_orderkey % 3 < 2 THEN 999 ELSE expires END::BIGINT AS expires, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE bytes END::BIGINT AS bytes FROM {_RESPONSES} UNION ALL SELECT 'claim', url, NULL, NULL FROM {_RESPONSES} WHERE o_orderkey % 2 = 0")
def region_refreshed(spark, sf):
    r = _responses(spark, sf)
    n = F.col("url").cast("long")
    answers = r.select("url", F.when(n % 3 == 0, 200).when(n % 3 == 1, 304).otherwise(500).alias("status"), F.lit(999).cast("long").alias("expires"), F.lit(1).cast("long").alias("bytes"))
    now, claims = catalog.region_refreshed(r, r.select(F.lit(1).alias("region_id"), "url"), 1, r.where(n % 2 == 0), answers)
    none = F.lit(None).cast("long")
    return now.select(F.lit("response").alias("what"), "url", "expires", "bytes").unionByName(claims.select(F.lit("claim").alias("what"), "url", none.alias("expires"), none.alias("bytes")))


# -- seams


@query("dem_seams", "SELECT x::INT AS x, y::INT AS y FROM (SELECT unnest(range(4)) AS x), (SELECT unnest(range(4)) AS y) WHERE NOT (x = 1 AND y = 1) AND (x IN (3, 0, 1) AND y IN (1, 2, 3) OR x IN (1, 2, 3) AND y IN (0, 1))")
def dem_seams(spark, sf):
    """What the tiles (0, 2) and (2, 0) border on, across the antimeridian as well."""
    g = _ground(spark).select("z", "x", "y").distinct()
    return dem.seams(g.where("x = 0 and y = 2 or x = 2 and y = 0"), g).select("x", "y")


@query("dem_reconciled", f"""WITH b AS {_BORDERED}, s AS (SELECT *, lag(h) OVER r AS w, lead(h) OVER r AS e FROM b WINDOW r AS (PARTITION BY x, y, py ORDER BY px)),
  t AS (SELECT *, w + 2 * h + e AS a, e - w AS c FROM s), u AS (SELECT *, lead(a) OVER k - lag(a) OVER k AS dy, lag(c) OVER k + 2 * c + lead(c) OVER k AS dx FROM t WINDOW k AS (PARTITION BY x, y, px ORDER BY py))
  SELECT x::INT AS x, y::INT AS y, px::INT AS px, py::INT AS py, dx / 80 AS dzdx, dy / 80 AS dzdy FROM u WHERE dx IS NOT NULL AND dy IS NOT NULL""")
def dem_reconciled(spark, sf):
    """Slopes made before a tile has landed, with the rings along its seams made anew, are those made after."""
    ground = _ground(spark)
    landed = ground.where("x = 2 and y = 2").select("z", "x", "y").distinct()
    before = dem.slopes(dem.bordered(ground.where("not (x = 2 and y = 2)"), 4), 10.0)
    own = dem.slopes(dem.bordered(ground, 4), 10.0).where("x = 2 and y = 2")
    return dem.reconciled(before.unionByName(own), ground, landed, 4, 10.0).select("x", "y", "px", "py", "dzdx", "dzdy")


@query("covering_zooms", "SELECT p_partkey, (p_size % 10 + 1)::INT AS images, greatest(0, floor(p_size % 10 + 0.5))::INT AS data FROM part")
def covering_zooms(spark, sf):
    z = F.col("p_size") % 10
    return table(spark, sf, "part").select("p_partkey", dem.covering_zoom(z + 0.25, 256).alias("images"), dem.covering_zoom(z + 0.5, 512, rounds=False).alias("data"))


# -- labels


@query("label_anchors", "SELECT p_partkey, i::INT AS attempt, ['left', 'top-right', 'center'][i + 1] AS anchor, [0.0, 1.0, 0.5][i + 1]::DOUBLE AS align_x, [0.5, 0.0, 0.5][i + 1]::DOUBLE AS align_y FROM part, (SELECT unnest(range(3)) AS i)")
def label_anchors(spark, sf):
    return labels.variable_anchors(table(spark, sf, "part").select("p_partkey"), ["left", "top-right", "center"])


@query("icons_fitted", "SELECT p_partkey, 1 - 2 * p_size - 3.0::DOUBLE AS \"left\", 1 + 2 * p_size + 4.0::DOUBLE AS \"right\", 2 - 5.0::DOUBLE AS top, 2 + 5.0::DOUBLE AS bottom FROM part")
def icons_fitted(spark, sf):
    n = F.col("p_size").cast("double")
    box = labels.fitted_icon(F.lit(20.0), F.lit(10.0), {"left": -n, "right": n, "top": F.lit(-4.0), "bottom": F.lit(4.0)}, {"left": 3.0, "right": 4.0, "top": 1.0, "bottom": 1.0}, (1.0, 2.0), "width", 2.0)
    return table(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in box.items()])


@query("lines_split", "SELECT p_partkey, substring(p_name, 1, 3) AS first, substring(p_name, 4) AS last, 2::INT AS lines FROM part WHERE length(p_name) > 3")
def lines_split(spark, sf):
    d = table(spark, sf, "part").where("length(p_name) > 3").select("p_partkey", labels.split_lines(F.col("p_name"), F.array(F.lit(0), F.lit(3), F.length("p_name"))).alias("l"))
    return d.select("p_partkey", F.col("l")[0].alias("first"), F.element_at("l", -1).alias("last"), F.size("l").alias("lines"))


@query("label_passes", "SELECT * FROM (VALUES (0, true, true), (1, false, true), (2, true, true), (3, false, false), (4, false, true)) v(layer, halo, fill)")
def label_passes(spark, sf):
    written = [("red", "white", 1.0), ("red", "rgba(0,0,0,0)", 2.0), (None, None, None), ("transparent", "white", 0.0), ("#000", "white", 0.0)]
    return spark.createDataFrame([(i, *labels.passes(*w)) for i, w in enumerate(written)], "layer int, halo boolean, fill boolean")


@query("circles_projected", "SELECT p_partkey, 100 + p_size * 0.5::DOUBLE AS x, 50 + 0.5::DOUBLE AS y, 1.5::DOUBLE AS r FROM part")
def circles_projected(spark, sf):
    c = F.array(F.struct(F.col("p_size").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(3.0).alias("r")))
    return table(spark, sf, "part").select("p_partkey", F.explode(labels.projected_circles(c, 0.5, F.lit(100.0), F.lit(50.0))).alias("c")).select("p_partkey", "c.x", "c.y", "c.r")


@query("text_shaped", "SELECT p_partkey, g::INT AS glyph, (g // 3)::INT AS line, CASE g % 3 WHEN 0 THEN -0.5 * (p_size * 3 + 3) WHEN 1 THEN -0.5 * (p_size * 3 + 3) + p_size ELSE -0.5 * (p_size * 3 + 3) + p_size * 2 + 1 END::DOUBLE AS x, ((g // 3) - 0.5) * 24::DOUBLE AS y FROM part, (SELECT unnest(range(6)) AS g)")
def text_shaped(spark, sf):
    """Six glyphs on two lines, each line's glyphs of the advances n, n + 1 and n + 2."""
    n = F.col("p_size").cast("double")
    g = labels.shaped(F.array(*[n + i % 3 for i in range(6)]), F.array(*[F.lit(i // 3) for i in range(6)]), 24.0)
    return table(spark, sf, "part").select("p_partkey", F.posexplode(g).alias("glyph", "g")).select("p_partkey", "glyph", "g.line", "g.x", "g.y")


@query("glyphs_along", "SELECT p_partkey, g::INT AS glyph, CASE WHEN p_size * g <= 100 THEN least(60, p_size * g) WHEN false THEN 0 END::DOUBLE AS x, CASE WHEN p_size * g <= 100 THEN greatest(0, p_size * g - 60) END::DOUBLE AS y FROM part, (SELECT unnest(range(5)) AS g)")
def glyphs_along(spark, sf):
    """Glyphs each n units along a line that goes 60 east, then 40 up; none stands beyond its end."""
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (60.0, 0.0), (60.0, 40.0))])
    at = labels.along(line, F.array(*[F.col("p_size") * float(g) for g in range(5)]))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(at).alias("glyph", "g")).select("p_partkey", "glyph", "g.x", "g.y")


@query("symbol_candidates", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS text, CASE WHEN p_size % 2 = 0 THEN p_brand END AS icon FROM part WHERE p_size % 3 > 0 OR p_size % 2 = 0")
def symbol_candidates(spark, sf):
    n = F.col("p_size")
    return labels.candidates(table(spark, sf, "part").select("p_partkey", "p_size", "p_name", "p_brand"), F.when(n % 3 > 0, F.col("p_name")).otherwise(F.lit("")), F.when(n % 2 == 0, F.col("p_brand"))).select("p_partkey", "text", "icon")


@query("glyphs_covered", "SELECT lang, bool_and(ascii(c) // 256 IN (0, 1)) AS covered FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang")
def glyphs_covered(spark, sf):
    """Whether the first two ranges are all that the texts of a language need."""
    r = labels.glyph_ranges(table(spark, sf, "documents").select(F.col("lang").alias("stack"), "text")).groupBy("stack").agg(F.collect_set("range").alias("wanted"))
    return r.select(F.col("stack").alias("lang"), labels.covered(F.col("wanted"), F.array(F.lit(0).cast("int"), F.lit(1).cast("int"))).alias("covered"))


@query("rings_subdivided", "SELECT p_partkey, count(*)::INT AS cells, sum((least(16 * (i + 1), p_partkey % 40 + p_size) - greatest(16 * i, p_partkey % 40)) * (least(16 * (j + 1), p_size) - 16 * j))::DOUBLE AS area FROM part, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) WHERE p_size > 0 AND 16 * i < p_partkey % 40 + p_size AND 16 * (i + 1) > p_partkey % 40 AND 16 * j < p_size GROUP BY p_partkey")
def rings_subdivided(spark, sf):
    """Squares parted by a grid: their parts' number, and the sum of their areas."""
    a, n = (F.col("p_partkey") % 40).cast("double"), F.col("p_size").cast("double")
    ring = F.array(*[F.struct((a + n * i).alias("x"), (n * j).alias("y")) for i, j in [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]])
    parts = dealt(table(spark, sf, "part").where("p_size > 0").select("p_partkey", "p_size"), "p_partkey")
    d = parts.select("p_partkey", F.explode(geometry.subdivided_column(ring, 16.0)).alias("c"))
    return d.groupBy("p_partkey").agg(F.count("*").cast("int").alias("cells"), F.sum(F.abs(geometry.signed_area(F.col("c.ring")))).alias("area"))


@query("tiles_at_zooms", f"SELECT DISTINCT 3::INT AS z, (x >> 1)::INT AS x, (y >> 1)::INT AS y FROM ({_COVER}) UNION ALL SELECT DISTINCT 5, (x * 2 + i)::INT, (y * 2 + j)::INT FROM ({_COVER}), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)")
def tiles_at_zooms(spark, sf):
    x, y = projection.tile_of(F.col("lon"), F.col("lat"), 4)
    return tiles.at_zooms(places(spark, sf).select(F.lit(4).alias("z"), x.alias("x"), y.alias("y")).distinct(), [3, 5])


@query("builds_matching", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 = o_orderkey % 2")
def builds_matching(spark, sf):
    n = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(n.alias("key"), (n % 3).alias("source"), (n % 2).alias("revision"))
    return tiles.matching(b, spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "source long, revision long")).select("key")


@query("tiles_evicted", "WITH f AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey <> 5) SELECT key FROM f WHERE n <= (SELECT count(*) - 1000 FROM orders)")
def tiles_evicted(spark, sf):
    """The least used tiles beyond a thousand, but those that are retained and the new one."""
    held = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("used"), (F.col("o_orderkey") % 4 == 0).alias("retained"))
    return tiles.evictable(held, 1000, 5).select("key")


@query("camera_published", "SELECT max(event_id) AS seq FROM events WHERE event_id % 2 = 0")
def camera_published(spark, sf):
    return frames.published(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "value")).select("seq")


# -- clusters


def _repeating(spark, sf) -> DataFrame:
    """Pairs of suppliers 0.01 degrees apart, at positions that repeat after 2040 pairs."""
    n = F.col("s_suppkey")
    pair = F.floor(n / 2)
    return table(spark, sf, "supplier").select(n.alias("index"), ((pair * 7) % 340 - 170 + (n % 2) * 0.01).cast("double").alias("lon"), ((pair * 11) % 120 - 60).cast("double").alias("lat"))


def _apart(spark, sf) -> DataFrame:
    """Pairs of suppliers 0.01 degrees apart, the pairs far from each other: those that would repeat positions stand between
    them, 0.06 degrees apart, in 15 columns and rows, which is room for 459,000 pairs."""
    again = F.floor(F.col("index") / (2 * 2040))
    return _repeating(spark, sf).withColumns({"lon": F.col("lon") + again % 15 * 0.06, "lat": F.col("lat") + F.floor(again / 15) % 15 * 0.06})


@query("cluster_pairs", "SELECT z::INT AS z, CASE WHEN z <= 10 THEN (SELECT count(DISTINCT s_suppkey // 2) FROM supplier) ELSE (SELECT count(*) FROM supplier) END AS points, (SELECT count(*) FROM supplier) AS leaves FROM (SELECT unnest([10, 14, 16]) AS z)")
def cluster_pairs(spark, sf):
    """Pairs join where the radius reaches over them and no farther."""
    o = cluster.Options(min_zoom=9, max_zoom=16)
    levels = cluster.hierarchy(_apart(spark, sf), "lon", "lat", "index", o)
    return levels.where("z in (10, 14, 16)").groupBy("z").agg(F.count("*").alias("points"), F.sum("n").alias("leaves"))


@query("cluster_pairs_by_rounds", "SELECT z::INT AS z, CASE WHEN z <= 10 THEN (SELECT count(DISTINCT s_suppkey // 2) FROM supplier) ELSE (SELECT count(*) FROM supplier) END AS points, (SELECT count(*) FROM supplier) AS leaves FROM (SELECT unnest([10, 12]) AS z)")
def cluster_pairs_by_rounds(spark, sf):
    """The same by rounds over cells, as for levels of any size."""
    o = cluster.Options(min_zoom=10, max_zoom=11)
    levels = cluster.hierarchy(_apart(spark, sf), "lon", "lat", "index", o, task_points=0)
    return levels.where("z in (10, 12)").groupBy("z").agg(F.count("*").alias("points"), F.sum("n").alias("leaves"))


@query("cluster_tile_features", "SELECT s_suppkey AS id, round(((s_suppkey // 2 * 7) % 340 - 170 + (s_suppkey % 2) * 0.01), 6)::DOUBLE AS lon, round(((s_suppkey // 2 * 11) % 120 - 60), 6)::DOUBLE AS lat, NULL::BIGINT AS point_count FROM supplier")
def cluster_tile_features(spark, sf):
    """The world's tiles of the level below all clusters, as features in degrees. Positions repeat, so levels above it have
    clusters; what the buffers of several tiles hold is one feature."""
    o = cluster.Options(min_zoom=0, max_zoom=0, radius=1e-6)
    levels = cut(cluster.hierarchy(_repeating(spark, sf), "lon", "lat", "index", o), "levels")
    rows = reduce(DataFrame.unionByName, [cluster.tile_features(levels, 1, x, y, o) for x in (0, 1) for y in (0, 1)])
    return rows.select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("point_count").cast("long").alias("point_count")).distinct()


# -- the engine


def _engine(spark, sf, zoom: float) -> Engine:
    e = Engine(spark, cover.View(lon=0.0, lat=0.0, zoom=zoom, width=1024, height=512))
    e.set_style({"version": 8, "sources": {"places": {}}, "layers": [
        {"id": "all", "type": "circle", "source": "places", "paint": {"circle-radius": ["case", ["boolean", ["feature-state", "hover"], False], 9, 4]}},
        {"id": "late", "type": "circle", "source": "places", "minzoom": 5},
        {"id": "broken", "type": "circle", "source": "places", "paint": {"circle-radius": ["nothing"]}},
    ]})
    p = places(spark, sf)
    point = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    e.set_source("places", p.select(F.col("c_custkey").alias("feature_index"), F.col("c_custkey").alias("id"), F.lit("Point").alias("geom_type"), F.array(F.array(F.array(point))).alias("geom"), F.to_variant_object(F.struct(F.col("c_name").alias("name"))).alias("props")))
    return e


@query("engine_status", "SELECT 'all,late' AS layers, 'broken' AS rejected, 1::BIGINT AS places")
def engine_status(spark, sf):
    s = _engine(spark, sf, 5.0).status()
    return spark.createDataFrame([(",".join(s["layers"]), ",".join(s["rejected"]), s["sources"]["places"])], "layers string, rejected string, places long")


@query("engine_frame", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 9 ELSE 4 END::DOUBLE AS radius FROM customer")
def engine_frame(spark, sf):
    """Features of a layer after states have been set, and some cleared."""
    e = _engine(spark, sf, 1.0)
    c = table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.lit(1).cast("long").alias("seq"), F.col("c_custkey").cast("string").alias("id"), F.lit("hover").alias("key"), F.lit("true").alias("value"), "c_custkey")
    e.set_feature_state("places", c.drop("c_custkey"))
    e.set_feature_state("places", c.where("c_custkey % 10 = 0").withColumn("seq", F.lit(2).cast("long")).withColumn("key", F.lit(None).cast("string")).drop("c_custkey"))
    return e.frame()["all"].select(F.col("feature_index").alias("c_custkey"), F.col("circle-radius").alias("radius"))


_SCREEN = f"(SELECT c_custkey, 512 + lon / 360 * 1024 AS sx, 256 + (-ln(tan(pi() / 4 + radians(greatest(-85.0511287798066, least(85.0511287798066, lat))) / 2)) * 180 / pi()) / 360 * 1024 AS sy FROM {_PLACES})"


@query("engine_query", f"SELECT 'all' AS layer, c_custkey AS ord FROM {_SCREEN} WHERE pow(sx - greatest(400, least(600, sx)), 2) + pow(sy - greatest(200, least(300, sy)), 2) <= 16 AND abs(pow(sx - greatest(400, least(600, sx)), 2) + pow(sy - greatest(200, least(300, sy)), 2) - 16) > 1e-6")
def engine_query(spark, sf):
    """What a box of the screen touches, in a view that shows the world on 1024 pixels."""
    return _engine(spark, sf, 1.0).query(400, 200, 600, 300).select("layer", "ord")


@query("engine_tiles", "SELECT 1::INT AS z, x::INT AS x, y::INT AS y FROM (SELECT unnest([0, 1]) AS x), (SELECT unnest([0, 1]) AS y)")
def engine_tiles(spark, sf):
    return _engine(spark, sf, 1.0).tiles()
