"""The box query: which features of which layers a screen box touches, as rows or GeoJSON.

features: layer, layer_index, ord, id, source, kind (fill, line, circle), geom_type, geom in screen units, and the paint
columns that widen a hit (line_width, gap_width, offset; radius, stroke). A bounding-box test comes first, the exact
test after it; answers come top layer first, each (layer, id, source) once, rows without an id all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..sources.geojson import feature_texts
from ..spatial.contain import point_in


def _points(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def _edges(geom: Column) -> Column:
    """All segments of all parts, as p, q."""

    def of(line: Column) -> Column:
        n = F.size(line)
        return F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))

    return F.flatten(F.transform(F.flatten(geom), of))


def _segment_box(e: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a segment has a point in a box: its parameters between the box's four sides leave an interval."""

    def between(a: Column, b: Column, low: float, high: float) -> tuple[Column, Column]:
        d = b - a
        u, v = (F.lit(low) - a) / F.when(d != 0, d), (F.lit(high) - a) / F.when(d != 0, d)
        inside = a.between(low, high)
        start = F.when(d != 0, F.least(u, v)).otherwise(F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0)))
        end = F.when(d != 0, F.greatest(u, v)).otherwise(F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0)))
        return start, end

    sx, ex = between(e["x1"], e["x2"], x0, x1)
    sy, ey = between(e["y1"], e["y2"], y0, y1)
    return F.greatest(F.lit(0.0), sx, sy) <= F.least(F.lit(1.0), ex, ey)


def _distance2(px, py, e: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / F.when(square != 0, square))))
    ex, ey = e["x1"] + t * dx - px, e["y1"] + t * dy - py
    return ex * ex + ey * ey


def _box_distance2(e: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Squared distance of a segment and a box: 0 if they meet, else from a corner of the box or an end of the segment."""
    corners = [_distance2(F.lit(x), F.lit(y), e) for x in (x0, x1) for y in (y0, y1)]
    ends = []
    for a, b in (("x1", "y1"), ("x2", "y2")):
        dx = e[a] - F.greatest(F.lit(x0), F.least(F.lit(x1), e[a]))
        dy = e[b] - F.greatest(F.lit(y0), F.least(F.lit(y1), e[b]))
        ends.append(dx * dx + dy * dy)
    return F.when(_segment_box(e, x0, y0, x1, y1), F.lit(0.0)).otherwise(F.least(*corners, *ends))


def touched(x0: float, y0: float, x1: float, y1: float) -> Column:
    """The exact test. Fills: a vertex or edge in the box, or the box inside. Lines: within half the painted width; with a
    gap, the width stands on either side of it. Circles: within radius and stroke."""
    geom, edges = F.col("geom"), _edges(F.col("geom"))
    lines = F.transform(edges, lambda e: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2")))
    fill = F.exists(edges, lambda e: _segment_box(e, x0, y0, x1, y1)) | point_in(F.lit(x0), F.lit(y0), lines)
    width, gap = F.coalesce("line_width", F.lit(1.0)), F.coalesce("gap_width", F.lit(0.0))
    half = F.when(gap > 0, gap / 2 + width).otherwise(width / 2) + F.abs(F.coalesce("line_offset", F.lit(0.0)))
    line = F.exists(edges, lambda e: _box_distance2(e, x0, y0, x1, y1) <= half * half)
    reach = F.coalesce("radius", F.lit(5.0)) + F.coalesce("stroke", F.lit(0.0))

    def near(p: Column) -> Column:
        dx = p["x"] - F.greatest(F.lit(x0), F.least(F.lit(x1), p["x"]))
        dy = p["y"] - F.greatest(F.lit(y0), F.least(F.lit(y1), p["y"]))
        return dx * dx + dy * dy <= reach * reach

    circle = F.exists(_points(geom), near)
    return F.coalesce(F.when(F.col("kind") == "fill", fill).when(F.col("kind") == "line", line).when(F.col("kind") == "circle", circle), F.lit(False))


def query(features: DataFrame, x0: float, y0: float, x1: float, y1: float, layers: list[str] | None = None) -> DataFrame:
    x0, x1 = sorted((float(x0), float(x1)))
    y0, y1 = sorted((float(y0), float(y1)))
    df = features if layers is None else features.where(F.col("layer").isin(layers))
    pts = _points(F.col("geom"))
    reach = F.when(F.col("kind") == "circle", F.coalesce("radius", F.lit(5.0)) + F.coalesce("stroke", F.lit(0.0))).when(F.col("kind") == "line", F.coalesce("line_width", F.lit(1.0)) + F.coalesce("gap_width", F.lit(0.0)) + F.abs(F.coalesce("line_offset", F.lit(0.0)))).otherwise(F.lit(0.0))
    low, high = (lambda c: F.array_min(F.transform(pts, lambda p: p[c])) - reach), (lambda c: F.array_max(F.transform(pts, lambda p: p[c])) + reach)
    df = df.where((low("x") <= x1) & (high("x") >= x0) & (low("y") <= y1) & (high("y") >= y0)).where(touched(x0, y0, x1, y1))
    named = df.where("id is not null")
    w = W.partitionBy("layer", "id", "source").orderBy("ord")
    once = named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.unionByName(df.where("id is null"))


def ordered(hits: DataFrame) -> DataFrame:
    """Top layer first, then the order of the records."""
    return hits.orderBy(F.col("layer_index").desc(), "ord")


def as_geojson(hits: DataFrame, columns: list[str]) -> DataFrame:
    """The answer as GeoJSON features: place (from 1, top layer first) and feature, a row a feature; an answer of any size
    stays a table."""
    rows = numbered(hits.withColumn("_below", -F.col("layer_index")), ["_below", "ord"], "place")
    return feature_texts(rows, columns)
