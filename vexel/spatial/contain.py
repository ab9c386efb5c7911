"""Containment of points and lines in polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.values import ExpressionError

Ring = list[tuple[float, float]]


def polygon_rings(geometry) -> list[Ring]:
    """All rings of a GeoJSON Polygon, MultiPolygon, or a Feature or collection of them."""
    if isinstance(geometry, dict):
        kind = geometry.get("type")
        if kind == "Feature":
            return polygon_rings(geometry.get("geometry"))
        if kind == "FeatureCollection":
            return [r for f in geometry.get("features", []) for r in polygon_rings(f)]
        if kind == "Polygon":
            return [[(float(p[0]), float(p[1])) for p in ring] for ring in geometry["coordinates"]]
        if kind == "MultiPolygon":
            return [[(float(p[0]), float(p[1])) for p in ring] for polygon in geometry["coordinates"] for ring in polygon]
    raise ExpressionError("\"within\" requires a Polygon or MultiPolygon.")


def edges(rings: list[Ring]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if a != b]


def edge_array(rings: list[Ring]) -> Column:
    """The edges as one literal array: the plan stays small, however many there are."""
    flat = edges(rings)
    parts = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)]) for e in flat]
    return F.array(*parts) if parts else F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")


def point_in(x: Column, y: Column, edge_list: Column) -> Column:
    """Even-odd rule: whether a ray from the point crosses an odd number of edges."""
    crosses = F.filter(edge_list, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crosses) % 2 == 1


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_crosses(p: Column, q: Column, edge_list: Column) -> Column:
    """Whether a segment properly crosses an edge."""

    def hit(e: Column) -> Column:
        s1 = _side(p["x"], p["y"], q["x"], q["y"], e["x1"], e["y1"])
        s2 = _side(p["x"], p["y"], q["x"], q["y"], e["x2"], e["y2"])
        s3 = _side(e["x1"], e["y1"], e["x2"], e["y2"], p["x"], p["y"])
        s4 = _side(e["x1"], e["y1"], e["x2"], e["y2"], q["x"], q["y"])
        return (s1 * s2 < 0) & (s3 * s4 < 0)

    return F.exists(edge_list, hit)


def within_column(geom_type: Column | None, geom: Column, rings: list[Ring]) -> Column:
    """Whether a feature's points, or its lines' vertices and segments, lie inside; polygons never do."""
    e = edge_array(rings)
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    points = F.flatten(F.flatten(geom))
    box = F.forall(points, lambda p: p["x"].between(min(xs), max(xs)) & p["y"].between(min(ys), max(ys))) if xs else F.lit(False)
    inside = box & F.forall(points, lambda p: point_in(p["x"], p["y"], e)) & (F.size(points) > 0)

    def line_stays(line: Column) -> Column:
        n = F.size(line)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(line, i).alias("p"), F.element_at(line, i + 1).alias("q"))))
        return F.coalesce(F.forall(pairs, lambda s: ~segment_crosses(s["p"], s["q"], e)), F.lit(True))

    lines = F.forall(F.flatten(geom), line_stays)
    kind = F.lit("Point") if geom_type is None else geom_type
    return F.coalesce(F.when(kind == "Point", inside).when(kind == "LineString", inside & lines).otherwise(F.lit(False)), F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
