"""Geometry: what can be said by Columns, and kernels for what can't (as Arrow UDFs over nested arrays)."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
LINES = T.ArrayType(LINE)
Points = list[tuple[float, float]]


# -- Columns


def _pairs(line: Column, f) -> Column:
    """f over neighbors (p, q) of a line, as an array."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), f)).otherwise(F.array().cast("array<double>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring; positive counts counter-clockwise where y points up."""
    return _total(_pairs(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def line_length(line: Column) -> Column:
    return _total(_pairs(line, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def bounds(points: Column) -> Column:
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def clip_points(points: Column, axis: str, low: float, high: float) -> Column:
    return F.filter(points, lambda p: p[axis].between(low, high))


def rescaled(rings: Column, extent: int, target: int) -> Column:
    """Rings in another tile extent, rounded."""
    scale = lambda c: F.round(c * target / extent)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(scale(p["x"]).alias("x"), scale(p["y"]).alias("y"))))


def tolerance_at(zoom: Column | int, source_tolerance: float = 0.375) -> Column | float:
    """Simplification distance at a zoom in a world of size 1."""
    t = 16 * source_tolerance / 8192
    return t / 2**zoom if isinstance(zoom, int) else t / F.pow(F.lit(2.0), zoom)


def simplified(line: Column, importance: Column, tolerance: float) -> Column:
    """The points of a line whose importance is above the squared tolerance; both ends stay."""
    kept = F.filter(F.arrays_zip(line.alias("p"), importance.alias("w")), lambda e: e["w"] > tolerance * tolerance)
    return F.transform(kept, lambda e: e["p"])


# -- kernels


def importances(line: Points, least: float = 0.0) -> list[float]:
    """Douglas-Peucker: the squared distance at which each point would go; both ends have 1. Of equally far points the
    one nearest the middle splits."""
    out = [0.0] * len(line)
    if line:
        out[0] = out[-1] = 1.0
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        middle = a + (b - a) // 2
        d, _, i = max(((_segment_distance(line[i], line[a], line[b]), -abs(i - middle), i) for i in range(a + 1, b)), key=lambda t: t[:2])
        if d > least * least:
            out[i] = d
            stack += [(a, i), (i, b)]
    return out


def _segment_distance(p, a, b) -> float:
    """Squared."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = 0.0 if square == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square))
    return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2


def clip_ring(ring: Points, axis: int, low: float, high: float) -> Points:
    """The part of a closed ring between two lines; closed again, empty if nothing is left."""
    for bound, keep in ((low, lambda v: v >= low), (high, lambda v: v <= high)):
        out: Points = []
        for a, b in zip(ring, ring[1:]):
            inside, then = keep(a[axis]), keep(b[axis])
            if inside:
                out.append(a)
            if inside != then:
                out.append(_cut(a, b, axis, bound))
        if not out:
            return []
        ring = out if out[0] == out[-1] else [*out, out[0]]
    return ring


def _cut(a, b, axis: int, at: float) -> tuple[float, float]:
    t = (at - a[axis]) / (b[axis] - a[axis])
    p = (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
    return (at, p[1]) if axis == 0 else (p[0], at)


def clip_line(line: Points, axis: int, low: float, high: float) -> list[Points]:
    """The pieces of a line between two lines."""
    return [piece for piece, _, _ in clip_line_measured(line, axis, low, high)]


def clip_line_measured(line: Points, axis: int, low: float, high: float, start: float = 0.0) -> list[tuple[Points, float, float]]:
    """Pieces with the distances along the line at which they begin and end."""
    out: list[tuple[Points, float, float]] = []
    piece: Points = []
    begun = at = start
    for a, b in zip(line, line[1:]):
        length = math.hypot(b[0] - a[0], b[1] - a[1])
        d = b[axis] - a[axis]
        # the part of the segment that lies between the bounds
        t0, t1 = 0.0, 1.0
        if d == 0:
            if not low <= a[axis] <= high:
                t0, t1 = 1.0, 0.0
        else:
            u, v = sorted(((low - a[axis]) / d, (high - a[axis]) / d))
            t0, t1 = max(t0, u), min(t1, v)
        if t0 < t1 or t0 == t1 and 0 < t0 < 1:
            on = lambda t: (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
            p = a if t0 == 0 else on(t0)
            if not piece or piece[-1] != p:
                if len(piece) > 1:
                    out.append((piece, begun, at))
                piece, begun = [p], at + length * t0
            piece.append(b if t1 == 1 else on(t1))
            if t1 < 1:
                out.append((piece, begun, at + length * t1))
                piece = []
        at += length
    if len(piece) > 1:
        out.append((piece, begun, at))
    return out


def ring_area(ring: Points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def classified(rings: list[Points], most_holes: int | None = None) -> list[list[Points]]:
    """Rings grouped into polygons: a ring that winds as the first one does begins a polygon, others are its holes. Of
    more holes than most_holes the largest stay."""
    out: list[list[Points]] = []
    first = 0.0
    for r in rings:
        area = ring_area(r)
        if area == 0:
            continue
        first = first or area
        if (area > 0) == (first > 0):
            out.append([r])
        elif out:
            out[-1].append(r)
    if most_holes is not None:
        out = [[p[0], *sorted(p[1:], key=lambda r: -abs(ring_area(r)))[:most_holes]] for p in out]
    return out


def contains(rings: list[Points], x: float, y: float) -> bool:
    inside = False
    for ring in rings:
        for a, b in zip(ring, ring[1:]):
            if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return inside


def wound(rings: list[Points]) -> list[Points]:
    """Rings nested and wound anew: a ring inside an odd number of others is a hole and winds against its outer ring,
    which it follows. Outer rings run clockwise where y points down."""
    rings = [r if r[0] == r[-1] else [*r, r[0]] for r in rings if len(r) > 2]
    depth = [sum(contains([o], *r[0]) for o in rings if o is not r) for r in rings]
    out: list[Points] = []
    for r, d in zip(rings, depth):
        if d % 2 == 0:
            out.append(r if ring_area(r) > 0 else r[::-1])
            for h, e in zip(rings, depth):
                if e == d + 1 and contains([r], *h[0]):
                    out.append(h if ring_area(h) < 0 else h[::-1])
    return out


def label_point(rings: list[Points], precision: float = 1.0) -> tuple[float, float] | None:
    """The point of a polygon farthest from its outline, to a precision: best cells first."""
    if not rings or len(rings[0]) < 3:
        return None
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
    size = min(x1 - x0, y1 - y0)
    if size == 0:
        return (x0, y0)

    def distance(x: float, y: float) -> float:
        d = math.sqrt(min(_segment_distance((x, y), a, b) for r in rings for a, b in zip(r, r[1:])))
        return d if contains(rings, x, y) else -d

    def cell(x: float, y: float, half: float):
        d = distance(x, y)
        return (-(d + half * math.sqrt(2)), x, y, half, d)

    queue = []
    half = size / 2
    x = x0
    while x < x1:
        y = y0
        while y < y1:
            heapq.heappush(queue, cell(x + half, y + half, half))
            y += size
        x += size
    best = max(queue, key=lambda c: c[4])
    middle = cell((x0 + x1) / 2, (y0 + y1) / 2, 0)
    best = middle if middle[4] > best[4] else best
    while queue:
        c = heapq.heappop(queue)
        if c[4] > best[4]:
            best = c
        if -c[0] - best[4] <= precision:
            break
        h = c[3] / 2
        for dx in (-h, h):
            for dy in (-h, h):
                heapq.heappush(queue, cell(c[1] + dx, c[2] + dy, h))
    return (best[1], best[2])


def anchors(line: Points, spacing: float, offset: float, window: float, most_angle: float, margin: float = 0.0) -> list[tuple[float, float, float]]:
    """Label anchors (x, y, angle) each `spacing` along a line from `offset` on; not nearer than margin to an end, nor
    where the line turns more than most_angle within the window around it."""
    lengths = [math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(line, line[1:])]
    total, at, out, k, before = sum(lengths), offset, [], 0, 0.0
    turns, s = [], 0.0
    angles = [math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in zip(line, line[1:])]
    for i in range(len(angles) - 1):
        s += lengths[i]
        turns.append((s, abs((angles[i + 1] - angles[i] + math.pi) % (2 * math.pi) - math.pi)))
    while spacing > 0 and at <= total and lengths:
        while k < len(lengths) - 1 and before + lengths[k] < at:
            before += lengths[k]
            k += 1
        t = (at - before) / lengths[k] if lengths[k] else 0.0
        a, b = line[k], line[k + 1]
        if margin <= at <= total - margin and sum(v for p, v in turns if abs(p - at) <= window / 2) <= most_angle:
            out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t, angles[k]))
        at += spacing
    return out


def polygon_tiles(rings: list[Points]) -> list[tuple[int, int, int]]:
    """Rows (y, first x, last x) of unit cells that a polygon, in units of cells, touches. Inside is what its rings wind
    around other than zero times."""
    rows: dict[int, set[int]] = {}
    for ring in rings:
        for a, b in zip(ring, ring[1:]):
            for y in range(math.floor(min(a[1], b[1])), math.floor(max(a[1], b[1])) + 1):
                # the edge's part in this row
                if a[1] == b[1]:
                    xs = (a[0], b[0])
                else:
                    t = [max(0.0, min(1.0, (v - a[1]) / (b[1] - a[1]))) for v in (y, y + 1)]
                    xs = tuple(a[0] + (b[0] - a[0]) * u for u in t)
                rows.setdefault(y, set()).update(range(math.floor(min(xs)), math.floor(max(xs)) + 1))
    for y, cells in rows.items():
        # between edges, whole cells are inside or outside as their middles are: edges that cross the row's middle line
        # change how often the rings wind around what lies east of them
        turns = sorted((a[0] + (b[0] - a[0]) * (y + 0.5 - a[1]) / (b[1] - a[1]), 1 if b[1] > a[1] else -1) for ring in rings for a, b in zip(ring, ring[1:]) if (a[1] > y + 0.5) != (b[1] > y + 0.5))
        winds = 0
        for (x, turn), (following, _) in zip(turns, turns[1:]):
            winds += turn
            if winds:
                cells.update(range(math.ceil(x - 0.5), math.ceil(following - 0.5)))
    out = []
    for y in sorted(rows):
        xs = sorted(rows[y])
        start = last = xs[0]
        for x in xs[1:]:
            if x > last + 1:
                out.append((y, start, last))
                start = x
            last = x
        out.append((y, start, last))
    return out


# -- the kernels as functions of Columns
#
# Arrow's arrays are read and made as a whole: a dict for each point takes far longer than most kernels.


def _points(rows: pa.StructArray) -> Points:
    values = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
    return list(zip(*(values(c) for c in rows.flatten())))


def _each(lists: pa.ListArray, read) -> list:
    """An array of lists as Python's, what they hold by `read`; null is None."""
    held, at = read(lists.values), lists.offsets.to_pylist()
    valid = lists.is_valid().to_pylist() if lists.null_count else None
    return [held[a:b] if valid is None or valid[i] else None for i, (a, b) in enumerate(zip(at, at[1:]))]


def _lines(v: pa.ListArray) -> list[Points | None]:
    return _each(v, _points)


def _rings(v: pa.ListArray) -> list[list[Points] | None]:
    return _each(v, _lines)


def polygons(v: pa.ListArray) -> list[list[list[Points]] | None]:
    """Parts of rings from Arrow's array."""
    return _each(v, _rings)


def _floats(rows: list) -> pa.Array:
    return pa.array(rows, pa.float64())


def _structs(names: dict):
    """A writer of tuples as structs of names, each with its writer; None is null."""

    def write(rows: list[tuple | None]) -> pa.Array:
        null = [r is None for r in rows]
        columns = zip(*((None,) * len(names) if r is None else r for r in rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([w(list(c)) for w, c in zip(names.values(), columns)], names=list(names), mask=pa.array(null) if any(null) else None)

    return write


def _arrays(write):
    """A writer of lists, what they hold by `write`; None is null."""

    def run(rows: list[list | None]) -> pa.Array:
        flat, at = [], [0]
        for r in rows:
            flat += r or ()
            at.append(len(flat))
        if any(r is None for r in rows):
            at = [None if i < len(rows) and rows[i] is None else a for i, a in enumerate(at)]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), write(flat))

    return run


_longs = lambda rows: pa.array(rows, pa.int64())
_point = _structs({"x": _floats, "y": _floats})
_line = _arrays(_point)
#: Parts of rings as Arrow's array.
parts = _arrays(_arrays(_line))


def _kernel(f, read, write, kind):
    """f, which gives None for what it can't take, as a function of a Column: each value is read and written in Arrow's form."""

    def run(v: pa.Array) -> pa.Array:
        return write([None if x is None else f(x) for x in read(v)])

    # the decorator would look for types of arguments that this module's annotations only name
    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def importance_column(line: Column) -> Column:
    return _kernel(importances, _lines, _arrays(_floats), "array<double>")(line)


def clip_rings_column(rings: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Rings within a box; the ones that vanish are left out."""

    def run(value):
        out = [clip_ring(clip_ring(r, 0, x0, x1), 1, y0, y1) for r in value]
        return [r for r in out if len(r) > 3]

    return _kernel(run, _rings, _arrays(_line), LINES)(rings)


def clip_lines_column(lines: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    def run(value):
        return [q for line in value for p in clip_line(line, 0, x0, x1) for q in clip_line(p, 1, y0, y1)]

    return _kernel(run, _rings, _arrays(_line), LINES)(lines)


def label_point_column(rings: Column, precision: float = 1.0) -> Column:
    return _kernel(lambda v: label_point(v, precision), _rings, _point, POINT)(rings)


def wound_column(rings: Column) -> Column:
    return _kernel(wound, _rings, _arrays(_line), LINES)(rings)


def polygon_cover_column(rings: Column) -> Column:
    """Cells (x, y) that a polygon in units of cells touches."""

    def run(value):
        return [(x, y) for y, a, b in polygon_tiles(value) for x in range(a, b + 1)]

    return _kernel(run, _rings, _arrays(_structs({"x": _longs, "y": _longs})), "array<struct<x:long,y:long>>")(rings)


def clip_measured_column(line: Column, axis: str, low: float, high: float) -> Column:
    """A line's pieces between two lines: points, and the distances along the line at which each begins and ends."""
    at = "xy".index(axis)
    write = _arrays(_structs({"points": _line, "start": _floats, "stop": _floats}))
    return _kernel(lambda v: clip_line_measured(v, at, low, high), _lines, write, "array<struct<points:array<struct<x:double,y:double>>,start:double,stop:double>>")(line)


def classified_column(rings: Column, most_holes: int | None = None) -> Column:
    """Rings grouped into polygons, each an outer ring and its holes."""
    return _kernel(lambda v: classified(v, most_holes), _rings, _arrays(_arrays(_line)), "array<array<array<struct<x:double,y:double>>>>")(rings)


def anchors_column(line: Column, spacing: float, offset: float, window: float, most_angle: float, margin: float = 0.0) -> Column:
    """A line's label anchors: x, y, angle."""
    write = _arrays(_structs({"x": _floats, "y": _floats, "angle": _floats}))
    return _kernel(lambda v: anchors(v, spacing, offset, window, most_angle, margin), _lines, write, "array<struct<x:double,y:double,angle:double>>")(line)


def subdivided_column(ring: Column, size: float) -> Column:
    """A ring's parts within the cells of a grid: cx, cy, ring."""

    def run(points):
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        out = []
        for cx in range(math.floor(min(xs) / size), math.ceil(max(xs) / size)):
            column_ = clip_ring(points, 0, cx * size, (cx + 1) * size)
            for cy in range(math.floor(min(ys) / size), math.ceil(max(ys) / size)):
                part = clip_ring(column_, 1, cy * size, (cy + 1) * size) if len(column_) > 3 else []
                if len(part) > 3 and ring_area(part):
                    out.append((cx, cy, part))
        return out

    write = _arrays(_structs({"cx": _longs, "cy": _longs, "ring": _line}))
    return _kernel(run, _lines, write, "array<struct<cx:long,cy:long,ring:array<struct<x:double,y:double>>>>")(ring)
