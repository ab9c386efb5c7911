"""Spatial joins by cells: both sides are filed under the cells of a grid, meet in an equi-join, and are then compared
exactly. The cell is as wide as the search reaches, so a point meets 3 x 3 cells at most.

Points of one place are no problem for the equi-join (adaptive execution splits a common cell's larger side); the exact
comparison runs in the join's own condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import carried, in_ranges


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _near_cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    around = F.array(*[F.struct((_cell(F.col(x), size) + i).alias("cx"), (_cell(F.col(y), size) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(around)).withColumns({"_cx": F.col("_c.cx"), "_cy": F.col("_c.cy")}).drop("_c")


def radius_join(left: DataFrame, right: DataFrame, r: float, lx: str, ly: str, rx: str, ry: str, how: str = "inner") -> DataFrame:
    """Pairs no farther apart than r; for semi and anti joins the left rows. Columns of the sides must differ in name."""
    if how in ("left_semi", "left_anti"):
        # the right side unfolds, so a left row is met in one cell
        a = left.withColumns({"_cx": _cell(F.col(lx), r), "_cy": _cell(F.col(ly), r)})
        b = _near_cells(right.select(rx, ry).distinct(), rx, ry, r)
    else:
        a = left.withColumns({"_cx": _cell(F.col(lx), r), "_cy": _cell(F.col(ly), r)})
        b = _near_cells(right, rx, ry, r)
    dx, dy = F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)
    on = (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"]) & (dx * dx + dy * dy <= r * r)
    keep = left.columns if how in ("left_semi", "left_anti") else left.columns + right.columns
    # what is unfolded is larger than Spark estimates, so it isn't broadcast
    return a.join(b.hint("merge"), on, how).select(*[(a if c in left.columns else b)[c] for c in keep])


def box_join(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y", bounds=("x0", "y0", "x1", "y1"), how: str = "inner") -> DataFrame:
    """Points and the boxes that hold them, edges included. size: cell width; a box is filed under all its cells."""
    x0, y0, x1, y1 = bounds
    a = points.withColumns({"_cx": _cell(F.col(x), size), "_cy": _cell(F.col(y), size)})
    b = boxes.withColumn("_cx", F.explode(F.sequence(_cell(F.col(x0), size), _cell(F.col(x1), size))))
    b = b.withColumn("_cy", F.explode(F.sequence(_cell(F.col(y0), size), _cell(F.col(y1), size))))
    inside = a[x].between(b[x0], b[x1]) & a[y].between(b[y0], b[y1])
    on = (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"]) & inside
    keep = points.columns if how in ("left_semi", "left_anti") else points.columns + boxes.columns
    return a.join(b.hint("merge"), on, how).select(*[(a if c in points.columns else b)[c] for c in keep])


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    """Touching counts. Boxes are (x0, y0, x1, y1)."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def circles_collide(a: list[Column], b: list[Column]) -> Column:
    """Touching doesn't count. Circles are (x, y, r)."""
    dx, dy, r = a[0] - b[0], a[1] - b[1], a[2] + b[2]
    return r * r > dx * dx + dy * dy


def circle_meets_box(c: list[Column], box: list[Column]) -> Column:
    """Touching counts."""
    dx = c[0] - F.greatest(box[0], F.least(box[2], c[0]))
    dy = c[1] - F.greatest(box[1], F.least(box[3], c[1]))
    return dx * dx + dy * dy <= c[2] * c[2]


def box_box_join(left: DataFrame, right: DataFrame, size: float, key: list[str]) -> DataFrame:
    """Overlapping boxes (l_x0 .. l_y1, r_x0 .. r_y1): each pair once, found in the cell of its overlap's corner."""

    def cells(df: DataFrame, p: str) -> DataFrame:
        df = df.withColumn("_cx", F.explode(F.sequence(_cell(F.col(f"{p}x0"), size), _cell(F.col(f"{p}x1"), size))))
        return df.withColumn("_cy", F.explode(F.sequence(_cell(F.col(f"{p}y0"), size), _cell(F.col(f"{p}y1"), size))))

    j = cells(left, "l_").hint("merge").join(cells(right, "r_").hint("merge"), ["_cx", "_cy", *key])
    a, b = [F.col(f"l_{c}") for c in ("x0", "y0", "x1", "y1")], [F.col(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]
    first = (_cell(F.greatest(a[0], b[0]), size) == F.col("_cx")) & (_cell(F.greatest(a[1], b[1]), size) == F.col("_cy"))
    return j.where(boxes_overlap(a, b) & first).drop("_cx", "_cy")


def with_state(features: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Features with their state, null where there is none. state has one row a key."""
    return features.join(state, keys, "left")


def latest_stop(x: Column, stops: list[tuple[float, object]]) -> Column:
    """The value of the greatest stop that isn't above x, null before the first one."""
    ordered = sorted(stops, key=lambda s: -s[0])
    out = None
    for s, v in ordered:
        out = F.when(x >= s, F.lit(v)) if out is None else out.when(x >= s, F.lit(v))
    return F.lit(None) if out is None else out


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str]) -> DataFrame:
    """Each left row with the last right row of its key that isn't later: both sides in one sorted stream, dealt by
    ranges of key and time."""
    a = left.select(*left.columns, F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    b = right.select(*[F.col(c) if c in by or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), *columns)
    # in ranges, each row looks back within its range, and else takes what the ranges before have of its key
    dealt = in_ranges(a.unionByName(b), *[F.col(c) for c in (*by, on, "_side")])
    w = W.partitionBy("_part", *by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    right_row = F.when(F.col("_side") == 0, F.struct(*columns))
    held = F.max_by(right_row, F.when(F.col("_side") == 0, F.col(on)))
    rows = carried(dealt, by, held, lambda c: F.last(c, ignorenulls=True), "_carried")
    found = F.coalesce(F.last(right_row, ignorenulls=True).over(w), F.col("_carried"))
    return rows.withColumn("_found", found).where("_side = 1").select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])


def reaches(low: Column, high: Column, z: int, x: int, wrap: int, buffer: float = 128.0) -> Column:
    """Whether a feature's extent of longitudes meets a world copy of a tile with its buffer (in units of the extent 8192)."""
    width, margin = 360.0 / (1 << z), 360.0 / (1 << z) * buffer / 8192
    west = -180.0 + x * width + 360.0 * wrap
    return (low <= west + width + margin) & (high >= west - margin)
