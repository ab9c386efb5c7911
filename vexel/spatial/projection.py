"""Spherical Mercator and tile arithmetic, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATITUDE_MAX = 85.051128779806604
EXTENT = 8192
TILE_SIZE = 512
HALF_EQUATOR = math.pi * 6378137.0


def project(lon: Column, lat: Column, world: float | Column) -> tuple[Column, Column]:
    """Position in a world of a given size. The order of operations is fixed, as tile numbers depend on the last bit."""
    lat = F.greatest(F.lit(-LATITUDE_MAX), F.least(F.lit(LATITUDE_MAX), lat.cast("double")))
    scale = world / 360.0
    y = 180.0 - F.log(F.tan(F.lit(math.pi / 4) + lat * math.pi / 360.0)) * 180.0 / math.pi
    return (F.lit(180.0) + lon) * scale, y * scale


def unproject(x: Column, y: Column, world: float | Column) -> tuple[Column, Column]:
    lat = F.atan(F.exp((F.lit(180.0) - y * 360.0 / world) * math.pi / 180.0)) * 360.0 / math.pi - 90.0
    return x * 360.0 / world - 180.0, lat


def tile_of(lon: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Tile column and row at an integer zoom, within the world."""
    n = 1 << z
    x, y = project(lon, lat, float(n))
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c))).cast("int")
    return inside(x), inside(y)


def tile_local(lon: Column, lat: Column, z: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Position in a tile, in units of 1 / EXTENT."""
    ux, uy = project(lon, lat, float(1 << z))
    return (ux - x) * float(EXTENT), (uy - y) * float(EXTENT)


def cluster_position(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Mercator in a world of size 1, y held in it."""
    s = F.sin(lat * math.pi / 180.0)
    y = F.lit(0.5) - F.log((1.0 + s) / (1.0 - s)) * 0.25 / math.pi
    return lon / 360.0 + 0.5, F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def quadkey(z: int, x: Column, y: Column) -> Column:
    """One digit of base 4 a zoom, the coarsest first."""
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
    return F.concat(F.lit(""), *[(bit(x, k) + 2 * bit(y, k)).cast("string") for k in reversed(range(z))])


def tile_id(z: int | Column, x: Column, y: Column, most: int = 26) -> Column:
    """The tile's number along a Hilbert curve, after all tiles of lower zooms; null outside the pyramid. most: the
    highest zoom of a Column z."""
    zc = F.lit(z) if isinstance(z, int) else z
    top = z if isinstance(z, int) else most
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, k: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx, ry = (a["x"].bitwiseAND(s) > 0), (a["y"].bitwiseAND(s) > 0)
        quadrant = F.when(rx & ry, 2).when(rx, 3).when(ry, 1).otherwise(0)
        fx = F.when(rx & ~ry, s - 1 - a["x"].bitwiseAND(s - 1)).otherwise(a["x"].bitwiseAND(s - 1))
        fy = F.when(rx & ~ry, s - 1 - a["y"].bitwiseAND(s - 1)).otherwise(a["y"].bitwiseAND(s - 1))
        return F.struct(F.when(ry, fx).otherwise(fy).alias("x"), F.when(ry, fy).otherwise(fx).alias("y"), (a["d"] + s * s * quadrant).alias("d"))

    levels = F.when(zc > 0, F.sequence(zc - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    side = F.call_function("shiftleft", F.lit(1).cast("long"), zc)
    below = ((F.call_function("shiftleft", F.lit(1).cast("long"), zc * 2) - 1) / 3).cast("long")
    return F.when((zc <= top) & (x >= 0) & (y >= 0) & (x < side) & (y < side), F.aggregate(levels, start, step, lambda a: a["d"]) + below)


def box_ranges(west: float, south: float, east: float, north: float, z: int) -> tuple[int, int, int, int] | None:
    """(x0, x1, y0, y1) of the tiles that a box covers, x0 > x1 across the antimeridian; None off the world. The east
    edge takes the tile before it when it lies on a border."""
    if south > LATITUDE_MAX or north < -LATITUDE_MAX:
        return None
    n = 1 << z

    def at(lon: float, lat: float) -> tuple[float, float]:
        lat = max(-LATITUDE_MAX, min(LATITUDE_MAX, lat))
        return (180 + lon) * (n / 360), (180 - math.log(math.tan(math.pi / 4 + lat * math.pi / 360)) * 180 / math.pi) * (n / 360)

    clamp = lambda v: int(max(0, min(n - 1, v)))
    (wx, sy), (ex, ny) = at(west, south), at(east, north)
    return clamp(math.floor(wx)), clamp(math.ceil(ex) - 1), clamp(math.floor(ny)), clamp(math.floor(sy))


def tile_count(west: float, south: float, east: float, north: float, z: int) -> int:
    r = box_ranges(west, south, east, north, z)
    if r is None:
        return 0
    x0, x1, y0, y1 = r
    return ((x1 - x0) % (1 << z) + 1) * (y1 - y0 + 1)


class CoverTooLarge(ValueError):
    pass


def box_cover(spark: SparkSession, west: float, south: float, east: float, north: float, z: int, limit: int | None = None) -> DataFrame:
    """The tiles (z, x, y) of a box, row by row. Rows are unfolded on the executors."""
    n = tile_count(west, south, east, north, z)
    if limit is not None and n > limit:
        raise CoverTooLarge(f"{n} tiles")
    r = box_ranges(west, south, east, north, z)
    if r is None:
        return spark.createDataFrame([], "z int, x int, y int")
    x0, x1, y0, y1 = r
    width = (x1 - x0) % (1 << z) + 1
    rows = spark.range(y0, y1 + 1).select(F.col("id").cast("int").alias("y"))
    x = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    return rows.select("y", x.alias("i")).select(F.lit(z).alias("z"), ((F.col("i") + x0) % (1 << z)).cast("int").alias("x"), "y")


def tile_bbox(z: int, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """A tile's box in EPSG:3857 metres: min x, min y, max x, max y."""
    size = 2 * HALF_EQUATOR / (1 << z)
    up = F.lit((1 << z) - 1) - y
    return x * size - HALF_EQUATOR, up * size - HALF_EQUATOR, (x + 1) * size - HALF_EQUATOR, (up + 1) * size - HALF_EQUATOR


def ancestor(z: Column, x: Column, y: Column, at: Column | int) -> tuple[Column, Column, Column]:
    """The tile at a zoom no higher than its own that holds a tile."""
    at = F.lit(at) if isinstance(at, int) else at
    up = F.greatest(F.lit(0), z - at)
    return z - up, F.call_function("shiftright", x, up), F.call_function("shiftright", y, up)


def fetch_zoom(z: Column, low: int, high: int) -> Column:
    """The zoom a source serves: none below its range, its highest above."""
    return F.when(z >= low, F.least(z, F.lit(high)))


def ruler(lat: float) -> tuple[float, float]:
    """Metres a degree of longitude and of latitude near a latitude, on the WGS84 ellipsoid."""
    e2, radius = (2 - 1 / 298.257223563) / 298.257223563, 6378137.0
    c = math.cos(math.radians(lat))
    w2 = 1 / (1 - e2 * (1 - c * c))
    w = math.sqrt(w2)
    return math.radians(1) * radius * w * c, math.radians(1) * radius * w * w2 * (1 - e2)
