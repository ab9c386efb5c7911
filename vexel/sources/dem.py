"""Elevation tiles as pixel rows (z, x, y, px, py, r, g, b), and what is computed from them."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Factors of red, green and blue, and the offset, of the two encodings.
UNPACK = {"mapbox": (6553.6, 25.6, 0.1, 10000.0), "terrarium": (256.0, 1.0, 1.0 / 256.0, 32768.0)}


def elevation(r: Column, g: Column, b: Column, encoding: str = "mapbox") -> Column:
    a = UNPACK[encoding]
    return r * a[0] + g * a[1] + b * a[2] - a[3]


def bordered(pixels: DataFrame, dim: int) -> DataFrame:
    """Pixel rows (z, x, y, px, py, h) with a border of one pixel on each side: from the neighbors where they are there,
    else from the nearest own pixel. Columns wrap around the world."""
    side = F.call_function("shiftleft", F.lit(1), F.col("z"))
    moved = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            if dx or dy:
                p = pixels
                for c, d in (("px", dx), ("py", dy)):
                    if d:
                        p = p.where(F.col(c) == (0 if d > 0 else dim - 1))
                moved.append(p.select("z", F.pmod(F.col("x") - dx, side).alias("x"), (F.col("y") - dy).alias("y"), (F.col("px") + dx * dim).alias("px"), (F.col("py") + dy * dim).alias("py"), "h"))
    given = moved[0]
    for m in moved[1:]:
        given = given.unionByName(m)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(dim - 1), F.col(c)))
    edge = pixels.where((F.col("px") % (dim - 1) == 0) | (F.col("py") % (dim - 1) == 0)) if dim > 1 else pixels
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    own = edge.withColumn("d", F.explode(around)).select("z", "x", "y", (F.col("px") + F.col("d.dx")).alias("px"), (F.col("py") + F.col("d.dy")).alias("py"), "h", F.col("px").alias("ox"), F.col("py").alias("oy"))
    own = own.where((F.col("px").isin(-1, dim) | F.col("py").isin(-1, dim)) & (clamp("px") == F.col("ox")) & (clamp("py") == F.col("oy"))).select("z", "x", "y", "px", "py", F.col("h").alias("own_h"))
    keys = ["z", "x", "y", "px", "py"]
    border = own.join(given, keys, "left").select(*keys, F.coalesce("h", "own_h").alias("h"))
    return pixels.select(*keys, "h").unionByName(border)


def sampled(points: DataFrame, pixels: DataFrame, by=("z", "x", "y")) -> DataFrame:
    """points (z, x, y, u, v in pixels) with h, bilinear from the four pixels around; null where one is missing."""
    p = points.withColumns({"_px": F.floor("u").cast("int"), "_py": F.floor("v").cast("int")})
    four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    tx, ty = F.col("u") - F.col("_px"), F.col("v") - F.col("_py")
    p = p.withColumn("_id", F.monotonically_increasing_id()).withColumn("_d", F.explode(four))
    weight = F.when(F.col("_d.i") == 1, tx).otherwise(1 - tx) * F.when(F.col("_d.j") == 1, ty).otherwise(1 - ty)
    p = p.withColumns({"_w": weight, "px": F.col("_px") + F.col("_d.i"), "py": F.col("_py") + F.col("_d.j")})
    j = p.join(pixels.select(*by, "px", "py", "h"), [*by, "px", "py"], "left")
    got = j.groupBy("_id", *points.columns).agg(F.sum(F.col("h") * F.col("_w")).alias("h"), F.count("h").alias("_n"))
    return got.select(*points.columns, F.when(F.col("_n") == 4, F.col("h")).alias("h"))


def slopes(pixels: DataFrame, metres: float) -> DataFrame:
    """Horn's 3 x 3 differences of bordered pixels, in metres a metre; metres: width of a pixel."""
    row = W.partitionBy("z", "x", "y", "py").orderBy("px")
    column = W.partitionBy("z", "x", "y", "px").orderBy("py")
    d = pixels.withColumns({"w": F.lag("h").over(row), "e": F.lead("h").over(row)})
    d = d.withColumns({"a": F.col("w") + 2 * F.col("h") + F.col("e"), "c": F.col("e") - F.col("w")})
    d = d.withColumns({"dy": F.lead("a").over(column) - F.lag("a").over(column), "dx": F.lag("c").over(column) + 2 * F.col("c") + F.lead("c").over(column)})
    return d.where("dx is not null and dy is not null").select("z", "x", "y", "px", "py", (F.col("dx") / (8 * metres)).alias("dzdx"), (F.col("dy") / (8 * metres)).alias("dzdy"))


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """cells (cx, cy, low, high) coarsened four to one, level by level: level, cx, cy, low, high."""
    level = cells.select(F.lit(0).alias("level"), "cx", "cy", "low", "high")
    out = level
    for k in range(1, levels + 1):
        half = lambda c: F.call_function("shiftright", F.col(c), F.lit(1))
        level = level.groupBy(half("cx").alias("cx"), half("cy").alias("cy")).agg(F.min("low").alias("low"), F.max("high").alias("high")).select(F.lit(k).alias("level"), "cx", "cy", "low", "high")
        out = out.unionByName(level)
    return out


def coarsest_within(pyramid_rows: DataFrame, relief: float) -> DataFrame:
    """The coarsest level whose greatest relief is no more than a bound (one row; none if no level is)."""
    worst = pyramid_rows.groupBy("level").agg(F.max(F.col("high") - F.col("low")).alias("worst"))
    return worst.where(F.col("worst") <= relief).agg(F.max("level").alias("level"), F.max_by("worst", "level").alias("worst"))


def premultiplied(r: Column, g: Column, b: Column, a: Column) -> tuple[Column, Column, Column]:
    """Channels of 0 to 255 scaled by alpha, rounded."""
    return tuple(F.floor((c * a + 127) / 255).cast("int") for c in (r, g, b))


class ImageError(ValueError):
    pass


#: The largest image that is decoded, in bytes of RGBA.
MOST_BYTES = 64 << 20


def read_png(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of a PNG of 8 bits a channel that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ImageError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ImageError("unsupported PNG")
    width, height = head[:2]
    if width * height * 4 > MOST_BYTES:
        raise ImageError("the image is too large")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        raw = zlib.decompress(body)
    except zlib.error as e:
        raise ImageError(str(e)) from e
    stride = width * n
    if len(raw) != (stride + 1) * height:
        raise ImageError("wrong number of pixels")
    last, out = bytearray(stride), bytearray()
    for y in range(height):
        f, line = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        for i in range(stride):
            a, b, c = line[i - n] if i >= n else 0, last[i], last[i - n] if i >= n else 0
            if f == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = (0, a, b, (a + b) // 2)[f]
            line[i] = (line[i] + guess) & 255
        last = line
        for i in range(0, stride, n):
            p = line[i : i + n]
            out += bytes([p[0]] * 3 if n < 3 else p[:3]) + bytes([p[-1] if n in (2, 4) else 255])
    return width, height, bytes(out)


def range_over_box(pyramid_rows: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Low and high of the cells that hold a box of finest cells, read at the finest level at which the box spans two cells
    an axis at most."""
    level = 0
    while (x1 >> level) - (x0 >> level) > 1 or (y1 >> level) - (y0 >> level) > 1:
        level += 1
    own = (F.col("level") == level) & F.col("cx").between(x0 >> level, x1 >> level) & F.col("cy").between(y0 >> level, y1 >> level)
    return pyramid_rows.where(own).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def dem_position(lon: Column, lat: Column, z: int, dim: int) -> tuple[Column, Column, Column, Column]:
    """The elevation tile (x, y) of zoom z that holds a place, and where in it, in pixels from the middle of the first."""
    from ..spatial.projection import project, tile_of

    x, y = tile_of(lon, lat, z)
    u, v = project(lon, lat, float(1 << z))
    return x, y, (u - x) * dim - 0.5, (v - y) * dim - 0.5


def elevations(places: DataFrame, pixels: DataFrame, z: int, dim: int) -> DataFrame:
    """places (lon, lat) with h from bordered pixels (z, x, y, px, py, h)."""
    x, y, u, v = dem_position(F.col("lon"), F.col("lat"), z, dim)
    p = places.withColumns({"z": F.lit(z), "x": x, "y": y, "u": u, "v": v})
    return sampled(p, pixels).drop("z", "x", "y", "u", "v")


def invisible_relief(zoom: Column | int, lat: Column, exaggeration: float, pixels: float, most_pitch: float = 60.0) -> Column:
    """Metres of relief that stay below a number of pixels at the top of a zoom, seen at the steepest pitch."""
    import math

    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    around = F.abs(F.cos(F.radians(lat))) * (2 * math.pi * 6378137.0)
    per_metre = F.pow(F.lit(2.0), z + 1) * 512.0 / around
    return F.lit(pixels) / (per_metre * math.sin(math.radians(most_pitch)) * max(exaggeration, 1e-300))


def ring(slope_rows: DataFrame, dim: int) -> DataFrame:
    """Of slopes(), the outer ring of each tile: all that a new neighbor can change."""
    last = dim - 1
    return slope_rows.where((F.col("px") == 0) | (F.col("py") == 0) | (F.col("px") == last) | (F.col("py") == last))


def seams(landed: DataFrame, held: DataFrame) -> DataFrame:
    """Tiles whose borders are to be made anew: those that have landed, and their held neighbors, eight each, across the
    antimeridian as well. Tiles are z, x, y."""
    side = F.call_function("shiftleft", F.lit(1), F.col("z"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = landed.select("z", "x", "y").withColumn("_d", around).select("z", F.pmod(F.col("x") + F.col("_d.i"), side).alias("x"), (F.col("y") + F.col("_d.j")).alias("y")).distinct()
    return held.select("z", "x", "y").distinct().join(near, ["z", "x", "y"], "left_semi")


def reconciled(slope_rows: DataFrame, pixels: DataFrame, landed: DataFrame, dim: int, metres: float) -> DataFrame:
    """slopes() with the rings of all tiles at the seams of landed ones made anew from pixels."""
    at = seams(landed, pixels)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    side = F.call_function("shiftleft", F.lit(1), F.col("z"))
    needed = at.withColumn("_d", around).select("z", F.pmod(F.col("x") + F.col("_d.i"), side).alias("x"), (F.col("y") + F.col("_d.j")).alias("y")).distinct()
    new = ring(slopes(bordered(pixels.join(needed, ["z", "x", "y"], "left_semi"), dim), metres), dim).join(at, ["z", "x", "y"], "left_semi")
    kept = slope_rows.join(new.select("z", "x", "y", "px", "py"), ["z", "x", "y", "px", "py"], "left_anti")
    return kept.unionByName(new)


def covering_zoom(zoom: Column, tile_size: int, rounds: bool = True) -> Column:
    """The zoom at which a source of images of a size is asked for: higher for smaller images; images round, data floors."""
    import math

    z = zoom + math.log2(512 / tile_size)
    return F.greatest(F.lit(0), (F.round(z) if rounds else F.floor(z)).cast("int"))
