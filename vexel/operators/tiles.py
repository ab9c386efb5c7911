"""Operators over sets of tiles (z, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def _half(c: str):
    return F.call_function("shiftright", F.col(c), F.lit(1))


def folded(cover: DataFrame) -> DataFrame:
    """Copies of the world (wrap) fold into one tile."""
    return cover.dropDuplicates(["z", "x", "y"])


def refined(cover: DataFrame, levels: int) -> DataFrame:
    """The distinct tiles so many levels below."""
    n = 1 << levels
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(n)]) if levels <= 5 else None
    if grid is None:
        raise ValueError("refine in several steps")
    u = cover.select("z", "x", "y").distinct().withColumn("d", F.explode(grid))
    return u.select((F.col("z") + levels).alias("z"), (F.col("x") * n + F.col("d.i")).alias("x"), (F.col("y") * n + F.col("d.j")).alias("y"))


def substituted(ideal: DataFrame, loaded: DataFrame, min_zoom: int = 0) -> DataFrame:
    """What is drawn in place of ideal tiles: the tile itself if it is loaded, else all its loaded children, and, unless
    all four are there, the nearest loaded ancestor. Columns ideal_z, ideal_x, ideal_y, z, x, y."""
    tiles = ideal.select("z", "x", "y").distinct()
    have = loaded.select("z", "x", "y").distinct()
    named = lambda df: df.select(F.col("z").alias("ideal_z"), F.col("x").alias("ideal_x"), F.col("y").alias("ideal_y"), "z", "x", "y")
    exact = named(tiles.join(have, ["z", "x", "y"], "left_semi"))
    missing = tiles.join(have, ["z", "x", "y"], "left_anti")
    kids = refined(missing, 1).join(have, ["z", "x", "y"], "left_semi")
    below = kids.select((F.col("z") - 1).alias("ideal_z"), _half("x").alias("ideal_x"), _half("y").alias("ideal_y"), "z", "x", "y")
    full = below.groupBy("ideal_z", "ideal_x", "ideal_y").count().where("count = 4").select(F.col("ideal_z").alias("z"), F.col("ideal_x").alias("x"), F.col("ideal_y").alias("y"))
    open_ = missing.join(full, ["z", "x", "y"], "left_anti")
    up = F.explode(F.when(F.col("z") > min_zoom, F.sequence(F.lit(1), F.col("z") - min_zoom)))
    lines = named(open_).withColumn("k", up)
    lines = lines.select("ideal_z", "ideal_x", "ideal_y", (F.col("ideal_z") - F.col("k")).alias("z"), F.call_function("shiftright", F.col("ideal_x"), F.col("k")).alias("x"), F.call_function("shiftright", F.col("ideal_y"), F.col("k")).alias("y"))
    nearest = lines.join(have, ["z", "x", "y"], "left_semi").groupBy("ideal_z", "ideal_x", "ideal_y").agg(F.max(F.struct("z", "x", "y")).alias("t"))
    above = nearest.select("ideal_z", "ideal_x", "ideal_y", "t.z", "t.x", "t.y")
    return exact.unionByName(below).unionByName(above)


def masks(drawn: DataFrame) -> DataFrame:
    """For each drawn tile (tz, tx, ty), the parts (z, x, y) of it that no drawn tile below it covers: whole if there is none,
    however far below. Copies of the world (a column wrap) are apart."""
    by = ["wrap"] if "wrap" in drawn.columns else []
    t = drawn.select(*by, "z", "x", "y").distinct()
    owner, tile = [*by, "tz", "tx", "ty"], [*by, "tz", "tx", "ty", "z", "x", "y"]
    up = F.explode(F.when(F.col("z") > 0, F.sequence(F.lit(1), F.col("z"))))
    parent = lambda c: F.call_function("shiftright", F.col(c), F.col("k"))
    pairs = t.withColumn("k", up).select(*by, (F.col("z") - F.col("k")).alias("tz"), parent("x").alias("tx"), parent("y").alias("ty"), "z", "x", "y")
    owners = t.select(*by, F.col("z").alias("tz"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    pairs = pairs.join(owners, owner, "left_semi")
    # the path from a covering tile up to its owner is split; the siblings along it that neither split nor are covered remain
    path = F.explode(F.sequence(F.lit(0), F.col("z") - F.col("tz")))
    steps = pairs.withColumn("k", path).select(*owner, (F.col("z") - F.col("k")).alias("z"), parent("x").alias("x"), parent("y").alias("y"), (F.col("k") == 0).alias("covered"))
    steps = steps.groupBy(*tile).agg(F.max("covered").alias("covered"))
    kids = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    parts = steps.where("not covered").withColumn("d", kids).select(*owner, (F.col("z") + 1).alias("z"), (F.col("x") * 2 + F.col("d.i")).alias("x"), (F.col("y") * 2 + F.col("d.j")).alias("y"))
    parts = parts.join(steps.select(*tile), tile, "left_anti")
    # what lies under a covered step is covered, too: a part's ancestors below its owner are looked up there
    above = parts.withColumn("k", F.explode(F.when(F.col("z") - F.col("tz") > 1, F.sequence(F.lit(1), F.col("z") - F.col("tz") - 1))))
    above = above.select(*owner, "z", "x", "y", (F.col("z") - F.col("k")).alias("cz"), parent("x").alias("cx"), parent("y").alias("cy"))
    covered = steps.where("covered").select(*owner, F.col("z").alias("cz"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    parts = parts.join(above.join(covered, [*owner, "cz", "cx", "cy"], "left_semi"), tile, "left_anti")
    whole = owners.join(pairs.select(*owner).distinct(), owner, "left_anti").select(*owner, F.col("tz").alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"))
    return whole.unionByName(parts)


def mask_quads(parts: DataFrame, extent: int = 8192) -> DataFrame:
    """masks() as quads of their tiles: the square (x0, y0, x1, y1) of each part in units of its tile's extent."""
    size = F.call_function("shiftright", F.lit(extent), F.col("z") - F.col("tz"))
    x0 = (F.col("x") - F.call_function("shiftleft", F.col("tx"), F.col("z") - F.col("tz"))) * size
    y0 = (F.col("y") - F.call_function("shiftleft", F.col("ty"), F.col("z") - F.col("tz"))) * size
    return parts.withColumns({"x0": x0, "y0": y0, "x1": x0 + size, "y1": y0 + size})


def wanted(ideal: DataFrame, held: DataFrame) -> DataFrame:
    return ideal.select("z", "x", "y").distinct().join(held, ["z", "x", "y"], "left_anti")


def sweep_statistics(frames: DataFrame) -> DataFrame:
    """frames (frame, view, z, x, y): distinct tiles, uses, and how many uses share a tile."""
    return frames.groupBy("frame").agg(F.count("*").alias("uses"), F.count_distinct("z", "x", "y").alias("distinct_tiles")).withColumn("shared", F.col("uses") - F.col("distinct_tiles"))


def at_zooms(cover: DataFrame, zooms: list[int]) -> DataFrame:
    """The tiles of other zooms that meet a cover's tiles: those that hold them, or those below them."""
    parts = []
    for zoom in zooms:
        up = F.col("z") - zoom
        above = cover.where(F.col("z") >= zoom).select(F.lit(zoom).alias("z"), F.call_function("shiftright", F.col("x"), F.greatest(F.lit(0), up)).alias("x"), F.call_function("shiftright", F.col("y"), F.greatest(F.lit(0), up)).alias("y"))
        side = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), -up)) - 1
        below = cover.where(F.col("z") < zoom).withColumn("_i", F.explode(F.sequence(F.lit(0), side))).withColumn("_j", F.explode(F.sequence(F.lit(0), side)))
        grown = lambda c, k: F.call_function("shiftleft", F.col(c), F.greatest(F.lit(0), -up)) + F.col(k)
        parts += [above, below.select(F.lit(zoom).alias("z"), grown("x", "_i").alias("x"), grown("y", "_j").alias("y"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def matching(builds: DataFrame, revisions: DataFrame) -> DataFrame:
    """Builds (source, revision, ...) that were made from the data that their sources have now."""
    return builds.join(revisions.select("source", "revision"), ["source", "revision"], "left_semi")


def evictable(held: DataFrame, capacity: int, new: int | None = None) -> DataFrame:
    """Of held tiles (key, used, retained) those that must go so that no more than capacity stay: the least used first, none
    that is retained, nor the new one."""
    excess = held.agg(F.greatest(F.lit(0), F.count("*") - capacity).alias("_excess"))
    free = held.where(~F.col("retained") & (F.lit(True) if new is None else F.col("key") != new))
    return numbered(free, ["used", "key"], "_n").join(F.broadcast(excess)).where("_n <= _excess").select(*held.columns)
