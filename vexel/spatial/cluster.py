"""Hierarchical point clustering.

From the highest zoom to the lowest, each level groups the one below it: in index order, a point that isn't taken yet
takes all free points within the zoom's radius; if they are enough, they become a cluster at their weighted mean.
Who takes whom is the lexicographically first maximal independent set of the radius graph. A level of a bounded number
of points, and all levels above it, are computed in one task over a grid; larger levels are computed by rounds over
the cells of a grid so fine that all points of a cell are within the radius: at most one of them takes others, so a point
meets a bounded number of takers, however crowded a place is. Means are made from sums in fixed point, which don't depend on
their order, so both ways give the same result to the last bit.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..operators.scratch import cut
from .projection import cluster_position, unproject

#: Points that one task clusters.
TASK_POINTS = 50_000


@dataclass(frozen=True)
class Options:
    min_zoom: int = 0
    max_zoom: int = 16
    radius: float = 40.0
    extent: float = 512.0
    min_points: int = 2

    def reach(self, zoom: int) -> float:
        return self.radius / (self.extent * 2.0**zoom)


#: Parts of the world's width in which positions are summed.
_FIXED = float(1 << 52)
LEVEL = "z int, index long, id long, x double, y double, n long, parent_id long"


def _next_level(level: pd.DataFrame, zoom: int, o: Options) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(the level with its parents, the level above it)."""
    r = o.reach(zoom)
    x, y, n, ids = (level[c].to_numpy() for c in ("x", "y", "n", "id"))
    fx, fy = np.floor(x * _FIXED).astype(np.int64), np.floor(y * _FIXED).astype(np.int64)
    cells: dict[tuple[int, int], list[int]] = defaultdict(list)
    cx, cy = np.floor(x / r).astype(np.int64), np.floor(y / r).astype(np.int64)
    for i, c in enumerate(zip(cx.tolist(), cy.tolist())):
        cells[c].append(i)
    free, parent, up = np.ones(len(level), bool), np.zeros(len(level), np.int64), []
    for i in range(len(level)):
        if not free[i]:
            continue
        free[i] = False
        near = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx[i] + dx, cy[i] + dy), ()) if free[j]], np.int64)
        near = np.sort(near[(x[near] - x[i]) ** 2 + (y[near] - y[i]) ** 2 <= r * r])
        total = int(n[i] + n[near].sum())
        if total >= o.min_points:
            own = (i << 5) + zoom + 1
            parent[i] = own
            parent[near] = own
            every = [i, *near.tolist()]
            wx, wy = (sum(a * b for a, b in zip(fixed[every].tolist(), n[every].tolist())) for fixed in (fx, fy))
            up.append((own, float(wx) / total / _FIXED, float(wy) / total / _FIXED, total))
        else:
            up.append((ids[i], x[i], y[i], 1))
            up += [(ids[j], x[j], y[j], 1) for j in near]
        free[near] = False
    above = pd.DataFrame(up, columns=["id", "x", "y", "n"])
    above["index"] = np.arange(len(above))
    return level.assign(parent_id=parent), above


def _hierarchy(points: pd.DataFrame, zoom: int, o: Options) -> pd.DataFrame:
    """Level zoom + 1 as given, and all above it."""
    out, level = [], points.sort_values("index", ignore_index=True)
    for z in range(zoom, o.min_zoom - 1, -1):
        done, level = _next_level(level, z, o)
        out.append(done.assign(z=z + 1))
    out.append(level.assign(z=o.min_zoom, parent_id=0))
    return pd.concat(out)[[c.split()[0] for c in LEVEL.split(", ")]].astype({"z": "int32", "index": "int64", "id": "int64", "n": "int64", "parent_id": "int64"})


def _level_by_rounds(level: DataFrame, zoom: int, o: Options) -> tuple[DataFrame, DataFrame]:
    r = o.reach(zoom)
    # the diagonal of a cell is no longer than the radius, and what a point reaches lies within two cells
    side = r / math.sqrt(2) * (1 - 1e-9)
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-2, 3) for j in range(-2, 3)])
    cell = lambda c: F.floor(F.col(c) / side).cast("long")

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("_d", F.explode(around)).withColumns({"cx": F.col("cx") + F.col("_d.dx"), "cy": F.col("cy") + F.col("_d.dy")}).drop("_d")

    open_ = cut(level.select(F.col("index").alias("i"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"), F.lit(None).cast("long").alias("near")), "open")
    takers = []
    while True:
        # the least open index of each cell, and of all cells that its points may reach
        least = open_.groupBy("cx", "cy").agg(F.min("i").alias("own"))
        reach = spread(least).groupBy("cx", "cy").agg(F.min("own").alias("least")).join(least.drop("own"), ["cx", "cy"], "left_semi")
        here = cut(open_.hint("merge").join(reach.hint("merge"), ["cx", "cy"]), "reach")
        # one that no open point of a lesser index may come before, and that no taker has near, takes
        new = here.where("i = least and near is null")
        found = spread(new.select(F.col("i").alias("c"), F.col("x").alias("tx"), F.col("y").alias("ty"), "cx", "cy"))
        within = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 <= r * r
        met = here.hint("merge").join(found.hint("merge"), (here.cx == found.cx) & (here.cy == found.cy), "left").select("i", "x", "y", here.cx, here.cy, "near", "least", F.when(within, F.col("c")).alias("c"))
        met = met.groupBy("i", "x", "y", "cx", "cy", "least").agg(F.least(F.min("near"), F.min("c")).alias("near"))
        # the least taker near a point has it, once no open point of a lesser index can become one
        state = cut(met.withColumn("taken", F.col("near").isNotNull() & (F.col("least") >= F.col("near"))), "state")
        takers.append(state.where("taken").select(F.col("i").alias("index"), F.col("near").alias("taker")))
        open_ = state.where("not taken").drop("taken", "least")
        if open_.isEmpty():
            break
    state = takers[0]
    for t in takers[1:]:
        state = state.unionByName(t)
    j = level.hint("merge").join(state.hint("merge"), "index")
    weight = lambda c: F.sum(F.floor(F.col(c) * _FIXED).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).cast("double")
    sums = j.groupBy("taker").agg(F.sum("n").alias("total"), weight("x").alias("wx"), weight("y").alias("wy"))
    j = j.hint("merge").join(cut(sums, "sums").hint("merge"), "taker")
    grown = F.col("total") >= o.min_points
    own = F.call_function("shiftleft", F.col("taker"), F.lit(5)) + zoom + 1
    done = j.select(F.lit(zoom + 1).alias("z"), "index", "id", "x", "y", "n", F.when(grown, own).otherwise(F.lit(0)).alias("parent_id"))
    heads = j.where(grown & (F.col("index") == F.col("taker"))).select("taker", "index", own.alias("id"), (F.col("wx") / F.col("total") / _FIXED).alias("x"), (F.col("wy") / F.col("total") / _FIXED).alias("y"), F.col("total").alias("n"))
    single = j.where(~grown).select("taker", "index", "id", "x", "y", F.lit(1).cast("long").alias("n"))
    up = numbered(heads.unionByName(single), ["taker", "index"], "place")
    return done, up.select((F.col("place") - 1).alias("index"), "id", "x", "y", "n")


def hierarchy(features: DataFrame, lon: str, lat: str, index: str, o: Options = Options(), task_points: int = TASK_POINTS) -> DataFrame:
    """All levels of features (unique index from 0, lon, lat): z, index, id (the feature's index, or a cluster's id),
    x, y, n, parent_id (0 for none)."""
    x, y = cluster_position(F.col(lon), F.col(lat))
    level = features.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(index).cast("long").alias("index"), F.col(index).cast("long").alias("id"), x.alias("x"), y.alias("y"), F.lit(1).cast("long").alias("n"))
    level, zoom, done = cut(level, "points"), o.max_zoom, []
    while zoom >= o.min_zoom and level.count() > task_points:
        below, level = _level_by_rounds(level, zoom, o)
        done.append(cut(below, "level"))
        level = cut(level, "points")
        zoom -= 1
    rest = level.groupBy().applyInPandas(lambda pdf: _hierarchy(pdf, zoom, o), LEVEL)
    for d in done:
        rest = rest.unionByName(d)
    return rest


def abbreviated(n: Column) -> Column:
    """999, 1.2k, 12k. The digits shown are those of n / 1000 as a double, rounded from its exact value, ties to even."""
    tenths, rest = F.floor(n / 100), n % 100
    # in a tie of decimals the double lies above, below or on it
    exact = (F.floor(n / 1000.0 * float(1 << 52))).cast("decimal(20,0)") * 1000
    tie = n.cast("decimal(10,0)") * F.lit(1 << 52).cast("decimal(20,0)")
    up = (rest > 50) | (rest == 50) & ((exact > tie) | (exact == tie) & (tenths % 2 == 1))
    t = tenths + F.when(up, 1).otherwise(0)
    one = F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("k"))
    return F.when(n < 1000, n.cast("string")).when(n < 10_000, one).otherwise(F.concat(F.bround(n / 1000.0, 0).cast("long").cast("string"), F.lit("k")))


def with_properties(levels: DataFrame) -> DataFrame:
    """cluster, cluster_id, point_count and point_count_abbreviated; null for single points."""
    is_one = F.col("n") > 1
    return levels.withColumns({"cluster": is_one, "cluster_id": F.when(is_one, F.col("id")), "point_count": F.when(is_one, F.col("n")), "point_count_abbreviated": F.when(is_one, abbreviated(F.col("n")))})


def tile(levels: DataFrame, z: int, x: int, y: int, o: Options = Options()) -> DataFrame:
    """What a tile shows, with a buffer of the radius, across the antimeridian as well: rows of its level with tile_x
    and tile_y in units of the extent."""
    side, r, level = 2.0**z, o.radius / o.extent, max(o.min_zoom, min(z, o.max_zoom + 1))
    own = levels.where((F.col("z") == level) & F.col("y").between((y - r) / side, (y + 1 + r) / side))

    def band(low: float, high: float, origin: float) -> DataFrame:
        px = F.round((F.col("x") * side - origin) * o.extent).cast("int")
        return own.where(F.col("x").between(low, high)).withColumns({"tile_x": px, "tile_y": F.round((F.col("y") * side - y) * o.extent).cast("int")})

    out = band((x - r) / side, (x + 1 + r) / side, float(x))
    if x == 0:
        out = out.unionByName(band(1.0 - r / side, 1.0, side))
    if x == side - 1:
        out = out.unionByName(band(0.0, r / side, -1.0))
    return out


def tile_features(levels: DataFrame, z: int, x: int, y: int, o: Options = Options()) -> DataFrame:
    """A tile's points and clusters as features: id, lon, lat, and the properties of a cluster."""
    rows = with_properties(tile(levels, z, x, y, o))
    lon, lat = unproject(F.col("x"), F.col("y"), 1.0)
    return rows.withColumns({"lon": lon, "lat": lat})


def children(levels: DataFrame, cluster_id: int) -> DataFrame:
    """A cluster's members one level below it."""
    return levels.where((F.col("z") == cluster_id % 32) & (F.col("parent_id") == cluster_id))


def leaves(levels: DataFrame, cluster_id: int, limit: int, offset: int = 0, min_zoom: int = 0) -> DataFrame:
    """A cluster's points, depth first by index: the path of indexes from the cluster down orders them."""
    level, found = children(levels, cluster_id).select("id", "n", F.array("index").alias("path")), []
    for z in range(cluster_id % 32 + 1, 32):
        found.append(level.where("n = 1").select("id", "path"))
        deeper = level.where("n > 1").select(F.col("id").alias("parent_id"), "path")
        below = levels.where(F.col("z") == z).select("parent_id", "index", "id", "n")
        level = below.join(deeper, "parent_id").select("id", "n", F.concat("path", F.array("index")).alias("path"))
        if z > 26:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy("path").offset(offset).limit(limit).select("id")


def expansion_zoom(levels: DataFrame, cluster_id: int, o: Options = Options()) -> int:
    """The first zoom at which a cluster has other than one child."""
    zoom = cluster_id % 32 - 1
    while zoom <= o.max_zoom:
        below = children(levels, cluster_id).select("id").limit(2).collect()
        zoom += 1
        if len(below) != 1:
            break
        cluster_id = below[0].id
    return zoom


def reach_degrees(o: Options, zoom: int) -> float:
    return math.degrees(2 * math.pi * o.reach(zoom))
