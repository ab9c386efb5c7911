"""Annotations: symbols (id, lon, lat, icon) and shapes (id, kind, geom) that a host adds, changes and removes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..spatial.projection import project


def added(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """New annotations get the next ids, in order of their column ord."""
    top = annotations.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    own = numbered(new, ["ord"], "_n").join(F.broadcast(top)).withColumn("id", (F.col("top") + F.col("_n")).cast("long"))
    return annotations.unionByName(own.select(*annotations.columns))


def updated(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Annotations with what changes has for their ids; ids that aren't there change nothing."""
    known = changes.join(annotations.select("id"), "id", "left_semi")
    return removed(annotations, known).unionByName(known.select(*annotations.columns))


def removed(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    return annotations.join(ids.select("id"), "id", "left_anti")


def tile_symbols(symbols: DataFrame, z: int, x: int, y: int, buffer: float = 0.0) -> DataFrame:
    """A tile's symbols, in order of id, with tile_x and tile_y in units of the extent."""
    u, v = project(F.col("lon"), F.col("lat"), float(1 << z))
    inside = (u >= x - buffer) & (u < x + 1 + buffer) & (v >= y - buffer) & (v < y + 1 + buffer)
    units = lambda c, o: F.round((c - o) * 8192).cast("int")
    return symbols.where(inside).withColumns({"tile_x": units(u, x), "tile_y": units(v, y)}).orderBy("id")


def from_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical features as (symbols, shapes): each point a symbol, lines and polygons shapes."""
    icon = F.try_variant_get("props", "$.icon", "string")
    points = features.where("geom_type = 'Point'").select("feature_index", icon.alias("icon"), F.posexplode(F.flatten(F.flatten("geom"))).alias("part", "p"))
    symbols = points.select(F.struct("feature_index", "part").alias("ord"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), F.coalesce("icon", F.lit("default_marker")).alias("icon"))
    shapes = features.where("geom_type in ('LineString', 'Polygon')").select(F.col("feature_index").alias("ord"), F.col("geom_type").alias("kind"), "geom")
    return symbols, shapes
