"""The host's side: one object that holds a style, its sources, feature states and a view, and answers with DataFrames.

Nothing runs until a result is asked for; a change makes new plans, old results stay what they were."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import frames, tiles
from .plans import box_query
from .plans.document import Plan, Style, replaced
from .sources import annotations, geojson
from .spatial import cover
from .spatial.projection import LATITUDE_MAX

_KINDS = {"fill": "Polygon", "line": "LineString", "circle": "Point"}


def on_screen(view: cover.View, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(x, y, w) of places on a view's screen, as Columns; w is no more than 0 for what lies above the horizon."""
    world, (cx, cy) = view.world, view._center()
    a, p, d = math.radians(view.bearing), math.radians(view.pitch), view._distance()
    lat = F.greatest(F.lit(-LATITUDE_MAX), F.least(F.lit(LATITUDE_MAX), lat))
    x = (lon + 180.0) / 360.0 * world
    y = (180.0 - F.degrees(F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)))) / 360.0 * world
    dx, dy = x - cx, y - cy
    u, v = dx * math.cos(a) + dy * math.sin(a), dy * math.cos(a) - dx * math.sin(a)
    w = F.lit(d) - v * math.sin(p)
    return F.lit(view.width / 2) + u * d / w, F.lit(view.height / 2) + v * math.cos(p) * d / w, w


class Engine:
    def __init__(self, spark: SparkSession, view: cover.View | None = None):
        self.spark = spark
        self.view = view or cover.View(lon=0.0, lat=0.0, zoom=0.0, width=1024, height=768)
        self.style: Style | None = None
        self.sources: dict[str, DataFrame] = {}
        self.revisions: dict[str, int] = {}
        self.states: dict[str, DataFrame] = {}

    # -- what the host sets

    def set_style(self, style: str | dict, config: dict | None = None) -> None:
        """The style; GeoJSON that its sources hold inline becomes their data."""
        self.style = Style.parse(style, config)
        for name, source in self.style.sources.items():
            data = source.get("data") if source.get("type") == "geojson" else None
            if isinstance(data, dict):
                import json

                self.set_source(name, geojson.features(self.spark.createDataFrame([(json.dumps(data),)], "doc string")))

    def set_source(self, name: str, features: DataFrame) -> None:
        """Canonical features for a source, in place of those it had."""
        self.revisions[name] = self.revisions.get(name, 0) + 1
        self.sources[name] = replaced(None, features, name, self.revisions[name])

    def set_annotations(self, symbols: DataFrame) -> None:
        """Annotations (id, lon, lat, icon) as a source of their own."""
        point = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
        rows = symbols.select(F.col("id").alias("feature_index"), "id", F.lit("Point").alias("geom_type"), F.array(F.array(F.array(point))).alias("geom"), F.to_variant_object(F.struct("icon")).alias("props"))
        self.set_source("annotations", rows)

    def set_feature_state(self, source: str, changes: DataFrame) -> None:
        """changes (seq, id, key, value as JSON text; a null value clears the key, a null key all keys) on top of what holds."""
        held = self.states.get(source)
        self.states[source] = changes if held is None else held.unionByName(changes)

    def clear_feature_state(self, source: str) -> None:
        self.states.pop(source, None)

    def set_view(self, **parts) -> None:
        self.view = replace(self.view, **parts)

    # -- answers

    def status(self) -> dict:
        """What is set, and which layers don't compile."""
        plan = self._plan() if self.style else None
        return {"layers": [] if plan is None else [c.layer.id for c in plan.compiled], "rejected": {} if plan is None else plan.rejected, "sources": dict(self.revisions)}

    def _plan(self) -> Plan:
        sources = {}
        for name, rows in self.sources.items():
            if name in self.states and "id" in rows.columns:
                kept = frames.feature_states(self.states[name].withColumn("source", F.lit(name)))
                own = F.when(F.col("_state").isNotNull(), F.parse_json("_state"))
                key = F.try_variant_get("id", "$", "string") if rows.schema["id"].dataType.typeName() == "variant" else F.col("id").cast("string")
                rows = rows.withColumn("_key", key).join(kept.select(F.col("id").cast("string").alias("_key"), F.col("state").alias("_state")), "_key", "left").withColumn("state", own).drop("_key", "_state")
            sources[name] = rows.drop("source", "revision")
        return Plan(self.style, sources, self.view.zoom)

    def tiles(self, max_zoom: int = 22) -> DataFrame:
        """The tiles of the view (z, x, y), each once."""
        found = cover.pitched_tiles(self.view, max_zoom) if self.view.pitch else cover.view_tiles(self.view, 0, max_zoom)
        return tiles.folded(cover.as_frame(self.spark, found)).select("z", "x", "y")

    def frame(self) -> dict[str, DataFrame]:
        """Each layer that the view's zoom shows, bottom first, as a DataFrame of its features and properties."""
        plan = self._plan()
        return {c.layer.id: plan.layer(c.layer.id) for c in plan.compiled if c.layer.shown_at(self.view.zoom)}

    def screen(self) -> DataFrame:
        """The features of all shown layers of fills, lines and circles in units of the screen, as the box query takes them."""
        plan, parts = self._plan(), []
        for c in plan.compiled:
            layer = c.layer
            if layer.type not in _KINDS or not layer.shown_at(self.view.zoom):
                continue
            rows = plan.layer(layer.id)

            def at(p: Column) -> Column:
                x, y, w = on_screen(self.view, p["x"], p["y"])
                return F.struct(F.when(w > 1e-9, x).alias("x"), F.when(w > 1e-9, y).alias("y"))

            geom = F.transform("geom", lambda part: F.transform(part, lambda line: F.filter(F.transform(line, at), lambda p: p["x"].isNotNull())))
            paint = lambda n: F.col(n).cast("double") if n in rows.columns else F.lit(None).cast("double")
            key = F.try_variant_get("id", "$", "string") if "id" in rows.columns and rows.schema["id"].dataType.typeName() == "variant" else F.col("id").cast("string") if "id" in rows.columns else F.lit(None).cast("string")
            parts.append(
                rows.select(
                    F.lit(layer.id).alias("layer"), F.lit(c.index).alias("layer_index"), F.col("feature_index").cast("long").alias("ord"), key.alias("id"), F.lit(layer.source).alias("source"), F.lit(layer.type).alias("kind"), F.col("geom_type"), geom.alias("geom"),
                    paint("line-width").alias("line_width"), paint("line-gap-width").alias("gap_width"), paint("line-offset").alias("line_offset"), paint("circle-radius").alias("radius"), paint("circle-stroke-width").alias("stroke"),
                )
            )
        if not parts:
            raise ValueError("no layer of the style can be queried")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def query(self, x0: float, y0: float, x1: float, y1: float, layers: list[str] | None = None) -> DataFrame:
        """What a box of the screen touches: layer, ord, id, source; top layer first once ordered by box_query.ordered()."""
        return box_query.query(self.screen(), x0, y0, x1, y1, layers)

    def query_geojson(self, x0: float, y0: float, x1: float, y1: float, layers: list[str] | None = None) -> DataFrame:
        return box_query.as_geojson(self.query(x0, y0, x1, y1, layers), ["layer", "source"])

    def annotation_tile(self, z: int, x: int, y: int) -> DataFrame:
        rows = self.sources["annotations"]
        p = F.col("geom")[0][0][0]
        return annotations.tile_symbols(rows.select("id", p["x"].alias("lon"), p["y"].alias("lat"), F.try_variant_get("props", "$.icon", "string").alias("icon")), z, x, y)
