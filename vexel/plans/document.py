"""Style documents: sources and ordered layers, each layer a declarative query over one source."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.compiler import Compiler
from ..lang.filters import compile_filter, pushable
from ..lang.values import ExpressionError, Fields, Val, column_value
from ..operators.ordered import numbered
from .properties import SPECS, Property, resolve_group

#: Layer types that answer from features.
FEATURE_TYPES = ("fill", "line", "circle", "heatmap", "fill-extrusion", "symbol")


class StyleError(ValueError):
    pass


@dataclass
class Layer:
    id: str
    type: str
    source: str | None = None
    source_layer: str | None = None
    minzoom: float = 0.0
    maxzoom: float = 24.0
    filter: object = None
    paint: dict = field(default_factory=dict)
    layout: dict = field(default_factory=dict)

    def built_at(self, z: int) -> bool:
        """Whether a tile of zoom z holds the layer."""
        return math.floor(self.minzoom) <= z < math.ceil(self.maxzoom)

    def shown_at(self, zoom: float) -> bool:
        return self.minzoom <= zoom <= self.maxzoom


@dataclass
class Style:
    sources: dict[str, dict]
    layers: list[Layer]
    rejected: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str | dict, config: dict | None = None) -> Style:
        d = json.loads(text) if isinstance(text, str) else text
        if d.get("version") != 8:
            raise StyleError(f"unsupported style version {d.get('version')}")
        options = {n: o.get("default") if isinstance(o, dict) else o for n, o in d.get("schema", {}).items()} | (config or {})
        d = substituted(d, options)
        layers, seen = [], set()
        for x in d.get("layers", []):
            if x["id"] in seen:
                raise StyleError(f"layer id {x['id']} is used twice")
            seen.add(x["id"])
            layers.append(Layer(x["id"], x["type"], x.get("source"), x.get("source-layer"), float(x.get("minzoom", 0)), float(x.get("maxzoom", 24)), x.get("filter"), x.get("paint", {}), x.get("layout", {})))
        return cls(d.get("sources", {}), layers)

    def used_sources(self) -> list[str]:
        """Only sources that a layer draws, in order of first use."""
        return list(dict.fromkeys(x.source for x in self.layers if x.source in self.sources))

    def font_stacks(self) -> tuple[set[tuple[str, ...]], bool]:
        """The constant font stacks of symbol layers, and whether some layer computes its own."""
        found, computed = set(), False
        for x in self.layers:
            if x.type == "symbol":
                f = x.layout.get("text-font", ["Open Sans Regular", "Arial Unicode MS Regular"])
                if isinstance(f, list) and f and f[0] == "literal":
                    f = f[1]
                if isinstance(f, list) and all(isinstance(n, str) for n in f) and f and f[0] not in ("case", "match", "step", "get", "coalesce", "let"):
                    found.add(tuple(f))
                else:
                    computed = True
        return found, computed


def substituted(x, options: dict):
    """x with each ["config", name] replaced by its option; unknown names become null. Import scopes ask for name@import."""
    if isinstance(x, list):
        if x[:1] == ["config"] and len(x) in (2, 3) and all(isinstance(i, str) for i in x[1:]):
            return options.get(x[1] if len(x) == 2 else f"{x[1]}@{x[2]}")
        return [substituted(i, options) for i in x]
    if isinstance(x, dict):
        return {k: substituted(v, options) for k, v in x.items()}
    return x


@dataclass
class Compiled:
    """A layer as Columns over its source's rows."""

    layer: Layer
    index: int
    filter: Column
    pushed: Column | None
    paint: dict[str, Property]
    layout: dict[str, Property]
    sort_key: Val | None

    def rows(self, features: DataFrame, order: str = "feature_index") -> DataFrame:
        """The features that the layer draws, with its properties as columns and, if a sort key is written, a rank by
        it; equal keys keep the order of the source, failures count as 0."""
        df = features
        if self.layer.source_layer is not None and "source_layer" in df.columns:
            df = df.where(F.col("source_layer") == self.layer.source_layer)
        if self.pushed is not None:
            df = df.where(self.pushed)
        df = df.where(self.filter)
        out = [F.lit(self.layer.id).alias("layer"), F.lit(self.index).alias("layer_index")]
        out += [p.column().alias(n) for n, p in {**self.paint, **self.layout}.items()]
        key = F.lit(0.0) if self.sort_key is None else F.coalesce(self.sort_key.col if self.sort_key.ok is None else F.when(self.sort_key.ok, self.sort_key.col), F.lit(0.0))
        return df.select(*df.columns, *out, key.alias("sort_key"))


class Plan:
    """Style and sources to lazy DataFrames: one a layer. A layer that doesn't compile is left out, with its reason."""

    def __init__(self, style: Style, sources: dict[str, DataFrame], zoom: float, state: Callable[[str], Fields] | None = None):
        self.style, self.sources, self.zoom = style, sources, zoom
        self.compiled: list[Compiled] = []
        self.rejected = dict(style.rejected)
        for i, layer in enumerate(style.layers):
            if layer.source not in sources or layer.type not in FEATURE_TYPES or not layer.built_at(math.floor(zoom)):
                continue
            try:
                self.compiled.append(compile_layer(layer, i, self.fields(sources[layer.source])))
            except (ExpressionError, KeyError, TypeError) as e:
                self.rejected[layer.id] = str(e)

    def fields(self, df: DataFrame) -> Fields:
        return feature_fields(df, self.zoom)

    def layer(self, layer_id: str) -> DataFrame:
        c = next(c for c in self.compiled if c.layer.id == layer_id)
        return c.rows(self.sources[c.layer.source])

    def draw_order(self, columns: list[str]) -> DataFrame:
        """All layers' rows in drawing order: by layer, then sort key, then the source's order."""
        parts = [c.rows(self.sources[c.layer.source]).select("layer", "layer_index", "sort_key", "feature_index", *columns) for c in self.compiled]
        return reduce(DataFrame.unionByName, parts).orderBy("layer_index", "sort_key", "feature_index")


def feature_fields(df: DataFrame, zoom=None) -> Fields:
    """The canonical parts of a feature table: props (VARIANT or columns), id, geom_type, geom, state."""
    types = {f.name: f.dataType for f in df.schema.fields}
    own = {"id", "geom_type", "geom", "props", "state", "feature_index", "source_layer"}
    f = Fields.of(df.select(*[n for n in types if n not in own])) if "props" not in types else Fields(column_value(F.col("props"), types["props"]).col)
    f.id = column_value(F.col("id"), types["id"]) if "id" in types else None
    f.geom_type = F.col("geom_type") if "geom_type" in types else None
    f.geom = F.col("geom") if "geom" in types else None
    f.state = F.col("state") if "state" in types else None
    f.zoom = zoom
    return f


def compile_layer(layer: Layer, index: int, fields: Fields) -> Compiled:
    key = layer.layout.get(f"{layer.type}-sort-key")
    sort_key = Compiler(fields, state_allowed=False).of(key, "number") if key is not None else None
    known = {n: v for n, v in layer.layout.items() if n in SPECS.get((layer.type, "layout"), {})}
    return Compiled(layer, index, compile_filter(layer.filter, fields), pushable(layer.filter, fields), resolve_group(layer.type, "paint", layer.paint, fields), resolve_group(layer.type, "layout", known, fields), sort_key)


_TOKEN = re.compile(r"\{([^{}]*)\}")


def label_template(text: str, fields: Fields) -> Column:
    """{name} in a label text stands for a property's text; a missing one is empty, and an unclosed brace is literal."""
    from ..lang.values import text_of

    parts, at = [], 0
    for m in _TOKEN.finditer(text):
        parts.append(F.lit(text[at : m.start()]))
        parts.append(text_of(Compiler(fields).get("get", [m[1]])))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def ranked(df: DataFrame, by: list[str], tie: str) -> DataFrame:
    """A dense place from 1 within each layer."""
    return numbered(df, [*by, tie], "place", ["layer"])


def images_used(style: Style) -> set[str]:
    """Image names that layers name outright, or as outcomes of their expressions."""
    found: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, str):
            found.add(x)
        elif isinstance(x, list) and x:
            if x[0] in ("match", "case", "step", "coalesce", "image", "literal", "let", "interpolate"):
                # labels and inputs of a match aren't outcomes
                parts = [*x[3::2], x[-1]] if x[0] == "match" else [*x[2::2], x[-1]] if x[0] in ("case", "step") else x[1:]
                for p in parts:
                    walk(p)
        elif isinstance(x, dict):
            for _, v in x.get("stops", []):
                walk(v)

    names = {n for group in SPECS.values() for n, s in group.items() if s.kind == "image"} | {"icon-image"}
    for layer in style.layers:
        for name, written in {**layer.paint, **layer.layout}.items():
            if name in names:
                walk(written)
    return found


def replaced(held: DataFrame | None, new: DataFrame, source: str, revision: int) -> DataFrame:
    """The features of all sources with one source's replaced; its rows carry the new data revision, so what was built
    from older ones no longer matches."""
    rows = new.withColumns({"source": F.lit(source), "revision": F.lit(revision)})
    if held is None:
        return rows
    return held.where(F.col("source") != source).unionByName(rows.select(*held.columns))
