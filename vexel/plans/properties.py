"""The table of layer properties, and how a written property becomes a Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang import color
from ..lang.compiler import Compiler, property_column, to_color
from ..lang.legacy import LegacyFunction, is_function
from ..lang.values import ABSENT, ExpressionError, Fields, Val, asserted, literal, text_of

# Name, kind, default and whether it may depend on the feature, in the order of declaration.
_TABLE = """
background paint
background-color color #000000 no
background-opacity number 1 no
background-pattern image - no
fill paint
fill-antialias boolean true no
fill-color color #000000 yes
fill-opacity number 1 yes
fill-outline-color color transparent yes
fill-pattern image - yes
fill-translate numbers2 0,0 no
fill-translate-anchor enum map no
fill layout
fill-sort-key number 0 yes
line paint
line-blur number 0 yes
line-color color #000000 yes
line-dasharray numbers - no
line-floorwidth number 1 yes
line-gap-width number 0 yes
line-gradient color - no
line-offset number 0 yes
line-opacity number 1 yes
line-pattern image - yes
line-translate numbers2 0,0 no
line-translate-anchor enum map no
line-width number 1 yes
line layout
line-cap enum butt no
line-join enum miter yes
line-miter-limit number 2 no
line-round-limit number 1.05 no
line-sort-key number 0 yes
circle paint
circle-blur number 0 yes
circle-color color #000000 yes
circle-opacity number 1 yes
circle-pitch-alignment enum viewport no
circle-pitch-scale enum map no
circle-radius number 5 yes
circle-stroke-color color #000000 yes
circle-stroke-opacity number 1 yes
circle-stroke-width number 0 yes
circle-translate numbers2 0,0 no
circle-translate-anchor enum map no
circle layout
circle-sort-key number 0 yes
heatmap paint
heatmap-color color - no
heatmap-intensity number 1 no
heatmap-opacity number 1 no
heatmap-radius number 30 yes
heatmap-weight number 1 yes
raster paint
raster-brightness-max number 1 no
raster-brightness-min number 0 no
raster-contrast number 0 no
raster-fade-duration number 300 no
raster-hue-rotate number 0 no
raster-opacity number 1 no
raster-resampling enum linear no
raster-saturation number 0 no
location-indicator paint
accuracy-radius number 0 no
accuracy-radius-border-color color #ffffff no
accuracy-radius-color color #ffffff no
bearing number 0 no
bearing-image-size number 1 no
image-tilt-displacement number 0 no
location numbers3 - no
perspective-compensation number 0.85 no
shadow-image-size number 1 no
top-image-size number 1 no
location-indicator layout
bearing-image image - no
shadow-image image - no
top-image image - no
color-relief paint
color-relief-color color - no
color-relief-opacity number 1 no
hillshade paint
hillshade-accent-color color #000000 no
hillshade-exaggeration number 0.5 no
hillshade-highlight-color colors #ffffff no
hillshade-illumination-altitude numberlist 45 no
hillshade-illumination-anchor enum viewport no
hillshade-illumination-direction numberlist 335 no
hillshade-method enum standard no
hillshade-shadow-color colors #000000 no
fill-extrusion paint
fill-extrusion-base number 0 yes
fill-extrusion-color color #000000 yes
fill-extrusion-height number 0 yes
fill-extrusion-opacity number 1 no
fill-extrusion-pattern image - yes
fill-extrusion-translate numbers2 0,0 no
fill-extrusion-translate-anchor enum map no
fill-extrusion-vertical-gradient boolean true no
symbol paint
icon-color color #000000 yes
icon-halo-blur number 0 yes
icon-halo-color color transparent yes
icon-halo-width number 0 yes
icon-opacity number 1 yes
icon-translate numbers2 0,0 no
icon-translate-anchor enum map no
text-color color #000000 yes
text-halo-blur number 0 yes
text-halo-color color transparent yes
text-halo-width number 0 yes
text-opacity number 1 yes
text-translate numbers2 0,0 no
text-translate-anchor enum map no
"""


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str
    default: object
    data_driven: bool


def _specs() -> dict[tuple[str, str], dict[str, Spec]]:
    out: dict[tuple[str, str], dict[str, Spec]] = {}
    now: dict[str, Spec] = {}
    for line in _TABLE.strip().splitlines():
        parts = line.split()
        if len(parts) == 2:
            now = out.setdefault((parts[0], parts[1]), {})
            continue
        name, kind, default, driven = parts
        if default == "-":
            value: object = None
        elif kind in ("number", "numberlist"):
            value = float(default)
        elif kind == "boolean":
            value = default == "true"
        elif kind.startswith("numbers"):
            value = [float(x) for x in default.split(",")]
        else:
            value = default
        now[name] = Spec(name, kind, value, driven == "yes")
    return out


SPECS = _specs()

#: The language's type of each kind of property, and whether its values can be mixed.
_TYPES = {"color": ("color", True), "number": ("number", True), "boolean": ("boolean", False), "enum": ("string", False), "image": ("string", False), "numbers": ("array", True), "numberlist": ("number", True), "colors": ("color", True)}


def _type(spec: Spec) -> tuple[str, bool]:
    return _TYPES[spec.kind.rstrip("0123456789")]


@dataclass(frozen=True)
class Property:
    """A resolved property. binding: constant, zoom, feature or composite (feature and zoom)."""

    spec: Spec
    value: Val
    binding: str

    def column(self) -> Column:
        """The value for each feature, with the default in place of errors."""
        return property_column(self.value, default_column(self.spec))


def default_column(spec: Spec) -> Column:
    if spec.default is None:
        return F.lit(None)
    if spec.kind in ("color", "colors"):
        return color.column(color.parse(spec.default))
    return literal(spec.default).col


def resolve(spec: Spec, written, fields: Fields) -> Property:
    """A property as written (absent: ABSENT). Raises for what doesn't compile, has the wrong type, or depends on the
    feature where the property can't."""
    kind, mixes = _type(spec)
    if written is ABSENT or written is None:
        v = Val(kind, default_column(spec))
    elif is_function(written):
        v = LegacyFunction(written, fields, None if kind == "array" else kind, mixes, spec.default).compile()
    else:
        v = Compiler(fields).compile(["literal", written] if isinstance(written, list) and not (written and isinstance(written[0], str)) else written)
        v = coerced(v, kind)
    feature = bool(v.deps & {"feature", "state"})
    if feature and not spec.data_driven:
        raise ExpressionError(f"\"{spec.name}\" does not support data expressions.")
    zoom = "zoom" in v.deps
    return Property(spec, v, "composite" if feature and zoom else "feature" if feature else "zoom" if zoom else "constant")


def coerced(v: Val, kind: str) -> Val:
    """A value as a property's type: colors and texts are converted, others asserted."""
    if kind == "color":
        return to_color([v])
    if kind == "string" and v.kind in ("number", "boolean", "formatted", "image"):
        return Val("string", text_of(v), v.ok).with_deps(v)
    if kind in ("string", "formatted") and v.kind in ("value", "null"):
        # what is only known when it is read is written as text, and what is missing is empty
        text = F.coalesce(text_of(v), F.lit("")) if v.kind == "value" else F.lit("")
        v = Val("string", text, v.ok).with_deps(v)
    if kind == "formatted" and v.kind in ("string", "number", "boolean"):
        none = [F.lit(None).cast(t).alias(n) for n, t in (("image", "string"), ("scale", "double"), ("font", "array<string>"), ("color", "struct<r:double,g:double,b:double,a:double>"))]
        return Val("formatted", F.array(F.struct(text_of(v).alias("text"), *none)), v.ok).with_deps(v)
    return v if v.kind == kind else asserted(v, kind)


def resolve_group(layer_type: str, group: str, written: dict, fields: Fields) -> dict[str, Property]:
    """All of a layer type's properties, written or not."""
    return {n: resolve(s, written.get(n, ABSENT), fields) for n, s in SPECS.get((layer_type, group), {}).items()}


def at_two_zooms(spec: Spec, written, fields_at) -> tuple[Column, Column]:
    """A composite property's values at an integer zoom and the next one; fields_at gives the fields at 0 or 1 above."""
    return resolve(spec, written, fields_at(0)).column(), resolve(spec, written, fields_at(1)).column()
