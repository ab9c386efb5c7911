"""Smaller parts of a style: sizes over zooms, faded values, lights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang import color
from ..lang.compiler import Compiler, property_column
from ..lang.values import ExpressionError, Fields


def size_range(expression, fields_at, zoom: float, default: float) -> tuple[Column, Column]:
    """A label's size at the integer zooms around a zoom; equal where it doesn't depend on zoom. fields_at(zoom) gives the
    fields; an error is the default."""
    low = math.floor(zoom)

    def at(z: float) -> Column:
        f: Fields = fields_at(z)
        return property_column(Compiler(f).of(expression, "number"), F.lit(float(default)))

    depends = "zoom" in Compiler(fields_at(float(low))).of(expression, "number").deps
    return (at(float(low)), at(float(low + 1))) if depends else (at(float(low)),) * 2


def transformed(text: Column, transform: Column) -> Column:
    """A label's text by its text-transform: uppercase, lowercase, or anything else for none."""
    return F.when(transform == "uppercase", F.upper(text)).when(transform == "lowercase", F.lower(text)).otherwise(text)


def faded(evaluate, zoom: float, last_integer_zoom: float) -> tuple:
    """The values a pattern is between: from the level it comes from, to its own."""
    return evaluate(zoom - 1 if zoom > last_integer_zoom else zoom + 1), evaluate(zoom)


def fade_factor(zoom: float, elapsed_ms: float, duration_ms: float = 300.0) -> tuple[float, float]:
    """(share of the new value, scale of the fraction) of a fade."""
    fraction = zoom - math.floor(zoom)
    t = 1.0 if duration_ms <= 0 else min(1.0, max(0.0, elapsed_ms / duration_ms))
    return t, fraction


def pattern_names(values: list, zoom: float) -> list[str]:
    """The distinct images that properties name at a zoom and next to it, in order."""
    found = (f(z) for f in values for z in (zoom - 1, zoom, zoom + 1))
    return list(dict.fromkeys(n for n in found if n))


def light(written: dict | None) -> dict:
    """A light's parts with their defaults, and its direction as x, y, z."""
    w = written or {}
    position = w.get("position", [1.15, 210, 30])
    anchor, tint = w.get("anchor", "viewport"), color.parse(w.get("color", "#ffffff"))
    if not isinstance(position, list) or len(position) != 3 or anchor not in ("map", "viewport") or tint is None:
        raise ExpressionError("This light can't be read.")
    r, a, p = position[0], math.radians(position[1] + 90), math.radians(position[2])
    return {"anchor": anchor, "color": tint, "intensity": float(w.get("intensity", 0.5)), "position": position, "direction": (r * math.cos(a) * math.sin(p), r * math.sin(a) * math.sin(p), r * math.cos(p))}
