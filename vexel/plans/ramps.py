"""Ramps: an expression over one parameter, tabulated."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.compiler import compile_expression, to_color
from ..lang.values import ExpressionError, Fields

SIZE = 256


def bake(spark: SparkSession, expression, size: int = SIZE) -> DataFrame:
    """A row for each of `size` evenly spaced parameters: i, t (4 * i / (4 * size)), and the color's channels."""
    t = F.col("i") * 4.0 / (4.0 * size)
    v = to_color([compile_expression(expression, Fields(ramp=t))])
    if v.deps - {"ramp", "zoom"}:
        raise ExpressionError("A ramp depends on its parameter alone.")
    c = v.col if v.ok is None else F.when(v.ok, v.col)
    return spark.range(size).select(F.col("id").cast("int").alias("i")).select("i", t.alias("t"), *[c[x].alias(x) for x in "rgba"])


def elevation_stops(expression) -> list[tuple[float, object]]:
    """The (elevation, color) stops of an interpolation over elevation."""
    if not isinstance(expression, list) or expression[:1] != ["interpolate"] or expression[2:3] != [["elevation"]]:
        raise ExpressionError("A relief ramp is an interpolation over elevation.")
    rest = expression[3:]
    return [(float(a), b) for a, b in zip(rest[::2], rest[1::2])]


def with_ramp(fields: Fields, t) -> Fields:
    return replace(fields, ramp=t)
