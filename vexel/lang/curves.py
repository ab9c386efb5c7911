"""Interpolation: stops, factors and easing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ExpressionError


def stops(args: list, name: str) -> tuple[list[float], list]:
    """Alternating inputs and outputs; inputs are numbers in strictly ascending order."""
    if not args or len(args) % 2:
        raise ExpressionError(f"\"{name}\" needs pairs of input and output.")
    at = args[::2]
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in at):
        raise ExpressionError("Stop inputs must be numbers.")
    if any(b <= a for a, b in zip(at, at[1:])):
        raise ExpressionError("Stop inputs must be in strictly ascending order.")
    return [float(x) for x in at], args[1::2]


def is_interpolation(x) -> tuple[str, float, list[float]]:
    if isinstance(x, list) and x:
        if x[0] == "linear" and len(x) == 1:
            return "linear", 1.0, []
        if x[0] == "exponential" and len(x) == 2 and isinstance(x[1], (int, float)):
            return "exponential", float(x[1]), []
        if x[0] == "cubic-bezier" and len(x) == 5 and all(isinstance(c, (int, float)) and 0 <= c <= 1 for c in x[1:]):
            return "cubic-bezier", 1.0, [float(c) for c in x[1:]]
    raise ExpressionError("Unknown interpolation.")


def factor(x: Column, base: float, low: float, high: float) -> Column:
    """How far x is from low to high."""
    span = high - low
    if span <= 0:
        return F.lit(0.0)
    if abs(base - 1) < 1e-6:
        return (x - low) / span
    return (F.pow(F.lit(base), x - low) - 1) / (math.pow(base, span) - 1)


def bezier(x: Column, x1: float, y1: float, x2: float, y2: float, rounds: int = 30) -> Column:
    """The height of the curve through (0, 0), (x1, y1), (x2, y2), (1, 1) at x: x is monotonous in the curve's parameter,
    which is found by halving."""

    def at(t: Column, a: float, b: float) -> Column:
        return ((1 - 3 * b + 3 * a) * t + (3 * b - 6 * a)) * t * t + 3 * a * t

    def halve(low: Column, half: Column) -> Column:
        # what is halved ends at low + 2 * half: all of these numbers are whole parts of 2^-30, so sums are exact
        return F.when(at(low + half, x1, x2) < bound, low + half).otherwise(low)

    def height(x: Column) -> Column:
        nonlocal bound
        bound = x
        halves = F.array(*[F.lit(2.0**-i) for i in range(1, rounds + 1)])
        found = F.aggregate(halves, F.lit(0.0), halve, lambda low: at(low + 2.0 ** -(rounds + 1), y1, y2))
        return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(found)

    # x is bound to a variable, so that what makes it is evaluated once
    bound = x
    return F.get(F.transform(F.array(x), height), F.lit(0))
