"""Feature filters in both dialects, as boolean Columns that are never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compiler import Compiler, filter_column
from .values import ExpressionError, Fields, Val, equal, literal, narrowed

_ORDERED = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def is_expression_filter(f) -> bool:
    """Which dialect an array is of. The dialects share operator names, so arity and nesting decide."""
    if not isinstance(f, list) or not f or not isinstance(f[0], str):
        return False
    op, rest = f[0], f[1:]
    if op in ("!in", "!has", "none"):
        return False
    if op == "has":
        return bool(rest) and isinstance(rest[0], str) and rest[0] not in ("$id", "$type")
    if op == "in":
        return len(rest) >= 2 and (not isinstance(rest[0], str) or isinstance(rest[1], list))
    if op in ("==", "!=", *_ORDERED):
        return len(rest) != 2 or any(isinstance(x, list) for x in rest)
    if op in ("any", "all"):
        return all(isinstance(x, bool) or is_expression_filter(x) for x in rest)
    return True


class LegacyFilter:
    """The older dialect: total, so a missing property or one of another type is simply no match."""

    def __init__(self, fields: Fields):
        self.fields, self.compiler = fields, Compiler(fields)

    def column(self, f) -> Column:
        if f is None:
            return F.lit(True)
        if not isinstance(f, list) or not f:
            raise ExpressionError("A filter must be an array.")
        if not isinstance(f[0], str):
            raise ExpressionError("A filter's operator must be a string.")
        op, rest = f[0], f[1:]
        if not rest:
            return F.lit(op != "any")
        if op in ("any", "all", "none"):
            parts = [self.column(x) for x in rest]
            if op == "all":
                return reduce(lambda a, b: a & b, parts)
            found = reduce(lambda a, b: a | b, parts)
            return ~found if op == "none" else found
        negated = op in ("!=", "!in", "!has")
        if op == "==" or op == "!=":
            c = self._is(self._target(rest), rest[1] if len(rest) > 1 else None)
        elif op in _ORDERED:
            c = self._ordered(op, rest)
        elif op in ("in", "!in"):
            target = self._target(rest)
            c = reduce(lambda a, b: a | b, [self._is(target, x) for x in rest[1:]], F.lit(False)) if len(rest) < 50 else self._in_many(target, rest[1:])
        elif op in ("has", "!has"):
            c = self._has(rest)
        elif op == "within":
            raise ExpressionError("\"within\" is no operator of legacy filters.")
        else:
            return F.lit(True)
        return ~c if negated else c

    def _name(self, rest: list) -> str:
        if not isinstance(rest[0], str):
            raise ExpressionError("A filter's property must be a string.")
        return rest[0]

    def _target(self, rest: list) -> Val:
        name = self._name(rest)
        if name == "$type":
            return self.compiler.geometry_type("geometry-type", [])
        if name == "$id":
            return self.compiler.id("id", [])
        return self.compiler.get("get", [name])

    def _is(self, target: Val, x) -> Column:
        """A property that is missing equals nothing, null included."""
        if target.kind == "null" or x is None:
            return F.lit(False)
        return F.coalesce(target.col.isNotNull() & equal(target, literal(x)), F.lit(False))

    def _in_many(self, target: Val, values: list) -> Column:
        """Long lists by type: the plan holds one IN list each."""
        c = F.lit(False)
        for kind, of in (("string", str), ("number", (int, float)), ("boolean", bool)):
            own = [x for x in values if isinstance(x, of) and (kind == "boolean") == isinstance(x, bool)]
            if own and target.kind in (kind, "value"):
                c = c | F.coalesce(narrowed(target, kind).col.isin([float(x) if kind == "number" else x for x in own]), F.lit(False))
        return c

    def _ordered(self, op: str, rest: list) -> Column:
        if self._name(rest) == "$type":
            raise ExpressionError(f"\"{op}\" can't be applied to $type.")
        target, x = self._target(rest), rest[1] if len(rest) > 1 else None
        if isinstance(x, bool) or not isinstance(x, (str, int, float)):
            return F.lit(False)
        kind = "string" if isinstance(x, str) else "number"
        if target.kind not in (kind, "value"):
            return F.lit(False)
        c = narrowed(target, kind).col
        found = getattr(c, _ORDERED[op])(F.lit(x if kind == "string" else float(x)))
        if kind == "number":
            found = found & ~F.isnan(c)
        return F.coalesce(found, F.lit(False))

    def _has(self, rest: list) -> Column:
        name = self._name(rest)
        if name == "$type":
            return F.lit(True)
        if name == "$id":
            return F.lit(False) if self.fields.id is None else self.fields.id.col.isNotNull()
        return F.coalesce(self.compiler.has_property(literal(name)), F.lit(False))


def compile_filter(f, fields: Fields) -> Column:
    """A filter of either dialect; none admits everything, and an error or anything but true rejects the feature."""
    if f is None:
        return F.lit(True)
    if isinstance(f, bool):
        return F.lit(f)
    if not is_expression_filter(f):
        return LegacyFilter(fields).column(f)
    v = Compiler(fields, state_allowed=False).compile(f)
    if v.kind not in ("boolean", "value", "null"):
        raise ExpressionError(f"A filter must be boolean, but found {v.kind}.")
    return filter_column(narrowed(v, "boolean"))


def pushable(f, fields: Fields) -> Column | None:
    """Plain comparisons that every admitted feature meets, so that scans can apply them: those of typed columns with
    constants, at the top of a filter or within its "all"."""
    if not isinstance(f, list) or not f or not isinstance(fields.props, dict):
        return None
    if f[0] == "all":
        parts = [p for p in (pushable(x, fields) for x in f[1:]) if p is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if f[0] not in ("==", *_ORDERED) or len(f) != 3:
        return None
    name, x = f[1], f[2]
    if is_expression_filter(f):
        if not (isinstance(name, list) and len(name) == 2 and name[0] == "get"):
            return None
        name = name[1]
    target = fields.props.get(name) if isinstance(name, str) and name[:1] != "$" else None
    kind = "string" if isinstance(x, str) else "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    if target is None or target.kind != kind:
        return None
    value = F.lit(x if kind == "string" else float(x))
    return target.col == value if f[0] == "==" else getattr(target.col, _ORDERED[f[0]])(value)


def admitted(df: DataFrame, f, fields: Fields) -> DataFrame:
    """The rows of df that a filter admits."""
    plain = pushable(f, fields)
    return (df if plain is None else df.where(plain)).where(compile_filter(f, fields))
