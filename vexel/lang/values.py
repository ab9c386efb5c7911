"""What an expression compiles to: a Column for its value, and one that says whether evaluating it is an error."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSENT = object()
NUMERIC_VARIANT = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


class ExpressionError(ValueError):
    """An expression that can't be compiled."""


@dataclass(frozen=True)
class Val:
    """kind: null, number, string, boolean, color, array, object, value (a VARIANT), formatted, image or collator.

    A null column is the language's null. ok is null-free; None means that there is never an error. item is an
    array's element kind; const is the Python value of a literal; deps says what the value depends on."""

    kind: str
    col: Column | None
    ok: Column | None = None
    item: str | None = None
    const: object = ABSENT
    deps: frozenset = frozenset()
    size: int | None = None

    def with_deps(self, *others: Val) -> Val:
        return replace(self, deps=self.deps.union(*[o.deps for o in others]))


def all_ok(*oks: Column | None) -> Column | None:
    known = [o for o in oks if o is not None]
    return reduce(lambda a, b: a & b, known) if known else None


def ok_column(v: Val) -> Column:
    return F.lit(True) if v.ok is None else v.ok


def guarded(v: Val) -> Column:
    """The value, null where it is an error."""
    return v.col if v.ok is None else F.when(v.ok, v.col)


def parse_json_literal(x) -> Column:
    return F.parse_json(F.lit(json.dumps(x, sort_keys=True)))


def literal(x) -> Val:
    if x is None:
        return Val("null", F.lit(None), const=None)
    if isinstance(x, bool):
        return Val("boolean", F.lit(x), const=x)
    if isinstance(x, (int, float)):
        return Val("number", F.lit(float(x)), const=float(x))
    if isinstance(x, str):
        return Val("string", F.lit(x), const=x)
    if isinstance(x, list):
        kinds = {literal(i).kind for i in x}
        if len(kinds) == 1 and kinds <= {"number", "string", "boolean"}:
            return Val("array", F.array(*[literal(i).col for i in x]), item=kinds.pop(), const=x, size=len(x))
        return Val("array", F.variant_get(parse_json_literal(x), "$", "array<variant>"), item="value", const=x, size=len(x))
    return Val("object", parse_json_literal(x), const=x)


def is_variant(v: Val) -> bool:
    return v.kind in ("value", "object")


def variant_type(c: Column) -> Column:
    return F.schema_of_variant(c)


def as_variant(v: Val) -> Column:
    """The value as VARIANT, null staying null."""
    if is_variant(v):
        return v.col
    if v.kind == "null":
        return F.parse_json(F.lit(None).cast("string"))
    inner = F.variant_get(F.parse_json(F.to_json(F.array(v.col))), "$[0]", "variant")
    return F.when(v.col.isNotNull(), inner)


def _variant_is(c: Column, kind: str) -> Column:
    t = variant_type(c)
    test = {"number": t.rlike(NUMERIC_VARIANT), "string": t == "STRING", "boolean": t == "BOOLEAN", "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT")}[kind]
    return F.coalesce(test, F.lit(False))


def narrowed(v: Val, kind: str, item: str | None = None) -> Val:
    """v where it is of a kind, null elsewhere; ok as before."""
    if v.kind == kind:
        return v
    if v.kind == "value" and kind in ("number", "string", "boolean", "object", "array"):
        sql = {"number": "double", "string": "string", "boolean": "boolean", "object": "variant", "array": "array<variant>"}[kind]
        got = F.try_variant_get(v.col, "$", sql)
        return replace(v, kind=kind, col=F.when(_variant_is(v.col, kind), got), item="value" if kind == "array" else None, const=ABSENT)
    none = {"number": "double", "string": "string", "boolean": "boolean"}.get(kind, "variant")
    return replace(v, kind=kind, col=F.lit(None).cast(none) if none != "variant" else F.parse_json(F.lit(None).cast("string")), const=ABSENT)


def asserted(v: Val, kind: str) -> Val:
    """v as a kind; an error where it is not of it, null included."""
    if v.const is not ABSENT and v.kind != kind and v.kind != "value":
        raise ExpressionError(f"Expected {kind} but found {v.kind} instead.")
    if v.kind == "null":
        # a property that no row has: an error for each row, not for the expression
        n = narrowed(v, kind)
        return replace(n, ok=F.lit(False))
    if v.kind not in (kind, "value"):
        raise ExpressionError(f"Expected {kind} but found {v.kind} instead.")
    if v.const is not ABSENT:
        return v
    n = narrowed(v, kind)
    return replace(n, ok=all_ok(v.ok, n.col.isNotNull()))


def unified(vals: list[Val]) -> tuple[str, str | None, list[Column]]:
    """A kind for several outputs, and their columns in it."""
    kinds = {v.kind for v in vals if v.kind != "null"}
    if not kinds:
        return "null", None, [v.col for v in vals]
    if len(kinds) == 1:
        kind = kinds.pop()
        items = {v.item for v in vals if v.kind != "null"}
        if kind != "array" or len(items) == 1:
            null = F.lit(None)
            return kind, items.pop() if items else None, [null if v.kind == "null" else v.col for v in vals]
    if "color" in kinds or "formatted" in kinds or "image" in kinds:
        raise ExpressionError(f"Outputs of different types: {', '.join(sorted(kinds))}.")
    return "value", None, [as_variant(v) for v in vals]


def truthy(v: Val) -> Column:
    """False for null, false, 0, NaN and the empty string."""
    c = v.col
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if v.kind == "number":
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if v.kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if v.kind == "value":
        parts = [truthy(narrowed(v, k)) for k in ("boolean", "number", "string")]
        return F.coalesce(parts[0] | parts[1] | parts[2] | _variant_is(c, "array") | _variant_is(c, "object"), F.lit(False))
    return c.isNotNull()


def equal(a: Val, b: Val) -> Column:
    """Deep equality: null equals null, NaN nothing, values of different types never."""
    if a.kind == "null" or b.kind == "null":
        other = b if a.kind == "null" else a
        return F.lit(True) if other.kind == "null" else other.col.isNull()
    if a.kind == "value" and b.kind == "value":
        numbers = equal(narrowed(a, "number"), narrowed(b, "number"))
        either = _variant_is(a.col, "number") | _variant_is(b.col, "number")
        return F.when(either, F.coalesce(numbers, F.lit(False))).otherwise(F.to_json(a.col).eqNullSafe(F.to_json(b.col)))
    if "value" in (a.kind, b.kind):
        dynamic, known = (a, b) if a.kind == "value" else (b, a)
        if known.kind == "object":
            return F.to_json(dynamic.col).eqNullSafe(F.to_json(known.col))
        if known.kind == "array":
            return F.to_json(dynamic.col).eqNullSafe(F.to_json(as_variant(known)))
        if known.kind not in ("number", "string", "boolean"):
            return F.lit(False)
        same = equal(narrowed(dynamic, known.kind), known)
        # a dynamic value of another type isn't null
        return same & (dynamic.col.isNull() == known.col.isNull())
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    if a.kind == "number":
        return a.col.eqNullSafe(b.col) & ~F.coalesce(F.isnan(a.col), F.lit(False))
    if a.kind == "object":
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    if a.kind == "array" and "value" in (a.item, b.item):
        return F.to_json(as_variant(a)).eqNullSafe(F.to_json(as_variant(b)))
    return a.col.eqNullSafe(b.col)


def number_text(c: Column) -> Column:
    """A number as text: whole numbers without a fraction, others in their shortest digits, no exponent below 1e21."""
    s = F.abs(c).cast("string")
    mantissa, exponent = F.regexp_extract(s, r"^([0-9.]+)E", 1), F.try_to_number(F.regexp_extract(s, r"E(-?[0-9]+)$", 1), F.lit("S999")).cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    whole = F.length(F.regexp_extract(mantissa, r"^([0-9]+)", 1))
    point = whole + exponent
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -point)), digits)
    large = F.rpad(digits, F.greatest(F.length(digits), point), "0")
    middle = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    plain = F.when(point <= 0, small).when(point >= F.length(digits), large).otherwise(middle)
    body = F.when(s.contains("E"), plain).otherwise(F.regexp_replace(s, r"\.0$", ""))
    text = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), body)
    return F.when(F.isnan(c), F.lit("NaN")).when(F.abs(c) == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(text)


def color_text(c: Column) -> Column:
    channel = lambda x: F.round(c[x] * 255).cast("int").cast("string")
    return F.concat(F.lit("rgba("), channel("r"), F.lit(","), channel("g"), F.lit(","), channel("b"), F.lit(","), number_text(c["a"]), F.lit(")"))


def text_of(v: Val) -> Column:
    """to-string; null is the empty text."""
    c = v.col
    if v.kind == "null":
        return F.lit("")
    if v.kind == "string":
        t = c
    elif v.kind == "boolean":
        t = c.cast("string")
    elif v.kind == "number":
        t = number_text(c)
    elif v.kind == "color":
        t = color_text(c)
    elif v.kind == "formatted":
        t = F.array_join(F.transform(c, lambda s: F.coalesce(s["text"], F.lit(""))), "")
    elif v.kind == "image":
        t = c["name"]
    elif v.kind == "value":
        # VARIANT writes whole doubles with a fraction
        t = F.coalesce(narrowed(v, "string").col, number_text(narrowed(v, "number").col), F.to_json(c))
    elif v.kind == "array" and v.item == "number":
        t = F.concat(F.lit("["), F.array_join(F.transform(c, number_text), ","), F.lit("]"))
    else:
        t = F.to_json(as_variant(v))
    return F.coalesce(t, F.lit(""))


@dataclass
class Fields:
    """Where an expression finds a feature's parts.

    props: columns by property name, or one VARIANT column with all. A property that props doesn't have is null.
    state: columns by key of the joined feature state. zoom and the camera's and ramp's inputs may be numbers or Columns."""

    props: dict[str, Val] | Column = field(default_factory=dict)
    id: Val | None = None
    geom_type: Column | None = None
    geom: Column | None = None
    state: dict[str, Val] | Column | None = None
    zoom: object = None
    pitch: object = None
    distance_from_center: object = None
    ramp: object = None
    images: set[str] | None = None

    @classmethod
    def of(cls, df: DataFrame, **parts) -> Fields:
        """All columns of df that have a type of the language as properties, by name."""
        props = {f.name: column_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        return cls({k: v for k, v in props.items() if v is not None}, **parts)


def column_value(c: Column, t: T.DataType) -> Val | None:
    deps = frozenset({"feature"})
    if isinstance(t, T.NumericType):
        return Val("number", c.cast("double"), deps=deps)
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return Val("string", c, deps=deps)
    if isinstance(t, T.BooleanType):
        return Val("boolean", c, deps=deps)
    if isinstance(t, T.VariantType):
        return Val("value", F.when(~F.is_variant_null(c), c), deps=deps)
    if isinstance(t, T.ArrayType):
        inner = column_value(c, t.elementType)
        if inner is not None and inner.kind in ("number", "string", "boolean"):
            return Val("array", c.cast("array<double>") if inner.kind == "number" else c, item=inner.kind, deps=deps)
    return None
