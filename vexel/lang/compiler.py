"""The compiler from JSON expressions to Columns.

Every operator is a method of Compiler named by the table at the end of the class; it gets the operator's arguments as
JSON and returns a Val. Argument types are checked here: a value whose type is only known per row gets an assertion,
which is an error for rows of another type, and a known wrong type doesn't compile.
"""

from __future__ import annotations

import math
import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import color
from .curves import bezier, factor, is_interpolation, stops
from .numbers import format_number
from .values import (
    ABSENT,
    ExpressionError,
    Fields,
    Val,
    all_ok,
    as_variant,
    asserted,
    equal,
    guarded,
    is_variant,
    literal,
    narrowed,
    ok_column,
    text_of,
    truthy,
    unified,
    variant_type,
)

REGISTERED = frozenset(
    "! != < <= == > >= all any case coalesce match % * + - / ^ abs acos asin atan ceil cos e floor ln ln2 log10 log2 max min pi "
    "round sin sqrt tan array boolean literal number object string to-boolean to-color to-number to-padding to-rgba to-string "
    "typeof at feature-state geometry-type get has id in index-of length properties slice collator concat downcase format "
    "image is-supported-script join number-format resolved-locale split upcase let var interpolate step elevation "
    "heatmap-density line-progress zoom rgb rgba distance within accumulated error config distance-from-center pitch".split()
)
#: Registered names that no expression can use.
UNIMPLEMENTED = frozenset({"accumulated", "distance", "to-padding"})
_LARGEST_LABEL = 2**53 - 1
#: Scripts that need no shaping of complex text, as ranges of code points; other characters need a shaper.
_COMPLEX_SCRIPTS = "\\u0900-\\u0DFF\\u0F00-\\u109F\\u1780-\\u17FF"


def is_expression(x) -> bool:
    return isinstance(x, list) and bool(x) and isinstance(x[0], str) and x[0] in REGISTERED


class Compiler:
    def __init__(self, fields: Fields, bindings: dict[str, Val] | None = None, state_allowed: bool = True):
        self.fields, self.bindings, self.state_allowed = fields, bindings or {}, state_allowed

    # -- entry

    def compile(self, x) -> Val:
        if not isinstance(x, list):
            if isinstance(x, dict):
                raise ExpressionError("Bare objects invalid. Use [\"literal\", {...}] instead.")
            return literal(x)
        if not x or not isinstance(x[0], str):
            raise ExpressionError("Expected an operator name as the first element.")
        name, args = x[0], x[1:]
        if name not in REGISTERED or name in UNIMPLEMENTED:
            raise ExpressionError(f"Unknown expression \"{name}\".")
        return getattr(self, self._METHODS[name])(name, args)

    def of(self, x, kind: str) -> Val:
        return asserted(self.compile(x), kind)

    def _count(self, name: str, args: list, least: int, most: int | None = None) -> None:
        if len(args) < least or most is not None and len(args) > most:
            raise ExpressionError(f"\"{name}\" has {len(args)} arguments.")

    @staticmethod
    def _result(kind: str, col: Column, *parts: Val, ok: Column | None = None, **more) -> Val:
        return Val(kind, col, all_ok(*[p.ok for p in parts], ok), **more).with_deps(*parts)

    # -- binding, literals, control flow

    def literal_(self, name, args):
        self._count(name, args, 1, 1)
        return literal(args[0])

    def let(self, name, args):
        self._count(name, args, 1)
        if len(args) % 2 == 0:
            raise ExpressionError("\"let\" needs pairs and a result.")
        inner = self
        for key, value in zip(args[:-1:2], args[1::2]):
            if not isinstance(key, str) or not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", key):
                raise ExpressionError(f"Not a variable name: {key}.")
            inner = Compiler(self.fields, inner.bindings | {key: inner.compile(value)}, self.state_allowed)
        return inner.compile(args[-1])

    def var(self, name, args):
        self._count(name, args, 1, 1)
        if args[0] not in self.bindings:
            raise ExpressionError(f"Unknown variable \"{args[0]}\".")
        return self.bindings[args[0]]

    def case(self, name, args):
        self._count(name, args, 3)
        if len(args) % 2 == 0:
            raise ExpressionError("\"case\" needs a fallback.")
        conditions = [self.of(c, "boolean") for c in args[:-1:2]]
        outputs = [self.compile(o) for o in [*args[1:-1:2], args[-1]]]
        return self._ladder([c.col for c in conditions], outputs, [c.ok for c in conditions], conditions)

    def _ladder(self, tests: list[Column], outputs: list[Val], oks: list[Column | None] = (), parts: list[Val] = ()) -> Val:
        """The output of the first test that holds, else the last one; only what is reached can be an error."""
        kind, item, cols = unified(outputs)
        oks = list(oks) or [None] * len(tests)
        value, ok = cols[-1], ok_column(outputs[-1])
        for test, out, v, test_ok in reversed(list(zip(tests, cols, outputs, oks))):
            value = F.when(test, out).otherwise(value)
            ok = F.when(test, ok_column(v)).otherwise(ok)
            if test_ok is not None:
                ok = F.when(test_ok, ok).otherwise(F.lit(False))
        never = all(o is None for o in oks) and all(v.ok is None for v in outputs)
        return Val(kind, value, None if never else ok, item=item).with_deps(*outputs, *parts)

    def match(self, name, args):
        self._count(name, args, 4)
        if len(args) % 2:
            raise ExpressionError("\"match\" needs a fallback.")
        labels = [x if isinstance(x, list) else [x] for x in args[1:-1:2]]
        flat = [i for group in labels for i in group]
        if not all(flat and isinstance(i, (str, int, float)) and not isinstance(i, bool) for i in flat) or any(not g for g in labels):
            raise ExpressionError("Branch labels must be numbers or strings.")
        if len({isinstance(i, str) for i in flat}) > 1:
            raise ExpressionError("Branch labels must be of one type.")
        kind = "string" if isinstance(flat[0], str) else "number"
        if kind == "number" and any(i != int(i) or abs(i) > _LARGEST_LABEL for i in flat):
            raise ExpressionError("Numeric branch labels must be integers no larger than 2^53 - 1.")
        if len(set(flat)) < len(flat):
            raise ExpressionError("Branch labels must be unique.")
        x = self.compile(args[0])
        if x.kind not in (kind, "value", "null"):
            raise ExpressionError(f"Expected {kind} but found {x.kind} instead.")
        on = narrowed(x, kind).col
        tests = [F.coalesce(on.isin([float(i) if kind == "number" else i for i in g]), F.lit(False)) for g in labels]
        outputs = [self.compile(o) for o in [*args[2:-1:2], args[-1]]]
        v = self._ladder(tests, outputs)
        return replace(v, ok=all_ok(x.ok, v.ok)).with_deps(x)

    def coalesce(self, name, args):
        self._count(name, args, 1)
        vals = [self.compile(a) for a in args]
        usable = [F.coalesce(v.col["available"], F.lit(False)) if v.kind == "image" else v.col.isNotNull() for v in vals]
        if len(vals) == 1:
            return vals[0]
        return self._ladder(usable[:-1], vals, [v.ok for v in vals[:-1]])

    # -- curves

    def step(self, name, args):
        self._count(name, args, 3)
        x = self.of(args[0], "number")
        at, outputs = stops(args[2:], "step")
        values = [self.compile(o) for o in [args[1], *outputs]]
        # from the last stop down, the first one that isn't above the input
        tests = [x.col >= s for s in reversed(at)]
        v = self._ladder(tests, [*reversed(values[1:]), values[0]])
        return replace(v, ok=all_ok(x.ok, v.ok)).with_deps(x)

    def interpolate(self, name, args):
        self._count(name, args, 4)
        kind, base, controls = is_interpolation(args[0])
        x = self.of(args[1], "number")
        at, outputs = stops(args[2:], "interpolate")
        values = [self.compile(o) for o in outputs]
        values = [self._interpolatable(v, values) for v in values]
        tests, ladder = [x.col <= at[0]], [values[0]]
        for k in range(len(at) - 1):
            t = factor(x.col, base, at[k], at[k + 1])
            if kind == "cubic-bezier":
                out = self._bent(values[k], values[k + 1], bezier(t, *controls))
            else:
                out = mixed(values[k], values[k + 1], t)
            tests.append(x.col < at[k + 1])
            ladder.append(out)
        v = self._ladder(tests, [*ladder, values[-1]])
        return replace(v, ok=all_ok(x.ok, v.ok)).with_deps(x)

    @staticmethod
    def _bent(a: Val, b: Val, t: Column) -> Val:
        """mixed(a, b, t) with t bound to a variable, so that it is found once."""
        return replace(mixed(a, b, t), col=F.get(F.transform(F.array(t), lambda s: mixed(a, b, s).col), F.lit(0)))

    @staticmethod
    def _interpolatable(v: Val, others: list[Val]) -> Val:
        if any(o.kind == "color" for o in others) or v.kind == "string" and v.const is not ABSENT:
            return to_color([v])
        if v.kind in ("number", "color") or v.kind == "array" and v.item == "number":
            return v
        if v.kind == "value" or v.kind == "null" and v.const is ABSENT:
            return asserted(v, "number")
        raise ExpressionError(f"Type {v.kind} is not interpolatable.")

    # -- comparison and logic

    def compare(self, name, args):
        self._count(name, args, 2, 3)
        a, b = self.compile(args[0]), self.compile(args[1])
        sides = {a.kind, b.kind}
        collation = self.compile(args[2]) if len(args) == 3 else None
        if collation is not None:
            if collation.kind != "collator":
                raise ExpressionError("Expected a collator.")
            if sides - {"string", "value"}:
                raise ExpressionError("A collator compares strings.")
        if name in ("==", "!="):
            known = sides - {"value", "null"}
            if len(known) > 1 or known - {"string", "number", "boolean"}:
                raise ExpressionError(f"\"{name}\" can't compare {a.kind} and {b.kind}.")
            same = equal(a, b)
            if collation is not None:
                x, y = narrowed(a, "string").col, narrowed(b, "string").col
                same = F.when(x.isNotNull() & y.isNotNull(), F.collate(x, collation.const) == F.collate(y, collation.const)).otherwise(same)
            return self._result("boolean", same if name == "==" else ~same, a, b)
        if any(v.kind == "null" and v.const is not ABSENT for v in (a, b)):
            raise ExpressionError(f"\"{name}\" can't order null.")
        known = sides - {"value", "null"}
        if len(known) > 1 or known - {"string", "number"}:
            raise ExpressionError(f"\"{name}\" can't compare {a.kind} and {b.kind}.")
        op = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[name]

        def ordered(kind: str) -> tuple[Column, Column]:
            x, y = narrowed(a, kind).col, narrowed(b, kind).col
            fine = x.isNotNull() & y.isNotNull()
            if kind == "number":
                # NaN is neither below nor above anything
                return getattr(x, op)(y) & ~F.isnan(x) & ~F.isnan(y), fine
            if collation is not None:
                x, y = F.collate(x, collation.const), F.collate(y, collation.const)
            return getattr(x, op)(y), fine

        pairs = [ordered(k) for k in (known or ("number", "string"))]
        value = F.coalesce(*[F.when(fine, v) for v, fine in pairs])
        return self._result("boolean", F.coalesce(value, F.lit(False)), a, b, ok=reduce(lambda p, q: p | q, [fine for _, fine in pairs]))

    def not_(self, name, args):
        self._count(name, args, 1, 1)
        v = self.compile(args[0])
        return self._result("boolean", ~truthy(v), v)

    def logic(self, name, args):
        """Evaluation stops at the first operand that decides, so a later error doesn't count."""
        vals = [self.compile(a) for a in args]
        deciding = name == "any"
        value, ok = F.lit(not deciding), F.lit(True)
        for v in reversed(vals):
            t = truthy(v)
            value = (t | value) if deciding else (t & value)
            if any(w.ok is not None for w in vals):
                ok = F.when(~ok_column(v), F.lit(False)).when(t if deciding else ~t, F.lit(True)).otherwise(ok)
        return Val("boolean", value, ok if any(v.ok is not None for v in vals) else None).with_deps(*vals)

    # -- properties of the feature

    def get(self, name, args):
        self._count(name, args, 1, 2)
        if len(args) == 2:
            return self._of_object(args, present=False)
        key = self.of(args[0], "string")
        return self._property(key)

    def _property(self, key: Val) -> Val:
        props = self.fields.props
        if isinstance(props, Column):
            return self._member(Val("object", props, deps=frozenset({"feature"})), key)
        if key.const is not ABSENT:
            return props.get(key.const, replace(literal(None), const=ABSENT, deps=frozenset({"feature"})))
        usable = {n: v for n, v in props.items() if v.kind in ("number", "string", "boolean", "value")}
        col = F.parse_json(F.lit(None).cast("string"))
        for n, v in usable.items():
            col = F.when(key.col == n, as_variant(v)).otherwise(col)
        return self._result("value", col, key, deps=frozenset({"feature"}))

    def _member(self, obj: Val, key: Val) -> Val:
        found = F.try_element_at(F.from_json(F.to_json(obj.col), "map<string,variant>"), key.col) if key.const is ABSENT else F.try_variant_get(obj.col, _path(key.const), "variant")
        return self._result("value", F.when(~F.is_variant_null(found), found), obj, key)

    def _of_object(self, args, present: bool) -> Val:
        key, obj = self.of(args[0], "string"), self.compile(args[1])
        if obj.kind not in ("object", "value"):
            raise ExpressionError(f"Expected object but found {obj.kind} instead.")
        obj = asserted(obj, "object")
        if not present:
            return self._member(obj, key)
        return self._result("boolean", self._has_member(obj.col, key), obj, key)

    @staticmethod
    def _has_member(obj: Column, key: Val) -> Column:
        # a key with JSON null is present
        if key.const is not ABSENT:
            return F.coalesce(F.try_variant_get(obj, _path(key.const), "variant").isNotNull(), F.lit(False))
        return F.coalesce(F.array_contains(F.json_object_keys(F.to_json(obj)), key.col), F.lit(False))

    def has(self, name, args):
        self._count(name, args, 1, 2)
        if len(args) == 2:
            return self._of_object(args, present=True)
        key = self.of(args[0], "string")
        return self._result("boolean", self.has_property(key), key, deps=frozenset({"feature"}))

    def has_property(self, key: Val) -> Column:
        props = self.fields.props
        if isinstance(props, Column):
            return self._has_member(props, key)
        if key.const is not ABSENT:
            return props[key.const].col.isNotNull() if key.const in props else F.lit(False)
        return reduce(lambda a, b: a | b, [(key.col == n) & v.col.isNotNull() for n, v in props.items()], F.lit(False))

    def properties(self, name, args):
        self._count(name, args, 0, 0)
        props = self.fields.props
        if not isinstance(props, Column):
            plain = [F.when(v.col.isNotNull(), F.concat(F.to_json(F.array(F.lit(n))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(n)))) - 2), F.lit(":"), F.to_json(as_variant(v)))) for n, v in sorted(props.items())]
            props = F.parse_json(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*plain)), ","), F.lit("}"))) if plain else F.parse_json(F.lit("{}"))
        return Val("object", props, deps=frozenset({"feature"}))

    def id(self, name, args):
        self._count(name, args, 0, 0)
        return self.fields.id or replace(literal(None), const=ABSENT, deps=frozenset({"feature"}))

    def geometry_type(self, name, args):
        self._count(name, args, 0, 0)
        c = self.fields.geom_type
        return Val("string", F.lit("Unknown") if c is None else F.coalesce(c, F.lit("Unknown")), deps=frozenset({"feature"}))

    def feature_state(self, name, args):
        self._count(name, args, 1, 1)
        if not self.state_allowed:
            raise ExpressionError("\"feature-state\" is not supported here.")
        key, state, deps = self.of(args[0], "string"), self.fields.state, frozenset({"state"})
        if isinstance(state, Column):
            return replace(self._member(Val("object", state), key), deps=deps)
        if state and key.const in state:
            return replace(state[key.const], deps=deps)
        return Val("null", F.lit(None), deps=deps)

    def camera(self, name, args):
        self._count(name, args, 0, 0)
        attribute = {"zoom": "zoom", "pitch": "pitch", "distance-from-center": "distance_from_center"}.get(name, "ramp")
        x = getattr(self.fields, attribute)
        if x is None:
            raise ExpressionError(f"\"{name}\" has no value here.")
        return Val("number", x.cast("double") if isinstance(x, Column) else F.lit(float(x)), deps=frozenset({{"zoom": "zoom", "ramp": "ramp"}.get(attribute, "camera")}))

    def within(self, name, args):
        from ..spatial.contain import polygon_rings, within_column

        self._count(name, args, 1, 1)
        rings = polygon_rings(args[0])
        if self.fields.geom is None:
            return Val("boolean", F.lit(False), deps=frozenset({"feature"}))
        return Val("boolean", within_column(self.fields.geom_type, self.fields.geom, rings), deps=frozenset({"feature"}))

    # -- types

    def assertion(self, name, args):
        self._count(name, args, 1)
        vals = [self.compile(a) for a in args]
        fits = [v.kind in (name, "value") or v.kind == "null" and v.const is ABSENT for v in vals]
        if not any(fits):
            raise ExpressionError(f"Expected {name} but found {vals[0].kind} instead.")
        if len(vals) == 1:
            return asserted(vals[0], name)
        typed = [narrowed(v, name) for v in vals]
        v = self._ladder([t.col.isNotNull() for t in typed[:-1]], typed, [t.ok for t in typed[:-1]])
        return replace(v, kind=name, ok=all_ok(v.ok, v.col.isNotNull()))

    def array(self, name, args):
        self._count(name, args, 1, 4)
        item = size = None
        if len(args) > 1:
            item = args[0]
            if item not in ("string", "number", "boolean"):
                raise ExpressionError("The item type of \"array\" must be string, number or boolean.")
        if len(args) > 2 and args[1] is not None:
            size = args[1]
            if isinstance(size, bool) or not isinstance(size, (int, float)) or size < 0 or size != int(size):
                raise ExpressionError("The length of \"array\" must be a non-negative integer.")
        tries = args[2:] if len(args) > 2 else args[-1:]
        typed = []
        for t in tries:
            v = self.compile(t)
            a = asserted(v, "array")
            ok = a.col.isNotNull()
            if size is not None:
                ok = ok & (F.size(a.col) == int(size))
            col = a.col
            if item is not None and a.item != item:
                sql = {"number": "double", "string": "string", "boolean": "boolean"}[item]
                if a.item in (None, "value"):
                    ok = ok & F.coalesce(F.forall(a.col, lambda e: narrowed(Val("value", e), item).col.isNotNull()), F.lit(False))
                    col = F.transform(a.col, lambda e: F.try_variant_get(e, "$", sql))
                else:
                    ok, col = F.lit(False), F.lit(None).cast(f"array<{sql}>")
            typed.append(Val("array", F.when(F.coalesce(ok, F.lit(False)), col), v.ok, item=item or a.item).with_deps(v))
        v = self._ladder([t.col.isNotNull() for t in typed[:-1]], typed, [t.ok for t in typed[:-1]]) if len(typed) > 1 else typed[0]
        return replace(v, ok=all_ok(v.ok, v.col.isNotNull()))

    def to_boolean(self, name, args):
        self._count(name, args, 1, 1)
        v = self.compile(args[0])
        return self._result("boolean", truthy(v), v)

    def to_string(self, name, args):
        self._count(name, args, 1, 1)
        v = self.compile(args[0])
        return self._result("string", text_of(v), v)

    def to_number(self, name, args):
        self._count(name, args, 1)
        return first_of([number_from(self.compile(a)) for a in args])

    def to_color_(self, name, args):
        self._count(name, args, 1)
        return to_color([self.compile(a) for a in args])

    def to_rgba(self, name, args):
        self._count(name, args, 1, 1)
        v = to_color([self.compile(args[0])])
        alpha = F.round(v.col["a"], 2)
        parts = F.when(v.col["a"] == 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(*[v.col[c] * 255 for c in "rgb"], alpha))
        return self._result("array", parts, v, item="number", size=4)

    def rgb(self, name, args):
        n = len(name)
        self._count(name, args, n, n)
        vals = [self.of(a, "number") for a in args]
        limits = [255.0, 255.0, 255.0, 1.0]
        fits = reduce(lambda a, b: a & b, [v.col.between(0.0, m) for v, m in zip(vals, limits)])
        channels = [v.col / 255 for v in vals[:3]]
        return self._result("color", color.struct_of(*channels, vals[3].col if n == 4 else F.lit(1.0)), *vals, ok=F.coalesce(fits, F.lit(False)))

    def type_of(self, name, args):
        self._count(name, args, 1, 1)
        v = self.compile(args[0])
        if v.kind == "null":
            return self._result("string", F.lit("null"), v)
        if v.kind == "array":
            known = v.item if v.item in ("number", "string", "boolean") else "value"
            return self._result("string", F.when(F.size(v.col) == 0, F.lit("array")).otherwise(F.concat(F.lit(f"array<{known}, "), F.size(v.col).cast("string"), F.lit(">"))), v)
        if v.kind == "value":

            def of(x: Column) -> Column:
                t = variant_type(x)
                return F.when(t.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("null")

            items = F.try_variant_get(v.col, "$", "array<variant>")
            kinds = F.array_distinct(F.transform(items, of))
            item = F.when((F.size(kinds) == 1) & kinds[0].isin("number", "string", "boolean"), kinds[0]).otherwise("value")
            array = F.when(F.size(items) == 0, F.lit("array")).otherwise(F.concat(F.lit("array<"), item, F.lit(", "), F.size(items).cast("string"), F.lit(">")))
            c = of(v.col)
            return self._result("string", F.coalesce(F.when(c == "array", array).otherwise(c), F.lit("null")), v)
        kind = {"formatted": "object", "image": "object"}.get(v.kind, v.kind)
        return self._result("string", F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(kind)), v)

    # -- arrays and strings

    def at(self, name, args):
        self._count(name, args, 2, 2)
        i, a = self.of(args[0], "number"), self.of(args[1], "array")
        fits = (i.col == F.floor(i.col)) & (i.col >= 0) & (i.col < F.size(a.col))
        value = F.when(fits, F.try_element_at(a.col, (i.col + 1).cast("int")))
        kind = a.item if a.item in ("number", "string", "boolean") else "value"
        return self._result(kind, value if kind != "value" else F.when(~F.is_variant_null(value), value), i, a, ok=F.coalesce(fits, F.lit(False)))

    def _search(self, needle: Val, hay: Val, start: Column | None) -> tuple[Column, Column]:
        """(place from 0, null for none, whether this is no error)."""
        if needle.kind in ("array", "object"):
            return F.lit(None).cast("int"), F.lit(False)
        at = F.lit(0) if start is None else start
        fine = F.lit(True) if needle.kind != "value" else ~F.coalesce(variant_type(needle.col).rlike("^(ARRAY|OBJECT)"), F.lit(False))
        results = []
        if hay.kind in ("string", "value"):
            s, n = narrowed(hay, "string").col, text_of(needle)
            from_ = F.least(at, F.length(s))
            place = F.when(n == "", from_).otherwise(F.nullif(F.call_function("locate", n, s, from_ + 1), F.lit(0)) - 1)
            results.append((s.isNotNull(), F.when(needle.col.isNotNull(), place)))
        if hay.kind in ("array", "value"):
            a = narrowed(hay, "array")
            rest = F.slice(a.col, at + 1, F.greatest(F.size(a.col), F.lit(1)))
            item = a.item or "value"
            if item == "value":
                hits = F.transform(rest, lambda e: equal(Val("value", F.when(~F.is_variant_null(e), e)), needle))
            else:
                same = narrowed(needle, item)
                hits = F.transform(rest, lambda e: equal(Val(item, e), same) & F.lit(needle.kind in (item, "value", "null")))
            results.append((a.col.isNotNull(), F.nullif(F.array_position(hits, F.lit(True)).cast("int"), F.lit(0)) - 1 + at))
        if not results:
            raise ExpressionError(f"Expected string or array but found {hay.kind} instead.")
        place = F.coalesce(*[F.when(is_it, p) for is_it, p in results])
        return place, fine & reduce(lambda a, b: a | b, [is_it for is_it, _ in results])

    def in_(self, name, args):
        self._count(name, args, 2, 2)
        needle, hay = self.compile(args[0]), self.compile(args[1])
        if needle.kind in ("array", "object", "color"):
            raise ExpressionError(f"Expected boolean, string, number or null but found {needle.kind} instead.")
        if hay.kind == "null":
            return self._result("boolean", F.lit(False), needle, hay)
        place, fine = self._search(needle, hay, None)
        # a null haystack holds nothing
        return self._result("boolean", place.isNotNull(), needle, hay, ok=fine | hay.col.isNull())

    def index_of(self, name, args):
        self._count(name, args, 2, 3)
        needle, hay = self.compile(args[0]), self.compile(args[1])
        if needle.kind in ("array", "object", "color"):
            raise ExpressionError(f"Expected boolean, string, number or null but found {needle.kind} instead.")
        start = None
        parts = [needle, hay]
        if len(args) == 3:
            s = self.of(args[2], "number")
            parts.append(s)
            # before the beginning is the beginning, unlike in a slice
            start = _relative(F.greatest(F.lit(0.0), s.col), _length(hay))
        place, fine = self._search(needle, hay, start)
        return self._result("number", F.coalesce(place, F.lit(-1)).cast("double"), *parts, ok=fine)

    def slice_(self, name, args):
        self._count(name, args, 2, 3)
        v, a = self.compile(args[0]), self.of(args[1], "number")
        if v.kind == "value":
            v = asserted(v, "string")
        if v.kind not in ("string", "array"):
            raise ExpressionError(f"Expected string or array but found {v.kind} instead.")
        size, parts = _length(v), [v, a]
        start, end = _relative(a.col, size), size
        if len(args) == 3:
            b = self.of(args[2], "number")
            parts.append(b)
            end = _relative(b.col, size)
        n = F.greatest(F.lit(0), end - start)
        if v.kind == "string":
            return self._result("string", F.substring(v.col, start + 1, n), *parts, ok=v.col.isNotNull())
        return self._result("array", F.slice(v.col, start + 1, n), *parts, ok=v.col.isNotNull(), item=v.item)

    def length(self, name, args):
        self._count(name, args, 1, 1)
        v = self.compile(args[0])
        if v.kind not in ("string", "array", "value"):
            raise ExpressionError(f"Expected string or array but found {v.kind} instead.")
        n = _length(v)
        return self._result("number", n.cast("double"), v, ok=n.isNotNull())

    def concat(self, name, args):
        vals = [self.compile(a) for a in args]
        return self._result("string", F.concat(*[text_of(v) for v in vals]) if vals else F.lit(""), *vals)

    def join(self, name, args):
        self._count(name, args, 2, 2)
        a, d = self.of(args[0], "array"), self.of(args[1], "string")
        if a.item not in ("string", "value", None):
            raise ExpressionError("\"join\" needs an array of strings.")
        items = a.col if a.item == "string" else F.transform(a.col, lambda e: narrowed(Val("value", e), "string").col)
        return self._result("string", _join(items, d.col), a, d, ok=F.forall(items, lambda e: e.isNotNull()))

    def split(self, name, args):
        self._count(name, args, 2, 2)
        s, d = self.of(args[0], "string"), self.of(args[1], "string")
        quoted = F.concat(F.lit("\\Q"), F.replace(d.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        parts = F.when(d.col == "", F.when(s.col == "", F.array().cast("array<string>")).otherwise(F.split(s.col, ""))).otherwise(F.call_function("split", s.col, quoted, F.lit(-1)))
        return self._result("array", parts, s, d, item="string")

    def change_case(self, name, args):
        self._count(name, args, 1, 1)
        s = self.of(args[0], "string")
        return self._result("string", (F.upper if name == "upcase" else F.lower)(s.col), s)

    def supported_script(self, name, args):
        self._count(name, args, 1, 1)
        s = self.of(args[0], "string")
        return self._result("boolean", ~s.col.rlike(f"[{_COMPLEX_SCRIPTS}]"), s)

    def collator(self, name, args):
        self._count(name, args, 1, 1)
        options = args[0]
        if not isinstance(options, dict):
            raise ExpressionError("Collator options must be an object.")
        flags = []
        for key in ("case-sensitive", "diacritic-sensitive"):
            x = options.get(key, False)
            if not isinstance(x, bool):
                raise ExpressionError(f"Collator option {key} must be a constant boolean.")
            flags.append(x)
        return Val("collator", None, const="UNICODE" + "_CI" * (not flags[0]) + "_AI" * (not flags[1]))

    def resolved_locale(self, name, args):
        self._count(name, args, 1, 1)
        if self.compile(args[0]).kind != "collator":
            raise ExpressionError("Expected a collator.")
        return Val("string", F.lit(""))

    def number_format(self, name, args):
        self._count(name, args, 2, 2)
        v, o = self.of(args[0], "number"), args[1]
        if not isinstance(o, dict):
            raise ExpressionError("Number format options must be an object.")
        for key in ("locale", "currency", "min-fraction-digits", "max-fraction-digits"):
            if isinstance(o.get(key), list):
                raise ExpressionError(f"{key} must be constant.")
        return self._result("string", format_number(v.col, o.get("locale", ""), o.get("currency", ""), int(o.get("min-fraction-digits", 0)), int(o.get("max-fraction-digits", 3))), v)

    def format(self, name, args):
        sections, parts, i = [], [], 0
        self._count(name, args, 1)
        while i < len(args):
            v = self.compile(args[i])
            options = args[i + 1] if i + 1 < len(args) and isinstance(args[i + 1], dict) else {}
            i += 1 + bool(i + 1 < len(args) and isinstance(args[i + 1], dict))
            scale = self.of(options["font-scale"], "number") if "font-scale" in options else Val("number", F.lit(None).cast("double"))
            font = self.of(options["text-font"], "array") if "text-font" in options else Val("array", F.lit(None).cast("array<string>"), item="string")
            tint = to_color([self.compile(options["text-color"])]) if "text-color" in options else Val("color", F.lit(None).cast("struct<r:double,g:double,b:double,a:double>"))
            image = v.col["name"] if v.kind == "image" else F.lit(None).cast("string")
            text = F.lit("") if v.kind == "image" else text_of(v)
            sections.append(F.struct(text.alias("text"), image.alias("image"), scale.col.alias("scale"), font.col.alias("font"), tint.col.alias("color")))
            parts += [v, scale, font, tint]
        return self._result("formatted", F.array(*sections), *[replace(p, ok=p.ok) for p in parts])

    def image(self, name, args):
        self._count(name, args, 1, 1)
        s = self.of(args[0], "string")
        known = self.fields.images
        available = F.lit(True) if known is None else s.col.isin(sorted(known)) if known else F.lit(False)
        return self._result("image", F.struct(s.col.alias("name"), available.alias("available")), s)

    def error(self, name, args):
        self._count(name, args, 1, 1)
        s = self.of(args[0], "string")
        return Val("null", F.lit(None), F.lit(False)).with_deps(s)

    def config(self, name, args):
        raise ExpressionError("\"config\" must be resolved before an expression is compiled.")

    # -- numbers: IEEE results, never an error

    def constant(self, name, args):
        self._count(name, args, 0, 0)
        return literal({"e": math.e, "pi": math.pi, "ln2": math.log(2)}[name])

    def arithmetic(self, name, args):
        self._count(name, args, {"+": 0, "*": 0, "-": 1, "min": 0, "max": 0}.get(name, 2))
        if name in ("/", "%", "^"):
            self._count(name, args, 2, None if name != "%" else 2)
        vals = [self.of(a, "number") for a in args]
        cols = [v.col for v in vals]
        if name == "-" and len(cols) == 1:
            out = -cols[0]
        elif name in ("min", "max"):
            worst = F.lit(float("inf") if name == "min" else float("-inf"))
            # NaN is passed over
            out = reduce(F.least if name == "min" else F.greatest, [F.when(F.isnan(c), worst).otherwise(c) for c in cols], worst)
        elif not cols:
            out = F.lit({"+": 0.0, "*": 1.0}[name])
        else:
            out = reduce({"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided, "%": remainder, "^": F.pow}[name], cols)
        return self._result("number", out, *vals)

    def function(self, name, args):
        self._count(name, args, 1, 1)
        v = self.of(args[0], "number")
        x, fine = v.col, F.abs(v.col) < 2.0**52
        nan, low = F.lit(float("nan")), F.lit(float("-inf"))
        log = {"ln": F.log, "log2": F.log2, "log10": F.log10}
        if name in log:
            out = F.when(x > 0, log[name](x)).when(x == 0, low).otherwise(nan)
        elif name in ("floor", "ceil"):
            out = F.when(fine, (F.floor if name == "floor" else F.ceil)(x).cast("double")).otherwise(x)
        elif name == "round":
            # half away from zero
            out = F.round(x)
        else:
            out = {"abs": F.abs, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan}[name](x)
        return self._result("number", out, v)

    _METHODS = {
        "literal": "literal_", "let": "let", "var": "var", "case": "case", "match": "match", "coalesce": "coalesce", "step": "step",
        "interpolate": "interpolate", "==": "compare", "!=": "compare", "<": "compare", "<=": "compare", ">": "compare", ">=": "compare",
        "!": "not_", "all": "logic", "any": "logic", "get": "get", "has": "has", "properties": "properties", "id": "id",
        "geometry-type": "geometry_type", "feature-state": "feature_state", "zoom": "camera", "pitch": "camera",
        "distance-from-center": "camera", "heatmap-density": "camera", "elevation": "camera", "line-progress": "camera", "within": "within",
        "boolean": "assertion", "number": "assertion", "string": "assertion", "object": "assertion", "array": "array",
        "to-boolean": "to_boolean", "to-string": "to_string", "to-number": "to_number", "to-color": "to_color_", "to-rgba": "to_rgba",
        "rgb": "rgb", "rgba": "rgb", "typeof": "type_of", "at": "at", "in": "in_", "index-of": "index_of", "slice": "slice_",
        "length": "length", "concat": "concat", "join": "join", "split": "split", "upcase": "change_case", "downcase": "change_case",
        "is-supported-script": "supported_script", "collator": "collator", "resolved-locale": "resolved_locale",
        "number-format": "number_format", "format": "format", "image": "image", "error": "error", "config": "config",
        "e": "constant", "pi": "constant", "ln2": "constant",
        **dict.fromkeys(["+", "-", "*", "/", "%", "^", "min", "max"], "arithmetic"),
        **dict.fromkeys(["abs", "ceil", "floor", "round", "sqrt", "ln", "log2", "log10", "sin", "cos", "tan", "asin", "acos", "atan"], "function"),
    }


def divided(a: Column, b: Column) -> Column:
    # a zero divisor is positive, as 0 == -0; ANSI division would raise
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, zero)


def remainder(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_mod(a, b)).when(b == 0, F.lit(float("nan")))


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _length(v: Val) -> Column:
    if v.kind == "string":
        return F.length(v.col)
    if v.kind == "array":
        return F.when(v.col.isNotNull(), F.size(v.col))
    a = narrowed(v, "array").col
    return F.coalesce(F.length(narrowed(v, "string").col), F.when(a.isNotNull(), F.size(a)))


def _relative(i: Column, size: Column) -> Column:
    """An index from the front, or from the back if negative, within 0 .. size."""
    return F.when(i < 0, F.greatest(F.lit(0.0), size + i)).otherwise(F.least(i, size.cast("double"))).cast("int")


def _join(items: Column, between: Column) -> Column:
    parts = F.transform(items, lambda e, i: F.when(i == 0, e).otherwise(F.concat(between, e)))
    return F.array_join(parts, "")


def number_from(v: Val) -> Val:
    """v as a number, null where it doesn't convert; the language's null is 0."""

    def raw(v: Val) -> Column:
        if v.kind == "number":
            return v.col
        if v.kind == "boolean":
            return v.col.cast("double")
        if v.kind == "string":
            t = F.trim(v.col)
            return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
        if v.kind == "value":
            return F.coalesce(*[raw(narrowed(v, k)) for k in ("number", "boolean", "string")])
        return F.lit(None).cast("double")

    return replace(v, kind="number", col=F.when(v.col.isNull(), F.lit(0.0)).otherwise(raw(v)), const=ABSENT)


def first_of(vals: list[Val]) -> Val:
    """The first that isn't null; an error if all are."""
    col = F.coalesce(*[v.col for v in vals])
    ok = col.isNotNull()
    for v in reversed(vals):
        if v.ok is not None:
            ok = F.when(v.ok, ok if v is vals[-1] else F.when(v.col.isNotNull(), F.lit(True)).otherwise(ok)).otherwise(F.lit(False))
    return Val(vals[0].kind, col, ok, item=vals[0].item).with_deps(*vals)


def to_color(vals: list[Val]) -> Val:
    def one(v: Val) -> Val:
        none = F.lit(None).cast("struct<r:double,g:double,b:double,a:double>")
        if v.kind == "color":
            return v
        if v.kind == "string" and v.const is not ABSENT:
            c = color.parse(v.const)
            if c is None and len(vals) == 1:
                raise ExpressionError(f"Could not parse color from value '{v.const}'.")
            return replace(v, kind="color", col=none if c is None else color.column(c), const=ABSENT)
        if v.kind == "string":
            return replace(v, kind="color", col=color.parsed(v.col))
        if v.kind == "array" and v.item in ("number", "value"):
            c = v.col if v.item == "number" else F.transform(v.col, lambda e: narrowed(Val("value", e), "number").col)
            at = lambda i: F.try_element_at(c, F.lit(i))
            fits = F.size(c).isin(3, 4) & F.forall(F.slice(c, 1, 3), lambda e: e.between(0, 255)) & F.coalesce(at(4).between(0, 1), F.lit(True))
            return replace(v, kind="color", col=F.when(fits, color.struct_of(*[at(i) / 255 for i in (1, 2, 3)], F.coalesce(at(4), F.lit(1.0)))), const=ABSENT, item=None)
        if v.kind == "value":
            a, b = one(narrowed(v, "string")), one(narrowed(v, "array"))
            return replace(v, kind="color", col=F.coalesce(a.col, b.col))
        return replace(v, kind="color", col=none, const=ABSENT)

    if len(vals) == 1 and vals[0].kind == "color":
        return vals[0]
    return first_of([one(v) for v in vals])


def mixed(a: Val, b: Val, t: Column) -> Val:
    """a * (1 - t) + b * t, by channel or element."""
    mix = lambda x, y: x * (1 - t) + y * t
    if a.kind == "color":
        col = color.struct_of(*[mix(a.col[c], b.col[c]) for c in "rgba"])
    elif a.kind == "array":
        col = F.zip_with(a.col, b.col, mix)
    else:
        col = mix(a.col, b.col)
    return Val(a.kind, col, all_ok(a.ok, b.ok), item=a.item).with_deps(a, b)


def compile_expression(x, fields: Fields, state_allowed: bool = True) -> Val:
    return Compiler(fields, state_allowed=state_allowed).compile(x)


def filter_column(v: Val) -> Column:
    """True where the value is true and no error."""
    return F.coalesce(guarded(v), F.lit(False))


def property_column(v: Val, default: Column) -> Column:
    """The value, or the default where it is an error; null stays null."""
    return v.col if v.ok is None else F.when(F.coalesce(v.ok, F.lit(False)), v.col).otherwise(default)


__all__ = ["Compiler", "ExpressionError", "Fields", "compile_expression", "filter_column", "is_expression", "is_variant", "property_column"]
