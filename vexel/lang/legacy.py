"""Legacy functions: objects with stops over zoom, a property, or both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compiler import Compiler, mixed, to_color
from .curves import factor
from .values import ExpressionError, Fields, Val, equal, literal, narrowed


def is_function(x) -> bool:
    return isinstance(x, dict) and ("stops" in x or x.get("type") == "identity")


class LegacyFunction:
    """kind is what the property takes (number, string, boolean, color or None); interpolates says whether its values
    can be mixed; default is what stands in where the function has no value."""

    def __init__(self, fn: dict, fields: Fields, kind: str | None, interpolates: bool, default=None):
        self.fields, self.kind = fields, kind
        self.property, self.base = fn.get("property"), float(fn.get("base", 1))
        self.stops = fn.get("stops", [])
        self.default = fn.get("default", default)
        self.type = fn.get("type") or ("exponential" if interpolates else "interval")
        if self.type not in ("identity", "categorical", "interval", "exponential"):
            raise ExpressionError(f"Unknown function type \"{self.type}\".")
        if any(not isinstance(s, list) or len(s) != 2 for s in self.stops):
            raise ExpressionError("Stops must be pairs.")

    def _value(self, x) -> Val:
        v = literal(x)
        return to_color([v]) if self.kind == "color" and v.kind == "string" else v

    def _default(self) -> Val:
        """The function's default, or an error."""
        if self.default is None:
            empty = literal(None)
            return Val("null", empty.col, F.lit(False))
        return self._value(self.default)

    def _pick(self, tests: list[Column], outputs: list[Val]) -> Val:
        return Compiler(self.fields)._ladder(tests, outputs)

    def compile(self) -> Val:
        if any(isinstance(s, dict) and "zoom" in s for s, _ in self.stops):
            return self._composite()
        c = Compiler(self.fields)
        x = c.get("get", [self.property]) if self.property is not None else c.camera("zoom", [])
        return self._over(x, self.stops).with_deps(x)

    def _over(self, x: Val, stops: list) -> Val:
        if self.type == "identity":
            own = to_color([narrowed(x, "string")]) if self.kind == "color" else narrowed(x, self.kind) if self.kind else x
            if own.kind == "null":
                return self._default()
            return self._pick([own.col.isNotNull()], [Val(own.kind, own.col, item=own.item), self._default()])
        if self.type == "categorical":
            return self._pick([F.coalesce(x.col.isNotNull() & equal(x, literal(s)), F.lit(False)) for s, _ in stops], [*[self._value(o) for _, o in stops], self._default()])
        number = narrowed(x, "number").col
        numeric = [(float(s), o) for s, o in stops if isinstance(s, (int, float)) and not isinstance(s, bool)]
        if not numeric:
            return self._default()
        outputs = [self._value(o) for _, o in numeric]
        if self.type == "interval":
            # of equal stops the first one counts, and stops end at the first that is out of order
            at: list[tuple[float, Val]] = []
            for (s, _), o in zip(numeric, outputs):
                if not at or s > at[-1][0]:
                    at.append((s, o))
            tests, ladder = [number.isNull()], [self._default()]
            for s, o in reversed(at):
                tests.append(number >= s)
                ladder.append(o)
            return self._pick(tests, [*ladder, outputs[0]])
        tests, ladder = [number.isNull(), number <= numeric[0][0]], [self._default(), outputs[0]]
        for k in range(len(numeric) - 1):
            low, high = numeric[k][0], numeric[k + 1][0]
            tests.append(number <= high)
            ladder.append(self._between(outputs[k], outputs[k + 1], factor(number, self.base, low, high)))
        return self._pick(tests, [*ladder, outputs[-1]])

    @staticmethod
    def _between(a: Val, b: Val, t: Column) -> Val:
        same = a.kind == b.kind and (a.kind in ("number", "color") or a.kind == "array" and a.item == b.item == "number" and a.size == b.size)
        # what can't be mixed steps
        return mixed(a, b, t) if same else a

    def _composite(self) -> Val:
        zoom = Compiler(self.fields).camera("zoom", [])
        levels = sorted({float(s["zoom"]) for s, _ in self.stops if isinstance(s, dict) and isinstance(s.get("zoom"), (int, float))})
        x = Compiler(self.fields).get("get", [self.property])
        curves = [self._over(x, [(s.get("value"), o) for s, o in self.stops if isinstance(s, dict) and s.get("zoom") == z]) for z in levels]
        tests, ladder = [zoom.col <= levels[0]], [curves[0]]
        for k in range(len(levels) - 1):
            tests.append(zoom.col <= levels[k + 1] if k + 2 < len(levels) else zoom.col < levels[k + 1])
            between = curves[k] if self.type != "exponential" else self._between(curves[k], curves[k + 1], factor(zoom.col, self.base, levels[k], levels[k + 1]))
            ladder.append(between)
        return self._pick(tests, [*ladder, curves[-1]]).with_deps(x, zoom)


