"""The public conformance suite of style expressions: a folder of test.json files that VEXEL_SUITE names. Each case has an
expression, inputs, and what is expected: whether it compiles, what its value depends on, and an output an input."""

import json
import math
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vexel.lang.compiler import compile_expression
from vexel.lang.legacy import LegacyFunction, is_function
from vexel.lang.values import ExpressionError, Fields, Val
from vexel.plans.properties import coerced

ROOT = os.environ.get("VEXEL_SUITE", "")
#: Cases that are platform-specific, or that the suite's other implementations don't pass either.
IGNORED = {
    "collator/accent-equals-de", "interpolate-hcl/linear", "interpolate-lab/linear", "is-supported-script/default", "legacy/categorical/array", "legacy/categorical/boolean", "legacy/categorical/color", "legacy/categorical/number", "legacy/categorical/string",
    "legacy/exponential/color-hcl", "legacy/exponential/color-lab", "legacy/identity/color-default", "legacy/identity/enum-default", "legacy/interval/composite", "legacy/interval/composite-default", "legacy/interval/tokens-zoom", "resolved-locale/basic", "within/non-supported",
}
#: Cases that are known to differ: checks of types before evaluation that aren't made (an item or length of an array, a branch's
#: type against the property's, errors of constant parts, where zoom may stand), options that must be constant here.
DIFFERENT = {
    "at/infer-array-type", "coalesce/argument-type-mismatch", "coalesce/infer-array-type", "collator/diacritic-omitted-en", "constant-folding/evaluation-error", "format/implicit-assert", "get/from-literal--missing", "interpolate/exponential-uninterpolatable-numeric-array", "interpolate/linear-color",
    "legacy/identity/array", "legacy/identity/array-default", "match/mismatch-output", "number-format/currency", "number-format/precision", "typecheck/array-invalid-item", "typecheck/array-length-subtyping--no-length", "typecheck/array-wrong-length", "zoom/invalid-no-curve",
}
KINDS = {"number": "number", "string": "string", "boolean": "boolean", "color": "color", "array": "array", "enum": "string", "formatted": "formatted", "resolvedImage": "image"}
_LINES = "array<array<array<struct<x:double,y:double>>>>"


def cases() -> list[str]:
    found = [str(p.parent.relative_to(ROOT)) for p in sorted(Path(ROOT).rglob("test.json"))] if ROOT else []
    return [c for c in found if c not in IGNORED]


def fields(globals_: dict, feature: dict) -> Fields:
    g = feature.get("geometry") or {}
    f = Fields(F.parse_json(F.lit(json.dumps(feature.get("properties", {})))))
    f.geom_type = F.lit(g.get("type", feature.get("geometry_type", "Point")).removeprefix("Multi"))
    if "id" in feature:
        v = feature["id"]
        f.id = Val("number", F.lit(float(v)), deps=frozenset({"feature"})) if isinstance(v, (int, float)) else Val("string", F.lit(v), deps=frozenset({"feature"}))
    if "coordinates" in g:
        depth = {"Point": 3, "MultiPoint": 2, "LineString": 2, "MultiLineString": 1, "Polygon": 1}.get(g["type"], 0)
        c = g["coordinates"]
        for _ in range(depth):
            c = [c]
        geom = [[[{"x": p[0], "y": p[1]} for p in line] for line in part] for part in c]
        f.geom = F.from_json(F.lit(json.dumps(geom)), _LINES)
    f.zoom = globals_.get("zoom")
    f.ramp = globals_.get("heatmapDensity")
    f.images = set(globals_["availableImages"]) if "availableImages" in globals_ else None
    return f


def compiled(case: dict, at: Fields) -> Val:
    x, spec = case["expression"], case.get("propertySpec") or {}
    kind = KINDS.get(spec.get("type"))
    if is_function(x):
        return LegacyFunction(x, at, None if kind == "array" else kind, kind in ("number", "color", "array"), spec.get("default")).compile()
    if kind == "array" and "value" in spec:
        # what the property asserts of its value
        x = ["array", spec["value"], *([spec["length"]] if "length" in spec else []), x] if isinstance(x, list) else ["literal", x]
    v = compile_expression(x, at)
    return v if kind in (None, "array") else coerced(v, kind)


def column(v: Val):
    c = F.to_json(v.col) if v.kind in ("value", "object", "formatted", "image", "color", "array") else F.to_json(F.struct(v.col.alias("v")))
    c = F.when(v.col.isNull(), F.lit("null")).otherwise(c) if v.kind != "null" else F.lit("null")
    return c if v.ok is None else F.when(F.coalesce(v.ok, F.lit(False)), c)


def value(v: Val, text: str):
    x = json.loads(text)
    if x is None:
        return None
    if v.kind == "color":
        return [x["r"] * x["a"], x["g"] * x["a"], x["b"] * x["a"], x["a"]]
    if v.kind in ("value", "object", "array", "formatted", "image"):
        return x
    return x.get("v")


def agree(got, want) -> bool:
    if isinstance(want, (int, float)) and not isinstance(want, bool) and isinstance(got, (int, float)) and not isinstance(got, bool):
        return math.isclose(got, want, rel_tol=1e-5, abs_tol=1e-6)
    if isinstance(want, list) and isinstance(got, list):
        return len(want) == len(got) and all(map(agree, got, want))
    if isinstance(want, dict) and isinstance(got, dict):
        return set(want) == set(got) and all(agree(got[k], want[k]) for k in want)
    return type(got) is type(want) and got == want or got == want and not isinstance(want, bool)


def formatted(x) -> dict:
    """Sections as the suite writes them."""
    out = []
    for s in x:
        tint = s.get("color")
        out.append({"text": s["text"], "image": None if s.get("image") is None else {"name": s["image"]}, "scale": s.get("scale"), "fontStack": None if s.get("font") is None else ",".join(s["font"]), "textColor": tint})
    return {"sections": out}


def failures(spark, names: list[str]) -> dict[str, str]:
    bad, pending = {}, []
    for name in names:
        case = json.loads(Path(ROOT, name, "test.json").read_text())
        wants = case["expected"]["compiled"]["result"] == "success"
        inputs = case.get("inputs") or []
        try:
            vals = [compiled(case, fields(g, f)) for g, f in inputs] or [compiled(case, fields({"zoom": 1.0, "heatmapDensity": 0.5}, {}))]
        except ExpressionError as e:
            if wants:
                bad[name] = f"doesn't compile: {e}"
            continue
        if not wants:
            bad[name] = "compiles"
            continue
        pending += [(name, v, want) for v, want in zip(vals, case["expected"].get("outputs", []))]
    for a in range(0, len(pending), 60):
        some = pending[a : a + 60]
        try:
            row = spark.range(1).select(*[column(v).alias(f"c{i}") for i, (_, v, _) in enumerate(some)]).first()
        except Exception:
            row = []
            for _, v, _ in some:
                try:
                    row.append(spark.range(1).select(column(v)).first()[0])
                except Exception as e:
                    row.append(f"!{str(e)[:200]}")
        for (name, v, want), text in zip(some, row):
            if isinstance(want, dict) and set(want) == {"error"}:
                if text is not None:
                    bad[name] = f"no error but {text}"
            elif text is None or text.startswith("!"):
                bad[name] = f"error instead of {want}: {text}"
            else:
                got = value(v, text)
                if v.kind == "formatted" and got is not None:
                    got = formatted(got)
                    for s in want["sections"]:
                        s["image"] = s.get("image") and {"name": s["image"]["name"]}
                if not agree(got, want):
                    bad[name] = f"{got} instead of {want}"
    return bad


@pytest.mark.skipif(not ROOT, reason="VEXEL_SUITE names no folder")
def test_suite(spark):
    names = cases()
    assert len(names) > 300
    assert set(failures(spark, names)) <= DIFFERENT
