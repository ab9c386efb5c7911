"""Colors: CSS notation, and columns of straight (not premultiplied) channels from 0 to 1."""

from __future__ import annotations

import colorsys
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named colors of CSS, as 24-bit numbers.
NAMED = dict(
    aliceblue=0xF0F8FF, antiquewhite=0xFAEBD7, aqua=0x00FFFF, aquamarine=0x7FFFD4, azure=0xF0FFFF, beige=0xF5F5DC,
    bisque=0xFFE4C4, black=0x000000, blanchedalmond=0xFFEBCD, blue=0x0000FF, blueviolet=0x8A2BE2, brown=0xA52A2A,
    burlywood=0xDEB887, cadetblue=0x5F9EA0, chartreuse=0x7FFF00, chocolate=0xD2691E, coral=0xFF7F50,
    cornflowerblue=0x6495ED, cornsilk=0xFFF8DC, crimson=0xDC143C, cyan=0x00FFFF, darkblue=0x00008B, darkcyan=0x008B8B,
    darkgoldenrod=0xB8860B, darkgray=0xA9A9A9, darkgreen=0x006400, darkgrey=0xA9A9A9, darkkhaki=0xBDB76B,
    darkmagenta=0x8B008B, darkolivegreen=0x556B2F, darkorange=0xFF8C00, darkorchid=0x9932CC, darkred=0x8B0000,
    darksalmon=0xE9967A, darkseagreen=0x8FBC8F, darkslateblue=0x483D8B, darkslategray=0x2F4F4F, darkslategrey=0x2F4F4F,
    darkturquoise=0x00CED1, darkviolet=0x9400D3, deeppink=0xFF1493, deepskyblue=0x00BFFF, dimgray=0x696969,
    dimgrey=0x696969, dodgerblue=0x1E90FF, firebrick=0xB22222, floralwhite=0xFFFAF0, forestgreen=0x228B22,
    fuchsia=0xFF00FF, gainsboro=0xDCDCDC, ghostwhite=0xF8F8FF, gold=0xFFD700, goldenrod=0xDAA520, gray=0x808080,
    green=0x008000, greenyellow=0xADFF2F, grey=0x808080, honeydew=0xF0FFF0, hotpink=0xFF69B4, indianred=0xCD5C5C,
    indigo=0x4B0082, ivory=0xFFFFF0, khaki=0xF0E68C, lavender=0xE6E6FA, lavenderblush=0xFFF0F5, lawngreen=0x7CFC00,
    lemonchiffon=0xFFFACD, lightblue=0xADD8E6, lightcoral=0xF08080, lightcyan=0xE0FFFF, lightgoldenrodyellow=0xFAFAD2,
    lightgray=0xD3D3D3, lightgreen=0x90EE90, lightgrey=0xD3D3D3, lightpink=0xFFB6C1, lightsalmon=0xFFA07A,
    lightseagreen=0x20B2AA, lightskyblue=0x87CEFA, lightslategray=0x778899, lightslategrey=0x778899,
    lightsteelblue=0xB0C4DE, lightyellow=0xFFFFE0, lime=0x00FF00, limegreen=0x32CD32, linen=0xFAF0E6, magenta=0xFF00FF,
    maroon=0x800000, mediumaquamarine=0x66CDAA, mediumblue=0x0000CD, mediumorchid=0xBA55D3, mediumpurple=0x9370DB,
    mediumseagreen=0x3CB371, mediumslateblue=0x7B68EE, mediumspringgreen=0x00FA9A, mediumturquoise=0x48D1CC,
    mediumvioletred=0xC71585, midnightblue=0x191970, mintcream=0xF5FFFA, mistyrose=0xFFE4E1, moccasin=0xFFE4B5,
    navajowhite=0xFFDEAD, navy=0x000080, oldlace=0xFDF5E6, olive=0x808000, olivedrab=0x6B8E23, orange=0xFFA500,
    orangered=0xFF4500, orchid=0xDA70D6, palegoldenrod=0xEEE8AA, palegreen=0x98FB98, paleturquoise=0xAFEEEE,
    palevioletred=0xDB7093, papayawhip=0xFFEFD5, peachpuff=0xFFDAB9, peru=0xCD853F, pink=0xFFC0CB, plum=0xDDA0DD,
    powderblue=0xB0E0E6, purple=0x800080, rebeccapurple=0x663399, red=0xFF0000, rosybrown=0xBC8F8F, royalblue=0x4169E1,
    saddlebrown=0x8B4513, salmon=0xFA8072, sandybrown=0xF4A460, seagreen=0x2E8B57, seashell=0xFFF5EE, sienna=0xA0522D,
    silver=0xC0C0C0, skyblue=0x87CEEB, slateblue=0x6A5ACD, slategray=0x708090, slategrey=0x708090, snow=0xFFFAFA,
    springgreen=0x00FF7F, steelblue=0x4682B4, tan=0xD2B48C, teal=0x008080, thistle=0xD8BFD8, tomato=0xFF6347,
    turquoise=0x40E0D0, violet=0xEE82EE, wheat=0xF5DEB3, white=0xFFFFFF, whitesmoke=0xF5F5F5, yellow=0xFFFF00,
    yellowgreen=0x9ACD32,
)

Rgba = tuple[float, float, float, float]
_FUNCTION = re.compile(r"^(rgb|rgba|hsl|hsla)\(\s*([^()]*)\)$")


def parse(text: str) -> Rgba | None:
    """A CSS color as channels from 0 to 1, or None."""
    t = text.strip().lower()
    if t == "transparent":
        return (0.0, 0.0, 0.0, 0.0)
    if t in NAMED:
        return (*((NAMED[t] >> s & 255) / 255 for s in (16, 8, 0)), 1.0)
    if t.startswith("#") and re.fullmatch(r"[0-9a-f]+", t[1:]):
        h = t[1:]
        if len(h) in (3, 4):
            h = "".join(c * 2 for c in h)
        if len(h) in (6, 8):
            c = [int(h[i : i + 2], 16) / 255 for i in range(0, len(h), 2)]
            return (c[0], c[1], c[2], c[3] if len(c) == 4 else 1.0)
        return None
    m = _FUNCTION.match(t)
    if not m:
        return None
    parts = [p for p in re.split(r"[\s,/]+", m[2].strip()) if p]
    if len(parts) not in (3, 4):
        return None
    try:
        alpha = 1.0 if len(parts) == 3 else _share(parts[3], 1.0)
        if m[1].startswith("rgb"):
            return (*(min(1.0, max(0.0, _share(p, 255.0))) for p in parts[:3]), min(1.0, max(0.0, alpha)))
        hue = float(parts[0].removesuffix("deg")) % 360 / 360
        s, light = (min(1.0, max(0.0, float(p.removesuffix("%")) / 100)) for p in parts[1:3])
        r, g, b = colorsys.hls_to_rgb(hue, light, s)
        return (r, g, b, min(1.0, max(0.0, alpha)))
    except ValueError:
        return None


def _share(part: str, whole: float) -> float:
    return float(part[:-1]) / 100 if part.endswith("%") else float(part) / whole


def column(c: Rgba) -> Column:
    return struct_of(*[F.lit(float(x)) for x in c])


def struct_of(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def parsed(text: Column) -> Column:
    """A column of CSS texts (names, hex, rgb and hsl notation) as colors; null for what isn't one. The text is bound to a
    variable, so that what makes it is evaluated once."""
    return F.get(F.transform(F.array(F.lower(F.trim(text))), _parsed), F.lit(0))


def _parsed(t: Column) -> Column:
    pairs = [x for name, n in NAMED.items() for x in (F.lit(name), F.lit(n))]
    number = F.try_element_at(F.create_map(*pairs), t)
    long = F.when(F.length(t).isin(4, 5), F.regexp_replace(t, "([0-9a-f])", "$1$1")).otherwise(t)

    def hex_at(i: int) -> Column:
        return F.conv(F.substring(long, i, 2), 16, 10).cast("double") / 255

    is_hex = t.rlike("^#([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$")
    hexed = struct_of(hex_at(2), hex_at(4), hex_at(6), F.when(F.length(long) == 9, hex_at(8)).otherwise(F.lit(1.0)))
    rest = r"(?:[\s,/]+([0-9.]+)(%?))?\s*\)$"
    rgb_, hsl_ = r"^rgba?\(\s*([0-9.]+)[\s,]+([0-9.]+)[\s,]+([0-9.]+)" + rest, r"^hsla?\(\s*([-+]?[0-9.]+)(?:deg)?[\s,]+([0-9.]+)%?[\s,]+([0-9.]+)%?" + rest

    def part(pattern: str, i: int) -> Column:
        return F.expr("1D") * F.regexp_extract(t, pattern, i).try_cast("double")

    def alpha(pattern: str) -> Column:
        a = part(pattern, 4) / F.when(F.regexp_extract(t, pattern, 5) == "%", 100.0).otherwise(1.0)
        return F.coalesce(F.least(F.lit(1.0), a), F.lit(1.0))

    rgb = struct_of(*[F.least(F.lit(1.0), part(rgb_, i) / 255) for i in (1, 2, 3)], alpha(rgb_))
    hue, sat, light = F.pmod(part(hsl_, 1), F.lit(360.0)) / 30, F.least(F.lit(1.0), part(hsl_, 2) / 100), F.least(F.lit(1.0), part(hsl_, 3) / 100)

    def channel(k: float) -> Column:
        n = (hue + k) % 12
        return light - sat * F.least(light, 1 - light) * F.greatest(F.lit(-1.0), F.least(n - 3, 9 - n, F.lit(1.0)))

    hsl = struct_of(channel(0.0), channel(8.0), channel(4.0), alpha(hsl_))
    named = struct_of(*[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("double") / 255 for s in (16, 8, 0)], F.lit(1.0))
    return F.when(number.isNotNull(), named).when(is_hex, hexed).when(t.rlike(rgb_), rgb).when(t.rlike(hsl_), hsl).when(t == "transparent", column((0, 0, 0, 0)))
