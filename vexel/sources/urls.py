"""Tile URLs: templates compiled to Columns, and percent encoding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spatial.projection import quadkey, tile_bbox

_TOKEN = re.compile(r"\{([^{}]*)\}")


def expand(template: str, z: int, x: Column, y: Column, scheme: str = "xyz", ratio: float = 1.0) -> Column:
    """A tile's URL. Tokens z, x, y, quadkey, bbox-epsg-3857, prefix and ratio are filled in; unknown tokens and
    unclosed braces stay as they are; tms counts rows from the south."""
    if scheme == "tms":
        y = F.lit((1 << z) - 1) - y
    hexdigit = lambda c: F.lower(F.hex(c % 16))
    known = {
        "z": lambda: F.lit(str(z)),
        "x": lambda: x.cast("string"),
        "y": lambda: y.cast("string"),
        "quadkey": lambda: quadkey(z, x, y),
        "bbox-epsg-3857": lambda: F.concat_ws(",", *[c.cast("string") for c in tile_bbox(z, x, y)]),
        "prefix": lambda: F.concat(hexdigit(x), hexdigit(y)),
        "ratio": lambda: F.lit("@2x" if ratio > 1 else ""),
    }
    parts, at = [], 0
    for m in _TOKEN.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(known[m[1]]() if m[1] in known else F.lit(m[0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def pick(templates: list[str], x: Column, y: Column) -> Column:
    """Which of several templates serves a tile: neighbors go to different ones."""
    return F.element_at(F.array(*[F.lit(t) for t in templates]), F.pmod(x + y, F.lit(len(templates))) + 1)


def percent_encoded(text: Column) -> Column:
    """All bytes but RFC 3986's unreserved ones as lower-case %xx."""
    pairs = F.split(F.regexp_replace(F.lower(F.hex(text.cast("binary"))), "(..)", "$1 "), " ")
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~"
    table = F.create_map(*[F.lit(v) for c in plain for v in (f"{ord(c):02x}", c)])
    one = lambda p: F.when(p == "", F.lit("")).otherwise(F.coalesce(F.try_element_at(table, p), F.concat(F.lit("%"), p)))
    return F.array_join(F.transform(pairs, one), "")


def canonical(url: str, key_names=("access_token", "key", "api_key")) -> str:
    """A url without its access key, so that equal resources have equal names whoever asks."""
    head, mark, query = url.partition("?")
    kept = [p for p in query.split("&") if p and p.split("=", 1)[0] not in key_names]
    return head + ("?" + "&".join(kept) if kept else "")


def canonical_column(url: Column, key_names=("access_token", "key", "api_key")) -> Column:
    """canonical() as a Column."""
    at = F.instr(url, "?")
    head = F.when(at > 0, F.substring(url, F.lit(1), at - 1)).otherwise(url)
    query = F.when(at > 0, F.substring(url, at + 1, F.length(url))).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*key_names))
    return F.when(F.size(kept) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"))).otherwise(head)


class Router:
    """The first route whose test takes a url, else the fallback, else an error."""

    def __init__(self, routes: list, fallback=None):
        self.routes, self.fallback = routes, fallback

    def __call__(self, url: str):
        for test, route in self.routes:
            if test(url):
                return route
        if self.fallback is None:
            raise LookupError(f"nothing serves {url}")
        return self.fallback

    def column(self, url: Column) -> Column:
        """The route of each url, by tests that take and give Columns; null where the fallback is None."""
        found = F.lit(self.fallback)
        for test, route in reversed(self.routes):
            found = F.when(test(url), F.lit(route)).otherwise(found)
        return found


def tile_set(tilejson: dict) -> dict:
    """A TileJSON document's templates, zooms, bounds and scheme, with their defaults."""
    if not tilejson.get("tiles"):
        raise ValueError("a tile set needs tiles")
    low, high = int(tilejson.get("minzoom", 0)), int(tilejson.get("maxzoom", 22))
    if low > high:
        raise ValueError("minzoom is above maxzoom")
    return {"tiles": list(tilejson["tiles"]), "minzoom": low, "maxzoom": high, "scheme": tilejson.get("scheme", "xyz"), "bounds": tilejson.get("bounds", [-180, -90, 180, 90])}
