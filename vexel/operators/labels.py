"""Labels: greedy placement, line merging, identities across tiles, line breaking. All depend on order within a view, tile or
text, so each such group is handled by one task, in order."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def place(boxes: pd.DataFrame, cell: float = 64.0) -> list[bool]:
    """First come, first placed: a box (x0, y0, x1, y1) that touches a placed one isn't placed, unless its overlap is
    allowed; one that ignores placement is placed but takes no space."""
    grid: dict[tuple[int, int], list[int]] = defaultdict(list)
    b = boxes[["x0", "y0", "x1", "y1"]].to_numpy(float)
    allow, ignore = boxes["allow_overlap"].to_numpy(bool), boxes["ignore_placement"].to_numpy(bool)
    placed = []
    for i, (x0, y0, x1, y1) in enumerate(b):
        cells = [(cx, cy) for cx in range(int(x0 // cell), int(x1 // cell) + 1) for cy in range(int(y0 // cell), int(y1 // cell) + 1)]
        hit = not allow[i] and any(x0 <= b[j, 2] and b[j, 0] <= x1 and y0 <= b[j, 3] and b[j, 1] <= y1 for c in cells for j in grid.get(c, ()))
        placed.append(not hit)
        if not hit and not ignore[i]:
            for c in cells:
                grid[c].append(i)
    return placed


def placement(candidates: DataFrame) -> DataFrame:
    """candidates (view, ord, id, x0, y0, x1, y1, allow_overlap, ignore_placement) with placed. A view's candidates are
    the labels of one screen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"], ignore_index=True)
        return pdf.assign(placed=place(pdf))[["view", "ord", "id", "placed"]]

    return candidates.groupBy("view").applyInPandas(run, "view long, ord long, id long, placed boolean")


def symbol_placement(candidates: DataFrame) -> DataFrame:
    """Labels of two boxes (kind text or icon): a label is placed if both are; one that is optional may be missing, and then
    takes no space."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[np.ndarray] = []
        out = []
        for (order, label), own in pdf.sort_values(["ord", "id", "kind"]).groupby(["ord", "id"], sort=True):
            free = {}
            for r in own.itertuples():
                hit = not r.allow_overlap and any(r.x0 <= t[2] and t[0] <= r.x1 and r.y0 <= t[3] and t[1] <= r.y1 for t in taken)
                free[r.kind] = not hit
            needed = [k for k, o in zip(own.kind, own.optional) if not o]
            shown = all(free[k] for k in needed) and any(free.values())
            for r in own.itertuples():
                on = shown and free[r.kind]
                if on and not r.ignore_placement:
                    taken.append(np.array([r.x0, r.y0, r.x1, r.y1]))
                out.append((r.view, order, label, r.kind, on))
        return pd.DataFrame(out, columns=["view", "ord", "id", "kind", "placed"])

    return candidates.groupBy("view").applyInPandas(run, "view long, ord long, id long, kind string, placed boolean")


def merge_lines(lines: list[tuple[str, list[tuple[float, float]]]]) -> list[tuple[int, list[tuple[float, float]]]]:
    """(text, points) in order: a line that ends where an earlier one of the same text begins, or the other way round, is
    spliced to it; the earlier line's number stays."""
    heads: dict[tuple, int] = {}
    tails: dict[tuple, int] = {}
    out: dict[int, list] = {}
    ends = lambda p: (int(p[0]), int(p[1]))
    for i, (text, points) in enumerate(lines):
        if not text or len(points) < 2:
            out[i] = list(points)
            continue
        a, b = (text, *ends(points[0])), (text, *ends(points[-1]))
        before, after = tails.pop(a, None), heads.pop(b, None)
        if before is not None and before == after:
            # it would close a ring
            tails[a] = before
            heads[b] = after
            out[i] = list(points)
            continue
        at, merged = i, list(points)
        if before is not None:
            heads.pop((text, *ends(out[before][0])), None)
            merged = out.pop(before)[:-1] + merged
            at = min(at, before)
        if after is not None:
            tails.pop((text, *ends(out[after][-1])), None)
            merged = merged[:-1] + out.pop(after)
            at = min(at, after)
        out[at] = merged
        heads[(text, *ends(merged[0]))] = at
        tails[(text, *ends(merged[-1]))] = at
    return sorted(out.items())


def _chained(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge_lines() of lines of one text that begin and end at the places a and b (numbers from 0): (the lines, chain by chain in
    order of the chains' numbers and from head to tail within each, where each chain begins there). What is kept of a line is
    where it goes on, not its points."""
    n, places = len(a), int(max(a.max(), b.max())) + 1
    heads, tails = array("i", [-1]) * places, array("i", [-1]) * places
    following, first, last, start, end = (array("i", [-1]) * n for _ in range(5))
    live = bytearray(b"\1") * n
    for block in range(0, n, 1 << 16):
        for i, p, q in zip(range(block, n), a[block : block + (1 << 16)].tolist(), b[block : block + (1 << 16)].tolist()):
            before, after = tails[p], heads[q]
            if before == after >= 0:
                # it would close a ring
                first[i] = i
                continue
            tails[p] = heads[q] = -1
            at = head = tail = i
            if before >= 0:
                p, head = start[before], first[before]
                heads[p], following[last[before]], live[i] = -1, i, 0
                at = before
            if after >= 0:
                q, tail = end[after], last[after]
                tails[q], following[i], live[max(at, after)] = -1, first[after], 0
                at = min(at, after)
            start[at], end[at], first[at], last[at] = p, q, head, tail
            heads[p] = tails[q] = at
    order, chains = array("i"), array("i")
    for c in np.flatnonzero(np.frombuffer(live, np.uint8)).tolist():
        chains.append(len(order))
        i = first[c]
        while i >= 0:
            order.append(i)
            i = following[i]
    return np.frombuffer(order, np.int32), np.frombuffer(chains, np.int32)


#: About the points of a batch of merged lines.
_BATCH_POINTS = 1 << 18


def _ends(xs: pa.Array, ys: pa.Array) -> list[pa.Array]:
    """Where lines begin, and where they end, in whole units: 16 bytes each."""
    out = []
    for last in (False, True):
        at = np.empty((len(xs), 2))
        for k, v in enumerate((xs, ys)):
            offsets = v.offsets.to_numpy()
            at[:, k] = v.values.to_numpy(zero_copy_only=False)[offsets[1:] - 1 if last else offsets[:-1]]
        # zero has one sign only
        at = np.trunc(at) + 0.0
        if not np.isfinite(at).all():
            raise ValueError("a line's end is not a number")
        out.append(pa.Array.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(at)]))
    return out


def _merged(columns: list[list[pa.Array]]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Lines of one tile, layer and text, in order, as batches of merged ones. columns: the parts of ord, xs and ys, which
    are let go as they are read. Points stay in Arrow's form."""
    both = [_ends(x, y) for x, y in zip(*columns[1:])]
    codes = pa.chunked_array([p for k in (0, 1) for p in (b[k] for b in both)]).dictionary_encode()
    del both
    numbers = np.concatenate([c.indices.to_numpy() for c in codes.chunks])
    del codes
    n = len(numbers) // 2
    order, begin = _chained(numbers[:n], numbers[n:])
    del numbers
    parts = []
    for c in columns:
        parts.append(pa.concat_arrays(c))
        c.clear()
    ords, lists = parts[0], parts[1:]
    flat, offsets = [v.values.to_numpy(zero_copy_only=False) for v in lists], lists[0].offsets.to_numpy()
    # both hold the same number of points a line, but may begin elsewhere in their buffers
    shift = (0, int(lists[1].offsets[0].as_py()) - int(offsets[0]))
    # a point at which two lines meet is taken from the later one
    points = (offsets[1:] - offsets[:-1])[order] - 1
    bounds = np.append(begin, n)
    points[bounds[1:] - 1] += 1
    total = np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
    c = 0
    while c < len(begin):
        d = max(c + 1, int(np.searchsorted(total, total[begin[c]] + _BATCH_POINTS, side="right")) - 1)
        d = max(c + 1, int(np.searchsorted(bounds, d, side="right")) - 1)
        low, high = int(bounds[c]), int(bounds[d])
        base = total[low]
        at = np.repeat(offsets[order[low:high]] - (total[low:high] - base), points[low:high]) + np.arange(total[high] - base)
        ends = pa.array(total[bounds[c : d + 1]] - base, pa.int32())
        lowest = np.minimum.reduceat(order[low:high], begin[c:d] - low)
        yield ords.take(pa.array(lowest)), *(pa.ListArray.from_arrays(ends, pa.array(v[at + by])) for v, by in zip(flat, shift))
        c = d


def merged_lines(lines: DataFrame) -> DataFrame:
    """lines (tile, layer, ord, text, xs, ys) merged within each tile and layer. Lines of different texts never meet, so a task
    takes those of one tile, layer and text, in order; what it holds of them are their numbers and coordinates."""
    n = F.least(F.size("xs"), F.size("ys"))
    same = F.size("xs") == F.size("ys")
    rows = lines.select("tile", "layer", "ord", "text", *[F.when(same, F.col(c)).otherwise(F.slice(c, F.lit(1), F.greatest(n, F.lit(0)))).cast("array<double>").alias(c) for c in ("xs", "ys")])
    # a line without a text or with fewer than two points meets none
    alone = F.col("text").isNull() | (F.col("text") == "") | F.coalesce(n < 2, F.lit(True))
    names = rows.columns
    dealt = rows.repartition("tile", "layer", "text", F.when(alone, F.col("ord"))).sortWithinPartitions("tile", "layer", "text", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the lines of one tile, layer and text
        held, own = [[], [], []], []

        def group() -> Iterator[pa.RecordBatch]:
            for o, xs, ys in _merged(held):
                tile, layer, text = (pa.repeat(v, len(o)) for v in own)
                yield pa.RecordBatch.from_arrays([tile, layer, o, text, xs, ys], names=names)
            own.clear()

        for batch in batches:
            text, size = batch.column(3), pc.fill_null(pc.list_value_length(batch.column(4)), 0)
            meets = pc.and_(pc.fill_null(pc.not_equal(text, ""), False), pc.greater(size, 1))
            rest = batch.filter(pc.invert(meets))
            if rest.num_rows:
                yield rest
            batch = batch.filter(meets)
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in (0, 1, 3):
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            if own and any(batch.column(k)[0].as_py() != v.as_py() for k, v in zip((0, 1, 3), own)):
                yield from group()
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
                if i:
                    yield from group()
                own[:] = [batch.column(k)[low] for k in (0, 1, 3)]
                for column, k in zip(held, (2, 4, 5)):
                    column.append(batch.column(k).slice(low, high - low))
        if own:
            yield from group()

    return dealt.mapInArrow(run, rows.schema).select(*[F.col(f.name).cast(f.dataType) for f in lines.select(*rows.columns).schema])


def cross_tile_ids(symbols: DataFrame, prior: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """symbols (key, x, y, ord) and the last index's (key, x, y, cross_id), positions in the same units: a symbol takes the id
    of an unclaimed one of its key within the tolerance, the first in order; others get new ids, above all known."""
    both = symbols.select("key", "x", "y", F.col("ord").cast("long").alias("ord"), F.lit(None).cast("long").alias("cross_id")).unionByName(prior.select("key", "x", "y", F.lit(None).cast("long").alias("ord"), F.col("cross_id").cast("long").alias("cross_id")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # the old symbols of a key by cells as wide as the tolerance: a new one meets those of the cells around its own
        cells: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        side = max(tolerance, 1e-9)
        of = lambda v: int(np.floor(v / side))
        for r in pdf[pdf.cross_id.notna()].sort_values("cross_id").itertuples():
            cells.setdefault((of(r.x), of(r.y)), {})[int(r.cross_id)] = (r.x, r.y)
        out = []
        for r in pdf[pdf.ord.notna()].sort_values("ord").itertuples():
            near = [cells.get((of(r.x) + i, of(r.y) + j), {}) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            found = min(((i, k) for k, c in enumerate(near) for i, (x, y) in c.items() if abs(x - r.x) <= tolerance and abs(y - r.y) <= tolerance), default=None)
            if found is not None:
                del near[found[1]][found[0]]
            out.append((r.key, int(r.ord), r.x, r.y, found and found[0]))
        return pd.DataFrame(out, columns=["key", "ord", "x", "y", "cross_id"]).astype({"cross_id": "Int64", "ord": "int64"})

    matched = both.groupBy("key").applyInPandas(run, "key string, ord long, x double, y double, cross_id long")
    top = prior.agg(F.coalesce(F.max("cross_id"), F.lit(0)).alias("top"))
    fresh = numbered(matched.where("cross_id is null"), ["ord", "key"], "n")
    new = fresh.join(F.broadcast(top)).select("key", "ord", "x", "y", (F.col("top") + F.col("n")).cast("long").alias("cross_id"))
    return matched.where("cross_id is not null").unionByName(new)


def line_breaks(widths: list[float], breakable: list[bool], most: float, penalties: list[float] | None = None) -> list[int]:
    """Where to break a text of advances so that lines are even: the least sum of squared distances from the target width,
    which makes for about equal lines no wider than `most`. Returns the places after which a line ends."""
    total = sum(widths)
    if not widths or most <= 0 or total <= most:
        return []
    target = total / max(1, -(-total // most))
    at = [0.0]
    for w in widths:
        at.append(at[-1] + w)
    places = [i for i, b in enumerate(breakable) if b and i + 1 < len(widths)]
    best: dict[int, tuple[float, int | None]] = {-1: (0.0, None)}

    def cost(start: int, end: int, last: bool) -> float:
        width = at[end + 1] - at[start + 1]
        raggedness = (width - target) ** 2
        if last and width < target:
            raggedness /= 2
        p = 0.0 if penalties is None or last else penalties[end]
        return raggedness + (abs(p) * p)

    for i in places:
        best[i] = min((best[j][0] + cost(j, i, False), j) for j in best if j < i)
    end = len(widths) - 1
    _, j = min((c + cost(k, end, True), k) for k, (c, _) in best.items())
    out = []
    while j is not None and j >= 0:
        out.append(j)
        j = best[j][1]
    return sorted(out)


def shelf_pack(sizes: list[tuple[int, int]], width: int, height: int) -> list[tuple[int, int] | None]:
    """Places for rectangles on shelves: the shelf that wastes the least height, else a new one; None where none fits."""
    shelves: list[list[int]] = []
    out: list[tuple[int, int] | None] = []
    for w, h in sizes:
        fits = [s for s in shelves if s[1] >= h and width - s[2] >= w]
        if fits:
            s = min(fits, key=lambda s: s[1] - h)
        else:
            top = shelves[-1][0] + shelves[-1][1] if shelves else 0
            if top + h > height or w > width:
                out.append(None)
                continue
            s = [top, h, 0]
            shelves.append(s)
        out.append((s[2], s[0]))
        s[2] += w
    return out


def glyph_ranges(texts: DataFrame) -> DataFrame:
    """texts (stack, text) to the distinct ranges of 256 code points that each font stack needs."""
    # most characters are of the first range: what is left without them is short, and each is looked at once a text
    rest = texts.select("stack", "text", F.regexp_replace("text", r"[\x00-\xFF]+", "").alias("rest"))
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
    others = F.transform(F.filter(F.array_distinct(F.split("rest", "")), lambda c: c != ""), lambda c: F.floor(point(c) / 256).cast("int"))
    first = F.when(F.length("rest") < F.length("text"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return rest.select("stack", F.explode(F.array_distinct(F.concat(first, others))).alias("range")).distinct()


def owed(needed: DataFrame, loaded: DataFrame) -> DataFrame:
    return needed.join(loaded, ["stack", "range"], "left_anti")


def collision_box(extent: dict, anchor_x, anchor_y, scale, padding, degrees=None) -> tuple:
    """A label's box (x0, y0, x1, y1) as Columns: its extent (top, bottom, left, right) scaled and padded around the
    anchor; turned, it is the upright box around the turned one."""
    x0, x1 = extent["left"] * scale - padding, extent["right"] * scale + padding
    y0, y1 = extent["top"] * scale - padding, extent["bottom"] * scale + padding
    if degrees is not None:
        a = F.radians(degrees)
        corners = [(x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)) for x in (x0, x1) for y in (y0, y1)]
        x0, x1 = F.least(*[c[0] for c in corners]), F.greatest(*[c[0] for c in corners])
        y0, y1 = F.least(*[c[1] for c in corners]), F.greatest(*[c[1] for c in corners])
    return anchor_x + x0, anchor_y + y0, anchor_x + x1, anchor_y + y1


def line_circles(line: list[tuple[float, float]], at: float, length: float, height: float) -> list[tuple[float, float, float]]:
    """Circles (x, y, r) that cover a label of a length and height along a line, its middle at a distance; none where the
    line is too short."""
    steps = [np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(line, line[1:])]
    ends = np.concatenate([[0.0], np.cumsum(steps)])
    r = height / 2
    if r <= 0 or at - length / 2 < 0 or at + length / 2 > ends[-1]:
        return []
    n = max(1, int(np.ceil(length / height)))
    out = []
    for d in at - length / 2 + (np.arange(n) + 0.5) * length / n:
        k = min(int(np.searchsorted(ends, d, side="right")) - 1, len(steps) - 1)
        t = (d - ends[k]) / steps[k] if steps[k] else 0.0
        (ax, ay), (bx, by) = line[k], line[k + 1]
        out.append((float(ax + (bx - ax) * t), float(ay + (by - ay) * t), r))
    return out


#: Where an anchor lies in a label's box: shares of its width and height.
ALIGNMENTS = {"center": (0.5, 0.5), "left": (0.0, 0.5), "right": (1.0, 0.5), "top": (0.5, 0.0), "bottom": (0.5, 1.0), "top-left": (0.0, 0.0), "top-right": (1.0, 0.0), "bottom-left": (0.0, 1.0), "bottom-right": (1.0, 1.0)}


def variable_anchors(labels: DataFrame, anchors: list[str]) -> DataFrame:
    """Each label once for each place it may take, in order of preference: attempt (from 0), anchor, align_x, align_y. A name that
    is none counts as center."""
    each = F.array(*[F.struct(F.lit(a).alias("anchor"), *[F.lit(v).alias(n) for v, n in zip(ALIGNMENTS.get(a, (0.5, 0.5)), ("align_x", "align_y"))]) for a in anchors])
    return labels.select("*", F.posexplode(each).alias("attempt", "_a")).select(*labels.columns, "attempt", "_a.*")


def fitted_icon(width, height, text: dict, padding: dict, offset: tuple, fit: str = "both", scale=1.0) -> dict:
    """An icon's box around the text it holds, as Columns: stretched to the text's width, height or both with a padding, else
    centered on it in its own size. The icon's anchor takes no part."""
    left, right, top, bottom = (text[k] * scale for k in ("left", "right", "top", "bottom"))
    wide, high = fit in ("width", "both"), fit in ("height", "both")
    x0 = offset[0] + (left - padding["left"] if wide else (left + right - width) / 2)
    y0 = offset[1] + (top - padding["top"] if high else (top + bottom - height) / 2)
    return {"left": x0, "right": offset[0] + right + padding["right"] if wide else x0 + width, "top": y0, "bottom": offset[1] + bottom + padding["bottom"] if high else y0 + height}


def split_lines(text, breaks):
    """A text's lines at breaks (an array of places after which a line ends, ascending), as Columns; none is empty."""
    ends = F.concat(F.transform(breaks, lambda b: b.cast("int")), F.array(F.length(text)))
    starts_ = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    lines = F.zip_with(starts_, ends, lambda a, b: F.when(b > a, F.substring(text, a + 1, b - a)))
    return F.filter(lines, lambda s: s.isNotNull())


def passes(color, halo_color, halo_width) -> tuple:
    """(whether a label's halo is drawn, whether its fill is), from values that are constant, or None where they vary by
    feature: those always count as drawn."""
    from ..lang.color import parse

    def opaque(c) -> bool:
        return c is None or (parse(c) or (0, 0, 0, 0))[3] > 0

    return opaque(halo_color) and (halo_width is None or halo_width != 0), opaque(color)


def projected_circles(circles, scale, x, y):
    """Circles (x, y, r) of a tile on the screen, as a Column: scaled around the tile's corner, which lies at (x, y)."""
    return F.transform(circles, lambda c: F.struct((x + c["x"] * scale).alias("x"), (y + c["y"] * scale).alias("y"), (c["r"] * scale).alias("r")))


def covered(wanted, asked):
    """Whether all ranges of an array are in another one, as a Column."""
    return F.size(F.array_except(wanted, asked)) == 0


def shaped(advances, line_of, line_height: float, justify: float = 0.5):
    """Where the glyphs of a text stand, as a Column of arrays of (line, x, y): advances and the number of each glyph's line, from
    0; lines are justified around the anchor (0 left, 0.5 middle, 1 right), their middle at its height."""
    lines = F.array_max(line_of) + 1
    each = F.arrays_zip(advances.alias("a"), line_of.alias("l"))
    widths = F.transform(F.sequence(F.lit(0), lines - 1), lambda i: F.aggregate(F.filter(each, lambda g: g["l"] == i), F.lit(0.0), lambda s, g: s + g["a"]))

    def step(state, g):
        x = F.when(g["l"] == state["l"], state["x"]).otherwise(-justify * F.get(widths, g["l"]))
        at = F.struct(g["l"].alias("line"), x.alias("x"), ((g["l"] - (lines - 1) / 2) * line_height).alias("y"))
        return F.struct(g["l"].alias("l"), (x + g["a"]).alias("x"), F.concat(state["found"], F.array(at)).alias("found"))

    start = F.struct(F.lit(-1).alias("l"), F.lit(0.0).alias("x"), F.array().cast("array<struct<line:int,x:double,y:double>>").alias("found"))
    return F.aggregate(each, start, step, lambda s: s["found"])


def along(line, distances):
    """The places (x, y, angle) at distances along a line, as a Column of arrays; null beyond its ends."""
    n = F.size(line)
    pairs = F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"), F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("l")))

    def place(d):
        def step(s, e):
            here = s["x"].isNull() & (d >= s["at"]) & (d <= s["at"] + e["l"]) & (e["l"] > 0)
            t = (d - s["at"]) / F.when(e["l"] > 0, e["l"])
            pick = lambda a, b: F.when(here, a).otherwise(b)
            return F.struct((s["at"] + e["l"]).alias("at"), pick(e["px"] + e["dx"] * t, s["x"]).alias("x"), pick(e["py"] + e["dy"] * t, s["y"]).alias("y"), pick(F.atan2(e["dy"], e["dx"]), s["angle"]).alias("angle"))

        none = F.lit(None).cast("double")
        start = F.struct(F.lit(0.0).alias("at"), none.alias("x"), none.alias("y"), none.alias("angle"))
        return F.aggregate(pairs, start, step, lambda s: F.when(s["x"].isNotNull(), F.struct(s["x"], s["y"], s["angle"])))

    return F.transform(distances, place)


def candidates(features: DataFrame, text, icon) -> DataFrame:
    """Features with what a symbol layer draws of them, text and icon as Columns: those that have neither are left out, and an
    empty text is none."""
    t, i = F.when(F.length(text) > 0, text), F.when(F.length(icon) > 0, icon)
    return features.withColumns({"text": t, "icon": i}).where("text is not null or icon is not null")
