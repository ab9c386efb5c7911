"""Image sheets and glyph ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .protobuf import WireError, fields, zigzag

#: The largest side of a sprite, and the greatest pixel ratio.
MOST_SIDE, MOST_RATIO = 1024, 10.0


def sprites(docs: DataFrame, sheet_width: int | None = None, sheet_height: int | None = None) -> DataFrame:
    """Index documents (doc: JSON text) as rows name, x, y, width, height, pixel_ratio, sdf. Entries without a size, of a
    size or ratio beyond the limits, or that don't lie on the sheet are left out."""
    e = docs.select(F.explode(F.from_json("doc", "map<string,struct<x:int,y:int,width:int,height:int,pixelRatio:double,sdf:boolean>>")).alias("name", "s"))
    r = e.select("name", F.coalesce("s.x", F.lit(0)).alias("x"), F.coalesce("s.y", F.lit(0)).alias("y"), F.coalesce("s.width", F.lit(0)).alias("width"), F.coalesce("s.height", F.lit(0)).alias("height"), F.coalesce("s.pixelRatio", F.lit(1.0)).alias("pixel_ratio"), F.coalesce("s.sdf", F.lit(False)).alias("sdf"))
    ok = F.col("width").between(1, MOST_SIDE) & F.col("height").between(1, MOST_SIDE) & (F.col("pixel_ratio") > 0) & (F.col("pixel_ratio") <= MOST_RATIO) & (F.col("x") >= 0) & (F.col("y") >= 0)
    if sheet_width is not None and sheet_height is not None:
        ok = ok & (F.col("x") + F.col("width") <= sheet_width) & (F.col("y") + F.col("height") <= sheet_height)
    return r.where(ok)


def sheet_urls(base: str, ratio: float) -> tuple[str, str]:
    """The index's and the image's url; a query string stays at the end."""
    path, mark, query = base.partition("?")
    path += "@2x" if ratio > 1 else ""
    return f"{path}.json{mark}{query}", f"{path}.png{mark}{query}"


GLYPHS = "stack string, range string, id int, width int, height int, left int, top int, advance int, bitmap binary"


def glyphs(files: DataFrame) -> DataFrame:
    """files (data) of glyph ranges as a row a glyph. A file that breaks the format raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [g for data in batch.column(0).to_pylist() for g in decode_glyphs(data or b"")]
            columns = [pa.array([g[i] for g in rows], t) for i, t in enumerate((pa.string(), pa.string(), *[pa.int32()] * 6, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in GLYPHS.split(", ")])

    return files.select("data").mapInArrow(run, GLYPHS)


def decode_glyphs(data: bytes) -> list[tuple]:
    out = []
    for n, k, stack in fields(data):
        if n != 1 or k != 2:
            continue
        name = span = ""
        raw = []
        for m, kind, v in fields(stack):
            if m == 1 and kind == 2:
                name = v.decode()
            elif m == 2 and kind == 2:
                span = v.decode()
            elif m == 3 and kind == 2:
                raw.append(v)
        for g in raw:
            f = {m: v for m, kind, v in fields(g)}
            width, height, bitmap = f.get(3, 0), f.get(4, 0), f.get(2)
            # three pixels of border on each side
            if width and height and bitmap is not None and len(bitmap) != (width + 6) * (height + 6):
                raise WireError("a glyph's bitmap has the wrong size")
            out.append((name, span, f.get(1, 0), width, height, zigzag(f.get(5, 0)), zigzag(f.get(6, 0)), f.get(7, 0), bitmap))
    return out
