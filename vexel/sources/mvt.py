"""Vector tiles: bytes to canonical feature rows, and back."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spatial.geometry import parts, polygons
from .protobuf import WireError, fields, packed, put, put_packed, zigzag

KINDS = {0: "Unknown", 1: "Point", 2: "LineString", 3: "Polygon"}
#: The format's default extent, and its command numbers.
EXTENT = 4096
MOVE, LINE, CLOSE = 1, 2, 7
_LIMIT = 2**31
#: Features that a worker turns into rows, or rows into features, at once.
FEATURE_ROWS = 2048


class TileError(ValueError):
    pass


def decode(data: bytes) -> list[dict]:
    """A tile's layers: name, version, extent, features (id, type, geom as rings or parts, props). What breaks the format
    raises TileError."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    try:
        layers = [_layer(v) for n, k, v in fields(data) if n == 3 and k == 2]
    except (WireError, UnicodeDecodeError, struct.error) as e:
        raise TileError(str(e)) from e
    names = [x["name"] for x in layers]
    if len(set(names)) < len(names):
        raise TileError("two layers of one name")
    return layers


def _layer(data: bytes) -> dict:
    name, version, extent = None, 1, EXTENT
    keys: list[str] = []
    values: list = []
    raw: list[bytes] = []
    # tables may follow the features that use them
    for n, k, v in fields(data):
        if n == 1 and k == 2:
            name = v.decode()
        elif n == 2 and k == 2:
            raw.append(v)
        elif n == 3 and k == 2:
            keys.append(v.decode())
        elif n == 4 and k == 2:
            values.append(_value(v))
        elif n == 5 and k == 0:
            extent = v
        elif n == 15 and k == 0:
            version = v
    if not name:
        raise TileError("a layer has no name")
    if version not in (1, 2):
        raise TileError(f"version {version}")
    return {"name": name, "version": version, "extent": extent, "features": [_feature(f, keys, values) for f in raw]}


def _value(data: bytes):
    found = []
    for n, k, v in fields(data):
        if n == 1 and k == 2:
            found.append(v.decode())
        elif n == 2 and k == 5:
            found.append(float(struct.unpack("<f", v)[0]))
        elif n == 3 and k == 1:
            found.append(struct.unpack("<d", v)[0])
        elif n == 4 and k == 0:
            found.append(float(v - (1 << 64) if v >> 63 else v))
        elif n == 5 and k == 0:
            found.append(float(v))
        elif n == 6 and k == 0:
            found.append(float(zigzag(v)))
        elif n == 7 and k == 0:
            found.append(bool(v))
    if len(found) != 1:
        raise TileError("a value must be of exactly one type")
    return found[0]


def _feature(data: bytes, keys: list[str], values: list) -> dict:
    fid, kind, tags, geometry = None, 0, [], None
    for n, k, v in fields(data):
        if n == 1 and k == 0:
            fid = v
        elif n == 2:
            tags += packed(v) if k == 2 else [v]
        elif n == 3 and k == 0:
            kind = v
        elif n == 4:
            if geometry is not None:
                raise TileError("two geometries")
            geometry = packed(v) if k == 2 else [v]
    if len(tags) % 2:
        raise TileError("odd number of tags")
    if any(t >= len(keys) for t in tags[::2]) or any(t >= len(values) for t in tags[1::2]):
        raise TileError("a tag is out of range")
    props = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}
    return {"id": fid, "type": KINDS.get(kind, "Unknown"), "geom": _geometry(geometry or [], kind), "props": props}


def _geometry(commands: list[int], kind: int) -> list[list[tuple[int, int]]]:
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        op, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if op == CLOSE:
            if kind != 3 or not parts or count != 1:
                raise TileError("misplaced close")
            parts[-1].append(parts[-1][0])
            continue
        if op not in (MOVE, LINE):
            raise TileError(f"command {op}")
        if at + 2 * count > len(commands):
            raise TileError("truncated geometry")
        for _ in range(count):
            x, y = x + zigzag(commands[at]), y + zigzag(commands[at + 1])
            at += 2
            if not (-_LIMIT <= x < _LIMIT and -_LIMIT <= y < _LIMIT):
                raise TileError("position out of range")
            if op == MOVE:
                parts.append([(x, y)])
            elif not parts:
                raise TileError("line before move")
            else:
                parts[-1].append((x, y))
    return parts


def encode(layers: list[dict]) -> bytes:
    """The inverse of decode()."""
    return b"".join(_encoded(x["name"], x["features"], x.get("version", 2), x.get("extent", EXTENT)) for x in layers)


def _encoded(name: str, features: Iterable[dict], version: int = 2, extent: int = EXTENT) -> bytes:
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    out = [put(15, version), put(1, name)]
    for f in features:
        tags = [i for k, v in f["props"].items() for i in (keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values)))]
        body = (put(1, f["id"]) if f.get("id") is not None else b"") + put_packed(2, tags)
        kind = next(n for n, name in KINDS.items() if name == f["type"])
        out.append(put(2, body + put(3, kind) + put_packed(4, _commands(f["geom"], kind))))
    out += [put(3, k) for k in keys]
    for t, v in values:
        out.append(put(4, put(1, v) if t is str else put(7, int(v)) if t is bool else put(3, float(v))))
    return put(3, b"".join([*out, put(5, extent)]))


def _commands(parts, kind: int) -> list[int]:
    out: list[int] = []
    x = y = 0
    for part in parts:
        points = part[:-1] if kind == 3 and len(part) > 1 and part[0] == part[-1] else part
        for i, (px, py) in enumerate(points):
            if i < 2:
                out.append((MOVE if i == 0 else LINE) | (1 if i == 0 else len(points) - 1) << 3)
            out += [(d << 1) ^ (d >> 63) for d in (int(px) - x, int(py) - y)]
            x, y = int(px), int(py)
        if kind == 3:
            out.append(CLOSE | 1 << 3)
    return out


FEATURES = "z int, x int, y int, source_layer string, extent int, feature_index long, id long, geom_type string, geom array<array<array<struct<x:double,y:double>>>>, props_json string, error string"


def features(tiles: DataFrame, on_error: str = "fail") -> DataFrame:
    """tiles (z, x, y, data) as canonical rows with props as VARIANT. on_error: fail, drop or keep (a row with error). A worker
    holds one decoded tile at a time."""

    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), None, pa.string(), pa.string())

    def written(rows: list[tuple]) -> pa.RecordBatch:
        columns = [parts(c) if kind is None else pa.array(c, kind) for c, kind in zip(map(list, zip(*rows)), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(batch.num_rows):
            *where, data = (c[i].as_py() for c in batch.columns)
            try:
                layers = decode(data or b"")
            except TileError as e:
                if on_error == "fail":
                    raise
                yield *where, *[None] * 7, str(e)
                continue
            for layer in layers:
                for n, f in enumerate(layer["features"]):
                    fid = f["id"] if f["id"] is None or f["id"] < 1 << 63 else f["id"] - (1 << 64)
                    yield *where, layer["name"], layer["extent"], n, fid, f["type"], [f["geom"]], json.dumps(f["props"]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = found(batch)
            while some := list(islice(rows, FEATURE_ROWS)):
                yield written(some)

    rows = tiles.select("z", "x", "y", "data").mapInArrow(run, FEATURES)
    rows = rows.withColumn("props", F.parse_json("props_json")).drop("props_json")
    if on_error == "keep":
        return rows
    return rows.where("error is null").drop("error")


def read(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Tiles under a path that ends in z/x/y.mvt or .pbf."""
    pattern = r"(\d+)/(\d+)/(\d+)\.[a-z.]+$"
    part = lambda i: F.regexp_extract("path", pattern, i).cast("int")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return features(files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), F.col("content").alias("data")), on_error)


def build(rows: DataFrame) -> DataFrame:
    """Canonical rows (z, x, y, source_layer, feature_index, id, geom_type, geom, props_json) to tiles (z, x, y, data): a
    tile's features are gathered in one task, as the format holds them together."""

    def features(part: pa.Table) -> Iterator[dict]:
        for at in range(0, part.num_rows, FEATURE_ROWS):
            some = part.slice(at, FEATURE_ROWS).combine_chunks()
            column = lambda c: some.column(c).combine_chunks()  # noqa: E731, B023
            for fid, kind, geom, props in zip(column("id").to_pylist(), column("geom_type").to_pylist(), polygons(column("geom")), column("props_json").to_pylist()):
                yield {"id": fid, "type": kind, "geom": [ring for part in geom for ring in part], "props": json.loads(props)}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("source_layer", "ascending"), ("feature_index", "ascending")])
        runs = pc.run_end_encode(table.column("source_layer").combine_chunks())
        bounds = [0, *runs.run_ends.to_pylist()]
        data = b"".join(_encoded(name, features(table.slice(a, b - a))) for name, a, b in zip(runs.values.to_pylist(), bounds, bounds[1:]))
        own = [[table.column(c)[0].as_py()] for c in ("z", "x", "y")] + [[data]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(own, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["z", "x", "y", "data"])

    return rows.groupBy("z", "x", "y").applyInArrow(run, "z int, x int, y int, data binary")
