"""Tile archives of format PMTiles 3, as a data source: format "vexel_pmtiles" with options minz and maxz."""

from __future__ import annotations

import gzip
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .protobuf import put_varint, varint

#: Fixed values of the format: header size, and how many directories may nest.
HEADER, MOST_DEPTH = 127, 4
NONE, GZIP = 1, 2


class ArchiveError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    root: tuple[int, int]
    metadata: tuple[int, int]
    leaves: tuple[int, int]
    tiles: tuple[int, int]
    internal: int
    compression: int
    kind: int
    min_zoom: int
    max_zoom: int
    bounds: tuple[float, float, float, float]

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < HEADER or data[:7] != b"PMTiles" or data[7] != 3:
            raise ArchiveError("not a PMTiles 3 archive")
        n = struct.unpack("<8Q", data[8:72])
        box = tuple(v / 1e7 for v in struct.unpack("<4i", data[102:118]))
        return cls(n[0:2], n[2:4], n[4:6], n[6:8], data[97], data[98], data[99], data[100], data[101], box)

    def bytes(self) -> bytes:
        body = struct.pack("<8Q", *self.root, *self.metadata, *self.leaves, *self.tiles)
        return b"PMTiles\x03" + body + struct.pack("<3Q", 0, 0, 0) + bytes([1, self.internal, self.compression, self.kind, self.min_zoom, self.max_zoom]) + struct.pack("<4i", *[round(v * 1e7) for v in self.bounds]) + bytes(9)


def plain(data: bytes, compression: int) -> bytes:
    if compression in (0, NONE):
        return data
    if compression == GZIP:
        try:
            return gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            raise ArchiveError(str(e)) from e
    raise ArchiveError(f"compression {compression}")


@dataclass(frozen=True)
class Entry:
    """run 0 is a leaf directory."""

    tile_id: int
    offset: int
    length: int
    run: int


def directory(data: bytes) -> list[Entry]:
    n, at = varint(data, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(data, at)
            column.append(v)
        columns.append(column)
    out, tile, end = [], 0, 0
    for i, (step, run, length, offset) in enumerate(zip(*columns)):
        tile += step
        if offset == 0 and i == 0:
            raise ArchiveError("the first entry has no offset")
        # 0: right after the entry before
        start = end if offset == 0 else offset - 1
        out.append(Entry(tile, start, length, run))
        end = start + length
    return out


def put_directory(entries: list[Entry]) -> bytes:
    out, last = put_varint(len(entries)), 0
    steps = []
    for e in entries:
        steps.append(e.tile_id - last)
        last = e.tile_id
    for column in (steps, [e.run for e in entries], [e.length for e in entries], [e.offset + 1 for e in entries]):
        out += b"".join(map(put_varint, column))
    return out


def find(entries: list[Entry], tile_id: int) -> Entry | None:
    """The entry whose run holds a tile, or the leaf that may."""
    i = bisect_right([e.tile_id for e in entries], tile_id) - 1
    if i >= 0 and (entries[i].run == 0 or tile_id < entries[i].tile_id + entries[i].run):
        return entries[i]
    return None


def tile_number(z: int, x: int, y: int) -> int | None:
    """Place along a Hilbert curve, after all lower zooms."""
    if not (0 <= z <= 31 and 0 <= x < 1 << z and 0 <= y < 1 << z):
        return None
    d = 0
    for k in reversed(range(z)):
        s = 1 << k
        rx, ry = x >> k & 1, y >> k & 1
        d += s * s * (3 * rx ^ ry)
        x, y = x & s - 1, y & s - 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
    return ((1 << 2 * z) - 1) // 3 + d


def tile_at(number: int) -> tuple[int, int, int]:
    z, base = 0, 0
    while number >= base + (1 << 2 * z):
        base += 1 << 2 * z
        z += 1
    d, x, y = number - base, 0, 0
    for k in range(z):
        s = 1 << k
        q = d >> 2 * k & 3
        rx, ry = q >> 1, (q ^ q >> 1) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
    return z, x, y


class Archive:
    """Reads ranges of a file-like source."""

    def __init__(self, source):
        self.source = source
        self.header = Header.parse(self._at(0, HEADER))

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(length)
        if len(data) < length:
            raise ArchiveError("the archive is too short")
        return data

    def _directory(self, offset: int, length: int) -> list[Entry]:
        return directory(plain(self._at(offset, length), self.header.internal))

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        number = tile_number(z, x, y)
        at, depth = self.header.root, 0
        while number is not None and depth < MOST_DEPTH:
            e = find(self._directory(*at), number)
            if e is None:
                return None
            if e.run:
                return plain(self._at(self.header.tiles[0] + e.offset, e.length), self.header.compression)
            at, depth = (self.header.leaves[0] + e.offset, e.length), depth + 1
        return None

    def entries(self, low: int = 0, high: int = 1 << 63) -> Iterator[Entry]:
        """Tile entries that meet a range of numbers, in order; leaves out of the range aren't read."""
        stack = [(self.header.root, 0)]
        while stack:
            at, depth = stack.pop()
            own = self._directory(*at)
            deeper = []
            for e, then in zip(own, [*own[1:], None]):
                if e.run == 0:
                    if depth < MOST_DEPTH and e.tile_id < high and (then is None or then.tile_id > low):
                        deeper.append(((self.header.leaves[0] + e.offset, e.length), depth + 1))
                elif e.tile_id < high and e.tile_id + e.run > low:
                    yield e
            stack += reversed(deeper)


def build(tiles: dict[tuple[int, int, int], bytes], bounds=(-180.0, -85.0, 180.0, 85.0), compression: int = GZIP, leaf_size: int | None = None) -> bytes:
    """An archive of tiles; equal neighbors share one entry."""
    entries: list[Entry] = []
    body = b""
    for number, data in sorted((tile_number(*k), v) for k, v in tiles.items()):
        data = gzip.compress(data, mtime=0) if compression == GZIP else data
        if entries and entries[-1].tile_id + entries[-1].run == number and body[entries[-1].offset :] == data:
            last = entries.pop()
            entries.append(Entry(last.tile_id, last.offset, last.length, last.run + 1))
            continue
        entries.append(Entry(number, len(body), len(data), 1))
        body += data
    leaves = b""
    if leaf_size:
        top = []
        for i in range(0, len(entries), leaf_size):
            leaf = gzip.compress(put_directory(entries[i : i + leaf_size]), mtime=0)
            top.append(Entry(entries[i].tile_id, len(leaves), len(leaf), 0))
            leaves += leaf
        entries = top
    root, meta = gzip.compress(put_directory(entries), mtime=0), gzip.compress(b"{}", mtime=0)
    zooms = [z for z, _, _ in tiles] or [0]
    a = HEADER
    b, c = a + len(root), a + len(root) + len(meta)
    h = Header((a, len(root)), (b, len(meta)), (c, len(leaves)), (c + len(leaves), len(body)), GZIP, compression, 1, min(zooms), max(zooms), bounds)
    return h.bytes() + root + meta + leaves + body


def box_numbers(z: int, x0: int, y0: int, x1: int, y1: int, most: int) -> list[tuple[int, int]]:
    """Ranges of the numbers of a zoom's tiles that hold all of a box, about `most` of them: squares of the curve are parted
    while they are few and lie across the box's edge; a square's tiles follow one another."""
    found, squares = [], [(0, 0, z)]
    while squares:
        inside, edge = [], []
        for x, y, k in squares:
            a, b, c, d = x << k, y << k, ((x + 1) << k) - 1, ((y + 1) << k) - 1
            if a > x1 or c < x0 or b > y1 or d < y0:
                continue
            (inside if k == 0 or (x0 <= a and c <= x1 and y0 <= b and d <= y1) else edge).append((x, y, k))
        found += inside
        if len(found) + 4 * len(edge) > 4 * most:
            found += edge
            break
        squares = [(2 * x + i, 2 * y + j, k - 1) for x, y, k in edge for i in (0, 1) for j in (0, 1)]
    base, ranges = ((1 << 2 * z) - 1) // 3, []
    for x, y, k in found:
        first = base + (((tile_number(z, x << k, y << k) - base) >> 2 * k) << 2 * k)
        ranges.append((first, first + (1 << 2 * k)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and merged[-1][1] == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    """Reads the tiles of a range of zooms; x and y leave the ranges of the curve that meet their box. The bounds are
    options: filters that Spark 4.1 pushes into a Python reader are shared by all scans of one relation, so that in a union
    of two differently filtered scans both would read the last one's tiles."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.low, self.high = int(options.get("minz", 0)), int(options.get("maxz", 31))
        self.parts = int(options.get("partitions", 8))
        self.box = {c: (int(options.get(f"min{c}", 0)), int(options.get(f"max{c}", 1 << 31))) for c in "xy"}

    def _open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system.open_input_file(path)

    def partitions(self) -> list[_Range]:
        """Ranges of tile numbers of the zooms asked for that the archive holds."""
        with self._open() as source:
            h = Archive(source).header
        low, high = max(self.low, h.min_zoom), min(self.high, h.max_zoom)
        if low > high:
            return [_Range(0, 0)]
        (x0, x1), (y0, y1) = self.box["x"], self.box["y"]
        if x0 > 0 or y0 > 0 or min(x1, y1) < 1 << 31:
            ranges = [r for z in range(low, high + 1) for r in box_numbers(z, x0, y0, x1, y1, self.parts)]
            return [_Range(*r) for r in ranges] or [_Range(0, 0)]
        a, b = ((1 << 2 * low) - 1) // 3, ((1 << 2 * (high + 1)) - 1) // 3
        cuts = [a + (b - a) * i // self.parts for i in range(self.parts + 1)]
        return [_Range(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]

    def read(self, partition: _Range):
        with self._open() as source:
            archive = Archive(source)
            for e in archive.entries(partition.low, partition.high):
                data = plain(archive._at(archive.header.tiles[0] + e.offset, e.length), archive.header.compression)
                for number in range(max(e.tile_id, partition.low), min(e.tile_id + e.run, partition.high)):
                    z, x, y = tile_at(number)
                    if self.box["x"][0] <= x <= self.box["x"][1] and self.box["y"][0] <= y <= self.box["y"][1]:
                        yield z, x, y, data


class PMTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vexel_pmtiles"

    def schema(self) -> str:
        return "z int, x int, y int, data binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PMTiles)


def scan(spark: SparkSession, path: str, z: tuple[int, int] = (0, 31), x: tuple[int, int] | None = None, y: tuple[int, int] | None = None) -> DataFrame:
    """An archive's tiles of a range of zooms, and of columns and rows if they are given; bounds included."""
    register(spark)
    r = spark.read.format(PMTiles.name()).option("path", path).option("minz", z[0]).option("maxz", z[1])
    for c, own in (("x", x), ("y", y)):
        if own is not None:
            r = r.option(f"min{c}", own[0]).option(f"max{c}", own[1])
    return r.load()
