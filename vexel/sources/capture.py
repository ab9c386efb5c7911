"""Captures: a log of records in one file, with the slabs that they refer to."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import in_ranges

#: Fixed values of the format: magic and version; the bytes of the head, of a record's head, of a slab's entry.
MAGIC = b"TSLCAP01"
HEAD, PER_RECORD, PER_SLAB = 32, 16, 16
#: Records that a worker turns into rows at once.
RECORD_ROWS = 4096


class CaptureError(ValueError):
    pass


def encode(records: list[tuple[int, bytes, bytes]], slabs: list[tuple[int, int]] = (), region: bytes = b"") -> bytes:
    """Records (kind, record, payload) in order, slabs (offset, length) and the region they lie in. All numbers are
    little-endian: the head has the counts of records and slabs and the sizes of the records' part and the region."""
    body = b"".join(struct.pack("<4I", kind, len(r), len(p), 0) + r + p for kind, r, p in records)
    head = MAGIC + struct.pack("<IIQQ", len(records), len(slabs), len(body), len(region))
    return head + body + b"".join(struct.pack("<QQ", *s) for s in slabs) + region


def _records(data: bytes, count: int, end: int) -> Iterator[tuple[int, bytes, bytes]]:
    at = HEAD
    while count and at + PER_RECORD <= end:
        kind, r, p, _ = struct.unpack("<4I", data[at : at + PER_RECORD])
        at += PER_RECORD
        if at + r + p > end:
            break
        yield kind, data[at : at + r], data[at + r : at + r + p]
        at, count = at + r + p, count - 1


def _checked(data: bytes) -> tuple[int, int, int, int]:
    """The head's numbers: records, slabs, and the sizes of the records' part and the region."""
    if len(data) < HEAD or data[:8] != MAGIC:
        raise CaptureError("not a capture of this version")
    head = struct.unpack("<IIQQ", data[8:HEAD])
    if HEAD + head[2] + head[1] * PER_SLAB + head[3] != len(data):
        raise CaptureError("sizes don't add up")
    return head


def decode(data: bytes) -> tuple[list[tuple[int, bytes, bytes]], list[tuple[int, int]], bytes]:
    """The inverse of encode(). Records end at the first one that doesn't fit, as its lengths are what finds the next."""
    count, n_slabs, size, region = _checked(data)
    end = HEAD + size
    records = list(_records(data, count, end))
    slabs = [struct.unpack("<QQ", data[end + i * PER_SLAB : end + (i + 1) * PER_SLAB]) for i in range(n_slabs)]
    return records, slabs, data[len(data) - region :]


def read(files: DataFrame) -> DataFrame:
    """files (name, data) as a row a record: name, seq (from 0), kind, record, payload. A file that is no capture raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = (c[i].as_py() for c in batch.columns)
                count, _, size, _ = _checked(data)
                records, seq = _records(data, count, HEAD + size), 0
                while some := list(islice(records, RECORD_ROWS)):
                    columns = [[name] * len(some), range(seq, seq + len(some)), *([x[i] for x in some] for i in range(3))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["name", "seq", "kind", "record", "payload"])
                    seq += len(some)

    return files.select("name", "data").mapInArrow(run, "name string, seq long, kind long, record binary, payload binary")


def _little(n: Column, size: int) -> Column:
    """A whole number in little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)]))


def write(records: DataFrame) -> DataFrame:
    """Rows (name, seq, kind, record, payload) to captures (name, data): ranges of a log are joined to pieces, and these to the
    one file that it is. DataFrame operations only."""
    r, p = (F.coalesce(c, F.lit(b"")) for c in ("record", "payload"))
    kind = F.when(F.col("kind").between(0, 0xFFFFFFFF), F.col("kind")).otherwise(F.raise_error(F.lit("a record's kind is no 32-bit number")))
    one = F.concat(*[_little(n, 4) for n in (kind, F.octet_length(r), F.octet_length(p), F.lit(0))], r, p)
    dealt = in_ranges(records.select("name", "seq", one.alias("one")), F.col("name"), F.col("seq"))
    pieces = dealt.groupBy("name", "_part").agg(F.expr("listagg(one) WITHIN GROUP (ORDER BY seq)").alias("piece"), F.count("*").alias("n"))
    logs = pieces.groupBy("name").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY _part)").alias("body"), F.sum("n").alias("n"))
    head = F.concat(F.lit(MAGIC), _little(F.col("n"), 4), _little(F.lit(0), 4), _little(F.octet_length("body"), 8), _little(F.lit(0), 8))
    return logs.select("name", F.concat(head, "body").alias("data"))
