"""Token ids in seekable files.

A file holds independent zstandard frames of ids (little-endian unsigned 32-bit), each with the whole ids of one or
more documents; then a skippable frame with the directory (which documents have an id, their ids, and their numbers of
token ids); then the
seek table of the seekable zstandard format: a skippable frame with each frame's compressed and plain size and the
low half of its XXH64 checksum, closed by a footer. A reader takes the footer, the seek table and the directory, then
decompresses and verifies the frames of the documents it is asked for, and no others.

A table is dealt by ranges of doc_id, so that the files of its partitions, in order, hold it in ascending order: null
ids first, equal ids by a hash of their text. A task writes its file under a name of its own and renames it, so a
task that runs again leaves the same file. Null text is empty; each document has its end id at least.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ENCODER_BYTES, encoder, scratch_dir, slices, table, text_or_empty
from .packing import END_ID, vocabulary

#: Fixed values of the seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: A skippable frame of our own, for the directory.
DIRECTORY_MAGIC = 0x184D2A50
CHECKSUM_FLAG = 0x80
FRAME_BYTES = 1 << 18


class Writer:
    """Writes documents' ids to a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.frame_bytes = out, frame_bytes
        self.z = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._frame()
        self.held.append(ids)
        self.size += len(ids)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)

    def _frame(self) -> None:
        plain = b"".join(self.held)
        packed = self.z.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._frame()
        known = [i is not None for i in self.ids]
        directory = self.z.compress(np.array([known, [i or 0 for i in self.ids], self.counts], "<i8").tobytes())
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
        entries = [(8 + len(directory), 0, xxhash.xxh64_intdigest(directory) & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *f) for f in [*self.frames, *entries])
        footer = struct.pack("<IBI", len(self.frames) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(body) + len(footer)) + body + footer)


class Reader:
    """Reads chosen documents from a seekable file; anything that doesn't hold raises ValueError."""

    def __init__(self, source):
        self.source, self.z = source, zstandard.ZstdDecompressor()
        end = source.seek(0, io.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table_at = end - 9 - 12 * n - 8
        head, size = struct.unpack("<II", self._at(table_at, 8))
        if head != SEEK_TABLE_MAGIC or size != 12 * n + 9:
            raise ValueError("broken seek table")
        e = np.frombuffer(self._at(table_at + 8, 12 * n), "<u4").reshape(n, 3)
        self.packed, self.plain, self.sums = e[:-1, 0].astype(np.int64), e[:-1, 1].astype(np.int64), e[:, 2]
        self.frame_at = np.concatenate([[0], np.cumsum(self.packed)])
        if int(self.frame_at[-1]) + int(e[-1, 0]) != table_at:
            raise ValueError("sizes don't add up")
        raw = self._at(int(self.frame_at[-1]), int(e[-1, 0]))
        if struct.unpack("<II", raw[:8]) != (DIRECTORY_MAGIC, len(raw) - 8) or xxhash.xxh64_intdigest(raw[8:]) & 0xFFFFFFFF != self.sums[-1]:
            raise ValueError("broken directory")
        self.known, self.doc_ids, self.counts = np.frombuffer(self.z.decompress(raw[8:]), "<i8").reshape(3, -1)
        self.start = np.concatenate([[0], np.cumsum(self.counts)])
        self.frame_start = np.concatenate([[0], np.cumsum(self.plain)]) // 4
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        if at < 0:
            raise ValueError("too short")
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def doc_id(self, i: int) -> int | None:
        return int(self.doc_ids[i]) if self.known[i] else None

    def ids(self, i: int) -> memoryview:
        """The bytes of the i-th document's ids."""
        f = int(np.searchsorted(self.frame_start, self.start[i], side="right")) - 1
        if self._last[0] != f:
            plain = self.z.decompress(self._at(int(self.frame_at[f]), int(self.packed[f])), max_output_size=int(self.plain[f]))
            if len(plain) != self.plain[f] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[f]:
                raise ValueError(f"frame {f} doesn't match its checksum")
            self._last, self.frames_read = (f, plain), self.frames_read + 1
        at = int(self.start[i] - self.frame_start[f]) * 4
        return memoryview(self._last[1])[at : at + int(self.counts[i]) * 4]

    def find(self, doc_id: int | None) -> list[int]:
        """Places of a document, by its id."""
        return np.flatnonzero(self.known == 0 if doc_id is None else (self.known == 1) & (self.doc_ids == doc_id)).tolist()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, folder: str, path: str, keep_spaces: bool, end_id: int = END_ID, memory: int = ENCODER_BYTES) -> list[tuple]:
    """Encodes docs (doc_id, text) and writes them to files in the folder, a URI that all executors reach. Returns a
    row a file: part, file, n_docs, n_tokens, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, e = TaskContext.get(), encoder(path, keep_spaces, memory)
        part = context.partitionId()
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{part:06d}.ids.zst"
        own = f"{root}/.{name}.{context.taskAttemptId()}"
        with system.open_output_stream(own) as out:
            w = Writer(out)
            for batch in batches:
                for s in slices(batch, 1):
                    ids, off = e.encode(s.column(1).to_pylist(), end_id)
                    data = memoryview(ids.astype("<u4")).cast("B")
                    for k, doc_id in enumerate(s.column(0).to_pylist()):
                        w.add(doc_id, bytes(data[off[k] * 4 : off[k + 1] * 4]))
            w.close()
        system.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(w.ids)], pa.int64()), pa.array([sum(w.counts)], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.rand(13)})
    dealt = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "k1", "k2").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "k1", "k2")
    # a row a partition comes to the driver
    return sorted(tuple(r) for r in dealt.select("doc_id", "text").mapInArrow(run, "part int, file string, n_docs long, n_tokens long").collect())


def read_files(spark: SparkSession, files: list[tuple], with_ids: bool = True) -> DataFrame:
    """The documents of files that write_files() wrote: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, p = _file_system(r["file"])
                with system.open_input_file(p) as source:
                    f = Reader(source)
                    for a in range(0, len(f), 500):
                        rows = range(a, min(a + 500, len(f)))
                        ids = [f.ids(i) for i in rows]
                        columns = [pa.array([f.doc_id(i) for i in rows], pa.int64()), pa.array(r["at"] + f.start[rows.start : rows.stop], pa.int64()), pa.array(f.counts[rows.start : rows.stop], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([bytes(x) for x in ids], pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    at, rows = 0, []
    for part, file, _, n in files:
        rows.append((part, file, at))
        at += n
    if not rows:
        return spark.createDataFrame([], schema)
    manifest = spark.createDataFrame(rows, "part int, file string, at long").repartition(len(rows), "part")
    return manifest.mapInArrow(run, schema)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = write_files(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), keep_spaces=False)
    return read_files(spark, files, with_ids=False)
