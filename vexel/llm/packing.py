"""Packing documents into sequences of fixed length: concatenate and cut.

Pass one encodes each partition's documents, ends each with an end id, and writes the ids with each document's place
among its partition's ids. The sums of the partitions' ids, one row a partition, give each partition's place among
all ids. Pass two cuts all ids at multiples of the sequence length: a document's pieces follow from its place alone.
A sequence that several documents share, also across partitions, is put together from its pieces, of which
it holds as many as it has ids at most. Only the last sequence can be short.

Nulls and the like: a null text is empty and consists of its end id; null ids, repeated rows and empty texts are
documents as any other; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ENCODER_BYTES, encoder, slices, spread, table, text_or_empty, written

SEQUENCE = 2048
END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, keep_spaces: bool, end_id: int = END_ID, memory: int = ENCODER_BYTES) -> DataFrame:
    """docs (doc_id, text) as written rows doc_id, part, part_start, n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, e = TaskContext.get().partitionId(), 0, encoder(path, keep_spaces, memory)
        for batch in batches:
            for s in slices(batch, 1):
                ids, off = e.encode(s.column(1).to_pylist(), end_id)
                sizes = np.diff(off)
                binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                n = pa.array(sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(total + off[:-1], pa.int64()), n, binary], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                total += int(off[-1])

    return written(spread(docs.select("doc_id", text_or_empty().alias("text"))).mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids binary"), "encoded")


def placed(docs: DataFrame) -> DataFrame:
    """Adds start, the place of a document's first id among all ids. The partitions' sums are one row a partition of
    the first pass, whose number the reader sets, so they can be broadcast."""
    sums = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    at = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_at"))
    return docs.join(F.broadcast(at), "part").withColumn("start", F.col("part_at") + F.col("part_start"))


def pieces(docs: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """placed() documents cut into pieces: doc_id, start (the document's ids before it), length, ids, doc_tokens,
    sequence_id, offset (in the sequence)."""
    g, n = F.col("start"), F.col("n_tokens")
    k = F.sequence(F.expr(f"start div {sequence}"), F.expr(f"(start + n_tokens - 1) div {sequence}"))

    def piece(i):
        first, last = F.greatest(g, i * sequence), F.least(g + n, (i + 1) * sequence)
        ids = F.substring(F.col("ids"), ((first - g) * 4 + 1).cast("int"), ((last - first) * 4).cast("int"))
        return F.struct((first - g).alias("start"), (last - first).alias("length"), ids.alias("ids"), i.alias("sequence_id"), (first - i * sequence).alias("offset"))

    return docs.where("n_tokens > 0").select("doc_id", n.alias("doc_tokens"), F.explode(F.transform(k, piece)).alias("p")).select("doc_id", "doc_tokens", "p.*")


def sequences(cut: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """pieces() put together: sequence_id, n_tokens, ids padded to the full length."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    s = cut.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(parts, "").alias("all"))
    pad = int(pad_id).to_bytes(4, "little").hex().upper()
    return s.select("sequence_id", "n_tokens", F.unhex(F.concat("all", F.repeat(F.lit(pad), (sequence - F.col("n_tokens")).cast("int")))).alias("ids"))


def pack(docs: DataFrame, path: str, keep_spaces: bool = True, sequence: int = SEQUENCE, memory: int = ENCODER_BYTES) -> DataFrame:
    return pieces(placed(encoded(docs, path, keep_spaces, memory=memory)), sequence)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))
