"""Document fingerprints: quartile bucket digests, and their likeness.

Byte triplets from a sliding window of five bytes are hashed and counted in 128 buckets. The digest has two bits a
bucket, which say between which quartiles of all counts it lies, and a logarithmic code of the length. Two digests
differ by the sum over buckets of the distance of their codes (opposite ends count 6) and a term for the lengths;
that score is bounded, and likeness is 1 at no difference and 0 at the bound.

Nulls and the like: a null text is empty; texts without a whole triplet have the digest of empty counts; equal texts
have equal digests, whatever their length or number. Texts of any length are counted in parts, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scratch import cut_mapped
from .common import raw_bytes, slices, table, text_or_empty

BUCKETS = 128
#: The difference at which likeness is 0.
MOST_DIFFERENCE = 300
_LENGTH_WEIGHT = 4
_TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]
#: Bytes counted at a time.
_PART = 1 << 18


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """Counts of the hashed triplets of one text's bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data)
    for at in range(0, n, _PART):
        b = data[at : at + _PART + 4].astype(np.uint32)
        for salt, (i, j, k) in enumerate(_TRIPLETS):
            m = min(_PART, len(b) - k)
            if m > 0:
                h = b[i : i + m] * np.uint32(0x9E3779B1) + b[j : j + m] * np.uint32(0x85EBCA6B) + b[k : k + m] * np.uint32(0xC2B2AE35) + np.uint32((salt + 1) * 0x27D4EB2F & 0xFFFFFFFF)
                h ^= h >> np.uint32(15)
                counts += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(25), minlength=BUCKETS)
    return counts


def digest(data: np.ndarray) -> bytes:
    """The length code, then 2 bits a bucket."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.partition(counts, [31, 63, 95])[[31, 63, 95]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, round(8 * np.log2(1 + len(data))))
    return bytes([length]) + packed.tobytes()


_STEP = np.array([0, 1, 2, 6])
#: The difference of two bytes of four codes each.
_PAIRS = np.zeros((256, 256), np.int64)
for _shift in (0, 2, 4, 6):
    _code = np.arange(256) >> _shift & 3
    _PAIRS += _STEP[np.abs(_code[:, None] - _code[None, :])]


def likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    apart = abs(int(x[0]) - int(y[0]))
    score = int(_PAIRS[x[1:], y[1:]].sum()) + _LENGTH_WEIGHT * max(0, apart - 1)
    return 1.0 - min(score, MOST_DIFFERENCE) / MOST_DIFFERENCE


def _text_digest(text: str) -> bytes:
    return digest(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: part and kind: 0 a finished row, 1 a partition's first row, 2 its last one, which waits for the next partition.
_KEPT = f"{_FIELDS}, part int, kind int, text string"


def _row(doc_id, text: str, own: bytes, following: str, next_digest: bytes) -> tuple:
    e = edited(text, following)
    d = own if e == text else _text_digest(e)
    sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, own.hex(), d.hex(), likeness(own, d), likeness(own, next_digest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in _KEPT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _sorted_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        for s in slices(batch, 1):
            rows = []
            data, off = raw_bytes(s.column(1))
            for k, (doc_id, text) in enumerate(zip(s.column(0).to_pylist(), s.column(1).to_pylist())):
                own = digest(data[off[k] : off[k + 1]])
                if held is None:
                    rows.append((doc_id, None, None, own.hex(), None, None, None, part, 1, text))
                else:
                    rows.append((*_row(*held, text, own), part, 0, None))
                held = (doc_id, text, own)
            yield _batch(rows)
    if held:
        yield _batch([(held[0], None, None, held[2].hex(), None, None, None, part, 2, held[1])])


def _boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*_row(r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["next_text"], bytes.fromhex(r["next_fingerprint"])), 0, 0, None) for r in batch.to_pylist()]
        if rows:
            yield _batch(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text), in descending order of doc_id, compared with its own edited text and
    with the next document; the last one's next is the first. Null ids come last, and equal ids are ordered by a hash
    of their text.

    One shuffle deals the texts by ranges of doc_id; a salt after the other keys lets rows that are equal in them lie
    in many partitions. A partition's last row needs the first one of the next partition: these boundary rows, two a
    partition, are completed apart."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", text_or_empty().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.rand(11)]
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.withColumns({"k1": order[1], "k2": order[2]}).repartitionByRange(n, order[0], "k1", "k2")
    part = dealt.sortWithinPartitions(order[0], "k1", "k2").select("doc_id", "text")
    kept = cut_mapped(part, _sorted_part, _KEPT, "fingerprints")
    edge = kept.where("kind > 0").select("part", "kind", "doc_id", "fingerprint", "text")
    # as few rows as there are partitions; of each but the text, the order comes first
    order_of = edge.where("kind = 1").select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))
    first = edge.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = edge.where("kind = 2").join(order_of, "part").join(first, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    # a task for each of so few rows would only start workers and make files
    last = last.coalesce(max(1, spark.sparkContext.defaultParallelism))
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    return kept.where("kind = 0").select(*names).unionByName(last.mapInArrow(_boundary, _KEPT).select(*names))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_bucket(i: int, j: int, k: int, salt: int) -> str:
    h = f"((b{i} * {0x9E3779B1} + b{j} * {0x85EBCA6B} + b{k} * {0xC2B2AE35} + {(salt + 1) * 0x27D4EB2F & 0xFFFFFFFF}) & 4294967295)"
    return f"CASE WHEN b{k} IS NOT NULL THEN (xor({h}, {h} >> 15) * {0x2C1B3C6D} & 4294967295) >> 25 END"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS row, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n_chars, coalesce(lead(row) OVER (ORDER BY row), 1) AS next_row, coalesce(lead(text) OVER (ORDER BY row), first(text) OVER (ORDER BY row)) AS next_text FROM d),
t AS (
  SELECT row, 0 AS kind, text FROM n
  UNION ALL SELECT row, 1, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) FROM n),
b AS (SELECT row, kind, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM t),
p AS (SELECT row, kind, unnest(bytes) AS b0, unnest(range(len(bytes))) AS place FROM b),
w AS (
  SELECT row, kind, b0, lead(b0, 1) OVER o AS b1, lead(b0, 2) OVER o AS b2, lead(b0, 3) OVER o AS b3, lead(b0, 4) OVER o AS b4 FROM p
  WINDOW o AS (PARTITION BY row, kind ORDER BY place)),
h AS (SELECT row, kind, unnest([{", ".join(_sql_bucket(*x, salt) for salt, x in enumerate(_TRIPLETS))}]) AS bucket FROM w),
c AS (SELECT row, kind, bucket, count(*) AS c FROM h WHERE bucket IS NOT NULL GROUP BY ALL),
a AS (
  SELECT t.row, t.kind, list(coalesce(c.c, 0) ORDER BY x.bucket) AS counts, list_sort(list(coalesce(c.c, 0))) AS sorted
  FROM t CROSS JOIN range({BUCKETS}) x(bucket) LEFT JOIN c ON c.row = t.row AND c.kind = t.kind AND c.bucket = x.bucket GROUP BY t.row, t.kind),
e AS (
  SELECT a.row, a.kind, list_transform(counts, lambda c: (c > sorted[32])::INT + (c > sorted[64])::INT + (c > sorted[96])::INT) AS codes,
    least(255, round(8 * log2(1 + octet_length(encode(t.text)))))::INT AS size
  FROM a JOIN t ON t.row = a.row AND t.kind = a.kind),
f AS (
  SELECT *, printf('%02x', size) || array_to_string(list_transform(range({BUCKETS // 4}), lambda m: printf('%02x', codes[4 * m + 1] + 4 * codes[4 * m + 2] + 16 * codes[4 * m + 3] + 64 * codes[4 * m + 4])), '') AS digest
  FROM e),
s AS (
  SELECT n.doc_id, n.n_chars, x.digest AS fingerprint, y.digest AS edited_fingerprint, n.row,
    list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [0, 1, 2, 6][abs(x.codes[i] - y.codes[i]) + 1])) + {_LENGTH_WEIGHT} * greatest(0, abs(x.size - y.size) - 1) AS to_edited,
    list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [0, 1, 2, 6][abs(x.codes[i] - z.codes[i]) + 1])) + {_LENGTH_WEIGHT} * greatest(0, abs(x.size - z.size) - 1) AS to_next
  FROM n JOIN f x ON x.row = n.row AND x.kind = 0 JOIN f y ON y.row = n.row AND y.kind = 1 JOIN f z ON z.row = n.next_row AND z.kind = 0)
SELECT s.doc_id, s.n_chars, sha256(t.text) AS edited_sha256, fingerprint, edited_fingerprint,
  1.0::DOUBLE - least(to_edited, {MOST_DIFFERENCE})::DOUBLE / {MOST_DIFFERENCE} AS near_edited, 1.0::DOUBLE - least(to_next, {MOST_DIFFERENCE})::DOUBLE / {MOST_DIFFERENCE} AS near_next
FROM s JOIN t ON t.row = s.row AND t.kind = 1"""
