"""Token counts as delta-maintained rollups.

A change is an insert, a delete or a revised count of one document under one tokenizer version. Each batch of
changes becomes signed sums of documents and tokens by (source, language, version), written in a folder of the
batch's own; totals are the sums over all committed batches. A batch counts once its folder is complete; a batch
that is committed again is left as it is, so commits may be repeated after any failure. compact() folds committed
batches and an earlier base into a new base, whose manifest names both; whatever a complete base names counts through
it alone, so neither a crash between the new base and the deletion of what it holds nor a reader in between counts
anything twice.

Nulls and the like: null sources and languages are groups of their own; a null count is 0; changes of any number
for one document add up; a batch without changes commits nothing but its name. Changes are summed before they are
shuffled, so a common group moves a row a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, scratch_dir, slices, spread, table, text_or_empty, written
from .mixing import n_words
from .packing import vocabulary

KEYS = ["source", "lang", "version"]
_DELTA = "source string, lang string, version string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """changes (op: insert, delete or revise; source, lang, version, tokens; old_tokens for revise) as signed sums.
    Any other op raises an error."""
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("no such op: "), F.coalesce("op", F.lit("null")))))
    n, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    tokens = F.when(F.col("op") == "revise", n - old).otherwise(F.col("sign") * n)
    c = changes.withColumn("sign", sign).select(*KEYS, F.col("sign").cast("long").alias("docs"), tokens.cast("long").alias("tokens"))
    return c.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """The rollup kept in a folder that all executors and the driver reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _complete(self, prefix: str) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix) and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def _manifest(self, bases: list[str]) -> DataFrame:
        """What bases name: kind (batch or base) and name."""
        return self.spark.read.schema("kind string, name string").json([f"{self.folder}/names-{c}" for c in bases])

    def _live(self) -> list[str]:
        """Complete bases that no other complete base has taken in: one, but for compactions at the same time."""
        bases = self._complete("base-")
        # bases that are left until their deletion are few
        gone = {r.name for r in self._manifest(bases).where("kind = 'base'").collect()} if len(bases) > 1 else set()
        return [c for c in bases if c not in gone]

    def _named(self, live: list[str], batches: list[str]) -> set[str]:
        """Those of the given batches that live bases name; only their names come to the driver."""
        if not live or not batches:
            return set()
        m = self._manifest(live).where("kind = 'batch'")
        asked = self.spark.createDataFrame([(b,) for b in batches], "name string")
        return {r.name for r in m.join(asked, "name", "left_semi").distinct().collect()}

    def batches(self) -> list[str]:
        """The names of all committed batches."""
        live = self._live()
        folded = {r.name for r in self._manifest(live).where("kind = 'batch'").collect()} if live else set()
        return sorted(set(self._complete("batch-")) | folded)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch is new. Without the mark of completion, what an earlier try left is overwritten."""
        fs, path = self._fs()
        if fs.exists(path(f"{self.folder}/batch-{batch_id}/_SUCCESS")) or self._named(self._live(), [batch_id]):
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
        return True

    def _parts(self, live: list[str]) -> tuple[list[str], list[str]]:
        """(folders that count, batches among them)."""
        there = self._complete("batch-")
        folded = self._named(live, there)
        own = [b for b in there if b not in folded]
        return [f"{self.folder}/base-{c}" for c in live] + [f"{self.folder}/batch-{b}" for b in own], own

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups that have come to nothing are left out."""
        parts, _ = self._parts(self._live())
        if not parts:
            return self.spark.createDataFrame([], _DELTA.replace("docs", "n_docs").replace("tokens", "n_tokens"))
        d = self.spark.read.schema(_DELTA).parquet(*parts).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return d.where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """One base of all that counts. Its manifest is written before it is complete; then what it holds goes, as does
        what an earlier compaction left behind."""
        live = self._live()
        parts, own = self._parts(live)
        if not parts:
            return
        if own or len(live) > 1:
            new = uuid.uuid4().hex
            d = self.spark.read.schema(_DELTA).parquet(*parts).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            names = self.spark.createDataFrame([("batch", b) for b in own] + [("base", c) for c in live], "kind string, name string")
            if live:
                names = names.unionByName(self._manifest(live).where("kind = 'batch'"))
            names.coalesce(1).write.json(f"{self.folder}/names-{new}")
            d.write.parquet(f"{self.folder}/base-{new}")
        self._sweep()

    def _sweep(self) -> None:
        """Deletes bases and batches that a live base names, the bases' manifests last."""
        fs, path = self._fs()
        live, bases = self._live(), self._complete("base-")
        folded = self._named(live, self._complete("batch-"))
        for name in [*(f"batch-{b}" for b in sorted(folded)), *(f"base-{c}" for c in bases if c not in live), *(f"names-{c}" for c in bases if c not in live)]:
            fs.delete(path(f"{self.folder}/{name}"), True)


def token_counts(docs: DataFrame, path: str, keep_spaces: bool = True) -> DataFrame:
    """docs with a last column n_tokens, the ids of column text under a vocabulary, instead of the text."""
    rest = [c for c in docs.columns if c not in ("text", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, keep_spaces)
        for batch in batches:
            for s in slices(batch, len(rest)):
                n = e.count(s.column(len(rest)).to_pylist())
                yield pa.RecordBatch.from_arrays([*s.columns[: len(rest)], pa.array(n.astype(np.int64))], names=[*rest, "n_tokens"])

    schema = docs.select(*rest).schema.add("n_tokens", "long")
    return spread(docs.select(*rest, text_or_empty().alias("text"))).mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and byte-pair tokens of all documents enter as two batches; then copies of a text that have a greater
    doc_id are deleted under both versions, and the byte-pair counts are revised by an end id. One batch is
    committed twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", n_words(text_or_empty()).alias("n_words"), F.xxhash64("text").alias("h1"), F.crc32(text_or_empty().cast("binary")).alias("h2"), F.length(text_or_empty()).alias("chars"), "text")
    counts = written(token_counts(docs, vocabulary("byte_bpe_50k.json")), "counts")
    none = F.lit(None).cast("long")

    def changes(rows: DataFrame, op: str, version: str, tokens, old=none) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), F.expr(tokens).alias("tokens"), old.alias("old_tokens"))

    same = ["h1", "h2", "chars"]
    # only texts that occur more than once are joined, and written apart: then Spark can split a group of any size
    firsts = written(counts.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    marked = written(counts.join(firsts.hint("merge"), same, "left").select("doc_id", "source", "lang", "n_words", "n_tokens", (F.col("doc_id") > F.col("first")).alias("copy")), "marked")
    copies, kept = marked.where("copy"), marked.where("not coalesce(copy, false)")
    r = TokenRollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    load = changes(marked, "insert", "bpe-50k", "n_tokens")
    r.commit("01-words", changes(marked, "insert", "words", "n_words"))
    r.commit("02-bpe", load)
    r.commit("02-bpe", load)
    r.commit("03-copies", changes(copies, "delete", "words", "n_words").unionByName(changes(copies, "delete", "bpe-50k", "n_tokens")))
    r.commit("04-ends", changes(kept, "revise", "bpe-50k", "n_tokens + 1", F.col("n_tokens")))
    return r.totals()
