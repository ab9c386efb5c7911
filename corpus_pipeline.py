"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, sources are mixed to target
weights, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns such a table; the last one
returns pieces of sequences. run() writes each stage's result to the shared scratch folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexel.llm.common import table, written
from vexel.llm.mixing import mixed_documents
from vexel.llm.near_dup import deduplicated
from vexel.llm.packing import digests, pack, vocabulary
from vexel.llm.toxicity import CHAIN, scored, train, training_sample

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(training_sample(docs, table(spark, sf_dir, "labels")), [n for n, _ in CHAIN])
    return scored(docs, model, prefix="_").where("not _toxic").select(*DOCUMENTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs).select(*DOCUMENTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs.select(*DOCUMENTS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
