"""Cutting lineage: tables written to the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir. Where the setting is absent, a session in one process
    gets a local folder; with executors elsewhere it is an error, as they wouldn't see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "vexel-scratch")
    return f"{root.rstrip('/')}/vexel/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """cut(df.mapInArrow(f, schema), name), whose files the Python workers write: rows don't go back to the JVM, and an
    executor starts no processes for them. Hadoop's local file system starts one for each file it makes, which shares all
    of the JVM's memory until it has replaced its image, and so counts it twice where an executor's processes are summed.

    A task writes under a hidden name of its own and renames the file, so a task that runs again leaves the same file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = df.sparkSession
    folder, arrow = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        context, rows = TaskContext.get(), 0
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        file = f"part-{context.partitionId():06d}.parquet"
        own = f"{root}/.{file}.{context.taskAttemptId()}"
        with system.open_output_stream(own) as out, pq.ParquetWriter(out, arrow, compression="zstd") as w:
            for batch in f(batches):
                w.write_batch(pa.RecordBatch.from_arrays([batch.column(n) for n in arrow.names], schema=arrow))
                rows += batch.num_rows
        if rows:
            system.move(own, f"{root}/{file}")
        else:
            system.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    # a number a partition comes to the driver
    if any(r.rows for r in df.mapInArrow(run, "rows long").collect()):
        return spark.read.schema(schema).parquet(folder)
    return spark.createDataFrame([], schema)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has cut, once no result that reads it is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
