"""Shared plumbing: intermediate tables in the cluster's shared folder, size checks."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of joins below this many bytes (measured, not guessed) are broadcast.
BROADCAST_BYTES = 32 << 20

#: Java form of the separator class of all word contracts.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder, on one machine only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quantloom-checkpoints")
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts lineage: a lost executor repeats a read, not the work behind it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quantloom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "_quantloom_path", None)
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def maybe_broadcast(df: DataFrame, size: int, limit: int = BROADCAST_BYTES, rows: bool = True) -> DataFrame:
    """``df`` with a broadcast hint if it is small: ``size`` bytes for each of its rows, or in all."""
    return F.broadcast(df) if (df.count() * size if rows else size) <= limit else df


def tidy(run):
    """A batch function whose worker gives freed memory back to the system when a task ends.

    Workers live on between tasks, beside the executor's heap.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only; others need no asking
            if trim is not None:
                trim(0)

    return tidied


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator reads, so extra columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
