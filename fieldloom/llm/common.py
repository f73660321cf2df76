"""Shared helpers of the text operators: tables, shared scratch tables, packed batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster
    must name one, since a machine-local folder would lose rows there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Files of a staged table for each core, at most: small tables over many partitions would else be thousands of tiny files.
FILES = 4


def staged(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors; options: of the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism).write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables and let Spark's cleaner find the shuffles that nothing refers to any more."""
    for path in paths:
        dropped(spark, path)
    paths.clear()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch that is sent to Python, so that batches of texts stay at a few MB.
BATCH_ROWS = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; the session's batches for Python are made small, which bounds memory beside the heap."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the UTF-8 bytes of text (null: empty), with further columns; other columns are pruned."""
    small_batches(docs)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), *more)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes (uint8) of a binary or string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of `column` each (one row at least): bounds memory for long texts."""
    for batch in batches:
        offsets, _ = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    _trim()


def _trim() -> None:
    """Give memory that is free back to the system: idle workers of later stages would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
