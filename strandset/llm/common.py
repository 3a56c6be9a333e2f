"""Shared plumbing of the corpus operators: shared scratch folders, text batches and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Scratch paths made within the innermost temporary().
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        chosen = spark.sparkContext.getCheckpointDir()
        if not chosen:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandset-"))
            chosen = spark.sparkContext.getCheckpointDir()
        found = chosen
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; the JVM removes it when it ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch paths made inside are deleted at the end, and shuffle files of plans that have finished."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        release(spark)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at a table that outlives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now, rather than when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory of this Python worker back to the system: workers outlive their tasks, beside others of the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
        library.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about limit; a larger item is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with the texts of a column, null as empty, of about limit characters each."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    for a, b in chunks(sizes, limit):
        part = batch.slice(a, b - a)
        yield part, [x or "" for x in part.column(column).to_pylist()]
