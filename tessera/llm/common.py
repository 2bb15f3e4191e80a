"""Shared pieces of the corpus operators: staging tables, Arrow helpers, session settings."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session that is one process makes a folder of its own; any other is refused, as its
    executors don't share the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table: it is written and read back like a stage.

    A written table is computed once, where a checkpoint of Spark's own computes it again to write it; it has as few
    partitions as its size needs and a size that joins can plan by, so that a table of few rows costs few tasks.
    """
    return stage(df, "cut")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: a barrier that survives lost executors.

    `df.staged_path` of the result is its folder; `unstage` removes it once nothing reads it any more, the end of the
    application at the latest. The shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    with short_lived_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    release()
    return out


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Jobs in here delete their shuffle files when they end, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def unstage(df: DataFrame) -> None:
    """Delete a staged table."""
    fs, place = _file_system(df.sparkSession, df.staged_path)
    fs.delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of a table; a null text counts as empty, other columns are ignored."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows: what becomes of them as Python objects is small at any time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list]]:
    """(ids, texts) of an (id, text) Arrow stream, in slices of few rows so that memory doesn't follow the batch size."""
    for part in sliced(batches, rows):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def release() -> None:
    """Give freed memory back to the system: workers outlive tasks, the driver its steps, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """A task over Arrow batches that gives its memory back when it ends."""

    def f(batches):
        yield from run(batches)
        release()

    return f


def words(text_col) -> F.Column:
    """Number of words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
