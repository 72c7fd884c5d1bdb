"""Reading, staging and size checks shared by the text operators."""

from __future__ import annotations

import atexit
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir, scratch_path

#: A side is broadcast only if it has been measured to be at most this large.
BROADCAST_BYTES = 32 * 1024 * 1024

_staged: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage at a table that every executor can read again, so a
    lost executor costs a re-read and never a recomputation of what came
    before.  The table is removed when the session's process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not _staged:
        atexit.register(_remove_staged)
    _staged.append((spark, path))
    df.write.parquet(path)
    schema = df.schema
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer
    referenced; it only acts when the driver's garbage is collected, which may
    be long after the files fill the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_staged() -> None:
    for spark, path in _staged:
        if spark.sparkContext._jsc is None:        # the session has been stopped
            continue
        try:
            _delete(spark, path)
        except Exception:                          # the gateway may be gone at exit
            return


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no later read needs."""
    spark = df.sparkSession
    files = df.inputFiles()
    for entry in list(_staged):
        if any(entry[1].split("://")[-1].lstrip("/") in f for f in files[:1]):
            _staged.remove(entry)
            _delete(spark, entry[1])


def with_small(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner",
               row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``small`` on, by broadcast only if its counted rows fit ``limit``;
    otherwise by a shuffle join, which adaptive execution may split."""
    if small.count() * row_bytes <= limit:
        small = F.broadcast(small)
    return df.join(small, on, how)


#: Rows that a task turns into Python objects at once.
ROWS = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def columns(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[list, ...]]:
    """The columns as Python lists (nulls are ``None``), ``rows`` rows at a
    time, so that a task never holds a whole batch of texts twice."""
    for b in slices(batches, rows):
        yield tuple(c.to_pylist() for c in b.columns)


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(cols, schema)], schema=schema)


__all__ = ["BROADCAST_BYTES", "batch", "columns", "ensure_checkpoint_dir", "read", "slices", "stage", "unstage", "with_small"]
