"""What the operators share: scratch tables in the cluster's shared folder, and byte helpers."""

from __future__ import annotations

import ctypes
import gc
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.scratch import put, shared_dir

#: White space of the contracts, [\x20\x09-\x0D], as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; see `shared_dir`."""
    return shared_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared scratch folder: cuts the lineage, survives lost executors."""
    path = put(df, name)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables, which are frames that `written` gave, once nothing reads them any more. No other frame is
    taken, and nothing outside the scratch folder is deleted."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if not path or not path.startswith(scratch_dir(df.sparkSession) + "/"):
            raise ValueError("only tables of `written` are scratch")
        context = df.sparkSession.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes a shuffle's files once no plan on the driver refers to it, which
    would else happen at any time later. Twice, as listeners hold the last plan for a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.6)


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _malloc_trim = None


def trim() -> None:
    """Gives memory that a task has freed back to the machine: Python workers live on and serve the next stage."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def partitions(df: DataFrame) -> int:
    """Number of the scan's partitions: what the plan's fan-out is sized by."""
    return max(1, df.rdd.getNumPartitions())


def power_of_two(n: int) -> int:
    """The smallest power of two that is at least n."""
    return 1 << max(0, n - 1).bit_length()


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def sliced(batch: pa.RecordBatch, text: str, limit: int = 4_000_000):
    """Consecutive slices of a batch with about `limit` bytes of text at most (one row at least)."""
    column, at = batch.column(batch.schema.get_field_index(text)), 0
    total = 0
    for i in range(batch.num_rows):
        value = column[i]
        size = len(value.as_buffer()) if value.is_valid else 0
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if batch.num_rows > at:
        yield batch.slice(at)
