"""The folder that driver and executors share, for tables that cut lineage and for streams' checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="scratch-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, local mode (one process) gets a folder of its own, and
    a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, name: str) -> str:
    """df as a Parquet table in the shared folder: its path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, read from a Parquet table in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(put(df, name))
