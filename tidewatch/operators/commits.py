"""A sink whose rows, manifest and checkpoint appear in one step, and only once for each batch.

Rows are staged as Parquet in a folder that nobody reads. The commit is one rename: of a manifest, which names the
folder, the batch, a digest of its rows and the checkpoint, to the next number. Whoever reads takes the folders that
manifests name. A crash before the rename leaves a folder that doesn't count; a batch that comes again is passed over if
its rows have the digest of the first time, and is an error if not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import content_id
from tidewatch.operators.pit import digest

MANIFEST = "version bigint, batch string, folder string, n bigint, manifest_id string, checkpoint string"


class ConflictError(ValueError):
    """The same batch, or the same key, with other content."""


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Whether source became target; false if there is a target already."""
    jvm = spark.sparkContext._jvm
    (a, fs), (b, _) = _path(spark, source), _path(spark, target)
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(a).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(a), fs.makeQualified(b), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The commits at `path`, a row each."""
    folder, fs = _path(spark, f"{path}/_commits")
    if not fs.exists(folder) or not len(fs.listStatus(folder)):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/_commits/*.json")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that were committed at `path`."""
    folders = [r.folder for r in manifests(spark, path).where("n > 0").select("folder").orderBy("folder").collect()]  # a row a commit
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def checkpoint(spark: SparkSession, path: str) -> dict | None:
    """The checkpoint of the last commit that has one."""
    row = manifests(spark, path).where("checkpoint is not null").agg(F.max_by("checkpoint", "version").alias("last")).first()
    return json.loads(row.last) if row.last else None


def commit(rows: DataFrame, path: str, batch: str, state: dict | None = None, key: str | None = None, order: Sequence[str] = ()) -> bool:
    """Adds the rows of a batch and its checkpoint `state`; false if that batch is there with the same rows.

    With a key, rows whose key was committed before with the same content are left out, and other content, or one key twice
    with different content within the batch, is a ConflictError; then nothing is committed. order: rows are sorted within
    files, so that a reader's filters skip. Rows are computed once, and digests are taken of what was staged."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    kinds = rows.schema
    (rows.sortWithinPartitions(*order) if order else rows).write.parquet(f"{path}/{folder}")
    staged = spark.read.schema(kinds).parquet(f"{path}/{folder}")
    one, two = digest(F.struct(*staged.columns))
    found = staged.agg(F.count("*").alias("n"), one.alias("one"), two.alias("two")).select("n", content_id("manifest", F.col("n"), F.coalesce("one", F.lit("0")), F.coalesce("two", F.lit("0"))).alias("id")).first()
    n, name = found.n, found.id
    before = manifests(spark, path).where(F.col("batch") == batch).select("manifest_id").first()
    if before:
        if before.manifest_id != name:
            raise ConflictError(f"batch {batch} was committed with other rows")
        return False
    if key:
        mark = lambda df: df.select(F.col(key).alias("_key"), F.sha2(F.to_json(F.struct(*kinds.names)), 256).alias("_own"))
        old = mark(committed(spark, path, _ddl(kinds)))
        both = old.withColumn("_old", F.lit(1)).union(mark(staged).withColumn("_old", F.lit(0))).groupBy("_key").agg(F.count_distinct("_own").alias("_kinds"), F.max("_old").alias("_had"), F.count("*").alias("_n"))
        clash = both.where("_kinds > 1").select("_key").first()
        if clash:
            raise ConflictError(f"{key} {clash._key} comes with other content")
        if both.where("_n > 1").limit(1).count():  # repeats: stage what is new, once
            fresh = staged.dropDuplicates([key]).join(both.where("_had = 0").select("_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
            folder = f"data/{uuid.uuid4().hex}"
            (fresh.sortWithinPartitions(*order) if order else fresh).write.parquet(f"{path}/{folder}")
            n = spark.read.schema(kinds).parquet(f"{path}/{folder}").count()
    last = manifests(spark, path).agg(F.max("version").alias("v")).first().v
    version = 0 if last is None else last + 1
    while True:
        body = {"version": version, "batch": batch, "folder": folder, "n": n, "manifest_id": name, "checkpoint": None if state is None else json.dumps(state, sort_keys=True)}
        draft = f"{path}/_drafts/{uuid.uuid4().hex}"
        place, fs = _path(spark, draft)
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        fs.mkdirs(_path(spark, f"{path}/_commits")[0])
        if _rename(spark, draft, f"{path}/_commits/{version:020d}.json"):
            return True
        fs.delete(place, False)
        again = manifests(spark, path).where(F.col("batch") == batch).select("manifest_id").first()  # another writer was faster
        if again or key:
            if again and again.manifest_id == name:
                return False
            raise ConflictError(f"batch {batch} met another writer")
        version += 1


def _ddl(kinds) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)


def sink(path: str, name: str, key: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: commits each batch of the stream `name` by its number, so a batch that is run again adds nothing."""

    def run(rows: DataFrame, number: int) -> None:
        commit(rows, path, f"{name}-{number}", {"batch": number}, key)

    return run


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Deletes staged folders that no commit names, and says which. Only while nobody writes."""
    folder, fs = _path(spark, f"{path}/data")
    if not fs.exists(folder):
        return []
    named = {r.folder for r in manifests(spark, path).select("folder").collect()}  # a row a commit
    found = [f"data/{s.getPath().getName()}" for s in fs.listStatus(folder)]
    gone = sorted(f for f in found if f not in named)
    for f in gone:
        fs.delete(_path(spark, f"{path}/{f}")[0], True)
    return gone
