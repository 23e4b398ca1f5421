"""Stores on Parquet: upserts, insert-once ledgers, manifests, content-addressed blobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import flags
from tidewatch.operators.consensus import latest_by
from tidewatch.operators.pit import digest


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key of both: new rows win over old ones, then `order`."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by(both, list(keys), [F.col("_new").desc(), *order]).drop("_new")


#: Pieces that each partition of a scan is dealt to by key, so that a task's memory is that of a piece, whatever the input.
PIECES = 8


def pieces(*frames: DataFrame) -> int:
    """PIECES for each partition of all frames; they should be scans, or what is made of one without a shuffle."""
    return PIECES * max(1, sum(df.rdd.getNumPartitions() for df in frames))


def insert_once(ledger: DataFrame, rows: DataFrame, key: str, digest: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): rows whose key is new; keys that are there with another digest. parts: how many pieces
    both are dealt to by key, such as `pieces` has it; as Spark plans it, if None."""
    have = ledger.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    if parts:  # merged, so no task holds more than its piece of either
        have, rows = have.repartition(parts, "_k").hint("merge"), rows.repartition(parts, key)
    fresh = rows.join(have, rows[key] == have["_k"], "left_anti").dropDuplicates([key, digest])
    clash = rows.join(have, (rows[key] == have["_k"]) & (rows[digest] != have["_d"])).select(key).distinct()
    return fresh, clash


def resolved_pairs(predictions: DataFrame, outcomes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, problems): the one-to-one join, and keys that are missing, orphaned or repeated on either side."""
    pairs = predictions.join(outcomes, key)
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    sides = count(predictions, "_p").join(count(outcomes, "_o"), key, "full_outer")
    problem = F.when(F.col("_o").isNull(), "MISSING").when(F.col("_p").isNull(), "ORPHAN").when((F.col("_p") > 1) | (F.col("_o") > 1), "REPEATED")
    return pairs, sides.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def pair_mismatches(predictions: DataFrame, outcomes: DataFrame, key: str, same: Sequence[str], resolved: str, ends: str) -> DataFrame:
    """key and problem of pairs that don't fit: MISMATCH:<column> for each column of `same` (such as the feature row, event,
    horizon and time) that differs between prediction and outcome, two nulls being equal; EARLY where the outcome was
    resolved before its label ends, or either time is unknown. Keys that come several times are judged pair by pair and
    reported once a problem; keys without a partner are `resolved_pairs`' matter."""
    sides = predictions.select(key, F.struct(*same).alias("_p")).join(outcomes.select(key, F.struct(*same).alias("_o"), F.col(resolved).alias("_r"), F.col(ends).alias("_e")), key)
    wrong = [F.when(~F.col(f"_p.{c}").eqNullSafe(F.col(f"_o.{c}")), F.lit(f"MISMATCH:{c}")) for c in same]
    early = F.when(~F.coalesce(F.col("_r") >= F.col("_e"), F.lit(False)), F.lit("EARLY"))
    return sides.select(key, F.explode(F.array_compact(F.array(*wrong, early))).alias("problem")).distinct()


def manifest(rows: DataFrame, partition: Sequence[str], row_key: Column, observed: str) -> DataFrame:
    """One row per partition: n, first and last time, and a digest of its rows that their order doesn't change and that
    repeats do."""
    one, two = digest(row_key)
    out = rows.groupBy(*partition).agg(F.count("*").alias("n"), F.min(observed).alias("first_at"), F.max(observed).alias("last_at"), one.alias("_one"), two.alias("_two"))
    return out.withColumn("digest", F.sha2(F.concat_ws("/", F.col("n").cast("string"), "_one", "_two"), 256)).drop("_one", "_two")


def verified(stated: DataFrame, rows: DataFrame, partition: Sequence[str], row_key: Column, observed: str) -> DataFrame:
    """partition and problem of each partition that isn't as a manifest states: MISSING, UNSTATED or CHANGED."""
    now = manifest(rows, partition, row_key, observed).select(*partition, F.col("digest").alias("_now"))
    both = stated.select(*partition, F.col("digest").alias("_was")).join(now, list(partition), "full_outer")
    problem = F.when(F.col("_now").isNull(), "MISSING").when(F.col("_was").isNull(), "UNSTATED").when(F.col("_now") != F.col("_was"), "CHANGED")
    return both.select(*partition, problem.alias("problem")).where("problem IS NOT NULL")


def partitions_of(stated: DataFrame, partition: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Rows of a manifest whose times meet [first, last], in partition order."""
    return stated.where((F.col("last_at") >= first) & (F.col("first_at") <= last)).orderBy(*partition)


def page_problems(pages: DataFrame, source: str, page: str, cursor: str, following: str, rows: str) -> DataFrame:
    """source, page, problem of landed pages of a backfill: pages are numbered from 0, each begins at the cursor that the
    page before gave, no cursor comes twice, and only a last page has none to follow.

    REPEATED (a page number twice), GAP (no page before), CURSOR (not where the page before ended), LOOP (a cursor seen
    before), AFTER_END (the page before was the last), NEGATIVE (fewer rows than none). A source's pages are one window
    partition: thousands of rows at most, whatever the pages hold."""
    w, seen = Window.partitionBy(source).orderBy(page), Window.partitionBy(source, cursor).orderBy(page)
    one = pages.groupBy(source, page).agg(F.count("*").alias("_n"), F.min(cursor).alias(cursor), F.min(following).alias(following), F.min(rows).alias(rows))
    before, number = F.lag(following).over(w), F.lag(page).over(w)
    marks = one.withColumns({"_before": before, "_number": number, "_again": F.row_number().over(seen) > 1})
    problem = flags(
        REPEATED=F.col("_n") > 1, GAP=F.coalesce(F.col(page) != F.col("_number") + 1, F.col(page) != 0), AFTER_END=F.col("_number").isNotNull() & F.col("_before").isNull(),
        CURSOR=F.col("_before") != F.col(cursor), LOOP=F.col("_again") & F.col(cursor).isNotNull(), NEGATIVE=F.col(rows) < 0,
    )
    return marks.select(source, page, F.explode(problem).alias("problem"))


def checkpoints(pages: DataFrame, problems: DataFrame, source: str, page: str, following: str, rows: str) -> DataFrame:
    """source, pages, rows, next_cursor, done: how far a backfill may go on, up to the first page with a problem."""
    bad = problems.groupBy(source).agg(F.min(page).alias("_bad"))
    good = pages.join(bad, source, "left").where(F.col("_bad").isNull() | (F.col(page) < F.col("_bad")))
    out = good.groupBy(source).agg(F.count("*").alias("pages"), F.sum(rows).alias("rows"), F.max_by(F.struct(F.col(following).alias("c")), page).alias("_last"))
    return out.select(source, "pages", "rows", F.col("_last.c").alias("next_cursor"), F.col("_last.c").isNull().alias("done"))


def write_partitioned(rows: DataFrame, path: str, partition: Sequence[str], order: Sequence[str]) -> None:
    """Parquet by partition, sorted within files so that min/max statistics prune."""
    rows.repartition(*partition).sortWithinPartitions(*partition, *order).write.mode("append").partitionBy(*partition).parquet(path)


def put_blobs(blobs: DataFrame, path: str, content: str = "content") -> None:
    """Content-addressed blobs, one row per distinct digest, partitioned by its first two characters."""
    addressed = blobs.select(F.sha2(content, 256).alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    addressed.withColumn("prefix", F.substring("digest", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def read_blob(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """The blob of a digest; one partition is read, and the content is hashed again."""
    found = spark.read.parquet(path).where((F.col("prefix") == digest[:2]) & (F.col("digest") == digest))
    return found.where(F.sha2("content", 256) == F.col("digest"))
