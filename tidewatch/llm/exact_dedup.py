"""Exact dedup by a tree-merge of sorted digest runs, DataFrame functions only.

Each input partition is one run: its rows sorted by digest and grouped, one entry per distinct text with the row to
keep and a count. Runs then meet in binomial rounds, ROUNDS at most: in each, as many neighbouring runs as that takes
become one, sorted again, and entries of equal digests merge to the better row, so a text that fills a third of the table is reduced to one entry a run before it
ever moves. The verdict goes back down by (run, digest), so no key gathers all its copies anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE, partitions, power_of_two, written

#: Runs that merge into one in a round, at least (a power of two), and rounds at most: more runs merge more at once.
FAN, ROUNDS = 4, 4


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, code points of the original text, SHA-256 of the text without white space, and a second check value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).alias("id"), F.length(text).alias("size"), F.regexp_replace(text, f"{SPACE}+", "").alias("norm"))
    return norm.select("id", "size", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("proof"))


def _best(size: Column, row: Column) -> Column:
    return F.struct((-size).alias("less"), row.alias("id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary).

    Rows are equal when their texts are after deleting white space. Of equal rows, the one with the most code points
    stays, then the smallest id. Null texts count as empty, so they are one group; repeated ids are rows of their own
    with the same verdict; a null id sorts first. An empty table gives an empty result; other columns are not read.
    Digests that agree must also agree in a second hash (`proof`), at every level of the merge.
    """
    runs = power_of_two(partitions(docs))
    base = written(digested(docs, id_col, text_col).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs))), "digests")
    key = ["digest", "proof"]
    entries = base.select("run", *key, _best(F.col("size"), F.col("id")).alias("best"), F.lit(1).cast("long").alias("n")).sortWithinPartitions("run", *key)
    level, left = entries.groupBy("run", *key).agg(F.min("best").alias("best"), F.sum("n").alias("n")), runs
    fan = max(FAN, power_of_two(math.ceil(runs ** (1 / ROUNDS))))
    while left > 1:
        step = min(fan, left)
        level = level.withColumn("run", F.expr(f"run div {step}")).groupBy("run", *key).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        left //= step
    winners = level.select(*key, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    # One entry per run and text on the left, one per text on the right: a hot text is `runs` rows at most.
    verdicts = base.select("run", *key).distinct().join(winners, key)
    return (
        base.join(verdicts, ["run", *key])
        .select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    )
