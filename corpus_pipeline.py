"""A corpus pipeline: quality rules, language identification, line dedup, near-duplicate documents, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import language_id, line_dedup, ngram_join, packing, quality_rules
from tidewatch.llm.common import discard, written
from tidewatch.sources import table

#: Texts whose main language holds fewer of their letters go.
LEAST_SCORE = 0.5


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """Each row as one column `_row`, whatever names its columns have, and the columns that an operator reads."""
    return docs.select(F.struct("*").alias("_row"), *columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the fixed base or a learned rule rejects; rules are learned on the labelled ones among docs."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(_whole(docs, "text"), rules, keep=("_row",)).where("kept").select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those with no main language."""
    found = language_id.identify(_whole(docs, "doc_id", "text"), language_id.fit(docs), keep=("_row",))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line is similar to; n_chars follows the text. A document that is left without a word
    goes: every line of it stands in an earlier one."""
    out = line_dedup.without_repeats(_whole(docs, "doc_id", "text")).where(F.col("lines_removed").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the row of the smallest id, nulls last. Rows are told apart by
    a key of their own, so of repeated rows one stays, and rows without an id are judged each by its text."""
    keyed = written(_whole(docs, "doc_id", "text").withColumn("_key", F.monotonically_increasing_id()), "keyed")
    groups = ngram_join.near_groups(keyed, id_col="_key").join(keyed.select(F.col("_key").alias("id"), "doc_id"), "id")
    stay = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("best")).select(F.col("best.id").alias("_key"))
    return keyed.join(stay, "_key", "left_semi").select("_row.*")


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 ids."""
    return packing.pack_documents(docs, packing.library_encode(public_tokenizers.path("word_bpe_49k.json"), True), 1)


STAGES = [("quality_rules", quality), ("language_id", language), ("line_dedup", lines), ("ngram_join", documents), ("packing", windows)]
#: Learned rules, Viterbi and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)  # the stage before it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
