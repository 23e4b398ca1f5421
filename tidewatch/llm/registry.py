"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import alignment, bpe, exact_dedup, language_id, lexical, line_dedup, ngram_join, packing, quality_classifier, quality_rules, token_files, toxicity, url_filters
from tidewatch.llm.common import scratch_dir
from tidewatch.sources import table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of documents: one row per document with the row that stays."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and the verdict of the fixed base and the learned decision list, for every document."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), path)
    back = bpe.decode_documents(coded, path, ("id", "n_tokens"))
    return back.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents to token files in the scratch folder and reads them back."""
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, path)
    return token_files.read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '^([^/]*\.)?(spam-|ads\.|tracker\.)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the ids of all documents into windows of 2048."""
    encode = packing.library_encode(public_tokenizers.path("word_bpe_49k.json"), True)
    return packing.pack_documents(table(spark, sf_dir, "documents"), encode, 1)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document; kept is false for poor and for toxic ones."""
    docs = table(spark, sf_dir, "documents")
    scorer = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, scorer).withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(docs.where(~held))
    found = language_id.identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model, keep=("held_out",))
    return found.withColumnRenamed("id", "doc_id")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return ngram_join.near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines that an earlier line is similar to."""
    return line_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "lines_removed", "text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT i, item_id, term, count(*) AS times FROM items GROUP BY ALL
), sizes AS (
  SELECT count(*) AS n, sum(len(terms))::BIGINT AS total FROM docs WHERE len(terms) > 0
), counts AS (
  SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS size, unnest(terms) AS term FROM docs) GROUP BY ALL
), known AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sizes GROUP BY term
), scores AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // total))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN known USING (term), sizes GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of two tokenizers end together in every document, and how usual those pairs are."""
    found = alignment.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scorer = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    found = toxicity.classify(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), scorer, keep=("held_out",))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_alignment": op12_alignment,
    "op13_toxicity": op13_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_files": op3_token_files,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op6_url_filters": OP6_SQL, "op11_lexical_search": OP11_SQL}
