"""Claims, tokens, embeddings by hashing, redaction, addresses, and the alias and contradiction graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claim_text(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def claim_id(text: Column) -> Column:
    return F.sha2(claim_text(text), 256)


def tokens(text: Column) -> Column:
    """Runs of word characters, dots and dashes, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)[\w.-]+)"), 1)


def token_bucket(token: Column, buckets: int) -> Column:
    """The first four bytes of a token's SHA-256 as a number, modulo buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def sparse_lexical(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, index, weight: counts of a text's tokens by the first four bytes of their SHA-256."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("_w"))
    counted = words.groupBy(key, "_w").agg(F.count("*").alias("_n"))  # hashes are taken once a distinct word
    return counted.groupBy(key, token_bucket(F.col("_w"), 1 << 32).alias("index")).agg(F.sum("_n").cast("double").alias("weight"))


def hash_embedding(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """key, index, value of the nonzero entries of a signed feature-hashing vector of length 1."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias("_n"))
    sign = F.when(F.pmod(F.conv(F.substring(F.sha2("_w", 256), 9, 2), 16, 10).cast("bigint"), F.lit(2)) == 1, -1.0).otherwise(1.0)
    raw = words.groupBy(key, token_bucket(F.col("_w"), size).alias("index")).agg(F.sum(sign * F.col("_n")).alias("_v")).where("_v != 0")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    return raw.join(norm, key).select(key, "index", (F.col("_v") / F.col("_norm")).alias("value"))


#: What stands for a secret.
MARK = "[REDACTED]"
#: Names whose values are secrets, as a pattern.
_NAMES = r"(?:api[_-]?key|apikey|access[_-]?key|secret(?:[_-]?key)?|client[_-]?secret|(?:access|refresh|auth|id)?[_-]?token|password|passwd|pwd|signature|sig)"
#: (pattern, replacement), in order: credentials of an Authorization header up to the line's end or a comma or quote, bearer
#: tokens in their whole alphabet, user info in addresses, and values of secret names up to white space, a comma, quote or
#: the separators & # ; of an address.
REDACTIONS = (
    (r"(?i)(authorization\s*[=:]\s*[\"']?(?:(?:basic|bearer|digest|token)\s+)?)[^\s,\"']+", "$1" + MARK),
    (r"(?i)\b(bearer\s+)[A-Za-z0-9\-._~+/]+=*", "$1" + MARK),
    (r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/?#@]+@", "$1" + MARK + "@"),
    (rf"(?i)\b({_NAMES}[\"']?\s*[=:]\s*[\"']?)[^\s,;&#\"']+", "$1" + MARK),
    (r"(?i)([?&]key=)[^\s&#,;\"']+", "$1" + MARK),
)


def redacted(text: Column) -> Column:
    """Secrets in headers, bearer tokens, addresses and key=value pairs give way to a mark; the rest of a line, other
    parameters of an address among it, stays."""
    out = text
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def sanitized_uri(url: Column) -> Column:
    """An absolute http(s) address without its fragment; null with user info or another scheme."""
    ok = url.rlike(r"^https?://[^/?#@]+([/?#]|$)")
    return F.when(ok, F.regexp_replace(url, r"#.*$", ""))


def alias_conflicts(aliases: DataFrame, alias: str, entity: str) -> DataFrame:
    """alias (lower, trimmed) and n: those that name several entities."""
    key = F.trim(F.lower(F.col(alias)))
    return aliases.groupBy(key.alias("alias")).agg(F.count_distinct(entity).alias("n")).where("n > 1")


def contradictions(links: DataFrame, known: DataFrame, a: str, b: str, claim: str) -> DataFrame:
    """a, b in both directions, without repeats, of links whose ends are both known claims."""
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).union(links.select(F.col(b).alias("a"), F.col(a).alias("b"))).where("a != b").distinct()
    ids = known.select(F.col(claim).alias("a")).distinct()
    return both.join(ids, "a", "left_semi").join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


def disputed(claims: DataFrame, pairs: DataFrame, claim: str, status: str) -> DataFrame:
    """claims with FACTs that another FACT contradicts turned into DISPUTED."""
    facts = claims.where(F.col(status) == "FACT").select(F.col(claim).alias("_c")).distinct()
    hit = pairs.join(facts, pairs["b"] == facts["_c"], "left_semi").select(F.col("a").alias("_h")).distinct()
    return claims.join(hit, claims[claim] == hit["_h"], "left").withColumn(status, F.when((F.col(status) == "FACT") & F.col("_h").isNotNull(), "DISPUTED").otherwise(F.col(status))).drop("_h")


def context(records: DataFrame, decision_at: Column, available_at: str, status: str, non_directional: Sequence[str]) -> DataFrame:
    """Records that were available (or carry no time) with a mark on those that give no direction."""
    return records.where(F.col(available_at).isNull() | (F.col(available_at) <= decision_at)).withColumn("flags", F.array_compact(F.array(F.when(F.col(status).isin(*non_directional), F.lit("NON_DIRECTIONAL")))))
