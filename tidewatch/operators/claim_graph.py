"""Claim graphs: entities joined by chains of aliases, documents compiled into one graph, and claims whose status follows from
their sources, what supports them and what contradicts them.

Every fixed point is a loop of joins over tables in the shared folder; what ends it is one number. Nothing of a graph comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.evidence import PRIMARY_TIERS
from tidewatch.scratch import kept


def name_of(alias: Column) -> Column:
    """An alias as names are compared: trimmed, lower case; null without text."""
    text = F.lower(F.trim(alias))
    return F.when(text != "", text)


def _labels(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of undirected edges (a, b), a > b after the first step.

    Each round links all larger neighbours of a node, and itself, to the smallest of its neighbourhood, then all smaller
    ones: rounds grow with the logarithm of a chain's length, edges never outnumber those given, and a hub's edges stay one
    row each. It ends when every node hangs on one that is smaller than all its neighbours (large and small stars)."""
    star = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = star.union(star.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        large = kept(large, "large")
        small = large.groupBy("a").agg(F.min("b").alias("_m"))
        found = large.join(small, "a").select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b")).distinct()
        found = kept(found, "small")
        moved = found.join(star, ["a", "b"], "left_anti").limit(1).count() or star.join(found, ["a", "b"], "left_anti").limit(1).count()
        star = found
        if not moved:
            return star.select(F.col("a").alias("node"), F.col("b").alias("label"))


def closure(aliases: DataFrame, entity: str, alias: str) -> DataFrame:
    """entity, canonical, n_entities: entities that share an alias are one, over chains of any length; canonical is the
    smallest of them. Rows with a null entity name nothing; an entity without a name of its own stands alone; repeats don't
    matter. An alias that names a third of all entities is a row for each of them, never a group in one task."""
    own = aliases.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), name_of(F.col(alias)).alias("_n"))
    named = kept(own.where("_n IS NOT NULL").distinct(), "aliases")
    first = named.groupBy("_n").agg(F.min("_e").alias("b"))
    labels = _labels(named.join(first, "_n").select(F.col("_e").alias("a"), "b"))
    every = own.select("_e").distinct().join(labels, F.col("_e") == F.col("node"), "left").select("_e", F.coalesce("label", "_e").alias("canonical"))
    sizes = every.groupBy("canonical").agg(F.count("*").alias("n_entities"))
    return every.join(sizes, "canonical").select(F.col("_e").alias(entity), "canonical", "n_entities")


def resolved(values: DataFrame, value: str, aliases: DataFrame, found: DataFrame, entity: str, alias: str) -> DataFrame:
    """values with `canonical`: the entity that a name stands for by `closure`'s result, null where none has that name."""
    names = aliases.join(found, entity).select(name_of(F.col(alias)).alias("_n"), "canonical").where("_n IS NOT NULL").distinct()
    return values.withColumn("_n", name_of(F.col(value))).join(names, "_n", "left").drop("_n")


def compiled(claims: DataFrame, edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(claims, edges, contradictions, problems) of documents' claims (claim, statement, status), edges (edge, source, kind,
    target) and links (a, b: claims that contradict each other), repeats and all.

    One row a claim and edge; contradictions in both directions between known claims. Problems (problem, what): CLAIM (an id
    with several statements; the smallest stays), EDGE (an id with several contents; the smallest stays), SELF (a claim
    against itself; left out). Of a claim's statuses the smallest stays. Null ids are left out."""
    content = F.struct("source", "kind", "target")
    one = claims.where("claim IS NOT NULL").groupBy("claim").agg(F.min("statement").alias("statement"), F.min("status").alias("status"), F.count_distinct(F.struct("statement")).alias("_n"))
    lines = edges.where("edge IS NOT NULL").groupBy("edge").agg(F.min(content).alias("_c"), F.count_distinct(content).alias("_n"))
    known = one.select(F.col("claim").alias("a"))
    pairs = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    say = lambda df, problem, c: df.select(F.lit(problem).alias("problem"), F.col(c).cast("string").alias("what"))
    problems = say(one.where("_n > 1"), "CLAIM", "claim").union(say(lines.where("_n > 1"), "EDGE", "edge")).union(say(links.where("a = b").select("a").distinct(), "SELF", "a"))
    return one.drop("_n"), lines.select("edge", "_c.*"), pairs, problems


def settled(claims: DataFrame, pairs: DataFrame, supports: DataFrame, primary: Sequence[str] = PRIMARY_TIERS) -> DataFrame:
    """claim, status, depth of claims (claim, status, tiers: an array of its sources' tiers), at the fixed point.

    A claim that asks to be a FACT becomes one if no claim contradicts it (`pairs`, both directions) and it has a source of a
    primary tier (depth 0) or is supported (`supports`: claim, by) by a FACT of depth d (it then has d + 1, the least). Two
    that ask, have primary sources and contradict each other are DISPUTED. A claim that asks and that neither holds for is
    UNSUPPORTED, or, if it is contradicted, CONTRADICTED; all others keep their status. Supports in circles lift nothing.
    One round a depth; each joins the facts that the last one found with what they support."""
    against = pairs.select(F.col("a").alias("claim")).distinct().withColumn("_against", F.lit(True))
    asked = kept(claims.where("claim IS NOT NULL").join(against, "claim", "left").select("claim", "status", F.coalesce("_against", F.lit(False)).alias("_against"), F.coalesce(F.arrays_overlap("tiers", F.array(*map(F.lit, primary))), F.lit(False)).alias("_primary")), "asked")
    free = asked.where("status = 'FACT' AND NOT _against")
    facts = newest = kept(free.where("_primary").select("claim", F.lit(0).alias("depth")), "facts")
    depth = 0
    while newest.limit(1).count():
        depth += 1
        lifted = supports.select("claim", "by").join(newest.select(F.col("claim").alias("by")), "by", "left_semi").select("claim").distinct()
        newest = kept(lifted.join(free, "claim", "left_semi").join(facts, "claim", "left_anti").select("claim", F.lit(depth).alias("depth")), "lifted")
        facts = kept(facts.union(newest), "facts")
    strong = asked.where("status = 'FACT' AND _primary").select("claim")
    clash = pairs.join(strong.withColumnRenamed("claim", "a"), "a", "left_semi").join(strong.withColumnRenamed("claim", "b"), "b", "left_semi").select(F.col("a").alias("claim")).distinct().withColumn("_clash", F.lit(True))
    status = F.when(F.col("status") != "FACT", F.col("status")).when(F.col("depth").isNotNull(), "FACT").when(F.col("_clash"), "DISPUTED").when(F.col("_against"), "CONTRADICTED").otherwise("UNSUPPORTED")
    return asked.join(facts, "claim", "left").join(clash, "claim", "left").select("claim", F.when(F.col("status").isNull(), F.lit(None)).otherwise(status).alias("status"), "depth")
