"""Versions of a dataset: trees of digests whose differences are found by a walk over changed branches, and the record of a
version with the checks that it must pass.

A tree's leaves are buckets of a partition's rows; their parents are the partition's coarser buckets, the partition itself,
groups of partitions, and one root. A node has sixteen children at most (a group of partitions: as many partitions as
fall to it), so each level is an aggregate that shuffles digests, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import content_id
from tidewatch.operators import pit
from tidewatch.scratch import kept

TREE = "level int, node string, parent string, n bigint, digest string"
#: Hexadecimal digits that name a group of partitions, and a bucket of a partition's rows.
TOP, DEPTH = 2, 2


def _text(columns: Sequence[str]) -> Column:
    """The columns as text that differs where a value or a null differs."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _bucket(key: Sequence[str], depth: int) -> Column:
    """The bucket of a row within its partition: hexadecimal digits of a hash of its key."""
    return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(_text(key)))), 16, "0"), 17 - depth, depth)


def _leaf(name: Column, bucket: Column, top: int) -> Column:
    """The leaf of a partition, by its columns as text, and a bucket."""
    return F.concat(F.substring(F.sha2(name, 256), 1, top), F.lit("/"), name, F.lit("/"), bucket)


def _parent(node: Column, level: int, top: int) -> Column:
    if level == top + 1:
        return F.substring(node, 1, top)
    cut = 2 if level == top + 2 else 1  # a bucket's first digit goes with its stroke
    return node.substr(F.lit(1), F.length(node) - cut)


def tree(rows: DataFrame, partition: Sequence[str], key: Sequence[str], top: int = TOP, depth: int = DEPTH, keep: bool = True) -> DataFrame:
    """level, node, parent, n, digest: the tree of rows by the columns `partition` and, within it, `key`.

    Level 0 is the root, `top` + 1 the partitions, `top` + 1 + `depth` the leaves. Digests don't depend on rows' order, and
    repeats and nulls count. No rows give no node. top and depth fit the data: a leaf should hold some thousands of rows, and
    two trees are compared only if theirs are the same. Leaves are kept as a table, from which all levels are made; where one
    level is read once, such as the root, they need not be (keep)."""
    if top < 1 or depth < 1:
        raise ValueError("top and depth must be positive")
    last = top + 1 + depth
    one, two = pit.digest(F.struct(*sorted(rows.columns)))
    # A leaf has its name once it is aggregated, not by row.
    buckets = rows.groupBy(_text(partition).alias("_name"), _bucket(key, depth).alias("_bucket")).agg(F.count("*").alias("n"), one.alias("_one"), two.alias("_two"))
    leaves = buckets.withColumn("node", _leaf(F.col("_name"), F.col("_bucket"), top))
    made = leaves.select("node", "n", F.sha2(F.concat_ws("/", F.col("n").cast("string"), "_one", "_two"), 256).alias("digest"))
    made = kept(made, "leaves") if keep else made
    levels = []
    for level in range(last, -1, -1):
        named = made.withColumn("parent", _parent(F.col("node"), level, top) if level else F.lit(None).cast("string"))
        levels.append(named.select(F.lit(level).alias("level"), "node", "parent", "n", "digest"))
        if level:  # a child goes to its parent by what its name has more, and its digest as bytes
            tail = F.col("node").substr(F.length("parent") + 1, F.length("node")).alias("tail")
            both = named.groupBy("parent").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(tail, F.unhex("digest").alias("digest")))).alias("below"))
            below = F.transform("below", lambda x: F.struct(F.concat("parent", x["tail"]).alias("node"), F.lower(F.hex(x["digest"])).alias("digest")))
            made = both.select(F.col("parent").alias("node"), "n", F.sha2(F.to_json(below), 256).alias("digest"))
    return reduce(DataFrame.union, levels)


def changed_nodes(old: DataFrame, new: DataFrame, top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """level, node, change (ADDED, GONE, CHANGED), n_old, n_new of nodes that differ between two trees.

    A level's nodes are read only below nodes that differ, so with trees written by level and sorted by parent the walk
    reads what changed. Equal roots end it: no rows."""
    found, above = [], None
    for level in range(top + 2 + depth):
        side = lambda t, name: t.where(F.col("level") == level).select("node", "parent", F.struct("n", "digest").alias(name))  # noqa: E731, B023
        a, b = side(old, "a"), side(new, "b")
        if above is not None:
            a, b = (x.join(above, "parent", "left_semi") for x in (a, b))
        both = a.drop("parent").join(b.drop("parent"), "node", "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "GONE").otherwise("CHANGED")
        here = kept(both.select(F.lit(level).alias("level"), "node", change.alias("change"), F.coalesce("a.n", F.lit(0)).alias("n_old"), F.coalesce("b.n", F.lit(0)).alias("n_new")), "changed")
        found.append(here)
        above = here.select(F.col("node").alias("parent"))
    return reduce(DataFrame.union, found)


def changed_partitions(changes: DataFrame, partition: Sequence[str], kinds: str, top: int = TOP) -> DataFrame:
    """partition columns, change, n_old, n_new of the partitions among `changes`; kinds: their DDL."""
    name = F.col("node").substr(F.lit(top + 2), F.length("node"))
    return changes.where(F.col("level") == top + 1).withColumn("_p", F.from_json(name, kinds)).select(*(F.col("_p")[c].alias(c) for c in partition), "change", "n_old", "n_new")


def changed_rows(old: DataFrame, new: DataFrame, changes: DataFrame, partition: Sequence[str], key: Sequence[str], top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """partition and key columns, change (ADDED, GONE, CHANGED) of rows in leaves that differ. Keys that come more than once
    are compared with all their rows; null is a key like any other."""
    leaves = changes.where(F.col("level") == top + 1 + depth).select("node")
    names = sorted(old.columns)
    if names != sorted(new.columns):
        raise ValueError("both versions must have the same columns")
    # Leaves' partitions are told by the text of their columns and the bucket, so no row makes its node's name.
    inside = F.col("node").substr(F.lit(top + 2), F.length("node"))
    leaves = leaves.select(inside.substr(F.lit(1), F.length(inside) - depth - 1).alias("_name"), F.substring("node", -depth, depth).alias("_bucket"))
    mark = lambda df, s: df.withColumns({"_name": _text(partition), "_bucket": _bucket(key, depth)}).join(leaves, ["_name", "_bucket"], "left_semi").select(*names, F.lit(s).alias("_side"))
    one, two = pit.digest(F.struct(*names))
    own = mark(old, 0).union(mark(new, 1)).groupBy(*partition, *key, "_side").agg(F.concat_ws("/", F.count("*").cast("string"), one, two).alias("_d"))
    both = own.groupBy(*partition, *key).agg(F.max(F.when(F.col("_side") == 0, F.col("_d"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_d"))).alias("_b"))
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "GONE").otherwise("CHANGED")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*partition, *key, change.alias("change"))


def version_problems(manifests: DataFrame, partitions: DataFrame, observations: DataFrame, allow_reconstructed: bool = False) -> DataFrame:
    """problem, what, n: why manifests, partitions and observations are no version.

    manifests: manifest_id, dataset, partition_ids (array), total_rows; partitions: partition_id, dataset, row_count;
    observations: observation_id, class (of `pit.eligibility` at the cutoff). NO_MANIFEST, NO_PARTITION, NO_OBSERVATION;
    REPEATED_MANIFEST, REPEATED_PARTITION, REPEATED_OBSERVATION, REPEATED_REFERENCE (within a manifest); MISSING_PARTITION,
    OTHER_DATASET, MANIFEST_ROWS (another total than its partitions have), UNREFERENCED_PARTITION, ROWS (partitions hold
    another number than there are observations), UNAVAILABLE, RECONSTRUCTED (unless allowed)."""
    text = lambda c: F.col(c).cast("string").alias("what")
    own = lambda df, problem: df.select(F.lit(problem).alias("problem"), "what", F.col("n").cast("bigint").alias("n"))
    again = lambda df, key, problem: own(df.groupBy(text(key)).agg(F.count("*").alias("n")).where("n > 1"), problem)
    none = lambda df, problem: own(df.agg(F.count("*").alias("n")).where("n = 0").withColumn("what", F.lit(None).cast("string")), problem)
    listed = manifests.select("manifest_id", F.col("dataset").alias("_m"), "total_rows", F.explode_outer("partition_ids").alias("partition_id"))
    references = listed.where("partition_id IS NOT NULL")
    single = partitions.groupBy("partition_id").agg(F.min("dataset").alias("_p"), F.min("row_count").alias("row_count"))
    met = references.join(single, "partition_id", "left")
    missing = met.where("_p IS NULL AND row_count IS NULL")
    sums = listed.join(single, "partition_id", "left").groupBy("manifest_id").agg(F.max("total_rows").alias("_t"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("_s"))
    stray = single.join(references.select("partition_id").distinct(), "partition_id", "left_anti")
    rows = partitions.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("_s")).crossJoin(observations.agg(F.count("*").alias("_n")))  # one row each
    kinds = observations.where(F.col("class").isin("INELIGIBLE", *(() if allow_reconstructed else ("RECONSTRUCTED_PIT",)))).groupBy("class").agg(F.count("*").alias("n"))
    named = F.when(F.col("class") == "INELIGIBLE", "UNAVAILABLE").otherwise("RECONSTRUCTED")
    return reduce(DataFrame.union, [
        none(manifests, "NO_MANIFEST"), none(partitions, "NO_PARTITION"), none(observations, "NO_OBSERVATION"),
        again(manifests, "manifest_id", "REPEATED_MANIFEST"), again(partitions, "partition_id", "REPEATED_PARTITION"), again(observations, "observation_id", "REPEATED_OBSERVATION"),
        own(references.groupBy("manifest_id", "partition_id").agg(F.count("*").alias("n")).where("n > 1").withColumn("what", F.concat_ws("/", "manifest_id", "partition_id")), "REPEATED_REFERENCE"),
        own(missing.groupBy(text("partition_id")).agg(F.count("*").alias("n")), "MISSING_PARTITION"),
        own(met.where("_p <> _m").groupBy(text("partition_id")).agg(F.count("*").alias("n")), "OTHER_DATASET"),
        own(sums.where("_t <> _s").select(text("manifest_id"), (F.col("_t") - F.col("_s")).alias("n")), "MANIFEST_ROWS"),
        own(stray.select(text("partition_id"), F.col("row_count").alias("n")), "UNREFERENCED_PARTITION"),
        own(rows.where("_s <> _n").select(F.lit(None).cast("string").alias("what"), (F.col("_s") - F.col("_n")).alias("n")), "ROWS"),
        kinds.select(named.alias("problem"), F.lit(None).cast("string").alias("what"), "n"),
    ])


def dataset_version(observations: DataFrame, nodes: DataFrame, manifests: DataFrame, coverage: DataFrame, gaps: DataFrame, **stated: str) -> DataFrame:
    """One row: dataset_version_id, the stated names and times (dataset_key, schema_version, feature_schema_version,
    label_schema_version, created_at, cutoff_at), total_rows, strict_replay_fraction, reconstructed_pit_fraction, providers,
    n_gaps, and digests: root (of the tree `nodes`), manifests, coverage and gaps.

    The id is a content id of all the rest, so `reidentified` finds a record that was changed. A version of any size is one
    row: lists of partitions, coverage and gaps are tables, of which it holds digests. created_at before cutoff_at is an
    error, as is a name without text."""
    want = ("dataset_key", "schema_version", "feature_schema_version", "label_schema_version", "created_at", "cutoff_at")
    if sorted(stated) != sorted(want) or any(not v.strip() for v in stated.values()):
        raise ValueError(f"a version states {', '.join(want)}")
    if stated["created_at"] < stated["cutoff_at"]:
        raise ValueError("created_at must not be before cutoff_at")
    share = lambda k: F.avg((F.col("class") == k).cast("int"))
    facts = observations.agg(F.count("*").alias("total_rows"), share("STRICT_REPLAY").alias("strict_replay_fraction"), share("RECONSTRUCTED_PIT").alias("reconstructed_pit_fraction"))

    def of(df: DataFrame, name: str, count: str | None = None) -> DataFrame:
        one, two = pit.digest(F.struct(*sorted(df.columns)))
        made = df.agg(F.count("*").alias("_n"), F.coalesce(one, F.lit("0")).alias("_one"), F.coalesce(two, F.lit("0")).alias("_two"))
        return made.select(F.sha2(F.concat_ws("/", "_n", "_one", "_two"), 256).alias(name), *([F.col("_n").alias(count)] if count else []))

    root = nodes.where("level = 0").agg(F.max("digest").alias("root"))
    for side in (root, of(manifests, "manifests"), of(coverage, "coverage", "providers"), of(gaps, "gaps", "n_gaps")):
        facts = facts.crossJoin(side)  # one row each
    out = facts.select(*(F.lit(stated[k].strip()).alias(k) for k in want), *facts.columns)
    return out.select(_identity(out.columns).alias("dataset_version_id"), *out.columns)


def _identity(columns: Sequence[str]) -> Column:
    return content_id("dataset-version", *(F.col(c) for c in columns))


def reidentified(versions: DataFrame) -> DataFrame:
    """dataset_version_id, problem of records that can't be: IDENTITY (the id is not of its fields), FRACTIONS (outside 0 to
    1, or not 1 together), ORDER (created before the cutoff), EMPTY (no rows, root or provider)."""
    fields = [c for c in versions.columns if c != "dataset_version_id"]
    strict, made = F.col("strict_replay_fraction"), F.col("reconstructed_pit_fraction")
    rules = {
        "IDENTITY": F.col("dataset_version_id") != _identity(fields), "FRACTIONS": ~(strict.between(0, 1) & made.between(0, 1) & (F.abs(strict + made - 1) <= 1e-12)),
        "ORDER": F.col("created_at") < F.col("cutoff_at"), "EMPTY": (F.col("total_rows") < 1) | F.col("root").isNull() | (F.col("providers") < 1),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items())))
    return versions.select("dataset_version_id", F.explode(broken).alias("problem"))
