"""N-gram Jaccard join of documents with a token-group matrix.

Documents whose sets may be similar to another's at all (`set_join`) are partitioned into groups: each is compared with
the smallest-id document of the min-hash keys it shares, and verified links make the first groups. For every group the
matrix holds the union of its members' tokens. A document is a query against all groups but its own: how many of its
tokens a group's union holds bounds its overlap with any member, so only groups that hold 0.8 of them are opened, and
only there are pairs of documents compared. A large group of near copies is one group from the start; its tokens are
one matrix entry each, and its members are never compared with one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, free_shuffles, strings, written
from tidewatch.llm.hashing import mixed
from tidewatch.llm.set_join import band, bands, classes, components, least, looked_up, similar, token_sets

#: Min-hash keys by which first groups form; they only decide how much is left for the matrix, not the result.
KEYS = 3


def _texts(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    """Rows without an id have the largest id and part 1, so that they stand behind a row that has it."""
    texts = [t.encode().lower() for t in strings(batch.column(1))]
    ids = batch.column(0).to_pylist()
    return [2**63 - 1 if i is None else i for i in ids], [int(i is None) for i in ids], texts


def _keys(sets: DataFrame) -> DataFrame:
    """sig, first, key: the smallest scrambled token of each set under KEYS scramblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64) for k in range(KEYS)]
        for batch in batches:
            tokens = [np.frombuffer(x, "<u8") for x in batch.column(2).to_pylist()]
            keys = [int((mixed(t ^ s)).min().view(np.int64)) for t in tokens for s in salts]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), KEYS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys, pa.int64())], names=["sig", "id", "key"])

    return sets.select("sig", F.col("first.id").alias("id"), "tokens").mapInArrow(run, "sig binary, id bigint, key bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    A row's set is its distinct five-word shingles, A-Z lower-cased; with fewer words the whole sequence is the one
    member. Rows link when 100 * overlap >= 80 * union; component_id is the smallest id reachable by links, itself
    included. Rows without words or text have no members and link with nothing; a null id is null in the result and
    counts as larger than any; repeated rows link; an empty table gives no rows; texts of any length count whole;
    only id and text are read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = token_sets(source, _texts, True, False)  # a row for each different set of a block, with all its ids
    may = written(classes(sets).withColumn("row", F.monotonically_increasing_id()), "classes")  # a number for each set, as it is written
    keys = written(_keys(may), "keys")
    leaders = keys.groupBy("key").agg(F.min_by("sig", F.struct("id", "sig")).alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    stars = looked_up(keys, leaders, "key").where("sig != b").groupBy(F.col("sig").alias("a"), "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    first = written(similar(stars, may).select("a", "b"), "links")
    links = written(first.union(_across(may, components(first))), "links")
    found = components(links)
    discard(may, keys, first, links)
    free_shuffles(docs.sparkSession)
    one = F.struct("id", "part")
    label = sets.where("size > 0").select("sig", "id", "part").join(found, sets["sig"] == found["node"], "left").select("sig", "id", "part", F.coalesce("component", "sig").alias("component"))
    least_id = label.groupBy("component", "sig").agg(F.min(one).alias("one"))
    smallest = least_id.groupBy("component").agg(F.min("one").alias("best"))
    verdict = looked_up(least_id, smallest, "component").select("sig", "best")
    # Blocks have one row for each different set, so a text that fills a third of the table is a row a block here.
    linked = sets.where("size > 0").select("sig", "size", "ids", "parts").join(verdict, "sig").select("size", "best", F.inline(F.arrays_zip("ids", "parts")))
    whole = lambda i, p: F.when(p == 0, i)
    out = linked.select(whole(F.col("ids"), F.col("parts")).alias("id"), F.col("size").alias("n_shingles"), whole(F.col("best.id"), F.col("best.part")).alias("component_id"))
    alone = sets.where("size = 0").select("size", F.inline(F.arrays_zip("ids", "parts"))).select(whole(F.col("ids"), F.col("parts")).alias("id"), F.col("size").alias("n_shingles"))
    return out.union(alone.withColumn("component_id", F.col("id")))


def _cells(sets: DataFrame, name: str) -> DataFrame:
    """token and the row's column `name` (long), for each token of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = [np.frombuffer(x, "<i8") for x in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(part.num_rows), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), part.column(0).take(pa.array(rows))], names=["token", name])

    return sets.select(name, "tokens").mapInArrow(run, f"token bigint, {name} bigint")


def _across(may: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links a, b between documents of different groups, all of them."""
    # A group is the number of its component's set; a set that links with none is a group of its own.
    numbers = may.select(F.col("sig").alias("component"), F.col("row").alias("group"))
    group = looked_up(grouped, numbers, "component").select("node", "group")
    members = written(may.join(group, may["sig"] == group["node"], "left").select("sig", "row", F.coalesce("group", "row").alias("group"), "size", "tokens"), "members")
    about = members.select("row", "group", "size")
    # Tokens of one group alone can't lead across.
    spread = _cells(members, "group").groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("token")
    wide = written(_cells(members, "row").join(spread, "token").join(about, "row"), "wide")
    # A query needs 0.8 of its tokens in groups other than its own, so in tokens of several groups.
    able = wide.groupBy("row").agg(F.count("*").alias("n"), F.min("size").alias("size")).where(F.col("n") >= least(F.col("size"))).select("row", "n")
    held = written(wide.join(able, "row"), "queries")
    # The matrix: token x group over documents that may link across, and how many groups hold the token.
    matrix = written(held.select("token", F.col("group").alias("other")).distinct(), "matrix")
    groups = matrix.groupBy("token").agg(F.count("*").alias("groups"))
    rank = F.col("size") - F.col("n") + F.row_number().over(Window.partitionBy("row").orderBy("groups", "token"))
    ranked = held.join(groups, "token").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - least(F.col("size")) + 1)
    # Rare tokens of each document; `rest` tokens stand from this one on, and no more can be shared with what shares it first.
    prefix = written(ranked.where("groups > 1").select("row", "size", "group", "token", (F.col("size") - F.col("rank") + 1).alias("rest")), "prefixes")
    cells = prefix.groupBy("token", F.col("group").alias("other")).agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("rest").alias("far"))
    fits = (F.col("group") != F.col("other")) & (F.col("high") >= least(F.col("size"))) & (F.col("size") >= least(F.col("low"))) & (180 * F.least("rest", "far") >= 80 * (F.col("size") + F.greatest("low", least(F.col("size")))))
    asked = prefix.join(cells, "token").where(fits).select("row", "other").distinct()
    # How many tokens of the query the group's union holds bounds its overlap with every member.
    bound = held.select("row", "size", "token").join(asked, "row").join(matrix, ["token", "other"]).groupBy("row", "other").agg(F.count("*").alias("bound"), F.min("size").alias("size"))
    opened = bound.where(F.col("bound") >= least(F.col("size"))).select("row", "other")
    # Opened groups: members that share a rare token and are of a size that can be similar.
    inside = prefix.select("token", band(F.col("size")).alias("band"), F.col("row").alias("member"), F.col("size").alias("m"), F.col("group").alias("other"), F.col("rest").alias("m_rest"))
    n, m = F.col("size"), F.col("m")
    pairs = prefix.join(opened, "row").withColumn("band", F.explode(bands(F.col("size")))).join(inside, ["token", "other", "band"]).where((m >= least(n)) & (n >= least(m)) & (180 * F.least("rest", "m_rest") >= 80 * (n + m))).select("row", "member").distinct()
    sig = lambda a, b: members.select(F.col("row").alias(a), F.col("sig").alias(b))
    links = written(similar(pairs.join(sig("row", "a"), "row").join(sig("member", "b"), "member").select("a", "b"), may).select("a", "b"), "across")
    discard(members, wide, held, matrix, prefix)
    free_shuffles(links.sparkSession)
    return links
