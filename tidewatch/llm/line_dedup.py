"""Line dedup across documents: an exact set-similarity join of lines.

A line's tokens are its five-word shingles (the whole line if it has fewer words). `set_join` collapses equal sets and
leaves only sets that may have a similar one, with each token's frequency. Then each set's tokens stand rare first; two
similar sets share one of their first `size - 0.8 size + 1` tokens (prefix filter); the places of a shared token bound
the overlap (positional filter), the sizes bound the ratio (length filter). What remains is verified, and a line goes if
any earlier line is similar to it.

Before that, each set meets only the earliest set of each of its prefix tokens: in a large family of near copies that
settles nearly all of them, so the pairs within a family are never formed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, free_shuffles, partitions, strings, written
from tidewatch.llm.set_join import band, bands, classes, exploded, least, similar, token_sets

#: Sets of one prefix token beyond which they meet by length band.
WIDE = 1000


def _lines(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    """Every line with a word, however short: one of fewer words than a shingle is one token, and only copies equal it."""
    ids, parts, texts = [], [], []
    for row, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
        for number, line in enumerate(text.encode().lower().split(b"\n")):
            if line.strip():
                ids.append(row)
                parts.append(number)
                texts.append(line)
    return ids, parts, texts


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, part of every line (part: its number in the text, from 0) that a line before it is similar to: 100 * overlap
    >= 80 * union of their token sets. Before: smaller (id, part). Ids are unique and not null; `without_repeats` sees to
    that."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    sets = token_sets(source, _lines, False, True)
    may = written(classes(sets, "dfs"), "lines")
    # Equal sets: all but the first line of each go.
    firsts = may.select("sig", "first")
    leads = sets.where("tokens is not null").select("sig", "id", "part").join(firsts, "sig").where(F.struct("id", "part") != F.col("first")).select("id", "part")
    copies = sets.where(F.size("ids") > 1).select("id", "part", F.inline(F.arrays_zip("ids", "parts")))
    equal = copies.where((F.col("ids") != F.col("id")) | (F.col("parts") != F.col("part"))).select(F.col("ids").alias("id"), F.col("parts").alias("part")).union(leads)
    # Similar sets: only whether an earlier one exists matters, and of each set only its first line is still there.
    tokens = exploded(may.withColumns({"id": F.col("first.id"), "part": F.col("first.part")}), ("sig", "size", "id", "part"))
    prefix = written(tokens.where(F.col("place") <= F.col("size") - least(F.col("size"))).drop("df"), "prefixes")
    order = F.struct("id", "part", "sig")
    heads = prefix.groupBy("token").agg(F.min(order).alias("head"), F.count("*").alias("n")).where("n > 1").select("token", "head", "n")
    shared = prefix.join(heads, "token")
    stars = shared.where(F.col("sig") != F.col("head.sig")).select(F.col("sig").alias("a"), F.col("head.sig").alias("b")).distinct()
    settled = written(similar(stars, may).select("a").distinct(), "settled")
    left = written(shared.join(settled, F.col("sig") == F.col("a"), "left_anti").select("sig", "size", "id", "part", "place", "token", "n"), "open")
    # Sets of a frequent token meet by length band; the length filter leaves no pair outside.
    wide, n, m = F.col("n") > WIDE, F.col("size"), F.col("b_size")
    asked = left.withColumn("band", F.explode(F.when(wide, bands(n)).otherwise(F.array(F.lit(-1).cast("long")))))
    other = prefix.join(heads.select("token", "n"), "token").select("token", F.when(wide, band(n)).otherwise(F.lit(-1).cast("long")).alias("band"), F.col("sig").alias("b"), n.alias("b_size"), F.col("place").alias("b_place"), F.struct("id", "part").alias("b_first"))
    close = (
        (F.col("b_first") < F.struct("id", "part"))
        & (m >= least(n)) & (n >= least(m))
        & (180 * F.least(n - F.col("place"), m - F.col("b_place")) >= 80 * (n + m))
    )
    pairs = asked.join(other, ["token", "band"]).where(close).select(F.col("sig").alias("a"), "b").distinct()
    near = settled.union(similar(pairs, may).select("a")).distinct()
    gone = may.join(near, may["sig"] == near["a"], "left_semi").select("first.id", "first.part")
    found = written(equal.union(gone).distinct(), "gone")
    discard(sets, may, prefix, settled, left)
    free_shuffles(found.sparkSession)
    return found


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """(rows, key): docs with each row as one column `_row`, and a unique key in the order of the documents. Ids are the key
    where no two rows share one and none is null; else rows are sorted by (id, text), those without an id last, and
    numbered as they are written."""
    rows = docs.select(F.struct("*").alias("_row"))  # whatever names the columns have
    own, text = F.col("_row")[id_col].cast("long"), F.col("_row")[text_col]
    if not docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").limit(1).count():
        return rows, own
    order = [own.isNull(), own, F.xxhash64(text), text, F.col("_tie")]  # a row that stands a million times is split too
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(max(2, partitions(docs)), *order).sortWithinPartitions(*order)
    return written(dealt.select("_row", F.monotonically_increasing_id().alias("_number")), "numbered"), F.col("_number")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later similar lines removed from its text, and `lines_removed` (in the place of a column of that name).

    All other columns stay, and every row: a text that loses all its lines is empty, a null text stays null. A line is
    later if its document's id is larger, or in the same document its number; rows that share an id are documents of their
    own in the order of a hash of their texts (so a row that comes twice loses its lines the second time), and rows without
    an id stand behind all others. Lines without a word stay; in scripts without spaces a line is one word, so its copies go
    and near copies stay. Texts and lines may be of any length and number. An empty table stays empty.
    """
    rows, key = _numbered(docs, id_col, text_col)
    found = later_matches(rows.select(key.alias("id"), F.col("_row")[text_col].alias("text")), "id", "text")
    gone = found.groupBy(F.col("id").alias("_id")).agg(F.collect_set("part").alias("_gone"))
    joined = rows.join(gone, key == F.col("_id"), "left").withColumn("_lines", F.split(F.col("_row")[text_col], "\n"))
    # Numbers of the lines that stay, by a hash set, so that a text costs what it has of lines.
    left = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size("_lines") - 1).cast("long")), "_gone")
    joined = joined.withColumn("_text", F.array_join(F.transform(left, lambda i: F.get("_lines", i.cast("int"))), "\n"))
    new = {text_col: F.when(F.col("_gone").isNull(), F.col("_row")[text_col]).otherwise(F.col("_text")), "lines_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return joined.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in dict.fromkeys([*docs.columns, *new])))
