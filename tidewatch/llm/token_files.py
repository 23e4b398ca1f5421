"""Token-id files: ids of a table in ascending id order, Simple-8b coded, as rows of pages in Parquet files.

Texts are encoded where they are read; their ids alone are dealt to shards, which are ranges of the documents' ids, and
sorted there. A page is a run of whole documents of one shard: doc_ids, their lengths, the coded words and the block
offsets. Shards are numbered in id order, so a document's place in the whole stream is the tokens of the shards before,
plus those of its shard before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import simple8b
from tidewatch.llm.common import partitions, sliced, strings, trim
from tidewatch.llm.hashing import mixed
from tidewatch.llm.library_encoding import encoder

#: Ids of a page; a page has one document at least. Shards that one level of quantiles parts.
PAGE_IDS, CUTS = 1 << 17, 1000
PAGE = "shard int, page int, start bigint, n_ids bigint, ids array<bigint>, lengths binary, offsets binary, words binary"
SCHEMA = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("offsets", pa.binary()), ("words", pa.binary())])
#: Ids that are null count as the smallest, and stand before a row that has it.
LEAST = -(2**63)


def _bounds(rows: DataFrame, shards: int) -> np.ndarray:
    """Where the shards part: quantiles of the ids, one number a shard. Beyond CUTS they are taken in two levels: quantiles of
    the whole table cut it into groups, and each group gives its own, so no sketch and no list in a plan grows further."""
    if shards < 2:
        return np.empty(0, np.int64)
    first = _quantiles(rows, min(shards, CUTS)).first().cut
    if shards <= CUTS or not first:
        return np.array(first or [], np.int64)
    coarse, each = np.unique(np.array(first, np.int64)), -(-shards // CUTS)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(coarse, batch.column(0).to_numpy(), side="left"))], names=["key", "part"])

    parts = _quantiles(rows.select("key").mapInArrow(grouped, "key bigint, part bigint"), each, "part").collect()  # a number a shard
    return np.sort(np.array([*first, *(x for r in parts for x in r.cut)], np.int64))


def _quantiles(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """`cut`: the n - 1 values that cut the keys into n shares."""
    return rows.groupBy(*by).agg(F.percentile_approx("key", F.array(*(F.lit(k / n) for k in range(1, n))), F.lit(10_000)).alias("cut")) if n > 1 else rows.groupBy(*by).agg(F.array().cast("array<bigint>").alias("cut"))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every row's text and end_id after it, and writes pages to the folder `path`.

    Null texts are empty, so they are the end id alone; an empty table writes no pages. Rows of equal ids stand next
    to each other in no stated order, and are dealt to as many shards as they fill; rows with no id come first. Texts
    may be of any length. `path` is a Spark path; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    shards = partitions(docs)
    bounds = _bounds(rows, shards)
    shards = max(shards, len(bounds) + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end = encoder(tokenizer, False), np.array([end_id], "<u4").tobytes()
        width = "<u2" if library.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in batches:
            for part in sliced(batch, "text", 1_000_000):
                coded = library.encode(strings(part.column(3)))
                key = part.column(1).to_numpy(zero_copy_only=False)
                tie = mixed(part.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)) >> np.uint64(1)
                low, high = np.searchsorted(bounds, key, side="left"), np.searchsorted(bounds, key, side="right")
                shard = low + (((tie >> np.uint64(31)) * (high - low + 1).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                ids = [np.frombuffer(x + end, "<u4").astype(width).tobytes() for x in coded]
                n = [len(x) // 4 + 1 for x in coded]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0), part.column(1), pa.array(tie.astype(np.int64)), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "id", "key", "tie", "n", "coded"])
        trim()

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page, start = TaskContext.get().partitionId(), 0, 0
        names, coded, lengths, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            words, offsets = simple8b.encode(np.concatenate(coded))
            found = {"shard": shard, "page": page, "start": start, "n_ids": total, "ids": names, "lengths": np.array(lengths, "<u4").tobytes(), "offsets": offsets.astype("<u4").tobytes(), "words": words.astype("<u8").tobytes()}
            return pa.RecordBatch.from_pylist([found], schema=SCHEMA)

        for batch in batches:
            raw = batch.column(2)
            for k, (name, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if total and total + n > PAGE_IDS:
                    yield row()
                    page, start = page + 1, start + total
                    names, coded, lengths, total = [], [], [], 0
                value = raw[k].as_buffer()
                names.append(name)
                coded.append(np.frombuffer(value, f"<u{len(value) // n}"))
                lengths.append(n)
                total += n
        if names:
            yield row()

    dealt = rows.mapInArrow(encode, "shard int, id bigint, key bigint, tie bigint, n bigint, coded binary")
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("key", F.col("id").isNotNull(), "tie")
    ordered.select("id", "n", "coded").mapInArrow(pages, PAGE).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit) of each
    document in the files of `path`; a folder without pages gives no rows."""
    pages = spark.read.schema(PAGE).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    bases = pages.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a shard: small enough to send everywhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, start, n_ids, names, *packed = (batch.column(c)[k] for c in ("shard", "start", "n_ids", "ids", "lengths", "offsets", "words"))
                lengths, offsets, words = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, ("<u4", "<u4", "<u8")))
                ids = simple8b.decode(words, offsets, n_ids.as_py()).astype("<u4").tobytes()
                ends = np.cumsum(lengths.astype(np.int64))
                cut = [ids[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * n, pa.int32()), names.values, pa.array(start.as_py() + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(cut, pa.binary())], names=["shard", "id", "within", "n_tokens", "ids"])

    rows = pages.mapInArrow(run, "shard int, id bigint, within bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(bases), "shard").select("id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
