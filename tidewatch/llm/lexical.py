"""Ranked lexical search as a blocked sparse matrix product: items x terms (multiplicities) times terms x documents
(integer impacts).

1. A block of items gives the terms that are asked for and the item-term matrix, both sent everywhere. Their size is
   bounded by BLOCK_BYTES of item text; more items are more blocks, each a product of its own.
2. Every document becomes a sparse row over those terms: numbers and counts, a table in the scratch folder. Documents,
   terms and documents by term are counted from that table, a row a term and task.
3. Each task multiplies its rows with the matrix by Gustavson's method: of each document's terms, the items that ask for
   them are merged into one row of scores. Block by block it keeps each item's best documents; what tasks keep meets in
   two rounds of ranking, so no task sees more than a share of it.

Terms are looked up by a 64-bit hash that is one-to-one on the terms asked for, and then compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import partitions, sliced, written
from tidewatch.llm.hashing import mixed

#: Bytes of item text in a block (one item at least), bytes of text that are hashed at once, scores and products at once.
BLOCK_BYTES, PIECE, CELLS, PRODUCTS = 4_000_000, 1 << 20, 1 << 21, 1 << 21
#: Fixed values of the score: its two parameters are 1.2 and 0.25, as integers.
SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 25, 12
#: Rows that count documents and terms, beside those of the terms.
N_DOCS, N_TERMS = -1, -2
_TERM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64, n at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_MULTIPLIER, -1, 2**64)
        have = _powers[0] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size, x, np.uint64)), dtype=np.uint64) for x in (_MULTIPLIER, inverse))
    return have


def _pieces(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that no term crosses."""
    at = 0
    while at < len(buf):
        end = at + PIECE
        while end < len(buf) and _TERM[buf[end]]:
            step = buf[end : end + 4096]
            found = np.flatnonzero(~_TERM[step])
            if len(found):
                end += int(found[0])
                break
            end += len(step)
        end = min(end, len(buf))
        yield at, end
        at = end


def _hashed(buf: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each term in lower-cased bytes: differences of one running sum of weighted bytes."""
    edge = np.flatnonzero(np.diff(_TERM[buf], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(buf))
    weight = mixed(np.arange(256, dtype=np.uint64) + np.uint64(256 * seed + 1))
    sums = np.append(np.uint64(0), np.cumsum(weight[buf] * power[: len(buf)], dtype=np.uint64))
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


@dataclass(frozen=True)
class Vocabulary:
    """Different terms, by ascending hash, and their bytes end to end."""

    seed: int
    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(terms: set[bytes]) -> Vocabulary:
        """Under the first seed that gives the terms different hashes."""
        known = sorted(terms)
        text = np.frombuffer(b" ".join(known), np.uint8)
        seed = 0
        while True:
            parts = [_hashed(text[a:b], seed) for a, b in _pieces(text)]
            hashes = np.concatenate([np.empty(0, np.uint64), *(h for h, _, _ in parts)])
            if len(np.unique(hashes)) == len(known):
                break
            seed += 1
        size = np.array([len(t) for t in known], np.int64)
        order = np.argsort(hashes)
        return Vocabulary(seed, hashes[order], text, (np.cumsum(size + 1) - size - 1)[order], size[order])

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, number, count) of each term of the vocabulary in each text, by text and number, and how many terms of any
        kind each text has."""
        buf = _LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        total, key = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)]
        for a, b in _pieces(buf):
            hashes, start, end = _hashed(buf[a:b], self.seed)
            text = np.searchsorted(ends, start + a, side="right")
            total += np.bincount(text, minlength=len(texts))
            if not len(self.hashes) or not len(hashes):
                continue
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == end - start))
            at, n, text = at[hit], (end - start)[hit], text[hit]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = buf[a + np.repeat(start[hit], n) + within] == self.text[np.repeat(self.start[at], n) + within]
            equal = np.logical_and.reduceat(same, np.cumsum(n) - n) if len(n) else np.empty(0, bool)
            key.append(text[equal] * len(self.hashes) + at[equal])
        cells, count = np.unique(np.concatenate(key), return_counts=True)
        return cells // max(1, len(self.hashes)), cells % max(1, len(self.hashes)), count, total


@dataclass(frozen=True)
class Matrix:
    """Items by term: of term t the items `item[first[t]:first[t + 1]]`, each with how often it has the term."""

    items: int
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray


def _matrix(texts: list[bytes]) -> tuple[Vocabulary, Matrix]:
    low = [_LOWER[np.frombuffer(t, np.uint8)] for t in texts]
    terms: set[bytes] = set()
    for buf in low:
        raw = buf.tobytes()
        for a, b in _pieces(buf):
            edge = (np.flatnonzero(np.diff(_TERM[buf[a:b]], prepend=False, append=False)) + a).tolist()
            terms.update(raw[i:j] for i, j in zip(edge[::2], edge[1::2]))
    known = Vocabulary.of(terms)
    item, number, count, _ = known.found(texts)
    order = np.lexsort((item, number))
    return known, Matrix(len(texts), np.searchsorted(number[order], np.arange(len(known.hashes) + 1)), item[order], count[order])


def _rows(docs: DataFrame, known) -> DataFrame:
    """id, n (terms of any kind), number and count (packed) of the asked terms of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value[0]
        kind = "<u2" if len(vocabulary.hashes) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in sliced(batch, "text", PIECE):
                texts = [b"" if not x.is_valid else x.as_buffer().to_pybytes() for x in part.column(1)]
                text, number, count, total = vocabulary.found(texts)
                cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                number = number.astype(kind)
                counts = [count[i:j].astype("<u1" if j == i or count[i:j].max() < 256 else "<u4").tobytes() for i, j in zip(cut, cut[1:])]
                numbers = [number[i:j].tobytes() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "numbers", "counts"]).filter(pa.array(total > 0))

    return docs.mapInArrow(run, "id bigint, n bigint, numbers binary, counts binary")


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, count) of a batch of `_rows`."""
    raw, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    sizes = np.array([len(x) // width for x in raw], np.int64)
    number = np.frombuffer(b"".join(raw), f"<u{width}").astype(np.int64)
    count = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(c, f"<u{len(c) * width // len(x)}").astype(np.int64) for c, x in zip(counts, raw) if x)])
    return np.repeat(np.arange(batch.num_rows), sizes), number, count


def _counted(rows: DataFrame, terms: int, width: int) -> np.ndarray:
    """Documents that hold each term, then the number of documents and of their terms: a row a term and task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, docs, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            number = np.frombuffer(b"".join(batch.column(2).to_pylist()), f"<u{width}")
            holding += np.bincount(number, minlength=terms)
            docs += batch.num_rows
            total += int(batch.column(1).to_numpy().sum())
        have = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(have, [N_DOCS, N_TERMS])), pa.array(np.append(holding[have], [docs, total]))], names=["term", "n"])

    found = rows.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term that was asked for
    out = np.zeros(terms + 2, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


class _Best:
    """The best `top` documents of each item so far: highest score first, then the smallest id, rows without one last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.score, self.id, self.null = (np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: documents x items."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score = np.append(self.item, item), np.append(self.score, scores[row, item])
        own, none = np.append(self.id, ids[row]), np.append(self.null, null[row])
        order = np.lexsort((own, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.top
        order, self.item = order[kept], item[kept]
        self.score, self.id, self.null = score[order], own[order], none[order]
        last = np.arange(len(self.item)) - np.searchsorted(self.item, self.item) == self.top - 1
        self.least[self.item[last]] = self.score[last]


def _ranked(rows: DataFrame, shared, top: int) -> DataFrame:
    """item, score, id: each task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, weights, docs, terms, width = shared.value
        best, size = _Best(matrix.items, top), np.diff(matrix.first)
        for batch in batches:
            row, number, count = _unpacked(batch, width)
            n = batch.column(1).to_numpy()
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * docs) // max(1, terms)
            impact = weights[number] * ((SCALE * count) // (1000 * count + SATURATION * m[row]))
            ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            made = np.append(0, np.cumsum(np.bincount(row, weights=size[number], minlength=batch.num_rows).astype(np.int64)))
            edges, at = np.searchsorted(row, np.arange(batch.num_rows + 1)), 0
            while at < batch.num_rows:  # rows whose products and scores are held at once, one at least
                end = max(at + 1, min(at + max(1, CELLS // max(1, matrix.items)), int(np.searchsorted(made, made[at] + PRODUCTS, side="right")) - 1))
                end = min(end, batch.num_rows)
                i, j = edges[at], edges[end]
                each = size[number[i:j]]
                place = np.repeat(matrix.first[number[i:j]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                scores = np.zeros((end - at, matrix.items), np.int64)
                np.add.at(scores.reshape(-1), np.repeat((row[i:j] - at) * matrix.items, each) + matrix.item[place], np.repeat(impact[i:j], each) * matrix.times[place])
                best.add(scores, ids[at:end], null[at:end])
                at = end
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.score), pa.array(best.id, pa.int64(), mask=best.null)], names=["item", "score", "id"])

    return rows.mapInArrow(run, "item bigint, score bigint, id bigint")


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score of the `top` documents of each item.

    Terms are maximal runs of digits, ASCII letters and code points from 0x80 on, A-Z lower-cased, of whole texts. A
    document scores the sum of w * ((10**9 tf) div (1000 tf + 12 m)) over an item's terms, repeats included, where
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L. Only scores above 0 count; equal ones stand by
    ascending id, rows without an id last. Null and empty texts have no terms: such items get no rows, such documents
    none either. Repeated documents and repeated items each count as rows of their own; empty tables give no rows; texts
    of any length are taken whole; only the four named columns are read. 25 n N must stay below 2**63.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()), "items")  # a stable number for each item
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = [_block(spark, source, asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k), top) for k in range(blocks)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _block(spark: SparkSession, docs: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """search() for the items of one block."""
    own = asked.orderBy("row").toArrow()  # about BLOCK_BYTES
    known, matrix = _matrix([x.as_buffer().to_pybytes() for x in own.column("text").combine_chunks()])
    context, width = spark.sparkContext, 2 if len(known.hashes) <= 1 << 16 else 4
    rows = written(_rows(docs, context.broadcast((known,))), "rows")
    counts = _counted(rows, len(known.hashes), width)
    n, total = int(counts[N_DOCS]), int(counts[N_TERMS])
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in counts[:-2].tolist()], np.int64)
    kept = _ranked(rows, context.broadcast((matrix, weights, n, total, width)), top)
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    shares = max(1, math.isqrt(partitions(rows)))
    some = kept.withColumn("share", F.spark_partition_id() % shares).withColumn("rank", best("item", "share")).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", best("item")).where(F.col("rank") <= top).select("item", "rank", F.col("id").alias("doc_id"), "score")
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(own.num_rows)), "item_id": own.column("item_id")}))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
