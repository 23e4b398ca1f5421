"""Packing documents' ids into windows by minimum bin slack.

A document's ids are cut into whole windows and a rest. The rests of a partition wait in a pool by length. Each window
takes the longest rest, then the multiset of waiting lengths that comes closest to the room left: a subset-sum dynamic
program over bitsets, with counts found by backtracking. What a window still lacks is cut from one more rest, and the
last rests become windows whose lengths are powers of two; so nothing is padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import sliced, strings, trim
from tidewatch.llm.library_encoding import encoder

#: Rests that wait before windows are filled, and those that stay for the next filling.
POOL, STAY = 4096, 1024
SCHEMA = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def fill(lengths: Sequence[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest one within room. lengths: ascending, distinct;
    count(length): how many there are. Bit t of a bitset says that t can be reached; one bitset is kept for each item
    tried, longest first, and the item is taken where the sum could not be reached without it."""
    mask, reach, tried, k = (1 << (room + 1)) - 1, 1, [], bisect_right(lengths, room)
    while k and not reach >> room & 1:
        k -= 1
        length = lengths[k]
        for _ in range(min(count(length), room // length)):
            more = reach | (reach << length & mask)
            if more == reach:
                break
            tried.append((length, reach))
            reach = more
    left, taken = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(tried):
        if not before >> left & 1:
            taken[length] += 1
            left -= length
    return dict(taken)


@dataclass
class Piece:
    """ids[start:] of a document that wait for a window."""

    doc: object
    start: int
    ids: bytes
    total: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class Packer:
    """Packs the documents of one partition; sequence ids start from `first`."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.waiting = capacity, first, 0
        self.pool: dict[int, deque[Piece]] = {}
        self.lengths: list[int] = []  # ascending, those in the pool

    def _wait(self, piece: Piece) -> None:
        if len(piece) not in self.pool:
            self.pool[len(piece)] = deque()
            insort(self.lengths, len(piece))
        self.pool[len(piece)].append(piece)
        self.waiting += 1

    def _take(self, length: int) -> Piece:
        piece = self.pool[length].popleft()
        if not self.pool[length]:
            del self.pool[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.waiting -= 1
        return piece

    def _rows(self, pieces: list[Piece]) -> list[tuple]:
        rows, at = [], 0
        for p in pieces:
            rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, self.next, at))
            at += len(p)
        self.next += 1
        return rows

    def add(self, doc, ids: bytes) -> list[tuple]:
        """Rows of the windows that a document fills alone; its rest waits."""
        n, size, rows = len(ids) // 4, self.capacity, []
        for start in range(0, n - n % size, size):
            rows += self._rows([Piece(doc, start, ids[4 * start : 4 * (start + size)], n)])
        if n % size:
            self._wait(Piece(doc, n - n % size, ids[4 * (n - n % size) :], n))
        return rows

    def drain(self, stay: int) -> list[tuple]:
        """Rows of windows filled from the pool until at most `stay` rests wait; with stay 0, of all that wait."""
        rows = []
        while self.waiting > stay:
            window = [self._take(self.lengths[-1])]
            room = self.capacity - len(window[0])
            for length, n in fill(self.lengths, lambda x: len(self.pool[x]), room).items():
                window += [self._take(length) for _ in range(n)]
                room -= length * n
            if room and self.pool:  # every rest is longer than the room, or the sums don't meet it
                head, tail = self._take(self.lengths[bisect_right(self.lengths, room)]).split(room)
                window.append(head)
                self._wait(tail)
                room = 0
            if not room:
                rows += self._rows(window)
                continue
            size = self.capacity  # the last: windows of powers of two
            while window:
                while size > sum(map(len, window)):
                    size //= 2
                part, room = [], size
                while room:
                    piece = window.pop(0)
                    if len(piece) > room:
                        piece, tail = piece.split(room)
                        window.insert(0, tail)
                    part.append(piece)
                    room -= len(piece)
                rows += self._rows(part)
        return rows


def pack_documents(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    encode: gives texts' ids as little-endian unsigned 32-bit integers; end_id follows each document. capacity: a
    power of two. Each partition packs its own documents, so nothing is shuffled and a lost task gives the same rows
    again. Null and empty texts are the end id alone; repeated rows are packed as rows of their own; texts of any
    length are cut as needed; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, end, schema = Packer(capacity, TaskContext.get().partitionId() << 36), np.array([end_id], "<u4").tobytes(), None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [schema, *[pa.int64()] * 6]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            schema = batch.schema.field(0).type
            for part in sliced(batch, "text", 1_000_000):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(strings(part.column(1)))):
                    rows += packer.add(doc, ids + end)
                if packer.waiting >= POOL:
                    rows += packer.drain(STAY)
                if rows:
                    yield table(rows)
        rows = packer.drain(0)
        if rows:
            yield table(rows)
        del packer, rows
        trim()

    return source.mapInArrow(run, SCHEMA.format(id=kind))


def library_encode(path: str, drops_space: bool) -> Callable[[list[str]], list[bytes]]:
    """encode() of a tokenizers file, loaded once a worker."""
    return lambda texts: encoder(path, drops_space).encode(texts)
