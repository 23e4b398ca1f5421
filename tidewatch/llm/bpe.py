"""Byte-level BPE encoding and decoding by a rank file.

Pieces come from `pretokenize`; each distinct piece is merged once and kept in a bounded cache as its ids' bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import sliced, strings
from tidewatch.llm.pretokenize import boundaries

#: Pieces that a worker keeps, in two generations; longer pieces aren't kept.
CACHED, LONGEST = 400_000, 64


class Generations(dict):
    """A bounded cache: at half its size the present generation becomes the old one, and what is used again moves on."""

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """The ranks of a file and the merges by them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache = Generations(self._piece)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode()), "<u4").tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a piece: the adjacent pair of the lowest rank merges, the leftmost first, until none has a rank."""
        rank = self.ranks.get(raw)
        if rank is not None:
            return [rank]
        if len(raw) > 400:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get, top = self.ranks.get, len(self.tokens)
        pairs = [get(a + b, top) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == top:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], top)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], top)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap over a linked list, for very long pieces."""
        import heapq

        n, get = len(raw), self.ranks.get
        part: list = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, part[k] + part[after[k]]))
        return [self.ranks[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        cuts = boundaries(joined, starts)
        marks = cuts.tolist()
        pieces = [joined[a:b] for a, b in zip(marks, [*marks[1:], len(joined)])]
        coded = list(map(self.cache.__getitem__, pieces))
        bounds = np.searchsorted(cuts, np.append(starts, len(joined))).tolist()
        return [b"".join(coded[a:b]) for a, b in zip(bounds, bounds[1:])]

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each token in the decoded text, and the text's length last."""
        return np.concatenate([[0], np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, gathered at once by the tokens' offsets."""
        code = np.frombuffer(ids, "<u4")
        size = self.lengths[code]
        at = np.cumsum(size) - size
        return self.blob[np.repeat(self.places[code] - at, size) + np.arange(int(size.sum()))].tobytes()


@lru_cache(maxsize=2)
def model(path: str) -> ByteBpe:
    """One model a worker."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """id, n_tokens, ids (binary, little-endian unsigned 32-bit), and if asked offsets (binary, 64-bit: byte offset of
    each token and the text's length), for every row.

    Null and empty texts have no tokens. Texts of any length are coded whole; repeated rows give equal rows; nothing
    is shuffled, and other columns are not read. `path` must name a file that every machine has.
    """
    fields = [("id", docs.schema[id_col].dataType), ("n_tokens", "long"), ("ids", "binary")] + [("offsets", "binary")] * with_offsets
    schema = ", ".join(f"{k} {t if isinstance(t, str) else t.simpleString()}" for k, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part in sliced(batch, "text", 1_000_000):
                ids = bpe.encode(strings(part.column(1)))
                out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if with_offsets:
                    out.append(pa.array([bpe.offsets(x).astype("<i8").tobytes() for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[k for k, _ in fields])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """`keep`, ids and decoded (binary) for every row of binary ids; null ids decode to nothing."""
    source = encoded.select(*keep, "ids")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in source.schema] + ["decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part in sliced(batch, "ids", 4_000_000):
                ids = part.column(part.num_columns - 1).to_pylist()
                decoded = pa.array([bpe.decode(x or b"") for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return source.mapInArrow(run, schema)
