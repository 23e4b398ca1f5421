"""Exact set-similarity joins over word-shingle sets at Jaccard 0.8: what the line and the document join share.

1. `token_sets`: each scan partition turns its texts into sets of 56-bit shingle hashes, in blocks; equal sets of a
   block collapse to one. Tokens leave sorted and cut into buckets of the hash range, packed as delta bytes: each
   distinct token of a block once, with how many of its sets hold it, and which.
2. Each bucket counts how many sets hold each of its tokens and sends back those that two or more hold. A token that
   one set alone holds cannot match anything, and it is never looked at again.
3. Each block puts its sets together again. A set with less than 0.8 of its tokens shared can't be similar to any
   other, whatever the order: only the rest (`tokens` not null) enter the join.

There are SHARE buckets for each scan partition, so a bucket's size doesn't grow with the table. A token that HOT sets
of a block or more hold is one number a block in its bucket; which sets hold it goes straight to the block. So a token
that all documents hold costs its bucket a few bytes a block. No pair of sets is formed here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, free_shuffles, partitions, power_of_two, sliced, strings, trim, written
from tidewatch.llm.hashing import mixed, shingles, word_hashes

#: Similarity as a ratio of integers: 100 * overlap >= 80 * union.
PERCENT = 80
#: Bits of a token. Two shingles of one text of n fall together once in 2**57 / n**2 texts.
TOKEN_BITS = 56
#: Sets and tokens of a block at most; sets are numbered in two bytes.
BLOCK_SETS, BLOCK_TOKENS = 60_000, 2_000_000
#: Bytes of text that are hashed at once (one text at least).
PIECE = 4_000_000
#: Buckets for each scan partition; sets of a block that make a token hot there; sets in a header row.
SHARE, HOT, HEADER = 8, 64, 4096
#: Rows of one key that are too many for one task, and how many such keys are told apart (the most frequent).
HOT_ROWS, HOT_KEYS = 100_000, 10_000
#: Kinds of a row: sets of a block, owners of its hot tokens, tokens of a bucket.
SETS, OWNERS, TOKENS = 0, 1, 2
_MAP = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("tokens", pa.binary()), ("held", pa.binary()), ("owner", pa.binary()), ("df", pa.binary()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("reps", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("sigs", pa.list_(pa.binary()))])
_MAP_DDL = "bucket bigint, block bigint, kind int, at bigint, tokens binary, held binary, owner binary, df binary, ids array<bigint>, parts array<bigint>, reps array<int>, sizes array<bigint>, sigs array<binary>"
SETS_DDL = "id bigint, part bigint, sig binary, size bigint, ids array<bigint>, parts array<bigint>, tokens binary, dfs binary"
_SETS = pa.schema([("id", pa.int64()), ("part", pa.int64()), ("sig", pa.binary()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("tokens", pa.binary()), ("dfs", pa.binary())])


def least_overlap(size: int) -> int:
    """The fewest tokens that a set shares with any similar one: 0.8 of its own, rounded up."""
    return -(-PERCENT * size // 100)


def pack(tokens: np.ndarray) -> bytes:
    """Ascending values as bytes of their differences, the bytes of one weight together: they compress."""
    delta = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel())


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def distinct_tokens(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, owner) without repeats, by owner and token. Eight bits of the owner and the token are one number, so
    that 256 sets are sorted at a time."""
    tokens, group = hashes >> np.uint64(64 - TOKEN_BITS), owner >> 8
    key = ((owner & 255).astype(np.uint64) << np.uint64(TOKEN_BITS)) | tokens
    if len(group) and group.max() > 0:
        order = np.argsort(group, kind="stable")
        key, group = key[order], group[order]
    cuts = np.searchsorted(group, np.arange(int(group[-1]) + 2 if len(group) else 1)).tolist()
    new = np.ones(len(key), bool)
    for i, j in zip(cuts, cuts[1:]):
        key[i:j].sort()
        new[i + 1 : j] = key[i + 1 : j] != key[i : j - 1]
    key, group = key[new], group[new]
    return key & np.uint64((1 << TOKEN_BITS) - 1), (group << 8) + (key >> np.uint64(TOKEN_BITS)).astype(np.int64)


class _Block:
    """Sets that wait to leave together."""

    def __init__(self, number: int, bits: int):
        self.number, self.bits = number, bits
        self.ids: list[int] = []
        self.parts: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.total = 0

    def add(self, ids: list[int], parts: list[int], texts: list[bytes]) -> None:
        tokens, owner = distinct_tokens(*shingles(word_hashes(texts)))
        self.tokens.append(tokens)
        self.owners.append(owner + len(self.ids))
        self.sizes.append(np.bincount(owner, minlength=len(texts)))
        self.ids += ids
        self.parts += parts
        self.total += len(tokens)

    def _rows(self, **columns: list) -> pa.RecordBatch:
        n = len(columns["bucket"])
        whole = {f.name: columns.get(f.name, [None] * n) for f in _MAP} | {"block": [self.number] * n}
        return pa.RecordBatch.from_pydict(whole, schema=_MAP)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The block's sets, then its tokens by bucket. Of equal sets the one of the smallest id and part leads."""
        tokens, owner, sizes = np.concatenate(self.tokens), np.concatenate(self.owners).astype(np.int64), np.concatenate(self.sizes)
        n, home = len(sizes), int(mixed(np.array([self.number], np.uint64))[0]) % (1 << self.bits)  # blocks' rows spread over all buckets
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(np.append(f(tokens), np.uint64(0)), np.minimum(first, len(tokens))) * (sizes > 0) for f in (mixed, lambda x: mixed(x ^ np.uint64(0x5851F42D4C957F2D)))]
        sigs = np.stack([x.astype("<u8") for x in sums], axis=1).tobytes()
        keys = np.lexsort((np.array(self.parts), np.array(self.ids), sums[1], sums[0]))
        same = np.zeros(n, bool)
        same[1:] = (sums[0][keys][1:] == sums[0][keys][:-1]) & (sums[1][keys][1:] == sums[1][keys][:-1])
        lead = keys[np.maximum.accumulate(np.where(same, 0, np.arange(n)))]
        reps = np.empty(n, np.int64)
        reps[keys] = lead
        for i in range(0, n, HEADER):
            j = min(n, i + HEADER)
            yield self._rows(bucket=[home], kind=[SETS], at=[i], ids=[self.ids[i:j]], parts=[self.parts[i:j]], reps=[reps[i:j]], sizes=[sizes[i:j]], sigs=[[sigs[16 * k : 16 * k + 16] for k in range(i, j)]])
        alone = reps[owner] == owner
        tokens, owner = tokens[alone], owner[alone]
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order].astype("<u2")
        start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
        held = np.diff(np.append(start, len(tokens))).astype("<u4")
        tokens, hot = tokens[start], held >= HOT
        if hot.any():
            mine = np.repeat(hot, held)
            yield self._rows(bucket=[home], kind=[OWNERS], at=[0], tokens=[pack(tokens[hot])], held=[held[hot].tobytes()], owner=[owner[mine].tobytes()])
            owner = owner[~mine]
        before = np.append(0, np.cumsum(np.where(hot, 0, held).astype(np.int64)))
        edges = np.searchsorted(tokens, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(TOKEN_BITS - self.bits)) if self.bits else np.empty(0, np.int64)
        cuts = [(b, i, j) for b, (i, j) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(tokens)])) if j > i]
        for k in range(0, len(cuts), 64):
            some = cuts[k : k + 64]
            yield self._rows(
                bucket=[b for b, _, _ in some], kind=[TOKENS] * len(some), at=[0] * len(some), tokens=[pack(tokens[i:j]) for _, i, j in some],
                held=[held[i:j].tobytes() for _, i, j in some], owner=[owner[before[i] : before[j]].tobytes() for _, i, j in some],
            )


def _packed(rows: pa.Table, name: str, kind: str, where: list[int]) -> list[np.ndarray]:
    column = rows.column(name)
    return [np.frombuffer(column[i].as_py(), kind) for i in where]


def _count(with_df: bool) -> Callable[[pa.Table], pa.Table]:
    """A bucket: tokens that two sets or more hold, with the number of the sets, back to the blocks of those sets."""

    def run(rows: pa.Table) -> pa.Table:
        kinds, blocks = rows.column("kind").to_pylist(), rows.column("block").to_pylist()
        have = [i for i, k in enumerate(kinds) if k == TOKENS]
        passed = rows.filter(pa.array([k != TOKENS for k in kinds], pa.bool_()))
        if not have:
            return passed
        tokens = [unpack(x) for x in (rows.column("tokens")[i].as_py() for i in have)]
        held, own = _packed(rows, "held", "<u4", have), _packed(rows, "owner", "<u2", have)
        everything = np.concatenate(tokens)
        everything.sort()
        start = np.flatnonzero(np.append(True, everything[1:] != everything[:-1]))
        different = everything[start]
        total = np.diff(np.append(start, len(everything)))  # blocks that hold it, then what they hold beyond one set
        many = [h > 1 for h in held]
        more = np.searchsorted(different, np.concatenate([t[m] for t, m in zip(tokens, many)]))
        total = total + np.bincount(more, weights=np.concatenate([h[m] for h, m in zip(held, many)]) - 1.0, minlength=len(different)).astype(np.int64)
        shared, df = different[total > 1], total[total > 1]
        out = {f.name: [] for f in _MAP}
        for i, t, h, o in zip(have, tokens, held, own):
            at = np.minimum(np.searchsorted(shared, t), max(0, len(shared) - 1))
            hit = shared[at] == t if len(shared) else np.zeros(len(t), bool)
            if hit.any():
                row = {"bucket": 0, "block": blocks[i], "kind": TOKENS, "at": 0, "tokens": pack(t[hit]), "held": h[hit].tobytes(), "owner": o[np.repeat(hit, np.where(h >= HOT, 0, h))].tobytes(), "df": np.minimum(df[at[hit]], 2**32 - 1).astype("<u4").tobytes() if with_df else None}
                for name, column in out.items():
                    column.append(row.get(name))
        trim()
        return pa.concat_tables([passed, pa.Table.from_pydict(out, schema=_MAP)])

    return run


def _gather(all_sets: bool, with_df: bool) -> Callable[[pa.Table], pa.Table]:
    """A block: one row for each different set (all, or those that may have a similar one or have an equal one here)."""

    def run(rows: pa.Table) -> pa.Table:
        kinds, at = rows.column("kind").to_pylist(), rows.column("at").to_pylist()
        heads = sorted((i for i, k in enumerate(kinds) if k == SETS), key=at.__getitem__)
        whole = lambda name: [x for i in heads for x in rows.column(name)[i].as_py()]
        ids, parts, sigs = np.array(whole("ids"), np.int64), np.array(whole("parts"), np.int64), whole("sigs")
        sizes, reps, n = np.array(whole("sizes"), np.int64), np.array(whole("reps"), np.int64), len(ids)
        tokens, owner, df = [], [], []
        hot_token, hot_df = [], []
        have = [i for i, k in enumerate(kinds) if k == TOKENS]
        counts = _packed(rows, "df", "<u4", have) if with_df else [None] * len(have)
        for i, h, o, d in zip(have, _packed(rows, "held", "<u4", have), _packed(rows, "owner", "<u2", have), counts):
            t, hot = unpack(rows.column("tokens")[i].as_py()), h >= HOT
            each = np.where(hot, 0, h)
            tokens.append(np.repeat(t, each))
            owner.append(o)
            df.append(np.repeat(d, each) if with_df else np.zeros(len(o), np.uint32))
            hot_token.append(t[hot])
            hot_df.append(d[hot] if with_df else np.zeros(int(hot.sum()), np.uint32))
        hot_token, hot_df = _joined(hot_token, np.uint64), _joined(hot_df, np.uint32)
        order = np.argsort(hot_token)
        hot_token, hot_df = hot_token[order], hot_df[order]
        for i in (i for i, k in enumerate(kinds) if k == OWNERS):  # hot tokens are shared, so all of them came back
            t, h = unpack(rows.column("tokens")[i].as_py()), np.frombuffer(rows.column("held")[i].as_py(), "<u4")
            tokens.append(np.repeat(t, h))
            owner.append(np.frombuffer(rows.column("owner")[i].as_py(), "<u2"))
            df.append(np.repeat(hot_df[np.searchsorted(hot_token, t)], h))
        tokens, owner, df = _joined(tokens, np.uint64), _joined(owner, "<u2").astype(np.int64), _joined(df, np.uint32)
        count = np.bincount(owner, minlength=n)
        may = (sizes > 0) & (count >= -(-PERCENT * sizes // 100)) & (reps == np.arange(n))
        inside = may[owner]
        tokens, owner, df = tokens[inside], owner[inside], df[inside]
        order = np.lexsort((tokens, df, owner))  # rare tokens first
        tokens, owner, df = tokens[order], owner[order], df[order]
        edges = np.searchsorted(owner, np.arange(n + 1))
        members = np.argsort(reps, kind="stable")
        begin = np.searchsorted(reps[members], np.arange(n + 1))
        keep = np.flatnonzero((reps == np.arange(n)) & (may | all_sets | (np.diff(begin) > 1) & (sizes > 0)))
        cut = lambda a, kind: [a[edges[i] : edges[i + 1]].astype(kind).tobytes() if may[i] else None for i in keep]
        of = lambda a: [a[members[begin[i] : begin[i + 1]]] for i in keep]
        return pa.Table.from_pydict({"id": ids[keep], "part": parts[keep], "sig": [sigs[i] for i in keep], "size": sizes[keep], "ids": of(ids), "parts": of(parts), "tokens": cut(tokens, "<u8"), "dfs": cut(df, "<u4") if with_df else [None] * len(keep)}, schema=_SETS)

    return run


Explode = Callable[[pa.RecordBatch], tuple[list[int], list[int], list[bytes]]]


def token_sets(source: DataFrame, explode: Explode, all_sets: bool, with_df: bool) -> DataFrame:
    """A row for each different set of a block, of the sets that `explode` makes of each batch: ids, parts, and texts.

    id, part: the smallest of those that have the set; ids, parts: all of them, repeated rows too. sig tells sets apart
    (128 bits, the same for equal sets of all blocks). tokens (binary, rare first) and dfs are null unless the set may
    have a similar one. all_sets: every set; else only those that may, and those with an equal one in the block.
    with_df: dfs are wanted; without, tokens ascend. Written to the scratch folder."""
    bits = power_of_two(SHARE * partitions(source)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        block = _Block(number, bits)
        for batch in batches:
            for some in (part.slice(at, 256) for part in sliced(batch, "text", PIECE) for at in range(0, part.num_rows, 256)):
                ids, parts, texts = explode(some)
                for i in range(0, len(ids), BLOCK_SETS // 2):
                    block.add(ids[i : i + BLOCK_SETS // 2], parts[i : i + BLOCK_SETS // 2], texts[i : i + BLOCK_SETS // 2])
                    if len(block.ids) >= BLOCK_SETS // 2 or block.total >= BLOCK_TOKENS:
                        yield from block.rows()
                        number += 1
                        block = _Block(number, bits)
        if block.ids:
            yield from block.rows()
        del block
        trim()

    packed = source.mapInArrow(run, _MAP_DDL)
    counted = packed.groupBy("bucket").applyInArrow(_count(with_df), _MAP_DDL)
    sets = written(counted.groupBy("block").applyInArrow(_gather(all_sets, with_df), SETS_DDL), "sets")
    free_shuffles(sets.sparkSession)  # the two of the tokens are the largest there are
    return sets


def classes(sets: DataFrame, *packed: str) -> DataFrame:
    """One row for each distinct set that may have a similar one: sig, size, first (smallest id, part), tokens, and
    other packed columns."""
    place = F.struct("id", "part")
    return sets.where(F.col("tokens").isNotNull()).groupBy("sig").agg(F.min(place).alias("first"), F.min("size").alias("size"), *(F.min_by(c, place).alias(c) for c in ("tokens", *packed)))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b of sig) whose sets have 100 * overlap >= 80 * union, counted token by token."""
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("size").alias(f"{c}_size"), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_size", "b_size", "a_tokens", "b_tokens"))):
                overlap = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(100 * overlap >= PERCENT * (n + m - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def exploded(sets: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`keep`, token, df and place (from 0, rare tokens first, counting tokens that the set alone holds) of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = [np.frombuffer(x, "<i8") for x in part.column("tokens").to_pylist()]
                counts = np.array([len(t) for t in tokens])
                rows = np.repeat(np.arange(part.num_rows), counts)
                alone = np.array(part.column("size").to_pylist()) - counts
                place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + alone[rows]
                columns = [part.column(c).take(pa.array(rows)) for c in keep]
                df = np.concatenate([np.frombuffer(x, "<u4") for x in part.column("dfs").to_pylist()]).astype(np.int64) if len(rows) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(tokens) if len(rows) else np.empty(0, np.int64)), pa.array(df), pa.array(place)], names=[*keep, "token", "df", "place"])

    source = sets.select(*dict.fromkeys((*keep, "size", "tokens", "dfs")))
    return source.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keep) + ", token bigint, df bigint, place bigint")


def least(size: Column) -> Column:
    """least_overlap as a column."""
    return F.ceil(size * PERCENT / 100.0)


def band(size: Column) -> Column:
    """Number of a size's length band: sizes of similar sets are in the same band or in neighbouring ones."""
    return F.floor(F.ln(size) / F.ln(F.lit(1.25)))


def bands(size: Column) -> Column:
    """The bands that sizes of sets similar to one of `size` are in."""
    return F.sequence(band(least(size)), band(F.floor(size * 100 / PERCENT)))


def looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The inner join of rows with values (one row a key) by `key`. A key of over HOT_ROWS rows never gathers them in a
    task: the most frequent of such keys, HOT_KEYS at most, have their values sent everywhere; all others are shuffled."""
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n"), key).limit(HOT_KEYS).select(key)
    few = F.broadcast(often.join(values, key))  # HOT_KEYS rows of a few numbers at most
    return rows.join(few, key).unionByName(rows.join(F.broadcast(often), key, "left_anti").join(values, key))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of edges a, b (binary).

    Each round every node takes the smallest label around it and then its label's label, so long chains halve; rounds
    are tables in the scratch folder. A hub's edges and a large component's label are keys that `looked_up` splits. No
    edges give no rows."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        around = looked_up(both, seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = written(labels.join(around, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("old")), "lower")
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = written(looked_up(lower, jump, "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") != F.col("old")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels, lower)
        labels = new
        if not moved:
            discard(both)
            return new.select("node", "component")
