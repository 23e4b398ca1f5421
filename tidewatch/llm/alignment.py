"""Cross-tokenizer alignment: where the tokens of a byte-level model (A) and of a piece model (B) end together.

Both code the same bytes, a space and the text. The documents of a whole Arrow batch are set end to end, each with its
byte offset; the ends of all A tokens and of all B tokens are counted by byte once (bincount), and the batch is cut
wherever both kinds end. Prefix sums over the cuts, read at the documents' offsets, give each document's groups, and
the places of its tokens among them.

A token's bytes end where the other's do, so one of a linked pair's byte strings is a suffix of the other's: the longer
token and the length of the shorter one name the pair. That bounds the different pairs by the bytes of the two
vocabularies, whatever the corpus; a link is its pair's number, and the corpus-wide counts of the pairs are an array that
can be sent everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import sliced, strings, written
from tidewatch.llm.library_encoding import LibraryEncoder, byte_of

ALIGNED = "id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary"
#: Bytes of text that are aligned at once.
PIECE = 500_000


def _keeps_bytes(model) -> bool:
    """Whether a piece model's pieces spell its input, a space before it, whatever it is: nothing is normalised, and there
    is a piece for each byte. Only U+2581 reads as a space then."""
    try:
        from sentencepiece import sentencepiece_model_pb2 as proto
    except ImportError:  # its package for such files isn't there: every text is compared
        return False
    spec = proto.ModelProto.FromString(model.serialized_model_proto()).normalizer_spec
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    return plain and sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


class Aligner:
    """Both tokenizers, the bytes of their tokens, and numbers of all pairs that can end together. Special tokens' strings in
    a text are plain text."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a, self.b = LibraryEncoder(byte_path, False, special_is_text=True), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of, special = byte_of(), {t.content for t in self.a.tokenizer.get_added_tokens_decoder().values()}
        names = [self.a.tokenizer.id_to_token(i) for i in range(self.a.tokenizer.get_vocab_size())]
        self.a_bytes = [t.encode() if t in special else bytes(of[c] for c in t) for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.is_byte)]
        # A byte-level model without a normaliser that knows each byte spells its input.
        self.a_exact = self.a.tokenizer.normalizer is None and len({x for x in self.a_bytes if len(x) == 1}) == 256
        self.b_exact = _keeps_bytes(self.b)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # A byte piece and a plain one may hold the same byte; other than that a side's tokens differ in their bytes.
        self.twin = np.array(self.is_byte, np.int64)
        self.by_a = np.cumsum(2 * self.a_size) - 2 * self.a_size
        self.by_b = 2 * self.a_size.sum() + np.cumsum(self.b_size) - self.b_size
        #: Numbers of pairs: all of an A token with its suffixes, then all of a B token with its shorter suffixes.
        self.pairs = int(2 * self.a_size.sum() + self.b_size.sum())
        #: What a token adds to a document's string: its number and what follows, at 2 * id, and 2 * id + 1 at a group's end.
        self.printed = [b"%d%s" % (i, end) for side, last in ((self.a_bytes, b"|"), (self.b_bytes, b";")) for i in range(len(side)) for end in (b",", last)]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair of ids of which one's bytes end with the other's."""
        n, m = self.a_size[a], self.b_size[b]
        return np.where(m <= n, self.by_a[a] + 2 * (m - 1) + self.twin[b], self.by_b[b] + n - 1)

    def second(self, pairs: np.ndarray) -> np.ndarray:
        """The B id of each pair."""
        plain, byte = ({x: i for i, x in enumerate(self.b_bytes) if self.is_byte[i] == kind} for kind in (False, True))
        out = np.searchsorted(self.by_b, pairs, side="right") - 1
        for k in np.flatnonzero(pairs < self.by_b[0]).tolist():
            a = int(np.searchsorted(self.by_a, pairs[k], side="right")) - 1
            size, twin = divmod(int(pairs[k] - self.by_a[a]), 2)
            out[k] = (byte if twin else plain)[self.a_bytes[a][-size - 1 :]]
        return out

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """(n_a, n_b, n_groups, groups_sha256, links) of each text; links are numbers of pairs, in order."""
        out: list[tuple[int, int, int, str, bytes]] = [(0, 0, 0, "", b"")] * len(texts)
        whole = [k for k, t in enumerate(texts) if t]
        a_ids = [np.frombuffer(x, "<u4") for x in self.a.encode([" " + texts[k] for k in whole])]
        b_ids = self.b.encode([texts[k] for k in whole], num_threads=1)
        kept, ends = [], [0]
        for n, k in enumerate(whole):
            text = (" " + texts[k]).encode()
            if (self.a_exact or b"".join(map(self.a_bytes.__getitem__, a_ids[n].tolist())) == text) and (self.b_exact and "▁" not in texts[k] or b"".join(map(self.b_bytes.__getitem__, b_ids[n])) == text):
                kept.append(n)
                ends.append(ends[-1] + len(text))
        if not kept:
            return out
        n_a, n_b = [len(a_ids[n]) for n in kept], [len(b_ids[n]) for n in kept]
        a = np.concatenate([a_ids[n] for n in kept]).astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_ids[n] for n in kept), np.int64, sum(n_b))
        a_end, b_end, offsets = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.array(ends)
        cut = (np.bincount(a_end, minlength=ends[-1] + 1) > 0) & (np.bincount(b_end, minlength=ends[-1] + 1) > 0)
        before = np.cumsum(cut)  # cuts up to and with each byte
        groups = np.diff(before[offsets])
        a_last, b_last = cut[a_end], cut[b_end]
        links = self.pair(a[a_last], b[b_last]).astype("<u4")
        # Groups one after the other, in each the A tokens first.
        a_group, b_group = before[a_end - self.a_size[a]], before[b_end - self.b_size[b]]
        a_count, b_count = (np.bincount(g, minlength=int(before[-1])) for g in (a_group, b_group))
        printed = np.empty(len(a) + len(b), np.int64)
        printed[np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_group]] = 2 * a + a_last
        printed[np.arange(len(b)) + np.cumsum(a_count)[b_group]] = 2 * (len(self.a_bytes) + b) + b_last
        codes, at, first = printed.tolist(), 0, 0
        for n, x, y, g in zip(kept, n_a, n_b, groups.tolist()):
            line = b"".join(map(self.printed.__getitem__, codes[at : at + x + y]))[:-1]
            out[whole[n]] = (x, y, g, hashlib.sha256(line).hexdigest(), links[first : first + g].tobytes())
            at, first = at + x + y, first + g
        return out


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One aligner a process."""
    return Aligner(byte_path, piece_path)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, groups_sha256 and links (numbers of pairs, little-endian unsigned 32-bit) of each row.

    Null and empty texts, and texts whose tokens' joined bytes of either kind differ from space and text, have no tokens:
    counts 0 and an empty string. Texts of any length are coded whole; repeated rows get equal rows; an empty table gives
    no rows; ids may be null; only id and text are read, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        for batch in batches:
            for part in sliced(batch, "text", PIECE):
                found = [pa.array(c, t) for c, t in zip(zip(*both.align(strings(part.column(1)))), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, pairs: int) -> np.ndarray:
    """How many links of all documents hold each pair: a row a pair and task, summed, at most one a pair in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(pairs, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=pairs)
        have = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(counts[have])], names=["pair", "n"])

    found = aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(pairs, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def scored(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A pair's count is the number of links of all documents that hold it; n_best are the links whose count is the highest
    of their B id, ties included; count_sum sums the counts of the row's links. Tokens have a byte at least, so each end
    that both share is one link. Other cases as in `align_documents`. The aligned documents are a table in the scratch
    folder that the result reads."""
    both = aligner(byte_path, piece_path)
    aligned = written(align_documents(docs, byte_path, piece_path, id_col, text_col), "aligned")
    counts = pair_counts(aligned, both.pairs)
    have = np.flatnonzero(counts)
    of_b, top = both.second(have), np.zeros(len(both.b_bytes), np.int64)
    np.maximum.at(top, of_b, counts[have])
    highest = np.zeros(both.pairs, bool)
    highest[have] = counts[have] == top[of_b]
    shared = docs.sparkSession.sparkContext.broadcast((counts, highest))  # a number for each possible pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            raw = batch.column(5).to_pylist()
            links = np.frombuffer(b"".join(raw), "<u4")
            ends = np.append(0, np.cumsum([len(x) // 4 for x in raw]))
            sums = [np.append(0, np.cumsum(x[links], dtype=np.int64)) for x in (best, count)]
            n_best, total = (np.diff(s[ends]) for s in sums)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(ends)), pa.array(n_best), pa.array(total), batch.column(4)], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.mapInArrow(run, "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
