"""Pair merges of a tokenizers BPE file for many words at once.

All words of a batch lie end to end as symbols. In each round every word merges its pair of the lowest rank, the
leftmost of equals, as the library does; words without a pair that merges leave with their ids.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: itself where it prints, else the next from U+0100 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class PairMerges:
    """Ranks of the pairs of a file, in a hash table of parallel arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.suffix] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = len(vocab)
        self._fill([vocab[a] * self.width + vocab[b] for a, b in pairs])

    def _fill(self, keys: list[int]) -> None:
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, np.int32)
        left = np.unique(np.array(keys, np.int64), return_index=True)  # of equal pairs the first counts
        key, rank, self.probes = left[0], left[1], 0
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.ranks[slot[first]] = key[first], rank[first]
            rest = np.setdiff1d(np.arange(len(key)), first, assume_unique=True)
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it doesn't merge."""
        key = a * self.width + b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], _NONE)
        for _ in range(self.probes - 1):
            open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] >= 0))
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = open_[self.keys[slot[open_]] == key[open_]]
            out[hit] = self.ranks[slot[hit]]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        code = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size) - 1
        symbol = self.inner[code]
        symbol[ends] = self.last[code[ends]]
        rank = np.full(len(symbol), _NONE, np.int32)  # of each symbol with the next one of its word
        inside = np.ones(len(symbol), bool)
        inside[ends] = False
        at = np.flatnonzero(inside)
        rank[at] = self.rank(symbol[at], symbol[at + 1])
        place, out = np.arange(len(words)), [b""] * len(words)
        while len(place):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, first)
            done = np.flatnonzero(least == _NONE)
            if len(done):
                taken = np.repeat(least == _NONE, size)
                ids, n = symbol[taken].astype("<u4").tobytes(), 4 * size[done]
                for k, b, m in zip(place[done].tolist(), np.cumsum(n).tolist(), n.tolist()):
                    out[k] = ids[b - m : b]
                live = least != _NONE
                symbol, rank, size, place, least = symbol[~taken], rank[~taken], size[live], place[live], least[live]
                if not len(place):
                    break
                first = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(least, size))
            word = np.searchsorted(first, hits, side="right") - 1
            new = np.ones(len(hits), bool)
            new[1:] = word[1:] != word[:-1]
            hits = hits[new]  # the leftmost of each word
            symbol[hits] = self.merged[least]
            stay = np.ones(len(symbol), bool)
            stay[hits + 1] = False
            symbol, rank, size = symbol[stay], rank[stay], size - 1
            hits -= np.arange(len(hits))  # one symbol left before each word
            first = np.cumsum(size) - size
            tail = hits == first + size - 1
            rank[hits[tail]] = _NONE
            go = hits[~tail]
            rank[go] = self.rank(symbol[go], symbol[go + 1])
            back = hits[hits > first]
            rank[back - 1] = self.rank(symbol[back - 1], symbol[back])
        return out
