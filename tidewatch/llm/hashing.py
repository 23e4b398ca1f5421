"""Words of texts as 64-bit hashes, and word shingles, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of a shingle.
WIDTH = 5


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class WordHashes:
    """One entry a word: hash, hash of its first `prefix` bytes, and the number of its text; counts by text."""

    hash: np.ndarray
    prefix: np.ndarray
    text: np.ndarray
    counts: np.ndarray


def word_hashes(texts: list[bytes], prefix: int = 0) -> WordHashes:
    """Words are runs of bytes outside [\x20\x09-\x0D]; they are hashed as they stand."""
    n = len(texts)
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    solid = ~_WHITE[buf]
    place = np.flatnonzero(solid)
    if not len(place):
        empty = np.empty(0, np.uint64)
        return WordHashes(empty, empty, np.empty(0, np.int64), np.zeros(n, np.int64))
    new = np.ones(len(place), bool)
    new[1:] = np.diff(place) > 1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(place)))
    within = np.arange(len(place)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _POWER, np.uint64))
    value = _BYTE[buf[place]] * powers[within]
    whole = mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    text = np.searchsorted(begins, place[first], side="right") - 1
    short = mixed(np.add.reduceat(np.where(within < prefix, value, np.uint64(0)), first)) if prefix else whole[:0]
    return WordHashes(whole, short, text, np.bincount(text, minlength=n))


def shingles(words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of their text) of all runs of WIDTH words of each text, in order; a text with fewer words gives
    its whole sequence as one, a text without words gives none."""
    w, text = words.hash, words.text
    runs = max(0, len(w) - WIDTH + 1)
    total = np.zeros(runs, np.uint64)
    for j in range(WIDTH):
        total += w[j : j + runs] * _PLACE[j]
    full = text[:runs] == text[WIDTH - 1 :] if runs else np.empty(0, bool)
    few = np.flatnonzero((words.counts > 0) & (words.counts < WIDTH))
    out, owner = [mixed(total[full])], [text[:runs][full]]
    if len(few):
        first = np.cumsum(words.counts) - words.counts
        part = np.zeros(len(few), np.uint64)
        for j in range(WIDTH - 1):
            have = words.counts[few] > j
            part[have] += w[first[few][have] + j] * _PLACE[j]
        out.append(mixed(part + words.counts[few].astype(np.uint64) * _PLACE[5]))
        owner.append(few)
    return np.concatenate(out), np.concatenate(owner)
