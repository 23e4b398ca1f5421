"""Simple-8b word-aligned coding of token ids, vectorised over blocks.

A word has a selector in its top four bits and 60 bits of payload: COUNTS[s] values of BITS[s] bits, the first lowest.
Selector ESCAPE stands for one value of over 60 bits: the payload is its place among the block's raw words, which
follow the coded ones. Blocks of BLOCK values start at words of their own, kept as offsets, so all blocks are coded
and decoded side by side.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: how many values a word holds under each selector, and their bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 60])
ESCAPE, BLOCK = 15, 1024
_FIT = 13  # selectors 0 to 13 hold values as they are
_LIMITS = np.array([(1 << int(b)) - 1 for b in BITS[: _FIT + 1]], np.uint64)
_NARROWEST = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets[b] is the first word of block b, the last entry the number of words."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK + 64, np.uint64)
    grid[:n] = v
    raw = grid >= np.uint64(1 << 60)
    need = _NARROWEST[np.minimum(grid, np.uint64(0xFFFF)).astype(np.uint16)]  # the narrowest selector that holds it
    large = np.flatnonzero(grid > np.uint64(0xFFFF))
    need[large] = np.searchsorted(_LIMITS, grid[large])
    need[raw] = ESCAPE
    # Widest selectors last: best[i] is the selector that takes most values from i on.
    best = np.where(raw, ESCAPE, _FIT).astype(np.uint8)
    widest, have = need, 1
    for s in range(_FIT - 1, -1, -1):
        count = int(COUNTS[s])
        while have < count:
            step = min(have, count - have)
            widest = np.append(np.maximum(widest[:-step], widest[step:]), widest[-step:])
            have += step
        np.copyto(best, np.uint8(s), where=widest <= s)
    jump = COUNTS[best]
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    at, live, steps = np.arange(blocks) * BLOCK, np.arange(blocks), []
    while len(live):
        steps.append((live, at[live]))
        at[live] += jump[at[live]]
        live = live[at[live] < ends[live]]
    owner, where = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    coded = np.bincount(owner, minlength=blocks)
    escaped = best[where] == ESCAPE
    extra = np.bincount(owner[escaped], minlength=blocks)
    offsets = np.concatenate([[0], np.cumsum(coded + extra)])
    place = np.arange(len(where)) - np.repeat(np.cumsum(coded) - coded, coded) + offsets[owner]
    words = np.zeros(offsets[-1], np.uint64)
    limit = ends[owner]
    for s in np.unique(best[where]):
        rows = np.flatnonzero(best[where] == s)
        if s == ESCAPE:
            rank = np.arange(len(rows)) - np.repeat(np.cumsum(extra) - extra, extra)
            words[place[rows]] = np.uint64(ESCAPE << 60) | rank.astype(np.uint64)
            words[offsets[owner[rows]] + coded[owner[rows]] + rank] = grid[where[rows]]
            continue
        lane = where[rows][:, None] + np.arange(COUNTS[s])
        took = np.where(lane < limit[rows][:, None], grid[lane], 0).astype(np.uint64)
        payload = np.bitwise_or.reduce(took << (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64), axis=1)
        words[place[rows]] = payload | np.uint64(int(s) << 60)
    return words, offsets.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values that encode() got."""
    out = np.empty(n, np.uint64)
    if not n:
        return out
    words, offsets = np.asarray(words, np.uint64), np.asarray(offsets, np.int64)
    blocks = len(offsets) - 1
    size = np.minimum(np.full(blocks, BLOCK), n - np.arange(blocks) * BLOCK)
    select = (words >> np.uint64(60)).astype(np.int64)
    owner = np.repeat(np.arange(blocks), np.diff(offsets))
    held = COUNTS[select]
    before = np.cumsum(held) - held
    before -= before[offsets[:-1]][owner]  # values of the block before this word; raw words stand past its size
    coded = before < size[owner]
    start = owner * BLOCK + before
    for s in np.unique(select[coded]):
        rows = np.flatnonzero(coded & (select == s))
        if s == ESCAPE:
            last = np.bincount(owner[coded], minlength=blocks)
            out[start[rows]] = words[offsets[owner[rows]] + last[owner[rows]] + (words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        values = (words[rows][:, None] >> (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        lane = start[rows][:, None] + np.arange(COUNTS[s])
        fits = lane < (owner[rows] * BLOCK + size[owner[rows]])[:, None]
        out[lane[fits]] = values[fits]
    return out
