"""Vectorised pre-tokenisation without a regular expression.

Every code point gets a class; a small automaton reads the classes. Its transition functions form a finite monoid, so
the state before every character comes from an associative scan over function numbers with one composition table.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, BLANK, SPACE, OTHER, CLITIC2, CLITIC3 = range(7)
#: States: nothing pending, after one blank, in letters, in numbers, in others, one and two letters of a clitic to come.
FRESH, PENDING, LETTERS, NUMBERS, OTHERS, ONE, TWO = range(7)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Characters of a scan block: the scan runs over columns of blocks, then over the blocks.
BLOCK = 256


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    table[kinds == ord("L")] = LETTER
    table[kinds == ord("N")] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    table[0x20] = BLANK
    return table


def _step(state: int, symbol: int) -> int:
    if symbol == LETTER:
        return {TWO: ONE, ONE: FRESH}.get(state, LETTERS)
    if symbol in (CLITIC2, CLITIC3) and state in (FRESH, LETTERS, NUMBERS):
        return ONE if symbol == CLITIC2 else TWO
    return {NUMBER: NUMBERS, BLANK: PENDING, SPACE: FRESH}.get(symbol, OTHERS)


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each symbol's transition function, composition table, value of each function at FRESH).

    Symbols 7 to 13 are the same at the start of a text: they forget the state before them.
    """
    base = [tuple(_step(s, x) for s in range(7)) for x in range(7)]
    gens = base + [(f[FRESH],) * 7 for f in base]
    number = {tuple(range(7)): 0}
    todo = [tuple(range(7))]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    funcs = list(number)
    table = np.array([[number[tuple(g[x] for x in f)] for g in funcs] for f in funcs], np.uint16)
    return np.array([number[g] for g in gens], np.uint16), table, np.array([f[FRESH] for f in funcs], np.uint8)


def _scan(ids: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive scan: at i the number of the composition of functions 0..i. Associative, so blocks scan alone first."""
    n, size = len(ids), compose.shape[0]
    flat = compose.ravel()
    width = min(BLOCK, max(1, n))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = flat[grid[j - 1].astype(np.int32) * size + grid[j]]
    if rows > 1:
        before = np.concatenate([[0], _scan(grid[-1], compose)[:-1]]).astype(np.int32) * size
        grid = flat[before[None, :] + grid]
    return grid.T.reshape(-1)[:n]


def boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """Places in `text` (texts set end to end, each from one of the ascending `starts`) where a piece begins."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    symbol = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = True
    first[n] = True
    marks = np.flatnonzero(cp == 0x27)
    if len(marks):
        at = lambda k: np.where(marks + k < n, cp[np.minimum(marks + k, n - 1)], 0)
        same1 = ~first[np.minimum(marks + 1, n)]
        same2 = same1 & ~first[np.minimum(marks + 2, n)]
        a, b = at(1), at(2)
        symbol[marks[same1 & np.isin(a, [ord(c) for c in "stmd"])]] = CLITIC2
        pair = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[marks[same2 & pair]] = CLITIC3
    numbers, compose, value = monoid()
    after = value[_scan(numbers[symbol + np.uint8(7) * first[:n]], compose)]
    state = np.empty(n, np.uint8)
    state[0] = FRESH
    state[1:] = after[:-1]
    state[first[:n]] = FRESH
    white = (symbol == BLANK) | (symbol == SPACE)
    begins = first[:n].copy()
    begins |= ~white & (state == FRESH)
    begins |= (state == LETTERS) & (symbol != LETTER)
    begins |= (state == NUMBERS) & (symbol != NUMBER)
    begins |= (state == OTHERS) & (symbol < OTHER)
    ends = np.empty(n, bool)  # the last white space before a character that isn't
    ends[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    ends[-1] = False
    opens = np.empty(n, bool)  # the first of a run
    opens[0] = white[0]
    opens[1:] = white[1:] & (~white[:-1] | first[1:n])
    begins = np.where(white, opens | ends, begins)
    return np.flatnonzero(begins)
