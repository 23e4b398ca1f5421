"""URL filters by a bit-parallel wildcard automaton.

All glob rules share one bit vector of several 64-bit words: bit j of a rule is set while its first j characters are
matched. A step for a character is Shift-And, and wildcards are bits that may stay: `*` on any character but a slash,
`**` on any. Every URL of a batch advances at once, a column of characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import strings


@dataclass(frozen=True)
class UrlRule:
    """Globs over host + path (`*`: all but a slash, `**`: all, `?`: one byte but a slash), a verdict and a rank."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    rank: int


def site_rule(verdict: str, name: str) -> UrlRule:
    """A rule like `example.net/en/`: the host, its subdomains, and paths that start with the rest; longer ones win."""
    return UrlRule(name, verdict, (f"{name}**", f"*.{name}**"), len(name))


#: Fixed values of the contract.
SITE_RULES = (site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/"))
#: The method's own verdicts where no site rule fits: hosts by name, then the default.
HOST_RULES = tuple(UrlRule(g, "block", (g,), 0) for g in ("spam-**", "*.spam-**", "ads.**", "*.ads.**", "tracker.**", "*.tracker.**"))
DEFAULT = "allow"


class Automaton:
    """Masks of rules' globs, W words wide."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        bits = sum(len(units) + 1 for units, _ in parsed)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for units, loops in parsed:
            put = lambda table, bit: np.bitwise_or(table[..., bit // 64], np.uint64(1 << bit % 64), out=table[..., bit // 64])
            put(self.start, at)
            for j, unit in enumerate(units):
                for c in range(256) if unit is None else (unit,):
                    if unit is not None or c != 0x2F:
                        put(self.step[c], at + j + 1)
            for j, everything in loops.items():
                for c in range(256):
                    if everything or c != 0x2F:
                        put(self.stay[c], at + j)
            self.ends.append(((at + len(units)) // 64, np.uint64(1 << (at + len(units)) % 64)))
            at += len(units) + 1

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        """Bytes (None: any but a slash) and, by the number matched before, wildcards (True: slashes too)."""
        units: list[int | None] = []
        loops: dict[int, bool] = {}
        raw, i = glob.encode(), 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                loops[len(units)] = True
                i += 2
            elif raw[i : i + 1] == b"*":
                loops.setdefault(len(units), False)
                i += 1
            else:
                units.append(None if raw[i : i + 1] == b"?" else raw[i])
                i += 1
        return units, loops

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """URLs x globs: which glob matches which whole URL."""
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lengths = np.array([len(urls[i]) for i in order], np.int64)
        state = np.tile(self.start, (len(urls), 1))
        text = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        begins = np.cumsum(lengths) - lengths
        live = len(urls)
        for j in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths[:live], -j, side="left"))  # URLs with a character here come first
            now = text[begins[:live] + j]
            old = state[:live]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[now]) | (old & self.stay[now])
        found = np.empty((len(urls), len(self.ends)), bool)
        for k, (word, bit) in enumerate(self.ends):
            found[order, k] = (state[:, word] & bit) != 0
        return found


def host_of(url: Column) -> Column:
    """After the first `://` up to a slash, question mark, hash or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[UrlRule] = SITE_RULES, own: Sequence[UrlRule] = HOST_RULES, default: str = DEFAULT) -> DataFrame:
    """id, host, path, rule, verdict of every row.

    rule: name of the matching rule of the highest rank (the first of equals), null if none matches; the verdict is its
    own, else that of the first of `own` that matches, else the default. Null URLs and those without `://` have empty
    host and path; repeated rows get equal rows; an empty table gives no rows; other columns are not read. Each row is
    judged alone, nothing is shuffled.
    """
    ranked = sorted(rules, key=lambda r: -r.rank)
    everything = [*ranked, *own]
    globs = [g for r in everything for g in r.globs]
    owner = np.array([k for k, r in enumerate(everything) for _ in r.globs])
    kind = pages.schema[id_col].dataType.simpleString()
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        names = pa.array([r.name for r in ranked] + [None] * (len(own) + 1), pa.string())
        verdicts = pa.array([r.verdict for r in everything] + [default], pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                urls = [(a + b).encode() for a, b in zip(strings(part.column(1)), strings(part.column(2)))]
                hits = automaton.match(urls)
                first = pa.array(np.where(hits.any(axis=1), owner[hits.argmax(axis=1)], len(everything)))
                yield pa.RecordBatch.from_arrays([*part.columns, names.take(first), verdicts.take(first)], names=["id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
