"""Toxicity by maximum-scoring segments.

Words are runs of letters. A word's log-odds of standing in a toxic text come from labelled texts by a chain of
Dirichlet priors: what is known of its first three letters is the prior of its first four, and so on to the whole word,
so a word that was never seen is judged by the longest beginning that was. Each word costs COST, so in harmless text a
running sum falls; a linear-time scan finds all maximal segments, the passages where it rises (Ruzzo and Tompa).

How high the best segment of n harmless words gets by chance follows an extreme-value law: P(S >= x) is about
K n exp(-lambda x). lambda is the root of the words' scores in clean texts, K the location of clean texts' best scores.
A passage counts by how far it is beyond chance, lambda S - ln(K n), and a text's best passage and the sum of its passages
give its probability. Everything that is calibrated was scored by counts that its own fold had no part in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, sliced, strings, written
from tidewatch.llm.hashing import mixed
from tidewatch.llm.pretokenize import LETTER, classes

#: Bounds of the fit: labelled texts (half of each class at most, smallest hashes of the id), and units with the most texts.
SAMPLE, UNITS = 20_000, 1 << 20
#: Folds of the sample, texts that a unit must be in to count, and how many texts a prior is worth.
FOLDS, SUPPORT, STRENGTH = 4, 2, 5.0
#: Beginnings of a word that are units beside the word itself, in letters; letters of a word in a script without spaces.
PREFIXES, UNSPACED = (3, 4, 5, 6, 7, 8, 9), 4
#: What each word costs, in nats; texts are toxic from this probability on.
COST, TOXIC = 1.5, 0.3
#: Letters that are scored at once; steps and edges of the histogram of scores.
PIECE, STEP, EDGE = 1 << 18, 0.05, 20.0
#: First and last code points of letters that are written without spaces (Unicode blocks).
NO_SPACES = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_MULTIPLIER, -1, 2**64)
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(n, PIECE + 1), x, np.uint64)), dtype=np.uint64) for x in (_MULTIPLIER, inverse)]
    return _POWERS


def _lower(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """Words of texts set end to end: number of the text, place there, letters, and the units that it has: a column for each
    beginning and one for the whole word, 0 where it is too short."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    units: np.ndarray


def words_of(texts: list[str]) -> Iterator[Words]:
    """The words of the texts in order, about PIECE letters at a time."""
    cp = np.frombuffer("\n".join(map(_lower, texts)).encode("utf-32-le"), np.uint32)
    begins, ends = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), np.cumsum([len(t) + 1 for t in texts])
    letter, at = classes()[cp] == LETTER, 0
    while at < len(cp):
        end = min(len(cp), at + PIECE)
        while end < len(cp) and letter[end]:
            end += 1
        yield _cut(cp[at:end], letter[at:end], at, begins, ends)
        at = end


def _cut(cp: np.ndarray, letter: np.ndarray, base: int, begins: np.ndarray, ends: np.ndarray) -> Words:
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    dense = np.zeros(len(cp), bool)
    if len(cp) and cp.max() >= NO_SPACES[0][0]:
        for low, high in NO_SPACES:
            dense |= (cp >= low) & (cp <= high)
        dense &= letter
    if dense.any():  # each letter of such a script begins a word
        run = np.cumsum(np.isin(np.arange(len(cp)), start)) - 1
        more = np.flatnonzero(dense & ~np.isin(np.arange(len(cp)), start))
        start, end = np.append(start, more), np.append(end, end[run[more]])
        end = np.where(dense[start], np.minimum(end, start + UNSPACED), end)
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    power, inverse = _powers(len(cp))
    sums = np.append(np.uint64(0), np.cumsum(mixed(cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], dtype=np.uint64))
    size, known = end - start, sums[start]
    units = np.zeros((len(start), len(PREFIXES) + 1), np.uint64)
    for k, n in enumerate(PREFIXES):
        longer = np.flatnonzero(size > n)
        units[longer, k] = mixed((sums[start[longer] + n] - known[longer]) * inverse[start[longer]] + np.uint64(n))
    units[:, -1] = mixed((sums[end] - known) * inverse[start] + np.uint64(1 << 32))
    text = np.searchsorted(ends, start + base, side="right")
    return Words(text, start + base - begins[text], size, units)


@dataclass(frozen=True)
class Counts:
    """Texts of the sample that hold each unit, by ascending unit: toxic and clean ones by fold."""

    units: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray

    def without(self, fold: int) -> Model:
        """The model of the other folds; of all where fold is -1."""
        some = np.array([k != fold for k in range(FOLDS)])
        toxic, clean = self.toxic[:, some].sum(axis=1), self.clean[:, some].sum(axis=1)
        return Model(self.units, toxic, clean, (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2))


@dataclass(frozen=True)
class Model:
    """Toxic and clean texts that hold each unit, and the share of toxic ones among all units' texts."""

    units: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    share: float

    def log_odds(self, words: Words) -> np.ndarray:
        """Each word's log-odds of standing in a toxic text against a clean one: down the chain of its beginnings each
        unit's share of toxic texts has the share of the one before it as its prior."""
        whole, first, back = np.unique(words.units[:, -1], return_index=True, return_inverse=True)
        share, rest = np.full(len(whole), self.share), np.full(len(whole), 1 - self.share)
        for k in range(words.units.shape[1]):
            unit = words.units[first, k]
            at = np.minimum(np.searchsorted(self.units, unit), max(0, len(self.units) - 1))
            hit = np.flatnonzero((self.units[at] == unit) & (unit > 0)) if len(self.units) else at[:0]
            toxic, clean = self.toxic[at[hit]], self.clean[at[hit]]
            # Both shares are kept: down a chain of units with thousands of texts of one class, 1 - share would round to 0.
            share[hit] = (toxic + STRENGTH * share[hit]) / (toxic + clean + STRENGTH)
            rest[hit] = (clean + STRENGTH * rest[hit]) / (toxic + clean + STRENGTH)
        return (np.log(share) - np.log(rest) - math.log(self.share / (1 - self.share)))[back]


def segments(before: list[float], after: list[float]) -> list[tuple[float, int, int]]:
    """(score, first, last) of all maximal segments, in order. The arguments are the running sum before and after each
    item of positive score; what lies between them is in the sums. Linear time: each candidate points to the nearest one
    before it that starts lower, and is merged once at most."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, number of the nearest lower one
    for k, (low, high) in enumerate(zip(before, after)):
        first = k
        near = len(found) - 1
        while True:
            while near >= 0 and found[near][0] >= low:
                near = found[near][4]
            if near < 0 or found[near][1] >= high:
                break
            low, first = found[near][0], found[near][2]
            del found[near:]
            near -= 1
        found.append((low, high, first, k, near))
    return [(high - low, first, last) for low, high, first, last, _ in found]


@dataclass
class Scanned:
    """Of each text: how many words it has; of all texts: the maximal segments, as number of the text, score, first and last
    code point."""

    words: np.ndarray
    text: np.ndarray
    score: np.ndarray
    start: np.ndarray
    end: np.ndarray
    histogram: np.ndarray


def scan(texts: list[str], model: Model, counted: np.ndarray | None = None) -> Scanned:
    """All maximal segments of each text; the histogram is of the scores of the words of the `counted` texts."""
    parts = [(w.text, w.start, w.size, model.log_odds(w) - COST) for w in words_of(texts)]
    text, start, size, score = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))
    bins = int(2 * EDGE / STEP)
    histogram = np.zeros(bins, np.int64)
    if counted is not None:
        at = np.clip((score[counted[text]] + EDGE) / STEP, 0, bins - 1).astype(np.int64)
        histogram = np.bincount(at, minlength=bins)
    up = np.flatnonzero(score > 0)
    sums = np.cumsum(score)[up]
    before, cut = (sums - score[up]).tolist(), np.searchsorted(text[up], np.arange(len(texts) + 1)).tolist()
    sums, found = sums.tolist(), []
    for t, (i, j) in enumerate(zip(cut, cut[1:])):
        found += [(t, s, i + a, i + b) for s, a, b in segments(before[i:j], sums[i:j])]
    own = np.array([f[0] for f in found], np.int64)
    first, last = (up[np.array([f[k] for f in found], np.int64)] for k in (2, 3))
    return Scanned(np.bincount(text, minlength=len(texts)), own, np.array([f[1] for f in found]), start[first], start[last] + size[last], histogram)


@dataclass(frozen=True)
class Scorer:
    """The model, the extreme-value law of clean texts, and the weights of (1, best passage, sum of passages)."""

    model: Model
    rate: float
    location: float
    weights: tuple[float, float, float]

    def beyond(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How far a segment's score is beyond the best one that so many clean words have by chance: lambda S - ln(K n)."""
        return np.minimum(self.rate * score - np.log(np.maximum(words, 1)) - self.location, 50.0)

    def evidence(self, words: np.ndarray, text: np.ndarray, score: np.ndarray) -> np.ndarray:
        """(1, best passage, sum of passages beyond chance) of each text."""
        best = np.zeros(len(words))
        np.maximum.at(best, text, score)
        passed = np.maximum(self.beyond(score, words[text]), 0)
        return np.stack([np.ones(len(words)), self.beyond(best, words), np.log1p(np.bincount(text, weights=passed, minlength=len(words)))], axis=1)

    def probability(self, found: Scanned) -> np.ndarray:
        margin = self.evidence(found.words, found.text, found.score) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _rate(histogram: np.ndarray) -> float:
    """lambda: where the mean of exp(lambda * score) over clean words is 1."""
    value = (np.arange(len(histogram)) + 0.5) * STEP - EDGE
    share = histogram / max(1, histogram.sum())
    if not histogram.any() or not share[value > 0].any() or (share * value).sum() >= 0:
        return 1.0
    low, high = 1e-3, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(np.minimum(middle * value, 500))).sum() < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton's method, with a small ridge."""
    w = np.zeros(3)
    if len(np.unique(y)) == 2:
        w[0] = math.log((weight * y).sum() / (weight * (1 - y)).sum())
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (weight * (p - y)) + ridge * w * (0, 1, 1)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[DataFrame, tuple[float, float]]:
    """text, toxic, fold of at most sample / 2 texts of each class; and how many texts one of each (clean, toxic) stands for."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    have = docs.select(F.col(id_col).alias("id")).distinct()
    marks = marks.join(have, "id", "left_semi")
    total = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    half = lambda y: marks.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2)
    chosen = half(0).unionByName(half(1))
    fold = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic", fold)
    return rows, tuple(max(1.0, total.get(y, 0) / max(1, sample // 2)) for y in (0, 1))


def counted(table: DataFrame) -> Counts:
    """How many texts (columns text, toxic, fold) of each class and fold hold each unit; units of less than SUPPORT texts are left out."""
    names = [f"{kind}{k}" for kind in ("toxic", "clean") for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", 4_000_000):
                column = np.array(part.column(2).to_pylist()) + FOLDS * (np.array(part.column(1).to_pylist()) == 0)
                cells = []
                for w in words_of(strings(part.column(0))):
                    own, unit = np.nonzero(w.units)
                    cells.append(np.unique(np.stack([w.units[own, unit], w.text[own].astype(np.uint64)]), axis=1) if len(own) else np.empty((2, 0), np.uint64))
                both = np.concatenate([np.empty((2, 0), np.uint64), *cells], axis=1)
                both = both[:, np.lexsort(both)]
                new = np.ones(both.shape[1], bool)
                new[1:] = (np.diff(both[0]) != 0) | (np.diff(both[1]) != 0)  # a piece may end inside a text
                unit, of = both[0][new], column[both[1][new].astype(np.int64)] if new.any() else np.empty(0, np.int64)
                whole, back = np.unique(unit, return_inverse=True)
                table = np.bincount(back * 2 * FOLDS + of, minlength=len(whole) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), *(pa.array(table[:, k].astype(np.int32)) for k in range(2 * FOLDS))], names=["unit", *names])

    found = table.mapInArrow(run, "unit bigint, " + ", ".join(f"{n} int" for n in names)).groupBy("unit").agg(*(F.sum(n).alias(n) for n in names))
    texts = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    kept = found.where(texts >= SUPPORT).orderBy(F.desc(texts), "unit").limit(UNITS).toArrow()
    unit = kept.column(0).to_numpy().view(np.uint64)
    order = np.argsort(unit)
    of = lambda ns: np.stack([kept.column(n).to_numpy()[order] for n in ns], axis=1)
    return Counts(unit[order], of(names[:FOLDS]), of(names[FOLDS:]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """Learns from the labelled ones (labels: doc_id, toxic; null labels are none, of several the highest counts) among docs,
    of each class at most sample / 2, those of the smallest id hashes. Each is scored by what the other folds counted, and
    from those scores come the law of clean texts and the weights. Without labels every text has one half."""
    rows, stands_for = _sample(docs, labels, id_col, text_col, sample)
    table = written(rows, "toxic")
    counts = counted(table)
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # UNITS rows of FOLDS counts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, Model] = {}
        for batch in batches:
            for part in sliced(batch, "text", 1_000_000):
                texts, toxic, fold = strings(part.column(0)), np.array(part.column(1).to_pylist()), np.array(part.column(2).to_pylist())
                for k in np.unique(fold).tolist():
                    own = np.flatnonzero(fold == k)
                    if k not in models:
                        models[k] = shared.value.without(k)
                    got = scan([texts[i] for i in own], models[k], toxic[own] == 0)
                    cut = np.searchsorted(got.text, np.arange(len(own) + 1)).tolist()
                    scores = [got.score[i:j].tobytes() for i, j in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(got.words), pa.array(toxic[own]), pa.array(scores, pa.binary())], names=["n", "toxic", "scores"])
                    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([got.histogram.tobytes()], pa.binary())], names=["n", "toxic", "scores"])

    found = table.mapInArrow(run, "n bigint, toxic bigint, scores binary").toArrow()  # a row a text of the sample
    shared.unpersist()
    discard(table)
    n, toxic, raw = found.column(0).to_numpy(), found.column(1).to_numpy(), found.column(2).to_pylist()
    histogram = sum((np.frombuffer(raw[k], np.int64) for k in np.flatnonzero(n < 0)), np.zeros(int(2 * EDGE / STEP), np.int64))
    own = np.flatnonzero(n >= 0)
    score = np.frombuffer(b"".join(raw[k] for k in own))
    text = np.repeat(np.arange(len(own)), [len(raw[k]) // 8 for k in own])
    n, toxic = n[own], toxic[own].astype(float)
    best, rate = np.zeros(len(own)), _rate(histogram)
    np.maximum.at(best, text, score)
    hit = (toxic == 0) & (best > 0)
    # The law's mean is its location and Euler's constant; the median is less moved by wrong labels.
    location = float(np.median(rate * best[hit] - np.log(np.maximum(n[hit], 1)))) + math.log(math.log(2)) if hit.any() else 0.0
    law = Scorer(counts.without(-1), rate, location, (0.0, 0.0, 0.0))
    weight = np.where(toxic > 0, stands_for[1], stands_for[0]) / min(stands_for)
    return Scorer(law.model, rate, location, _logistic(law.evidence(n, text, score), toxic, weight))


def classify(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep`, score (0 to 1), predicted (1 from TOXIC on, else 0) and passages: the segments that are beyond chance, as
    arrays of their first and last code point (the last excluded) and how far they are beyond it.

    Null texts are scored as empty ones, which have no passage; texts of any length are scored whole; repeated rows get
    equal rows; ids may be null; an empty table gives no rows; only `keep`, id and text are read, and nothing is shuffled.
    A column of `keep` that has the name of a result gives way to it."""
    made = ("id", "score", "predicted", "starts", "ends", "beyond")
    keep = tuple(c for c in keep if c not in made)
    source = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # UNITS rows of two counts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "_text", 1_000_000):
                found = scan(strings(part.column(part.num_columns - 1)), shared.value.model)
                score = shared.value.probability(found)
                beyond = shared.value.beyond(found.score, found.words[found.text])
                real = np.flatnonzero(beyond > 0)
                cut = pa.array(np.searchsorted(found.text[real], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x[real])) for x in (found.start, found.end, beyond)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), *lists], names=[*part.schema.names[:-1], *made[1:]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(run, schema + ", score double, predicted int, starts array<bigint>, ends array<bigint>, beyond array<double>")
