"""Language identification of mixed-language text.

Words are runs of letters. A word's script, found by code-point ranges, narrows the languages to those that were seen
in that script; hashed letter trigrams score it in each of them; and Viterbi over a text's words, with a penalty for
each switch, labels spans. A text's language is the one that holds most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import sliced, strings, trim
from tidewatch.llm.pretokenize import LETTER, classes

#: Buckets of trigrams; bound of the labelled sample (smallest hashes of the id); cost of a switch, in nats; what one
#: word can say against a language at most; texts' words that one Viterbi pass takes; letters scored at once.
BUCKETS, SAMPLE, SWITCH, WORD_LIMIT, PASS, LETTERS = 1 << 16, 20_000, 8.0, 12.0, 800_000, 1_000_000
#: First code points of script ranges (Unicode blocks), by ascending start; 0 is Latin.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0E00, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "southeast", "hangul", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han", "other")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
_SCRIPT_OF = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES], np.uint8)


@dataclass
class Words:
    """Runs of letters of texts set end to end, and the trigram bucket of every letter."""

    text: np.ndarray  # number of the text of each word
    start: np.ndarray  # place in that text
    size: np.ndarray
    script: np.ndarray
    buckets: np.ndarray
    first: np.ndarray  # place of each word's first letter in buckets


def words_of(texts: list[str]) -> Words:
    """Letters are compared in lower case; a letter's trigram is itself and its neighbours within the word."""
    joined = "".join(texts)
    low = joined.lower()
    if len(low) != len(joined):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    cp = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    letter = classes()[cp] == LETTER
    place = np.flatnonzero(letter)
    if not len(place):
        empty = np.empty(0, np.int64)
        return Words(empty, empty, empty, empty, empty, empty)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.add.reduceat(np.append(letter, False).astype(np.int64), begins[:-1]) * (np.diff(begins) > 0))
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) > 1) | (owner[1:] != owner[:-1])
    code = cp[place].astype(np.uint64)
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:] = np.where(new[1:], 0, code[:-1])
    after[:-1] = np.where(new[1:], 0, code[1:])
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (code * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    buckets = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int32)
    first = np.flatnonzero(new)
    return Words(owner[first], place[first] - begins[owner[first]], np.diff(np.append(first, len(place))), _SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, cp[place[first]], side="right") - 1], buckets, first)


@dataclass(frozen=True)
class LanguageModel:
    """Log shares of trigram buckets by language, and the scripts that each language was seen in."""

    languages: tuple[str, ...]
    scores: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages

    def word_scores(self, words: Words) -> np.ndarray:
        """Words x languages: log shares against the best language, at least -WORD_LIMIT; languages that the script
        rules out get the limit, but where it rules out all, all are as likely."""
        if not len(words.first) or not self.languages:
            return np.empty((len(words.first), len(self.languages)), np.float32)
        out = np.empty((len(words.first), len(self.languages)), np.float32)
        ends = np.append(words.first[1:], len(words.buckets))
        i = 0
        while i < len(out):  # LETTERS at a time, one word at least
            j = max(i + 1, int(np.searchsorted(ends, words.first[i] + LETTERS, side="right")))
            total = np.add.reduceat(self.scores[words.buckets[words.first[i] : ends[j - 1]]], words.first[i:j] - words.first[i], axis=0)
            can = self.scripts[words.script[i:j]]
            none = ~can.any(axis=1)
            total = np.where(can, total, -np.inf)
            total[none] = 0
            out[i:j] = np.maximum(total - total.max(axis=1, keepdims=True), -WORD_LIMIT)
            i = j
        return out

    def label(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Language of each word. counts: words of each text, in order. All texts take a step at once; those that have
        ended drop out, as longer texts stand first. What leads back is a few bytes a word, however long a text is."""
        k = scores.shape[1]
        kind = np.min_scalar_type(max(1, k - 1))
        labels, top_of = np.zeros(len(scores), kind), np.zeros(len(scores), kind)
        stay_of = np.zeros((len(scores), -(-k // 8)), np.uint8)
        order = np.argsort(-counts, kind="stable")
        sizes = counts[order]
        begins = (np.cumsum(counts) - counts)[order]
        live = int((sizes > 0).sum())
        if not live:
            return labels
        best = scores[begins[:live]].copy()
        for t in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes[:live], -t, side="left"))
            top = best[:live].argmax(axis=1)
            jump = best[np.arange(live), top] - np.float32(SWITCH)
            stay = best[:live] >= jump[:, None]
            at = begins[:live] + t
            top_of[at], stay_of[at] = top, np.packbits(stay, axis=1, bitorder="little")
            best[:live] = np.where(stay, best[:live], jump[:, None]) + scores[at]
        now = best.argmax(axis=1)  # texts that ended early keep their last row
        for t in range(int(sizes[0]) - 1, 0, -1):
            live = int(np.searchsorted(-sizes[: len(best)], -t, side="left"))
            at, own = begins[:live] + t, now[:live]
            labels[at] = own
            kept = (stay_of[at, own >> 3] >> (own & 7).astype(np.uint8)) & 1
            now[:live] = np.where(kept, own, top_of[at])
        labels[begins[: len(best)]] = now
        return labels


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learns from at most `sample` rows with a text and a language (smallest hashes of the id). No such row: a model
    without languages, which calls everything `und`."""
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    chosen = rows.select("id", "lang").orderBy(F.xxhash64("id"), "id").limit(sample)
    picked = rows.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in sliced(batch, "text", 1_000_000):
                langs, words = part.column(0).to_pylist(), words_of(strings(part.column(1)))
                by_word = words.text
                for lang in set(langs):
                    have = np.isin(by_word, [i for i, x in enumerate(langs) if x == lang])
                    tri, script = seen.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)))
                    tri += np.bincount(words.buckets[np.repeat(have, words.size)], minlength=BUCKETS)
                    script += np.bincount(words.script[have], minlength=len(SCRIPTS))
        if seen:
            yield pa.RecordBatch.from_pydict({"lang": list(seen), "tri": [x.tobytes() for x, _ in seen.values()], "script": [x.tobytes() for _, x in seen.values()]}, schema=pa.schema([("lang", pa.string()), ("tri", pa.binary()), ("script", pa.binary())]))

    # The scan keeps its partitions; the sample alone goes to eight tasks, and each gives one row a language to the driver.
    found = picked.select("lang", "text").repartition(8).mapInArrow(count, "lang string, tri binary, script binary").collect()
    languages = tuple(sorted({r.lang for r in found}))
    tri, script = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    for r in found:
        k = languages.index(r.lang)
        tri[:, k] += np.frombuffer(r.tri, np.int64)
        script[:, k] += np.frombuffer(r.script, np.int64)
    shares = np.log((tri + 0.5) / (tri.sum(axis=0) + 0.5 * BUCKETS)) if languages else tri
    return LanguageModel(languages, shares.astype(np.float32), script > 0.001 * np.maximum(1, script.sum(axis=0)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep`, lang_pred, score (the share of letters in spans of that language), and if asked spans: start, end
    (code points) and language of each run of words with one label.

    Null and empty texts, and those without a letter, are `und` with score 0 and no spans. Texts of any length are
    labelled whole; a tie goes to the language first by name; repeated rows get equal rows; an empty table gives no
    rows; only `keep`, id and text are read, and nothing is shuffled. A column of `keep` that has the name of a result
    gives way to it.
    """
    keep = tuple(c for c in keep if c not in ("id", "lang_pred", "score", "spans"))
    source = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    span = "array<struct<start: bigint, end: bigint, lang: string>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text") + ", lang_pred string, score double" + f", spans {span}" * with_spans
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def finish(parts: list[pa.RecordBatch], found: list[tuple[Words, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counts = [np.bincount(w.text, minlength=p.num_rows) if len(w.first) else np.zeros(p.num_rows, np.int64) for p, (w, _) in zip(parts, found)]
        labels = m.label(np.concatenate([s for _, s in found]), np.concatenate(counts)) if m.languages else None
        at = 0
        for part, (words, _) in zip(parts, found):
            n, k = part.num_rows, max(1, len(m.languages))
            own = labels[at : at + len(words.first)] if labels is not None else np.zeros(len(words.first), np.uint8)
            at += len(words.first)
            letters = np.bincount(words.text.astype(np.int64) * k + own, weights=words.size, minlength=n * k).reshape(n, k) if len(own) else np.zeros((n, k))
            total = letters.sum(axis=1)
            known = (total > 0) & bool(m.languages)
            best = letters.argmax(axis=1)
            pred = [m.languages[b] if y else "und" for b, y in zip(best.tolist(), known.tolist())]
            score = np.where(known, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
            columns = [*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                spans: list[list[dict]] = [[] for _ in range(n)]
                if len(own) and m.languages:
                    cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (words.text[1:] != words.text[:-1])))
                    last = np.append(cut[1:], len(own)) - 1
                    for a, b in zip(cut.tolist(), last.tolist()):
                        spans[words.text[a]].append({"start": int(words.start[a]), "end": int(words.start[b] + words.size[b]), "lang": m.languages[own[a]]})
                columns.append(pa.array(spans, span_type))
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "lang_pred", "score", *["spans"] * with_spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, found, waiting = [], [], 0
        for batch in batches:
            for part in sliced(batch, "_text", 1_000_000):
                words = words_of(strings(part.column(part.num_columns - 1)))
                scores = shared.value.word_scores(words)
                words.buckets = words.buckets[:0]
                slim = part.set_column(part.num_columns - 1, "_text", pa.nulls(part.num_rows))
                parts.append(slim)
                found.append((words, scores))
                waiting += len(words.first)
                if waiting >= PASS or len(parts) >= 64:
                    yield from finish(parts, found)
                    parts, found, waiting = [], [], 0
        if parts:
            yield from finish(parts, found)
        del parts, found
        trim()

    return source.mapInArrow(run, schema)
