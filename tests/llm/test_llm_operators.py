"""Each operator against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, exact_dedup, language_id, line_dedup, ngram_join, packing, quality_classifier, quality_rules, set_join, simple8b, token_files, url_filters
from tidewatch.llm.library_encoding import LibraryEncoder

RANKS, BYTES, WORDS = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, id string, n int, tokens string, label string"
library_of, encoder_of = functools.cache(Tokenizer.from_file), functools.cache(LibraryEncoder)


def words(k, n):
    rng = random.Random(k)
    return [rng.choice("abcdefg") + rng.choice("hijkl") + str(rng.randrange(50)) for _ in range(n)]


def texts():
    base = words(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    lines = "\n".join(" ".join(words(k, 30)) for k in range(4))
    return [
        None, "", " \t\n", "one", "one two three four", "ONE two\u00a0three", " ".join(base), " ".join(near), " ".join([*near, "more"]), " ".join(base).upper(), " ".join(base), lines, lines + "\n" + " ".join(words(9, 30)),
        "x " * 3000, "y" * 5000, "caf\u00e9 \u4f60\u597d \U0001f642 'tis we'll '' don't\r\n\x1c\x85 12\u00bd", " ".join(words(77, 9000)), "a b c d e f g h i j " * 4,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x", 1, "y", "z") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_bpe_equals_tiktoken_and_round_trips(docs, empty):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.model(RANKS).ranks, special_tokens={})
    coded = bpe.encode_documents(docs, RANKS, with_offsets=True)
    want = sorted((i, library.encode_ordinary(t)) for i, t in pairs(docs))
    assert sorted((r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in coded.collect()) == want
    assert sorted((r.id, bytes(r.decoded)) for r in bpe.decode_documents(coded, RANKS).collect()) == sorted((i, t.encode()) for i, t in pairs(docs))
    assert all(np.frombuffer(r.offsets, "<i8")[-1] == len(dict(pairs(docs))[r.id].encode()) for r in coded.collect())
    assert bpe.encode_documents(empty, RANKS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(alphabet=" \n\t\x0b\x1c\x85\u3000'strevmdlabAB12.,!\u00e9\u00bd\u4f60", max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "\u00cf"])), max_size=6).map("".join), max_size=4))
def test_encoders_equal_their_libraries(batch):
    model = bpe.model(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(batch)] == [library.encode_ordinary(t) for t in batch]
    for path, drops in ((BYTES, False), (WORDS, True)):
        plain = library_of(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder_of(path, drops).encode(batch)] == [plain.encode(t, add_special_tokens=False).ids for t in batch]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=2500))
def test_simple8b_round_trips(values):
    v = np.array(values, np.uint64)
    got, offsets = simple8b.encode(v)
    assert (simple8b.decode(got, offsets, len(v)) == v).all() and len(offsets) == -(-len(v) // simple8b.BLOCK) + 1


def test_token_files(spark, docs, empty, tmp_path):
    plain = Tokenizer.from_file(BYTES)
    token_files.write_tokens(docs, BYTES, 2, str(tmp_path / "t"))
    at, want = 0, []
    for i, t in sorted(pairs(docs)):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).collect()
    assert sorted((r.id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    token_files.write_tokens(empty, BYTES, 2, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in pairs(docs):
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", t).encode()).digest()].append((-len(t), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g)
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()) == want
    assert exact_dedup.exact_groups(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def test_ngram_join(docs, empty):
    rows = [(i, shingles(t)) for i, t in pairs(docs)]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near(rows[a][1], rows[b][1]):
                label = [label[b] if x == label[a] else x for x in label]
    least = {k: min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label)}
    want = sorted((i, len(s), least[label[k]]) for k, (i, s) in enumerate(rows))
    assert sorted((r.id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs).collect()) == want
    assert ngram_join.near_groups(empty).count() == 0


def test_ngram_join_finds_links_across_groups(spark):
    """Chains: each text is similar to its neighbours only, so no single leader holds them."""
    base, rng, rows = words(5, 200), random.Random(3), []
    for k in range(40):
        rows.append((1000 - k, " ".join(base)))
        at = rng.randrange(190)
        base = [*base[:at], f"new{k}", f"more{k}", *base[at + 2 :]]
    got = {r.component_id for r in ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {961}


def test_a_hub_and_hot_tokens(spark, monkeypatch):
    """A star of 10,000 edges, and shingles that every text holds, with hot keys and tokens told apart early."""
    monkeypatch.setattr(set_join, "HOT_ROWS", 100)
    edges = spark.range(1, 10_001).select(F.lit(b"0000").alias("a"), F.encode(F.lpad(F.col("id").cast("string"), 6, "0"), "utf-8").alias("b")).repartition(4)
    found = set_join.components(edges)
    assert found.count() == 10_001 and [bytes(r.component) for r in found.select("component").distinct().collect()] == [b"0000"]
    common = words(50, 40)
    rows = [(k, " ".join([*words(1000 + k, 30), *common])) for k in range(300)] + [(500 + k, " ".join([*words(1000 + k, 30)[1:], *common])) for k in range(0, 300, 7)]
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {k: (len(shingles(t)), k - 500 if k >= 500 else k) for k, t in rows}


@pytest.mark.parametrize("wide", [1000, 1])
def test_line_dedup(docs, empty, monkeypatch, wide):
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    seen, gone = [], set()
    for i, t in sorted(set(pairs(docs))):
        for k, line in enumerate(t.split("\n")):
            s = shingles(line)
            if any(near(s, x) for x in seen):
                gone.add((i, k))
            seen.append(s)
    assert {(r.id, r.part) for r in line_dedup.later_matches(docs.dropDuplicates(["doc_id"])).collect()} == gone
    out = line_dedup.without_repeats(docs)
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    want = [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in {(x.doc_id, x.text) for x in docs.collect()}]
    want.append((6, ""))  # the row that stands twice has nothing of its own the second time
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert line_dedup.without_repeats(empty).count() == 0


def test_packing(docs, empty):
    """Every id of every document lies in one piece, the pieces' digests are right, and windows are full or powers of two."""
    plain = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs, packing.library_encode(WORDS, True), 1).collect()
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in pairs(docs)}
    rows_of = collections.Counter(i for i, _ in pairs(docs))
    windows, covered = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        covered.update((r.doc_id, r.start + k) for k in range(r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert covered == {(i, k): rows_of[i] for i, x in ids.items() for k in range(len(x))}
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack_documents(empty, packing.library_encode(WORDS, True), 1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 60))
def test_fill_finds_the_largest_sum(lengths, room):
    count = collections.Counter(lengths)
    taken = packing.fill(sorted(count), count.__getitem__, room)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    assert sum(k * v for k, v in taken.items()) == max(sums) and all(v <= count[k] for k, v in taken.items())


def test_urls(spark):
    urls = [None, "", "a.net/x", "http://a.net/x", "http://NET/x", "http://a.net", "https://www.example.net/en/1?q", "http://example.net/de/", "http://xexample.net/en/", "http://example.com/de/1", "ftp://m.org/fr/", "http://spam-x.example.org/", "http:///fr/", "http://h.net?x=/en/", "x://" + "a" * 3000 + ".org/fr/"]
    rows = [(k, u, "extra") for k, u in enumerate(urls)]
    df = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, host string")
    got = {r.id: (r.host[:20], r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4] == ("net", "/x", "net/", "block") and got[5] == ("a.net", "", None, "allow")
    assert got[6][2:] == ("example.net/en/", "allow") and got[7][2] == "net/" and got[8][2] == "net/" and got[9][2:] == ("example.com/de/", "block")
    assert got[10][2:] == ("org/fr/", "allow") and got[11][2:] == (None, "block") and got[12] == ("", "/fr/", None, "allow") and got[13] == ("h.net", "", None, "allow") and got[14][2] == "org/fr/"
    assert url_filters.filter_urls(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/?*", max_size=6), st.lists(st.text(alphabet="ab/", max_size=8), min_size=1, max_size=4))
def test_globs_equal_regular_expressions(glob, urls):
    pattern = re.sub(r"\*\*|\*|\?|.", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0], re.escape(m[0])), glob)
    got = url_filters.Automaton([glob, "zz"] * 40).match([u.encode() for u in urls])[:, 78]
    assert got.tolist() == [bool(re.fullmatch(pattern, u)) for u in urls]


def test_rule_statistics(docs, empty):
    for r in quality_rules.judged(docs, []).collect():
        t = dict(pairs(docs))[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and r.kept == (not r.base_failed)
    assert quality_rules.judged(empty, []).count() == 0


def test_ordered_rules(spark, docs):
    """The first rule met counts, each a conjunction; string ids, a clashing column and rows without a label are fine."""
    test = quality_rules.Test
    rules = [quality_rules.Rule((test("chars_per_word", True, 3.0), test("upper_share", True, 0.2))), quality_rules.Rule((test("chars_per_word", True, 3.0),)), quality_rules.Rule((test("repeat_share", False, 0.0),))]
    for r in quality_rules.judged(docs.withColumn("n_words", F.lit("x")), rules, keep=("doc_id", "text", "n_words")).collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", r.text or "")
        chars = sum(map(len, w))
        mean, upper = chars / max(1, len(w)), sum(c.isupper() for c in r.text or "") / max(1, chars)
        assert r.n_words == len(w) and r.rule == (1 if mean > 3 and upper > 0.2 else 2 if mean > 3 else 3 if r.n_repeat_words == 0 else None)
        assert r.kept == (not r.base_failed and r.rule is None)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert quality_rules.fit(named, named.select("doc_id", F.lit(1).alias("quality"))) == [] and quality_rules.fit(named, named.select("doc_id", F.lit(None).cast("int").alias("quality"))) == []


def test_learned_rules_find_the_symptom_and_spare_the_rest():
    rng = random.Random(1)
    rows = [{f: rng.random() * 0.1 for f in quality_rules.FEATURES} | {"bad": False} for _ in range(300)]
    for r in rows[::5]:
        r |= {"symbol_share": 0.4 + rng.random() * 0.2, "bad": True}
    rules = quality_rules.learn(rows)
    assert rules and all(any(k.holds(r) for k in rules) == r["bad"] for r in rows)
    assert quality_rules.learn([]) == [] and quality_rules.learn([r for r in rows if not r["bad"]]) == []


def test_language_spans(spark, empty):
    en, de = "the house and the river that was there with this", "der die das und ist nicht ein schöner garten"
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de")] * 20)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    rows = [(1, f"{en} {de}", "x"), (2, None, "x"), (3, "12 !", "x"), (4, de, "x"), (5, "", "x")]
    got = {r.id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model, with_spans=True).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and got[1].spans[1].start == len(en) + 1
    assert got[2].lang_pred == got[3].lang_pred == got[5].lang_pred == "und" and got[3].score == 0 and got[4].lang_pred == "de" and got[4].score == 1
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, language_id.fit(df.limit(0))).collect()} == {"und"}


def test_viterbi_equals_a_plain_one():
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel(("a", "b", "c"), np.zeros((1, 3)), np.ones((1, 3), bool))
    counts = np.array([5, 0, 1, 9])
    scores = (rng.random((15, 3)) * -6).astype(np.float32)
    got, at = model.label(scores, counts), 0
    for n in counts:
        paths = [()]
        for t in range(n):
            paths = [(*p, k) for p in paths for k in range(3)] if t < 1 else [max(((*p, k) for p in paths), key=lambda q: sum(scores[at + i, x] for i, x in enumerate(q)) - language_id.SWITCH * sum(x != y for x, y in zip(q, q[1:]))) for k in range(3)]
        if n:
            value = lambda q: sum(scores[at + i, x] for i, x in enumerate(q)) - language_id.SWITCH * sum(x != y for x, y in zip(q, q[1:]))  # noqa: B023, E731
            assert value(tuple(got[at : at + n])) == pytest.approx(max(map(value, paths)), abs=1e-4)
        at += n


def test_many_languages_and_long_texts():
    """The 280th of 300 languages is no smaller number, and a text of 50,000 words is labelled like its parts."""
    model = language_id.LanguageModel(tuple(map(str, range(300))), np.zeros((1, 300)), np.ones((1, 300), bool))
    scores = np.full((7, 300), -3, np.float32)
    scores[:, 280] = 0
    assert model.label(scores, np.array([5, 2])).tolist() == [280] * 7
    three = language_id.LanguageModel(("a", "b", "c"), np.zeros((1, 3)), np.ones((1, 3), bool))
    long = np.full((50_000, 3), -2, np.float32)
    long[:20_000, 1] = long[20_000:, 2] = 0
    assert three.label(long, np.array([50_000])).tolist() == [1] * 20_000 + [2] * 30_000


def test_classifier_on_held_out_texts(spark, docs, empty):
    rng = random.Random(2)
    make = lambda k: " ".join(words(k, 60)) if k % 3 else " ".join(w + "***" for w in words(k, 60))
    rows = [(k, make(k)) for k in range(300)]
    train = spark.createDataFrame(rows[:200], "doc_id long, text string")
    scorer = quality_classifier.fit(train)
    got = {r.id: r.kept for r in quality_classifier.classify(spark.createDataFrame(rows[200:], "doc_id long, text string"), scorer).collect()}
    assert all(v == bool(k % 3) for k, v in got.items()) and rng
    assert quality_classifier.classify(docs, scorer).count() == docs.count() and quality_classifier.classify(empty, scorer).count() == 0


def test_expectation_maximisation_ranks_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.2
    noisy = lambda right: np.where(rng.random(3000) < right, truth, ~truth) + 1
    vote = np.stack([noisy(0.95), noisy(0.9), noisy(0.65)], axis=1).astype(int)
    post, table = quality_classifier.expectation_maximisation(vote)
    assert ((post > 0.5) == truth).mean() > 0.93 and table[0, 1, 2] > table[2, 1, 2]
