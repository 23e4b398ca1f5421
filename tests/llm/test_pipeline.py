"""The corpus pipeline: each stage against a plain version on a small fixture, and all of them on the smallest tables."""

import collections
import os
import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LATIN = "abcdefghijkl"
CYRILLIC, GREEK = str.maketrans(LATIN, "абвгдежзийкл"), str.maketrans(LATIN, "αβγδεζηθικλμ")


def words(k, n):
    rng = random.Random(k)
    return [rng.choice("abcdefg") + rng.choice("hijkl") + str(rng.randrange(50)) for _ in range(n)]


def line(k, n=60):
    return " ".join(words(k, n))


def corpus():
    """Texts by id, languages by id (null for the odd cases), and labels of what stands for clean and for junk."""
    texts, langs, labels = {}, {}, {}
    for k in range(100, 280):
        junk = k % 3 == 0
        texts[k] = " ".join(w + "***" for w in words(k, 60)) if junk else line(k) if k % 3 == 1 else line(k).translate(CYRILLIC if k % 2 else GREEK)
        langs[k] = "aa" if k % 3 < 2 else "bb" if k % 2 else "cc"
        labels[k] = 0 if junk else 1
    short = [" ".join(words(500 + k, 2)) for k in range(40)]
    near = [*short[:20], "al1 bl2", *short[21:]]
    texts |= {
        1: None, 2: "", 3: "one two", 4: "a b c d e f g h i j " * 4, 5: " ".join(map(str, range(1000, 1040))),
        6: " ".join([line(1, 20), line(2, 20).translate(CYRILLIC), line(3, 20).translate(GREEK)]),
        7: line(100) + "\n" + line(900, 40), 290: line(901, 30) + "\n" + " ".join([*words(900, 40)[:-1], "changed"]), 300: line(901, 30),
        310: " ".join(words(950, 81)), 311: "\n".join(" ".join(words(950, 81)[k : k + 3]) for k in range(0, 81, 3)),  # equal as documents, not by line
        400: "\n".join(short), 401: "\n".join(near), 402: "\n".join([*near[:35], "ak3 dl4", *near[36:]]),
    }
    return texts, langs, labels


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_quality(texts):
    """The base rule, and symbols at every word as the one symptom that labels show."""
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {x for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for x in range(j, j + 5)}
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and "***" not in t:
            out[i] = t
    return out


def plain_language(texts):
    """Each script is one language here: the share of letters in the most frequent script."""
    out = {}
    for i, t in texts.items():
        scripts = collections.Counter("a" if x < "Ͱ" else "g" if x < "Ѐ" else "c" for x in t if x.isalpha())
        if scripts and max(scripts.values()) >= corpus_pipeline.LEAST_SCORE * sum(scripts.values()):
            out[i] = t
    return out


def plain_lines(texts):
    """Every line with a word counts; documents left without a word go."""
    seen, out = [], {}
    for i, t in sorted(texts.items()):
        stay = []
        for x in t.split("\n"):
            s = shingles(x)
            if not any(near(s, y) for y in seen):
                stay.append(x)
            seen.append(s)
        if len(stay) == len(t.split("\n")) or "".join(stay).strip():
            out[i] = "\n".join(stay)
    return out


def plain_documents(texts):
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and near(sets[a], sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i: t for i, t in texts.items() if label[i] == i}


PLAIN = (plain_quality, plain_language, plain_lines, plain_documents)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts, langs, labels = corpus()
    rows = [(i, t, langs.get(i), "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_plain_ones(spark, folder):
    docs, texts = spark.read.parquet(f"{folder}/documents.parquet"), corpus()[0]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN):
        before, texts = len(texts), plain(texts)
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == texts, name
        assert len(texts) < before, name
        docs = out
    assert {400, 7, 310} <= set(texts) and not {1, 2, 3, 4, 5, 6, 102, 100, 300, 311} & set(texts)


def test_run_packs_what_the_plain_stages_leave(spark, folder):
    texts = corpus()[0]
    for plain in PLAIN:
        texts = plain(texts)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    rows = corpus_pipeline.run(spark, folder).collect()
    got, windows = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert got == want and all(r.doc_tokens == want[r.doc_id] for r in rows)
    for w in windows.values():
        ends = [0]
        for offset, length in sorted(w):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stages_keep_the_columns_and_the_last_packs(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == first.columns and 0 < out.count() <= left
        docs, left = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == left


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows without an id, and a row without an id whose text links with one that has it."""
    t, other = line(1), line(2)
    rows = [(1, t), (1, t), (2, t), (None, t), (None, other), (None, other), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.documents(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == [(False, 1, t), (False, 5, ""), (False, 6, ""), (True, 0, other)]


def test_clashing_names(spark, folder):
    """Stages keep columns whose names their operators use themselves."""
    names = ("id", "score", "lang_pred", "_body", "n_words", "symbol_share", "_t", "kept", "rule", "_row", "_key", "_gone", "_id", "lines_removed", "part", "sig", "order", "component_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns and out.count() > 0 and {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
