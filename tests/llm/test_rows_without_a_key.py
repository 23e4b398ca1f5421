"""Line dedup where ids repeat or are missing, very long texts in both set joins, and scratch tables."""

import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import line_dedup, ngram_join, registry, token_files
from tidewatch.llm.common import discard, written

SMALL = "/root/testdata/sf0.001"


def shingles(line):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset({tuple(w)} if w else ())


def near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def plain(texts):
    """Texts of documents in order, without the lines that an earlier one is similar to."""
    seen, by, out = set(), {}, []
    for text in texts:
        stay = []
        for line in (text or "").split("\n"):
            s = shingles(line)
            if not (s in seen or any(near(s, x) for x in {x for token in s for x in by.get(token, ())})):
                stay.append(line)
            if s and s not in seen:
                seen.add(s)
                for token in s:
                    by.setdefault(token, []).append(s)
        out.append(None if text is None else "\n".join(stay))
    return out


COPY, MORE = "alpha beta gamma delta epsilon zeta", "keep this one here please now ok"


def test_lines_that_stand_once_stay_where_ids_repeat(spark):
    rows = [(1, f"{COPY}\n{MORE}"), (1, f"unique line of the other row\n{COPY}"), (2, f"{COPY}\nthird row of the table"), (1, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.text or "" for r in line_dedup.without_repeats(docs).collect())
    lines = [x for t in got for x in t.split("\n") if x]
    assert sorted(lines) == sorted([COPY, MORE, "unique line of the other row", "third row of the table"]) and len(got) == 5
    stage = corpus_pipeline.lines(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "").collect()
    assert sorted(x for r in stage for x in (r.text or "").split("\n") if x) == sorted(lines) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in stage)


def test_rows_without_an_id_are_documents_behind_all_others(spark):
    rows = [(None, f"{COPY}\nfirst of its own"), (None, f"{COPY}\nsecond of its own"), (7, f"{MORE}\n{COPY}"), (None, None), (-2, MORE)]
    got = [(r.doc_id, r.text) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted([(None, "first of its own"), (None, "second of its own"), (7, COPY), (None, None), (-2, MORE)], key=repr)


def test_a_row_that_stands_very_often_keeps_its_lines_once(spark):
    rows = [(3, f"{COPY}\n{MORE}")] * 500 + [(k, f"document {k} has this line alone\n{COPY}") for k in range(10, 40)]
    got = [r.text for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got) == sorted([f"{COPY}\n{MORE}", *[""] * 499, *(f"document {k} has this line alone" for k in range(10, 40))])


def test_many_lines_of_one_text(spark):
    """Half of 200,000 lines go; the time is that of a few passes over them."""
    lines = [f"w{k} x{k} y{k // 2}" for k in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(x for a in lines for x in (a, f"{a} own")))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert got == {1: "\n".join(lines), 2: "\n".join(f"{a} own" for a in lines)} and time.time() - began < 120


def test_texts_of_megabytes(spark):
    rng = random.Random(4)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(700_000)]
    changed = [*base[:350_000], "other", *base[350_001:]]
    far = [f"z{rng.randrange(10**6)}" for _ in range(700_000)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(far)), (4, "short one")], "doc_id long, text string").repartition(2)
    assert docs.agg(F.min(F.length("text"))).first()[0] < 10 < 5_000_000 < docs.agg(F.max(F.length("text"))).first()[0]
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1][0] > 690_000
    left = {r.doc_id: r.lines_removed for r in line_dedup.without_repeats(docs).collect()}
    assert left == {1: 0, 2: 1, 3: 0, 4: 0}


def test_only_scratch_tables_are_discarded(spark, tmp_path):
    path = str(tmp_path / "own")
    spark.range(5).write.parquet(path)
    with pytest.raises(ValueError, match="scratch"):
        discard(spark.read.parquet(path))
    foreign = spark.read.parquet(path)
    foreign._scratch_path = path
    with pytest.raises(ValueError, match="scratch"):
        discard(foreign)
    assert spark.read.parquet(path).count() == 5
    table = written(spark.range(5), "some")
    place = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(place)
    discard(table)
    assert not os.path.isdir(place)


@pytest.mark.parametrize("cuts", [1000, 4])
def test_shards_are_even_and_their_bounds_no_literals(spark, monkeypatch, cuts):
    monkeypatch.setattr(token_files, "CUTS", cuts)
    rows = spark.range(10_000).select(F.when(F.col("id") < 3000, F.lit(50)).otherwise(F.col("id")).alias("key"))
    bounds = token_files._bounds(rows, 20)
    keys = np.array([50] * 3000 + list(range(3000, 10_000)))
    low, high = np.searchsorted(bounds, keys, side="left"), np.searchsorted(bounds, keys, side="right")
    assert (np.diff(bounds) >= 0).all() and len(bounds) >= 19
    single = low[low == high]
    assert np.bincount(single).max() <= 1100 and (high[:3000] - low[:3000] >= 5).all()  # the hot id has as many shards as it fills
    assert token_files._bounds(rows.limit(0), 20).tolist() == [] == token_files._bounds(rows, 1).tolist()


def test_files_of_many_shards_equal_those_of_few(spark, monkeypatch, tmp_path):
    import public_tokenizers as P

    docs = spark.createDataFrame([(k % 40 if k % 7 else None, f"text number {k} of the table") for k in range(200)], "doc_id long, text string").repartition(9)
    found = []
    for k, cuts in enumerate((1000, 3)):
        monkeypatch.setattr(token_files, "CUTS", cuts)
        token_files.write_tokens(docs, P.path("byte_bpe_50k.json"), 2, f"{tmp_path}/{k}")
        rows = token_files.read_tokens(spark, f"{tmp_path}/{k}").orderBy("start").collect()
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        assert [r.id for r in rows] == sorted((r.id for r in rows), key=lambda i: (i is not None, i or 0))  # null ids first
        found.append(sorted((r.id is None, r.id or 0, bytes(r.ids)) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 200


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_registered_query_equals_plain_loops(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet' order by doc_id").fetchall()
    want = dict(zip((i for i, _ in rows), plain([t for _, t in rows])))
    got = {r.doc_id: r for r in registry.QUERIES["op8_line_dedup"](spark, SMALL).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.lines_removed == len((t or "").split("\n")) - (0 if r.text is None else len(r.text.split("\n")) if r.text or not r.lines_removed else 0) or not r.text for (i, t), r in ((x, got[x[0]]) for x in rows))
