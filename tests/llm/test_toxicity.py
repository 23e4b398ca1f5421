"""Toxicity: words, chains of priors and maximal segments against plain loops; odd rows; held-out results by count."""

import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import registry, toxicity

SF = "/root/testdata/sf0.1"


def plain_segments(before, after):
    """By the definition: the shortest segment of the highest score, then what is left and right of it."""
    def inside(i, j):
        best = max(((after[b] - before[a], a - b, a) for a in range(i, j) for b in range(a, j)), default=None)
        if not best or best[0] <= 0:
            return []
        a, b = best[2], best[2] - best[1]
        return [*inside(i, a), (best[0], a, b), *inside(b + 1, j)]

    return inside(0, len(before))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=24))
def test_segments_equal_their_definition(scores):
    sums = np.cumsum(scores)
    up = [k for k, s in enumerate(scores) if s > 0]
    before, after = [int(sums[k] - scores[k]) for k in up], [int(sums[k]) for k in up]
    got, want = toxicity.segments(before, after), plain_segments(before, after)
    assert sorted(s for s, _, _ in got) == sorted(s for s, _, _ in want)
    assert all(after[b] - before[a] == s for s, a, b in got) and all(x[2] < y[1] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("piece", [toxicity.PIECE, 5])
def test_words_are_runs_of_letters(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    texts = ["", "One tWo, three1four_five", "  ", "İstanbul'da ÄRGER\n" * 3, "x" * 40, "a 你好嗎朋友 b"]
    parts = list(toxicity.words_of(texts))
    got = [(t, s, n) for w in parts for t, s, n in zip(w.text.tolist(), w.start.tolist(), w.size.tolist())]
    want = [(k, m.start(), len(m[0])) for k, t in enumerate(texts[:5]) for m in re.finditer(r"[^\W\d_]+", t)]
    assert [x for x in got if x[0] < 5] == want
    assert [(s, n) for t, s, n in got if t == 5] == [(0, 1), (2, 4), (3, 4), (4, 3), (5, 2), (6, 1), (8, 1)]  # no spaces: each letter begins one
    units = np.concatenate([w.units for w in parts])
    same = [k for k, (t, s, n) in enumerate(got) if texts[t][s : s + n].lower() == "ärger"]
    assert len(same) == 3 and (units[same] == units[same[0]]).all() and len(np.unique(units[:, -1])) == len({texts[t][s : s + n].lower() for t, s, n in got})


def test_log_odds_equal_the_chain_by_hand():
    (w,) = toxicity.words_of(["abcdef abcdxy zzz"])
    units, share = w.units, 0.25
    known = sorted([(units[0, 0], 6, 2), (units[0, 1], 5, 1), (units[0, -1], 3, 0), (units[2, -1], 0, 4)])
    model = toxicity.Model(*(np.array(c, k) for c, k in zip(zip(*known), (np.uint64, np.int64, np.int64))), share)
    logit = lambda p: math.log(p / (1 - p))
    three = (6 + 5 * share) / 13
    four = (5 + 5 * three) / 11
    want = [(3 + 5 * four) / 8, four, 5 * share / 9]
    assert np.allclose(model.log_odds(w), [logit(p) - logit(share) for p in want])


def test_log_odds_of_units_of_many_texts_are_finite():
    """A word whose every beginning stands in thousands of texts of one class: its other share is tiny, not 0."""
    (w,) = toxicity.words_of(["zogarkument"])
    units = np.sort(w.units[0])
    for many, none in ((0, 1), (1, 0)):
        columns = np.zeros((2, len(units)), np.int64)
        columns[many] = 7400
        model = toxicity.Model(units, columns[0], columns[1], 0.5)
        (odds,) = model.log_odds(w)
        want = math.log(7405 / 5) * len(units)  # each unit leaves 5 in 7,405 of what was left
        assert np.isfinite(odds) and abs(abs(odds) - want) < 1 and (odds > 0) == (many == 0)


SCHEMA = "doc_id long, text string, score string, passages int, id string"


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    plain = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("lom", "rin", "sta", "ven")]
    rows, marks = [], []
    for i in range(n):
        words, bad = [rng.choice(plain) for _ in range(rng.randrange(5, 120))], rng.random() < 0.2
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), "zog" + rng.choice("aeiou") + rng.choice(["rk", "lt", "mm"]))
        rows.append((i, " ".join(words), "x", 1, "y"))
        marks.append((i, int(bad)))
    return rows, marks


def test_odd_rows_and_passages(spark):
    rows, marks = corpus()
    odd = [(1000, None), (1001, ""), (1002, " \t."), (1003, rows[0][1] + " zogark you zogelt"), (None, "zogark zogelt zogirk"), (1005, (rows[0][1] + " ") * 3000), (1006, (rows[0][1] + " ") * 500 + "zogark zogamm zogilt zogurk " + rows[1][1]), (1003, rows[0][1] + " zogark you zogelt")]
    docs = spark.createDataFrame([*rows, *((i, t, "x", 1, "y") for i, t in odd)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([*marks, (1, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    found = toxicity.classify(docs, scorer, keep=("score", "passages", "id")).collect()
    assert set(found[0].asDict()) == {"id", "passages", "score", "predicted", "starts", "ends", "beyond"} and len(found) == len(rows) + len(odd)
    got = {r.id: r for r in found}
    truth = dict(marks)
    assert sum(got[i].predicted == y for i, y in marks) >= 0.98 * len(marks)
    assert got[1003].predicted == got[None].predicted == got[1006].predicted == 1 and got[1000].predicted == got[1001].predicted == got[1002].predicted == 0
    assert got[1000].score == got[1001].score and got[1000].starts == [] and (got[1005].predicted == 1) == bool(truth[0])
    text = odd[6][1]
    assert any(text[a:b] == "zogark zogamm zogilt zogurk" for a, b in zip(got[1006].starts, got[1006].ends))
    assert all(0 <= r.score <= 1 and len(r.starts) == len(r.ends) == len(r.beyond) for r in found)


def test_empty_tables_and_no_labels(spark):
    rows, marks = corpus(2, 40)
    docs, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    blank = toxicity.fit(docs, none)
    assert {round(r.score, 9) for r in toxicity.classify(docs, blank).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
    clean = toxicity.fit(docs, spark.createDataFrame([(i, 0) for i, _ in marks], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.classify(docs, clean).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_registered_query_on_held_out_labels(spark, tmp_path):
    """Only labels that the fit never saw count; and other labels for those change no score."""
    marks = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    poor = {i for (i,) in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 0").fetchall()}
    found = {r.doc_id: r for r in registry.QUERIES["op13_toxicity"](spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(marks[i], r.predicted, i) for i, r in found.items() if r.held_out and i in marks]
    caught, toxic = sum(y and p for y, p, _ in held), sum(y for y, _, _ in held)
    false = sum(p and not y for y, p, _ in held)
    print(f"held out: {caught} of {toxic} toxic texts found, {false} of {len(held) - toxic} clean ones")
    assert toxic > 100 and caught >= 0.93 * toxic and false <= 0.01 * (len(held) - toxic)
    good = [(y, p) for y, p, i in held if i not in poor and y]
    assert sum(p for _, p in good) >= 0.97 * len(good)
    turned = ",".join(str(i) for _, _, i in held)
    duckdb.sql(f"copy (select * from '{SF}/documents.parquet') to '{tmp_path}/documents.parquet'")
    duckdb.sql(f"copy (select doc_id, quality, case when doc_id in ({turned}) then 1 - toxic else toxic end as toxic from '{SF}/labels.parquet') to '{tmp_path}/labels.parquet'")
    again = {r.doc_id: r.score for r in registry.QUERIES["op13_toxicity"](spark, str(tmp_path)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in found.items())
