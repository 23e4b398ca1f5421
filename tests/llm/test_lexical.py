"""Ranked lexical search against plain loops: small tables with odd rows, and the registered query."""

import collections
import math
import os
import re

import duckdb
import numpy as np
import pytest

from tidewatch.llm import lexical, registry

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=20):
    """Every document for every item."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for name, text in items:
        found = []
        for i, bag in bags:
            size = sum(bag.values())
            m = 75 + (25 * size * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(name, k + 1, i, -s) for k, (s, _, i) in enumerate(found[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


ODD = [
    (1, "Alpha beta, beta GAMMA"), (2, None), (3, ""), (4, "   \t..."), (5, "alpha alpha alpha"), (5, "alpha alpha alpha"), (7, "alpha alpha alpha"), (None, "alpha alpha alpha"),
    (9, "café 你好 x y İstanbul"), (10, "beta " * 3000), (11, "a" * 5000 + " gamma"), (12, "delta_epsilon delta 42 4½"), (-3, "gamma\x00beta\x7falpha"), (14, "word " * 40 + "rare"),
]
ASKED = [(0, "alpha BETA alpha"), (1, None), (2, ""), (3, "café 你好 x y"), (3, "gamma"), (4, "nothing here"), (5, "delta epsilon 42 rare"), (6, "A" * 5000), (7, "istanbul İstanbul"), (8, "...")]


@pytest.mark.parametrize("block", [lexical.BLOCK_BYTES, 2000])
def test_equals_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, 7, "s", "r") for i, t in ODD], "doc_id long, text string, n int, score string, rank string").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ASKED], "item_id long, text string, score int")
    for top in (20, 2):
        assert got(lexical.search(docs, items, top)) == plain(ODD, ASKED, top)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.search(docs, asked).count() == lexical.search(some, items).count() == lexical.search(docs, items).count() == 0


def test_pieces_lose_no_term(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "one two threefourfivesix, seven " * 9 + "x" * 10_000
    known = lexical.Vocabulary.of({b"one", b"seven", b"threefourfivesix", b"x" * 10_000, b"absent"})
    text_of, number, count, total = known.found([b"", text.encode(), b"seven"])
    names = [known.text[s : s + n].tobytes().decode() for s, n in zip(known.start.tolist(), known.size.tolist())]
    assert collections.Counter({(t, names[k]): c for t, k, c in zip(text_of.tolist(), number.tolist(), count.tolist())}) == {(1, "one"): 9, (1, "seven"): 9, (1, "threefourfivesix"): 9, (1, "x" * 10_000): 1, (2, "seven"): 1}
    assert total.tolist() == [0, 37, 1]


def test_rows_in_small_parts_keep_the_best():
    rng, best, whole = np.random.Generator(np.random.PCG64(1)), lexical._Best(5, 4), []
    for at in range(0, 90, 9):
        scores, ids, null = rng.integers(0, 6, (9, 5)), rng.integers(0, 40, 9), rng.random(9) < 0.2
        best.add(scores, ids, null)
        whole += [(k, -int(s), bool(n), int(i)) for row, i, n in zip(scores, ids, null) for k, s in enumerate(row) if s > 0]
    want = [x for k in range(5) for x in sorted(x for x in whole if x[0] == k)[:4]]
    assert list(zip(best.item.tolist(), (-best.score).tolist(), best.null.tolist(), best.id.tolist())) == want


def test_equal_hashes_are_not_equal_terms(monkeypatch):
    known = lexical.Vocabulary.of({b"one", b"two"})
    same = lexical._hashed
    monkeypatch.setattr(lexical, "_hashed", lambda buf, seed: (lambda h, a, b: (h * 0 + known.hashes[0], a, b))(*same(buf, seed)))
    text, number, count, _ = known.found([b"one two six"])
    assert len(text) == 1 and count.tolist() == [1]  # the one term whose bytes are the same


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_registered_query_equals_plain_loops(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SMALL}/benchmark.parquet'").fetchall()
    assert got(registry.QUERIES["op11_lexical_search"](spark, SMALL)) == plain(docs, items)
