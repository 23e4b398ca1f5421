"""The registered queries on the driver's smallest tables: against their SQL, the libraries, or plain loops."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, quality_classifier, registry

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="driver tables are not here")


@pytest.fixture(scope="module")
def docs():
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()}


def result(spark, name, folder=SMALL):
    return registry.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rel, rows = con.sql(registry.ORACLE_SQL[name]), result(spark, name)
    assert collections.Counter(tuple(r) for r in rel.select(*rows[0].__fields__).fetchall()) == collections.Counter(map(tuple, rows))


def test_op1_digests(spark, docs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.model(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result(spark, "op1_byte_bpe")} == want


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_op2_components(spark, docs):
    sets, label = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, "op2_ngram_join")} == {i: (len(sets[i]), label[i]) for i in docs}


def test_op3_and_op7_ids(spark, docs):
    plain, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, {}
    for i, t in sorted(docs.items()):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op3_token_files")} == want
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in docs.items()}
    covered = collections.Counter()
    for r in result(spark, "op7_packing"):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        covered.update((r.doc_id, r.start + k) for k in range(r.length))
    assert covered == collections.Counter((i, k) for i, x in ids.items() for k in range(len(x)))


def test_op9_counts(spark, docs):
    for r in result(spark, "op9_quality_rules"):
        t = docs[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and r.kept == (not r.base_failed and r.rule is None)


def test_op10_learns_from_four_fifths_only(spark):
    known = dict(duckdb.sql(f"select doc_id, lang from '{MIDDLE}/documents.parquet' where lang is not null and text is not null").fetchall())
    rows = result(spark, "op10_language_id", MIDDLE)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known and r.lang_pred != "und"]
    assert len(held) > 100 and sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)


LARGE = "/root/testdata/sf0.1"


def test_op5_on_withheld_labels(spark):
    """Against the labels that had no vote in the fit, and no others."""
    own = spark.read.parquet(f"{LARGE}/labels.parquet").where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_classifier.WITHHELD)) == 0).collect()
    got = {r.doc_id: r for r in result(spark, "op5_quality_classifier", LARGE)}
    good = {y: [r.doc_id for r in own if r.quality == 1 and r.toxic == y] for y in (0, 1)}
    poor = [r.doc_id for r in own if r.quality == 0]
    caught, gone, kept = sum(got[i].toxicity >= quality_classifier.TOXIC for i in good[1]), sum(not got[i].kept for i in poor), sum(got[i].kept for i in good[0])
    print(f"withheld: {caught} of {len(good[1])} toxic, {gone} of {len(poor)} poor, {kept} of {len(good[0])} clean texts kept")
    assert len(good[1]) > 60 and caught >= 0.9 * len(good[1]) and gone >= 0.95 * len(poor) and kept >= 0.97 * len(good[0])
