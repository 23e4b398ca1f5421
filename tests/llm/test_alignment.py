"""Cross-tokenizer alignment against plain loops over the libraries' own tokens."""

import collections
import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import alignment, registry

SMALL = "/root/testdata/sf0.001"
BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PLAIN = Tokenizer.from_file(BYTES)
PLAIN.encode_special_tokens = True
PIECE = sentencepiece.SentencePieceProcessor(model_file=PIECES)
OF = alignment.byte_of()


def one(text):
    """(a ids, b ids, groups, links) of a text by plain loops."""
    if not text:
        return [], [], [], []
    a, b = PLAIN.encode(" " + text, add_special_tokens=False).ids, PIECE.encode(text)
    raw_a = [bytes(OF[c] for c in PLAIN.id_to_token(i)) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if PIECE.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, PIECE.id_to_piece(i)) for i in b)]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], [], []
    groups, links, x, y, i, j, p, q = [], [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if p <= q and i < len(a):
            x.append(a[i])
            p, i = p + len(raw_a[i]), i + 1
        else:
            y.append(b[j])
            q, j = q + len(raw_b[j]), j + 1
        if p == q and x and y:
            groups.append((x, y))
            links.append((x[-1], y[-1]))
            x, y = [], []
    return a, b, groups, links


def digest(groups):
    line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return hashlib.sha256(line.encode()).hexdigest() if line else ""


def plain(rows):
    found = [(i, one(t)) for i, t in rows]
    count = collections.Counter(k for _, (_, _, _, links) in found for k in links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((i, len(a), len(b), len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), digest(g)) for i, (a, b, g, k) in found), key=repr)


def got(df, name):
    return sorted((tuple(r[c] for c in (name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


ODD = [None, "", " ", "  two  spaces\t\n\n x", "one", "one", "café 你好 \U0001f642 \x00\x01 \x85", "holds ▁ the mark", "<|endoftext|> and <s> </s> <unk> <0x41>", "Woŕds é", "word " * 4000, "y" * 3000, "The tion of 1234567 isn't it's\r\n{\r\n}", " 　​"]


def test_equals_plain_loops(spark):
    rows = [*enumerate(ODD), (5, "one"), (None, "null id"), (-4, "The words that stand here.")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_a int, links string, id string").repartition(3)
    assert got(alignment.scored(docs, BYTES, PIECES), "id") == plain(rows)
    assert alignment.scored(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0
    held = alignment.align_documents(docs, BYTES, PIECES).where("id = 7").first()
    assert (held.n_a, held.n_b, held.groups_sha256, bytes(held.links)) == (0, 0, "", b"")  # U+2581 becomes a space


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" \n\t\r{}();.,'▁ 　abcdethiné你\U0001f642", max_size=30), st.text(max_size=12)), max_size=6))
def test_batches_equal_single_texts(texts):
    both = alignment.aligner(BYTES, PIECES)
    for text, (n_a, n_b, n_groups, sha, links) in zip(texts, both.align(texts)):
        a, b, groups, pairs = one(text)
        numbers = [int.from_bytes(links[k : k + 4], "little") for k in range(0, len(links), 4)]
        assert (n_a, n_b, n_groups, sha) == (len(a), len(b), len(groups), digest(groups))
        assert numbers == (both.pair(*np.array(pairs).T).tolist() if pairs else [])
        assert both.second(np.array(numbers, np.int64)).tolist() == [b for _, b in pairs]


def test_bytes_are_compared_where_a_model_might_change_them(monkeypatch):
    both = alignment.Aligner(BYTES, PIECES)
    assert both.a_exact and both.b_exact
    texts = [t or "" for t in ODD]
    want = both.align(texts)
    both.a_exact = both.b_exact = False
    assert both.align(texts) == want
    both.a_bytes[both.a.tokenizer.token_to_id("one")] = b"two"
    assert both.align(["xone"])[0][:3] == (0, 0, 0) and both.align(["x two"])[0][0] > 0


def test_pairs_have_numbers_of_their_own():
    both = alignment.aligner(BYTES, PIECES)
    known = {}
    for j, x in enumerate(both.b_bytes):
        known.setdefault(x, []).append(j)
    of_a = {x: i for i, x in enumerate(both.a_bytes)}
    pairs = {(i, j) for i, x in enumerate(both.a_bytes) for k in range(len(x)) for j in known.get(x[k:], ())}
    pairs |= {(of_a[x[k:]], j) for j, x in enumerate(both.b_bytes) for k in range(len(x)) if x[k:] in of_a}
    a, b = np.array(sorted(pairs)).T
    numbers = both.pair(a, b)
    assert len(np.unique(numbers)) == len(pairs) > 300_000 and numbers.max() < both.pairs and (both.second(numbers) == b).all()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_registered_query_equals_plain_loops(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    assert got(registry.QUERIES["op12_alignment"](spark, SMALL), "doc_id") == plain(docs)
