"""Expectation-maximisation and the linear scorer against plain loops; the labeller by word beginnings."""

import math
import random

import numpy as np
import pytest

from tidewatch.llm import quality_classifier as qc
from tidewatch.llm import toxicity
from tidewatch.llm.hashing import word_hashes


def plain_em(vote, weight, rounds, prior):
    """The two-class model by loops over rows and labellers."""
    post = []
    for row in vote:
        good, bad = sum(v == qc.GOOD for v in row), sum(v == qc.BAD for v in row)
        start = (bad + 2 * prior * (bad > 0)) / max(good * 0.3 + bad, 1) if good + bad else prior
        post.append(min(0.98, max(0.02, start)))
    tables = []
    for _ in range(rounds):
        tables = []
        for j in range(len(vote[0])):
            rows = [(v[j], w, p) for v, w, p in zip(vote, weight, post) if v[j] != qc.NOT_ASKED]
            tables.append([{k: (sum(w * (p if c else 1 - p) for v, w, p in rows if v == k) + 0.5 + (k == side)) / (sum(w * (p if c else 1 - p) for _, w, p in rows) + 2.5) for k in (qc.ABSTAIN, qc.GOOD, qc.BAD)} for c, side in ((0, qc.GOOD), (1, qc.BAD))])
        share = min(0.5, max(1e-3, sum(w * p for w, p in zip(weight, post)) / sum(weight)))
        post = []
        for row in vote:
            odds = math.log(share / (1 - share)) + sum(math.log(tables[j][1][v] / tables[j][0][v]) for j, v in enumerate(row) if v != qc.NOT_ASKED)
            post.append(1 / (1 + math.exp(-max(-35, min(35, odds)))))
    return post, tables


@pytest.mark.parametrize("seed", range(4))
def test_em_equals_plain_loops(seed):
    rng = random.Random(seed)
    vote = [[rng.choice((qc.ABSTAIN, qc.GOOD, qc.BAD, qc.NOT_ASKED)) for _ in range(5)] for _ in range(40)]
    weight = [rng.randrange(1, 30) for _ in vote]
    post, table = qc.expectation_maximisation(np.array(vote), np.array(weight, float), rounds=25, prior=0.1)
    want, tables = plain_em(vote, weight, 25, 0.1)
    assert np.allclose(post, want, atol=1e-9)
    assert all(abs(table[j, c, k] - tables[j][c][k]) < 1e-9 for j in range(5) for c in (0, 1) for k in (qc.ABSTAIN, qc.GOOD, qc.BAD))


def plain_margins(text, scorer):
    """Both margins of one text, feature by feature."""
    raw = text.encode()
    words = raw.lower().split()
    number = lambda w: int(word_hashes([w]).hash[0] >> np.uint64(48))
    start = lambda w, n: int(word_hashes([w], n).prefix[0] >> np.uint64(48))
    buckets = {number(w) for w in words} | {start(w, n) for w in words for n in qc.PREFIXES}
    kinds = [int(qc._CLASS[b]) for b in raw]
    pairs = {}
    for a, b in zip(kinds, kinds[1:]):
        pairs[a * 16 + b] = pairs.get(a * 16 + b, 0) + 1
    count = lambda *ks: sum(k in ks for k in kinds)
    letters, n = max(1, count(2, 3)), max(1, len(words))
    shares = [sum(a == b for a, b in zip(words, words[1:])) / n, count(9, 11) / letters, count(2) / letters, count(6) / n, count(10) / n]
    rest = {qc.BUCKETS + p: 4.0 * c / max(1, len(raw) - 1) for p, c in pairs.items()} | {qc.BUCKETS + qc.PAIRS + k: 8.0 * min(1.0, x) for k, x in enumerate(shares) if x}
    (q, q0), (t, t0) = scorer.quality, scorer.toxicity
    scale = 3.0 / math.sqrt(max(9, len(buckets)))
    return q0 + sum(q[b] * scale for b in buckets) + sum(4.0 * x * q[i] for i, x in rest.items()), t0 + sum(t[b] for b in buckets) + sum(x * t[i] for i, x in rest.items())


def test_scores_equal_plain_margins():
    rng = np.random.Generator(np.random.PCG64(5))
    scorer = qc.Scorer((rng.normal(0, 0.3, qc.SIZE), 0.1), (rng.normal(0, 0.3, qc.SIZE), -0.2), {}, {})
    texts = ["", " \n\t", "one", "The cat, the CAT the cat!", "café | 你好 你好 ###$$ 12.5\nnext line here", "abcdefghij abcdefgxyz " * 30]
    quality, toxic = scorer.score(texts)
    for text, a, b in zip(texts, quality, toxic):
        x, y = plain_margins(text, scorer)
        assert a == pytest.approx(1 - 1 / (1 + math.exp(-x))) and b == pytest.approx(1 / (1 + math.exp(-y)))


def test_beginnings_of_other_folds_vote():
    texts = ["zogark was here with nothing else to say", "zogelt was there and nothing came of it", "nothing was here", "zogamm is what they said"]
    units = {}
    for k, (text, toxic) in enumerate(zip(texts[:3], (1, 1, 0))):
        for w in toxicity.words_of([text]):
            for u in np.unique(w.units[w.units > 0]).tolist():
                units.setdefault(u, [0] * 8)[(0 if toxic else 4) + k % 4] += 40
    known = sorted(units.items())
    table = np.array([c for _, c in known])
    counts = toxicity.Counts(np.array([u for u, _ in known], np.uint64), table[:, :4], table[:, 4:])
    models = {k: counts.without(k) for k in range(-1, 4)}
    assert qc.beginnings([texts[3], texts[2], ""], [-1, -1, -1], models) == [qc.BAD, qc.GOOD, qc.GOOD]
    nothing = toxicity.Counts(np.empty(0, np.uint64), np.empty((0, 4), np.int64), np.empty((0, 4), np.int64))
    assert qc.beginnings(texts, [-1, 0, 1, 2], {k: nothing.without(k) for k in range(-1, 4)}) == [qc.NOT_ASKED] * 4
