"""Nearest analogs in blocks against plain loops: metrics, ties, zero vectors, unknown components."""

import math
import random

import pytest

from tidewatch.operators import analogs


def far(a, b, metric):
    if metric == "euclidean":
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    if metric == "manhattan":
        return sum(abs(x - y) for x, y in zip(a, b))
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return 0.0 if na == nb == 0 else 1.0 if 0 in (na, nb) else 1 - sum(x * y for x, y in zip(a, b)) / (na * nb)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("prior", [True, False])
def test_blocks_equal_plain_loops(spark, monkeypatch, metric, prior):
    monkeypatch.setattr(analogs, "BLOCK", 7)
    monkeypatch.setattr(analogs, "ROWS", 5)
    monkeypatch.setattr(analogs, "SLICES", 3)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)] if i % 9 else [0.0] * 4) for i in range(150)]
    odd = [(150, None), (151, [1.0, None, 0.0, 1.0]), (152, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    history = spark.createDataFrame(rows + odd, "i long, v array<double>")
    asked = spark.createDataFrame([(i, v, i) for i, v in rows + odd[:2] if i is not None and i % 4 in (0, 3)], "query long, query_vector array<double>, query_order long")
    found = analogs.nearest(asked, history, "v", "i", 3, metric, min_history=2, prior_only=prior)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()  # no row of pairs is ever made
    got = {(r.query, r["rank"]): (r.candidate, round(r.distance, 9)) for r in found.collect()}
    want = {}
    for q, a in rows:
        near = sorted((round(far(a, b, metric), 9), c) for c, b in rows if (c < q if prior else c != q))
        if q % 4 in (0, 3) and len(near) >= 2:
            want |= {(q, k + 1): (c, d) for k, (d, c) in enumerate(near[:3])}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    if metric != "cosine":  # equal directions of other lengths differ by rounding
        assert got == want
