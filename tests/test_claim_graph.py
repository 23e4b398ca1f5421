"""Claim graphs against a plain union-find and a plain work list; chains, hubs, circles, nulls, empty graphs."""

import random

import pytest

from tidewatch.operators import claim_graph

ALIASES = "entity string, alias string"


def united(rows):
    """entity -> (smallest, size) by a plain union-find."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for e, a in rows:
        if e is not None:
            top(("e", e))
            if a is not None and a.strip():
                up[top(("e", e))] = top(("n", a.strip().lower()))
    groups = {}
    for kind, e in list(up):
        if kind == "e":
            groups.setdefault(top((kind, e)), []).append(e)
    return {e: (min(g), len(g)) for g in groups.values() for e in g}


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "odd"])
def test_closure_equals_union_find(spark, kind):
    rnd = random.Random(2)
    rows = {
        "random": [(f"e{rnd.randrange(200)}", f"n{rnd.randrange(260)}") for _ in range(230)],
        "chain": [(f"e{(k + d) * 7919 % 300:03d}", f"n{k}") for k in range(150) for d in (0, 1)],
        "hub": [(f"e{k}", "All") for k in range(400)] + [(f"f{k}", f"x{k // 2}") for k in range(40)],
        "odd": [("a", " Same "), ("b", "sAME"), ("b", "sAME"), ("c", None), ("d", "  "), ("e", ""), (None, "same"), ("f", "x"), ("f", "y"), ("g", "y")],
    }[kind]
    df = spark.createDataFrame(rows, ALIASES)
    out = claim_graph.closure(df, "entity", "alias")
    assert {r.entity: (r.canonical, r.n_entities) for r in out.collect()} == united(rows)
    if kind == "odd":
        asked = spark.createDataFrame([("SAME",), ("none",), (None,), ("y ",)], "q string")
        assert {r.q: r.canonical for r in claim_graph.resolved(asked, "q", df, out, "entity", "alias").collect()} == {"SAME": "a", "none": None, None: None, "y ": "f"}


def test_no_aliases(spark):
    assert claim_graph.closure(spark.createDataFrame([], ALIASES), "entity", "alias").count() == 0


def test_compiled(spark):
    make = spark.createDataFrame
    claims = make([("a", "x", "FACT"), ("a", "x", "FACT"), ("b", "y", None), ("b", "z", "FACT"), (None, "q", None)], "claim string, statement string, status string")
    edges = make([("e", "a", "about", "b"), ("e", "a", "about", "b"), ("f", "a", "about", "b"), ("f", "a", "cites", None)], "edge string, source string, kind string, target string")
    links = make([("a", "b"), ("b", "a"), ("a", "a"), ("a", "unknown"), ("a", None)], "a string, b string")
    one, lines, pairs, problems = claim_graph.compiled(claims, edges, links)
    assert sorted((r.claim, r.statement, r.status) for r in one.collect()) == [("a", "x", "FACT"), ("b", "y", "FACT")]
    assert sorted(tuple(r) for r in lines.collect()) == [("e", "a", "about", "b"), ("f", "a", "about", "b")]
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b"), ("b", "a")]
    assert sorted(tuple(r) for r in problems.collect()) == [("CLAIM", "b"), ("EDGE", "f"), ("SELF", "a")]


def plain(claims, pairs, supports):
    """A work list."""
    against, strong = {a for a, _ in pairs}, {c for c, s, t in claims if s == "FACT" and t and "T0_PRIMARY_MACHINE" in t}
    free = {c for c, s, _ in claims if s == "FACT" and c not in against}
    depth, todo = {c: 0 for c in strong & free}, sorted(strong & free)
    for by in todo:
        for c, b in supports:
            if b == by and c in free and c not in depth:
                depth[c] = depth[by] + 1
                todo.append(c)
    clash = {a for a, b in pairs if a in strong and b in strong}
    return {c: (s if s != "FACT" else "FACT" if c in depth else "DISPUTED" if c in clash else "CONTRADICTED" if c in against else "UNSUPPORTED", depth.get(c)) for c, s, _ in claims}


def test_settled_equals_a_work_list(spark):
    rnd = random.Random(4)
    claims = [(k, rnd.choice(["FACT", "FACT", "FACT", "OPINION", None]), rnd.choice([["T0_PRIMARY_MACHINE"], ["T4_X"], [], None, ["T4_X", "T5_Y"]])) for k in range(300)]
    half = [(a, b) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(50)) if a != b]
    pairs = sorted({*half, *((b, a) for a, b in half)})
    supports = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(500)] + [(k + 1, k) for k in range(100, 140)] + [(298, 299), (299, 298), (None, 1), (1, None)]
    make = spark.createDataFrame
    out = claim_graph.settled(make(claims, "claim bigint, status string, tiers array<string>"), make(pairs, "a bigint, b bigint"), make(supports, "claim bigint, by bigint"))
    got = {r.claim: (r.status, r.depth) for r in out.collect()}
    assert got == plain(claims, pairs, supports) and {"FACT", "DISPUTED", "CONTRADICTED", "UNSUPPORTED", "OPINION", None} == {s for s, _ in got.values()} and max(d or 0 for _, d in got.values()) > 2


def test_no_claims(spark):
    make = spark.createDataFrame
    out = claim_graph.settled(make([], "claim bigint, status string, tiers array<string>"), make([], "a bigint, b bigint"), make([], "claim bigint, by bigint"))
    assert out.count() == 0
