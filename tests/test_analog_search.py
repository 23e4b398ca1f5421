"""Nearest analogs by an index against plain loops over all pairs: filters, unknown components, blocks, clusters."""

import math
import os
import random

import numpy as np
import pytest

from tidewatch.operators import analog_search, research
from tidewatch.operators.analog_search import Scenario
from tidewatch.plans import queries

SF = "/root/testdata/sf0.001"

HISTORY = "time bigint, known bigint, regime string, provider string, v array<double>"
QUERIES = "query bigint, time bigint, cutoff bigint, regime string, v array<double>"


def clustered(seed, n, size, clusters=12, unknown=0.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-40, 40) for _ in range(size)] for _ in range(clusters)]
    rows = []
    for t in range(n):
        c = rng.randrange(clusters) if t % 3 else 0  # one cluster holds a third of all rows
        v = [None if rng.random() < unknown else x + rng.gauss(0, 1) for x in centres[c]]
        rows.append((t, t + rng.randrange(4), "ABC"[c % 3], "xy"[t % 2], rows[-7][4] if t % 11 == 10 else v))
    return rows


def plain(history, queries, scenarios):
    """The definition: candidates, their means and deviations, and every distance."""
    matches, states = {}, {}
    for query, time, cutoff, regime, v in queries:
        for s in scenarios:
            own = [k for k in range(len(v)) if k not in s.excluded]
            able = [h for h in history if h[1] < cutoff and h[0] != time and all(h[4][k] is not None for k in own) and (s.lookback is None or h[0] >= time - s.lookback) and (not s.same_regime or h[2] == regime) and (not s.providers or h[3] in s.providers)]
            reasons = [r for r, x in (("INSUFFICIENT_HISTORY", len(able) < s.min_history), ("MISSING_SIGNALS", any(v[k] is None for k in own)), ("QUERY_REGIME_NO_DATA", regime == "NO_DATA")) if x]
            states[query, s.name] = (len(able), reasons)
            if reasons:
                continue
            mean = {k: sum(h[4][k] for h in able) / len(able) for k in own}
            scale = {k: math.sqrt(sum((h[4][k] - mean[k]) ** 2 for h in able) / len(able)) for k in own}
            z = lambda x: [(x[k] - mean[k]) / (scale[k] if scale[k] > 1e-9 else 1.0) for k in own]  # noqa: B023, E731
            q, found = z(v), []
            for h in able:
                a = z(h[4])
                if s.metric == "euclidean":
                    d = math.sqrt(sum((x - y) ** 2 for x, y in zip(a, q)))
                elif s.metric == "manhattan":
                    d = sum(abs(x - y) for x, y in zip(a, q))
                else:
                    d = 1 - sum(x * y for x, y in zip(a, q)) / (math.hypot(*a) * math.hypot(*q))
                found.append((d, h[0]))
            matches[query, s.name] = sorted(found)[: s.k]
    return matches, states


SCENARIOS = [
    Scenario("base", min_history=10), Scenario("manhattan", "manhattan", min_history=10), Scenario("cosine", "cosine", min_history=10), Scenario("regime", same_regime=True, min_history=30, k=3),
    Scenario("lookback", lookback=120, min_history=10), Scenario("provider", "manhattan", providers=("x",), min_history=10), Scenario("fewer", excluded=(0, 3), min_history=10), Scenario("other", excluded=(1,), min_history=10, k=7),
    Scenario("all", "manhattan", (2,), 4, 8, True, 200, ("x", "z")),
]


def compare(got, want):
    assert set(got) == set(want)
    for key, rows in want.items():
        mine = sorted(got[key])
        assert [round(d, 6) for _, d, _ in mine] == [round(d, 6) for d, _ in rows], key
        near = [abs(a - b) < 1e-7 for (a, _), (b, _) in zip(rows, rows[1:])]
        if not any(near):
            assert [c for _, _, c in mine] == [c for _, c in rows], key


@pytest.mark.parametrize(("unknown", "block"), [(0.0, 2000), (0.02, 7)])
def test_equals_all_pairs(spark, monkeypatch, unknown, block):
    monkeypatch.setattr(analog_search, "BLOCK", block)
    history = clustered(5, 500, 6, unknown=unknown)
    queries = [(1000 + h[0], h[0], h[0] - h[0] % 5, h[2], h[4]) for h in history[::40]] + [(1, 9000, 10**6, "A", [0.0] * 6), (2, 9001, 10**6, "NO_DATA", history[3][4]), (3, 9002, -5, "B", history[4][4]), (4, 9003, 10**6, "C", [None, *history[5][4][1:]]), (5, 9000, 10**6, "Z", history[9][4])]
    index = analog_search.build(spark.createDataFrame([*history, (None, 1, "A", "x", [0.0] * 6), (10**7, 5, "A", "x", None)], HISTORY).repartition(3), 6, [(), (0, 3)], 20)
    matches, states, work = analog_search.search(index, spark.createDataFrame(queries, QUERIES), SCENARIOS)
    want, told = plain(history, queries, SCENARIOS)
    got = {}
    for r in matches.collect():
        got.setdefault((r.query, r.scenario), []).append((r["rank"], r.distance, r.candidate))
    compare(got, want)
    assert {(r.query, r.scenario): (r.n, r.reasons) for r in states.collect()} == told
    assert {r.scenario for r in work.collect()} == {s.name for s in SCENARIOS}


def test_fewer_than_a_third_of_the_pairs_is_measured(spark):
    history = clustered(8, 3000, 8, 30)
    queries = [(h[0], h[0], 10**6, h[2], h[4]) for h in history[::60]]
    index = analog_search.build(spark.createDataFrame(history, HISTORY).repartition(4), 8)
    some = [Scenario("l2"), Scenario("l1", "manhattan"), Scenario("cosine", "cosine")]
    matches, _, work = analog_search.search(index, spark.createDataFrame(queries, QUERIES), some)
    want, _ = plain(history, queries, some)
    got = {}
    for r in matches.collect():
        got.setdefault((r.query, r.scenario), []).append((r["rank"], r.distance, r.candidate))
    compare(got, want)
    done = {r.scenario: r.measured / r.possible for r in work.collect()}
    print(done)
    assert done["l2"] < 1 / 3 and done["l1"] < 1 / 3 and done["cosine"] == 1


def random_rows(seed, n, queries, size, late=3):
    rng = np.random.default_rng(seed)
    time = rng.permutation(n)
    v = rng.standard_normal((n, size)) + 5
    v[n // 2] = 5.0
    v[n // 3] = v[n // 4]
    v[::97, 1] = np.nan
    text = lambda k: np.array([f"{'rp'[k == 2]}{i}" for i in rng.integers(0, k, n)], object)
    rows = {"time": time, "known": time + rng.integers(-1, late, n), "regime": text(3), "provider": text(2), "v": v}
    some = rng.permutation(n)[:queries]
    return rows, analog_search._Asked(time[some], time[some] + 1, rows["regime"][some], np.nan_to_num(v[some], nan=4.0))


def allowed(rows, asked, s):
    own = [k for k in range(rows["v"].shape[1]) if k not in s.excluded]
    ok = (rows["known"][:, None] < asked.cutoff) & (rows["time"][:, None] != asked.time) & ~np.isnan(rows["v"][:, own]).any(axis=1)[:, None]
    ok &= rows["time"][:, None] >= asked.time - (s.lookback or 10**9)
    ok &= (rows["regime"][:, None] == asked.regime) | (not s.same_regime)
    return ok & np.isin(rows["provider"], s.providers or ["p0", "p1"])[:, None]


@pytest.mark.parametrize("s", [Scenario(f"{m}{r}", m, x, same_regime=r) for m in analog_search.METRICS for x, r in (((), True), ((1, 2), False))] + [Scenario("lookback", lookback=400), Scenario("provider", "manhattan", providers=("p1",), k=3)], ids=lambda s: s.name)
def test_few_pairs_are_measured_each_by_itself(monkeypatch, s):
    """Matrices tell which pairs may be among the nearest: 2,000 rows are not measured pair by pair, and none is lost."""
    rows, asked = random_rows(3, 2000, 40, 8)
    pairs, measure = [], analog_search._measure
    monkeypatch.setattr(analog_search, "_measure", lambda x, *rest: pairs.append(len(x)) or measure(x, *rest))
    mean, scale = np.full((40, 8), 5.0) + np.arange(40)[:, None] / 400, 1 + np.arange(320).reshape(40, 8) / 500
    index = {"spaces": (), "means": np.full(8, 5.0), "scales": np.ones(8), "pivots": []}
    task = analog_search._Search(s, index, asked, mean, scale, np.arange(40))
    for i in range(0, 2000, 700):
        task.batch({k: a[i : i + 700] for k, a in rows.items()}, np.full(len(rows["time"][i : i + 700]), -1), None)
    ok, got = allowed(rows, asked, s), {}
    assert task.measured == ok.sum() and sum(pairs) < ok.sum() / 3
    for q, t, d in zip(*task.found()):
        got.setdefault(int(q), []).append((float(d), int(t)))
    own = analog_search._selected(8, s.excluded)
    for q in range(40):
        r = np.flatnonzero(ok[:, q])
        same = lambda a: np.broadcast_to(a[q, own], (len(r), len(own)))  # noqa: B023, E731
        far = measure(rows["v"][r][:, own], same(asked.v), same(mean), same(scale), s.metric)
        want = sorted(zip(far.tolist(), rows["time"][r].tolist()))[: s.k]
        assert [t for _, t in got.get(q, [])] == [t for _, t in want] and np.allclose([d for d, _ in got.get(q, [])], [d for d, _ in want], atol=1e-9)


@pytest.mark.parametrize(("late", "pairs"), [(3, 100_000), (900, 50), (1, 1)])
@pytest.mark.parametrize("same", [False, True])
def test_sums_with_a_lookback_hold_no_matrix(monkeypatch, late, pairs, same):
    """Sums of a slice by time, with rows that are known long after it or before it, and no mask of all pairs."""
    monkeypatch.setattr(analog_search, "PAIRS", pairs)
    monkeypatch.setattr(analog_search, "_allowed", None, raising=False)
    rows, asked = random_rows(4, 1000, 60, 4, late)
    for s in (Scenario("a", lookback=120, same_regime=same), Scenario("b", excluded=(1,), same_regime=same), Scenario("c", lookback=5, providers=("p0",), same_regime=same)):
        x = np.nan_to_num(rows["v"] - 5.0)
        want = allowed(rows, asked, s).T.astype(float) @ np.column_stack([np.ones(1000), x, x**2])
        assert np.allclose(analog_search._sums(rows, asked, s, np.full(4, 5.0)), want, atol=1e-7)


def test_empty_tables_and_bad_scenarios(spark):
    index = analog_search.build(spark.createDataFrame([], HISTORY), 3)
    asked = spark.createDataFrame([(1, 5, 9, "A", [1.0, 2.0, 3.0])], QUERIES)
    matches, states, _ = analog_search.search(index, asked, [Scenario("s")])
    assert matches.count() == 0 and [(r.n, r.reasons) for r in states.collect()] == [(0, ["INSUFFICIENT_HISTORY"])]
    assert all(f.count() == 0 for f in analog_search.search(index, asked.limit(0), [Scenario("s")]))
    for bad in ({"metric": "other"}, {"k": 0}, {"k": 9, "min_history": 3}, {"lookback": 0}):
        with pytest.raises(ValueError, match="scenario"):
            Scenario("s", **bad)


def test_sensitivity(spark):
    rows = [(1, "base", 10, 0.1, 1), (1, "base", 11, 0.2, 2), (1, "a", 10, 0.1, 1), (1, "a", 12, 0.2, 2), (1, "b", 12, 0.1, 1), (1, "b", 11, 0.2, 2), (2, "a", 10, 0.1, 1), (3, "base", 10, 0.1, 1), (3, "a", 10, 0.1, 1), (3, "b", 10, 0.1, 1)]
    matches = spark.createDataFrame(rows, "query bigint, scenario string, candidate bigint, distance double, rank int")
    states = spark.createDataFrame([(q, s, 30, ["INSUFFICIENT_HISTORY"] if (q, s) == (2, "base") else []) for q in (1, 2, 3) for s in ("base", "a", "b")], "query bigint, scenario string, n bigint, reasons array<string>")
    regimes = spark.createDataFrame([(10, "A"), (11, "A"), (12, "B")], "candidate bigint, regime string")
    got = {r.query: r for r in analog_search.sensitivity(matches, states, regimes, "base", 2).collect()}
    assert (got[1].ready, round(got[1].min_overlap, 6), got[1].agreement, got[1].reasons) == (2, round(1 / 3, 6), 0.5, ["OVERLAP", "REGIME"])
    assert got[2].reasons == ["BASE_NOT_READY"] and got[3].stable and got[3].min_overlap == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_registered_folds_equal_plain_loops(spark):
    """Every test day by its definition: analogs of what its fold was trained on, its scenarios, its vote."""
    days, tests = ([r.asDict() for r in x.collect()] for x in queries.fold_days(spark, SF))
    history = [(r["n"], r["resolved"], r["regime"], "p", r["v"]) for r in days]
    matches, states = plain(history, [(r["query"], r["time"], r["cutoff"], r["regime"], r["v"]) for r in tests], queries.FOLD_GRID)
    regime, outcome, want = {h[0]: h[2] for h in history}, {r["n"]: r["actual"] for r in days}, {}
    for r in tests:
        q = r["query"]
        names = lambda s: {c for _, c in matches[q, s]}  # noqa: B023, E731
        why = states[q, "base"][1]
        if not why:
            ready = [s.name for s in queries.FOLD_GRID[1:] if not states[q, s.name][1]]
            overlap = min((len(names(s) & names("base")) / len(names(s) | names("base")) for s in ready), default=None)
            same = [regime[matches[q, s][0][1]] == regime[matches[q, "base"][0][1]] for s in ready]
            why = [x for x, bad in (("FEW_READY", len(ready) < 3), ("OVERLAP", overlap is None or overlap < 0.4), ("REGIME", not same or sum(same) / len(same) < 0.6)) if bad]
        sims = [(1 / (1 + d), outcome[c]) for d, c in matches.get((q, "base"), [])]
        score = None if why else (r["prior"] + sum(s for s, y in sims if y)) / (1 + sum(s for s, _ in sims))
        want[q] = (r["fold_index"], r["actual"], score, ",".join(why))
    got = {r.n: (r.fold_index, r.actual, r.score, r.reasons) for r in queries.QUERIES["analog_folds"](spark, SF).collect()}
    assert set(got) == set(want) and sum(x[2] is not None for x in want.values()) > 20 and sum(x[2] is None for x in want.values()) > 20
    for q, (fold, actual, score, why) in want.items():
        assert (got[q][0], got[q][1], got[q][3]) == (fold, actual, why) and (got[q][2] == score if score is None else abs(got[q][2] - score) < 1e-5)
    row = queries.QUERIES["analog_fold_evidence"](spark, SF).first()
    answered = [x for x in want.values() if x[2] is not None]
    assert abs(row.n - len(answered)) <= 2 and abs(row.suppressed - (1 - len(answered) / len(want))) < 0.01 and row.comparator in ("B0", "B1", "B2", "B3")
    assert (row.state == "INSUFFICIENT_EVIDENCE") == any(x in row.reasons for x in ("TOO_FEW", "FEW_", "SUPPRESSED"))


def test_evidence_states(spark):
    """Each reason and each state, and no answers at all."""
    base = [(k, kind, s, k % 2 == 0) for k in range(80) for kind, s in (("B0", 0.5), ("B1", 0.4), ("B2", 0.9))]
    baselines = spark.createDataFrame(base, "query long, kind string, score double, actual boolean")
    eligible = spark.createDataFrame([("B0",), ("B1",)], "kind string")
    run = lambda rows, tests: research.challenger_evidence(spark.createDataFrame(rows, "query long, score double, actual boolean"), tests, baselines, eligible, ["query"]).first()
    good = run([(k, 0.9 if k % 2 == 0 else 0.2, k % 2 == 0) for k in range(60)], 80)
    assert (good.state, good.reasons, good.comparator, good.n, good.positives, good.suppressed) == ("ELIGIBLE_CHALLENGER", [], "B0", 60, 30, 0.25)
    bad = run([(k, 0.2 if k % 2 == 0 else 0.9, k % 2 == 0) for k in range(60)], 60)
    assert (bad.state, bad.reasons) == ("NO_SKILL", ["BRIER_WORSE", "LOG_LOSS_WORSE"])
    thin = run([(k, 0.9, True) for k in range(0, 20, 2)], 80)
    assert thin.state == "INSUFFICIENT_EVIDENCE" and thin.reasons == ["TOO_FEW", "FEW_NEGATIVES", "SUPPRESSED"]
    none = run([], 9)
    assert (none.state, none.reasons, none.n, none.suppressed, none.comparator) == ("INSUFFICIENT_EVIDENCE", ["NO_ANSWERS"], 0, 1.0, None)
