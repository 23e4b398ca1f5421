"""Small fixtures with known answers."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import content_id, horizon_end, is_content_id, jaccard, logit, ratio, scale, sigmoid
from tidewatch.operators import analogs, consensus, microstructure, pit, regime, research, semantic, store, timeseries

T0 = dt.datetime(2026, 1, 2, 12)


def quotes(spark, prices, age=60):
    rows = [("x", f"p{i}", p, T0 - dt.timedelta(seconds=age)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "asset string, provider string, price double, close_time timestamp_ntz")


def close(spark, prices, **options):
    rows = consensus.consensus_close(quotes(spark, prices), now=F.lit(T0).cast("timestamp_ntz"), **options).collect()
    return rows[0] if rows else None


def test_consensus_rejects_an_outlier_and_keeps_the_flag(spark):
    row = close(spark, [1.30, 1.31, 2.50])
    assert row.valid and 1.29 < row.value < 1.32 and row.flags == ["OUTLIER"] and row.providers == 2


def test_consensus_needs_two_providers_and_agreement(spark):
    one = close(spark, [1.3])
    assert not one.valid and one.value is None and "MISSING" in one.flags
    two = close(spark, [1.0, 1.2])
    assert not two.valid and "CONFLICT" in two.flags
    assert close(spark, [None, -1.0]) is None
    assert "STALE" in consensus.consensus_close(quotes(spark, [1.0, 1.0], 10_000), now=F.lit(T0).cast("timestamp_ntz")).first().flags


def series(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "one int, d int, p double")


def w():
    return Window.partitionBy("one").orderBy("d")


@pytest.mark.parametrize(("values", "want"), [([1.0] * 16, 50.0), ([float(i) for i in range(1, 17)], 100.0), ([float(-i) for i in range(16)], 0.0)])
def test_rsi_edges(spark, values, want):
    df = series(spark, values).withColumn("x", F.col("p") - F.lag("p").over(w()))
    out = [r.v for r in df.select("d", timeseries.rsi(F.col("x"), w()).alias("v")).orderBy("d").collect()]
    assert out[:14] == [None] * 14 and out[-1] == want


def test_zscore_of_a_flat_window_is_zero_and_a_short_one_null(spark):
    out = [r.v for r in series(spark, [2.0] * 4).select("d", timeseries.zscore(F.col("p"), w(), 3).alias("v")).orderBy("d").collect()]
    assert out == [None, None, 0.0, 0.0]


def test_scores_without_features_are_blocked_and_fifty(spark):
    df = spark.createDataFrame([(1,)], "d int").withColumn("btc_return_7d", F.lit(None).cast("double"))
    row = regime.blended(regime.component_scores(df), regime.WEIGHTS["1d"]).first()
    assert row.bull_score == 50 and row.label == "DEGRADED" and row.coverage == 0


def test_full_features_give_a_label_and_drivers(spark):
    names = [f for terms in regime.TERMS.values() for f, _, _ in terms] + ["funding_z", "oi_price_divergence", "liquidation_impulse", "ledger_activity_z"]
    df = spark.createDataFrame([(1,)], "d int").withColumns({n: F.lit(0.0) for n in names}).withColumn("btc_return_7d", F.lit(1.0))
    scored = regime.blended(regime.component_scores(df), regime.WEIGHTS["1d"])
    row = scored.select("*", regime.key_drivers(scored, list(regime.WEIGHTS["1d"])).alias("top")).first()
    assert row.label in ("BULLISH", "NEUTRAL") and not row.blocked and row.top[0] == "derivatives"
    assert 0 <= row.confidence <= 1
    assert regime.alerts(scored, "d", F.lit(80.0)).first().rule == "distribution_risk"


SIGNALS = [n for n, _, _ in regime.SIGNALS]


@pytest.mark.parametrize(("signals", "want"), [
    ({"breakout": -0.8}, ("FAILED_BREAKOUT", 1.0)), ({"trend": 0.2, "drawdown_stress": 0.4}, ("RECOVERY", 1.0)), ({"trend": None}, ("NO_DATA", "MISSING_REQUIRED_SIGNALS:trend")),
    ({"trend": 0.3}, ("NO_DATA", "NO_RULE_WITH_SUFFICIENT_SEPARATION")), ({n: None for n in SIGNALS[4:]}, ("NO_DATA", "INSUFFICIENT_SIGNAL_COVERAGE")),
])
def test_classified(spark, signals, want):
    """Signals are 0 where the case doesn't say otherwise."""
    row = regime.classified(spark.range(1).withColumns({n: F.lit(signals.get(n, 0.0)).cast("double") for n in SIGNALS})).first()
    if row.regime == "NO_DATA":
        assert (row.regime, *row.reasons) == want and row.confidence == 0
    else:
        strongest = max(abs(v) for v in signals.values())
        assert (row.regime, row.signal_coverage) == want and row.reasons == [] and row.confidence == pytest.approx(0.5 + 0.5 * strongest)


def test_signals_are_scaled_and_clipped(spark):
    row = regime.signals(spark.range(1).select(F.lit(0.15).alias("trailing_return_30d"), F.lit(9.0).alias("breakout_score"), F.lit(float("nan")).alias("distribution_score"))).first()
    assert row.trend == pytest.approx(0.5) and row.breakout == 1.0 and row.distribution is None and row.leverage is None


def test_eligibility(spark):
    rows = [("EXACT", T0 - dt.timedelta(minutes=1), None, T0, None), ("EXACT", T0 - dt.timedelta(minutes=1), None, T0 + dt.timedelta(minutes=1), None), ("EXACT", T0 - dt.timedelta(minutes=1), None, T0 + dt.timedelta(minutes=1), "b"), ("DATE_ONLY", None, T0.date(), T0, None), ("UNKNOWN", None, None, T0, "b")]
    df = spark.createDataFrame(rows, "k string, a timestamp_ntz, d date, f timestamp_ntz, b string")
    boundary = pit.availability_boundary(F.col("k"), F.col("a"), F.col("d"))
    got = [r.e for r in df.select(pit.eligibility(boundary, F.col("f"), F.col("b"), F.lit(T0).cast("timestamp_ntz")).alias("e")).collect()]
    assert got == ["STRICT_REPLAY", "INELIGIBLE", "RECONSTRUCTED_PIT", "INELIGIBLE", "INELIGIBLE"]


def test_strict_raises_on_violations(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert pit.strict(df, pit.violations(df, order=F.col("a") < F.col("b")), "bad").count() == 1
    with pytest.raises(Exception, match="bad"):
        pit.strict(df, pit.violations(df, order=F.col("a") > F.col("b")), "bad").collect()


def test_ambiguous_tops(spark):
    df = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("s", 2, "z"), ("t", 1, "q")], "s string, r int, h string")
    assert [(r.s, r.n) for r in pit.ambiguous(df, ["s"], ["r"], "h").collect()] == [("s", 2)]


def test_downside_label(spark):
    row = research.outcome_labels(spark.createDataFrame([(0, 100.0), (1, 89.0), (2, 95.0)], "n int, p double"), [], "n", "p", 2).orderBy("n").first()
    assert row.mae == pytest.approx(-0.11) and row.mfe == 0 and row.touch_down_0_1 and row.future_return == pytest.approx(-0.05)
    assert row.max_drawdown == pytest.approx(-0.11)


def test_golden_calibration(spark):
    df = spark.createDataFrame([("e", 0.1, False), ("e", 0.2, False), ("e", 0.8, True), ("e", 0.9, True)], "k string, score double, actual boolean")
    row = research.calibration(df, ["k"]).first()
    assert row.brier < 0.05 and row.brier_reference == 0.25
    assert research.roc_auc(df, ["k"]).first().auc == 1.0
    assert research.roc_auc(df.where("actual"), ["k"]).first().auc is None
    ends = spark.createDataFrame([("e", 0.0, False), ("e", 1.0, True)], "k string, score double, actual boolean")
    bins = research.reliability_bins(ends, ["k"], 4)
    assert sorted(r.bin for r in bins.collect()) == [0, 3] and research.expected_calibration_error(bins, ["k"]).first().ece == 0


def test_purge_is_strict(spark):
    rows = [(i, i + 3) for i in range(10)]
    folds = research.walk_forward_folds(spark.createDataFrame(rows, "n int, resolved int"), "n", "resolved", 4, 2, 0).orderBy("fold_index").collect()
    assert [(f.test_start, f.n_train, f.n_purged) for f in folds] == [(4, 1, 3), (6, 3, 3), (8, 5, 3)]


def samples(spark, rows):
    """rows: (seconds before T0 of the observation, of availability, of the fetch, value)."""
    back = lambda s: T0 - dt.timedelta(seconds=s)
    return spark.createDataFrame([(back(o), back(a), back(f), v) for o, a, f, v in rows], "ts timestamp_ntz, av timestamp_ntz, fe timestamp_ntz, v double")


def window(spark, rows, seconds=60):
    at = spark.createDataFrame([(T0,)], "at timestamp_ntz")
    return microstructure.trailing_windows(samples(spark, rows), at, seconds, "ts", F.col("v"), F.col("av"), F.col("fe")).first()


def test_window_is_open_on_the_left(spark):
    row = window(spark, [(s, s, s, float(s)) for s in (0, 20, 59, 60, 61)])
    assert row.n == 3 and row.last_value == 0.0 and row.first_value == 59.0 and row.flags == [] and row.regime_eligible


def test_window_knows_nothing_that_came_later(spark):
    row = window(spark, [(50, 50, 50, 1.0), (10, 8, 7, 2.0), (5, -1, -1, 3.0), (4, 4, -1, 4.0), (3, -1, 3, 5.0)])
    assert row.n == 2 and row.last_value == 2.0 and row.lag_seconds == 3.0 and row.flags == [] and row.regime_eligible
    late = window(spark, [(50, 50, 50, 1.0), (10, 3, 3, 2.0)])
    assert late.flags == ["INGESTION_LAG"] and not late.regime_eligible
    assert window(spark, [(5, -1, -1, 3.0)]) is None and "STALE_WINDOW" in window(spark, [(50, 50, 50, 1.0), (30, 30, 30, 1.0)]).flags
    with pytest.raises(ValueError, match="window of 61"):
        window(spark, [(5, 5, 5, 1.0)], 61)


def test_consensus_invalid_and_default_now(spark):
    later = T0 - dt.timedelta(seconds=3600)
    row = consensus.consensus_close(quotes(spark, [1.0, 1.0, 1.001]), now=F.lit(later).cast("timestamp_ntz")).first()
    assert row.flags == ["INVALID"] and row.value is None and row.providers == 3 and row.freshness == 1.0
    fresh = spark.createDataFrame([("x", p) for p in (1.0, 1.001)], "asset string, price double").withColumn("close_time", F.current_timestamp() - F.expr("INTERVAL 1 MINUTE"))
    assert consensus.consensus_close(fresh).first().valid
    old = quotes(spark, [1.0, 1.0]).union(quotes(spark, [5.0], 20_000))  # the stale quote is the outlier: what stays is fresh
    assert consensus.consensus_close(old, now=F.lit(T0).cast("timestamp_ntz"), alignment_seconds=1e6).first().flags == ["OUTLIER"]


def test_book(spark):
    level = "array<struct<price:double,quantity:double>>"
    df = spark.createDataFrame([([(99.0, 2.0)], [(101.0, 1.0)])], f"bids {level}, asks {level}")
    row = microstructure.book_metrics(df).first()
    assert row.mid == 100 and row.spread_bps == pytest.approx(200) and "WIDE_SPREAD" in row.flags and row.imbalance_10 == 0 and row.imbalance_100 == pytest.approx((198 - 101) / 299)


def test_analogs_see_only_the_past(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "i long, v array<double>")
    q = v.where("i = 3").select(F.col("i").alias("query"), F.col("v").alias("query_vector"), F.col("i").alias("query_order"))
    assert [r.candidate for r in analogs.nearest(q, v, "v", "i", 2, "euclidean").orderBy("rank").collect()] == [2, 1]
    zero = spark.createDataFrame([([0.0], [0.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    r = zero.select(analogs.distance(F.col("a"), F.col("b"), "cosine").alias("x"), analogs.distance(F.col("a"), F.col("c"), "cosine").alias("y")).first()
    assert (r.x, r.y) == (0.0, 1.0)


def test_analogs_in_blocks_and_normalised(spark, monkeypatch):
    monkeypatch.setattr(analogs, "BLOCK", 3)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(5, 2), rng.gauss(0, 1), 4.0]) for i in range(40)]
    raw = spark.createDataFrame(rows, "i long, v array<double>")
    v = raw.select("i", analogs.normalised(F.col("v"), *analogs.normaliser(raw, "v", 3)).alias("v"))
    z = np.array([r for _, r in rows])
    z = (z - z.mean(axis=0)) / np.where(z.std(axis=0) > 1e-12, z.std(axis=0), 1.0)
    q = v.where("i % 4 = 0").select(F.col("i").alias("query"), F.col("v").alias("query_vector"), F.col("i").alias("query_order"))
    for prior in (True, False):
        got = {(r.query, r["rank"]): (r.candidate, r.distance) for r in analogs.nearest(q, v, "v", "i", 3, "euclidean", min_history=2, prior_only=prior).collect()}
        want = {}
        for a in range(0, 40, 4):
            near = sorted((round(float(np.linalg.norm(z[a] - z[b])), 9), b) for b in range(40) if (b < a if prior else b != a))
            want |= {(a, k + 1): b for k, (_, b) in enumerate(near[:3])} if len(near) >= 2 else {}
        assert {k: b for k, (b, _) in got.items()} == want


def test_as_of_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), None if k % 9 == 0 else T0 + dt.timedelta(hours=rng.randrange(50)), rng.choice([None, 1, 2])) for k in range(80)]
    obs = spark.createDataFrame(rows, "k int, s string, b timestamp_ntz, r int")
    times = [T0 + dt.timedelta(hours=h) for h in (-5, 3, 10, 10, 30, 99)]
    got = sorted((r.at, r.s, r.k) for r in pit.as_of(obs, spark.createDataFrame([(t,) for t in times], "at timestamp_ntz"), ["s"], "b", ["b", "r", "k"]).collect())
    want = []
    for t in sorted(set(times)):
        for s in "ab":
            able = [(b, -1 if r is None else r, k) for k, x, b, r in rows if x == s and b is not None and b <= t]
            want += [(t, s, max(able)[2])] if able else []
    assert got == sorted(want) and pit.as_of(obs, spark.createDataFrame([], "at timestamp_ntz"), ["s"], "b", ["b", "k"]).count() == 0


def test_snapshots_and_manifests_see_one_other_member(spark):
    rows = [(1, "a", i, "p", "STRICT_REPLAY") for i in (1, 2, 3, 9)]
    make = lambda r: pit.snapshots(spark.createDataFrame(r, "at int, s string, i int, p string, k string"), "at", "i", "p", "k", ["s"])
    same, other, text = make(rows[::-1]), make([r if r[2] != 2 else (*r[:2], 4, *r[3:]) for r in rows]), make([(1, "z", *rows[0][2:]), *rows[1:]])
    assert pit.changed_snapshots(make(rows), same).count() == 0 and pit.changed_snapshots(make(rows), other).count() == 1 == pit.changed_snapshots(make(rows), text).count()
    day = spark.createDataFrame([("d", k, T0) for k in (1, 2)], "d string, k int, t timestamp_ntz")
    stated = store.manifest(day, ["d"], F.col("k"), "t")
    assert store.verified(stated, day, ["d"], F.col("k"), "t").count() == 0
    twice = day.union(day.where("k = 1")).union(day.where("k = 1"))
    assert [r.problem for r in store.verified(stated, twice, ["d"], F.col("k"), "t").collect()] == ["CHANGED"]
    more = day.union(spark.createDataFrame([("e", 1, T0)], day.schema))
    assert [tuple(r) for r in store.verified(stated, more, ["d"], F.col("k"), "t").collect()] == [("e", "UNSTATED")]
    assert [tuple(r) for r in store.verified(stated, day.limit(0), ["d"], F.col("k"), "t").collect()] == [("d", "MISSING")]
    assert store.partitions_of(stated, ["d"], F.lit(T0), F.lit(T0)).count() == 1 and store.partitions_of(stated, ["d"], F.lit(T0 + dt.timedelta(1)), F.lit(T0 + dt.timedelta(2))).count() == 0


def test_backfill_pages(spark):
    rows = [("ok", 0, None, "b", 5), ("ok", 1, "b", None, 2), ("loop", 0, None, "b", 1), ("loop", 1, "b", "c", 1), ("loop", 2, "c", "b", 1), ("loop", 3, "b", "c", 1), ("gap", 0, None, "b", 1), ("gap", 2, "c", None, 1), ("end", 0, None, None, 1), ("end", 1, "x", None, -1), ("two", 0, None, "b", 1), ("two", 0, None, "b", 1)]
    pages = spark.createDataFrame(rows, "source string, page long, cursor string, following string, rows long")
    bad = store.page_problems(pages, "source", "page", "cursor", "following", "rows")
    assert sorted(tuple(r) for r in bad.collect()) == [("end", 1, "AFTER_END"), ("end", 1, "NEGATIVE"), ("gap", 2, "CURSOR"), ("gap", 2, "GAP"), ("loop", 3, "LOOP"), ("two", 0, "REPEATED")]
    at = {r.source: (r.pages, r.rows, r.next_cursor, r.done) for r in store.checkpoints(pages, bad, "source", "page", "following", "rows").collect()}
    assert at == {"ok": (2, 7, None, True), "loop": (3, 3, "b", False), "gap": (1, 1, "b", False), "end": (1, 1, None, True)}


def test_level_changes(spark):
    level = "array<struct<price:double,quantity:double>>"
    df = spark.createDataFrame([("x", 1, [(10.0, 2.0), (9.0, 1.0)], [(11.0, 1.0)]), ("x", 2, [(10.0, 3.0)], [(11.0, 1.0), (12.0, 2.0)]), ("y", 1, [], [])], f"s string, n int, bids {level}, asks {level}")
    (row,) = microstructure.level_changes(df, ["s"], "n").collect()
    assert (row.bid_added, row.bid_removed, row.ask_added, row.ask_removed) == (10.0, 9.0, 24.0, 0.0)


def test_disputed_facts(spark):
    claims = spark.createDataFrame([("a", "FACT"), ("b", "FACT"), ("c", "OPINION")], "claim string, status string")
    links = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "zz")], "x string, y string")
    pairs = semantic.contradictions(links, claims, "x", "y", "claim")
    got = {r.claim: r.status for r in semantic.disputed(claims, pairs, "claim", "status").collect()}
    assert got == {"a": "DISPUTED", "b": "DISPUTED", "c": "OPINION"} and pairs.count() == 4


def test_insert_once_and_blobs(spark, tmp_path):
    old = spark.createDataFrame([("a", "1")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "3")], "k string, h string")
    fresh, clash = store.insert_once(old, new, "k", "h")
    assert [tuple(r) for r in fresh.collect()] == [("b", "3")] and [r.k for r in clash.collect()] == ["a"]
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),)], "content binary")
    store.put_blobs(blobs, str(tmp_path / "b"))
    digest = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    assert store.read_blob(spark, str(tmp_path / "b"), digest).count() == 1


def test_insert_once_by_pieces(spark):
    """A task holds a piece of both sides, as many as partitions of what is read ask for; rows are the same, nulls too."""
    old = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300) if i % 3] + [(None, "a"), (4, None)], "k bigint, h string").repartition(2)
    new = spark.createDataFrame([(i, "abc"[(i + j) % 3]) for i in range(300) for j in range(2)] * 2 + [(None, "a"), (None, "a"), (5, None)], "k bigint, h string").repartition(3)
    parts = store.pieces(old, new)
    assert parts == store.PIECES * 5
    found = store.insert_once(old, new, "k", "h", parts)
    for mine, plain in zip(found, store.insert_once(old, new, "k", "h")):
        want = sorted(map(tuple, plain.collect()), key=str)
        assert sorted(map(tuple, mine.collect()), key=str) == want and len(want) > 99
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and f", {parts})" in plan
    assert found[0].where("k is null").count() == 1


def test_scalars(spark):
    row = spark.range(1).select(
        ratio(F.lit(1.0), F.lit(0.0)).alias("r"), scale(F.lit(9.0), 1.0).alias("s"), scale(F.lit(None).cast("double"), 1.0).alias("n"), sigmoid(logit(F.lit(0.3))).alias("p"),
        jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"), is_content_id(content_id("k", F.lit("a")), "k").alias("c"), horizon_end(F.lit(dt.datetime(2026, 1, 31)).cast("timestamp_ntz"), "1mo").alias("h"),
        semantic.redacted(F.lit("token=abc Bearer x.y")).alias("red"), semantic.sanitized_uri(F.lit("https://u@h/")).alias("u"), semantic.sanitized_uri(F.lit("https://h/a#b")).alias("v"),
    ).first()
    assert row.r is None and row.s == 100 and row.n is None and row.p == pytest.approx(0.3) and row.j == 0.5 and row.c
    assert row.h == dt.datetime(2026, 2, 28) and row.red == "token=[REDACTED] Bearer [REDACTED]" and row.u is None and row.v == "https://h/a"


@pytest.mark.parametrize(("text", "want"), [
    ("Bearer abc+def/ghi==", "Bearer [REDACTED]"), ("Authorization: Basic dXNlcjpw, next", "Authorization: Basic [REDACTED], next"), ("Authorization: Bearer a.b-c~d\nline", "Authorization: Bearer [REDACTED]\nline"),
    ("https://h/?api_key=x&y=1#z", "https://h/?api_key=[REDACTED]&y=1#z"), ("https://u:p@h/a", "https://[REDACTED]@h/a"), ('{"password": "p w", "a": 1}', '{"password": "[REDACTED] w", "a": 1}'),
    ("refresh_token = q, SECRET:z", "refresh_token = [REDACTED], SECRET:[REDACTED]"), ("the bearer of news, tokens and keys", "the bearer [REDACTED] news, tokens and keys"), ("", ""),
])
def test_redaction(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(semantic.redacted(F.col("t")).alias("r")).first().r == want


def test_pair_mismatches(spark):
    made = spark.createDataFrame([("a", "up", 1), ("b", "up", None), ("c", "up", 2), ("lone", "up", 1)], "k string, event string, horizon int")
    came = spark.createDataFrame([("a", "up", 1, 5, 5), ("b", "down", None, 4, 5), ("b", "down", None, 4, 5), ("c", "up", None, 9, None), ("stray", "up", 1, 9, 5)], "k string, event string, horizon int, done int, ends int")
    out = store.pair_mismatches(made, came, "k", ["event", "horizon"], "done", "ends")
    assert sorted(map(tuple, out.collect())) == [("b", "EARLY"), ("b", "MISMATCH:event"), ("c", "EARLY"), ("c", "MISMATCH:horizon")]
    assert store.pair_mismatches(made.limit(0), came, "k", ["event"], "done", "ends").count() == 0
