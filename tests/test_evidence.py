"""Row contracts, aligned windows, shadow vectors, promotion and resolution."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import contracts, evidence, pit

T0 = dt.datetime(2026, 1, 2, 12)
T1 = T0 + dt.timedelta(hours=1)


def broken(df, rules):
    return {r.k: r.broken for r in pit.violations(df, **rules).collect()}


def test_trades_and_funding(spark):
    rows = [(0, 1.0, 1.0, T0, T0, T1), (1, 0.0, float("nan"), T0, None, None), (2, 1.0, 1.0, T1, T0, T1), (3, 1.0, 1.0, T0, T0, None)]
    df = spark.createDataFrame(rows, "k int, price double, quantity double, observed_at timestamp_ntz, available_at timestamp_ntz, fetched_at timestamp_ntz")
    assert broken(df, contracts.trades()) == {1: ["price", "quantity"], 2: ["clock_order"], 3: ["clocks_together"]}
    more = df.withColumns({"mark_price": F.col("price"), "index_price": F.lit(1.0), "funding_rate": F.col("quantity"), "funding_at": F.col("fetched_at"), "payload_sha256": F.when(F.col("k") == 0, "xyz"), "open_interest": F.col("price") - 1})
    assert broken(more, contracts.funding()) == {0: ["digest"], 1: ["mark", "funding", "next"], 2: ["clock_order"], 3: ["next", "clocks_together"]}
    assert 1 in broken(more, contracts.open_interest()) and broken(more, contracts.horizon("payload_sha256"))[0] == ["horizon"]


def test_snapshots_predictions_and_metrics(spark):
    df = spark.createDataFrame([(0, 60.0, 40.01, False, [], "BULLISH"), (1, 60.0, 41.0, True, [], "NEUTRAL")], "k int, bull_score double, bear_score double, blocked boolean, reasons array<string>, label string")
    assert broken(df, contracts.snapshots()) == {1: ["scores", "reasons", "degraded"]}
    rows = [(0, T0, T0, T1, "OPEN", None), (1, T1, T0, T0, "HIT", T0), (2, T0, T0, T1, "MISS", T0), (3, T0, T0, T1, "OPEN", T1)]
    df = spark.createDataFrame(rows, "k int, published_at timestamp_ntz, frozen_at timestamp_ntz, horizon_end timestamp_ntz, resolution string, resolved_at timestamp_ntz")
    assert broken(df, contracts.frozen_predictions()) == {1: ["published", "ex_ante"], 2: ["too_early"], 3: ["resolved_together"]}
    metrics = spark.range(1).select(F.lit(0).alias("k"), *(F.lit(-1.0).alias(n) for n in (*contracts.SIGNED, *contracts.NOT_NEGATIVE[:2])), *(F.lit(None).cast("double").alias(n) for n in contracts.NOT_NEGATIVE[2:]))
    assert broken(metrics, contracts.derivatives()) == {0: list(contracts.NOT_NEGATIVE[:2])}
    assert broken(df, contracts.point_in_time("published_at", "frozen_at")) == {1: ["available"]}


def test_fold_problems(spark):
    make = lambda rows: sorted(tuple(r) for r in contracts.fold_problems(spark.createDataFrame(rows, "fold_index int, n_test int, n_train int, horizon string")).collect())
    assert make([(0, 5, 5, "1d"), (1, 5, 5, "1d")]) == [] and make([(1, 5, 0, "1d"), (3, 5, 5, "1w"), (3, 5, 5, "1w")]) == [(1, "EMPTY"), (1, "MIXED_HORIZONS"), (1, "NOT_CONTIGUOUS"), (3, "MIXED_HORIZONS"), (3, "NOT_CONTIGUOUS"), (3, "REPEATED")]


def test_windows_need_alignment_and_vectors_an_independent_price(spark):
    at = [T0 + dt.timedelta(minutes=k) for k in range(5)]
    alignment = spark.createDataFrame([(at[0], True, ["A"]), (at[1], False, ["DEPTH_MISSING"]), (at[2], True, []), (at[3], True, []), (at[4], True, [])], "at timestamp_ntz, eligible boolean, flags array<string>")
    windows = spark.createDataFrame([(at[0], "x", 1.5, True, ["FUNDING_NO_DATA"]), (at[1], "x", 1.0, True, []), (at[2], "x", 1.0, True, ["SPARSE_WINDOW"]), (at[3], "x", 2.5, True, [])], "at timestamp_ntz, symbol string, cvd double, regime_eligible boolean, flags array<string>")
    out = evidence.aligned_windows(alignment, windows)
    got = {r["at"]: (r.evidence_eligible, r.window.cvd if r.window else None, r.flags) for r in out.collect()}
    assert got == {at[0]: (True, 1.5, ["A", "FUNDING_NO_DATA"]), at[1]: (False, None, ["DEPTH_MISSING"]), at[2]: (False, None, ["SPARSE_WINDOW", "TEMPORAL_WINDOW_INELIGIBLE"]), at[3]: (True, 2.5, []), at[4]: (False, None, ["TEMPORAL_WINDOW_NO_DATA"])}
    anchor = lambda t, fetched, providers, valid=True: (t, "x", fetched, 1.0, valid, len(providers), providers, 0.9, 0.8, ["OUTLIER"])
    schema = "at timestamp_ntz, symbol string, fetched_at timestamp_ntz, value double, valid boolean, provider_count int, providers array<string>, agreement double, freshness double, anchor_flags array<string>"
    vectors = evidence.shadow_vectors(out, spark.createDataFrame([anchor(at[0], at[0], ["own_spot", "other"]), anchor(at[3], at[4], ["a", "b"])], schema), "OWN")
    (row,) = vectors.collect()
    assert row["at"] == at[0] and row.cvd == 1.5 and row.independent_external_provider_count == 1 and row.quality_flags == ["A", "FUNDING_NO_DATA", "UNCALIBRATED_SHADOW_ONLY", "INDEPENDENT_PRICE_CONSENSUS", "CONSENSUS_OUTLIER"]
    for providers, valid in ((["own_spot", "own_perp"], True), (["a"], True), (["a", "b"], False)):
        assert evidence.shadow_vectors(out, spark.createDataFrame([anchor(at[0], at[0], providers, valid)], schema), "own").count() == 0
    sources = lambda ids: spark.createDataFrame([(at[0], "x", i) for i in ids], "at timestamp_ntz, symbol string, source_id string")
    ids = [evidence.lineage(vectors, sources(s)).first().lineage_id for s in (["p", "q"], ["q", "p", "p"], ["p", "r"])]
    assert ids[0] == ids[1] != ids[2] and evidence.lineage(vectors, sources(["p"]).where("source_id = 'none'")).count() == 0


def test_promotion_and_resolution(spark):
    claims = spark.createDataFrame([(c, "OPINION") for c in "abcd"], "claim string, status string")
    wanted = spark.createDataFrame([("a", "FACT", ["T1_PRIMARY_DOCUMENT"]), ("b", "FACT", ["T3"]), ("c", "FACT", ["T0_PRIMARY_MACHINE"]), ("d", "RUMOR", [])], "claim string, target string, tiers array<string>")
    now, refused = evidence.promoted(claims, wanted, spark.createDataFrame([("c", "a2")], "a string, b string"))
    assert {r.claim: r.status for r in now.collect()} == {"a": "FACT", "b": "OPINION", "c": "OPINION", "d": "RUMOR"} and {r.claim: r.reason for r in refused.collect()} == {"b": "NO_PRIMARY_EVIDENCE", "c": "CONTRADICTED"}
    predictions = spark.createDataFrame([(k, T1) for k in "wxyz"], "prediction_id string, horizon_end timestamp_ntz")
    outcomes = spark.createDataFrame([("w", "HIT", T1), ("x", "HIT", T0), ("y", "VOID", T0), ("z", "OPEN", T1)], "prediction_id string, outcome string, at timestamp_ntz")
    done, refused = evidence.resolvable(predictions, outcomes)
    assert {r.prediction_id: (r.resolution, r.resolved_at) for r in done.collect()} == {"w": ("HIT", T1), "x": ("OPEN", None), "y": ("VOID", T0), "z": ("OPEN", None)} and {r.prediction_id: r.reason for r in refused.collect()} == {"x": "TOO_EARLY", "z": "STAYS_OPEN"}
