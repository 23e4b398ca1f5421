"""Walk-forward backtests against a plain loop over prefixes of the frame, and odd frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import backtest, regime, timeseries

D0 = dt.datetime(2024, 1, 1)
GIVEN = {"funding_z": 0.4, "provider_agreement": 1.0, "freshness_score": 1.0, "source_coverage": 1.0}


def frame(spark, n, seed=3):
    rnd, rows, at = random.Random(seed), [], [100.0] * len(timeseries.REQUIRED)
    for i in range(n):
        at = [x * (1 + rnd.uniform(-0.05, 0.052)) for x in at]
        d = D0 + dt.timedelta(days=i)
        rows.append((d, d + dt.timedelta(hours=rnd.choice((1, 20, 30, 80))), *(x if rnd.random() > 0.03 else None for x in at)))
    return spark.createDataFrame(rows, "d timestamp, known timestamp, " + ", ".join(f"{c} double" for c in timeseries.REQUIRED)), rows


def plain(spark, rows, schema, least, step, forward, embargo, window, available):
    """Each decision's history as a frame of its own, scored by its last row."""
    out = []
    for end in range(least, len(rows) - forward - embargo, step):
        at = rows[end - 1][0]
        history = [r for r in rows[max(0, end - window) if window else 0 : end] if not available or r[1] <= at]
        if len(history) < least:
            continue
        features = timeseries.feature_rows(spark.createDataFrame(history, schema), "d", {k: F.lit(v) for k, v in GIVEN.items()}).orderBy(F.desc("d")).limit(1)
        scored = regime.component_scores(features)
        row = regime.blended(scored, regime.WEIGHTS["1d"], regime.data_quality(scored)[2]).first()
        now, then = rows[end - 1][2], rows[end + embargo + forward - 1][2]
        out.append((end, len(history), bool(now is not None and then is not None and then > now), round(row.bull_score / 100, 3), round(row.confidence, 3)))
    return out


@pytest.mark.parametrize(("window", "available", "embargo"), [(None, None, 0), (None, "known", 1), (45, None, 2), (45, "known", 0)])
def test_walk_forward_equals_a_loop(spark, window, available, embargo):
    df, rows = frame(spark, 75)
    out = backtest.walk_forward(df, "d", least=40, step=13, embargo=embargo, available=available, window=window, supplemental={k: F.lit(v) for k, v in GIVEN.items()})
    got = [(r.end, r.n, r.outcome, r.raw_score, r.confidence) for r in out.orderBy("end").collect()]
    want = plain(spark, rows, df.schema, 40, 13, 7, embargo, window, available)
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) >= 2
    for g, w in zip(got, want):
        assert g[3:] == pytest.approx(w[3:], abs=1.1e-3)


def test_the_future_changes_no_score(spark):
    df, _ = frame(spark, 75)
    last = D0 + dt.timedelta(days=57)
    cut = df.select("d", "known", *(F.when(F.col("d") <= F.lit(last), F.col(c)).otherwise(F.col(c) * 3).alias(c) for c in timeseries.REQUIRED))
    scores = lambda x: {r.end: r.raw_score for r in backtest.walk_forward(x, "d", least=40, step=9).where("end <= 58").collect()}
    assert scores(df) == scores(cut) and len(scores(df)) == 3


def test_short_and_wrong_frames(spark):
    df, _ = frame(spark, 47)
    assert backtest.walk_forward(df, "d", least=40).count() == 0  # the last row is no outcome's
    one = backtest.summary(backtest.walk_forward(df.limit(0), "d", least=40)).first()
    assert one.decisions == 0 and one.accuracy is None
    df, rows = frame(spark, 60)
    early = df.withColumn("known", F.when(F.col("d") == F.lit(rows[5][0]), F.lit(D0)).otherwise(F.col("known")))
    bad = early.union(early.limit(1)).union(spark.createDataFrame([(None, None, *rows[0][2:])], df.schema))
    problems = sorted((r.d or D0 - dt.timedelta(days=1), r.problem) for r in backtest.availability_problems(bad, "d", "known").collect())
    assert problems == [(D0 - dt.timedelta(days=1), "NO_AVAILABILITY"), (D0 - dt.timedelta(days=1), "NO_TIME"), (D0, "REPEATED_TIME"), (rows[5][0], "EARLY")]
    with pytest.raises(Exception, match="clocks"):
        backtest.walk_forward(early, "d", least=40, available="known").collect()
    for wrong in ({"least": 29}, {"step": 0}, {"embargo": -1}, {"least": 40, "window": 39}):
        with pytest.raises(ValueError, match="must"):
            backtest.walk_forward(df, "d", **wrong)
