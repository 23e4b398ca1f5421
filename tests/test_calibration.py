"""Calibrator candidates against plain Newton steps; purges, guards, refusals, empty tables."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import calibration

T0 = dt.datetime(2026, 1, 1)
RECORDS = "horizon string, event string, prediction_id string, prediction_time timestamp, resolved_at timestamp, score double, actual boolean"
KEYS = ["horizon", "event"]


def records(rng, n=160, event="up"):
    out = []
    for k in range(n):
        at = T0 + dt.timedelta(days=k)
        score = rng.choice((rng.uniform(0.05, 0.95), rng.uniform(0.05, 0.95), 0.3))
        out.append(("1d", event, f"{event}{k}", at, at + dt.timedelta(days=rng.randrange(1, 30)), score, rng.random() < 0.2 + 0.5 * score))
    return out


def plain(rows):
    x = np.array([math.log(min(max(s, 1e-12), 1 - 1e-12) / (1 - min(max(s, 1e-12), 1 - 1e-12))) for *_, s, _ in rows])
    y = np.array([float(r[-1]) for r in rows])
    a, b = 0.0, 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -35, 35)))
        w, e = p * (1 - p), y - p
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]])
        da, db = np.linalg.solve(h, [e.sum(), (e * x).sum()])
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return a, b


def test_fits_on_what_was_resolved_before_the_cutoff(spark):
    rng = random.Random(1)
    rows, cutoff = records(rng) + records(rng, 150, "down"), T0 + dt.timedelta(days=120)
    rows += [("1d", "up", "n1", None, T0, 0.5, True), ("1d", "up", "n2", T0, T0, None, True), ("1d", "up", "n3", T0, T0, 0.5, None)]
    df = spark.createDataFrame(rows, RECORDS)
    made, refused = calibration.platt_candidates(df, KEYS, F.lit(cutoff))
    assert refused.count() == 0
    got = {r.event: r for r in made.collect()}
    for event in ("up", "down"):
        own = [r for r in rows if r[1] == event]
        used = [r for r in own if r[3] and r[3] < cutoff and r[4] < cutoff and None not in r]
        a, b = plain(used)
        r = got[event]
        assert (r.n, r.purged, r.positives) == (len(used), len(own) - len(used), sum(u[-1] for u in used))
        assert (r.a, r.b) == (pytest.approx(a, abs=1e-8), pytest.approx(b, abs=1e-8))
    again, _ = calibration.platt_candidates(df.repartition(3), KEYS, F.lit(cutoff))
    assert {r.event: r.predictions for r in again.collect()} == {e: r.predictions for e, r in got.items()}
    later = [("1d", "up", "a", cutoff, 0.3), ("1d", "up", "b", cutoff - dt.timedelta(seconds=1), 0.3), ("1w", "up", "c", cutoff, 0.3), ("1d", "up", "d", cutoff, 1.5), ("1d", "up", "e", cutoff, None), ("1d", "up", "f", None, 0.3), ("1d", "down", "g", cutoff, 1.0)]
    ok, no = calibration.apply_candidates(spark.createDataFrame(later, "horizon string, event string, prediction_id string, prediction_time timestamp, score double"), made, KEYS)
    assert sorted(tuple(r) for r in no.collect()) == [("b", "BEFORE_CUTOFF"), ("c", "NO_CALIBRATOR"), ("d", "SCORE"), ("e", "SCORE"), ("f", "BEFORE_CUTOFF")]
    values = {r.prediction_id: r for r in ok.collect()}
    assert set(values) == {"a", "g"} and values["a"].calibrated == pytest.approx(1 / (1 + math.exp(-(got["up"].a + got["up"].b * math.log(0.3 / 0.7)))))
    assert values["g"].candidate_id.startswith("calibrated-score-candidate:sha256:") and values["g"].calibrator_id == got["down"].calibrator_id


def test_refusals_and_empty_tables(spark):
    at = T0
    of = lambda event, n, score, hit: [("1d", event, f"{event}{k}", at, at, score(k), hit(k)) for k in range(n)]
    rows = of("few", 19, lambda k: k / 20, lambda k: k % 2 == 0) + of("sided", 40, lambda k: k / 40, lambda k: k < 4) + of("same", 40, lambda k: 0.25, lambda k: k % 2 == 0)
    cutoff = F.lit(T0 + dt.timedelta(days=1))
    made, refused = calibration.platt_candidates(spark.createDataFrame(rows, RECORDS), KEYS, cutoff)
    assert made.count() == 0 and {r.event: r.reason for r in refused.collect()} == {"few": "TOO_FEW", "sided": "ONE_SIDED", "same": "SINGULAR"}
    made, refused = calibration.platt_candidates(spark.createDataFrame([], RECORDS), KEYS, cutoff)
    assert made.count() == 0 and refused.count() == 0
    for wrong in ({"least_n": 1}, {"least_class": 0}, {"eps": 0.5}):
        with pytest.raises(ValueError, match="least_n"):
            calibration.platt_candidates(spark.createDataFrame([], RECORDS), KEYS, cutoff, **wrong)
