"""Baselines, calibration and features against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import research, timeseries


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35, min(35, x))))


def labelled(n=120):
    rng = random.Random(3)
    return [(k, k + 2 + k % 3, rng.random() < 0.5 + 0.2 * math.sin(k / 5), rng.gauss(0, 1), rng.gauss(1, 2)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "n long, resolved long, actual boolean, s double, t double")


def test_out_of_sample_baselines(spark):
    rows = labelled()
    got = {(r.fold_index, r.n, r.kind): r.score for r in research.oos_predictions(frame(spark, [*rows, (500, 501, True, None, 0.0)]), "n", "resolved", "actual", "s", 30, 10, 4).collect()}
    want = {}
    for fold, start in enumerate(range(30, 120, 10)):
        train = [r for r in rows if r[1] < start - 4]
        ys, xs = [r[2] for r in train], [r[3] for r in train]
        base = (sum(ys) + 1) / (len(ys) + 2)
        after = {p: [b for a, b in zip(ys, ys[1:]) if a == p] for p in (True, False)}
        stay = (sum(after[ys[-1]]) + 1) / (len(after[ys[-1]]) + 2)
        mean, sd = np.mean(xs), np.std(xs)
        for r in rows[start : start + 10]:
            z, logit = (r[3] - mean) / sd, math.log(base / (1 - base))
            want |= {(fold, r[0], "B0"): base, (fold, r[0], "B1"): stay, (fold, r[0], "B2"): sigmoid(logit + z), (fold, r[0], "B3"): sigmoid(logit - z)}
    assert got.keys() == want.keys() and all(v == pytest.approx(want[k]) for k, v in got.items())


def test_logistic_baseline(spark):
    rows = labelled(60)
    df = frame(spark, rows).withColumn("fold", F.lit(1))
    fits = research.fit_logistic(df, ["fold"], ["s", "t"], ["n"])
    x, y = np.array([r[3:] for r in rows]), np.array([float(r[2]) for r in rows])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z, w = (x - mean) / sd, np.zeros(2)
    b = math.log((y.sum() + 1) / (len(y) + 2) / (1 - (y.sum() + 1) / (len(y) + 2)))
    for _ in range(500):
        gw, gb = np.zeros(2), 0.0
        for row, actual in zip(z, y):
            e = sigmoid(b + float(w @ row)) - actual
            gb += e
            gw += e * row
        b -= 0.1 * gb / len(y)
        w -= 0.1 * (gw / len(y) + w / len(y))
    fit = fits.first()
    assert fit.intercept == pytest.approx(b) and fit.weights == pytest.approx(w.tolist()) and fit.means == pytest.approx(mean.tolist())
    got = {r.n: r.score for r in research.predict_logistic(df, fits, ["fold"], ["s", "t"]).collect()}
    assert all(got[r[0]] == pytest.approx(sigmoid(b + float(w @ z[k]))) for k, r in enumerate(rows))


def test_platt(spark):
    rng = random.Random(7)
    rows = [("a", s := rng.random(), rng.random() < s**2) for _ in range(200)] + [("few", 0.5, True)] * 10
    df = spark.createDataFrame(rows, "k string, score double, actual boolean")
    fits = research.platt(df, ["k"])
    x = np.array([math.log(min(max(s, 1e-6), 1 - 1e-6) / (1 - min(max(s, 1e-6), 1 - 1e-6))) for k, s, _ in rows if k == "a"])
    y = np.array([float(v) for k, _, v in rows if k == "a"])
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]])
        step = np.linalg.solve(h, [(y - p).sum(), ((y - p) * x).sum()])
        a, b = a + step[0], b + step[1]
    (fit,) = fits.collect()
    assert fit.k == "a" and fit.a == pytest.approx(a, abs=1e-6) and fit.b == pytest.approx(b, abs=1e-6)
    out = research.apply_platt(df, fits, ["k"]).collect()
    assert all((r.calibrated is None) == (r.k == "few") for r in out)
    (row,) = research.platt_evaluation(df, fits, ["k"]).collect()
    assert row.k == "a" and row.n == 200 and row.log_loss_after < row.log_loss and row.improved == (row.brier_after <= row.brier)


def test_features_of_a_frame(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2024-01-01", periods=130, freq="D")
    pdf = pd.DataFrame({c: 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 130))) for c in timeseries.REQUIRED}, index=days)
    pdf.loc[days[50:53], "vix"] = np.nan
    pdf.loc[days[128:], "btc_usd"] = np.inf
    plain = pdf.replace(np.inf, np.nan).astype(object).where(lambda x: x.notna(), None)
    df = spark.createDataFrame([(d.to_pydatetime(), *map(lambda v: None if v is None else float(v), r)) for d, r in zip(days, plain.to_numpy().tolist())], "d timestamp_ntz, " + ", ".join(f"{c} double" for c in timeseries.REQUIRED))
    row = timeseries.feature_rows(df, "d", {"funding_z": F.lit(0.5)}).orderBy(F.desc("d")).first()
    vix, btc, asset, ndx = (pdf[c].replace(np.inf, np.nan).dropna() for c in ("vix", "btc_usd", "asset_usd", "ndx"))
    assert row.vix_z_20d == pytest.approx((vix.iloc[-1] - vix[-20:].mean()) / vix[-20:].std(ddof=0)) and row.btc_return_30d == pytest.approx(btc.iloc[-1] / btc.iloc[-31] - 1)
    both = pd.concat([asset, btc], axis=1).dropna().pct_change().dropna()[-90:]
    assert row.asset_beta_btc_90d == pytest.approx(both.iloc[:, 0].cov(both.iloc[:, 1]) / both.iloc[:, 1].var()) and row.asset_btc_corr_90d == pytest.approx(both.iloc[:, 0].corr(both.iloc[:, 1]))
    r = asset.pct_change().dropna()[-30:]
    assert row.asset_vol_30d == pytest.approx(r.std(ddof=0) * math.sqrt(365.25)) and row.asset_ma100_distance == pytest.approx(asset.iloc[-1] / asset[-100:].mean() - 1)
    assert row.asset_drawdown_365d is None and row.funding_z == 0.5 and row.ledger_activity_z is None
    assert timeseries.frame_problems(df, "d").count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        timeseries.feature_rows(df.drop("vix"), "d")
    with pytest.raises(ValueError, match="unknown supplemental"):
        timeseries.feature_rows(df, "d", {"x": F.lit(1.0)})


def test_frame_problems(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    found = lambda times: {r.problem: r.n for r in timeseries.frame_problems(spark.createDataFrame([(t,) for t in times], "d timestamp_ntz"), "d").collect()}
    assert found([at(0), at(24), at(48), None, at(48)]) == {"NO_TIME": 1, "REPEATED_TIME": 1} and found([at(0), at(1), at(2)]) == {"CADENCE": 1} and found([at(0)]) == {"TOO_SHORT": 2}
