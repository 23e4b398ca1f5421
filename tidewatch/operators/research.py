"""Leakage-safe research: outcome labels, walk-forward folds, baselines, calibration evidence, skill gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import clip, content_id, logit, ratio, sigmoid
from tidewatch.operators.pit import digest
from tidewatch.scratch import kept

#: Price barriers and return thresholds.
PRICE_BARRIERS = (2, 3, 3.65, 5, 7.34, 10, 17, 26.6, 50)
RETURN_BARRIERS = (0.01, 0.02, 0.05, 0.10)


def outcome_labels(series: DataFrame, key: Sequence[str], step: str, price: str, horizon: int, returns: Sequence[float] = RETURN_BARRIERS, prices: Sequence[float] = ()) -> DataFrame:
    """Adds to each row the outcome over the next `horizon` steps (`step` is a whole number, such as a day).

    future_return, mfe >= 0 >= mae (the start counts), path_volatility (root of summed squared log returns),
    max_drawdown, n_path, resolved_step, touch_up_<k>/touch_down_<k>, and for `prices` touch_price_<k>: whether the path
    reaches a level from the side that it starts on. Each row meets `horizon` rows at most, found by
    windows over the series; rows without a full path have resolved null."""
    w = Window.partitionBy(*key).orderBy(step) if key else Window.partitionBy(F.lit(0)).orderBy(step)
    ahead = w.rangeBetween(0, horizon)
    after = w.rangeBetween(1, horizon)
    p = F.col(price)
    df = series.withColumn("_log", F.ln(p / F.lag(p).over(w)))
    df = df.withColumn("_path", F.collect_list(p).over(ahead))  # horizon + 1 prices at most
    falls = F.aggregate("_path", F.struct(F.lit(0.0).alias("worst"), F.element_at("_path", 1).alias("peak")), lambda a, x: F.struct(F.least(a["worst"], x / F.greatest(a["peak"], x) - 1).alias("worst"), F.greatest(a["peak"], x).alias("peak")), lambda a: a["worst"])
    df = df.withColumns({
        "n_path": F.count(p).over(after),
        "resolved_step": F.max(step).over(after),
        "future_return": F.element_at("_path", -1) / p - 1,
        "mfe": F.max(p).over(ahead) / p - 1,
        "mae": F.min(p).over(ahead) / p - 1,
        "path_volatility": F.sqrt(F.sum(F.col("_log") * F.col("_log")).over(after)),
        "max_drawdown": falls,
    })
    level = lambda k: F.when(p < k, F.max(p).over(ahead) >= k).when(p > k, F.min(p).over(ahead) <= k).otherwise(True)
    df = df.withColumns({f"touch_price_{number_name(k).replace('.', '_')}": level(k) for k in prices})
    touch = {f"touch_{d}_{str(k).replace('.', '_')}": (F.col("mfe") >= k) if d == "up" else (F.col("mae") <= -k) for k in returns for d in ("up", "down")}
    return df.withColumns(touch).drop("_log", "_path")


def number_name(k: float) -> str:
    """A number as short text: 2 for 2.0, 3.65 as it is."""
    return str(int(k)) if float(k).is_integer() else repr(float(k))


def event_keys(returns: Sequence[float] = RETURN_BARRIERS, prices: Sequence[float] = PRICE_BARRIERS) -> list[str]:
    """Names of the binary events that a label answers, in order."""
    out = ["return_gt_0"]
    for k in returns:
        out += [f"touch_return_up:{number_name(k)}", f"touch_return_down:{number_name(k)}"]
    return out + [f"touch_price:{number_name(k)}" for k in prices]


def event_outcomes(labels: DataFrame, key: Sequence[str], returns: Sequence[float] = RETURN_BARRIERS, prices: Sequence[float] = PRICE_BARRIERS) -> DataFrame:
    """key, event, actual: one row for each label and event of `event_keys`. Labels are those of `outcome_labels` with the
    same barriers; a label without a path answers nothing."""
    name = lambda k: str(k).replace(".", "_")
    answers = [F.col("future_return") > 0]
    for k in returns:
        answers += [F.col(f"touch_up_{name(k)}"), F.col(f"touch_down_{name(k)}")]
    answers += [F.col(f"touch_price_{number_name(k).replace('.', '_')}") for k in prices]
    rows = F.array(*(F.struct(F.lit(e).alias("event"), a.alias("actual")) for e, a in zip(event_keys(returns, prices), answers)))
    return labels.where("n_path > 0").select(*key, F.inline(rows))


def walk_forward_folds(labelled: DataFrame, time: str, resolved: str, min_train: int, test_size: int, embargo: int, max_train: int | None = None) -> DataFrame:
    """One row per emitted fold: fold_index, test_start, test_end, n_test, n_train, n_purged.

    Rows are numbered by time (unique); test blocks of test_size follow the first min_train rows. Training rows come
    before the block (nothing resolves before its own time) and are resolved strictly before its start less the embargo; the rest are purged, counted before
    a rolling window cuts the training set to its latest max_train rows. Blocks without a training row are not emitted
    and take no number."""
    w = Window.partitionBy(F.lit(0)).orderBy(time)
    rows = labelled.select(time, resolved).withColumn("_n", F.row_number().over(w) - 1)
    blocks = rows.where(F.col("_n") >= min_train).groupBy(F.floor((F.col("_n") - min_train) / test_size).alias("_block")).agg(F.min(time).alias("test_start"), F.max(time).alias("test_end"), F.count("*").alias("n_test"), F.min("_n").alias("_from"))
    # Purging by cumulative counts: rows and cutoffs stand in one order, a cutoff before rows resolved at its time.
    ends = rows.select(F.col(resolved).alias("_v"), F.lit(1).alias("_row"), F.lit(None).cast("long").alias("_block"))
    cuts = blocks.select((F.col("test_start") - embargo).alias("_v"), F.lit(0).alias("_row"), F.col("_block").cast("long"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_v", "_row").rowsBetween(Window.unboundedPreceding, 0)
    counts = ends.union(cuts).where("_v IS NOT NULL").select("_block", F.sum("_row").over(upto).alias("_fit")).where("_block IS NOT NULL")
    fits = blocks.join(counts, "_block")
    kept = fits.where(F.col("_fit") >= 1).withColumn("fold_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_block")) - 1)
    train = F.col("_fit") if max_train is None else F.least(F.col("_fit"), F.lit(max_train))
    return kept.select("fold_index", "test_start", "test_end", "n_test", train.alias("n_train"), (F.col("_from") - F.col("_fit")).alias("n_purged"))


def smoothed_rate(actual: Column, smoothing: float = 1.0) -> Column:
    """(positives + s) / (n + 2 s) as an aggregate."""
    return (F.sum(actual.cast("double")) + smoothing) / (F.count(actual) + 2 * smoothing)


def training_digests(training: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """keys, n, training_id and repeated (ids that a fold has twice): a content id of the set of rows that a fold was trained
    on, one aggregate a fold whatever its size."""
    one, two = digest(F.col(row_id))
    once = training.groupBy(*keys, row_id).agg(F.count("*").alias("_n"))
    out = once.groupBy(*keys).agg(F.count("*").alias("n"), one.alias("_one"), two.alias("_two"), F.count_if(F.col("_n") > 1).alias("repeated"))
    return out.select(*keys, "n", content_id("training", F.col("n"), F.col("_one"), F.col("_two")).alias("training_id"), "repeated")


def fit_baselines(training: DataFrame, keys: Sequence[str], order: str, actual: str, signal: str, smoothing: float = 1.0) -> DataFrame:
    """keys, n, base_rate (B0), rate_after_true, rate_after_false and last_actual (B1), base_logit, signal_mean and
    signal_scale (B2, B3) of each fold's training rows. `order` is unique within a fold; a signal that doesn't vary has
    scale 1."""
    before = F.lag(actual).over(Window.partitionBy(*keys).orderBy(order))
    y = F.col(actual)
    rate = lambda c: smoothed_rate(F.when(c, y), smoothing)
    out = training.withColumn("_before", before).groupBy(*keys).agg(
        F.count("*").alias("n"), smoothed_rate(y, smoothing).alias("base_rate"), rate(F.col("_before")).alias("rate_after_true"), rate(~F.col("_before")).alias("rate_after_false"),
        F.max_by(actual, order).alias("last_actual"), F.avg(signal).alias("signal_mean"), F.stddev_pop(signal).alias("_sd"),
    )
    return out.withColumns({"base_logit": logit(F.col("base_rate")), "signal_scale": F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0)}).drop("_sd")


def predict_baselines(rows: DataFrame, fits: DataFrame, keys: Sequence[str], signal: str) -> DataFrame:
    """rows, one for each kind B0 to B3, with kind and score. Fits are a row a fold."""
    joined = rows.join(F.broadcast(fits.drop("n")), list(keys))
    z = (F.col(signal) - F.col("signal_mean")) / F.col("signal_scale")
    scores = {"B0": F.col("base_rate"), "B1": F.when(F.col("last_actual"), F.col("rate_after_true")).otherwise(F.col("rate_after_false")), "B2": sigmoid(F.col("base_logit") + z), "B3": sigmoid(F.col("base_logit") - z)}
    return joined.select(*rows.columns, F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("score")) for k, c in scores.items()))))


def oos_predictions(labelled: DataFrame, time: str, resolved: str, actual: str, signal: str, min_train: int, test_size: int, embargo: int) -> DataFrame:
    """labelled rows of every test block, fold_index, kind (B0 to B3) and score, each fitted on what was resolved before
    its block, less the embargo. Rows without a signal or an outcome are left out first. Training sets of folds overlap,
    so rows meet folds: as many rows as the folds train on in all."""
    rows = labelled.where(F.col(signal).isNotNull() & F.col(actual).isNotNull())
    folds = F.broadcast(walk_forward_folds(rows, time, resolved, min_train, test_size, embargo).select("fold_index", "test_start", "test_end"))  # a row a block
    fits = fit_baselines(rows.join(folds, F.col(resolved) < F.col("test_start") - embargo), ["fold_index"], time, actual, signal)
    tests = rows.join(folds, F.col(time).between(F.col("test_start"), F.col("test_end"))).drop("test_start", "test_end")
    return predict_baselines(tests, fits, ["fold_index"], signal)


def calibration(predictions: DataFrame, keys: Sequence[str], score: str = "score", actual: str = "actual", eps: float = 1e-12) -> DataFrame:
    """keys, n, base_rate, brier, brier_reference, brier_skill, log_loss."""
    p, y = clip(F.col(score), eps, 1 - eps), F.col(actual).cast("double")
    out = predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
    )
    reference = F.col("base_rate") * (1 - F.col("base_rate"))
    return out.withColumns({"brier_reference": reference, "brier_skill": 1 - ratio(F.col("brier"), reference)})


def reliability_bins(predictions: DataFrame, keys: Sequence[str], bins: int = 10, score: str = "score", actual: str = "actual") -> DataFrame:
    """keys, bin, n, mean_score, rate: bins [i/n, (i+1)/n), 1.0 in the last, by comparing with the bounds themselves."""
    bound = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    number = F.size(F.filter(bound, lambda b: F.col(score) >= b))
    return predictions.withColumn("bin", number).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(actual).cast("double")).alias("rate"))


def expected_calibration_error(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ece, max_gap of reliability bins."""
    gap = F.abs(F.col("mean_score") - F.col("rate"))
    return bins.groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("max_gap"))


def roc_auc(predictions: DataFrame, keys: Sequence[str], score: str = "score", actual: str = "actual") -> DataFrame:
    """keys, n, auc by mid-ranks: scores are counted first, so ties and hot scores are one row; null for one class."""
    counts = predictions.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("long")).alias("pos"))
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy(score)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_rank", before + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * F.col("_rank")).alias("_sum"))
    neg = F.col("n") - F.col("pos")
    return out.select(*keys, "n", F.when((F.col("pos") > 0) & (neg > 0), (F.col("_sum") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).alias("auc"))


def skill_gate(metrics: DataFrame, keys: Sequence[str], kind: str = "kind", baseline: str = "B0", least_n: int = 50, least_class: int = 5) -> DataFrame:
    """metrics of every kind but the baseline, with brier_gain, log_loss_change, reasons and passed. Equality passes."""
    base = metrics.where(F.col(kind) == baseline).select(*keys, F.col("brier").alias("_b"), F.col("log_loss").alias("_l"))
    df = metrics.where(F.col(kind) != baseline).join(base, list(keys))
    pos = F.round(F.col("base_rate") * F.col("n"))
    df = df.withColumns({"brier_gain": F.col("_b") - F.col("brier"), "log_loss_change": F.col("log_loss") - F.col("_l")})
    why = F.array_compact(F.array(
        F.when(F.col("n") < least_n, F.lit("TOO_FEW")), F.when((pos < least_class) | (F.col("n") - pos < least_class), F.lit("ONE_SIDED")),
        F.when(F.col("brier_gain") < 0, F.lit("BRIER_WORSE")), F.when(F.col("log_loss_change") > 0, F.lit("LOG_LOSS_WORSE")),
    ))
    return df.withColumn("reasons", why).withColumn("passed", F.size("reasons") == 0).drop("_b", "_l")


def challenger_on_subset(challenger: DataFrame, baseline: DataFrame, key: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """The skill gate of a challenger that answers some cases only: both are measured on the cases that it answers.

    challenger, baseline: `key` of the case, `keys` of the cell, score and actual; the baseline has a row for every case of
    the challenger's, or that case counts for neither."""
    own = challenger.where("score IS NOT NULL AND actual IS NOT NULL").select(*keys, *key, F.col("score"), F.col("actual"))
    side = baseline.select(*keys, *key, F.col("score").alias("_base"))
    both = own.join(side, [*keys, *key]).select(*keys, "actual", F.inline(F.array(F.struct(F.lit("B0").alias("kind"), F.col("_base").alias("score")), F.struct(F.lit(name).alias("kind"), F.col("score").alias("score")))))
    cell = both if keys else both.withColumn("cell", F.lit(1))
    by = list(keys) or ["cell"]
    return skill_gate(calibration(cell, [*by, "kind"]), by)


def challenger_evidence(answers: DataFrame, tests: int | Column, baselines: DataFrame, eligible: DataFrame, key: Sequence[str], least_n: int = 30, least_class: int = 5, most_suppressed: float = 0.5) -> DataFrame:
    """One row: what a challenger that answers some cases shows against the best baseline on the cases that it answers.

    answers: `key`, score, actual; tests: number of all cases; baselines: `key`, kind, score, actual; eligible: the kinds that
    may be compared with (a column kind). The comparator is the kind of the least brier there, then log loss, then name.
    n, positives, suppressed (share of cases without an answer), comparator, brier_gain, log_loss_change, reasons
    (TOO_FEW, FEW_POSITIVES, FEW_NEGATIVES, SUPPRESSED, BRIER_WORSE, LOG_LOSS_WORSE; NO_ANSWERS alone) and state:
    INSUFFICIENT_EVIDENCE, NO_SKILL or ELIGIBLE_CHALLENGER."""
    own = calibration(answers.withColumn("cell", F.lit(1)), ["cell"]).select("n", F.round(F.col("base_rate") * F.col("n")).cast("bigint").alias("positives"), F.col("brier").alias("_b"), F.col("log_loss").alias("_l"))
    subset = baselines.join(eligible.select("kind").distinct(), "kind", "left_semi").join(answers.select(*key).distinct(), list(key), "left_semi")
    best = calibration(subset, ["kind"]).agg(F.min(F.struct("brier", "log_loss", "kind")).alias("_best"))  # one row
    first = answers.agg(F.count("*").alias("_n")).select(F.lit(1).alias("_one"))
    out = first.join(own.withColumn("_one", F.lit(1)), "_one", "left").join(best.withColumn("_one", F.lit(1)), "_one", "left").withColumn("_tests", tests if isinstance(tests, Column) else F.lit(tests))
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("positives", F.lit(0))
    out = out.withColumns({"n": n, "positives": pos, "suppressed": F.when(F.col("_tests") > 0, 1 - n / F.col("_tests")).otherwise(1.0), "brier_gain": F.col("_best.brier") - F.col("_b"), "log_loss_change": F.col("_l") - F.col("_best.log_loss")})
    thin = [F.when(F.col("n") < least_n, F.lit("TOO_FEW")), F.when(F.col("positives") < least_class, F.lit("FEW_POSITIVES")), F.when(F.col("n") - F.col("positives") < least_class, F.lit("FEW_NEGATIVES")), F.when(F.col("suppressed") > most_suppressed, F.lit("SUPPRESSED"))]
    worse = [F.when(F.col("brier_gain") < 0, F.lit("BRIER_WORSE")), F.when(F.col("log_loss_change") > 0, F.lit("LOG_LOSS_WORSE"))]
    none = F.col("n") == 0
    reasons = F.when(none, F.array(F.lit("NO_ANSWERS"))).otherwise(F.array_compact(F.array(*thin, *worse)))
    state = F.when(none | (F.size(F.array_compact(F.array(*thin))) > 0), "INSUFFICIENT_EVIDENCE").when(F.size("reasons") > 0, "NO_SKILL").otherwise("ELIGIBLE_CHALLENGER")
    return out.withColumn("reasons", reasons).withColumn("state", state).select("n", "positives", "suppressed", F.col("_best.kind").alias("comparator"), "brier_gain", "log_loss_change", "reasons", "state")


def model_registry(metrics: DataFrame, keys: Sequence[str], kind: str = "kind", baseline: str = "B0") -> tuple[DataFrame, DataFrame]:
    """(entries, cells). entries: keys, kind, n, brier, log_loss and state, REFERENCE_BASELINE, ELIGIBLE_CHALLENGER (it passes
    the skill gate) or REJECTED. cells: keys, eligible and challenger, the eligible kind of the least brier, then log loss,
    then name; null where none is eligible. Models in it have no authority of their own."""
    cols = [*keys, kind, "n", "brier", "log_loss"]
    first = metrics.where(F.col(kind) == baseline).select(*cols, F.lit("REFERENCE_BASELINE").alias("state"))
    entries = first.union(skill_gate(metrics, keys, kind, baseline).select(*cols, F.when(F.col("passed"), "ELIGIBLE_CHALLENGER").otherwise("REJECTED")))
    able = F.col("state") == "ELIGIBLE_CHALLENGER"
    return entries, entries.groupBy(*keys).agg(F.count_if(able).alias("eligible"), F.min_by(kind, F.when(able, F.struct("brier", "log_loss", kind))).alias("challenger"))


def research_matrix(horizons: DataFrame, events: DataFrame, cells: DataFrame) -> DataFrame:
    """Every horizon and event (small stated lists) with its state, MISSING where there is no cell."""
    return horizons.crossJoin(events).join(cells, ["horizon", "event"], "left").withColumn("state", F.coalesce("state", F.lit("MISSING")))


def _logistic(pdf: pd.DataFrame, features: list[str], iterations: int, rate: float, l2: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    x, y = pdf[features].to_numpy(float), pdf["actual"].to_numpy(float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd <= 1e-12, 1.0, sd)
    z, w = (x - mean) / sd, np.zeros(len(features))
    start = (y.sum() + 1) / (len(y) + 2)
    b = float(np.log(start / (1 - start)))
    for _ in range(iterations):
        e = 1 / (1 + np.exp(-np.clip(z @ w + b, -35, 35))) - y
        w, b = w - rate * (z.T @ e / len(y) + l2 * w / len(y)), b - rate * e.mean()
    return w, b, mean, sd


def fit_logistic(training: DataFrame, keys: Sequence[str], features: Sequence[str], order: Sequence[str], iterations: int = 500, rate: float = 0.1, l2: float = 1.0) -> DataFrame:
    """keys, n, intercept, weights, means, scales: full-batch gradient descent of a fixed number of steps for each fold
    (fold-sized groups), on standardised features, rows sorted by `order` so that sums repeat."""
    names = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        w, b, mean, sd = _logistic(pdf, names, iterations, rate, l2)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": len(pdf), "intercept": b, "weights": w.tolist(), "means": mean.tolist(), "scales": sd.tolist()}])

    kinds = ", ".join(f"{k} {training.schema[k].dataType.simpleString()}" for k in keys)
    return training.groupBy(*keys).applyInPandas(run, f"{kinds}, n bigint, intercept double, weights array<double>, means array<double>, scales array<double>")


def predict_logistic(rows: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """rows with kind B4 and score, by the fits of `fit_logistic` on the same features (a row a fold)."""
    joined = rows.join(F.broadcast(fits.drop("n")), list(keys))
    linear = F.col("intercept")
    for k, f in enumerate(features):
        linear = linear + F.get("weights", k) * (F.col(f) - F.get("means", k)) / F.get("scales", k)
    return joined.select(*rows.columns, F.lit("B4").alias("kind"), sigmoid(linear).alias("score"))


def platt(predictions: DataFrame, keys: Sequence[str], score: str = "score", actual: str = "actual", least_n: int = 20, least_class: int = 5, rounds: int = 12) -> DataFrame:
    """keys, n, a, b of sigmoid(a + b logit(score)): Newton steps on sufficient statistics, all keys in each step, so
    training rows are only ever aggregated. Keys with too few rows or a class of too few are left out."""
    known = predictions.select(*keys, logit(F.col(score), 1e-6).alias("_x"), F.col(actual).cast("double").alias("_y"))
    x = kept(known.groupBy(*keys, "_x").agg(F.count("*").alias("_m"), F.sum("_y").alias("_y")), "scores")  # predictions are read once: a row a score
    fit = x.groupBy(*keys).agg(F.sum("_m").alias("n"), F.sum("_y").alias("_pos")).where((F.col("n") >= least_n) & (F.col("_pos") >= least_class) & (F.col("n") - F.col("_pos") >= least_class)).select(*keys, "n", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    for _ in range(rounds):
        p = sigmoid(F.col("a") + F.col("b") * F.col("_x"))
        step = x.join(F.broadcast(fit), list(keys)).withColumn("_p", p).withColumn("_w", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-9)))
        error, weight = F.col("_y") - F.col("_m") * F.col("_p"), F.col("_m") * F.col("_w")
        sums = step.groupBy(*keys, "n", "a", "b").agg(F.sum(error).alias("g0"), F.sum(error * F.col("_x")).alias("g1"), F.sum(weight).alias("h0"), F.sum(weight * F.col("_x")).alias("h1"), F.sum(weight * F.col("_x") * F.col("_x")).alias("h2"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1") + 1e-9
        rows = sums.select(*keys, "n", (F.col("a") + (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).alias("a"), (F.col("b") + (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).alias("b"))
        fit = predictions.sparkSession.createDataFrame(rows.collect(), rows.schema)  # a row a key: models, not data
    return fit


def apply_platt(predictions: DataFrame, fits: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """predictions with `calibrated`, sigmoid(a + b logit(score)) by the fits of `platt` (a row a key); null where a key has
    no fit."""
    p = sigmoid(F.col("a") + F.col("b") * logit(F.col(score), 1e-6))
    return predictions.join(F.broadcast(fits.select(*keys, "a", "b")), list(keys), "left").withColumn("calibrated", p).drop("a", "b")


def platt_evaluation(predictions: DataFrame, fits: DataFrame, keys: Sequence[str], score: str = "score", actual: str = "actual") -> DataFrame:
    """keys, n, brier and log loss before and after calibration, and whether both got no worse; keys with a fit only."""
    rows = apply_platt(predictions, fits, keys, score).where("calibrated IS NOT NULL")
    side = lambda s, names: calibration(rows, keys, s, actual).select(*keys, "n", *(F.col(c).alias(n) for c, n in zip(("brier", "log_loss"), names)))
    both = side(score, ("brier", "log_loss")).join(side("calibrated", ("brier_after", "log_loss_after")).drop("n"), list(keys))
    return both.withColumn("improved", (F.col("brier_after") <= F.col("brier")) & (F.col("log_loss_after") <= F.col("log_loss")))
