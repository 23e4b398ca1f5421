"""Calibrator candidates: Platt fits on what was resolved before a cutoff, applied to later predictions of the same kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import content_id, finite, logit, sigmoid
from tidewatch.operators.pit import digest
from tidewatch.scratch import kept

#: How near 0 and 1 a score may come, steps at most and when they end, and the determinant at which a fit is
#: singular.
EPSILON, STEPS, TOLERANCE, SINGULAR = 1e-12, 100, 1e-10, 1e-15


def _fits(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, b, ok: Newton steps for every key at once on counts by score; a key that has come to rest stays there."""
    spark = points.sparkSession
    fit = points.select(*keys).distinct().select(*keys, F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(False).alias("rest"), F.lit(True).alias("ok"))
    rows, schema = fit.collect(), fit.schema  # a row a kind of prediction, as in every step
    for _ in range(STEPS):
        moving = [r for r in rows if not r.rest]
        if not moving:
            break
        at = spark.createDataFrame(moving, schema)
        step = points.join(F.broadcast(at), list(keys)).withColumn("_p", sigmoid(F.col("a") + F.col("b") * F.col("_x"))).withColumns({"_e": F.col("_y") - F.col("_m") * F.col("_p"), "_w": F.col("_m") * F.col("_p") * (1 - F.col("_p"))})
        sums = step.groupBy(*keys, "a", "b").agg(*(F.sum(c).alias(n) for n, c in (("g0", F.col("_e")), ("g1", F.col("_e") * F.col("_x")), ("h0", F.col("_w")), ("h1", F.col("_w") * F.col("_x")), ("h2", F.col("_w") * F.col("_x") * F.col("_x")))))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        ok = det > SINGULAR
        da, db = (F.when(ok, x / det).otherwise(0.0) for x in (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1"), F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")))
        moved = sums.select(*keys, (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), (~ok | (F.greatest(F.abs(da), F.abs(db)) < TOLERANCE)).alias("rest"), ok.alias("ok")).collect()
        rows = [r for r in rows if r.rest] + moved
    return spark.createDataFrame(rows, schema).drop("rest")


def platt_candidates(records: DataFrame, keys: Sequence[str], cutoff: Column, least_n: int = 20, least_class: int = 5, eps: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(candidates, refusals) of resolved predictions: keys (not null; horizon and event), prediction_id, prediction_time,
    resolved_at, score, actual.

    Only records predicted and resolved before the cutoff count; the others, and those with an unknown time, score or
    outcome, are purged. candidates: keys, fit_cutoff, n, purged, positives, negatives, a, b, epsilon, predictions (a digest of the
    ids that it was fitted on, whatever their order) and calibrator_id, a content id of all of that. refusals: keys, n,
    purged, reason: TOO_FEW, ONE_SIDED (less than `least_class` of a class) or SINGULAR (scores that are all
    the same, or steps that run away)."""
    if least_n < 2 or least_class < 1 or not 0 < eps < 0.5:
        raise ValueError("least_n must be 2 or more, least_class positive, eps between 0 and 0.5")
    good = (F.col("prediction_time") < cutoff) & (F.col("resolved_at") < cutoff) & F.col("score").isNotNull() & F.col("actual").isNotNull()
    marked = records.select(*keys, "prediction_id", F.coalesce(good, F.lit(False)).alias("_in"), logit(F.col("score").cast("double"), eps).alias("_x"), F.col("actual").cast("int").cast("double").alias("_y"))
    one, two = digest(F.when(F.col("_in"), F.struct("prediction_id")))
    # rows that don't count hash as null: the same for every record, so their number is taken in as well
    facts = kept(marked.groupBy(*keys).agg(F.count_if("_in").alias("n"), F.count_if(~F.col("_in")).alias("purged"), F.count_if(F.col("_in") & (F.col("_y") == 1)).alias("positives"), one.alias("_one"), two.alias("_two")), "facts")
    few, sided = F.col("n") < least_n, F.least("positives", F.col("n") - F.col("positives")) < least_class
    able = facts.where(~few & ~sided)
    points = kept(marked.where("_in").join(F.broadcast(able.select(*keys)), list(keys), "left_semi").groupBy(*keys, "_x").agg(F.count("*").alias("_m"), F.sum("_y").alias("_y")), "points")  # a row a score
    found = facts.join(_fits(points, keys), list(keys), "left").withColumn("reason", F.when(few, "TOO_FEW").when(sided, "ONE_SIDED").when(~F.col("ok") | finite(F.col("a") + F.col("b")).isNull(), "SINGULAR"))
    made = found.where("reason IS NULL").select(*keys, cutoff.alias("fit_cutoff"), "n", "purged", "positives", (F.col("n") - F.col("positives")).alias("negatives"), "a", "b", F.lit(eps).alias("epsilon"), F.sha2(F.concat_ws("/", "_one", "_two"), 256).alias("predictions"))
    return made.withColumn("calibrator_id", content_id("platt-candidate", *(F.col(c) for c in made.columns))), found.where("reason IS NOT NULL").select(*keys, "n", "purged", "reason")


def apply_candidates(predictions: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(calibrated, refusals) of predictions: keys, prediction_id, prediction_time, score. candidates: a row for each keys.

    calibrated: predictions with calibrator_id, calibrated and candidate_id. refusals: prediction_id, reason: NO_CALIBRATOR
    (none of that horizon and event), BEFORE_CUTOFF (the calibrator knows what came later; an unknown time counts as
    before) or SCORE (unknown, or outside 0 to 1). A calibrated value has no authority of its own."""
    fits = candidates.select(*keys, "fit_cutoff", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("epsilon").alias("_eps"), "calibrator_id")
    met = predictions.join(fits, list(keys), "left")
    score, later = F.col("score").cast("double"), F.coalesce(F.col("prediction_time") >= F.col("fit_cutoff"), F.lit(False))
    reason = F.when(F.col("calibrator_id").isNull(), "NO_CALIBRATOR").when(~later, "BEFORE_CUTOFF").when(~F.coalesce(score.between(0, 1), F.lit(False)), "SCORE")
    judged = met.withColumn("reason", reason)
    held = F.greatest(F.col("_eps"), F.least(1 - F.col("_eps"), score))
    value = sigmoid(F.col("_a") + F.col("_b") * F.ln(held / (1 - held)))
    good = judged.where("reason IS NULL").withColumn("calibrated", value).drop("_a", "_b", "_eps", "fit_cutoff", "reason")
    named = good.withColumn("candidate_id", content_id("calibrated-score-candidate", F.col("prediction_id"), F.col("calibrator_id"), F.col("prediction_time"), *(F.col(k) for k in keys), F.col("score"), F.col("calibrated")))
    return named, judged.where("reason IS NOT NULL").select("prediction_id", "reason")
