"""Walk-forward backtests: at every decision the regime score of what was known then, and what came of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import finite, flags
from tidewatch.operators import regime, timeseries
from tidewatch.operators.pit import strict


def decisions(frame: DataFrame, time: str, price: str = "asset_usd", least: int = 365, step: int = 7, forward: int = 7, embargo: int = 0) -> DataFrame:
    """end, at, outcome: every `step` rows of a daily frame from row `least` on, whether the price is higher `embargo` and
    `forward` rows later; `end` counts the rows up to the decision's own. The frame's last row is no outcome's. A price
    that is unknown at either end is no rise."""
    w, ahead = Window.partitionBy(F.lit(0)).orderBy(time), embargo + forward  # a table of days
    p = finite(F.col(price).cast("double"))
    rows = frame.select(F.row_number().over(w).alias("end"), F.col(time).alias("at"), F.coalesce(F.lead(p, ahead).over(w) > p, F.lit(False)).alias("outcome"), F.lead(F.lit(1), ahead + 1).over(w).alias("_more"))
    return rows.where((F.col("end") >= least) & ((F.col("end") - least) % step == 0) & F.col("_more").isNotNull()).drop("_more")


def availability_problems(frame: DataFrame, time: str, available: str) -> DataFrame:
    """time and problem of rows whose clocks can't be: NO_TIME, NO_AVAILABILITY, EARLY (available before observed),
    REPEATED_TIME (once for each such time)."""
    own = flags(NO_TIME=F.col(time).isNull(), NO_AVAILABILITY=F.col(available).isNull(), EARLY=F.col(available) < F.col(time))
    again = frame.where(F.col(time).isNotNull()).groupBy(time).agg(F.count("*").alias("n")).where("n > 1").select(time, F.lit("REPEATED_TIME").alias("problem"))
    return frame.select(time, F.explode(own).alias("problem")).union(again)


def histories(frame: DataFrame, time: str, made: DataFrame, least: int = 365, step: int = 7, window: int | None = None, available: str | None = None) -> DataFrame:
    """`end`, `at` and the frame's rows that decision `end` of `made` knows: its last `window` rows (all without), of them
    those that were available by `at`. A row goes to the decisions that hold it by arithmetic, so decisions and rows meet
    on a number: as many rows as all histories together have."""
    numbered = frame.withColumn("_row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)))
    last = F.broadcast(made.agg(F.max("end").alias("_last")))  # one row
    first = F.greatest(F.lit(0), F.ceil((F.col("_row") - least) / step).cast("int")) * step + least
    until = F.col("_last") if window is None else F.least(F.col("_last"), F.col("_row") + window - 1)
    held = numbered.crossJoin(last).withColumns({"_first": first, "_until": until}).where("_first <= _until").withColumn("end", F.explode(F.sequence("_first", "_until", F.lit(step)))).drop("_row", "_last", "_first", "_until")
    known = held.join(made.select("end", "at"), "end")
    return known.where(F.col(available) <= F.col("at")) if available else known


def walk_forward(
    frame: DataFrame, time: str, price: str = "asset_usd", *, least: int = 365, step: int = 7, forward: int = 7, embargo: int = 0, available: str | None = None, window: int | None = None,
    supplemental: Mapping[str, Column] | None = None, horizon: str = "1d",
) -> DataFrame:
    """One row a decision: end, at, n (rows that it knows), outcome, raw_score (bull score as a share; not a calibrated
    probability), label, data_confidence, model_confidence and confidence.

    Without `available` and `window` a decision knows all rows up to its own, whose features look back only, so features
    are made once for the frame. Else each decision has a frame of its own: with `window` its last rows, with `available`
    those that were available by its time, and decisions that know fewer than `least` rows are left out. Clocks that
    `availability_problems` reports are an error when the result is read. An empty or short frame has no decisions."""
    if least < 30 or step < 1 or forward < 1 or embargo < 0:
        raise ValueError("least must be 30 or more, step and forward positive, embargo not negative")
    if window is not None and window < least:
        raise ValueError("window must not be smaller than least")
    made = decisions(frame, time, price, least, step, forward, embargo)
    if available is None and window is None:
        found = timeseries.feature_rows(frame, time, supplemental).withColumnRenamed(time, "at")
        rows = made.withColumn("n", F.col("end")).join(found, "at")
    else:
        sound = strict(frame, availability_problems(frame, time, available), "a row's clocks can't be") if available else frame
        own = histories(sound, time, made, least, step, window, available)
        found = timeseries.feature_rows(own, time, supplemental, by=["end"])
        newest = own.groupBy("end").agg(F.max(time).alias(time), F.count("*").alias("n")).where(F.col("n") >= least)
        rows = made.join(newest, "end").join(found, ["end", time])
    scored = regime.component_scores(rows)
    out = regime.blended(scored, regime.WEIGHTS[horizon], regime.data_quality(rows)[2])
    model = 0.65 * F.col("coverage") + 0.20 * F.col("alignment") + 0.15 * F.col("conviction")
    four = lambda c, name: F.round(c, 4).alias(name)
    return out.select("end", "at", "n", "outcome", (F.round("bull_score", 2) / 100).alias("raw_score"), "label", four(F.col("data_confidence"), "data_confidence"), four(model, "model_confidence"), four(F.col("confidence"), "confidence"))


def summary(scored: DataFrame) -> DataFrame:
    """One row: decisions, accuracy (a score of a half or more says rise), brier of the raw score, and mean confidences; 0
    and nulls without a decision."""
    rise = F.col("raw_score") >= 0.5
    return scored.agg(
        F.count("*").alias("decisions"), F.avg((rise == F.col("outcome")).cast("int")).alias("accuracy"), F.avg((F.col("raw_score") - F.col("outcome").cast("int")) ** 2).alias("brier"),
        *(F.avg(c).alias(c) for c in ("confidence", "data_confidence", "model_confidence")),
    )
