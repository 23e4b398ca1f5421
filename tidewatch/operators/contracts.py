"""What rows must hold: named rules of each kind of record, for `pit.violations` (which rows break which) and `pit.strict`.

A rule is a column that is true for a good row; a value that must be there and is null breaks it, one that may be missing
does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = dict[str, Column]

#: Horizons, and metrics of a derivatives snapshot that may be negative and that may not.
HORIZONS = ("1h", "4h", "1d", "1w", "1mo", "3mo", "1y")
SIGNED = ("funding_rate", "basis_bps")
NOT_NEGATIVE = ("open_interest_usd", "liquidations_long_usd", "liquidations_short_usd", "long_short_ratio", "taker_buy_sell_ratio")


def finite_number(name: str) -> Column:
    """Whether a column holds a number that is neither NaN nor infinite."""
    x = F.col(name)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def positive(name: str) -> Column:
    return finite_number(name) & (F.col(name) > 0)


def if_known(name: str, rule: Column) -> Column:
    return F.col(name).isNull() | rule


def clocks(observed: str = "observed_at", available: str = "available_at", fetched: str = "fetched_at") -> Rules:
    """observed <= available <= fetched; the last two are known both or neither."""
    o, a, f = F.col(observed), F.col(available), F.col(fetched)
    return {"observed": o.isNotNull(), "clocks_together": a.isNull() == f.isNull(), "clock_order": a.isNull() | f.isNull() | ((o <= a) & (a <= f))}


def digest_rule(name: str = "payload_sha256") -> Rules:
    return {"digest": if_known(name, F.col(name).rlike("^[0-9a-f]{64}$"))}


def trades() -> Rules:
    return {"price": positive("price"), "quantity": positive("quantity"), **clocks()}


def funding() -> Rules:
    return {"mark": positive("mark_price"), "index": positive("index_price"), "funding": finite_number("funding_rate"), "next": F.col("funding_at").isNotNull(), **clocks(), **digest_rule()}


def open_interest() -> Rules:
    return {"open_interest": finite_number("open_interest") & (F.col("open_interest") >= 0), **clocks(), **digest_rule()}


def derivatives() -> Rules:
    """Metrics that are known are finite, and most of them not negative."""
    return {n: if_known(n, finite_number(n)) for n in SIGNED} | {n: if_known(n, finite_number(n) & (F.col(n) >= 0)) for n in NOT_NEGATIVE}


def snapshots() -> Rules:
    """Bull and bear scores add up to 100 (to 0.02); blocked output has reasons, and is exactly what is DEGRADED."""
    blocked = F.col("blocked")
    return {"scores": F.abs(F.col("bull_score") + F.col("bear_score") - 100) <= 0.02, "reasons": ~blocked | (F.size("reasons") > 0), "degraded": blocked == (F.col("label") == "DEGRADED")}


def frozen_predictions() -> Rules:
    """A reading is frozen after publication and before its horizon ends; HIT and MISS are for afterwards; a resolution and
    its time come together."""
    outcome, at = F.col("resolution"), F.col("resolved_at")
    return {
        "published": F.col("frozen_at") >= F.col("published_at"), "ex_ante": F.col("frozen_at") < F.col("horizon_end"), "resolution": outcome.isin("OPEN", "HIT", "MISS", "VOID", "PARTIAL", "UNRESOLVABLE"),
        "resolved_together": (outcome == "OPEN") == at.isNull(), "too_early": ~outcome.isin("HIT", "MISS") | (at >= F.col("horizon_end")),
    }


def point_in_time(observed: str, available: str) -> Rules:
    """A research row has a time, and was not available before it."""
    return {"time": F.col(observed).isNotNull(), "available": F.col(available) >= F.col(observed)}


def horizon(name: str = "horizon") -> Rules:
    return {"horizon": F.col(name).isin(*HORIZONS)}


def fold_problems(folds: DataFrame, fold: str = "fold_index") -> DataFrame:
    """fold, problem of a plan of folds (a row a block): REPEATED, NOT_CONTIGUOUS from 0, EMPTY (no test or no training
    rows), and MIXED_HORIZONS where the plan has a horizon column with several values."""
    w = Window.partitionBy(F.lit(0)).orderBy(fold)
    marks = folds.withColumns({"_before": F.lag(fold).over(w), "_n": F.count("*").over(Window.partitionBy(fold))})
    rules = {"REPEATED": F.col("_n") > 1, "NOT_CONTIGUOUS": F.coalesce(F.col(fold) > F.col("_before") + 1, F.col(fold) != 0), "EMPTY": (F.col("n_test") < 1) | (F.col("n_train") < 1)}
    if "horizon" in folds.columns:
        every = Window.partitionBy(F.lit(0))
        marks = marks.withColumn("_mixed", F.min("horizon").over(every) != F.max("horizon").over(every))
        rules["MIXED_HORIZONS"] = F.col("_mixed")
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return marks.select(fold, F.explode(found).alias("problem")).distinct()
