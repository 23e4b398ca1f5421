"""Robust price consensus over providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import flags, ratio


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`, which must break all ties."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def consensus_close(
    quotes: DataFrame, asset: str = "asset", price: str = "price", close_time: str = "close_time", now: Column | None = None,
    max_age_seconds: float = 7200, min_providers: int = 2, max_spread: float = 0.02, outlier: float = 0.03, alignment_seconds: float = 300,
) -> DataFrame:
    """One row per asset from one quote per provider: median, spread, agreement, freshness, validity, flags.

    With three providers or more, prices further than `outlier` from the median are left out (inclusive bound). Quotes
    closing after `now` (default: the current time) make the asset INVALID; the time alignment, a CONFLICT if it fails,
    looks at all quotes; spread, agreement and freshness at those that stay. The value is null unless valid: enough
    providers, and no CONFLICT, STALE or INVALID. Quotes whose price is null or not positive, or whose time is null, are
    no quotes."""
    now = F.current_timestamp() if now is None else now
    epoch = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    base = quotes.where((F.col(price) > 0) & F.col(close_time).isNotNull()).select(F.col(asset).alias("asset"), F.col(price).alias("p"), epoch(F.col(close_time)).alias("t"), epoch(now).alias("now"))
    middle = base.groupBy("asset").agg(F.median("p").alias("mid"), F.count("*").alias("inputs"), (F.max("t") - F.min("t")).alias("skew"), F.max(F.col("t") > F.col("now")).alias("future"))
    # The median comes back by a join: a window over a hot asset would gather all its quotes in one task unsplit.
    kept = base.join(middle.select("asset", "mid", F.col("inputs").alias("all")), "asset").where((F.col("all") < 3) | (F.abs(F.col("p") - F.col("mid")) / F.col("mid") <= outlier))
    out = kept.groupBy("asset").agg(F.count("*").alias("providers"), F.median("p").alias("value"), F.max("p").alias("hi"), F.min("p").alias("lo"), F.median(F.greatest(F.lit(0.0), F.col("now") - F.col("t"))).alias("age"))
    spread = F.when(F.col("providers") < 2, F.lit(0.0)).otherwise(ratio(F.col("hi") - F.col("lo"), F.col("value")))
    full = middle.join(out, "asset", "left").withColumns({"providers": F.coalesce("providers", F.lit(0)), "age": F.coalesce("age", F.lit(float("inf")))})
    full = full.withColumn("spread", F.coalesce(spread, F.lit(0.0)))
    apart = (F.col("skew") > alignment_seconds) | (F.col("spread") > max_spread)
    marks = flags(INVALID=F.col("future"), CONFLICT=apart, OUTLIER=F.col("inputs") > F.col("providers"), MISSING=F.col("providers") < min_providers, STALE=F.col("age") > max_age_seconds)
    full = full.withColumn("flags", marks).withColumn("valid", (F.col("providers") >= min_providers) & ~F.arrays_overlap("flags", F.array(F.lit("INVALID"), F.lit("CONFLICT"), F.lit("STALE"))))
    return full.select(
        "asset", "inputs", "providers", (F.col("inputs") - F.col("providers")).alias("rejected"), F.when(F.col("valid"), F.col("value")).alias("value"), "spread",
        F.greatest(F.lit(0.0), 1 - F.least(F.col("spread") / max_spread, F.lit(1.0))).alias("agreement"),
        F.greatest(F.lit(0.0), 1 - F.least(F.col("age") / max_age_seconds, F.lit(1.0))).alias("freshness"),
        "valid", "flags",
    )
