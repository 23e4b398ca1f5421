"""Evidence at a time: windows that aligned streams allow, shadow vectors with an independent price, lineage, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import content_id

#: Marks of every shadow vector; flags of a window that block it; tiers whose evidence makes a fact.
SHADOW_FLAGS = ("UNCALIBRATED_SHADOW_ONLY", "INDEPENDENT_PRICE_CONSENSUS")
BLOCKING = "SPARSE_WINDOW"
PRIMARY_TIERS = ("T0_PRIMARY_MACHINE", "T1_PRIMARY_DOCUMENT")


def _union(*arrays):
    """Elements in order of first appearance."""
    return F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))


def aligned_windows(alignment: DataFrame, windows: DataFrame, at: str = "at", key: str = "symbol") -> DataFrame:
    """One row for each time of `alignment` (at, eligible, flags) and symbol of `windows`: the window, evidence_eligible and
    flags. Where streams aren't aligned, there is no window, or it is sparse, stale or late, `window` is null and a flag
    says why. Times without a window keep one row with a null symbol."""
    value = [c for c in windows.columns if c not in (at, key)]
    side = windows.select(at, key, F.struct(*value).alias("_w"))
    joined = alignment.select(at, F.col("eligible").alias("_ok"), F.col("flags").alias("_flags")).join(side, at, "left")
    blocked = ~F.col("_w.regime_eligible") | F.array_contains("_w.flags", BLOCKING)
    eligible = F.col("_ok") & F.col("_w").isNotNull() & ~F.coalesce(blocked, F.lit(True))
    why = F.when(~F.col("_ok"), F.array().cast("array<string>")).when(F.col("_w").isNull(), F.array(F.lit("TEMPORAL_WINDOW_NO_DATA"))).when(blocked, F.array(F.lit("TEMPORAL_WINDOW_INELIGIBLE")))
    seen = F.when(F.col("_ok"), F.col("_w.flags"))
    return joined.select(at, key, F.when(eligible, F.col("_w")).alias("window"), eligible.alias("evidence_eligible"), _union(F.col("_flags"), seen, why).alias("flags"))


def shadow_vectors(aligned: DataFrame, anchors: DataFrame, source_family: str, at: str = "at", key: str = "symbol") -> DataFrame:
    """Eligible windows with an independent price, as rows of evidence that carry no probability and no authority.

    anchors: symbol, fetched_at, value, valid, provider_count, providers, agreement, freshness, anchor_flags (one row a
    symbol and time that it is for). An anchor counts if it was fetched by then, is valid with two providers or more, and
    one of them at least is not of the source's own family."""
    outside = F.filter("providers", lambda p: ~F.lower(p).startswith(source_family.lower()))
    able = F.col("evidence_eligible") & F.col("window").isNotNull() & (F.col("fetched_at") <= F.col(at)) & F.col("valid") & F.col("value").isNotNull() & (F.col("provider_count") >= 2) & (F.size(outside) > 0)
    joined = aligned.join(anchors, [at, key]).where(able)
    marked = _union(F.col("flags"), F.array(*map(F.lit, SHADOW_FLAGS)), F.transform("anchor_flags", lambda f: F.concat(F.lit("CONSENSUS_"), f)))
    return joined.select(
        at, key, F.col("value").alias("independent_price"), F.col("provider_count").alias("independent_provider_count"), F.size(outside).alias("independent_external_provider_count"), F.array_sort("providers").alias("independent_providers"),
        F.col("agreement").alias("consensus_agreement_score"), F.col("freshness").alias("consensus_freshness_score"), "window.*", marked.alias("quality_flags"),
    )


def lineage(vectors: DataFrame, sources: DataFrame, at: str = "at", key: str = "symbol") -> DataFrame:
    """at, symbol, vector_id, lineage_id, n_sources of each vector: content ids of its values and of the sources it rests on.

    sources: at, symbol, source_id (a content id each). A vector without a source has no lineage and is left out."""
    scalar = [c for c, t in vectors.dtypes if c not in (at, key) and not t.startswith("array")]
    vector = content_id("shadow-vector", F.col(key), F.col(at), *(F.col(c) for c in sorted(scalar)))
    # A vector's sources are the streams it was made of: a handful.
    rests = sources.groupBy(at, key).agg(F.array_sort(F.collect_set("source_id")).alias("_s"))
    return vectors.select(at, key, vector.alias("vector_id")).join(rests, [at, key]).select(at, key, "vector_id", content_id("lineage", F.col("vector_id"), F.array_join("_s", ",")).alias("lineage_id"), F.size("_s").alias("n_sources"))


def promoted(claims: DataFrame, wanted: DataFrame, contradictions: DataFrame, claim: str = "claim", status: str = "status", primary: Sequence[str] = PRIMARY_TIERS) -> tuple[DataFrame, DataFrame]:
    """(claims with the new status, refusals: claim and reason). wanted: claim, target, tiers (array of its sources' tiers).
    A FACT needs primary evidence and no open contradiction (pairs a, b of contradictions); other targets are free."""
    hit = contradictions.select(F.col("a").alias(claim)).distinct().withColumn("_against", F.lit(True))
    asked = wanted.join(hit, claim, "left")
    fact = F.col("target") == "FACT"
    reason = F.when(fact & ~F.arrays_overlap("tiers", F.array(*map(F.lit, primary))), "NO_PRIMARY_EVIDENCE").when(fact & F.col("_against").isNotNull(), "CONTRADICTED")
    judged = asked.withColumn("reason", reason)
    good = judged.where("reason IS NULL").groupBy(claim).agg(F.min("target").alias("_to"))
    out = claims.join(good, claim, "left").withColumn(status, F.coalesce("_to", status)).drop("_to")
    return out, judged.where("reason IS NOT NULL").select(claim, "reason")


def resolvable(predictions: DataFrame, outcomes: DataFrame, key: str = "prediction_id") -> tuple[DataFrame, DataFrame]:
    """(predictions with resolution and resolved_at, refusals: key and reason). outcomes: key, outcome, at. OPEN resolves
    nothing, and HIT or MISS can't come before the horizon's end."""
    asked = predictions.select(key, "horizon_end").join(outcomes, key)
    reason = F.when(F.col("outcome") == "OPEN", "STAYS_OPEN").when(F.col("outcome").isin("HIT", "MISS") & (F.col("at") < F.col("horizon_end")), "TOO_EARLY")
    judged = asked.withColumn("reason", reason)
    good = judged.where("reason IS NULL").groupBy(key).agg(F.min_by(F.struct("outcome", "at"), F.struct("at", "outcome")).alias("_o"))
    out = predictions.join(good, key, "left").withColumns({"resolution": F.coalesce("_o.outcome", F.lit("OPEN")), "resolved_at": F.col("_o.at")}).drop("_o")
    return out, judged.where("reason IS NOT NULL").select(key, "reason")
