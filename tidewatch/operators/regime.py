"""Explainable regime scores: components, blend, label, drivers, prototypes, alerts, and rule ladders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import clip, finite, flags, scale

#: Fixed values: (feature, width, sign) of each component's terms. `asset` stands for the asset that is scored.
TERMS = {
    "macro": (("ndx_return_20d", 0.10, 1), ("dxy_return_20d", 0.05, -1), ("us10y_change_20d", 0.50, -1), ("vix_z_20d", 2.0, -1)),
    "crypto": (("btc_return_7d", 0.15, 1), ("btc_return_30d", 0.30, 1), ("eth_btc_return_7d", 0.10, 1), ("btc_dominance_change_20d", 0.08, -1)),
    "relative": (("asset_return_7d", 0.20, 1), ("asset_return_30d", 0.45, 1), ("asset_btc_return_7d", 0.15, 1), ("asset_btc_return_30d", 0.30, 1), ("asset_ma100_distance", 0.40, 1)),
}
#: Component weights of each horizon.
WEIGHTS = {
    "1h": {"macro": 0.10, "crypto": 0.30, "relative": 0.30, "derivatives": 0.25, "ledger": 0.05},
    "4h": {"macro": 0.15, "crypto": 0.30, "relative": 0.30, "derivatives": 0.20, "ledger": 0.05},
    "1d": {"macro": 0.25, "crypto": 0.30, "relative": 0.30, "derivatives": 0.10, "ledger": 0.05},
    "1w": {"macro": 0.35, "crypto": 0.30, "relative": 0.25, "derivatives": 0.05, "ledger": 0.05},
}
#: Lower bounds of labels on the bull score.
LABELS = ((72, "STRONG_BULL"), (58, "BULLISH"), (43, "NEUTRAL"), (28, "BEARISH"))


def component(terms: Sequence[Column]) -> tuple[Column, Column]:
    """(score, coverage): the mean of the terms that are known, 50 without any; the share that is known."""
    known = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in terms), F.lit(0))
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    return F.when(known == 0, F.lit(50.0)).otherwise(total / known), known / F.lit(float(len(terms)))


def component_scores(features: DataFrame) -> DataFrame:
    """features with score_<component> and coverage_<component>; features that are missing as columns count as unknown."""
    have = lambda n: F.col(n) if n in features.columns else F.lit(None).cast("double")
    parts = {k: [scale(have(f), w, sign=s) for f, w, s in terms] for k, terms in TERMS.items()}
    calm = lambda n, w: 100 * (1 - clip(F.abs(have(n)) / w, 0.0, 1.0))
    parts["derivatives"] = [calm("funding_z", 2.5), calm("oi_price_divergence", 2.0), scale(have("liquidation_impulse"), 1.0)]
    parts["ledger"] = [scale(have("ledger_activity_z"), 2.0)]
    out = {}
    for k, terms in parts.items():
        out[f"score_{k}"], out[f"coverage_{k}"] = component(terms)
    return features.withColumns(out)


#: Features that say how good the data are.
QUALITY = ("provider_agreement", "freshness_score", "source_coverage")


def data_quality(features: DataFrame) -> tuple[Column, Column, Column]:
    """(quality from 0 to 100, coverage, confidence) of rows: the mean of the features of QUALITY that are known, held within
    [0, 1], the share that is known, and their product; 0 without any."""
    have = [clip(finite(F.col(n).cast("double")), 0.0, 1.0) if n in features.columns else F.lit(None).cast("double") for n in QUALITY]
    known = sum((h.isNotNull().cast("int") for h in have), F.lit(0))
    mean = F.when(known > 0, sum((F.coalesce(h, F.lit(0.0)) for h in have), F.lit(0.0)) / known).otherwise(0.0)
    coverage = known / F.lit(float(len(QUALITY)))
    return mean * 100, coverage, mean * coverage


def blended(scored: DataFrame, weights: Mapping[str, float], quality: Column | None = None, least_confidence: float = 0.5) -> DataFrame:
    """Adds bull_score, coverage, alignment, conviction, data_confidence, confidence, blocked, reasons and label.

    A component weighs its weight times its coverage; quality never moves the score, only the confidence."""
    quality = F.lit(1.0) if quality is None else quality
    eff = {k: F.lit(w) * F.col(f"coverage_{k}") for k, w in weights.items()}
    total = sum(eff.values(), F.lit(0.0))
    bull = F.when(total == 0, F.lit(50.0)).otherwise(sum((eff[k] * F.col(f"score_{k}") for k in weights), F.lit(0.0)) / total)
    active = F.array_compact(F.array(*(F.when(F.col(f"coverage_{k}") > 0, F.col(f"score_{k}")) for k in weights)))
    df = scored.withColumns({"bull_score": bull, "coverage": total, "_active": active})
    mean = F.aggregate("_active", F.lit(0.0), lambda a, x: a + x) / F.size("_active")
    df = df.withColumn("_mean", F.when(F.size("_active") > 0, mean))
    var = F.aggregate("_active", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.size("_active")
    df = df.withColumns({
        "alignment": F.when(F.size("_active") >= 2, clip(1 - F.sqrt(var) / 50, 0.0, 1.0)).otherwise(0.0),
        "conviction": F.abs(F.col("bull_score") - 50) / 50,
        "data_confidence": clip(F.least(quality, F.col("coverage")), 0.0, 1.0),
    })
    model = 0.65 * F.col("coverage") + 0.20 * F.col("alignment") + 0.15 * F.col("conviction")
    reasons = flags(QUALITY=quality < 1, COVERAGE=F.col("coverage") < 0.6, CONFIDENCE=F.col("data_confidence") < least_confidence)
    df = df.withColumns({"confidence": F.sqrt(F.col("data_confidence") * model), "reasons": reasons})
    label = F.lit("STRONG_BEAR")
    for at, name in reversed(LABELS):
        label = F.when(F.col("bull_score") >= at, F.lit(name)).otherwise(label)
    return df.withColumn("blocked", F.size("reasons") > 0).withColumn("label", F.when(F.col("blocked"), F.lit("DEGRADED")).otherwise(label)).drop("_active", "_mean")


def key_drivers(scored: DataFrame, names: Sequence[str], n: int = 4) -> Column:
    """The n covered components furthest from 50, declaration order on ties."""
    parts = F.array(*(F.struct((-F.round(F.abs(F.col(f"score_{k}") - 50), 9)).alias("far"), F.lit(i).alias("i"), F.lit(k).alias("name"), F.col(f"coverage_{k}").alias("c")) for i, k in enumerate(names)))
    return F.transform(F.slice(F.array_sort(F.filter(parts, lambda x: x["c"] > 0)), 1, n), lambda x: x["name"])


def nearest_prototypes(df: DataFrame, prototypes: Mapping[str, Mapping[str, float]], scales: Mapping[str, float]) -> Column:
    """Prototype names by ascending scaled distance (to nine digits; ties by order) over the features that are known."""
    out = []
    for i, (name, at) in enumerate(prototypes.items()):
        gaps = [F.abs(F.col(f) - v) / scales[f] for f, v in at.items()]
        known = sum((F.when(g.isNotNull(), 1).otherwise(0) for g in gaps), F.lit(0))
        total = sum((F.coalesce(g, F.lit(0.0)) for g in gaps), F.lit(0.0))
        out.append(F.struct(F.round(F.when(known > 0, total / known).otherwise(F.lit(1e9)), 9).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    return F.transform(F.array_sort(F.array(*out)), lambda x: x["name"])


def alerts(df: DataFrame, key: str, distribution_risk: Column) -> DataFrame:
    """One row per alert: key, rule, severity."""
    rules = (
        ("strong_bull", "high", ~F.col("blocked") & (F.col("bull_score") >= 72) & (F.col("conviction") >= 0.35)),
        ("distribution_risk", "high", ~F.col("blocked") & (distribution_risk >= 75)),
        ("blocked", "critical", F.col("blocked")),
    )
    fired = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules)))
    return df.select(key, F.inline(fired))


def ladder(rungs: Sequence[tuple[str, Column]], default: str = "NO_DATA") -> Column:
    """The first name whose condition is true; a condition that is null (a missing signal) is passed over."""
    out = F.lit(default)
    for name, c in reversed(rungs):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


#: Fixed values: (signal, feature, scale) of the canonical policy, the signals it requires, the least share known, and thresholds.
SIGNALS = (
    ("trend", "trailing_return_30d", 0.30), ("relative_strength", "asset_btc_return_30d", 0.25), ("spot_flow", "spot_flow_imbalance", 1.0), ("leverage", "leverage_expansion", 1.0),
    ("crowding", "long_crowding", 1.0), ("deleveraging", "deleveraging", 1.0), ("breakout", "breakout_score", 1.0), ("distribution", "distribution_score", 1.0),
    ("volatility", "realized_volatility_z", 2.0), ("drawdown_stress", "drawdown_stress", 1.0), ("liquidity", "liquidity_risk_on", 1.0),
)
REQUIRED, LEAST_COVERAGE = ("trend", "relative_strength"), 0.70
THRESHOLDS = {
    "breakout": 0.65, "failed_breakout": -0.55, "deleveraging": 0.60, "distribution": 0.60, "crowding": 0.60, "expansion_trend": 0.35, "spot_flow": 0.40, "leverage": 0.45,
    "capitulation_trend": -0.65, "capitulation_volatility": 0.55, "capitulation_drawdown": 0.55, "recovery_trend": 0.15, "recovery_drawdown": 0.30, "risk_on_liquidity": 0.35,
    "accumulation_abs_trend_max": 0.25, "accumulation_spot_flow": 0.10,
}


def signals(features: DataFrame, specs: Sequence[tuple[str, str, float]] = SIGNALS, center: float = 0.0, direction: float = 1.0) -> DataFrame:
    """features with a column for each signal: direction * (feature - center) / scale, held within [-1, 1]; a feature
    that is null or no column is unknown."""
    have = lambda n: finite(F.col(n).cast("double")) if n in features.columns else F.lit(None).cast("double")
    return features.withColumns({s: clip(direction * (have(f) - center) / scale, -1.0, 1.0) for s, f, scale in specs})


def _rungs(t: Mapping[str, float]) -> list[tuple[str, Column]]:
    s = F.col
    return [
        ("FAILED_BREAKOUT", s("breakout") <= t["failed_breakout"]),
        ("DELEVERAGING", s("deleveraging") >= t["deleveraging"]),
        ("CAPITULATION", (s("trend") <= t["capitulation_trend"]) & (s("volatility") >= t["capitulation_volatility"]) & (s("drawdown_stress") >= t["capitulation_drawdown"])),
        ("LONG_CROWDING", (s("crowding") >= t["crowding"]) & (s("leverage") >= t["leverage"])),
        ("DISTRIBUTION", s("distribution") >= t["distribution"]),
        ("BREAKOUT", (s("breakout") >= t["breakout"]) & (s("trend") >= t["expansion_trend"])),
        ("SPOT_LED_EXPANSION", (s("trend") >= t["expansion_trend"]) & (s("spot_flow") >= t["spot_flow"]) & (s("leverage") < t["leverage"])),
        ("LEVERAGED_EXPANSION", (s("trend") >= t["expansion_trend"]) & (s("leverage") >= t["leverage"]) & (s("crowding") < t["crowding"])),
        ("RECOVERY", (s("trend") >= t["recovery_trend"]) & (s("drawdown_stress") >= t["recovery_drawdown"])),
        ("RISK_ON", (s("liquidity") >= t["risk_on_liquidity"]) & (s("trend") >= t["recovery_trend"]) & (s("relative_strength") >= 0)),
        ("ACCUMULATION", (F.abs(s("trend")) <= t["accumulation_abs_trend_max"]) & (s("spot_flow") >= t["accumulation_spot_flow"]) & (s("leverage") < t["leverage"]) & (s("distribution") < t["distribution"])),
    ]


def classified(signalled: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS, required: Sequence[str] = REQUIRED, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Adds regime, confidence, signal_coverage and reasons to rows with a column for each signal of SIGNALS.

    NO_DATA with a reason where a required signal is missing, where fewer than least_coverage of the signals are known, or
    where no rung holds; a rung with a missing signal is passed over. Confidence: the coverage, halved where no signal is
    strong; 0 for NO_DATA."""
    names = [s for s, _, _ in SIGNALS]
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    strongest = F.coalesce(F.greatest(*(F.abs(F.col(n)) for n in names)), F.lit(0.0))
    missing = F.array_sort(F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in required))))
    df = signalled.withColumn("signal_coverage", known / F.lit(float(len(names))))
    low = F.col("signal_coverage") < least_coverage
    found = ladder(_rungs(thresholds))
    df = df.withColumn("regime", F.when((F.size(missing) > 0) | low, "NO_DATA").otherwise(found))
    why = F.when(F.size(missing) > 0, F.concat(F.lit("MISSING_REQUIRED_SIGNALS:"), F.array_join(missing, ","))).when(low, "INSUFFICIENT_SIGNAL_COVERAGE").when(F.col("regime") == "NO_DATA", "NO_RULE_WITH_SUFFICIENT_SEPARATION")
    sure = F.when(F.col("regime") == "NO_DATA", 0.0).otherwise(F.least(F.lit(1.0), F.col("signal_coverage") * (0.5 + 0.5 * strongest)))
    return df.withColumns({"confidence": sure, "reasons": F.array_compact(F.array(why))})


#: Bounds of book support and taker flow, of imbalance for a state, and the confidence of each label.
DEPTH, TAKER, IMBALANCE, WIDE_CAP = 0.25, 0.20, 0.35, 0.50
FLOW_CONFIDENCE = {"NO_DATA": 0.0, "SPOT_LED_DEMAND": 0.72, "SELL_PRESSURE": 0.72, "BID_ABSORPTION": 0.68, "LEVERAGED_DEMAND": 0.60, "LONG_CROWDING": 0.55, "MIXED": 0.45}
STATE_CONFIDENCE = {"NO_DATA": 0.0, "ABSORPTION": 0.62, "DISTRIBUTION": 0.62, "LONG_CROWDING": 0.58, "BALANCED": 0.45}


def _sure(label: Column, by: Mapping[str, float], wide_basis: Column) -> Column:
    sure = F.lit(None).cast("double")
    for name, value in by.items():
        sure = F.when(label == name, value).otherwise(sure)
    return F.when(wide_basis, F.least(sure, F.lit(WIDE_CAP))).otherwise(sure)


def flow_regime(depth: Column, taker: Column, positive_funding: Column, wide_basis: Column) -> tuple[Column, Column]:
    """(label, confidence) of book support and taker flow; NO_DATA without either; unknown funding is not positive."""
    crowded = F.coalesce(positive_funding, F.lit(False))
    demand, absorbed = (depth >= DEPTH) & (taker >= TAKER), (depth >= DEPTH) & (taker <= -TAKER)
    label = ladder([
        ("NO_DATA", depth.isNull() | taker.isNull()), ("LEVERAGED_DEMAND", demand & crowded), ("SPOT_LED_DEMAND", demand),
        ("LONG_CROWDING", absorbed & crowded), ("BID_ABSORPTION", absorbed), ("SELL_PRESSURE", (depth <= -DEPTH) & (taker <= -TAKER)),
    ], "MIXED")
    return label, _sure(label, FLOW_CONFIDENCE, wide_basis)


def market_state(imbalance: Column, micro_above: Column, positive_funding: Column, wide_basis: Column) -> tuple[Column, Column]:
    """(label, confidence) of book imbalance and where the microprice stands (micro_above: microprice minus mid); NO_DATA
    without either."""
    bid = (imbalance >= IMBALANCE) & (micro_above > 0)
    label = ladder([
        ("NO_DATA", imbalance.isNull() | micro_above.isNull()), ("LONG_CROWDING", bid & F.coalesce(positive_funding, F.lit(False))),
        ("ABSORPTION", bid), ("DISTRIBUTION", (imbalance <= -IMBALANCE) & (micro_above < 0)),
    ], "BALANCED")
    return label, _sure(label, STATE_CONFIDENCE, wide_basis)
