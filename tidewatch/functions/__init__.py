"""Scalar functions: finite values, clamps, scores, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: where b is 0, an infinity by the sign of a, or NaN if a is 0 too."""
    zero = b == 0
    return F.when(zero & (a > 0), F.lit(float("inf"))).when(zero & (a < 0), F.lit(float("-inf"))).when(zero & (a == 0), F.lit(float("nan"))).otherwise(F.try_divide(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    """x held between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def scale(x: Column, width: float, center: float = 0.0, sign: float = 1.0) -> Column:
    """50 at the center, 100 and 0 one width above and below (for a positive sign)."""
    return clip(50 + 50 * (sign * x - center) / width, 0.0, 100.0)


def sigmoid(x: Column) -> Column:
    """Logistic function of x held within 35 of 0."""
    return 1 / (1 + F.exp(-clip(x, -35.0, 35.0)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    """Log odds of p held eps away from 0 and 1."""
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def flags(**when: Column) -> Column:
    """Array of the names whose conditions hold, in the given order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in when.items())))


def content_id(kind: str, *parts: Column) -> Column:
    """`kind:sha256:digest` of the parts' text, nulls marked."""
    text = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))
    return F.concat(F.lit(f"{kind}:sha256:"), F.sha2(text, 256))


def is_content_id(x: Column, kind: str) -> Column:
    """Whether x is an identifier of that kind."""
    return x.rlike(f"^{kind}:sha256:[0-9a-f]{{64}}$")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def horizon_end(at: Column, horizon: str) -> Column:
    """at plus one of 1h, 4h, 1d, 1w, 1mo, 3mo, 1y; calendar steps clamp to the month's end."""
    step = {"1h": "INTERVAL 1 HOUR", "4h": "INTERVAL 4 HOUR", "1d": "INTERVAL 1 DAY", "1w": "INTERVAL 7 DAY", "1mo": "INTERVAL 1 MONTH", "3mo": "INTERVAL 3 MONTH", "1y": "INTERVAL 1 YEAR"}[horizon]
    return at + F.expr(step)


def flat_features(families: Column) -> Column:
    """A map of families of features as one map `family.name` -> value, of the values that are known and finite."""
    pairs = F.flatten(F.transform(F.map_entries(families), lambda f: F.transform(F.map_entries(f["value"]), lambda x: F.struct(F.concat_ws(".", f["key"], x["key"]).alias("key"), x["value"].alias("value")))))
    return F.map_from_entries(F.array_sort(F.filter(pairs, lambda x: finite(x["value"]).isNotNull())))


def feature_at(families: Column, key: str) -> Column:
    """The value of `family.name`, null where it isn't there, unknown or not finite."""
    family, _, name = key.partition(".")
    if not name:
        raise ValueError("feature keys are family.name")
    return finite(F.element_at(F.element_at(families, family), name))


#: How names of what happened afterwards begin; they are no features.
LOOK_AHEAD = ("future_", "label_", "target_", "touch_", "outcome_", "mfe", "mae")


def family_problems(families: Column) -> Column:
    """What is wrong with a map of families: EMPTY, EMPTY_FAMILY, UNNAMED (a blank or spaced name), LOOK_AHEAD (a name of what
    happened afterwards), NOT_FINITE."""
    later = lambda k: F.lower(F.trim(k)).rlike("^(" + "|".join(LOOK_AHEAD) + ")")
    entries = F.map_entries(families)
    blank = lambda k: ~F.coalesce(k.rlike(r"^[A-Za-z0-9_.:/-]+$"), F.lit(False))
    return flags(
        EMPTY=F.coalesce(F.size(families) < 1, F.lit(True)),
        EMPTY_FAMILY=F.exists(entries, lambda f: F.coalesce(F.size(f["value"]) < 1, F.lit(True))),
        UNNAMED=F.exists(entries, lambda f: blank(f["key"]) | F.exists(F.map_keys(f["value"]), blank)),
        LOOK_AHEAD=F.exists(entries, lambda f: F.exists(F.map_keys(f["value"]), later)),
        NOT_FINITE=F.exists(entries, lambda f: F.exists(F.map_values(f["value"]), lambda x: x.isNotNull() & finite(x).isNull())),
    )


def is_safe_segment(x: Column) -> Column:
    """Whether x can be a part of a path: letters, digits, underscore, dot, equals sign and dash."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9_.=-]+$"), F.lit(False))


def asset_name(x: Column) -> Column:
    """Upper case without dashes and underscores; null where nothing is left."""
    return F.nullif(F.upper(F.translate(x, "_-", "")), F.lit(""))


def canonical_json(x: Column) -> Column:
    """A map's JSON with its keys in order, so that equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x))))
