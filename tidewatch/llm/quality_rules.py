"""Quality rules as a learned decision list, DataFrame functions only.

`statistics` gives each text's counts; `learn` grows threshold conjunctions by sequential covering from labelled
statistics and prunes them; `rules_column` emits the list as one ordered Spark conditional.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE

#: Bound of the labelled sample that a list is learned from: the rows with the smallest hashes of their ids.
SAMPLE = 8_000
#: Statistics that rules may test, each a share or a mean so that long and short texts compare.
FEATURES = ("chars_per_word", "symbol_share", "shout_share", "bang_share", "dup_line_share", "repeat_share", "stutter_share", "upper_share")
#: Thresholds tried for each statistic; quantiles of the sample are added.
GRID = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)


@dataclass(frozen=True)
class Test:
    """A threshold on one statistic: `feature > at` or `feature <= at`."""

    feature: str
    above: bool
    at: float

    def column(self) -> Column:
        return F.col(self.feature) > self.at if self.above else F.col(self.feature) <= self.at

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.at) == self.above


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests; rows that meet it are rejected."""

    tests: tuple[Test, ...]

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once: projections don't merge across the generator, so a lambda that reads one
    doesn't compute it for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


#: The counts of the contract, and what each feature is a share of: (count, whole).
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = {
    "chars_per_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "shout_share": ("n_shouts", "n_words"), "bang_share": ("n_bangs", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "stutter_share": ("n_stutters", "n_words"), "upper_share": ("n_upper", "word_chars"),
}


def statistics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), features: Sequence[str] = FEATURES) -> DataFrame:
    """`keep`, the counts of each whole text (null: none) and `features`, without a shuffle. A column of `keep` that has
    the name of a count or a feature gives way to it.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are as in the contract; other counts are taken only for
    features that need them. A word in a five-word window that occurs twice or more counts once, however many windows
    hold it: equal windows stand side by side once (hash, place) pairs are sorted, and the places found are unions of
    runs of five. Texts whose windows are all different aren't sorted.
    """
    need = {c for f in features for c in SHARES[f]}
    text = F.coalesce(F.col(text_col), F.lit(""))
    ahead = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    behind = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    count = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.when(x, 1).otherwise(0)).cast("long")
    words = _step(docs.select(F.struct(*keep).alias("_kept"), text.alias("_t")), _w=F.array_remove(F.split("_t", f"{SPACE}+"), ""), _l=F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    patterns = {"n_bangs": "!", "n_upper": r"\p{Lu}", "n_shouts": r"(?<!\p{L})\p{Lu}{2}"}
    hashed = _step(
        words,
        n_words=F.size("_w").cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_symbols=F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        n_lines=F.size("_l").cast("long"),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        _h=F.transform("_w", lambda x: F.xxhash64(x)),
        **{c: F.regexp_count("_t", F.lit(p)).cast("long") for c, p in patterns.items() if c in need},
    ).drop("_t", "_w", "_l")
    grams = _step(
        hashed,
        _g=F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2), F.get("_h", i + 3), F.get("_h", i + 4))),
        **{"n_stutters": count(F.zip_with(ahead("_h"), behind("_h"), lambda a, b: a == b))} if "n_stutters" in need else {},
    ).drop("_h")
    twice = F.size(F.array_distinct("_g")) < F.size("_g")
    pairs = _step(grams, _p=F.when(twice, F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_g")
    again = lambda x, i: (i > 0) & F.get("_p", i - 1)["h"].eqNullSafe(x["h"]) | F.get("_p", i + 1)["h"].eqNullSafe(x["h"])
    places = _step(pairs, _q=F.sort_array(F.transform(F.filter("_p", again), lambda x: x["i"]))).drop("_p")
    covered = F.aggregate(
        "_q", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("at")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["at"])).alias("n"), x.alias("at")),
        lambda a: a["n"],
    )
    out = _step(places, n_repeat_words=F.coalesce(covered, F.lit(0).cast("long"))).drop("_q")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    stay = [F.col("_kept")[c].alias(c) for c in keep if c not in COUNTS and c not in features]
    return out.select(*stay, *COUNTS, *(share(*SHARES[f]).alias(f) for f in features))


def base_failed() -> Column:
    """The fixed part of the verdict: under ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _gain(bad: int, good: int, was_bad: int, was_good: int) -> float:
    """Information gain of a narrower rule, weighted by the bad rows it still covers."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(was_bad / (was_bad + was_good)))


def _tests(rows: list[dict]) -> list[Test]:
    out = []
    for f in FEATURES:
        values = sorted(r[f] for r in rows)
        cuts = {values[len(values) * k // 20] for k in range(1, 20)} | set(GRID)
        out += [Test(f, above, round(at, 6)) for at in sorted(cuts) if values[0] <= at < values[-1] for above in (True, False)]
    return list(dict.fromkeys(out))


def learn(rows: list[dict], max_rules: int = 12, max_tests: int = 3, precision: float = 0.97, least: int = 8) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows by gain, prune it on the rest, drop what it covers.

    rows: statistics with `bad` (boolean). A rule enters the list only if, on the pruning rows left and on the growing
    rows left, it covers `least` bad rows and at most 1 - precision good ones; so clean texts stay. No rows, or one
    class only: an empty list, which keeps everything.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    if not any(r["bad"] for r in grow) or all(r["bad"] for r in grow) or not prune:
        return []
    tests, rules = _tests(grow), []
    met = {t: frozenset(i for i, r in enumerate(grow) if t.holds(r)) for t in tests}
    left, is_bad = set(range(len(grow))), {i for i, r in enumerate(grow) if r["bad"]}
    while len(rules) < max_rules:
        chosen, cover = [], set(left)
        while len(chosen) < max_tests:
            bad = len(cover & is_bad)
            if not bad or bad == len(cover):
                break
            gains = {t: _gain(len(c & is_bad), len(c) - len(c & is_bad), bad, len(cover) - bad) for t in tests if (c := cover & met[t])}
            most = max(gains.values(), default=0)
            if most <= 0:
                break
            first = next(t for t in tests if gains.get(t, -math.inf) == most)
            tied = sorted(t.at for t in tests if (t.feature, t.above) == (first.feature, first.above) and gains.get(t, -math.inf) == most)
            best = Test(first.feature, first.above, tied[len(tied) // 2])  # in the middle of the gap between the classes
            chosen.append(best)
            cover &= met[best]
        if not chosen:
            break

        def worth(tests: Sequence[Test]) -> float:
            hit = [r["bad"] for r in prune if Rule(tuple(tests)).holds(r)]
            return (sum(hit) - (len(hit) - sum(hit))) / max(1, len(hit)) if hit else -1.0

        while len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
            chosen.pop()
        rule = Rule(tuple(chosen))
        cover = {i for i in left if rule.holds(grow[i])}
        seen = [r["bad"] for r in prune if rule.holds(r)]
        if len(cover & is_bad) < least or len(cover & is_bad) < precision * len(cover) or sum(seen) < precision * len(seen):
            break
        rules.append(rule)
        left -= cover
        prune = [r for r in prune if not rule.holds(r)]
    return rules


def rules_column(rules: Sequence[Rule]) -> Column:
    """The list as an ordered conditional: the number of the first rule met (from 1), null if none is."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = rule.tests[0].column()
        for t in rule.tests[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Learns from at most `sample` labelled texts (smallest hashes of doc_id, of any type); quality 0 is bad. Null labels
    are left out; without any the list is empty."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = statistics(texts.withColumn("order", F.xxhash64("doc_id")), "text", ("order", "quality")).where(~base_failed()).select("order", "quality", *FEATURES).collect()
    rows = sorted((r.asDict() for r in found), key=lambda r: (r["order"], *(r[f] for f in FEATURES)))
    return learn([r | {"bad": r["quality"] == 0} for r in rows])


def judged(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep`, the counts, the features that the rules test, base_failed, rule (number of the first one met, else null)
    and kept. A column of `keep` that has the name of one of these gives way to it.

    Null, empty and one-word texts fail the base; ties cannot occur, as each row is judged alone; repeated rows get
    equal rows; an empty table gives an empty result; only `keep` and the text are read.
    """
    tested = tuple(f for f in FEATURES if any(t.feature == f for r in rules for t in r.tests))
    keep = [c for c in keep if c not in ("base_failed", "rule", "kept")]
    return statistics(docs, text_col, keep, tested).withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
