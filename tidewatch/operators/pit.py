"""Point-in-time evidence: what was knowable at T, as-of selection, coverage, gaps, snapshots, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import content_id

def availability_boundary(precision: Column, available_at: Column, available_date: Column) -> Column:
    """When an observation became usable: its instant; for a date, the next midnight; null when unknown."""
    return F.when(precision.isin("EXACT", "INFERRED"), available_at).when(precision == "DATE_ONLY", F.date_add(available_date, 1).cast("timestamp_ntz"))


def eligibility(boundary: Column, fetched_at: Column, basis: Column, at: Column) -> Column:
    """INELIGIBLE before its boundary; STRICT_REPLAY once fetched; else RECONSTRUCTED_PIT given a basis."""
    return F.when(boundary.isNull() | (boundary > at), "INELIGIBLE").when(fetched_at <= at, "STRICT_REPLAY").when(basis.isNotNull(), "RECONSTRUCTED_PIT").otherwise("INELIGIBLE")


def as_of(observations: DataFrame, times: DataFrame, series: Sequence[str], boundary: str, rank: Sequence[str], at: str = "at") -> DataFrame:
    """For each time and series, the row of the highest rank among those with boundary <= time.

    `rank`: columns, larger is better and null is least; they must break all ties; see `ambiguous` for rows that disagree at
    the top. Columns must be orderable. Rows never meet times: the stated times are one sorted array, in which each row finds
    the first time that it is usable at by halving; the best of each such time and series is one aggregate of rows that
    hold each column once, and a running best over a series' times holds until the next one that has a row."""
    kind = times.schema[at].dataType
    stated = F.broadcast(times.select(at).distinct().where(F.col(at).isNotNull()).agg(F.array_sort(F.collect_list(at)).alias("_times")))  # one row: the stated times
    rest = [c for c in observations.columns if c not in rank]
    rows = observations.where(F.col(boundary).isNotNull()).select(*series, F.struct(*rank, *rest).alias("_best"), F.col(boundary).cast(kind).alias("_from"))
    steps = F.sequence(F.floor(F.log2(F.size("_times"))).cast("int"), F.lit(0), F.lit(-1))
    further = lambda low, power: low + F.pow(F.lit(2), power).cast("int")
    earlier = F.aggregate(steps, F.lit(0), lambda low, power: F.when(F.get("_times", further(low, power) - 1) < F.col("_from"), further(low, power)).otherwise(low))  # how many times are before
    placed = rows.crossJoin(stated).where(F.size("_times") > 0).select(*series, "_best", earlier.alias("_slot"), F.size("_times").alias("_n")).where(F.col("_slot") < F.col("_n"))
    best = placed.groupBy(*series, "_slot").agg(F.max("_best").alias("_best"))
    own = Window.partitionBy(*series).orderBy("_slot")  # a row a time at most
    running = best.crossJoin(stated).select(F.max("_best").over(own).alias("_best"), "_slot", (F.coalesce(F.lead("_slot").over(own), F.size("_times")) - 1).alias("_to"), "_times")
    held = running.select("_best", F.explode(F.slice("_times", F.col("_slot") + 1, F.col("_to") - F.col("_slot") + 1)).alias(at))
    return held.select(*(F.col("_best")[c].alias(c) for c in observations.columns), at)


def as_of_latest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """left with the latest right value at or before its time: one union and one window, never pairs.

    Without `by` the series is cut into day buckets, each given the last value before it, so no task holds all rows."""
    kinds = left.select(*by, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_o"))
    other = right.select(*by, F.col(right_time).alias("_t"), F.lit(None).cast(kinds.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_o"))
    both = kinds.unionByName(other).withColumn("_day", F.to_date("_t"))
    w = Window.partitionBy(*by, "_day").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    ends = other.groupBy(*by, F.to_date("_t").alias("_day")).agg(F.max_by("_v", "_t").alias("_last"))
    days = both.select(*by, "_day").distinct().join(ends, [*by, "_day"], "left")
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    carried = days.select(*by, "_day", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return within.where("_o = 1").join(carried, [*by, "_day"], "left").select("_row.*", F.coalesce("_in", "_carry").alias(value))


def ambiguous(observations: DataFrame, series: Sequence[str], rank: Sequence[str], digest: str) -> DataFrame:
    """Series whose top-ranked rows disagree: series and the number of distinct digests at the top."""
    top = observations.groupBy(*series).agg(F.max(F.struct(*rank)).alias("_top"))
    same = observations.join(top, list(series)).where(F.struct(*rank) == F.col("_top"))
    return same.groupBy(*series).agg(F.count_distinct(digest).alias("n")).where("n > 1")


def coverage(observations: DataFrame, provider: str, observed: str) -> DataFrame:
    """provider, n, first and last observation."""
    return observations.groupBy(provider).agg(F.count("*").alias("n"), F.min(observed).alias("first_at"), F.max(observed).alias("last_at"))


def gaps(observations: DataFrame, series: Sequence[str], observed: str, seconds: float) -> DataFrame:
    """series, gap_start, gap_end, gap_seconds where consecutive distinct times are further apart than `seconds`.

    A series is cut into days: the first time of a day follows the last one of the day before that has any, which is a
    window over days, so no task holds the rows of a series. Only first times go to that window."""
    times = observations.select(*series, observed).distinct().withColumn("_day", F.to_date(observed))
    within = Window.partitionBy(*series, "_day")
    across = Window.partitionBy(*series).orderBy("_day")  # a row a day
    marked = times.withColumns({"_prior": F.lag(observed).over(within.orderBy(observed)), "_end": F.max(observed).over(within)})
    later = marked.where("_prior is not null").select(*series, observed, F.col("_prior").alias("gap_start"))
    first = marked.where("_prior is null").select(*series, observed, F.lag("_end").over(across).alias("gap_start"))
    marked = later.union(first)
    secs = (F.unix_micros(F.col(observed).cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))) / 1e6
    return marked.withColumn("gap_seconds", secs).where(F.col("gap_seconds") > seconds).select(*series, "gap_start", F.col(observed).alias("gap_end"), "gap_seconds")


def digest(row: Column) -> tuple[Column, Column]:
    """Two aggregates that tell sets of rows apart whatever their order, and count repeats: sums of two hashes of `row`, as
    text. A hash is summed in two signed halves, whole numbers up to 2^32 rows, and put together once a group."""

    def wide(h: Column) -> Column:
        low = h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)
        high = F.shiftright(h, 32) + F.shiftright(h, 31).bitwiseAND(F.lit(1))
        parts = F.sum(high).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(low).cast("decimal(20,0)")
        return parts.cast("decimal(38,0)").cast("string")

    return wide(F.xxhash64(row)), wide(F.xxhash64(F.lit("second"), row))


def snapshots(chosen: DataFrame, at: str, observation_id: str, provider: str, kind: str, payload: Sequence[str] = ()) -> DataFrame:
    """One row per time: number of observations, providers, RECONSTRUCTED_PIT if any is, and snapshot_id.

    The id is a content id of the time, the number, and digests of every observation's id and `payload`, so a snapshot of
    any size is one aggregate row and one other member changes it."""
    one, two = digest(F.struct(observation_id, *payload))
    out = chosen.groupBy(at).agg(
        F.count("*").alias("n"), F.min(observation_id).alias("first_id"), F.max(observation_id).alias("last_id"),
        F.array_sort(F.collect_set(provider)).alias("providers"), one.alias("_one"), two.alias("_two"),
        F.when(F.count_if(F.col(kind) == "RECONSTRUCTED_PIT") > 0, "RECONSTRUCTED_PIT").otherwise("STRICT_REPLAY").alias("class"),
    )
    return out.withColumn("snapshot_id", content_id("snapshot", F.col(at), F.col("n"), F.col("_one"), F.col("_two"))).drop("_one", "_two")


def changed_snapshots(stated: DataFrame, found: DataFrame, at: str = "at") -> DataFrame:
    """Times whose snapshot is not the stated one: at, stated, found (null where there is none)."""
    both = stated.select(at, F.col("snapshot_id").alias("stated")).join(found.select(at, F.col("snapshot_id").alias("found")), at, "full_outer")
    return both.where(~F.col("stated").eqNullSafe(F.col("found")))


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows that break a rule, with the names of those that they break. A rule that is null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def strict(df: DataFrame, broken: DataFrame, message: str) -> DataFrame:
    """df, but reading it fails if `broken` has a row."""
    bad = broken.agg(F.count("*").alias("_bad"))
    return df.crossJoin(F.broadcast(bad)).where(F.when(F.col("_bad") == 0, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))).drop("_bad")  # one row
