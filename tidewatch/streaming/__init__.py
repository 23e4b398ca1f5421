"""Structured Streaming twins of the batch operators, and stateful ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.scratch import fresh_path, kept, put


def tumbling(events: DataFrame, time: str, length: str, keys: Sequence[str], value: Column, watermark: str = "1 hour") -> DataFrame:
    """keys, window_start, n, total; the same for a table and for a stream, where late rows are dropped by watermark."""
    source = events.withWatermark(time, watermark) if events.isStreaming else events
    out = source.groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("window.start").alias("window_start"), "n", "total")


def known_at(events: DataFrame, at: Column, available: str = "available_at", fetched: str = "fetched_at") -> DataFrame:
    """Rows that could be used at a time: a watermark only bounds state, these clocks decide."""
    return events.where((F.col(available) <= at) & (F.col(fetched) <= at))


def _keep(times: list[pd.Timestamp], last: pd.Timestamp | None, seconds: float) -> tuple[list[int], pd.Timestamp | None]:
    kept = []
    for i, t in enumerate(times):
        if last is None or (t - last).total_seconds() >= seconds:
            kept.append(i)
            last = t
    return kept, last


def _following(alerts: DataFrame, key: str, us: int) -> DataFrame:
    """key, t, to: the first alert of a key at least `us` microseconds after each one (null if there is none). Alerts are
    distinct (key, t). Time is cut into slices of `us`: a row meets those of one slice, and a slice's first alert is the
    answer where the slice before has none late enough."""
    from pyspark.sql import Window

    at = alerts.select(key, F.col("t").alias("_at"), F.lit(None).cast("bigint").alias("t"))
    ask = alerts.select(key, (F.col("t") + us).alias("_at"), "t")
    both = at.union(ask).withColumn("_slice", F.floor(F.col("_at") / us))
    own = F.when(F.col("t").isNull(), F.col("_at"))
    later = Window.partitionBy(key, "_slice").orderBy(F.desc("_at"), F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # times from here on
    within = both.withColumn("_in", F.min(own).over(later)).where("t is not null")
    firsts = both.groupBy(key, "_slice").agg(F.min(own).alias("_first"))  # a row a slice
    after = Window.partitionBy(key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(key, "_slice", F.min("_first").over(after).alias("_next"))
    return within.join(carried, [key, "_slice"]).select(key, "t", F.coalesce("_in", "_next").alias("to"))


def cooled(alerts: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """Alerts whose key has not fired within `seconds`; the timer restarts only when one is let through. Of equal times of a
    key one is let through, unless seconds is 0; alerts without a key or time are left out.

    Each alert points to the first one at least `seconds` later, and those that can be reached from a key's first are let
    through: pointers are doubled and what is reached is joined with them, round by round, so a key that never falls silent
    takes as many rounds as its number of alerts let through has binary digits, and no task holds a key."""
    us, kind = int(seconds * 1e6), alerts.schema[time].dataType
    rows = alerts.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    found = lambda df: df.select(key, F.timestamp_micros("t").cast(kind).alias(time))
    if us <= 0:
        return found(rows)
    rows = kept(rows.distinct(), "alerts")
    jumps = kept(_following(rows, key, us).where("to is not null"), "jumps")
    reached = kept(rows.groupBy(key).agg(F.min("t").alias("t")), "reached")
    while True:
        further = kept(reached.join(jumps, [key, "t"]).select(key, F.col("to").alias("t")), "further")  # as many again at most
        if not further.limit(1).count():
            return found(reached)
        reached = kept(reached.union(further), "reached")
        two = jumps.select(key, F.col("t").alias("_from"), F.col("to").alias("t"))
        jumps = kept(two.join(jumps, [key, "t"]).select(key, F.col("_from").alias("t"), "to"), "jumps")


def cooled_stream(alerts: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """The same for a stream: one instant of state a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(time)
        kept, last = _keep(pdf[time].tolist(), last, seconds)
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pdf.iloc[kept][[key, time]]

    schema = alerts.select(key, time).schema
    return alerts.select(key, time).groupBy(key).applyInPandasWithState(run, schema, "last timestamp", "append", GroupStateTimeout.NoTimeout)


def as_stream(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder, as a stream of its files."""
    return rows.sparkSession.readStream.schema(rows.schema).parquet(put(rows, name))


def drained(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """What the stream has to say of all that is there now, as a table at `path` (a fresh one in the shared folder), with the
    RocksDB state store, which keeps state on the executors' disks and its changes in the checkpoint. Running again with
    the same path goes on where the last run stopped."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
