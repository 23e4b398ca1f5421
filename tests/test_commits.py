"""Commits: a crash between staging and commit, batches that come again, keys, two writers, streams; and cooldowns, gaps and
as-of selection of hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import streaming
from tidewatch.operators import commits, pit

ROWS = "k bigint, v string"
T0 = dt.datetime(2026, 1, 1)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def there(spark, path):
    return sorted(map(tuple, commits.committed(spark, path, ROWS).collect()))


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    path, own = str(tmp_path / "table"), commits._rename
    assert commits.commit(rows(spark, (1, "a"), (2, "b")), path, "b0", {"cursor": "x"})
    monkeypatch.setattr(commits, "_rename", lambda *a: (_ for _ in ()).throw(OSError("power cut")))
    with pytest.raises(OSError, match="power"):
        commits.commit(rows(spark, (3, "c")), path, "b1", {"cursor": "y"})
    assert there(spark, path) == [(1, "a"), (2, "b")] and commits.checkpoint(spark, path) == {"cursor": "x"}
    monkeypatch.setattr(commits, "_rename", own)
    assert commits.commit(rows(spark, (3, "c")), path, "b1", {"cursor": "y"})
    assert not commits.commit(rows(spark, (3, "c")), path, "b1", {"cursor": "y"})  # again, after a lost answer
    assert there(spark, path) == [(1, "a"), (2, "b"), (3, "c")] and commits.checkpoint(spark, path) == {"cursor": "y"}
    assert len(commits.sweep(spark, path)) == 2 and there(spark, path) == [(1, "a"), (2, "b"), (3, "c")] and commits.sweep(spark, path) == []


def test_other_content_is_a_conflict(spark, tmp_path):
    path = str(tmp_path / "table")
    commits.commit(rows(spark, (1, "a"), (1, "a"), (None, None)), path, "b0", key="k")
    assert sorted(map(str, map(tuple, commits.committed(spark, path, ROWS).collect()))) == ["(1, 'a')", "(None, None)"]
    for batch, new in (("b0", (9, "z")), ("b1", (1, "other"))):
        with pytest.raises(commits.ConflictError):
            commits.commit(rows(spark, new), path, batch, key="k")
    with pytest.raises(commits.ConflictError):
        commits.commit(rows(spark, (7, "x"), (7, "y")), path, "b2", key="k")
    assert commits.commit(rows(spark, (1, "a"), (2, "b")), path, "b3", key="k")  # what is there already is left out
    assert sum(k == 1 for k, _ in commits.committed(spark, path, ROWS).collect()) == 1
    assert commits.commit(spark.createDataFrame([], ROWS), path, "b4", {"done": True}) and commits.checkpoint(spark, path) == {"done": True}


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer takes the next number between reading and renaming."""
    path, own, met = str(tmp_path / "table"), commits._rename, []

    def late(spark_, source, target):
        if not met:
            met.append(1)
            commits.commit(rows(spark, (5, "e")), path, "other")
        return own(spark_, source, target)

    monkeypatch.setattr(commits, "_rename", late)
    assert commits.commit(rows(spark, (1, "a")), path, "mine")
    assert there(spark, path) == [(1, "a"), (5, "e")] and sorted(r.version for r in commits.manifests(spark, path).collect()) == [0, 1]


def test_a_stream_that_is_run_again_adds_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    rows(spark, (1, "a"), (2, "b")).write.parquet(source)
    for k in range(2):  # the second run has lost its checkpoint: its batch 0 is the same
        stream = spark.readStream.schema(ROWS).parquet(source)
        stream.writeStream.foreachBatch(commits.sink(path, "s")).option("checkpointLocation", str(tmp_path / f"check{k}")).trigger(availableNow=True).start().awaitTermination(60)
    assert there(spark, path) == [(1, "a"), (2, "b")] and commits.checkpoint(spark, path) == {"batch": 0}


def test_cooldown_of_a_key_that_is_never_silent(spark):
    rng = random.Random(3)
    alerts = [("hot", T0 + dt.timedelta(seconds=s, microseconds=rng.choice([0, 0, 1]))) for s in range(0, 20_000, 7)] + [("odd", T0 + dt.timedelta(seconds=rng.randrange(90_000))) for _ in range(200)] + [("one", T0), ("one", T0), (None, T0)]
    want = set()
    for key in ("hot", "odd", "one"):
        last = None
        for t in sorted(t for k, t in alerts if k == key):
            if last is None or t - last >= dt.timedelta(seconds=100.5):
                want.add((key, t))
                last = t
    df = spark.createDataFrame(alerts, "key string, ts timestamp").repartition(5)
    got = [tuple(r) for r in streaming.cooled(df, "key", "ts", 100.5).collect()]
    assert len(got) == len(want) and set(got) == want
    assert streaming.cooled(df, "key", "ts", 0).count() == len(alerts) - 1 and streaming.cooled(df.limit(0), "key", "ts", 5).count() == 0


def test_gaps_across_days(spark):
    rng = random.Random(5)
    seen = [(s, T0 + dt.timedelta(hours=rng.randrange(400))) for s in ("a", "b", None) for _ in range(60)]
    seen += seen[:9]
    want = []
    for s in ("a", "b", None):
        times = sorted({t for x, t in seen if x == s})
        want += [(s, a, b, (b - a).total_seconds()) for a, b in zip(times, times[1:]) if (b - a).total_seconds() > 3 * 3600]
    got = [tuple(r) for r in pit.gaps(spark.createDataFrame(seen, "s string, at timestamp").repartition(4), ["s"], "at", 3 * 3600).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_as_of_over_many_times(spark):
    """Thousands of times are no literals of a plan, and every one gets its row."""
    rng = random.Random(7)
    rows_ = [(s, T0 + dt.timedelta(minutes=rng.randrange(6000)), k) for s in "ab" for k in range(50)] + [("a", None, 999)]
    times = spark.range(3000).select((F.lit(T0) + F.make_dt_interval(mins=(F.col("id") * 2).cast("int"))).alias("at"))
    out = pit.as_of(spark.createDataFrame(rows_, "s string, b timestamp, k int"), times, ["s"], "b", ["b", "k"])
    got = {(r.s, r.at): r.k for r in out.collect()}
    want = {}
    for s in "ab":
        for i in range(3000):
            at = T0 + dt.timedelta(minutes=2 * i)
            able = [(b, k) for x, b, k in rows_ if x == s and b is not None and b <= at]
            if able:
                want[s, at] = max(able)[1]
    assert got == want and len(out._jdf.queryExecution().toString()) < 200_000
