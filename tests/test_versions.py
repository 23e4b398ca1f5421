"""Trees of digests against plain comparisons, walks that read changed branches only, and records of versions."""

import datetime as dt
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import pit, versions
from tidewatch.plans import queries

SF = "/root/testdata/sf0.001"
ROWS = "part string, k bigint, v string"


def made(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def compared(spark, old, new):
    trees = [versions.tree(made(spark, rows), ["part"], ["k"]) for rows in (old, new)]
    changes = versions.changed_nodes(*trees)
    return trees, changes, sorted(((r.part, r.k, r.change) for r in versions.changed_rows(made(spark, old), made(spark, new), changes, ["part"], ["k"]).collect()), key=str)


def plain(old, new):
    """Rows of a key as a sorted list, on both sides."""
    both = {}
    for side, rows in enumerate((old, new)):
        for p, k, v in rows:
            both.setdefault((p, k), ([], []))[side].append(str(v))
    said = lambda a, b: "ADDED" if not a else "GONE" if not b else "CHANGED"
    return sorted(((*key, said(a, b)) for key, (a, b) in both.items() if sorted(a) != sorted(b)), key=str)


def test_walk_equals_a_plain_comparison(spark):
    rnd = random.Random(5)
    old = [(f"p{i % 9}", i // 3, f"v{i}") for i in range(900)] + [(None, None, None), ("p1", None, "x"), ("", 1, None), ("a/b", 2, "y"), ("a", 2, "b/y")]
    new = [r for r in old if rnd.random() > 0.01 and r[0] != "p7"] + [("p1", 4, "again"), ("p1", 4, "again"), ("fresh", 1, "v"), ("a", 2, None)]
    new = [(p, k, f"{v}!" if k and k % 97 == 0 else v) for p, k, v in new]
    rnd.shuffle(new)
    (a, b), changes, rows = compared(spark, old, new)
    assert rows == plain(old, new) and len(rows) > 50
    parts = {r.part: (r.change, r.n_old, r.n_new) for r in versions.changed_partitions(changes, ["part"], "part string").collect()}
    assert parts["p7"] == ("GONE", 100, 0) and parts["fresh"] == ("ADDED", 0, 1) and None not in parts
    for t, rows in ((a, old), (b, new)):
        sums = {r.level: (r.n, r.nodes) for r in t.groupBy("level").agg(F.sum("n").alias("n"), F.count("*").alias("nodes")).collect()}
        assert {n for n, _ in sums.values()} == {len(rows)} and sums[0][1] == 1 and len(sums) == versions.TOP + versions.DEPTH + 2
        children = t.where("level > 0").select("level", "parent").join(t.select((F.col("level") + 1).alias("level"), F.col("node").alias("parent")), ["level", "parent"], "left_anti")
        assert children.count() == 0


def test_equal_versions_in_any_order_and_one_changed_row(spark):
    old = [("p", k, f"v{k}") for k in range(300)] + [("q", 1, "x")]
    _, changes, rows = compared(spark, old, list(reversed(old)))
    assert changes.count() == 0 and rows == []
    _, changes, rows = compared(spark, old, [(p, k, "other" if k == 7 else v) for p, k, v in old])
    assert rows == [("p", 7, "CHANGED")]
    assert sorted(r.level for r in changes.collect()) == list(range(versions.TOP + versions.DEPTH + 2))  # one branch
    _, changes, rows = compared(spark, old, [*old, old[3]])
    assert rows == [("p", 3, "CHANGED")]  # a repeat counts


def test_empty_versions(spark):
    _, changes, rows = compared(spark, [], [])
    assert changes.count() == 0 and rows == []
    _, changes, rows = compared(spark, [], [("p", 1, "v")])
    assert rows == [("p", 1, "ADDED")] and {r.change for r in changes.collect()} == {"ADDED"}
    with pytest.raises(ValueError, match="positive"):
        versions.tree(made(spark, []), ["part"], ["k"], depth=0)


MANIFESTS, PARTITIONS, OBSERVATIONS = "manifest_id string, dataset string, partition_ids array<string>, total_rows bigint", "partition_id string, dataset string, row_count bigint", "observation_id string, class string"


def problems(spark, manifests, partitions, observations, **how):
    make = spark.createDataFrame
    out = versions.version_problems(make(manifests, MANIFESTS), make(partitions, PARTITIONS), make(observations, OBSERVATIONS), **how)
    return sorted(((r.problem, r.what, r.n) for r in out.collect()), key=str)


def test_version_problems(spark):
    seen = [(f"o{i}", "STRICT_REPLAY") for i in range(5)]
    good = [("m", "d", ["a", "b"], 5)], [("a", "d", 2), ("b", "d", 3)], seen
    assert problems(spark, *good) == []
    assert problems(spark, [], [], []) == [("NO_MANIFEST", None, 0), ("NO_OBSERVATION", None, 0), ("NO_PARTITION", None, 0)]
    assert problems(spark, [("m", "d", ["a", "a"], 4), ("m", "d", ["zz"], 0)], [("a", "e", 2), ("a", "e", 2), ("s", "d", 1)], seen) == [
        ("MISSING_PARTITION", "zz", 1), ("OTHER_DATASET", "a", 2), ("REPEATED_MANIFEST", "m", 2), ("REPEATED_PARTITION", "a", 2), ("REPEATED_REFERENCE", "m/a", 2), ("UNREFERENCED_PARTITION", "s", 1),
    ]
    assert problems(spark, [("m", "d", [], 5)], good[1], seen[:4]) == [("MANIFEST_ROWS", "m", 5), ("ROWS", None, 1), ("UNREFERENCED_PARTITION", "a", 2), ("UNREFERENCED_PARTITION", "b", 3)]
    mixed = [*seen[:3], ("o3", "RECONSTRUCTED_PIT"), ("o4", "INELIGIBLE")]
    assert problems(spark, *good[:2], mixed) == [("RECONSTRUCTED", None, 1), ("UNAVAILABLE", None, 1)]
    assert problems(spark, *good[:2], mixed, allow_reconstructed=True) == [("UNAVAILABLE", None, 1)]


STATED = {"dataset_key": "k", "schema_version": "1", "feature_schema_version": "1", "label_schema_version": "1", "created_at": "2026-01-02T00:00:00Z", "cutoff_at": "2026-01-01T00:00:00Z"}


def test_records_and_their_identity(spark):
    rows = made(spark, [("p", k, "v") for k in range(10)])
    seen = spark.createDataFrame([(f"o{i}", "STRICT_REPLAY" if i % 4 else "RECONSTRUCTED_PIT") for i in range(10)], OBSERVATIONS)
    manifests, coverage, gaps = spark.createDataFrame([("m", "d", ["a"], 10)], MANIFESTS), spark.createDataFrame([("p", 10)], "provider string, n bigint"), spark.createDataFrame([], "provider string, gap_start string")
    record = lambda r, **kw: versions.dataset_version(seen, versions.tree(r, ["part"], ["k"]), manifests, coverage, gaps, **{**STATED, **kw})
    one = record(rows)
    row = one.first()
    assert (row.total_rows, row.strict_replay_fraction, row.reconstructed_pit_fraction, row.providers, row.n_gaps) == (10, 0.7, 0.3, 1, 0)
    assert row.dataset_version_id.startswith("dataset-version:sha256:") and record(rows).first() == row
    assert record(rows.where("k <> 3")).first().dataset_version_id != row.dataset_version_id != record(rows, schema_version="2").first().dataset_version_id
    assert versions.reidentified(one).count() == 0
    bad = one.withColumns({"total_rows": F.lit(0).cast("bigint"), "strict_replay_fraction": F.lit(0.9), "created_at": F.lit("2025")})
    assert sorted(r.problem for r in versions.reidentified(bad).collect()) == ["EMPTY", "FRACTIONS", "IDENTITY", "ORDER"]
    for wrong in ({"created_at": "2025-01-01T00:00:00Z"}, {"dataset_key": " "}):
        with pytest.raises(ValueError, match="version states|created_at"):
            record(rows, **wrong)


def test_digests_equal_sums_of_whole_hashes(spark):
    """Halves of hashes put together are the sum of the hashes, whatever their signs."""
    rows = spark.range(5000).withColumn("g", F.col("id") % 7)
    one, two = pit.digest(F.struct("id"))
    plain = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    got = rows.groupBy("g").agg(one.alias("a"), two.alias("b"), plain(F.struct("id")).alias("c"), plain(F.lit("second"), F.struct("id")).alias("d")).collect()
    assert len(got) == 7 and all((r.a, r.b) == (r.c, r.d) for r in got)
    assert "sum(cast(xxhash64" not in rows.agg(one)._jdf.queryExecution().optimizedPlan().toString()  # no row's hash becomes a decimal


def test_rows_are_not_named_before_they_are_aggregated(spark):
    """The name of a leaf is hashed once a leaf, and rows of equal text are one leaf."""
    at = [dt.datetime(2026, 1, 1, 0, 0, 0, us) for us in (1, 2)]
    rows = spark.createDataFrame([(at[i % 2], i, float(i)) for i in range(40)], "at timestamp, k int, x double")
    leaves = versions.tree(rows, ["at"], ["k"], 1, 1).where("level = 3").collect()
    assert sum(r.n for r in leaves) == 40 and len({r.node for r in leaves}) == len(leaves)


def test_as_of_scans_its_rows_once(spark):
    """Rows find their time in an array of the stated ones: no sort, window or second scan of rows that are not aggregated."""
    rows = spark.range(100).select((F.col("id") % 3).alias("s"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("at_row"), F.col("id").alias("v"))
    times = spark.createDataFrame([(dt.datetime(1970, 1, 1) + dt.timedelta(minutes=m),) for m in (0, 1, 50, 200)], "at timestamp_ntz").select("at")
    found = pit.as_of(rows, times, ["s"], "at_row", ["at_row", "v"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1
    got = sorted((r.at.hour * 60 + r.at.minute, r.s, r.v) for r in found.collect())
    assert got == sorted((m, s, max(v for v in range(min(m, 99) + 1) if v % 3 == s)) for m in (0, 1, 50, 200) for s in range(3) if s <= m)


def test_a_root_alone_leaves_no_table(spark, monkeypatch):
    """Where only the root is read, leaves are not written; digests are of children's whole names and digests as text."""
    rows = made(spark, [(f"p{i % 5}", i, f"v{i}") for i in range(200)] + [(None, None, None)])
    nodes = [r.asDict() for r in versions.tree(rows, ["part"], ["k"]).collect()]
    for n in nodes:
        below = sorted((c["node"], c["digest"]) for c in nodes if c["level"] == n["level"] + 1 and c["parent"] == n["node"])
        text = json.dumps([{"node": a, "digest": b} for a, b in below], separators=(",", ":"))
        assert not below or hashlib.sha256(text.encode()).hexdigest() == n["digest"]
    monkeypatch.setattr(versions, "kept", None)
    root = versions.tree(rows, ["part"], ["k"], keep=False).where("level = 0").collect()
    assert [(r.n, r.digest) for r in root] == [(201, next(n["digest"] for n in nodes if n["level"] == 0))]


def test_gaps_read_times_twice_at_most(spark):
    """Only first times of days go to the window of days; no join of days with times."""
    rnd = random.Random(3)
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = [(s, None if rnd.random() < 0.05 else at(rnd.randrange(600))) for s in ("a", "b", None) for _ in range(70)]
    found = pit.gaps(spark.createDataFrame(rows, "s string, at timestamp_ntz"), ["s"], "at", 6 * 3600)
    want = []
    for s in ("a", "b", None):
        times = sorted({t for k, t in rows if k == s and t})
        want += [(s, a, b, (b - a).total_seconds()) for a, b in zip(times, times[1:]) if (b - a).total_seconds() > 6 * 3600]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and len(want) > 30
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_a_record_joins_its_rows_once(spark):
    """What a version's record is made of comes from one table of observations, and its check from the record."""
    assert not [f for f in queries.dataset_version_record(spark, SF).inputFiles() if f.startswith(f"file://{SF}")]
