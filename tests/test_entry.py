"""Every registered query against its SQL on the smallest tables, for a sample of the plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


#: Queries whose data hold more odd cases in larger tables, such as scores next to 0 and 1.
LARGER = ("calibration_metrics", "skill_gate", "model_registry", "stream_pit_windows")


@pytest.mark.parametrize(("name", "sf"), [*((n, SF) for n in sorted(plans.SQL)), *((n, "/root/testdata/sf0.01") for n in LARGER)])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(plans.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.limit(10**9).fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
