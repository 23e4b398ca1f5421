"""The paged source: every row once over stops, crashes and restarts; loops, empty pages, limits, wrong receipts."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import commits
from tidewatch.sources import paged

ROWS = "page bigint, v bigint"


def landed(spark, path, chain, **over):
    """chain: (cursor, following, values) each."""
    made = [(json.dumps({"at": c}), None if f is None else json.dumps({"at": f}), json.dumps([{"v": v, **over} for v in values]), "d", "p", "s", f"fetch-{c}", "2026-01-01T00:00:00Z") for c, f, values in chain]
    return paged.land(spark.createDataFrame(made, paged.LANDED), path)


def run(spark, tmp_path, **limits):
    parse = lambda items: items.select("page", F.get_json_object("item", "$.v").cast("bigint").alias("v"))
    return paged.backfill(spark, str(tmp_path / "landed"), str(tmp_path / "table"), {"at": 0}, parse, **limits)


def there(spark, tmp_path):
    return sorted(map(tuple, commits.committed(spark, str(tmp_path / "table"), ROWS).collect()))


def test_every_row_once_over_stops_and_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "landed")
    chain = [(k, k + 1 if k < 19 else None, range(10 * k, 10 * k + k % 4)) for k in range(20)]
    want = [(c, v) for c, _, values in chain for v in values]
    assert landed(spark, path, chain[5:9]) == 4  # pages that came early wait
    assert landed(spark, path, chain[:3]) == 3
    assert run(spark, tmp_path)["next"] == '{"at":3}' and there(spark, tmp_path) == want[:3]
    landed(spark, path, chain[3:5])
    own = commits._rename
    monkeypatch.setattr(commits, "_rename", lambda *a: (_ for _ in ()).throw(OSError("power cut")))
    with pytest.raises(Exception, match="power cut"):
        run(spark, tmp_path)
    monkeypatch.setattr(commits, "_rename", own)
    assert there(spark, tmp_path) == want[:3]
    assert run(spark, tmp_path) == {"pages": 9, "rows": sum(c % 4 for c in range(9)), "completed": False, "next": '{"at":9}', "problem": None}
    landed(spark, path, chain[9:])
    assert run(spark, tmp_path)["completed"] and there(spark, tmp_path) == sorted(want)
    assert run(spark, tmp_path)["completed"] and there(spark, tmp_path) == sorted(want)


@pytest.mark.parametrize(("chain", "limits", "problem", "good"), [
    ([(0, 1, [1]), (1, 2, [2]), (2, 1, [3])], {}, "LOOP", [(0, 1), (1, 2)]), ([(0, 0, [1])], {}, "LOOP", []),
    ([(0, 1, [1]), (1, 2, []), (2, 3, []), (3, None, [4])], {"max_empty": 1}, "EMPTY", [(0, 1)]),
    ([(0, 1, [1]), (1, 2, [2]), (2, None, [3])], {"max_pages": 2}, "PAGES", [(0, 1), (1, 2)]),
])
def test_a_problem_ends_a_run_after_the_good_pages(spark, tmp_path, chain, limits, problem, good):
    landed(spark, str(tmp_path / "landed"), chain)
    with pytest.raises(paged.BackfillError, match=problem):
        run(spark, tmp_path, **limits)
    assert there(spark, tmp_path) == good


def test_wrong_payloads_and_receipts(spark, tmp_path):
    path = tmp_path / "landed"
    landed(spark, str(path), [(0, None, [1])], provider="other")
    with pytest.raises(Exception, match="not of the page's receipt"):
        run(spark, tmp_path)
    landed(spark, str(path), [(0, None, [1])], provider="p")
    (body,) = path.glob("*.json")
    body.write_text("[]")
    with pytest.raises(Exception, match="not the one that its head names"):
        run(spark, tmp_path)
    (head,) = path.glob("*.head")
    head.write_text(json.dumps(json.loads(head.read_text()) | {"completed": False}))
    assert paged.progress(str(path), {"at": 0})["problem"] == "INVALID"


def test_nothing_landed_names_and_limits(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    assert run(spark, tmp_path) == {"pages": 0, "rows": 0, "completed": False, "next": '{"at":0}', "problem": None}
    one = paged.job_key("p", "d", "1", "2026-01-01", "2026-02-01", 60)
    assert one == paged.job_key("p", "d", "1", "2026-01-01", "2026-02-01", 60) != paged.job_key("p", "d", "2", "2026-01-01", "2026-02-01", 60)
    assert paged.canonical('{"b": 1, "a": "ä"}') == '{"a":"ä","b":1}'
    for wrong in ({"max_pages": 0}, {"max_empty": -1}):
        with pytest.raises(ValueError, match="max_"):
            paged.pages(spark, str(tmp_path), {"at": 0}, **wrong)
    with pytest.raises(ValueError, match="cursor"):
        paged.canonical("{}")
