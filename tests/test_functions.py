"""Families of features, names, canonical texts, data quality and training digests."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import asset_name, canonical_json, family_problems, feature_at, flat_features, is_safe_segment
from tidewatch.operators import regime, research

FAMILIES = "f map<string,map<string,double>>"


def test_families(spark):
    rows = [({"market": {"r": 1.0, "n": None}, "a": {"x": float("nan")}},), ({},), ({"m": {}},), ({"": {"x": 1.0}},), (None,), ({"m": {"Future_return": 1.0}},)]
    df = spark.createDataFrame(rows, FAMILIES)
    got = [tuple(r) for r in df.select(flat_features(F.col("f")), feature_at(F.col("f"), "market.r"), family_problems(F.col("f"))).collect()]
    assert got == [({"market.r": 1.0}, 1.0, ["NOT_FINITE"]), ({}, None, ["EMPTY"]), ({}, None, ["EMPTY_FAMILY"]), ({".x": 1.0}, None, ["UNNAMED"]), (None, None, ["EMPTY"]), ({"m.Future_return": 1.0}, None, ["LOOK_AHEAD"])]
    with pytest.raises(ValueError, match="family.name"):
        feature_at(F.col("f"), "market")


def test_names_and_canonical_text(spark):
    row = spark.range(1).select(
        *(asset_name(F.lit(x)).alias(f"a{k}") for k, x in enumerate(("abc-usd", "b_t_c", "-", None))), *(is_safe_segment(F.lit(x)).alias(f"s{k}") for k, x in enumerate(("a.b-1", "../x", "", None))),
        canonical_json(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("one"), canonical_json(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).alias("two"),
    ).first()
    assert tuple(row) == ("ABCUSD", "BTC", None, None, True, False, False, False, '{"a":1,"b":2}', '{"a":1,"b":2}')


def test_data_quality(spark):
    df = spark.createDataFrame([(0.5, 2.0), (None, None)], "provider_agreement double, freshness_score double")
    assert [tuple(r) for r in df.select(*regime.data_quality(df)).collect()] == [(75.0, pytest.approx(2 / 3), pytest.approx(0.5)), (0.0, 0.0, 0.0)]


def test_training_digests(spark):
    make = lambda ids: research.training_digests(spark.createDataFrame([(0, i) for i in ids], "fold int, id string"), ["fold"], "id").first()
    a, b, c, d = make(["x", "y"]), make(["y", "x"]), make(["x", "z"]), make(["x", "x", "y"])
    assert a == b and a.training_id != c.training_id and (d.n, d.repeated) == (2, 1) and a.training_id == d.training_id
