"""Landed payloads with known rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewatch.sources import landed

NOW = dt.datetime(2026, 1, 1, 0, 5)
T = int(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def rows(spark, payload):
    return spark.createDataFrame([("x", json.dumps(payload), NOW)], "asset string, payload string, fetched_at timestamp_ntz")


def test_layouts_and_open_bars(spark):
    bar = {"binance": [T * 1000, "1", "4", "0.5", "2", "9"], "coinbase": [T, 0.5, 4, 1, 2, 9], "kraken": [T, "1", "4", "0.5", "2", "0", "9"], "kucoin": [str(T), "1", "2", "4", "0.5", "9"]}
    for provider, one in bar.items():
        late = [one[0] + 300 * (1000 if provider == "binance" else 1) if provider != "kucoin" else str(T + 300), *one[1:]]
        data = [one, late]
        payload = {"kraken": {"result": {"P": data, "last": 1}}, "kucoin": {"data": data}}.get(provider, data)
        got = landed.candles(rows(spark, payload), provider, 60).collect()
        assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(1.0, 4.0, 0.5, 2.0, 9.0)], provider
        assert got[0].open_time == dt.datetime(2026, 1, 1)


def test_violations_name_the_rule(spark):
    bad = landed.candles(rows(spark, [[T * 1000, "1", "0.9", "0.5", "2", "-1"]]), "binance", 60)
    assert landed.candle_violations(bad).first().broken == ["volume", "high"]


def test_macro_and_books(spark):
    df = spark.createDataFrame([("s", json.dumps({"observations": [{"date": "2026-01-01", "realtime_start": "2026-01-03", "value": "1.5"}, {"date": "2026-01-02", "realtime_start": "2026-01-02", "value": "."}]}))], "series string, payload string")
    (row,) = landed.macro_observations(df).collect()
    assert row.value == 1.5 and row.available_at == dt.datetime(2026, 1, 3)
    book = landed.order_books(rows(spark, {"lastUpdateId": 7, "bids": [["1.0", "2"]], "asks": []})).first()
    assert book.last_update_id == 7 and book.bids[0].price == 1.0 and book.asks == []
    assert {r.metric: r.value for r in landed.ledger_metrics(rows(spark, {"result": {"info": {}}})).collect()} == {"load_factor": 1.0, "base_fee": 0.0, "sequence": 0.0}


def test_pages_funding_and_open_interest(spark):
    envelope = spark.createDataFrame([("s", 0, json.dumps({"cursor": None, "next": "b", "items": [{"a": 1}, 2]})), ("s", 1, "not json")], "source string, page int, payload string")
    first, second = landed.pages(envelope).orderBy("page").collect()
    assert (first.cursor, first.following, first.rows, first["items"]) == (None, "b", 2, ['{"a":1}', "2"]) and second["items"] is None
    one = {"symbol": "X", "markPrice": "1.5", "indexPrice": "bad", "lastFundingRate": "-0.0001", "nextFundingTime": T * 1000, "time": T * 1000}
    for payload in (one, [one]):
        (row,) = landed.funding_states(rows(spark, payload)).collect()
        assert (row.symbol, row.mark_price, row.index_price, row.funding_rate, row.observed_at, row.fetched_at) == ("X", 1.5, None, -0.0001, dt.datetime(2026, 1, 1), NOW)
    (row,) = landed.open_interest(rows(spark, {"symbol": "X", "openInterest": "12.5", "time": T * 1000})).collect()
    assert (row.symbol, row.open_interest, row.observed_at) == ("X", 12.5, dt.datetime(2026, 1, 1))
    health = landed.health(spark.createDataFrame([("p", NOW, True), ("q", NOW, None)], "provider string, checked_at timestamp_ntz, ok boolean"), F.col("ok"))
    assert sorted((r.provider, r.status, r.freshness) for r in health.collect()) == [("p", "ok", 1.0), ("q", "down", 0.0)]
