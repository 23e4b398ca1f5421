"""Provider payloads landed as JSON, parsed to candles, observations, books, funding and pages of backfills.

Each parser takes rows with the payload's text, its fetch time and the asset, so a scan is one `spark.read.text` (or a
table of blobs) away and nothing here talks to a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of time, open, high, low, close and volume in each provider's rows, and the time's unit.
LAYOUTS = {"binance": (0, 1, 2, 3, 4, 5, "ms"), "coinbase": (0, 3, 2, 1, 4, 5, "s"), "kraken": (0, 1, 2, 3, 4, 6, "s"), "kucoin": (0, 1, 3, 4, 2, 5, "s")}
#: Most candles that each provider gives at once.
LIMITS = {"binance": 1000, "coinbase": 300, "kraken": 720, "kucoin": 1500}


def _rows(payload: Column, provider: str) -> Column:
    if provider == "kraken":  # {"result": {"<pair>": [...], "last": n}}: the one key besides `last`
        pairs = F.from_json(F.get_json_object(payload, "$.result"), "map<string,string>")
        only = F.map_filter(pairs, lambda k, v: k != "last")
        return F.when(F.size(only) == 1, F.from_json(F.element_at(F.map_values(only), 1), "array<array<string>>"))
    if provider == "kucoin":
        return F.from_json(F.get_json_object(payload, "$.data"), "array<array<string>>")
    return F.from_json(payload, "array<array<string>>")


def candles(landed: DataFrame, provider: str, seconds: int, limit: int = 300, payload: str = "payload", fetched_at: str = "fetched_at", asset: str = "asset") -> DataFrame:
    """asset, provider, open_time, close_time, open, high, low, close, volume, fetched_at, payload_sha256.

    Bars that were still open when fetched are left out; of each payload the latest `limit` bars stay. Rows that do not
    parse give nulls, which `candle_violations` reports. Times are UTC timestamps without zone."""
    t, o, h, low, c, v, unit = LAYOUTS[provider]
    base = landed.select(asset, F.col(fetched_at).cast("timestamp_ntz").alias("fetched_at"), F.sha2(payload, 256).alias("payload_sha256"), _rows(F.col(payload), provider).alias("_rows"))
    rows = base.select("*", F.explode("_rows").alias("_r")).drop("_rows")
    number = lambda i: F.expr(f"try_cast(get(_r, {i}) AS double)")
    start = F.timestamp_millis(F.expr(f"try_cast(get(_r, {t}) AS bigint)") * (1 if unit == "ms" else 1000)).cast("timestamp_ntz")
    out = rows.select(F.col(asset).alias("asset"), F.lit(provider).alias("provider"), start.alias("open_time"), number(o).alias("open"), number(h).alias("high"), number(low).alias("low"), number(c).alias("close"), number(v).alias("volume"), "fetched_at", "payload_sha256")
    out = out.withColumn("close_time", F.col("open_time") + F.make_dt_interval(secs=F.lit(float(seconds)))).where(F.col("close_time") <= F.col("fetched_at"))
    from pyspark.sql import Window

    latest = Window.partitionBy("asset", "payload_sha256", "fetched_at").orderBy(F.col("open_time").desc())
    most = min(limit, LIMITS[provider])
    return out.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= most).drop("_n")


def candle_violations(df: DataFrame) -> DataFrame:
    """Candles that break a rule of prices, volume, geometry or clocks, with its name."""
    from tidewatch.operators.pit import violations

    return violations(
        df, price=(F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0), volume=F.col("volume") >= 0,
        high=F.col("high") >= F.greatest("open", "close", "low"), low=F.col("low") <= F.least("open", "close", "high"), times=F.col("close_time") > F.col("open_time"), fetched=F.col("fetched_at") >= F.col("close_time"),
    )


def macro_observations(landed: DataFrame, payload: str = "payload", series: str = "series") -> DataFrame:
    """series, observed_at, value, available_at (date precision: the later of the date and its real-time start).
    Values that are missing (`.`) or not numbers are left out."""
    item = "array<struct<date:string,realtime_start:string,value:string>>"
    rows = landed.select(series, F.inline(F.from_json(F.get_json_object(payload, "$.observations"), item)))
    day = lambda c: F.expr(f"cast(try_cast({c} AS date) AS timestamp_ntz)")
    return rows.select(F.col(series).alias("series"), day("date").alias("observed_at"), F.expr("try_cast(value AS double)").alias("value"), F.greatest(day("date"), day("realtime_start")).alias("available_at"), F.lit("date").alias("precision")).where("value IS NOT NULL")


def order_books(landed: DataFrame, payload: str = "payload", fetched_at: str = "fetched_at", asset: str = "asset") -> DataFrame:
    """asset, last_update_id, bids and asks (price, quantity; best first), observed_at, fetched_at."""
    levels = lambda side: F.transform(F.from_json(F.get_json_object(payload, f"$.{side}"), "array<array<string>>"), lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("quantity")))
    return landed.select(F.col(asset).alias("asset"), F.get_json_object(payload, "$.lastUpdateId").cast("bigint").alias("last_update_id"), levels("bids").alias("bids"), levels("asks").alias("asks"), F.col(fetched_at).alias("observed_at"), F.col(fetched_at).alias("fetched_at"))


def ledger_metrics(landed: DataFrame, payload: str = "payload", fetched_at: str = "fetched_at") -> DataFrame:
    """metric, value, observed_at rows of a server-info payload: load factor (1), base fee (0), last sequence (0 when missing)."""
    get = lambda path, default: F.coalesce(F.get_json_object(payload, path).cast("double"), F.lit(default))
    wide = landed.select(F.col(fetched_at).alias("observed_at"), get("$.result.info.load_factor", 1.0).alias("load_factor"), get("$.result.info.validated_ledger.base_fee", 0.0).alias("base_fee"), get("$.result.info.validated_ledger.seq", 0.0).alias("sequence"))
    return wide.unpivot(["observed_at"], ["load_factor", "base_fee", "sequence"], "metric", "value")


def health(landed: DataFrame, healthy: Column, provider: str = "provider", checked_at: str = "checked_at") -> DataFrame:
    """provider, checked_at, status, freshness, agreement: 1 where healthy, else down with 0; null is down."""
    ok = F.coalesce(healthy, F.lit(False))
    return landed.select(provider, checked_at, F.when(ok, "ok").otherwise("down").alias("status"), ok.cast("double").alias("freshness"), ok.cast("double").alias("agreement"))


def pages(landed: DataFrame, payload: str = "payload", source: str = "source", page: str = "page") -> DataFrame:
    """source, page, cursor, following, rows, items of landed pages of a backfill, whose payload is an object with `cursor`,
    `next` and `items`; `store.page_problems` says which of them can't be used. A payload that doesn't parse has null
    rows."""
    item = F.from_json(F.get_json_object(payload, "$.items"), "array<string>")
    return landed.select(F.col(source).alias("source"), F.col(page).cast("long").alias("page"), F.get_json_object(payload, "$.cursor").alias("cursor"), F.get_json_object(payload, "$.next").alias("following"), F.size(item).cast("long").alias("rows"), item.alias("items"))


def funding_states(landed: DataFrame, payload: str = "payload", fetched_at: str = "fetched_at") -> DataFrame:
    """symbol, mark_price, index_price, funding_rate, funding_at, observed_at, fetched_at of premium-index payloads, which are
    one object or an array of them; what isn't a number is null."""
    kind = "array<struct<symbol:string,markPrice:string,indexPrice:string,lastFundingRate:string,nextFundingTime:bigint,time:bigint>>"
    text = F.trim(payload)
    rows = landed.select(F.col(fetched_at).cast("timestamp_ntz").alias("fetched_at"), F.inline(F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), kind)))
    at = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return rows.select("symbol", *(F.expr(f"try_cast({c} AS double)").alias(n) for c, n in (("markPrice", "mark_price"), ("indexPrice", "index_price"), ("lastFundingRate", "funding_rate"))), at("nextFundingTime").alias("funding_at"), at("time").alias("observed_at"), "fetched_at")


def open_interest(landed: DataFrame, payload: str = "payload", fetched_at: str = "fetched_at") -> DataFrame:
    """symbol, open_interest, observed_at, fetched_at of open-interest payloads."""
    get = lambda path, kind: F.expr(f"try_cast(get_json_object({payload}, '{path}') AS {kind})")
    return landed.select(F.get_json_object(payload, "$.symbol").alias("symbol"), get("$.openInterest", "double").alias("open_interest"), F.timestamp_millis(get("$.time", "bigint")).cast("timestamp_ntz").alias("observed_at"), F.col(fetched_at).cast("timestamp_ntz").alias("fetched_at"))
