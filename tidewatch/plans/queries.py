"""The engine's operators over the driver tables: each query stands in market roles for the tables' columns.

lineitem: a quote of part l_partkey by provider l_suppkey; orders: a daily price series; events: trades and stream
samples; embeddings: state vectors; documents: claims; labels: outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions import content_id, horizon_end, scale
from tidewatch.operators import analog_search, analogs, backtest, calibration, claim_graph, commits, consensus, microstructure, pit, regime, research, semantic, store, timeseries, versions
from tidewatch.scratch import fresh_path, kept
from tidewatch.sources import landed, paged, table
from tidewatch.streaming import as_stream, drained
from tidewatch.streaming.book import books
from tidewatch.streaming.windows import sliding_windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d (date), n (days since 1970), p (mean price of the day)."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("p"))
    return days.withColumn("n", F.datediff("d", F.lit("1970-01-01").cast("date")))


_DAILY = "daily AS (SELECT cast(o_orderdate AS date) AS d, avg(o_totalprice) AS p FROM orders GROUP BY 1)"


def _series(order: str = "d") -> WindowSpec:
    """One series of one row a day: a table of days, however many orders there are."""
    return Window.partitionBy(F.lit(0)).orderBy(order)



def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest quote of each asset and provider; all columns break ties, as the line's key is not unique."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("provider"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("close_time"), "l_orderkey", "l_linenumber", "l_quantity")
    return consensus.latest_by(rows, ["asset", "provider"], [F.col("close_time").desc(), F.col("price").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc(), F.col("l_quantity").desc()])


_QUOTES = """q AS (
  SELECT asset, provider, price, close_time FROM (
    SELECT l_partkey AS asset, l_suppkey AS provider, l_extendedprice / l_quantity AS price, l_shipdate AS close_time,
      row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_extendedprice / l_quantity DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""


@query(f"WITH {_QUOTES} SELECT asset, provider, floor(price * 10000 + 0.5) / 10000 AS price, cast(close_time AS date) AS day FROM q")
def provider_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).select("asset", "provider", (F.floor(F.col("price") * 10000 + 0.5) / 10000).alias("price"), F.to_date("close_time").alias("day"))


#: The time of the consensus: some quotes close after it.
_NOW = "1998-06-01"


@query(f"""WITH {_QUOTES}, m AS (SELECT asset, median(price) AS mid, count(*) AS inputs, epoch(max(close_time)) - epoch(min(close_time)) AS skew, max(close_time) > TIMESTAMP '{_NOW}' AS late FROM q WHERE price > 0 GROUP BY asset),
k AS (SELECT q.asset, count(*) AS providers, median(price) AS value, max(price) AS hi, min(price) AS lo, median(greatest(0.0, epoch(TIMESTAMP '{_NOW}') - epoch(close_time))) AS age FROM q JOIN m USING (asset) WHERE price > 0 AND (inputs < 3 OR abs(price - mid) / mid <= 0.4) GROUP BY q.asset),
s AS (SELECT m.asset, inputs, coalesce(providers, 0) AS providers, value, CASE WHEN providers IS NULL OR providers < 2 THEN 0.0 ELSE (hi - lo) / value END AS spread, skew, late, coalesce(age, 'infinity'::double) AS age FROM m LEFT JOIN k USING (asset)),
c AS (SELECT *, skew > 2e8 OR spread > 0.6 AS apart FROM s), v AS (SELECT *, providers >= 2 AND NOT apart AND NOT late AND age <= 1e8 AS valid FROM c)
SELECT asset, inputs, providers, inputs - providers AS rejected, round(CASE WHEN valid THEN value END, 4) AS value, round(spread, 4) AS spread, round(greatest(0.0, 1 - least(spread / 0.6, 1.0)), 4) AS agreement, round(greatest(0.0, 1 - least(age / 1e8, 1.0)), 4) AS freshness, valid,
  concat_ws(',', CASE WHEN late THEN 'INVALID' END, CASE WHEN apart THEN 'CONFLICT' END, CASE WHEN inputs > providers THEN 'OUTLIER' END, CASE WHEN providers < 2 THEN 'MISSING' END, CASE WHEN age > 1e8 THEN 'STALE' END) AS flags
FROM v""")
def consensus_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    out = consensus.consensus_close(quotes(spark, sf_dir), now=now, max_age_seconds=1e8, max_spread=0.6, outlier=0.4, alignment_seconds=2e8)
    return rounded(out.withColumn("flags", F.array_join("flags", ",")))


@query(f"""WITH {_DAILY} SELECT d, round(p / lag(p, 1) OVER w - 1, 4) AS r1, round(p / lag(p, 7) OVER w - 1, 4) AS r7, round(p / lag(p, 30) OVER w - 1, 4) AS r30, floor((p - lag(p, 20) OVER w) * 1000 + 0.25) / 1000 AS change20 FROM daily WINDOW w AS (ORDER BY d)""")
def trailing_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return rounded(daily(spark, sf_dir).select("d", *(timeseries.trailing_return(p, _series(), k).alias(f"r{k}") for k in (1, 7, 30)), (F.floor(timeseries.absolute_change(p, _series(), 20) * 1000 + 0.25) / 1000).alias("change20")))


@query(f"""WITH {_DAILY}, f AS (SELECT d, p, count(p) OVER a AS n20, avg(p) OVER a AS m, stddev_pop(p) OVER a AS s, count(p) OVER b AS n100, avg(p) OVER b AS m100, count(p) OVER c AS n365, max(p) OVER c AS top FROM daily
  WINDOW a AS (ORDER BY d ROWS 19 PRECEDING), b AS (ORDER BY d ROWS 99 PRECEDING), c AS (ORDER BY d ROWS 364 PRECEDING))
SELECT d, round(CASE WHEN n20 = 20 THEN CASE WHEN s = 0 THEN 0.0 ELSE (p - m) / s END END, 4) AS z20, round(CASE WHEN n100 = 100 THEN p / m100 - 1 END, 4) AS sma100, round(CASE WHEN n365 = 365 THEN p / top - 1 END, 4) AS drawdown365 FROM f""")
def zscore_sma_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return rounded(daily(spark, sf_dir).select("d", timeseries.zscore(p, _series(), 20).alias("z20"), timeseries.distance_to_mean(p, _series(), 100).alias("sma100"), timeseries.drawdown(p, _series(), 365).alias("drawdown365")))


@query(f"""WITH {_DAILY}, c AS (SELECT d, p - lag(p) OVER (ORDER BY d) AS x FROM daily), g AS (SELECT d, count(x) OVER w AS n, avg(greatest(x, 0.0)) OVER w AS up, avg(greatest(-x, 0.0)) OVER w AS down FROM c WINDOW w AS (ORDER BY d ROWS 13 PRECEDING))
SELECT d, round(CASE WHEN n < 14 THEN NULL WHEN up = 0 AND down = 0 THEN 50.0 WHEN down = 0 THEN 100.0 WHEN up = 0 THEN 0.0 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi FROM g""")
def rsi_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = daily(spark, sf_dir).withColumn("x", F.col("p") - F.lag("p").over(_series()))
    return rounded(changes.select("d", timeseries.rsi(F.col("x"), _series()).alias("rsi")))


@query("""WITH s AS (SELECT cast(o_orderdate AS date) AS d, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS b FROM orders GROUP BY 1),
t AS (SELECT d, a / lag(a) OVER (ORDER BY d) - 1 AS ra, b / lag(b) OVER (ORDER BY d) - 1 AS rb FROM s),
r AS (SELECT * FROM t WHERE ra IS NOT NULL AND rb IS NOT NULL)
SELECT d, round(CASE WHEN n = 90 THEN c / v END, 4) AS beta, round(CASE WHEN n = 90 THEN k END, 4) AS correlation FROM (
  SELECT d, count(*) OVER w AS n, covar_samp(ra, rb) OVER w AS c, var_samp(rb) OVER w AS v, corr(ra, rb) OVER w AS k FROM r WINDOW w AS (ORDER BY d ROWS 89 PRECEDING))""")
def beta_corr_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.avg(F.when(F.col("o_orderpriority") == k, F.col("o_totalprice")))
    s = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(pick("1-URGENT").alias("a"), pick("5-LOW").alias("b"))
    r = s.select("d", timeseries.trailing_return(F.col("a"), _series(), 1).alias("ra"), timeseries.trailing_return(F.col("b"), _series(), 1).alias("rb")).where("ra is not null and rb is not null")
    return rounded(r.select("d", timeseries.beta(F.col("ra"), F.col("rb"), _series(), 90).alias("beta"), timeseries.correlation(F.col("ra"), F.col("rb"), _series(), 90).alias("correlation")))


@query(f"""WITH {_DAILY}, r AS (SELECT d, p / lag(p) OVER (ORDER BY d) - 1 AS r, date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM daily), k AS (SELECT sqrt(365.25 / median(g)) AS k FROM r)
SELECT d, round(CASE WHEN count(r) OVER w = 30 THEN stddev_pop(r) OVER w * k END, 4) AS vol30 FROM r, k WINDOW w AS (ORDER BY d ROWS 29 PRECEDING)""")
def realized_vol_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily(spark, sf_dir).select("d", timeseries.trailing_return(F.col("p"), _series(), 1).alias("r"), F.datediff("d", F.lag("d").over(_series())).alias("g"))
    per_year = r.agg((365.25 / F.median("g")).alias("per_year"))  # one row
    return rounded(r.crossJoin(F.broadcast(per_year)).select("d", timeseries.realized_volatility(F.col("r"), _series(), 30, F.col("per_year")).alias("vol30")))


_SERIES = "l AS (SELECT cast(o_orderdate AS date) AS d, o_orderkey % 15 AS k, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)"
_W = "OVER (PARTITION BY k ORDER BY d ROWS {} PRECEDING)"


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily market frame: mean prices of the orders of one remainder by 15 stand for one column; days without are null."""
    pick = lambda k: F.avg(F.when(F.col("o_orderkey") % 15 == k, F.col("o_totalprice")))
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(*(pick(k).alias(c) for k, c in enumerate(timeseries.REQUIRED)))


def _feature_sql() -> str:
    full = lambda n, x: f"CASE WHEN count(x) {_W.format(n - 1)} = {n} THEN {x} END"
    kinds = {"return": lambda n: f"x / lag(x, {n}) OVER (PARTITION BY k ORDER BY d) - 1", "change": lambda n: f"x - lag(x, {n}) OVER (PARTITION BY k ORDER BY d)", "mean": lambda n: full(n, f"x / avg(x) {_W.format(n - 1)} - 1"), "drawdown": lambda n: full(n, f"x / max(x) {_W.format(n - 1)} - 1"), "zscore": lambda n: full(n, f"CASE WHEN stddev_pop(x) {_W.format(n - 1)} = 0 THEN 0.0 ELSE (x - avg(x) {_W.format(n - 1)}) / stddev_pop(x) {_W.format(n - 1)} END")}
    want = {"asset_return_7d": ("return", 0, 7), "btc_return_30d": ("return", 1, 30), "asset_btc_return_7d": ("return", 2, 7), "btc_dominance_change_20d": ("return", 4, 20), "vix_z_20d": ("zscore", 7, 20), "us10y_change_20d": ("change", 9, 20), "asset_ma20_distance": ("mean", 0, 20), "asset_ma100_distance": ("mean", 0, 100), "asset_drawdown_365d": ("drawdown", 0, 365)}
    made = ", ".join(f"{kinds[what](n)} AS {what}{n}" for what, n in dict.fromkeys((what, n) for what, _, n in want.values()))
    wide = ", ".join(f"max({what}{n}) FILTER (k = {k}) AS {f}" for f, (what, k, n) in want.items())
    fill = ", ".join(f"round(last_value({f} IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 4) AS {f}" for f in want)
    return f"""WITH {_SERIES}, m AS (SELECT d, k, x, {made} FROM l), w AS (SELECT d, {wide} FROM m GROUP BY d),
b AS (SELECT p.d, p.x AS a, q.x AS b FROM l p JOIN l q ON p.d = q.d AND p.k = 0 AND q.k = 1), r AS (SELECT d, a / lag(a) OVER (ORDER BY d) - 1 AS ra, b / lag(b) OVER (ORDER BY d) - 1 AS rb FROM b), z AS (SELECT * FROM r WHERE ra IS NOT NULL),
y AS (SELECT d, CASE WHEN count(ra) OVER v = 90 THEN covar_samp(ra, rb) OVER v / var_samp(rb) OVER v END AS beta FROM z WINDOW v AS (ORDER BY d ROWS 89 PRECEDING)), t AS (SELECT DISTINCT d FROM l)
SELECT t.d, {fill}, round(last_value(beta IGNORE NULLS) OVER (ORDER BY t.d ROWS UNBOUNDED PRECEDING), 3) AS asset_beta_btc_90d FROM t LEFT JOIN w USING (d) LEFT JOIN y USING (d)""".replace("OVER (ORDER BY d ROWS UNB", "OVER (ORDER BY t.d ROWS UNB")


@query(_feature_sql())
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled daily features; those of each kind that SQL states here."""
    names = ("asset_return_7d", "btc_return_30d", "asset_btc_return_7d", "btc_dominance_change_20d", "vix_z_20d", "us10y_change_20d", "asset_ma20_distance", "asset_ma100_distance", "asset_drawdown_365d")
    out = timeseries.feature_rows(_market(spark, sf_dir), "d")
    return out.select("d", *(F.round(n, 4).alias(n) for n in names), F.round("asset_beta_btc_90d", 3).alias("asset_beta_btc_90d"))


@query("""WITH t AS (SELECT DISTINCT event_type, ts FROM events), g AS (SELECT event_type, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS a, ts AS b FROM t)
SELECT event_type, cast(floor(epoch(a)) AS bigint) AS gap_from, cast(floor(epoch(b)) AS bigint) AS gap_to, (epoch_us(b) - epoch_us(a)) // 1000 AS gap_millis FROM g WHERE epoch(b) - epoch(a) > 1800""")
def cadence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.gaps(table(spark, sf_dir, "events"), ["event_type"], "ts", 1800)
    return out.select("event_type", F.floor(microstructure.epoch(F.col("gap_start"))).alias("gap_from"), F.floor(microstructure.epoch(F.col("gap_end"))).alias("gap_to"), F.floor(F.round(F.col("gap_seconds") * 1e6) / 1000).alias("gap_millis"))


@query("SELECT event_type, count(*) AS n, cast(min(ts) AS date) AS first_day, cast(max(ts) AS date) AS last_day FROM events GROUP BY 1")
def provider_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.coverage(table(spark, sf_dir, "events"), "event_type", "ts").select("event_type", "n", F.to_date("first_at").alias("first_day"), F.to_date("last_at").alias("last_day"))


@query("""SELECT event_type, cast(epoch(date_trunc('hour', ts)) AS bigint) AS hour, round(arg_min(value, ts), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, ts), 4) AS close, count(*) AS n FROM events GROUP BY 1, 2""")
def ohlc_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = microstructure.epoch(F.date_trunc("hour", "ts")).cast("bigint")
    return rounded(table(spark, sf_dir, "events").groupBy("event_type", hour.alias("hour")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n")))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, concat_ws(',', CASE WHEN NOT l_extendedprice > 20000 THEN 'price' END, CASE WHEN NOT l_tax <= l_discount THEN 'order' END, CASE WHEN NOT l_quantity <= 45 THEN 'volume' END) AS broken FROM lineitem) WHERE broken <> ''""")
def geometry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.violations(table(spark, sf_dir, "lineitem"), price=F.col("l_extendedprice") > 20000, order=F.col("l_tax") <= F.col("l_discount"), volume=F.col("l_quantity") <= 45)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.array_join("broken", ",").alias("broken"))


_OBS = """o AS (SELECT l_partkey AS asset, l_suppkey AS provider, l_orderkey, l_linenumber, l_quantity, l_extendedprice AS price, o_orderdate AS observed, l_shipdate AS fetched,
  CASE l_returnflag WHEN 'R' THEN 'DATE_ONLY' WHEN 'A' THEN 'EXACT' ELSE 'UNKNOWN' END AS precision, CASE WHEN l_linestatus = 'O' THEN 'basis' END AS basis,
  CASE l_returnflag WHEN 'A' THEN o_orderdate WHEN 'R' THEN cast(cast(o_orderdate AS date) + 1 AS timestamp) END AS boundary
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def observations(spark: SparkSession, sf_dir: str, lines: Column | str = "true") -> DataFrame:
    """lineitem (those of `lines`) and orders as observations with an availability precision, boundary, fetch time and basis."""
    rows = table(spark, sf_dir, "lineitem").where(lines).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    precision = F.when(F.col("l_returnflag") == "R", "DATE_ONLY").when(F.col("l_returnflag") == "A", "EXACT").otherwise("UNKNOWN")
    boundary = pit.availability_boundary(precision, F.col("o_orderdate"), F.to_date("o_orderdate"))
    return rows.select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("provider"), "l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("fetched"), F.when(F.col("l_linestatus") == "O", "basis").alias("basis"), boundary.alias("boundary"))


@query(f"""WITH {_OBS} SELECT class, provider, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT provider, price, CASE WHEN boundary IS NULL OR boundary > TIMESTAMP '1999-01-01' THEN 'INELIGIBLE' WHEN fetched <= TIMESTAMP '1999-01-01' THEN 'STRICT_REPLAY' WHEN basis IS NOT NULL THEN 'RECONSTRUCTED_PIT' ELSE 'INELIGIBLE' END AS class FROM o) GROUP BY 1, 2""")
def eligibility_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1999-01-01").cast("timestamp_ntz")
    df = observations(spark, sf_dir).withColumn("class", pit.eligibility(F.col("boundary"), F.col("fetched"), F.col("basis"), at))
    return df.groupBy("class", "provider").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


_TIMES = ("1997-01-01", "1999-01-01", "2001-01-01")


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = spark.createDataFrame([(t,) for t in _TIMES], "at string").select(F.col("at").cast("timestamp_ntz").alias("at"))
    return pit.as_of(observations(spark, sf_dir), times, ["asset", "provider"], "boundary", ["boundary", "fetched", "price", "l_orderkey", "l_linenumber", "l_quantity"])


_CHOSEN = f"""{_OBS}, t AS (SELECT unnest([TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01', TIMESTAMP '2001-01-01']) AS moment),
c AS (SELECT * FROM (SELECT moment, o.*, row_number() OVER (PARTITION BY moment, asset, provider ORDER BY boundary DESC, fetched DESC, price DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM o JOIN t ON boundary <= moment) WHERE rn = 1)"""


@query(f"WITH {_CHOSEN} SELECT cast(moment AS date) AS moment, asset, provider, l_orderkey, l_linenumber, round(price, 2) AS price FROM c")
def asof_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).select(F.to_date("at").alias("moment"), "asset", "provider", "l_orderkey", "l_linenumber", F.round("price", 2).alias("price"))


@query(f"""WITH {_CHOSEN}, k AS (SELECT moment, asset, l_orderkey, CASE WHEN fetched <= moment THEN 'STRICT_REPLAY' ELSE 'RECONSTRUCTED_PIT' END AS class, provider FROM c)
SELECT cast(moment AS date) AS moment, count(*) AS n, min(l_orderkey) AS first_id, max(l_orderkey) AS last_id, array_to_string(list_sort(list(DISTINCT provider % 5)), ',') AS providers, CASE WHEN bool_or(class = 'RECONSTRUCTED_PIT') THEN 'RECONSTRUCTED_PIT' ELSE 'STRICT_REPLAY' END AS class FROM k GROUP BY moment""")
def source_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chosen(spark, sf_dir).withColumns({"kind": F.when(F.col("fetched") <= F.col("at"), "STRICT_REPLAY").otherwise("RECONSTRUCTED_PIT"), "provider": F.col("provider") % 5})
    return pit.snapshots(rows, "at", "l_orderkey", "provider", "kind").select(F.to_date("at").alias("moment"), "n", "first_id", "last_id", F.array_join(F.transform("providers", lambda x: x.cast("string")), ",").alias("providers"), "class")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS t, max_by(value, ts) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT e.event_id, round(h.v, 4) AS price FROM events e ASOF LEFT JOIN h ON e.ts >= h.t""")
def asof_event_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hours = events.where("event_type = 'view'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.max_by("value", "ts").alias("v"))
    return pit.as_of_latest(events.select("event_id", "ts"), hours, "ts", "t", "v").select("event_id", F.round("v", 4).alias("price"))


@query("""SELECT cast(ts AS date) AS day, user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS buys, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 4) AS sells, count(*) AS n,
  round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END), 4) AS cvd, round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END) / nullif(sum(value), 0), 0), 4) AS taker_imbalance
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2""")
def order_flow_cvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_flow(spark, sf_dir, ["day", "user_id"]))


def _flow(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    side = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return microstructure.order_flow(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), keys, side, F.col("value"))


def _grid(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("at")).distinct()


#: When an event was available and when it was fetched, in seconds after it happened: some only after the window's end.
_AVAILABLE, _FETCHED = "event_id % 4", "event_id % 4 + event_id % 90"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = lambda c: F.col("ts") + F.make_dt_interval(secs=F.expr(c))
    return table(spark, sf_dir, "events").withColumns({"available": after(_AVAILABLE), "fetched": after(_FETCHED)})


def _window_sql(seconds: int, unit: str) -> str:
    return f"""g AS (SELECT DISTINCT date_trunc('{unit}', ts) AS moment FROM events), s AS (SELECT *, epoch(ts) + {_AVAILABLE} AS av, epoch(ts) + {_FETCHED} AS fe FROM events),
met AS (SELECT moment, s.* FROM g JOIN s ON epoch(ts) > epoch(moment) - {seconds} AND ts <= moment AND av <= epoch(moment) AND fe <= epoch(moment))"""


#: Freshness and ingestion-lag limits by window.
_LIMITS = {60: (15, 5), 300: (60, 15), 900: (180, 30), 3600: (600, 60)}


def _windows(seconds: int, unit: str):
    fresh, late = _LIMITS[seconds]
    sql = f"""WITH {_window_sql(seconds, unit)}, w AS (SELECT moment, event_type, count(*) AS n, min_by(value, (ts, av, fe)) AS f, max_by(value, (ts, av, fe)) AS l, sum(value) AS total, min(epoch(ts)) AS a, max(epoch(ts)) AS b, max_by(fe, (ts, av, fe)) AS c FROM met GROUP BY 1, 2)
SELECT cast(floor(epoch(moment)) AS bigint) AS moment, event_type, n, round(f, 4) AS first_value, round(l, 4) AS last_value, round(total, 4) AS total, round((l / f - 1) * 1e4, 2) AS return_bps, round(epoch(moment) - b, 3) AS age_seconds, round(c - b, 3) AS lag_seconds, epoch(moment) - b <= {fresh} AND round(c - b, 3) <= {late} AS regime_eligible,
  concat_ws(',', CASE WHEN n < 2 OR b - a < 0.5 * {seconds} THEN 'SPARSE_WINDOW' END, CASE WHEN epoch(moment) - b > {fresh} THEN 'STALE_WINDOW' END, CASE WHEN round(c - b, 3) > {late} THEN 'INGESTION_LAG' END) AS flags FROM w"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = microstructure.trailing_windows(_samples(spark, sf_dir), _grid(spark, sf_dir, unit), seconds, "ts", F.col("value"), F.col("available"), F.col("fetched"), keys=["event_type"])
        return out.select(microstructure.epoch(F.col("at")).cast("bigint").alias("moment"), "event_type", "n", *(F.round(c, k).alias(c) for c, k in (("first_value", 4), ("last_value", 4), ("total", 4), ("return_bps", 2), ("age_seconds", 3), ("lag_seconds", 3))), "regime_eligible", F.array_join("flags", ",").alias("flags"))

    QUERIES[f"pit_windows_{seconds}s"], SQL[f"pit_windows_{seconds}s"] = run, sql


for _seconds in _LIMITS:
    _windows(_seconds, "hour")


@query(f"""WITH {_window_sql(3600, 'hour')}, x AS (SELECT *, (ts, av, fe, value) AS o, CASE WHEN user_id % 3 = 0 THEN value END AS oi, CASE WHEN user_id % 5 = 0 THEN value / 1e5 END AS fu, CASE WHEN user_id % 2 = 0 THEN value - 50 END AS ba FROM met),
w AS (SELECT moment, count(*) AS n, min_by(value, o) AS f, max_by(value, o) AS l, sum((user_id % 21 - 10) / 9.7) / count(*) AS depth, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS buys, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS sells,
  CASE WHEN count(oi) >= 2 THEN min_by(oi, o) FILTER (oi IS NOT NULL) END AS oi0, max_by(oi, o) FILTER (oi IS NOT NULL) AS oi1, CASE WHEN count(fu) >= 2 THEN min_by(fu, o) FILTER (fu IS NOT NULL) END AS fu0, max_by(fu, o) FILTER (fu IS NOT NULL) AS fu1, CASE WHEN count(ba) >= 2 THEN min_by(ba, o) FILTER (ba IS NOT NULL) END AS ba0, max_by(ba, o) FILTER (ba IS NOT NULL) AS ba1,
  min(epoch(ts)) AS a, max(epoch(ts)) AS b, max_by(fe, o) AS c FROM x GROUP BY 1)
SELECT cast(floor(epoch(moment)) AS bigint) AS moment, n AS sample_count, round((l / f - 1) * 1e4, 2) AS mid_return_bps, round(depth, 4) AS mean_depth_imbalance_25bps, round(buys - sells, 4) AS cvd_quote, round(CASE WHEN buys + sells = 0 THEN 0.0 ELSE (buys - sells) / (buys + sells) END, 4) AS taker_imbalance,
  round(CASE WHEN oi0 > 0 THEN (oi1 - oi0) / oi0 END, 4) AS open_interest_delta_pct, round((fu1 - fu0) * 1e4, 4) AS funding_delta_bps, round(ba1 - ba0, 4) AS basis_delta_bps, epoch(moment) - b <= 600 AND round(c - b, 3) <= 60 AS regime_eligible,
  concat_ws(',', CASE WHEN n < 2 OR b - a < 1800 THEN 'SPARSE_WINDOW' END, CASE WHEN oi0 IS NULL THEN 'OPEN_INTEREST_NO_DATA' END, CASE WHEN fu0 IS NULL THEN 'FUNDING_NO_DATA' END, CASE WHEN ba0 IS NULL THEN 'BASIS_NO_DATA' END, CASE WHEN epoch(moment) - b > 600 THEN 'STALE_WINDOW' END, CASE WHEN round(c - b, 3) > 60 THEN 'INGESTION_LAG' END) AS flags FROM w""")
def flow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of flow samples; users stand for what a sample holds of open interest, funding and basis."""
    v, u = F.col("value"), F.col("user_id")
    side = lambda k: F.when(F.col("event_type") == k, v).otherwise(0.0)
    samples = _samples(spark, sf_dir).select(
        F.lit("x").alias("symbol"), F.col("ts").alias("observed_at"), F.col("available").alias("available_at"), F.col("fetched").alias("fetched_at"), v.alias("mid_price"), ((u % 21 - 10) / 9.7).alias("depth_imbalance_25bps"),
        side("purchase").alias("aggressive_buy_notional"), side("error").alias("aggressive_sell_notional"), F.when(u % 3 == 0, v).alias("open_interest"), F.when(u % 5 == 0, v / 1e5).alias("funding_rate"), F.when(u % 2 == 0, v - 50).alias("basis_bps"),
    )
    out = microstructure.flow_windows(samples, _grid(spark, sf_dir, "hour"), 3600)
    names = (("mid_return_bps", 2), *((n, 4) for n in ("mean_depth_imbalance_25bps", "cvd_quote", "taker_imbalance", "open_interest_delta_pct", "funding_delta_bps", "basis_delta_bps")))
    return out.select(microstructure.epoch(F.col("at")).cast("bigint").alias("moment"), "sample_count", *(F.round(c, k).alias(c) for c, k in names), "regime_eligible", F.array_join("flags", ",").alias("flags"))


@query("""WITH g AS (SELECT DISTINCT date_trunc('hour', ts) AS moment FROM events), m AS (SELECT moment, max(CASE WHEN event_type = 'view' AND epoch(moment) - epoch(ts) < 1200 THEN epoch(ts) END) AS v, max(CASE WHEN event_type = 'click' AND epoch(moment) - epoch(ts) < 2400 THEN epoch(ts) END) AS c, max(CASE WHEN event_type = 'purchase' AND epoch(moment) - epoch(ts) < 3600 THEN epoch(ts) END) AS p FROM g LEFT JOIN events ON ts <= moment AND epoch(ts) > epoch(moment) - 3600 GROUP BY 1)
SELECT cast(floor(epoch(moment)) AS bigint) AS moment, round(epoch(moment) - v, 3) AS age_view, round(epoch(moment) - c, 3) AS age_click, round(epoch(moment) - p, 3) AS age_purchase, round(greatest(v, c, p) - least(v, c, p), 3) AS skew_seconds,
  concat_ws(',', CASE WHEN v IS NULL THEN 'VIEW_MISSING' END, CASE WHEN c IS NULL THEN 'CLICK_MISSING' END, CASE WHEN p IS NULL THEN 'PURCHASE_MISSING' END, CASE WHEN greatest(v, c, p) - least(v, c, p) > 1500 THEN 'SKEW' END) AS flags,
  v IS NOT NULL AND c IS NOT NULL AND p IS NOT NULL AND greatest(v, c, p) - least(v, c, p) <= 1500 AS eligible FROM m""")
def stream_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = microstructure.aligned(table(spark, sf_dir, "events"), _grid(spark, sf_dir, "hour"), "ts", "event_type", {"view": 1200, "click": 2400, "purchase": 3600}, 1500)
    return out.select(microstructure.epoch(F.col("at")).cast("bigint").alias("moment"), *(F.round(c, 3).alias(c) for c in ("age_view", "age_click", "age_purchase", "skew_seconds")), F.array_join("flags", ",").alias("flags"), "eligible")


@query("""WITH h AS (SELECT cast(epoch(date_trunc('hour', ts)) AS bigint) AS hour, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS br, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS ar, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS b, coalesce(sum(value) FILTER (event_type = 'error'), 0) AS s FROM events GROUP BY 1)
SELECT hour, round(least(br, s) + least(ar, b), 4) AS compatible, round(greatest(br - least(br, s), 0) + greatest(ar - least(ar, b), 0), 4) AS residual, round(greatest(s - least(br, s), 0) + greatest(b - least(ar, b), 0), 4) AS unmatched, round((least(br, s) + least(ar, b)) / nullif(br + ar, 0), 4) AS coverage FROM h""")
def depth_trade_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    hours = table(spark, sf_dir, "events").groupBy(microstructure.epoch(F.date_trunc("hour", "ts")).cast("bigint").alias("hour")).agg(pick("view").alias("br"), pick("click").alias("ar"), pick("purchase").alias("b"), pick("error").alias("s"))
    return rounded(microstructure.reconcile(hours, "br", "ar", "b", "s").select("hour", "compatible", "residual", "unmatched", "coverage"))


@query("""WITH d AS (SELECT cast(ts AS date) AS day, user_id % 50 AS u, sum(value) FILTER (event_type = 'view') AS a, sum(value) FILTER (event_type = 'click') AS b, sum(value) FILTER (event_type = 'purchase') AS p, sum(value) FILTER (event_type = 'error') AS e FROM events GROUP BY 1, 2),
i AS (SELECT day, u, (a - b) / (a + b) AS depth, (p - e) / (p + e) AS taker, CASE WHEN u % 7 > 0 THEN u % 3 = 0 END AS funding, u % 4 = 0 AS wide FROM d),
l AS (SELECT *, coalesce(funding, false) AS hot, CASE WHEN depth IS NULL OR taker IS NULL THEN 'NO_DATA' WHEN depth >= 0.25 AND taker >= 0.2 THEN CASE WHEN coalesce(funding, false) THEN 'LEVERAGED_DEMAND' ELSE 'SPOT_LED_DEMAND' END WHEN depth >= 0.25 AND taker <= -0.2 THEN CASE WHEN coalesce(funding, false) THEN 'LONG_CROWDING' ELSE 'BID_ABSORPTION' END WHEN depth <= -0.25 AND taker <= -0.2 THEN 'SELL_PRESSURE' ELSE 'MIXED' END AS flow FROM i),
z AS (SELECT *, CASE WHEN depth IS NULL OR taker IS NULL THEN 'NO_DATA' WHEN depth >= 0.35 AND taker > 0 THEN CASE WHEN hot THEN 'LONG_CROWDING' ELSE 'ABSORPTION' END WHEN depth <= -0.35 AND taker < 0 THEN 'DISTRIBUTION' ELSE 'BALANCED' END AS state FROM l),
c AS (SELECT *, CASE flow WHEN 'NO_DATA' THEN 0.0 WHEN 'SPOT_LED_DEMAND' THEN 0.72 WHEN 'SELL_PRESSURE' THEN 0.72 WHEN 'BID_ABSORPTION' THEN 0.68 WHEN 'LEVERAGED_DEMAND' THEN 0.6 WHEN 'LONG_CROWDING' THEN 0.55 ELSE 0.45 END AS f, CASE state WHEN 'NO_DATA' THEN 0.0 WHEN 'BALANCED' THEN 0.45 WHEN 'LONG_CROWDING' THEN 0.58 ELSE 0.62 END AS g FROM z)
SELECT day, u, flow, cast(CASE WHEN wide THEN least(f, 0.5) ELSE f END AS double) AS flow_confidence, state, cast(CASE WHEN wide THEN least(g, 0.5) ELSE g END AS double) AS state_confidence FROM c""")
def flow_and_market_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 50).alias("u")).agg(pick("view").alias("a"), pick("click").alias("b"), pick("purchase").alias("p"), pick("error").alias("e"))
    i = d.select("day", "u", F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b")).alias("depth"), F.try_divide(F.col("p") - F.col("e"), F.col("p") + F.col("e")).alias("taker"))
    funding, wide = F.when(F.col("u") % 7 > 0, F.col("u") % 3 == 0), F.col("u") % 4 == 0
    flow, sure = regime.flow_regime(F.col("depth"), F.col("taker"), funding, wide)
    state, sure2 = regime.market_state(F.col("depth"), F.col("taker"), funding, wide)
    return rounded(i.select("day", "u", flow.alias("flow"), sure.alias("flow_confidence"), state.alias("state"), sure2.alias("state_confidence")))


#: The terms as the SQL states them: (component, feature, width, sign), and what each feature is here, by user and day.
_TERMS = (
    ("macro", "ndx_return_20d", 0.10, 1), ("macro", "dxy_return_20d", 0.05, -1), ("macro", "us10y_change_20d", 0.50, -1), ("macro", "vix_z_20d", 2.0, -1), ("crypto", "btc_return_7d", 0.15, 1), ("crypto", "btc_return_30d", 0.30, 1),
    ("crypto", "eth_btc_return_7d", 0.10, 1), ("crypto", "btc_dominance_change_20d", 0.08, -1), ("relative", "asset_return_7d", 0.20, 1), ("relative", "asset_return_30d", 0.45, 1), ("relative", "asset_btc_return_7d", 0.15, 1),
    ("relative", "asset_btc_return_30d", 0.30, 1), ("relative", "asset_ma100_distance", 0.40, 1), ("derivatives", "liquidation_impulse", 1.0, 1), ("ledger", "ledger_activity_z", 2.0, 1),
)
_CALM = (("funding_z", 2.5), ("oi_price_divergence", 2.0))


def _score_ctes() -> str:
    """Components s_ and their coverage k_, bull, cov, alignment, conviction, sure and blocked, as table d."""
    clip = lambda x: f"greatest(0.0, least(100.0, {x}))"
    width = {f: w for _, f, w, _ in _TERMS} | dict(_CALM)
    feature = {f: f"CASE WHEN (u + {3 * k}) % 37 > 2 THEN (m - 50) / 25 * {w} * {sign} + (u % {5 + k} - {2 + k // 2}) / {10.0 + k} * {w} * {0.2 if k else 0.4} END" for k, (f, w, sign) in enumerate([(f, w, s) for _, f, w, s in _TERMS] + [(f, w, 1) for f, w in _CALM])}
    terms = {c: [clip(f"50 + 50 * ({s} * {f}) / {w}") + f" + 0 * {f}" for k, f, w, s in _TERMS if k == c] for c in dict.fromkeys(t[0] for t in _TERMS)}
    terms["derivatives"] = [f"100 * (1 - greatest(0.0, least(1.0, abs({f}) / {w}))) + 0 * {f}" for f, w in _CALM] + terms["derivatives"]
    assert set(width) == set(feature)
    parts = ", ".join(f"list_avg(list_filter([{', '.join(v)}], lambda x: x IS NOT NULL)) AS s_{c}, len(list_filter([{', '.join(v)}], lambda x: x IS NOT NULL)) / {float(len(v))} AS k_{c}" for c, v in terms.items())
    weights = {"macro": 0.25, "crypto": 0.3, "relative": 0.3, "derivatives": 0.1, "ledger": 0.05}
    cov = " + ".join(f"{w} * k_{c}" for c, w in weights.items())
    bull = " + ".join(f"{w} * k_{c} * coalesce(s_{c}, 50)" for c, w in weights.items())
    alive = ", ".join(f"CASE WHEN k_{c} > 0 THEN s_{c} END" for c in weights)
    return f"""v AS (SELECT user_id AS u, cast(ts AS date) AS day, avg(value) AS m FROM events GROUP BY 1, 2), f AS (SELECT u, day, {', '.join(f'{x} AS {n}' for n, x in feature.items())}, CASE WHEN u % 11 = 0 THEN 0.4 ELSE 1.0 END AS quality FROM v),
p AS (SELECT u, day, quality, {parts} FROM f), b AS (SELECT *, {cov} AS cov, list_filter([{alive}], lambda x: x IS NOT NULL) AS alive, {bull} AS total FROM p),
e AS (SELECT *, CASE WHEN cov = 0 THEN 50.0 ELSE total / cov END AS bull, CASE WHEN len(alive) >= 2 THEN greatest(0.0, least(1.0, 1 - list_stddev_pop(alive) / 50)) ELSE 0.0 END AS alignment FROM b),
d AS (SELECT *, abs(bull - 50) / 50 AS conviction, greatest(0.0, least(1.0, least(quality, cov))) AS sure, quality < 1 OR round(cov, 9) < 0.6 OR least(quality, cov) < 0.5 AS blocked FROM e)"""


def _scored_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    given = [(f, w, s) for _, f, w, s in _TERMS] + [(f, w, 1) for f, w in _CALM]
    value = lambda k, w, s: F.when((F.col("u") + 3 * k) % 37 > 2, (F.col("m") - 50) / 25 * w * s + (F.col("u") % (5 + k) - (2 + k // 2)) / (10.0 + k) * w * (0.2 if k else 0.4))
    return regime.component_scores(v.select("u", "day", *(value(k, w, s).alias(f) for k, (f, w, s) in enumerate(given))))


@query(f"""WITH {_score_ctes()} SELECT u, day, round(bull, 4) AS bull_score, round(cov, 4) AS coverage, round(alignment, 4) AS alignment, round(conviction, 4) AS conviction, round(sure, 4) AS data_confidence, round(sqrt(sure * (0.65 * cov + 0.2 * alignment + 0.15 * conviction)), 4) AS confidence, blocked,
  CASE WHEN blocked THEN 'DEGRADED' WHEN bull >= 72 THEN 'STRONG_BULL' WHEN bull >= 58 THEN 'BULLISH' WHEN bull >= 43 THEN 'NEUTRAL' WHEN bull >= 28 THEN 'BEARISH' ELSE 'STRONG_BEAR' END AS label FROM d""")
def regime_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all components vary, some are unknown, and some rows are of poor quality."""
    quality = F.when(F.col("u") % 11 == 0, 0.4).otherwise(1.0)
    out = regime.blended(_scored_regimes(spark, sf_dir), regime.WEIGHTS["1d"], quality)
    return rounded(out.select("u", "day", "bull_score", "coverage", "alignment", "conviction", "data_confidence", "confidence", "blocked", "label"))


@query("""WITH u AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1), z AS (SELECT user_id, (m - 50) / 10 AS a, (s - 30) / 10 AS b FROM u),
p AS (SELECT user_id, x.* FROM z, (VALUES ('calm', 0.0, -1.0, 0), ('storm', -1.0, 1.0, 1), ('surge', 1.0, 0.5, 2), ('drift', 0.5, -0.5, 3)) AS x(name, pa, pb, i)),
r AS (SELECT z.user_id, name, row_number() OVER (PARTITION BY z.user_id ORDER BY round((abs(a - pa) / 1.0 + abs(b - pb) / 2.0) / 2, 9), i) AS k FROM z JOIN p USING (user_id))
SELECT user_id, string_agg(name, ',' ORDER BY k) AS nearest FROM r GROUP BY 1""")
def prototype_analogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = u.select("user_id", ((F.col("m") - 50) / 10).alias("a"), ((F.col("s") - 30) / 10).alias("b"))
    near = regime.nearest_prototypes(z, {"calm": {"a": 0.0, "b": -1.0}, "storm": {"a": -1.0, "b": 1.0}, "surge": {"a": 1.0, "b": 0.5}, "drift": {"a": 0.5, "b": -0.5}}, {"a": 1.0, "b": 2.0})
    return z.select("user_id", F.array_join(near, ",").alias("nearest"))


_SIGNALS = ("trend", "relative_strength", "spot_flow", "leverage", "crowding", "deleveraging", "breakout", "distribution", "volatility", "drawdown_stress", "liquidity")


def _signal_sql(k: int) -> str:
    return f"CASE WHEN (u * {k + 3} + epoch(day) / 86400) % {13 + k} >= {1 if k > 1 else 0.5} THEN greatest(-1.0, least(1.0, (((u * {7 + 2 * k} + epoch(day) / 86400 * {5 + k}) % 41) - 20) / 18.0)) END"


@query(f"""WITH v AS (SELECT user_id AS u, cast(ts AS date) AS day FROM events GROUP BY 1, 2), s AS (SELECT u, day, {', '.join(f'{_signal_sql(k)} AS {n}' for k, n in enumerate(_SIGNALS))} FROM v),
c AS (SELECT *, len(list_filter([{', '.join(_SIGNALS)}], lambda x: x IS NOT NULL)) / 11.0 AS coverage, list_max(list_transform(list_filter([{', '.join(_SIGNALS)}], lambda x: x IS NOT NULL), lambda x: abs(x))) AS strongest FROM s),
r AS (SELECT *, trend IS NULL OR relative_strength IS NULL AS missing, CASE WHEN trend IS NULL OR relative_strength IS NULL OR coverage < 0.7 THEN 'NO_DATA' WHEN breakout <= -0.55 THEN 'FAILED_BREAKOUT' WHEN deleveraging >= 0.6 THEN 'DELEVERAGING' WHEN trend <= -0.65 AND volatility >= 0.55 AND drawdown_stress >= 0.55 THEN 'CAPITULATION'
  WHEN crowding >= 0.6 AND leverage >= 0.45 THEN 'LONG_CROWDING' WHEN distribution >= 0.6 THEN 'DISTRIBUTION' WHEN breakout >= 0.65 AND trend >= 0.35 THEN 'BREAKOUT' WHEN trend >= 0.35 AND spot_flow >= 0.4 AND leverage < 0.45 THEN 'SPOT_LED_EXPANSION' WHEN trend >= 0.35 AND leverage >= 0.45 AND crowding < 0.6 THEN 'LEVERAGED_EXPANSION'
  WHEN trend >= 0.15 AND drawdown_stress >= 0.3 THEN 'RECOVERY' WHEN liquidity >= 0.35 AND trend >= 0.15 AND relative_strength >= 0 THEN 'RISK_ON' WHEN abs(trend) <= 0.25 AND spot_flow >= 0.1 AND leverage < 0.45 AND distribution < 0.6 THEN 'ACCUMULATION' ELSE 'NO_DATA' END AS regime FROM c)
SELECT u, day, regime, round(coverage, 4) AS coverage, round(CASE WHEN regime = 'NO_DATA' THEN 0.0 ELSE least(1.0, coverage * (0.5 + 0.5 * strongest)) END, 4) AS confidence,
  CASE WHEN missing THEN 'MISSING_REQUIRED_SIGNALS:' || concat_ws(',', CASE WHEN relative_strength IS NULL THEN 'relative_strength' END, CASE WHEN trend IS NULL THEN 'trend' END) WHEN coverage < 0.7 THEN 'INSUFFICIENT_SIGNAL_COVERAGE' WHEN regime = 'NO_DATA' THEN 'NO_RULE_WITH_SUFFICIENT_SEPARATION' ELSE '' END AS reasons FROM r""")
def regime_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes of users and days whose signals go through all values, some unknown."""
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.to_date("ts").alias("day")).distinct()
    n = F.datediff("day", F.lit("1970-01-01").cast("date"))
    signal = lambda k: F.when((F.col("u") * (k + 3) + n) % (13 + k) >= (1 if k > 1 else 0.5), (((F.col("u") * (7 + 2 * k) + n * (5 + k)) % 41) - 20) / 18.0)
    known = regime.signals(v.select("u", "day", *(signal(k).alias(s) for k, s in enumerate(_SIGNALS))), [(s, s, 1.0) for s in _SIGNALS])
    out = regime.classified(known)
    return rounded(out.select("u", "day", "regime", F.col("signal_coverage").alias("coverage"), "confidence", F.array_join("reasons", ",").alias("reasons")))


_COMPONENTS = ("macro", "crypto", "relative", "derivatives", "ledger")


@query(f"""WITH {_score_ctes()}, x AS (SELECT u, day, unnest([{', '.join(f"{{i: {i}, name: '{c}', far: round(abs(round(s_{c}, 9) - 50), 9), known: k_{c}}}" for i, c in enumerate(_COMPONENTS))}], recursive := true) FROM d),
y AS (SELECT u, day, name, row_number() OVER (PARTITION BY u, day ORDER BY far DESC, i) AS k FROM x WHERE known > 0)
SELECT d.u, d.day, coalesce(string_agg(name, ',' ORDER BY k) FILTER (k <= 4), '') AS drivers FROM d LEFT JOIN y ON d.u = y.u AND d.day = y.day GROUP BY 1, 2""")
def key_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four components furthest from neutral."""
    scored = _scored_regimes(spark, sf_dir)
    scored = scored.withColumns({f"score_{c}": F.round(F.col(f"score_{c}"), 9) for c in _COMPONENTS})
    return scored.select("u", "day", F.array_join(regime.key_drivers(scored, _COMPONENTS), ",").alias("drivers"))


@query(f"""WITH {_DAILY}, n AS (SELECT date_diff('day', DATE '1970-01-01', d) AS n, p, ln(p / lag(p) OVER (ORDER BY d)) AS r FROM daily),
j AS (SELECT a.n, a.p, b.n AS m, b.p AS q, b.r, max(b.p) OVER (PARTITION BY a.n ORDER BY b.n) AS peak FROM n a JOIN n b ON b.n BETWEEN a.n AND a.n + 7)
SELECT n, count(*) - 1 AS n_path, max(m) FILTER (m > n) AS resolved_step, round(arg_max(q, m) / any_value(p) - 1, 4) AS future_return, round(max(q) / any_value(p) - 1, 4) AS mfe, round(min(q) / any_value(p) - 1, 4) AS mae, round(sqrt(sum(r * r) FILTER (m > n)), 4) AS path_volatility, round(min(q / peak - 1), 4) AS max_drawdown, max(q) / any_value(p) - 1 >= 0.05 AS touch_up_0_05, min(q) / any_value(p) - 1 <= -0.1 AS touch_down_0_1 FROM j GROUP BY n""")
def future_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.outcome_labels(daily(spark, sf_dir).select("n", "p"), [], "n", "p", 7)
    return rounded(out.select("n", "n_path", "resolved_step", "future_return", "mfe", "mae", "path_volatility", "max_drawdown", "touch_up_0_05", "touch_down_0_1"))


@query(f"""WITH {_DAILY}, n AS (SELECT date_diff('day', DATE '1970-01-01', d) AS n, p FROM daily), j AS (SELECT a.n, a.p, b.n AS m, b.p AS q FROM n a JOIN n b ON b.n BETWEEN a.n AND a.n + 7),
l AS (SELECT n, any_value(p) AS p, max(q) AS hi, min(q) AS lo, arg_max(q, m) AS last FROM j GROUP BY n HAVING count(*) > 1),
e AS (SELECT n, unnest([{{e: 'return_gt_0', y: last / p - 1 > 0}}, {{e: 'touch_return_up:0.05', y: hi / p - 1 >= 0.05}}, {{e: 'touch_return_down:0.05', y: lo / p - 1 <= -0.05}}, {{e: 'touch_return_up:0.1', y: hi / p - 1 >= 0.1}}, {{e: 'touch_return_down:0.1', y: lo / p - 1 <= -0.1}},
  {', '.join(f"{{e: 'touch_price:{k}', y: CASE WHEN p < {k} THEN hi >= {k} WHEN p > {k} THEN lo <= {k} ELSE true END}}" for k in (120000, 150000.5))}], recursive := true) FROM l)
SELECT e AS event, count(*) AS n, count_if(y) AS yes FROM e GROUP BY 1""")
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each binary event comes true within a week."""
    returns, prices = (0.05, 0.1), (120000, 150000.5)
    labels = research.outcome_labels(daily(spark, sf_dir).select("n", "p"), [], "n", "p", 7, returns, prices)
    out = research.event_outcomes(labels, ["n"], returns, prices)
    return out.groupBy("event").agg(F.count("*").alias("n"), F.count_if("actual").alias("yes"))


_LABELLED = f"{_DAILY}, x AS (SELECT date_diff('day', DATE '1970-01-01', d) AS n, row_number() OVER (ORDER BY d) - 1 AS i FROM daily), l AS (SELECT n, n + 7 + n % 3 AS resolved, i FROM x)"
_FOLDS = f"""{_LABELLED}, b AS (SELECT (i - 365) // 30 AS block, min(n) AS s, max(n) AS e, count(*) AS n_test, min(i) AS f FROM l WHERE i >= 365 GROUP BY 1),
t AS (SELECT block, s, e, n_test, f, count(l.n) AS fit FROM b LEFT JOIN l ON l.resolved < s - 7 AND l.i < f GROUP BY ALL),
folds AS (SELECT row_number() OVER (ORDER BY block) - 1 AS fold_index, * FROM t WHERE fit >= 1)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("n", (F.col("n") + 7 + F.col("n") % 3).alias("resolved"), "p")


@query(f"WITH {_FOLDS} SELECT fold_index, s AS test_start, e AS test_end, n_test, fit AS n_train, f - fit AS n_purged FROM folds")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.walk_forward_folds(_labelled(spark, sf_dir), "n", "resolved", 365, 30, 7)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B0 to B3 of each fold, for every test day: does the price rise over a week; the signal is the last week's return."""
    w = _series("n")
    days = _labelled(spark, sf_dir).withColumns({"actual": F.lead("p", 7).over(w) > F.col("p"), "r7": timeseries.trailing_return(F.col("p"), w, 7)})
    return research.oos_predictions(days, "n", "resolved", "actual", "r7", 365, 30, 7).select("fold_index", "n", "actual", "kind", "score")


_DAYS = f"""{_DAILY}, y AS (SELECT date_diff('day', DATE '1970-01-01', d) AS n, p, lead(p, 7) OVER (ORDER BY d) > p AS actual, p / lag(p, 7) OVER (ORDER BY d) - 1 AS r7, p / lag(p, 1) OVER (ORDER BY d) - 1 AS r1 FROM daily), l AS (SELECT n, n + 7 + n % 3 AS resolved, p, actual, r7, r1, row_number() OVER (ORDER BY n) - 1 AS i FROM y WHERE actual IS NOT NULL AND r7 IS NOT NULL),
b AS (SELECT (i - 365) // 30 AS block, min(n) AS s, max(n) AS e, min(i) AS f FROM l WHERE i >= 365 GROUP BY 1), folds AS (SELECT row_number() OVER (ORDER BY block) - 1 AS fold_index, * FROM b WHERE EXISTS (SELECT 1 FROM l WHERE l.resolved < s - 7))"""
_PRED = f"""{_DAYS}, j AS (SELECT fold_index, s, e, l.*, lag(actual) OVER (PARTITION BY fold_index ORDER BY n) AS prior FROM folds JOIN l ON resolved < s - 7),
r AS (SELECT fold_index, s, e, (sum(actual::int) + 1.0) / (count(*) + 2) AS b0, (coalesce(sum(actual::int) FILTER (prior), 0) + 1.0) / (count(*) FILTER (prior) + 2) AS yes, (coalesce(sum(actual::int) FILTER (NOT prior), 0) + 1.0) / (count(*) FILTER (NOT prior) + 2) AS no, arg_max(actual, n) AS last, avg(r7) AS m, CASE WHEN stddev_pop(r7) > 1e-12 THEN stddev_pop(r7) ELSE 1.0 END AS sd FROM j GROUP BY ALL),
t AS (SELECT fold_index, n, actual, b0, CASE WHEN last THEN yes ELSE no END AS b1, greatest(-35.0, least(35.0, ln(b0 / (1 - b0)) + (r7 - m) / sd)) AS up, greatest(-35.0, least(35.0, ln(b0 / (1 - b0)) - (r7 - m) / sd)) AS down FROM r JOIN l ON n BETWEEN s AND e),
pred AS (SELECT fold_index, n, actual, 'B0' AS kind, b0 AS score FROM t UNION ALL SELECT fold_index, n, actual, 'B1', b1 FROM t UNION ALL SELECT fold_index, n, actual, 'B2', 1 / (1 + exp(-up)) FROM t UNION ALL SELECT fold_index, n, actual, 'B3', 1 / (1 + exp(-down)) FROM t)"""


@query(f"WITH {_PRED} SELECT fold_index, n, kind, round(score, 6) AS score, actual FROM pred")
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("fold_index", "n", "kind", F.round("score", 6).alias("score"), "actual")


_METRICS = f"{_PRED}, m AS (SELECT kind, count(*) AS n, avg(actual::int) AS base_rate, avg((score - actual::int) ** 2) AS brier, avg(-(actual::int * ln(greatest(1e-12, least(1 - 1e-12, score))) + (1 - actual::int) * ln(1 - greatest(1e-12, least(1 - 1e-12, score))))) AS log_loss FROM pred GROUP BY 1)"


@query(f"WITH {_METRICS} SELECT kind, n, round(base_rate, 6) AS base_rate, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(base_rate * (1 - base_rate), 6) AS brier_reference, round(1 - brier / (base_rate * (1 - base_rate)), 4) AS brier_skill FROM m")
def calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.calibration(_predictions(spark, sf_dir), ["kind"])
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("base_rate", "brier", "log_loss", "brier_reference")), F.round("brier_skill", 4).alias("brier_skill"))


@query(f"WITH {_METRICS} SELECT a.kind, a.n, round(b.brier - a.brier, 6) AS brier_gain, round(a.log_loss - b.log_loss, 6) AS log_loss_change, b.brier - a.brier >= 0 AND a.log_loss - b.log_loss <= 0 AS passed FROM m a, m b WHERE a.kind <> 'B0' AND b.kind = 'B0'")
def skill_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = research.calibration(_predictions(spark, sf_dir), ["kind"])
    out = research.skill_gate(metrics.withColumn("cell", F.lit(1)), ["cell"], "kind")
    return out.select("kind", "n", F.round("brier_gain", 6).alias("brier_gain"), F.round("log_loss_change", 6).alias("log_loss_change"), "passed")


@query(f"""WITH {_PRED}, m AS (SELECT n % 4 AS cell, kind, count(*) AS n, avg(actual::int) AS base_rate, avg((score - actual::int) ** 2) AS brier, avg(-(actual::int * ln(greatest(1e-12, least(1 - 1e-12, score))) + (1 - actual::int) * ln(1 - greatest(1e-12, least(1 - 1e-12, score))))) AS log_loss FROM pred GROUP BY 1, 2),
g AS (SELECT a.cell, a.kind, a.brier, a.log_loss, CASE WHEN a.kind = 'B0' THEN 'REFERENCE_BASELINE' WHEN a.n >= 50 AND round(a.base_rate * a.n) >= 5 AND a.n - round(a.base_rate * a.n) >= 5 AND b.brier - a.brier >= 0 AND a.log_loss - b.log_loss <= 0 THEN 'ELIGIBLE_CHALLENGER' ELSE 'REJECTED' END AS state FROM m a JOIN m b ON a.cell = b.cell AND b.kind = 'B0')
SELECT cell, count_if(state = 'ELIGIBLE_CHALLENGER') AS eligible, arg_min(kind, brier) FILTER (state = 'ELIGIBLE_CHALLENGER') AS challenger, string_agg(kind || ':' || state, ',' ORDER BY kind) AS entries FROM g GROUP BY 1""")
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each kind of model, by cell (days by their remainder by 4), and the challenger of each."""
    metrics = research.calibration(_predictions(spark, sf_dir).withColumn("cell", F.col("n") % 4), ["cell", "kind"])
    entries, cells = research.model_registry(metrics, ["cell"])
    listed = entries.groupBy("cell").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(":"), "state"))), ",").alias("entries"))  # a kind each
    return cells.join(listed, "cell")


_SCORED = "s AS (SELECT lang, quality = 1 AS actual, least(1.0, round(n_chars / 8000.0, 3)) AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("actual"), F.least(F.lit(1.0), F.round(F.col("n_chars") / 8000.0, 3)).alias("score"))


@query(f"WITH {_SCORED}, b AS (SELECT lang, least(9, cast(floor(round(score * 1000) / 100) AS int)) AS bin, count(*) AS n, avg(score) AS mean_score, avg(actual::int) AS rate FROM s GROUP BY 1, 2) SELECT lang, bin, n, round(mean_score, 4) AS mean_score, round(rate, 4) AS rate FROM b")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.reliability_bins(_scored(spark, sf_dir), ["lang"]))


@query(f"WITH {_SCORED}, b AS (SELECT lang, least(9, cast(floor(round(score * 1000) / 100) AS int)) AS bin, count(*) AS n, avg(score) AS m, avg(actual::int) AS r FROM s GROUP BY 1, 2) SELECT lang, round(sum(abs(m - r) * n) / sum(n), 4) AS ece, round(max(abs(m - r)), 4) AS max_gap FROM b GROUP BY 1")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.expected_calibration_error(research.reliability_bins(_scored(spark, sf_dir), ["lang"]), ["lang"]))


@query(f"WITH {_SCORED}, r AS (SELECT lang, actual, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS k FROM s), g AS (SELECT lang, count(*) AS n, sum(actual::int) AS pos, sum(k) FILTER (actual) AS t FROM r GROUP BY 1) SELECT lang, n, round(CASE WHEN pos > 0 AND n > pos THEN (t - pos * (pos + 1) / 2.0) / (pos * (n - pos)) END, 6) AS auc FROM g")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.roc_auc(_scored(spark, sf_dir), ["lang"]).select("lang", "n", F.round("auc", 6).alias("auc"))


@query("""WITH h AS (SELECT DISTINCT c_mktsegment AS horizon FROM customer), e AS (SELECT DISTINCT o_orderpriority AS event FROM orders), c AS (SELECT c_mktsegment AS horizon, o_orderpriority AS event, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000 GROUP BY 1, 2)
SELECT horizon, event, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'MISSING' WHEN n >= 50 THEN 'READY' ELSE 'THIN' END AS state FROM h CROSS JOIN e LEFT JOIN c USING (horizon, event)""")
def research_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cells = orders.where("o_totalprice > 250000").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("horizon"), F.col("o_orderpriority").alias("event")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("state", F.when(F.col("n") >= 50, "READY").otherwise("THIN"))
    out = research.research_matrix(customers.select(F.col("c_mktsegment").alias("horizon")).distinct(), orders.select(F.col("o_orderpriority").alias("event")).distinct(), cells)
    return out.select("horizon", "event", F.coalesce("n", F.lit(0)).alias("n"), "state")


#: Components of the vectors in embeddings.
_SIZE = 64


def _near(spark: SparkSession, sf_dir: str, metric: str, prior: bool = False) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 100, among all rows, or all earlier ones; components
    are normalised by all rows."""
    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = raw.select("vec_id", analogs.normalised(F.col("v"), *analogs.normaliser(raw, "v", _SIZE)).alias("v"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("query_vector"), F.col("vec_id").alias("query_order"))
    return analogs.nearest(asked, v, "v", "vec_id", 5, metric, prior_only=prior)


_DIST = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])))",
    "cosine": "1 - list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))))",
}
_VECTORS = """e AS (SELECT vec_id, unnest(cast(embedding AS double[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1.0 END AS s FROM e GROUP BY i), v AS (SELECT vec_id, list((x - m) / s ORDER BY i) AS v FROM e JOIN st USING (i) GROUP BY vec_id)"""


def _near_sql(metric: str, name: str = "k", prior: bool = False) -> str:
    which = "b.vec_id < a.vec_id" if prior else "b.vec_id <> a.vec_id"
    return f"{name} AS (SELECT * FROM (SELECT query, candidate, distance, row_number() OVER (PARTITION BY query ORDER BY distance, candidate) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS candidate, {_DIST[metric]} AS distance FROM v a JOIN v b ON {which} WHERE a.vec_id % 100 = 0)) WHERE rank <= 5)"


def _knn(metric: str):
    QUERIES[f"knn_{metric}"] = lambda spark, sf_dir: rounded(_near(spark, sf_dir, metric).withColumn("rank", F.col("rank").cast("bigint")))
    SQL[f"knn_{metric}"] = f"WITH {_VECTORS}, {_near_sql(metric)} SELECT query, candidate, round(distance, 4) AS distance, rank FROM k"


for _metric in _DIST:
    _knn(_metric)


@query(f"WITH {_VECTORS}, {_near_sql('euclidean', prior=True)} SELECT query, count(*) AS n, round(greatest(0.0, least(1.0, (0.5 + sum((label % 2) / (1 + distance))) / (1 + sum(1 / (1 + distance))))), 4) AS probability FROM k JOIN embeddings ON candidate = vec_id GROUP BY 1")
def analog_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir, "euclidean", prior=True).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("candidate"), "label"), "candidate")
    return rounded(analogs.vote(near, F.col("label") % 2))


@query(f"WITH {_VECTORS}, {_near_sql('euclidean', 'k', True)}, {_near_sql('cosine', 'c', True)}, x AS (SELECT query, list(candidate) AS a FROM k GROUP BY 1), y AS (SELECT query, list(candidate) AS b FROM c GROUP BY 1) SELECT query, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS jaccard FROM x JOIN y USING (query)")
def analog_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analogs.overlap(_near(spark, sf_dir, "euclidean", prior=True), _near(spark, sf_dir, "cosine", prior=True)))


@query(f"""WITH {_VECTORS}, {_near_sql('euclidean', prior=True)}, p AS (SELECT query, greatest(0.0, least(1.0, (0.5 + sum((label % 2) / (1 + distance))) / (1 + sum(1 / (1 + distance))))) AS score FROM k JOIN embeddings ON candidate = vec_id GROUP BY 1), b AS (SELECT (sum(label % 2) + 1.0) / (count(*) + 2) AS base FROM embeddings WHERE vec_id % 100 <> 0),
x AS (SELECT label % 2 AS y, greatest(1e-12, least(1 - 1e-12, score)) AS s, base FROM p JOIN embeddings ON query = vec_id, b)
SELECT count(*) AS n, round(avg((base - y) ** 2) - avg((s - y) ** 2), 6) AS brier_gain, round(avg(-(y * ln(s) + (1 - y) * ln(1 - s))) - avg(-(y * ln(base) + (1 - y) * ln(1 - base))), 6) AS log_loss_change, count(*) >= 50 AND sum(y) >= 5 AND count(*) - sum(y) >= 5 AND avg((base - y) ** 2) >= avg((s - y) ** 2) AND avg(-(y * ln(s) + (1 - y) * ln(1 - s))) <= avg(-(y * ln(base) + (1 - y) * ln(1 - base))) AS passed FROM x""")
def analog_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of earlier analogs against the rate of all other rows, on the rows that have analogs."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2 == 1).alias("actual"))
    votes = analogs.vote(_near(spark, sf_dir, "euclidean", prior=True).join(rows.withColumnRenamed("vec_id", "candidate"), "candidate"), F.col("actual"))
    mine = votes.select(F.col("query").alias("vec_id"), F.col("probability").alias("score")).join(rows, "vec_id")
    base = rows.where("vec_id % 100 <> 0").agg(research.smoothed_rate(F.col("actual")).alias("score"))  # one row
    out = research.challenger_on_subset(mine, rows.where("vec_id % 100 = 0").select("vec_id").crossJoin(F.broadcast(base)), ["vec_id"], "ANALOG")
    return out.select("n", F.round("brier_gain", 6).alias("brier_gain"), F.round("log_loss_change", 6).alias("log_loss_change"), "passed")


#: The base scenario of the grid and those that it must stand in: metrics, components left out, a look-back, a provider.
_GRID = [
    analog_search.Scenario("base", min_history=10, same_regime=True),
    *(analog_search.Scenario(f"{m}{'_less' * bool(x)}", m, x, min_history=10, same_regime=True) for m in analog_search.METRICS for x in ((), tuple(range(8)))),
    analog_search.Scenario("lookback", lookback=300, min_history=10), analog_search.Scenario("provider", "manhattan", providers=("p1",), k=3, min_history=10),
]


def _grid_sql() -> str:
    """The matches and the number of candidates of each scenario, as tables m and c."""
    parts, counts = [], []
    for s in _GRID:
        where = "b.known < a.vec_id AND b.vec_id <> a.vec_id" + " AND a.regime = b.regime" * s.same_regime + (f" AND b.vec_id >= a.vec_id - {s.lookback}" if s.lookback else "") + (f" AND b.provider IN ({', '.join(repr(p) for p in s.providers)})" if s.providers else "")
        far = {"euclidean": "sqrt(sum((x - y) ** 2))", "manhattan": "sum(abs(x - y))", "cosine": "1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))"}[s.metric]
        n = s.name
        parts.append(f"""{n}_p AS (SELECT a.vec_id AS query, b.vec_id AS candidate FROM h a JOIN h b ON {where} WHERE a.vec_id % 100 = 0),
{n}_s AS (SELECT query, i, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1.0 END AS s FROM {n}_p JOIN e ON candidate = vec_id WHERE i > {len(s.excluded)} GROUP BY 1, 2),
{n}_d AS (SELECT query, candidate, {far} AS distance FROM (SELECT p.query, candidate, (c.x - m) / s AS x, (q.x - m) / s AS y FROM {n}_p p JOIN {n}_s t ON p.query = t.query JOIN e c ON c.vec_id = candidate AND c.i = t.i JOIN e q ON q.vec_id = p.query AND q.i = t.i) GROUP BY 1, 2),
{n}_r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, candidate) AS rank, count(*) OVER (PARTITION BY query) AS n FROM {n}_d)""")
        counts.append(f"SELECT '{n}' AS scenario, query, candidate, distance, rank FROM {n}_r WHERE rank <= {s.k} AND n >= {s.min_history}")
    return f"""h AS (SELECT vec_id, vec_id + vec_id % 3 AS known, 'r' || (label % 3) AS regime, 'p' || (vec_id % 2) AS provider FROM embeddings), e AS (SELECT vec_id, unnest(cast(embedding AS double[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), {', '.join(parts)}, m AS ({' UNION ALL '.join(counts)})"""


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The grid's matches and states of every row whose id is divisible by 100, and each row's regime."""
    c = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(c.alias("time"), (c + c % 3).alias("known"), F.concat(F.lit("r"), (F.col("label") % 3).cast("string")).alias("regime"), F.concat(F.lit("p"), (c % 2).cast("string")).alias("provider"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = rows.where("time % 100 = 0").select(F.col("time").alias("query"), "time", F.col("time").alias("cutoff"), "regime", "v")
    matches, states, _ = analog_search.search(analog_search.build(rows, _SIZE, sorted({s.excluded for s in _GRID})), asked, _GRID)
    return matches, states, rows.select(F.col("time").alias("candidate"), "regime")


@query(f"WITH {_grid_sql()} SELECT scenario, query, candidate, round(distance, 4) AS distance, cast(rank AS int) AS rank FROM m")
def analog_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest earlier analogs in every scenario, each query normalised by what it is compared with, in one pass."""
    return rounded(_searched(spark, sf_dir)[0]).select("scenario", "query", "candidate", "distance", "rank")


@query(f"""WITH {_grid_sql()}, l AS (SELECT scenario, query, list(candidate) AS found, min(candidate) FILTER (rank = 1) AS nearest FROM m GROUP BY 1, 2), g AS (SELECT l.*, regime FROM l JOIN h ON nearest = vec_id), b AS (SELECT query, found AS base, regime AS base_regime FROM g WHERE scenario = 'base'),
x AS (SELECT query, count(*) AS ready, min(len(list_intersect(found, base)) / len(list_distinct(list_concat(found, base)))) AS min_overlap, avg((regime = base_regime)::int) AS agreement FROM g JOIN b USING (query) WHERE scenario <> 'base' GROUP BY 1),
y AS (SELECT a.vec_id AS query, b.query IS NOT NULL AS good, cast(coalesce(ready, 0) AS bigint) AS ready, min_overlap, agreement FROM h a LEFT JOIN b ON b.query = a.vec_id LEFT JOIN x ON x.query = a.vec_id WHERE a.vec_id % 100 = 0)
SELECT query, ready, round(min_overlap, 4) AS min_overlap, round(agreement, 4) AS agreement, CASE WHEN NOT good THEN 'BASE_NOT_READY' ELSE concat_ws(',', CASE WHEN ready < 3 THEN 'FEW_READY' END, CASE WHEN coalesce(min_overlap < 0.4, true) THEN 'OVERLAP' END, CASE WHEN coalesce(agreement < 0.6, true) THEN 'REGIME' END) END AS reasons FROM y""")
def analog_grid_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the analogs of the base scenario stand in the others."""
    out = analog_search.sensitivity(*_searched(spark, sf_dir), "base")
    return rounded(out.select("query", "ready", "min_overlap", "agreement", F.array_join("reasons", ",").alias("reasons")))


#: Scenarios of the challenger by folds: of days of the same regime, with all components or without the third.
FOLD_GRID = [analog_search.Scenario("base", min_history=10, same_regime=True), *(analog_search.Scenario(f"{m}{'_less' * bool(x)}", m, x, min_history=10, same_regime=True) for m in analog_search.METRICS for x in ((), (2,)))]


def fold_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(days, tests): n, resolved, actual, signal r7, regime and vector of each day; the days of all test blocks with their
    fold, cutoff and the rate of what the fold was trained on."""
    p, w = F.col("p"), _series("n")
    r7 = timeseries.trailing_return(p, w, 7)
    days = _labelled(spark, sf_dir).withColumns({"actual": F.lead("p", 7).over(w) > p, "r1": timeseries.trailing_return(p, w, 1), "r7": r7, "r30": timeseries.trailing_return(p, w, 30), "level": p / F.avg(p).over(w.rowsBetween(-29, 0)) - 1}).dropna()
    days = days.withColumns({"regime": F.when(F.col("r30") > 0.1, "UP").when(F.col("r30") < -0.1, "DOWN").otherwise("FLAT"), "v": F.array("r1", "r7", "r30", "level")})
    folds = F.broadcast(research.walk_forward_folds(days, "n", "resolved", 365, 30, 7).select("fold_index", "test_start", "test_end"))  # a row a block
    rates = days.join(folds, F.col("resolved") < F.col("test_start") - 7).groupBy("fold_index").agg(research.smoothed_rate(F.col("actual")).alias("prior"))
    tests = days.join(folds, F.col("n").between(F.col("test_start"), F.col("test_end"))).join(rates, "fold_index")
    return days, tests.select("fold_index", F.col("n").alias("query"), F.col("n").alias("time"), (F.col("test_start") - 7).alias("cutoff"), "regime", "v", "actual", "prior")


def _fold_votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    days, tests = (kept(x, "days") for x in fold_days(spark, sf_dir))
    c = F.col
    history = days.select(c("n").cast("bigint").alias("time"), c("resolved").cast("bigint").alias("known"), "regime", F.lit("p").alias("provider"), "v")
    matches, states, _ = analog_search.search(analog_search.build(history, 4, sorted({s.excluded for s in FOLD_GRID})), tests.select(*(c(k).cast("bigint").alias(k) for k in ("query", "time", "cutoff")), "regime", "v"), FOLD_GRID)
    stable = analog_search.sensitivity(matches, states, history.select(c("time").alias("candidate"), "regime"), "base")
    outcomes = days.select(c("n").alias("candidate"), c("actual").alias("outcome"))
    return days, analog_search.fold_votes(tests.select("fold_index", "query", "actual", "prior"), matches, states, stable, "base", outcomes)


@query()
def analog_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of each test day's analogs among what its fold was trained on, or why it has none; tests hold it against plain
    loops. A fold is a cutoff of one index, not a copy of its training set."""
    out = _fold_votes(spark, sf_dir)[1]
    return out.select("fold_index", F.col("query").alias("n"), "actual", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query()
def analog_fold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analogs' votes against the best baseline that is reference or eligible, on the days that they answer."""
    days, votes = _fold_votes(spark, sf_dir)
    votes = kept(votes, "votes")
    baselines = research.oos_predictions(days, "n", "resolved", "actual", "r7", 365, 30, 7).select(F.col("n").alias("query"), "kind", "score", "actual")
    entries, _ = research.model_registry(research.calibration(baselines.withColumn("cell", F.lit(1)), ["cell", "kind"]), ["cell"])
    out = research.challenger_evidence(votes.where("score is not null").select("query", "score", "actual"), votes.count(), baselines, entries.where("state <> 'REJECTED'"), ["query"])
    return rounded(out.withColumn("reasons", F.array_join("reasons", ",")))


@query("SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_orderkey) AS keys, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY 1")
def sink_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders committed in three batches, each of which comes twice, and one more that repeats rows of all of them: what is
    there is every order once."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), fresh_path(spark, "orders")
    for k in (0, 1, 2, 0, 1, 2):
        commits.commit(orders.where(F.col("o_orderkey") % 3 == k), path, f"batch-{k}", {"batch": k}, "o_orderkey", ["o_custkey"])
    commits.commit(orders.where("o_orderkey % 5 = 0"), path, "batch-again", None, "o_orderkey")
    there = commits.committed(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string")
    return there.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_orderkey) AS keys, sum(o_custkey)::BIGINT AS customers, count(DISTINCT o_orderkey // 4096) AS pages, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def paged_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as pages of keys, each with the cursor of the next, in two goes; the stream of pages runs after each,
    and after the last once more, and its sink holds every order once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.floor(F.col("o_orderkey") / 4096).alias("block"))
    blocks = orders.groupBy("block").agg(F.to_json(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderpriority")))).alias("payload"))  # 4,096 keys at most
    numbers = orders.select("block").distinct().select("block", F.lead("block").over(Window.partitionBy(F.lit(0)).orderBy("block")).alias("next"))  # numbers of pages
    cursor = lambda c: F.when(c.isNotNull(), F.to_json(F.struct(c.alias("block"))))
    stated = {"dataset": "orders", "provider": "table", "source_id": "orders", "fetched_at": "2026-01-01T00:00:00Z"}
    made = kept(blocks.join(numbers, "block").select("block", cursor(F.col("block")).alias("cursor"), cursor(F.col("next")).alias("following"), "payload", *(F.lit(v).alias(k) for k, v in stated.items()), F.concat(F.lit("fetch-"), "block").alias("fetch_id")), "pages")
    folder, path, kinds = fresh_path(spark, "landed"), fresh_path(spark, "backfilled"), "o_orderkey bigint, o_custkey bigint, o_orderpriority string"
    ends = made.agg(F.min("block").alias("first"), F.max("block").alias("last")).first()
    if ends.first is not None:
        rows = lambda items: items.select(F.from_json("item", kinds).alias("x"), "page").select("x.*", "page")
        middle = (ends.first + ends.last) // 2
        for part in ("block <= {}", "block > {}", "false"):
            paged.land(made.where(part.format(middle)), folder)
            paged.backfill(spark, folder, path, {"block": ends.first}, rows, max_pages=1 << 31)
    there = commits.committed(spark, path, f"{kinds}, page bigint")
    return there.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"), F.count_distinct("page").alias("pages"), F.min("o_orderkey").alias("first_key"))


@query(r"SELECT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS claim, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(semantic.claim_id(F.col("text")).alias("claim")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_TOKENS = r"w AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\pL\pN\pM_.-]+')) AS t FROM benchmark) GROUP BY 1, 2)"


@query(f"WITH {_TOKENS} SELECT item_id, cast('0x' || substr(sha256(t), 1, 8) AS bigint) AS index, cast(sum(n) AS double) AS weight FROM w GROUP BY 1, 2")
def sparse_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.sparse_lexical(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"WITH {_TOKENS}, r AS (SELECT item_id, cast('0x' || substr(sha256(t), 1, 8) AS bigint) % 64 AS index, sum(n * CASE WHEN cast('0x' || substr(sha256(t), 9, 2) AS bigint) % 2 = 1 THEN -1 ELSE 1 END) AS v FROM w GROUP BY 1, 2) SELECT item_id, index, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 4) AS value FROM r WHERE v <> 0")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(semantic.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def _redact_sql() -> str:
    names = "(?:api[_-]?key|apikey|access[_-]?key|secret(?:[_-]?key)?|client[_-]?secret|(?:access|refresh|auth|id)?[_-]?token|password|passwd|pwd|signature|sig)"
    steps = (
        (r"(authorization\s*[=:]\s*[\"'']?(?:(?:basic|bearer|digest|token)\s+)?)[^\s,\"'']+", r"\1[REDACTED]"), (r"\b(bearer\s+)[A-Za-z0-9\-._~+/]+=*", r"\1[REDACTED]"), (r"\b([a-z][a-z0-9+.-]*://)[^\s/?#@]+@", r"\1[REDACTED]@"),
        (rf"\b({names}[\"'']?\s*[=:]\s*[\"'']?)[^\s,;&#\"'']+", r"\1[REDACTED]"), (r"([?&]key=)[^\s&#,;\"'']+", r"\1[REDACTED]"),
    )
    text = "x"
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'gi')"
    return f"WITH t AS (SELECT doc_id AS id, text AS x FROM documents UNION ALL SELECT -1 - page_id, 'GET ' || url || '?api_key=k' || page_id || '&y=1' || chr(10) || 'Authorization: Basic dTpw' || page_id || chr(10) || 'Bearer abc+def/gh==' FROM pages) SELECT id, sha256({text}) AS digest FROM t"


@query(_redact_sql())
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and requests for pages with secrets in addresses and headers."""
    request = F.concat(F.lit("GET "), "url", F.lit("?api_key=k"), F.col("page_id").cast("string"), F.lit("&y=1\nAuthorization: Basic dTpw"), F.col("page_id").cast("string"), F.lit("\nBearer abc+def/gh=="))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(table(spark, sf_dir, "pages").select(-1 - F.col("page_id"), request))
    return rows.select("id", F.sha2(semantic.redacted(F.col("text")), 256).alias("digest"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)') THEN regexp_replace(url, '#.*$', '') END AS uri FROM pages")
def uri_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", semantic.sanitized_uri(F.col("url")).alias("uri"))


@query("SELECT trim(lower(n_name)) || '-' || cast(c_custkey % 7 AS varchar) AS alias, count(DISTINCT c_mktsegment) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def entity_alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return semantic.alias_conflicts(rows.withColumn("alias", F.concat("n_name", F.lit("-"), (F.col("c_custkey") % 7).cast("string"))), "alias", "c_mktsegment")


@query("WITH l AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), z AS (SELECT a, b FROM l UNION SELECT b, a FROM l), k AS (SELECT p_partkey AS c FROM part) SELECT a, b FROM z WHERE a <> b AND a IN (FROM k) AND b IN (FROM k)")
def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.contradictions(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), "l_partkey", "l_suppkey", "p_partkey")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, (o_orderstatus = 'O')::int AS fresh FROM orders) SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, fresh FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fresh DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM b) WHERE rn = 1""")
def snapshot_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", (F.col("o_orderstatus") == "O").cast("int").alias("fresh"))
    out = store.upserted(rows.where("fresh = 0"), rows.where("fresh = 1"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return out.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"), "fresh")


@query("""WITH p AS (SELECT o_orderkey AS k, count(*) AS c FROM orders GROUP BY 1), o AS (SELECT l_orderkey AS k, count(*) AS c FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN o.c IS NULL THEN 'MISSING' WHEN p.c IS NULL THEN 'ORPHAN' ELSE 'REPEATED' END AS problem FROM p FULL JOIN o USING (k) WHERE o.c IS NULL OR p.c IS NULL OR o.c > 1 OR p.c > 1""")
def ledger_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.resolved_pairs(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), "k")[1]


_PAIRS = "p AS (SELECT o_orderkey AS k, o_orderpriority AS event, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 4 END AS horizon, cast(o_orderdate AS date) AS at FROM orders), o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'other' ELSE o_orderpriority END AS event, CASE WHEN o_custkey % 11 > 0 THEN (o_custkey + (o_orderkey % 40 = 0)::int) % 4 END AS horizon, cast(o_orderdate AS date) + (o_orderkey % 70 = 0)::int AS at, cast(o_orderdate AS date) + (o_orderkey % 30)::int AS resolved, CASE WHEN o_orderkey % 90 > 0 THEN cast(o_orderdate AS date) + 2 END AS ends FROM orders)"


@query(f"""WITH {_PAIRS}, j AS (SELECT k, p.event <> o.event AS e, p.horizon IS DISTINCT FROM o.horizon AS h, p.at <> o.at AS t, NOT coalesce(resolved >= ends, false) AS early FROM p JOIN o USING (k))
SELECT k, 'MISMATCH:event' AS problem FROM j WHERE e UNION ALL SELECT k, 'MISMATCH:horizon' FROM j WHERE h UNION ALL SELECT k, 'MISMATCH:at' FROM j WHERE t UNION ALL SELECT k, 'EARLY' FROM j WHERE early""")
def resolution_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions, and as outcomes some of which are of another event, horizon or time, or came too early."""
    orders = table(spark, sf_dir, "orders")
    k, c, at = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    known = lambda x: F.when(c % 11 > 0, x)
    made = orders.select(k.alias("k"), F.col("o_orderpriority").alias("event"), known(c % 4).alias("horizon"), at.alias("at"))
    came = orders.select(k.alias("k"), F.when(k % 50 == 0, "other").otherwise(F.col("o_orderpriority")).alias("event"), known((c + (k % 40 == 0).cast("int")) % 4).alias("horizon"), F.date_add(at, (k % 70 == 0).cast("int")).alias("at"), F.date_add(at, (k % 30).cast("int")).alias("resolved"), F.when(k % 90 > 0, F.date_add(at, 2)).alias("ends"))
    return store.pair_mismatches(made, came, "k", ["event", "horizon", "at"], "resolved", "ends")


@query("SELECT event_type, cast(ts AS date) AS day, count(*) AS n, cast(floor(epoch(min(ts))) AS bigint) AS first_at, cast(floor(epoch(max(ts))) AS bigint) AS last_at FROM events GROUP BY 1, 2")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.manifest(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], F.col("event_id"), "ts")
    return out.select("event_type", "day", "n", *(F.floor(microstructure.epoch(F.col(c))).alias(c) for c in ("first_at", "last_at")))


@query("SELECT * FROM (SELECT s_suppkey AS entity, 'acctbal' AS metric, round(s_acctbal, 2) AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', cast(s_nationkey AS double) FROM supplier)")
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.round("s_acctbal", 2).alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot(["entity"], ["acctbal", "nation"], "metric", "value")


@query("SELECT event_type, cast(epoch(date_trunc('hour', ts)) AS bigint) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.streaming import tumbling

    out = tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], F.col("value"))
    return out.select("event_type", F.col("window_start").cast("bigint").alias("hour"), "n", F.round("total", 4).alias("total"))


_STREAMED = (300, 900, 3600)


@query(f"""WITH s AS (SELECT event_type, value, epoch(ts) AS t, epoch(ts) + {_AVAILABLE} AS av, epoch(ts) + {_FETCHED} AS fe, CASE WHEN user_id % 3 = 0 THEN value END AS oi FROM events), k AS (SELECT *, ceil(fe / 3600) * 3600 AS moment, (t, av, fe, value) AS o FROM s),
w AS (SELECT moment, event_type, seconds, count(*) AS n, min_by(value, o) AS f, max_by(value, o) AS l, sum(value) AS total, CASE WHEN count(oi) >= 2 THEN min_by(oi, o) FILTER (oi IS NOT NULL) END AS oi0, CASE WHEN count(oi) >= 2 THEN max_by(oi, o) FILTER (oi IS NOT NULL) END AS oi1, min(t) AS a, max(t) AS b, max_by(fe, o) AS c
  FROM k JOIN (VALUES {', '.join(f'({x})' for x in _STREAMED)}) AS x(seconds) ON t > moment - seconds WHERE moment <= (SELECT max(fe) FROM s) - 600 GROUP BY 1, 2, 3),
g AS (SELECT *, CASE seconds {' '.join(f'WHEN {x} THEN {_LIMITS[x][0]}' for x in _STREAMED)} END AS fresh, CASE seconds {' '.join(f'WHEN {x} THEN {_LIMITS[x][1]}' for x in _STREAMED)} END AS late FROM w)
SELECT cast(moment AS bigint) AS moment, event_type, cast(seconds AS bigint) AS seconds, n, round(f, 4) AS first_value, round(l, 4) AS last_value, round(total, 4) AS total, round((l / f - 1) * 1e4, 2) AS return_bps, round(oi0, 4) AS interest_first, round(oi1, 4) AS interest_last, round(moment - b, 3) AS age_seconds, round(c - b, 3) AS lag_seconds, moment - b <= fresh AND round(c - b, 3) <= late AS regime_eligible,
  concat_ws(',', CASE WHEN n < 2 OR b - a < 0.5 * seconds THEN 'SPARSE_WINDOW' END, CASE WHEN oi0 IS NULL THEN 'INTEREST_NO_DATA' END, CASE WHEN moment - b > fresh THEN 'STALE_WINDOW' END, CASE WHEN round(c - b, 3) > late THEN 'INGESTION_LAG' END) AS flags FROM g""")
def stream_pit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of every hour as a stream sends them: all that the watermark, ten minutes behind, has passed."""
    samples = _samples(spark, sf_dir).select("event_type", "value", "user_id", *(F.col(c).cast("timestamp").alias(c) for c in ("ts", "available", "fetched")))
    stream = as_stream(samples, "samples")
    out = drained(sliding_windows(stream, 3600, _STREAMED, "ts", F.col("value"), F.col("available"), F.col("fetched"), ["event_type"], "10 minutes", series={"interest": F.when(F.col("user_id") % 3 == 0, F.col("value"))}), "windows")
    return out.select(microstructure.epoch(F.col("at")).cast("bigint").alias("moment"), "event_type", "seconds", "n", *(F.round(c, k).alias(c) for c, k in (("first_value", 4), ("last_value", 4), ("total", 4), ("return_bps", 2), ("interest_first", 4), ("interest_last", 4), ("age_seconds", 3), ("lag_seconds", 3))), "regime_eligible", F.array_join("flags", ",").alias("flags"))


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as order books of users: every tenth event of a user is a snapshot, the others change a level of each side;
    some skip a number, some lack their clocks."""
    e, own = table(spark, sf_dir, "events"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    e = e.withColumn("number", F.row_number().over(own).cast("bigint"))
    level = lambda price, quantity: F.struct(price.cast("double").alias("price"), quantity.cast("double").alias("quantity"))
    some = F.when(k % 4 == 0, 0).otherwise(F.ceil(F.col("value") / 10))
    whole, first = F.col("number") % 10 == 1, F.col("number") + F.when(k % 37 == 0, 1).otherwise(0)
    full = lambda low: F.array(*(level(F.lit(low + i), F.lit(1 + i % 3)) for i in range(5)))
    clock = F.when(k % 11 > 0, at)
    return e.select(
        F.col("user_id").alias("symbol"), F.when(whole, "snapshot").otherwise("delta").alias("kind"), first.alias("first_id"), F.greatest(first, F.col("number")).alias("last_id"), at.alias("observed_at"), clock.alias("available_at"), clock.alias("fetched_at"),
        F.when(whole, full(95)).otherwise(F.array(level(95 + k % 7, some))).alias("bids"), F.when(whole, full(101)).otherwise(F.array(level(101 + k % 6, some))).alias("asks"),
    )


#: Seconds after which a book is silent, and seconds by which the watermark is behind.
BOOK_SILENCE, BOOK_DELAY = 86_400, 60


@query()
def stream_order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of users with their three best levels and the dynamics of each change, from a stream; tests hold it against a
    plain loop."""
    out = drained(books(as_stream(book_events(spark, sf_dir), "book"), "symbol", f"{BOOK_DELAY} seconds", BOOK_SILENCE, 3), "books")
    side = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("x", x["price"].cast("string"), x["quantity"].cast("string"))), ",").alias(c)
    return rounded(out.select("symbol", F.unix_micros("observed_at").alias("observed_us"), "first_id", "last_id", "state", "problem", side("bids"), side("asks"), "elapsed_seconds", "bid_added", "bid_removed", "ask_added", "ask_removed", "provenance_complete", F.array_join("flags", ",").alias("flags")))


@query("""WITH RECURSIVE a AS (SELECT DISTINCT event_type AS key, ts FROM events WHERE value > 50), k AS (SELECT key, min(ts) AS ts FROM a GROUP BY key UNION ALL SELECT k.key, min(a.ts) AS ts FROM k JOIN a ON a.key = k.key AND a.ts >= k.ts + INTERVAL 4 HOUR GROUP BY k.key)
SELECT key, epoch_us(ts) AS fired FROM k""")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.streaming import cooled

    hot = table(spark, sf_dir, "events").where("value > 50").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return cooled(hot, "key", "ts", 4 * 3600).select("key", F.unix_micros("ts").alias("fired"))


def _logistic_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, w = F.col("p"), _series("n")
    days = _labelled(spark, sf_dir).select("n", "resolved", (F.lead("p", 7).over(w) > p).alias("actual"), timeseries.trailing_return(p, w, 1).alias("r1"), timeseries.trailing_return(p, w, 7).alias("r7")).dropna()
    return days, F.broadcast(research.walk_forward_folds(days, "n", "resolved", 365, 30, 7).select("fold_index", "test_start", "test_end"))


@query()
def baseline_b4_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's logistic model and its predictions of the fold's days; tests hold it against plain loops."""
    days, folds = _logistic_days(spark, sf_dir)
    fits = research.fit_logistic(days.join(folds, F.col("resolved") < F.col("test_start") - 7), ["fold_index"], ["r1", "r7"], ["n"])
    tests = days.join(folds, F.col("n").between(F.col("test_start"), F.col("test_end"))).select("fold_index", "n", "actual", "r1", "r7")
    return research.predict_logistic(tests, fits, ["fold_index"], ["r1", "r7"]).select("fold_index", "n", "actual", "kind", F.round("score", 6).alias("score"))


@query()
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of each language's scores, and what it does to them; tests hold it against plain Newton steps."""
    scored = _scored(spark, sf_dir)
    fits = research.platt(scored, ["lang"])
    return rounded(fits.join(research.platt_evaluation(scored, fits, ["lang"]).drop("n"), "lang"))


@query("""WITH RECURSIVE o AS (SELECT o_orderpriority AS event, o_orderkey, cast(o_orderdate AS timestamp) AS t, cast(o_orderdate AS timestamp) + to_days((o_orderkey % 90)::int) AS done, (o_custkey % 97 + 1) / 99.0 AS score, (o_custkey % 97 > 48) = (o_orderkey % 5 > 1) AS actual FROM orders),
c AS (SELECT *, done < TIMESTAMP '1997-01-01' AND t < TIMESTAMP '1997-01-01' AS used FROM o), n AS (SELECT event, count_if(used) AS n, count_if(NOT used) AS purged, count_if(used AND actual) AS positives, count_if(t >= TIMESTAMP '1997-01-01') AS later, count_if(t < TIMESTAMP '1997-01-01') AS refused FROM c GROUP BY 1),
x AS (SELECT event, ln(score / (1 - score)) AS x, count(*) AS m, sum(actual::int) AS y FROM c WHERE used GROUP BY 1, 2),
r AS (SELECT event, 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM n UNION ALL SELECT event, i + 1, CASE WHEN h0 * h2 - h1 * h1 > 1e-15 THEN a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) END, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
  SELECT event, i, a, b, sum(y - m * p) AS g0, sum((y - m * p) * x) AS g1, sum(m * p * (1 - p)) AS h0, sum(m * p * (1 - p) * x) AS h1, sum(m * p * (1 - p) * x * x) AS h2 FROM (SELECT r.*, x.x, x.m, x.y, 1 / (1 + exp(-(a + b * x.x))) AS p FROM r JOIN x USING (event) WHERE i < 25) GROUP BY event, i, a, b)),
f AS (SELECT event, a, b FROM r JOIN n USING (event) WHERE i = 25 AND isfinite(a + b) AND n >= 20 AND least(positives, n - positives) >= 5), z AS (SELECT event, avg(1 / (1 + exp(-(a + b * ln(score / (1 - score)))))) AS mean FROM c JOIN f USING (event) WHERE t >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT event, n, purged, positives, round(a, 5) AS a, round(b, 5) AS b, later, refused, round(mean, 5) AS mean_calibrated FROM n JOIN f USING (event) JOIN z USING (event)""")
def platt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrators of each priority's predictions, fitted on what was resolved before 1997, and what they make of all
    predictions: later ones are calibrated, earlier ones refused."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    part = F.col("o_custkey") % 97
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("event"), k.alias("prediction_id"), at.alias("prediction_time"), F.timestamp_micros(F.unix_micros(at) + k % 90 * 86_400_000_000).alias("resolved_at"), ((part + 1) / 99).alias("score"), ((part > 48) == (k % 5 > 1)).alias("actual"))
    fits, _ = calibration.platt_candidates(rows, ["event"], F.lit("1997-01-01").cast("timestamp"))
    good, no = calibration.apply_candidates(rows.drop("resolved_at", "actual"), fits, ["event"])
    counts = no.join(rows.select("prediction_id", "event"), "prediction_id").groupBy("event").agg(F.count_if(F.col("reason") == "BEFORE_CUTOFF").alias("refused"))
    made = good.groupBy("event").agg(F.count("*").alias("later"), F.avg("calibrated").alias("mean_calibrated"))
    return rounded(fits.join(made, "event").join(counts, "event").select("event", "n", "purged", "positives", "a", "b", "later", "refused", "mean_calibrated"), 5)


@query("SELECT o_orderkey, epoch(cast(o_orderdate AS timestamp) + INTERVAL 7 DAY)::bigint AS week, epoch(cast(o_orderdate AS timestamp) + INTERVAL 1 MONTH)::bigint AS month, epoch(cast(o_orderdate AS timestamp) + INTERVAL 3 MONTH)::bigint AS quarter, epoch(cast(o_orderdate AS timestamp) + INTERVAL 1 YEAR)::bigint AS year FROM orders")
def horizon_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp_ntz")
    ends = {"week": "1w", "month": "1mo", "quarter": "3mo", "year": "1y"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(F.floor(microstructure.epoch(horizon_end(at, h))).alias(n) for n, h in ends.items()))


@query("""WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS d FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS d FROM lineitem)
SELECT k, d, 'NEW' AS state FROM new WHERE k NOT IN (SELECT k FROM old) UNION ALL SELECT DISTINCT new.k, NULL, 'CONFLICT' FROM new JOIN old USING (k) WHERE new.d <> old.d""")
def ledger_insert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of a ledger, and keys that are there with another digest."""
    old = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("d"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("d"))
    fresh, clash = store.insert_once(old, new, "k", "d", store.pieces(old, new))
    return fresh.select("k", "d", F.lit("NEW").alias("state")).union(clash.select("k", F.lit(None).cast("string"), F.lit("CONFLICT")))


@query("""WITH a AS (SELECT event_type, cast(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, CASE WHEN event_type = 'error' THEN 'MISSING' ELSE 'CHANGED' END AS problem FROM a
WHERE event_type = 'error' OR EXISTS (SELECT 1 FROM events e WHERE e.event_type = a.event_type AND cast(e.ts AS date) = a.day AND e.event_id % 1000 = 7)""")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against rows of which one type is gone and some others come twice: repeats don't cancel."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    now = events.where("event_type <> 'error'")
    now = now.union(now.where("event_id % 1000 = 7")).union(now.where("event_id % 1000 = 7"))
    return store.verified(store.manifest(events, ["event_type", "day"], F.col("event_id"), "ts"), now, ["event_type", "day"], F.col("event_id"), "ts")


@query("""WITH c AS (SELECT conv_id, turn, 'c' || turn AS cursor, CASE WHEN turn < (SELECT max(turn) FROM conversations) THEN 'c' || (turn + CASE WHEN conv_id % 7 = 3 THEN 2 ELSE 1 END) END AS following FROM conversations WHERE NOT (conv_id % 5 = 2 AND turn = 1)),
w AS (SELECT conv_id, turn, cursor, following, lag(turn) OVER v AS t0, lag(following) OVER v AS f0 FROM (SELECT conv_id, turn, any_value(cursor) AS cursor, any_value(following) AS following FROM c GROUP BY 1, 2) WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'GAP' AS problem FROM w WHERE coalesce(turn <> t0 + 1, turn <> 0) UNION ALL SELECT conv_id, turn, 'AFTER_END' FROM w WHERE t0 IS NOT NULL AND f0 IS NULL UNION ALL SELECT conv_id, turn, 'CURSOR' FROM w WHERE f0 <> cursor""")
def backfill_page_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for pages of a conversation's backfill; some are missing, and some cursors skip one."""
    talk = table(spark, sf_dir, "conversations")
    last = talk.agg(F.max("turn").alias("_last"))  # one row
    rows = talk.where(~((F.col("conv_id") % 5 == 2) & (F.col("turn") == 1))).join(F.broadcast(last), how="cross").dropDuplicates(["conv_id", "turn"])
    cursor = lambda t: F.concat(F.lit("c"), t.cast("string"))
    pages = rows.select("conv_id", "turn", cursor(F.col("turn")).alias("cursor"), F.when(F.col("turn") < F.col("_last"), cursor(F.col("turn") + F.when(F.col("conv_id") % 7 == 3, 2).otherwise(1))).alias("following"), F.lit(1).alias("rows"))
    return store.page_problems(pages, "conv_id", "turn", "cursor", "following", "rows").select("conv_id", "turn", "problem")


@query("""WITH l AS (SELECT l_partkey AS part, l_extendedprice / l_quantity AS price, l_quantity AS q FROM lineitem), m AS (SELECT part, median(price) AS mid FROM l GROUP BY 1),
b AS (SELECT part, list({p: price, q: q} ORDER BY price DESC, q) FILTER (price < mid) AS bids, list({p: price, q: q} ORDER BY price, q) FILTER (price > mid) AS asks FROM l JOIN m USING (part) GROUP BY 1), t AS (SELECT *, (bids[1].p + asks[1].p) / 2 AS mid FROM b WHERE len(bids) > 0 AND len(asks) > 0),
i AS (SELECT *, coalesce(list_sum(list_transform(list_filter(bids, lambda x: round(abs(x.p - mid) / mid * 1e4, 6) <= 100), lambda x: x.p * x.q)), 0) AS x, coalesce(list_sum(list_transform(list_filter(asks, lambda x: round(abs(x.p - mid) / mid * 1e4, 6) <= 100), lambda x: x.p * x.q)), 0) AS y FROM t)
SELECT part, floor(mid * 1000 + 0.37) / 1000 AS mid, floor((asks[1].p - bids[1].p) / mid * 1e7 + 0.37) / 1000 AS spread_bps, floor((asks[1].p * bids[1].q + bids[1].p * asks[1].q) / (asks[1].q + bids[1].q) * 1000 + 0.37) / 1000 AS microprice, round(CASE WHEN x + y = 0 THEN 0.0 ELSE (x - y) / (x + y) END, 4) AS imbalance_100 FROM i""")
def book_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's lines below and above its median price are the sides of its book."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
    level, both = F.struct("price", "quantity"), rows.join(rows.groupBy("part").agg(F.median("price").alias("mid")), "part")
    # A part has a few dozen lines at any scale.
    side = lambda c, sign: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct((sign * F.col("price")).alias("o"), "quantity", level.alias("level"))))), lambda x: x["level"])
    books = both.groupBy("part").agg(side(F.col("price") < F.col("mid"), -1).alias("bids"), side(F.col("price") > F.col("mid"), 1).alias("asks")).where("size(bids) > 0 and size(asks) > 0")
    cut = lambda c: (F.floor(F.col(c) * 1000 + 0.37) / 1000).alias(c)
    return microstructure.book_metrics(books).select("part", cut("mid"), cut("spread_bps"), cut("microprice"), F.round("imbalance_100", 4).alias("imbalance_100"))


@query(f"""WITH {_DAILY}, x AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, p, p / lag(p, 30) OVER (ORDER BY d) - 1 AS r, lead(p, 7) OVER (ORDER BY d) / p - 1 AS f FROM daily), s AS (SELECT greatest(0.0, least(100.0, 50 + 50 * r / 0.45)) / 100 AS q, f > 0 AS y FROM x WHERE i >= 365 AND (i - 365) % 7 = 0 AND f IS NOT NULL)
SELECT count(*) AS decisions, round(avg(((q > 0.5) = y)::int), 4) AS accuracy, round(avg((q - y::int) ** 2), 4) AS brier, round(avg(abs(q - 0.5) * 2), 4) AS conviction FROM s""")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    x = daily(spark, sf_dir).select((F.row_number().over(_series()) - 1).alias("i"), (scale(timeseries.trailing_return(p, _series(), 30), 0.45) / 100).alias("q"), (F.lead("p", 7).over(_series()) / p - 1).alias("f"))
    s = x.where((F.col("i") >= 365) & ((F.col("i") - 365) % 7 == 0) & F.col("f").isNotNull()).select("q", (F.col("f") > 0).alias("y"))
    return rounded(s.agg(F.count("*").alias("decisions"), F.avg(((F.col("q") > 0.5) == F.col("y")).cast("int")).alias("accuracy"), F.avg((F.col("q") - F.col("y").cast("int")) ** 2).alias("brier"), F.avg(F.abs(F.col("q") - 0.5) * 2).alias("conviction")))


#: What the backtests take as given of every day: funding and the quality of the data.
_GIVEN = {"funding_z": 0.5, "provider_agreement": 0.9, "freshness_score": 0.8, "source_coverage": 1.0}


def _backtest_sql(window: int | None, late: str | None, embargo: int) -> str:
    """A decision's history as lists by column, newest last: features, components and scores of those."""
    back = lambda c, n: f"l{c}[-1] / l{c}[-{n + 1}] - 1"
    last = lambda c, n: f"l{c}[-{n}:]"
    zscore = f"CASE WHEN len(l7) >= 20 THEN CASE WHEN list_stddev_pop({last(7, 20)}) = 0 THEN 0.0 ELSE (l7[-1] - list_avg({last(7, 20)})) / list_stddev_pop({last(7, 20)}) END END"
    made = {
        "ndx_return_20d": back(5, 20), "dxy_return_20d": back(8, 20), "us10y_change_20d": "l9[-1] - l9[-21]", "vix_z_20d": zscore, "btc_return_7d": back(1, 7), "btc_return_30d": back(1, 30), "eth_btc_return_7d": back(3, 7), "btc_dominance_change_20d": back(4, 20),
        "asset_return_7d": back(0, 7), "asset_return_30d": back(0, 30), "asset_btc_return_7d": back(2, 7), "asset_btc_return_30d": back(2, 30), "asset_ma100_distance": f"CASE WHEN len(l0) >= 100 THEN l0[-1] / list_avg({last(0, 100)}) - 1 END",
    }
    term = lambda f, w, s: f"greatest(0.0, least(100.0, 50 + 50 * ({s} * ({made[f]})) / {w})) + 0 * ({made[f]})"
    parts = {c: [term(f, w, s) for k, f, w, s in _TERMS if k == c] for c in ("macro", "crypto", "relative")} | {"derivatives": [f"100 * (1 - {_GIVEN['funding_z']} / 2.5)", "NULL", "NULL"], "ledger": ["NULL"]}
    weights = {"macro": 0.25, "crypto": 0.3, "relative": 0.3, "derivatives": 0.1, "ledger": 0.05}
    found = ", ".join(f"list_avg(list_filter([{', '.join(v)}]::DOUBLE[], lambda x: x IS NOT NULL)) AS s_{c}, len(list_filter([{', '.join(v)}]::DOUBLE[], lambda x: x IS NOT NULL)) / {float(len(v))} AS k_{c}" for c, v in parts.items())
    quality = sum(v for k, v in _GIVEN.items() if k != "funding_z") / 3
    return f"""WITH {_SERIES}, r AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM l)), p AS (SELECT r.d, i, x, count(*) OVER () AS total FROM r LEFT JOIN l ON l.d = r.d AND k = 0),
q AS (SELECT a.i AS "end", a.d AS moment, coalesce(b.x > a.x, false) AS outcome FROM p a JOIN p b ON b.i = a.i + {7 + embargo} WHERE a.i >= 365 AND (a.i - 365) % 7 = 0 AND a.i < a.total - {7 + embargo}),
h AS (SELECT "end", r.d FROM q JOIN r ON i <= "end"{f' AND i > "end" - {window}' if window else ''}{f' AND {late} <= moment' if late else ''}), n AS (SELECT "end", count(*) AS n FROM h GROUP BY 1 HAVING count(*) >= 365),
w AS (SELECT "end", {', '.join(f'list(x ORDER BY d) FILTER (k = {k} AND x IS NOT NULL) AS l{k}' for k in range(10))} FROM h JOIN l USING (d) GROUP BY 1), f AS (SELECT "end", {found} FROM w),
s AS (SELECT *, {' + '.join(f'{w} * k_{c}' for c, w in weights.items())} AS cov, list_filter([{', '.join(f'CASE WHEN k_{c} > 0 THEN s_{c} END' for c in weights)}], lambda x: x IS NOT NULL) AS alive, {' + '.join(f'{w} * k_{c} * coalesce(s_{c}, 50)' for c, w in weights.items())} AS total FROM f),
t AS (SELECT *, total / cov AS bull, CASE WHEN len(alive) >= 2 THEN greatest(0.0, least(1.0, 1 - list_stddev_pop(alive) / 50)) ELSE 0.0 END AS alignment, least({quality}, cov) AS sure FROM s),
z AS (SELECT *, 0.65 * cov + 0.2 * alignment + 0.15 * abs(bull - 50) / 50 AS model FROM t),
out AS (SELECT "end", moment, n, outcome, round(bull, 2) / 100 AS raw_score, round(sure, 4) AS data_confidence, round(model, 4) AS model_confidence, round(sqrt(sure * model), 4) AS confidence FROM q JOIN n USING ("end") JOIN z USING ("end"))"""


_SUMMARY = "count(*) AS decisions, round(avg(((raw_score >= 0.5) = outcome)::int), 4) AS accuracy, round(avg((raw_score - outcome::int) ** 2), 4) AS brier, round(avg(confidence), 4) AS confidence, round(avg(data_confidence), 4) AS data_confidence, round(avg(model_confidence), 4) AS model_confidence"
_KNOWN_AT = "r.d + (2 + epoch(r.d)::bigint // 86400 % 3)::int"


@query(f'{_backtest_sql(None, None, 0)} SELECT "end", moment, n, outcome, round(raw_score, 4) AS raw_score, confidence FROM out')
def backtest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime score of every seventh day from all days up to it, and whether the price was higher seven days later."""
    out = backtest.walk_forward(_market(spark, sf_dir), "d", supplemental={k: F.lit(v) for k, v in _GIVEN.items()})
    return out.select("end", F.col("at").alias("moment"), F.col("n").cast("bigint").alias("n"), "outcome", F.round("raw_score", 4).alias("raw_score"), "confidence")


@query(f"{_backtest_sql(500, _KNOWN_AT, 2)} SELECT {_SUMMARY} FROM out")
def backtest_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by windows of 500 days of which a day is known two to four days later, two days kept between a decision and
    its outcome."""
    market = _market(spark, sf_dir).withColumn("known_at", F.date_add("d", F.lit(2) + F.datediff("d", F.lit("1970-01-01").cast("date")) % 3))
    return rounded(backtest.summary(backtest.walk_forward(market, "d", available="known_at", window=500, embargo=2, supplemental={k: F.lit(v) for k, v in _GIVEN.items()})))


@query("SELECT 'receipt:sha256:' || sha256(cast(o_orderkey AS varchar) || chr(31) || o_orderpriority || chr(31) || o_orderstatus) AS id, o_orderkey FROM orders")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(content_id("receipt", F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("id"), "o_orderkey")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax / 100 - 0.0003 AS funding, l_extendedprice AS mark, l_extendedprice * (1 + (l_discount - 0.05) / 10) AS idx FROM lineitem), b AS (SELECT *, (mark - idx) / idx * 1e4 AS basis FROM l)
SELECT l_partkey, count(*) AS n, count_if(funding > 5e-4) AS crowded, count_if(funding < -5e-4) AS paid, count_if(abs(basis) > 25) AS wide, round(avg(basis), 4) AS mean_basis_bps FROM b GROUP BY 1""")
def derivatives_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_tax") / 100 - 0.0003).alias("funding"), F.col("l_extendedprice").alias("mark"), (F.col("l_extendedprice") * (1 + (F.col("l_discount") - 0.05) / 10)).alias("idx"))
    risk = microstructure.derivatives_risk(rows, "funding", "mark", "idx")
    has = lambda flag: F.count_if(F.array_contains("flags", flag))
    return rounded(risk.groupBy("l_partkey").agg(F.count("*").alias("n"), has("FUNDING_POSITIVE").alias("crowded"), has("FUNDING_NEGATIVE").alias("paid"), has("WIDE_BASIS").alias("wide"), F.avg("basis_bps").alias("mean_basis_bps")))


@query(f"""WITH {_OBS}, c AS (SELECT provider, CASE WHEN boundary IS NULL OR boundary > TIMESTAMP '2000-01-01' THEN 'INELIGIBLE' WHEN fetched <= TIMESTAMP '2000-01-01' THEN 'STRICT_REPLAY' WHEN basis IS NOT NULL THEN 'RECONSTRUCTED_PIT' ELSE 'INELIGIBLE' END AS class FROM o)
SELECT provider, count(*) AS n, round(avg((class = 'STRICT_REPLAY')::int), 6) AS strict_share, round(avg((class = 'RECONSTRUCTED_PIT')::int), 6) AS reconstructed_share FROM c GROUP BY 1""")
def dataset_version_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2000-01-01").cast("timestamp_ntz")
    df = observations(spark, sf_dir).withColumn("class", pit.eligibility(F.col("boundary"), F.col("fetched"), F.col("basis"), at))
    share = lambda k: F.round(F.avg((F.col("class") == k).cast("int")), 6)
    return df.groupBy("provider").agg(F.count("*").alias("n"), share("STRICT_REPLAY").alias("strict_share"), share("RECONSTRUCTED_PIT").alias("reconstructed_share"))


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines by month, and the same after a correction of every third month: lines gone, changed, and added."""
    old = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("month"), F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"))
    k, third = F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.col("month") % 3 == 0
    new = old.where(~(third & (k % 101 == 0))).withColumn("quantity", F.col("quantity") + F.when(third & (k % 89 == 1), 1.0).otherwise(0.0))
    return old, new.union(old.where(third & (k % 97 == 2)).withColumn("l_linenumber", F.col("l_linenumber") + 100))


_TWO_VERSIONS = """o AS (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS month, l_orderkey, l_linenumber::bigint AS l_linenumber, l_quantity::double AS quantity, l_extendedprice::double AS price, l_orderkey * 7 + l_linenumber AS k FROM lineitem),
v AS (SELECT month, l_orderkey, l_linenumber, quantity + CASE WHEN month % 3 = 0 AND k % 89 = 1 THEN 1 ELSE 0 END AS quantity, price FROM o WHERE NOT (month % 3 = 0 AND k % 101 = 0) UNION ALL SELECT month, l_orderkey, l_linenumber + 100, quantity, price FROM o WHERE month % 3 = 0 AND k % 97 = 2),
a AS (SELECT month, l_orderkey, l_linenumber, list_sort(list((quantity, price))) AS x FROM o GROUP BY 1, 2, 3), b AS (SELECT month, l_orderkey, l_linenumber, list_sort(list((quantity, price))) AS y FROM v GROUP BY 1, 2, 3),
c AS (SELECT month, l_orderkey, l_linenumber, CASE WHEN x IS NULL THEN 'ADDED' WHEN y IS NULL THEN 'GONE' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (month, l_orderkey, l_linenumber) WHERE x IS DISTINCT FROM y)"""


@query(f"WITH {_TWO_VERSIONS} SELECT * FROM c")
def dataset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ between two versions, found by a walk over two trees of digests."""
    old, new = _two_versions(spark, sf_dir)
    changes = versions.changed_nodes(*(versions.tree(v, ["month"], ["l_orderkey", "l_linenumber"]) for v in (old, new)))
    return versions.changed_rows(old, new, changes, ["month"], ["l_orderkey", "l_linenumber"])


@query(f"WITH {_TWO_VERSIONS}, n AS (SELECT month, count(*) AS n_old FROM o GROUP BY 1), w AS (SELECT month, count(*) AS n_new FROM v GROUP BY 1) SELECT month, CASE WHEN n_old IS NULL THEN 'ADDED' WHEN n_new IS NULL THEN 'GONE' ELSE 'CHANGED' END AS change, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new FROM (SELECT DISTINCT month FROM c) LEFT JOIN n USING (month) LEFT JOIN w USING (month)")
def dataset_changed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_versions(spark, sf_dir)
    changes = versions.changed_nodes(*(versions.tree(v, ["month"], ["l_orderkey", "l_linenumber"]) for v in (old, new)))
    return versions.changed_partitions(changes, ["month"], "month int")


@query(f"""WITH {_OBS}, c AS (SELECT provider, boundary, fetched <= TIMESTAMP '2000-01-01' AS strict FROM o WHERE boundary <= TIMESTAMP '2000-01-01' AND (fetched <= TIMESTAMP '2000-01-01' OR basis IS NOT NULL)), t AS (SELECT DISTINCT provider, boundary FROM c),
g AS (SELECT count(*) AS n_gaps FROM (SELECT boundary - lag(boundary) OVER (PARTITION BY provider ORDER BY boundary) AS d FROM t) WHERE d > INTERVAL 30 DAY)
SELECT count(*) AS total_rows, round(avg(strict::int), 6) AS strict_replay_fraction, round(avg(1 - strict::int), 6) AS reconstructed_pit_fraction, count(DISTINCT provider) AS providers, (SELECT n_gaps FROM g) AS n_gaps, true AS sound FROM c""")
def dataset_version_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a version of all observations that a cutoff allows, whose id is of all its fields."""
    at = F.lit("2000-01-01").cast("timestamp_ntz")
    # A line of another flag has no boundary, so it is INELIGIBLE whatever its order; the join is done once for all that follows.
    able = F.col("l_returnflag").isin("R", "A")
    rows = kept(observations(spark, sf_dir, able).withColumn("class", pit.eligibility(F.col("boundary"), F.col("fetched"), F.col("basis"), at)).where("class <> 'INELIGIBLE'"), "observations")
    nodes = versions.tree(rows.drop("class"), ["provider"], ["l_orderkey", "l_linenumber"], keep=False)
    stated = {"dataset_key": "lines", "schema_version": "1", "feature_schema_version": "1", "label_schema_version": "1", "created_at": "2000-01-02T00:00:00Z", "cutoff_at": "2000-01-01T00:00:00Z"}
    out = versions.dataset_version(rows, nodes, store.manifest(rows, ["asset"], F.struct("l_orderkey", "l_linenumber"), "boundary"), pit.coverage(rows, "provider", "boundary"), pit.gaps(rows, ["provider"], "boundary", 30 * 86400), **stated)
    out = kept(out, "version")  # one row, and its id is made again of what is there
    wrong = versions.reidentified(out).agg((F.count("*") == 0).alias("sound"))  # one row
    return out.crossJoin(wrong).select("total_rows", F.round("strict_replay_fraction", 6).alias("strict_replay_fraction"), F.round("reconstructed_pit_fraction", 6).alias("reconstructed_pit_fraction"), "providers", "n_gaps", "sound")


@query(f"WITH {_FOLDS} SELECT fold_index, s AS test_start, n_test, least(fit, 365) AS n_train, f - fit AS n_purged FROM folds")
def walk_forward_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.walk_forward_folds(_labelled(spark, sf_dir), "n", "resolved", 365, 30, 7, max_train=365).select("fold_index", "test_start", "n_test", "n_train", "n_purged")


@query("""WITH l AS (SELECT l_partkey AS part, l_extendedprice / l_quantity AS price, l_quantity AS q, l_orderkey, l_linenumber FROM lineitem), m AS (SELECT part, median(price) AS mid FROM l GROUP BY 1),
s AS (SELECT part, sum(price * q) FILTER (price < mid AND (mid - price) / mid * 1e4 <= 2500) AS bid, sum(price * q) FILTER (price > mid AND (price - mid) / mid * 1e4 <= 2500) AS ask FROM l JOIN m USING (part) GROUP BY 1)
SELECT part, round(coalesce((coalesce(bid, 0) - coalesce(ask, 0)) / nullif(coalesce(bid, 0) + coalesce(ask, 0), 0), 0), 4) AS imbalance FROM s""")
def book_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("q"))
    mid = rows.groupBy("part").agg(F.median("price").alias("mid"))
    near = F.abs(F.col("price") - F.col("mid")) / F.col("mid") * 1e4 <= 2500
    side = lambda c: F.coalesce(F.sum(F.when(c & near, F.col("price") * F.col("q"))), F.lit(0.0))
    s = rows.join(mid, "part").groupBy("part").agg(side(F.col("price") < F.col("mid")).alias("bid"), side(F.col("price") > F.col("mid")).alias("ask"))
    return s.select("part", F.round(F.coalesce(F.try_divide(F.col("bid") - F.col("ask"), F.col("bid") + F.col("ask")), F.lit(0.0)), 4).alias("imbalance"))


@query("""WITH c AS (SELECT conv_id AS claim, any_value(CASE WHEN turn % 2 = 0 THEN 'FACT' ELSE 'OPINION' END) AS status FROM conversations WHERE turn = (SELECT min(turn) FROM conversations) GROUP BY 1), l AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey),
p AS (SELECT a, b FROM l UNION SELECT b, a FROM l), k AS (SELECT a, b FROM p WHERE a IN (SELECT claim FROM c) AND b IN (SELECT claim FROM c))
SELECT claim, CASE WHEN status = 'FACT' AND EXISTS (SELECT 1 FROM k JOIN c d ON d.claim = k.b WHERE k.a = c.claim AND d.status = 'FACT') THEN 'DISPUTED' ELSE status END AS status FROM c""")
def disputed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    first = talk.agg(F.min("turn").alias("_t"))  # one row
    claims = talk.join(F.broadcast(first), F.col("turn") == F.col("_t")).select(F.col("conv_id").alias("claim"), F.when(F.col("turn") % 2 == 0, "FACT").otherwise("OPINION").alias("status")).distinct()
    return semantic.disputed(claims, semantic.contradictions(table(spark, sf_dir, "lineitem"), claims, "l_partkey", "l_suppkey", "claim"), "claim", "status")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS e, lower(trim(n_name)) || '-' || cast(floor(c_acctbal / 100)::bigint AS varchar) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_custkey, lower(c_mktsegment) || '-' || cast(c_custkey // 3 AS varchar) FROM customer),
l AS (SELECT DISTINCT x.e AS a, y.e AS b FROM n x JOIN n y USING (name)), r AS (SELECT a AS e, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.e)
SELECT e AS entity, min(root) AS canonical, count(*) AS n_entities FROM r GROUP BY 1""")
def entity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share a name, over chains of names, as one entity."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = F.array(F.concat("n_name", F.lit("-"), F.floor(F.col("c_acctbal") / 100).cast("string")), F.concat("c_mktsegment", F.lit("-"), F.floor(F.col("c_custkey") / 3).cast("string")))
    return claim_graph.closure(rows.select(F.col("c_custkey").alias("entity"), F.explode(names).alias("alias")), "entity", "alias")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS claim, CASE WHEN p_size % 4 > 0 THEN 'FACT' ELSE 'OPINION' END AS status, p_size % 6 = 0 AS main FROM part), x AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 45 AND l_partkey <> l_suppkey),
k AS (SELECT a, b FROM (SELECT a, b FROM x UNION SELECT b, a FROM x) WHERE a IN (SELECT claim FROM c) AND b IN (SELECT claim FROM c)), s AS (SELECT DISTINCT l_partkey AS claim, l_orderkey % 1999 + 1 AS by FROM lineitem WHERE l_linenumber = 6 AND l_quantity < 20),
f AS (SELECT * FROM c WHERE status = 'FACT' AND claim NOT IN (SELECT a FROM k)), r AS (SELECT claim, 0 AS depth FROM f WHERE main UNION SELECT s.claim, r.depth + 1 FROM r JOIN s ON s.by = r.claim JOIN f ON f.claim = s.claim WHERE r.depth < 60), d AS (SELECT claim, min(depth) AS depth FROM r GROUP BY 1)
SELECT claim, CASE WHEN status <> 'FACT' THEN status WHEN depth IS NOT NULL THEN 'FACT' WHEN main AND EXISTS (SELECT 1 FROM k JOIN c o ON o.claim = k.b WHERE k.a = c.claim AND o.status = 'FACT' AND o.main) THEN 'DISPUTED' WHEN claim IN (SELECT a FROM k) THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS status, depth FROM c LEFT JOIN d USING (claim)""")
def settled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as claims: which are facts by their own source or by what supports them, step by step, and which are not."""
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim"), F.when(F.col("p_size") % 4 > 0, "FACT").otherwise("OPINION").alias("status"), F.array(F.when(F.col("p_size") % 6 == 0, "T0_PRIMARY_MACHINE").otherwise("T3_REPORT")).alias("tiers"))
    lines = table(spark, sf_dir, "lineitem")
    pairs = semantic.contradictions(lines.where("l_linenumber = 7 AND l_quantity > 45"), claims, "l_partkey", "l_suppkey", "claim")
    supports = lines.where("l_linenumber = 6 AND l_quantity < 20").select(F.col("l_partkey").alias("claim"), (F.col("l_orderkey") % 1999 + 1).alias("by")).distinct()
    return claim_graph.settled(claims, pairs, supports)


@query("""WITH h AS (SELECT event_type, cast(ts AS date) AS day, date_trunc('hour', ts) AS t, arg_min(value, ts) AS o, max(value) AS hi, min(value) AS lo, arg_max(value, ts) AS c, sum(value) AS v FROM events GROUP BY 1, 2, 3), f AS (SELECT event_type, cast(ts AS date) AS day, max(ts) AS fetched FROM events GROUP BY 1, 2),
r AS (SELECT h.*, row_number() OVER (PARTITION BY event_type, day ORDER BY t DESC) AS k FROM h JOIN f USING (event_type, day) WHERE t + INTERVAL 1 HOUR <= fetched)
SELECT event_type AS asset, epoch(t)::bigint AS open_time, round(o, 4) AS open, round(hi, 4) AS high, round(lo, 4) AS low, round(c, 4) AS close, round(v, 3) AS volume FROM r WHERE k <= 5""")
def landed_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of events landed as one JSON payload a day and type; bars that were open at the fetch and older ones than five are left out."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    hours = events.groupBy("event_type", "day", F.date_trunc("hour", "ts").alias("t")).agg(F.min_by("value", "ts").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "ts").alias("c"), F.sum("value").alias("v"))
    bar = F.array(F.unix_millis("t").cast("string"), *(F.col(c).cast("string") for c in "ohlcv"))
    payloads = hours.groupBy("event_type", "day").agg(F.to_json(F.collect_list(bar)).alias("payload"))  # 24 bars at most
    fetched = events.groupBy("event_type", "day").agg(F.max("ts").alias("fetched_at"))
    out = landed.candles(payloads.join(fetched, ["event_type", "day"]).withColumnRenamed("event_type", "asset"), "binance", 3600, limit=5)
    return out.select("asset", F.floor(microstructure.epoch(F.col("open_time"))).alias("open_time"), *(F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")), F.round("volume", 3).alias("volume"))


@query("""WITH o AS (SELECT o_orderpriority AS series, cast(o_orderdate AS date) AS d, o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 4 <> 1)
SELECT series, k, d AS observed, round(v, 2) AS value, CASE WHEN k % 3 = 0 THEN d + 2 ELSE d END AS available FROM o""")
def landed_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as macro observations, one payload each; values that are missing are left out."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    item = F.struct(F.col("d").cast("string").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add("d", 2)).otherwise(F.date_sub("d", 1)).cast("string").alias("realtime_start"), F.when(F.col("o_orderkey") % 4 == 1, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    rows = o.select(F.concat("o_orderpriority", F.lit("#"), F.col("o_orderkey").cast("string")).alias("series"), F.to_json(F.struct(F.array(item).alias("observations"))).alias("payload"))
    out, name = landed.macro_observations(rows), F.split("series", "#")
    return out.select(name[0].alias("series"), name[1].cast("bigint").alias("k"), F.to_date("observed_at").alias("observed"), F.round("value", 2).alias("value"), F.to_date("available_at").alias("available"))
