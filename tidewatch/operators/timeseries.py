"""Trailing-window features of daily series.

Every function takes a value column and a window spec's partition and order, so many series run side by side; offsets
count rows, windows must be full, and anything undefined is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions import finite, ratio


def _frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def full(x: Column, w: WindowSpec, n: int, value: Column) -> Column:
    """value where the last n rows all have x."""
    return F.when(F.count(x).over(_frame(w, n)) == n, value)


def trailing_return(x: Column, w: WindowSpec, k: int) -> Column:
    return ratio(x, F.lag(x, k).over(w)) - 1


def absolute_change(x: Column, w: WindowSpec, k: int) -> Column:
    return x - F.lag(x, k).over(w)


def zscore(x: Column, w: WindowSpec, n: int) -> Column:
    """Against the mean and population deviation of the last n; 0 where they don't vary."""
    f = _frame(w, n)
    sd = F.stddev_pop(x).over(f)
    return full(x, w, n, F.when(sd == 0, F.lit(0.0)).otherwise((x - F.avg(x).over(f)) / sd))


def rsi(delta: Column, w: WindowSpec, n: int = 14) -> Column:
    """Simple-mean relative strength of the last n changes: 50 when flat, 100 without losses, 0 without gains."""
    mean = lambda c: F.avg(F.greatest(c, F.lit(0.0))).over(_frame(w, n))
    return full(delta, w, n, _strength(mean(delta), mean(-delta)))


def _strength(gain: Column, loss: Column) -> Column:
    return F.when((gain == 0) & (loss == 0), F.lit(50.0)).when(loss == 0, F.lit(100.0)).when(gain == 0, F.lit(0.0)).otherwise(100 - 100 / (1 + gain / loss))


def distance_to_mean(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, w, n, ratio(x, F.avg(x).over(_frame(w, n))) - 1)


def drawdown(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, w, n, ratio(x, F.max(x).over(_frame(w, n))) - 1)


def beta(y: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """Sample covariance over sample variance of the last n pairs."""
    f = _frame(w, n)
    return full(y + x, w, n, ratio(F.covar_samp(y, x).over(f), F.var_samp(x).over(f)))


def correlation(y: Column, x: Column, w: WindowSpec, n: int) -> Column:
    return full(y + x, w, n, finite(F.corr(y, x).over(_frame(w, n))))


def realized_volatility(r: Column, w: WindowSpec, n: int, per_year: Column) -> Column:
    """Population deviation of the last n returns times the root of the periods in a year."""
    return full(r, w, n, F.stddev_pop(r).over(_frame(w, n)) * F.sqrt(per_year))


#: Columns of a market frame (`asset`: the one that is scored), and the features of each:
#: name -> (what, column or pair, observations).
REQUIRED = ("asset_usd", "btc_usd", "asset_btc", "eth_btc", "btc_dominance", "ndx", "spx", "vix", "dxy", "us10y", "gold", "wti", "gasoline", "coin", "mstr")
FEATURES = {
    "asset_return_1d": ("return", "asset_usd", 1), "asset_return_7d": ("return", "asset_usd", 7), "asset_return_30d": ("return", "asset_usd", 30),
    "btc_return_7d": ("return", "btc_usd", 7), "btc_return_30d": ("return", "btc_usd", 30), "asset_btc_return_7d": ("return", "asset_btc", 7), "asset_btc_return_30d": ("return", "asset_btc", 30),
    "eth_btc_return_7d": ("return", "eth_btc", 7), "btc_dominance_change_20d": ("return", "btc_dominance", 20), "ndx_return_20d": ("return", "ndx", 20), "spx_return_20d": ("return", "spx", 20),
    "coin_return_20d": ("return", "coin", 20), "mstr_return_20d": ("return", "mstr", 20), "dxy_return_20d": ("return", "dxy", 20), "us10y_change_20d": ("change", "us10y", 20), "vix_z_20d": ("zscore", "vix", 20),
    "gold_return_20d": ("return", "gold", 20), "wti_return_20d": ("return", "wti", 20), "gasoline_return_20d": ("return", "gasoline", 20), "asset_rsi_14": ("rsi", "asset_usd", 14), "asset_vol_30d": ("volatility", "asset_usd", 30),
    "asset_ma20_distance": ("mean", "asset_usd", 20), "asset_ma100_distance": ("mean", "asset_usd", 100), "asset_drawdown_365d": ("drawdown", "asset_usd", 365),
    "asset_beta_btc_90d": ("beta", ("asset_usd", "btc_usd"), 90), "asset_beta_ndx_90d": ("beta", ("asset_usd", "ndx"), 90), "btc_ndx_corr_90d": ("corr", ("btc_usd", "ndx"), 90), "asset_btc_corr_90d": ("corr", ("asset_usd", "btc_usd"), 90),
}
#: Features that a caller supplies, and the bounds of a daily frame's median interval in seconds.
SUPPLEMENTAL = ("funding_z", "oi_price_divergence", "liquidation_impulse", "provider_agreement", "freshness_score", "source_coverage", "ledger_activity_z")
DAILY = (18 * 3600, 30 * 3600)


def frame_problems(frame: DataFrame, time: str) -> DataFrame:
    """problem, n of a frame that features can't be taken from: NO_TIME (rows without one), REPEATED_TIME, TOO_SHORT
    (fewer than three times), CADENCE (a median interval outside DAILY). A frame is a table of days, one window."""
    times = frame.groupBy(time).agg(F.count("*").alias("n"))
    gaps = times.where(F.col(time).isNotNull()).select("n", (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(Window.partitionBy(F.lit(0)).orderBy(time)).cast("timestamp"))).alias("gap"))
    facts = gaps.agg(F.count("*").alias("times"), F.count_if(F.col("n") > 1).alias("repeated"), F.median(F.col("gap") / 1e6).alias("cadence")).join(times.agg(F.coalesce(F.sum(F.when(F.col(time).isNull(), F.col("n"))), F.lit(0)).alias("none")), how="cross")  # one row each
    found = {"NO_TIME": F.col("none"), "REPEATED_TIME": F.col("repeated"), "TOO_SHORT": F.greatest(F.lit(0).cast("bigint"), 3 - F.col("times")), "CADENCE": (~F.col("cadence").between(*DAILY)).cast("bigint")}
    return facts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("problem"), n.cast("bigint").alias("n")) for k, n in found.items())))).where("n > 0")


def feature_rows(frame: DataFrame, time: str, supplemental: Mapping[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, time and every feature of FEATURES and SUPPLEMENTAL, for each row of a daily frame with the columns of REQUIRED.
    by: columns (not null) that tell several frames apart; each is one of its own.

    A column's observations are its finite values; offsets and windows count those, and a row's feature is that of the
    last observation up to it (pairs: of the last time that both have). Features without enough of them are null, as are
    supplemental ones that aren't given. Missing columns and unknown supplemental names are errors; rows that
    `frame_problems` reports are for the caller to look at first."""
    supplemental = supplemental or {}
    if missing := sorted(set(REQUIRED) - set(frame.columns)):
        raise ValueError(f"missing columns: {missing}")
    if unknown := sorted(set(supplemental) - set(SUPPLEMENTAL)):
        raise ValueError(f"unknown supplemental features: {unknown}")
    x = F.col("x")
    at, alone = [*by, time], Window.partitionBy(*by or [F.lit(0)]).orderBy(time)
    w = Window.partitionBy(*by, "series").orderBy(time)
    long = frame.select(*at, F.inline(F.array(*(F.struct(F.lit(c).alias("series"), finite(F.col(c).cast("double")).alias("x")) for c in REQUIRED)))).where("x IS NOT NULL")
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(alone).cast("timestamp"))
    per_year = frame.select(*by, (gap / 1e6).alias("gap")).groupBy(*by).agg((365.25 * 86400 / F.median("gap")).alias("per_year"))
    steps = long.withColumns({"_r": trailing_return(x, w, 1), "_d": absolute_change(x, w, 1)})
    base = steps.join(per_year, list(by)) if by else steps.crossJoin(F.broadcast(per_year))  # one row
    make = {
        "return": lambda n: trailing_return(x, w, n), "change": lambda n: absolute_change(x, w, n), "zscore": lambda n: zscore(x, w, n), "rsi": lambda n: rsi(F.col("_d"), w, n),
        "volatility": lambda n: realized_volatility(F.col("_r"), w, n, F.col("per_year")), "mean": lambda n: distance_to_mean(x, w, n), "drawdown": lambda n: drawdown(x, w, n),
    }
    single = {name: spec for name, spec in FEATURES.items() if isinstance(spec[1], str)}
    kinds = dict.fromkeys((what, n) for what, _, n in single.values())
    made = base.select(*at, "series", *(make[what](n).alias(f"_{what}_{n}") for what, n in kinds))
    wide = made.groupBy(*at).agg(*(F.max(F.when(F.col("series") == c, F.col(f"_{what}_{n}"))).alias(name) for name, (what, c, n) in single.items()))
    pairs = [spec[1] for spec in FEATURES.values() if not isinstance(spec[1], str)]
    both = frame.select(*at, F.inline(F.array(*(F.struct(F.lit("/".join(p)).alias("series"), finite(F.col(p[0]).cast("double")).alias("a"), finite(F.col(p[1]).cast("double")).alias("b")) for p in dict.fromkeys(pairs))))).where("a IS NOT NULL AND b IS NOT NULL")
    returns = both.select(*at, "series", trailing_return(F.col("a"), w, 1).alias("a"), trailing_return(F.col("b"), w, 1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    joint = returns.select(*at, "series", beta(F.col("a"), F.col("b"), w, 90).alias("beta"), correlation(F.col("a"), F.col("b"), w, 90).alias("corr"))
    wide2 = joint.groupBy(*at).agg(*(F.max(F.when(F.col("series") == "/".join(spec[1]), F.col(spec[0]))).alias(name) for name, spec in FEATURES.items() if not isinstance(spec[1], str)))
    given = frame.select(*at, *(finite(supplemental[k].cast("double")).alias(k) if k in supplemental else F.lit(None).cast("double").alias(k) for k in SUPPLEMENTAL))
    upto = alone.rowsBetween(Window.unboundedPreceding, 0)
    return given.join(wide, at, "left").join(wide2, at, "left").select(*at, *(F.last(f, ignorenulls=True).over(upto).alias(f) for f in FEATURES), *SUPPLEMENTAL)
