"""Streams against their batch twins and plain loops, in any order of arrival."""

import datetime as dt
import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import streaming
from tidewatch.operators import microstructure
from tidewatch.plans import queries
from tidewatch.streaming import book, windows

T0 = dt.datetime(2026, 1, 1)
SF = "/root/testdata/sf0.001"


def drained(frame, name, mode="append"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return frame.sparkSession.table(name).collect()


def arriving(spark, batches, schema, path):
    """A stream of one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_cooldown_restarts_only_on_emission(spark, tmp_path):
    hours = (0, 3, 5, 8, 9, 30)
    rows = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h)) for h in hours], "key string, ts timestamp")
    want = [T0 + dt.timedelta(hours=h) for h in (0, 5, 9, 30)]
    assert sorted(r.ts for r in streaming.cooled(rows, "key", "ts", 4 * 3600).collect()) == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.ts for r in drained(streaming.cooled_stream(stream, "key", "ts", 4 * 3600), "cooled")) == want


def test_known_at(spark):
    df = spark.createDataFrame([(T0, T0), (T0, T0 + dt.timedelta(1))], "available_at timestamp, fetched_at timestamp")
    assert streaming.known_at(df, F.lit(T0)).count() == 1


SAMPLES = "symbol string, observed_at timestamp, available_at timestamp, fetched_at timestamp, v double, x double, s double"


def samples(seed, n, minutes=400):
    """Samples of three symbols: some are available late, one is fetched after its window has gone, some have equal times."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        at = T0 + dt.timedelta(seconds=rng.choice([rng.randrange(minutes * 60), 60 * rng.randrange(minutes)]), microseconds=rng.choice([0, 0, 1, 999_999]))
        available = at + dt.timedelta(seconds=rng.choice([0, 0, 1, 20, 70, 400]))
        fetched = available + dt.timedelta(seconds=rng.choice([0, 2, 40, 5000]))
        out.append((rng.choice("aab") if rng.random() < 0.9 else "c", at, available, fetched, rng.choice([None, float(rng.randrange(1, 50))]) if rng.random() < 0.1 else float(rng.randrange(1, 50)), float(rng.randrange(9)), rng.choice([None, float(rng.randrange(5))])))
    return [*out, out[0], ("a", T0, None, T0, 1.0, 1.0, 1.0), ("a", None, T0, T0, 1.0, 1.0, 1.0)]


def plain(row, columns):
    return tuple(None if row[c] is None else tuple(row[c]) if isinstance(row[c], list) else round(row[c], 6) if isinstance(row[c], float) else row[c] for c in columns)


@pytest.mark.parametrize("batches", [1, 5])
def test_sliding_windows_equal_those_of_a_table(spark, tmp_path, batches):
    rows, late = samples(batches, 300), ("a", T0 + dt.timedelta(minutes=3), T0 + dt.timedelta(minutes=3), T0 + dt.timedelta(minutes=3), 1e6, 1.0, 1.0)
    known = lambda r: max(x for x in r[1:4] if x)
    if batches == 1:
        random.Random(3).shuffle(rows)
        parts = [rows]
    else:  # arrival within the delay of the order of knowledge, and one row that comes far too late
        rows.sort(key=lambda r: known(r) + dt.timedelta(seconds=random.Random(str(r)).randrange(500)))
        parts = [rows[k * len(rows) // batches : (k + 1) * len(rows) // batches] for k in range(batches)]
        parts[-1] = [*parts[-1], late]
    columns = dict(sums={"_x": F.col("x")}, series={"s": F.col("s")})
    stream = windows.sliding_windows(arriving(spark, parts, SAMPLES, tmp_path / "in"), 60, [60, 300, 3600], "observed_at", F.col("v"), F.col("available_at"), F.col("fetched_at"), ["symbol"], "10 minutes", **columns)
    found = streaming.drained(stream, "windows", str(tmp_path / "out"))
    names = ["at", "symbol", "seconds", "n", "first_value", "last_value", "total", "return_bps", "_x", "s_first", "s_last", "age_seconds", "lag_seconds", "flags", "regime_eligible"]
    got = sorted((plain(r, names) for r in found.collect()), key=repr)
    upto = max(known(r) for r in rows if None not in r[1:4]) - dt.timedelta(minutes=10)
    table = spark.createDataFrame(rows, SAMPLES)
    grid = spark.createDataFrame([(T0 + dt.timedelta(minutes=k),) for k in range(-2, 700) if T0 + dt.timedelta(minutes=k) <= upto], "at timestamp")
    want = []
    for w in (60, 300, 3600):
        out = microstructure.trailing_windows(table, grid, w, "observed_at", F.col("v"), F.col("available_at"), F.col("fetched_at"), keys=["symbol"], **columns)
        want += [plain(r, names) for r in out.withColumn("seconds", F.lit(w)).collect()]
    assert len(got) > 500 and got == sorted(want, key=repr)
    again = streaming.drained(stream, "windows", str(tmp_path / "out"))  # nothing new: nothing is sent twice
    assert again.count() == len(got)


def test_windows_of_a_day_are_none(spark):
    with pytest.raises(ValueError, match="86400"):
        windows.sliding_windows(spark.readStream.format("rate").load(), 60, [86400], "timestamp", F.col("value"), F.col("timestamp"), F.col("timestamp"), [])


BOOKS = f"symbol string, kind string, first_id bigint, last_id bigint, observed_at timestamp, available_at timestamp, fetched_at timestamp, bids {book.LEVELS}, asks {book.LEVELS}"


def market(seed, n):
    """Snapshots and deltas of two symbols with every fault."""
    rng, out = random.Random(seed), []
    for symbol in ("s", "t"):
        last, at = 10, T0
        for _ in range(n):
            at += dt.timedelta(seconds=rng.choice([0.1, 0.3, 0.5, 1.0, 1.9, 2.0, 2.000001, 3.0]) if rng.random() > 0.04 else 0)
            clocks = (at, at + dt.timedelta(seconds=0.01)) if rng.random() > 0.1 else (None, None)
            level = lambda low: [(float(rng.randrange(low, low + 8)), float(rng.choice([0, 1, 2, 5]))) for _ in range(rng.randrange(4))]
            once = lambda side: list(dict(side).items())
            if rng.random() < 0.15:
                last += rng.choice([0, 3])
                out.append((symbol, "snapshot", last, last, at, *clocks, [(float(p), 1.0) for p in range(95, 100)], [(float(p), 2.0) for p in range(101, 106)]))
                continue
            first = last + 1 if rng.random() > 0.08 else last + rng.choice([2, -1, -5])
            final = first + rng.randrange(3)
            bids, asks = (level(93), level(101)) if rng.random() < 0.05 else (once(level(93 if rng.random() > 0.15 else 99)), once(level(101)))
            out.append((symbol, "delta", first, final, at, *clocks, bids, asks))
            last = max(last, final)
    return out


def replayed(rows, until, silence=2.0, top=3):
    """A plain loop with sorted dictionaries over events in their order."""
    out = []
    for symbol in sorted({r[0] for r in rows}):
        bids, asks, last, loaded, ok, seen, whole = {}, {}, -1, False, False, None, False
        best = lambda: (sorted(bids.items(), reverse=True)[:top], sorted(asks.items())[:top]) if ok else ([], [])
        end = [(symbol, "end", None, None, until, None, None, [], [])]
        for _, kind, first, final, at, av, fe, b, a in [*sorted((r for r in rows if r[0] == symbol and r[4] <= until), key=lambda r: (r[4], r[3], r[1] != "snapshot", r[2])), *end]:
            if ok and at > seen + dt.timedelta(seconds=silence):
                ok = loaded = False
                out.append((symbol, seen + dt.timedelta(seconds=silence), None, last, "OUT_OF_STEP", "SILENCE", (), ()))
            if kind == "end":
                continue
            complete, problem, state, extra = av is not None and fe is not None, None, "SYNCHRONISED", ()
            if kind == "snapshot":
                bids, asks, last, loaded, ok, seen, whole, state = {p: q for p, q in b if q}, {p: q for p, q in a if q}, final, True, False, at, False, "SNAPSHOT"
                first = None
            elif not loaded:
                problem = "NOT_SYNCHRONISED"
            elif ok and final <= last:
                state = "STALE"
            else:
                problem = (
                    ("NOT_BRIDGED" if not first <= last + 1 <= final else None) if not ok
                    else "TIME" if at <= seen else "DUPLICATE_LEVEL" if any(len(dict(x)) < len(x) for x in (b, a)) else "GAP" if first > last + 1 else None
                )
                if not problem:
                    if ok:
                        moved = [sum(max(0, sign * p * (q - side.get(p, 0))) for p, q in new) for side, new in ((bids, b), (asks, a)) for sign in (1, -1)]
                        extra = ((at - seen).total_seconds(), *moved, sum(moved) / (at - seen).total_seconds(), whole and complete)
                    for side, new in ((bids, b), (asks, a)):
                        for p, q in new:
                            side.pop(p, None) if q == 0 else side.__setitem__(p, q)
                    last, seen, whole, ok = final, at, complete, True
                    if not bids or not asks or max(bids) >= min(asks):
                        problem, extra = "CROSSED", ()
            if problem:
                state, ok, loaded = "OUT_OF_STEP", False, False
            x, y = best()
            out.append((symbol, at, first, final, state, problem, tuple(map(tuple, x)), tuple(map(tuple, y)), *extra))
    return out


@pytest.mark.parametrize("batches", [1, 6])
def test_books_equal_a_plain_loop(spark, tmp_path, batches):
    rows = market(batches, 200)
    if batches > 1:
        rows.sort(key=lambda r: r[4] + dt.timedelta(seconds=random.Random(str(r)).randrange(9)))
    else:
        random.Random(1).shuffle(rows)
    parts = [rows[k * len(rows) // batches : (k + 1) * len(rows) // batches] for k in range(batches)]
    found = streaming.drained(book.books(arriving(spark, parts, BOOKS, tmp_path / "in"), top=3), "books", str(tmp_path / "out")).collect()
    until = max(r[4] for r in rows) - dt.timedelta(seconds=10)
    until = until.replace(microsecond=until.microsecond // 1000 * 1000)  # a watermark is whole milliseconds
    got = []
    for r in found:
        extra = () if r.elapsed_seconds is None else (r.elapsed_seconds, r.bid_added, r.bid_removed, r.ask_added, r.ask_removed, r.churn_per_second, r.provenance_complete)
        got.append((r.symbol, r.observed_at, r.first_id, r.last_id, r.state, r.problem, tuple(map(tuple, r.bids)), tuple(map(tuple, r.asks)), *extra))
        if extra:
            assert ("NO_DISPLAYED_DEPTH_CHANGE" in r.flags) == math.isclose(sum(extra[1:5]), 0) and ("POINT_IN_TIME_PROVENANCE_INCOMPLETE" in r.flags) == (not r.provenance_complete)
    want = replayed(rows, until)
    assert {x[5] for x in want} >= {None, "SILENCE", "GAP", "NOT_SYNCHRONISED", "TIME", "CROSSED", "NOT_BRIDGED"}
    same = lambda x: tuple(round(v, 9) if isinstance(v, float) else v for v in x)
    assert sorted(map(same, got), key=repr) == sorted(map(same, want), key=repr)


def test_levels_and_sides():
    side = book.Side({1.0: 2.0, 3.0: 1.0})
    assert side.change([(1.0, 5.0), (3.0, 0.0), (4.0, 2.0)]) == (11.0, 3.0)
    for level in ((1.0, 5.0), (3.0, 0.0), (4.0, 2.0), (9.0, 0.0)):
        side.put(*level)
    assert side.prices == [1.0, 4.0] and side.quantity == {1.0: 5.0, 4.0: 2.0} and side.changed == {1.0, 3.0, 4.0, 9.0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_registered_books_equal_a_plain_loop(spark):
    rows = [(*(getattr(r, c) for c in ("symbol", "kind", "first_id", "last_id", "observed_at", "available_at", "fetched_at")), *([tuple(x) for x in getattr(r, c)] for c in ("bids", "asks"))) for r in queries.book_events(spark, SF).collect()]
    until = max(r[4] for r in rows) - dt.timedelta(seconds=queries.BOOK_DELAY)
    want = replayed(rows, until.replace(microsecond=until.microsecond // 1000 * 1000), queries.BOOK_SILENCE)
    side = lambda levels: ",".join(f"{p}x{q}" for p, q in levels)
    micros = lambda t: round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    want = [(s, micros(at), first, last, state, problem, side(b), side(a), *(round(v, 4) for v in extra[:5])) for s, at, first, last, state, problem, b, a, *extra in want]
    got = [(r.symbol, r.observed_us, r.first_id, r.last_id, r.state, r.problem, r.bids, r.asks, *(() if r.elapsed_seconds is None else (r.elapsed_seconds, r.bid_added, r.bid_removed, r.ask_added, r.ask_removed))) for r in queries.QUERIES["stream_order_books"](spark, SF).collect()]
    assert len({x[4:6] for x in want}) >= 5 and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["pit_windows_900s", "stream_pit_windows"])
def test_windows_that_begin_at_zero_equal_their_sql(spark, tmp_path, name):
    """A first value of 0 has an infinite return, or none that is a number, as in SQL."""
    at = lambda minute: f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {minute} MINUTE"
    rows = [(46, "view", 0.0), (55, "view", 3.5), (47, "click", 0.0), (57, "click", 0.0), (48, "error", 0.0), (56, "error", -2.0), (50, "signup", 4.0), (58, "signup", 5.0), (115, "view", 1.0), (300, "view", 1.0)]
    values = ", ".join(f"({4 * i}, {at(m)}, {i}, '{kind}', {value}::DOUBLE)" for i, (m, kind, value) in enumerate(rows))
    con = duckdb.connect()
    con.sql(f"create table events as from (values {values}, (99, TIMESTAMP '2024-01-01 01:00:00', 1, 'view', 1.0)) t(event_id, ts, user_id, event_type, value)")
    con.sql(f"copy events to '{tmp_path}/events.parquet'")
    want = con.sql(queries.SQL[name])
    columns = [c for c in want.columns]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    plain = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert plain(got) == plain(want.fetchall())
    returns = [r.return_bps for r in got]
    assert math.inf in returns and -math.inf in returns and any(r is not None and math.isnan(r) for r in returns)


def test_events_that_wait_have_a_timer_a_parcel():
    """However many events of a symbol arrive at once: one entry of the state and one timer for each CHUNK of them."""
    timers, entries = [], {}

    class State:
        containsKey = staticmethod(lambda place: place in entries)
        updateValue = staticmethod(entries.__setitem__)

    kept = book._Books(["symbol"], 1, 3)
    kept.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    kept.waiting = State
    n = 2 * book.CHUNK + 1
    rows = pd.DataFrame({"us": [1000 * i + 1 for i in range(n)][::-1], "last_id": range(n), "kind": "delta", "first_id": range(n), "bids": None, "asks": None, "known": True})
    list(kept.handleInputRows(("x",), iter([rows.iloc[:7], rows.iloc[7:]]), None))
    assert len(timers) == len(entries) == 3 and min(timers) == 1
    assert [e[0] for k in sorted(entries) for e in entries[k][0]] == [1000 * i + 1 for i in range(n)]
