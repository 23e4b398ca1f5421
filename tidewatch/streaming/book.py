"""Order books as level state of a symbol on a stream, with their best levels and the dynamics of each change.

A snapshot loads the book, which is not synchronised until the first delta that bridges it (first_id <= last + 1 <=
last_id). Then deltas follow one another: one that is older than the book is passed over, and each of these puts the book
out of step until the next snapshot: a gap in the numbers (GAP), a first delta that doesn't bridge (NOT_BRIDGED), a time
that doesn't advance (TIME), a price twice on a side (DUPLICATE_LEVEL), an empty or crossed book (CROSSED), and silence:
no delta within `silence` seconds of the last one (SILENCE, sent by a timer at that moment, whether or not one follows).

Events count in order of observation, then number, snapshots first; the watermark on observation says when all before
have arrived, and until then events wait in the state. So the order of arrival doesn't matter within the watermark's delay.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LEVELS = "array<struct<price:double,quantity:double>>"
#: Rows of the result. state: SNAPSHOT, SYNCHRONISED, STALE (passed over) or OUT_OF_STEP, then with the problem.
ROWS = f"observed_at timestamp, first_id bigint, last_id bigint, state string, problem string, bids {LEVELS}, asks {LEVELS}, elapsed_seconds double, bid_added double, bid_removed double, ask_added double, ask_removed double, churn_per_second double, provenance_complete boolean, flags array<string>"
_NAMES = "observed_at first_id last_id state problem bids asks elapsed_seconds bid_added bid_removed ask_added ask_removed churn_per_second provenance_complete flags".split()
#: What is known of a book: last number, whether it is loaded and in step, when it was last observed (microseconds), and whether
#: that event had its availability and fetch.
BOOK = "last_id bigint, loaded boolean, synchronised boolean, observed bigint, known boolean"

#: Events that wait in one entry of a symbol's state, at most.
CHUNK = 1000


class Side:
    """Levels of one side: quantities by price, prices in order, and which prices have changed since they were stored."""

    def __init__(self, levels: dict[float, float]):
        self.quantity, self.prices, self.changed = dict(levels), sorted(levels), set()

    def put(self, price: float, quantity: float) -> None:
        self.changed.add(price)
        if quantity == 0:
            if self.quantity.pop(price, None) is not None:
                del self.prices[bisect_left(self.prices, price)]
        else:
            if price not in self.quantity:
                insort(self.prices, price)
            self.quantity[price] = quantity

    def load(self, levels: list[tuple[float, float]]) -> None:
        for price in list(self.prices):
            self.put(price, 0)
        for price, quantity in levels:
            self.put(price, quantity)

    def change(self, levels: list[tuple[float, float]]) -> tuple[float, float]:
        """(notional that the levels add, notional that they remove)."""
        moved = [price * (quantity - self.quantity.get(price, 0.0)) for price, quantity in levels]
        return sum(x for x in moved if x > 0), sum(-x for x in moved if x < 0)


class Book:
    """A book and its state machine; times are microseconds."""

    def __init__(self, bids: dict, asks: dict, last: int = -1, loaded: bool = False, synchronised: bool = False, observed: int = -1, known: bool = False, silence: int = 2_000_000, top: int = 100):
        self.bids, self.asks = Side(bids), Side(asks)
        self.last, self.loaded, self.synchronised, self.observed, self.known, self.silence, self.top = last, loaded, synchronised, observed, known, silence, top

    def best(self) -> tuple[list, list]:
        """The best levels of each side, best first; none while the book is out of step."""
        if not self.synchronised:
            return [], []
        bids, asks = self.bids.prices[-self.top :][::-1], self.asks.prices[: self.top]
        return [(p, self.bids.quantity[p]) for p in bids], [(p, self.asks.quantity[p]) for p in asks]

    def _row(self, at: int, first: int | None, last: int, state: str, problem: str | None = None, dynamics: tuple = (None,) * 8) -> tuple:
        return (at, first, last, state, problem, *self.best(), *dynamics)

    def _fail(self, at: int, first: int | None, last: int, problem: str) -> tuple:
        self.synchronised = self.loaded = False
        return self._row(at, first, last, "OUT_OF_STEP", problem)

    def quiet(self, now: int) -> tuple | None:
        """The row of a book that has been silent for too long at `now`."""
        if self.synchronised and now > self.observed + self.silence:
            return self._fail(self.observed + self.silence, None, self.last, "SILENCE")
        return None

    def apply(self, at: int, kind: str, first: int, last: int, bids: list, asks: list, known: bool) -> tuple:
        """The row of one event, which comes after `quiet`."""
        if kind == "snapshot":
            self.bids.load(bids)
            self.asks.load(asks)
            # A snapshot has no availability of its own, so the first change after it is of incomplete provenance.
            self.last, self.loaded, self.synchronised, self.observed, self.known = last, True, False, at, False
            return self._row(at, None, last, "SNAPSHOT")
        if not self.loaded:
            return self._row(at, first, last, "OUT_OF_STEP", "NOT_SYNCHRONISED")
        if not self.synchronised:
            if not first <= self.last + 1 <= last:
                return self._fail(at, first, last, "NOT_BRIDGED")
            return self._changed(at, first, last, bids, asks, known, (None,) * 8)
        if last <= self.last:
            return self._row(at, first, last, "STALE")
        if at <= self.observed:
            return self._fail(at, first, last, "TIME")
        if any(len({p for p, _ in side}) < len(side) for side in (bids, asks)):
            return self._fail(at, first, last, "DUPLICATE_LEVEL")
        if first > self.last + 1:
            return self._fail(at, first, last, "GAP")
        elapsed, moved = (at - self.observed) / 1e6, (*self.bids.change(bids), *self.asks.change(asks))
        whole = self.known and known
        flags = ["TRADE_ATTRIBUTION_REQUIRED", *["POINT_IN_TIME_PROVENANCE_INCOMPLETE"] * (not whole), *["NO_DISPLAYED_DEPTH_CHANGE"] * (sum(moved) == 0)]
        return self._changed(at, first, last, bids, asks, known, (elapsed, *moved, sum(moved) / elapsed, whole, flags))

    def _changed(self, at: int, first: int, last: int, bids: list, asks: list, known: bool, dynamics: tuple) -> tuple:
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for price, quantity in levels:
                side.put(price, quantity)
        self.last, self.observed, self.known, self.synchronised = last, at, known, True
        if not self.bids.prices or not self.asks.prices or self.bids.prices[-1] >= self.asks.prices[0]:
            return self._fail(at, first, last, "CROSSED")
        return self._row(at, first, last, "SYNCHRONISED", None, dynamics)


class _Books(StatefulProcessor):
    """State of a symbol: a map of levels for each side, what is known of the book, and events that wait for the watermark, in
    parcels of CHUNK at most by the time of their first. A parcel has one timer, whatever it holds."""

    def __init__(self, keys: list[str], silence: int, top: int):
        self.keys, self.silence, self.top = keys, silence, top

    def init(self, handle) -> None:
        self.handle = handle
        self.bids = handle.getMapState("bids", "price double", "quantity double")
        self.asks = handle.getMapState("asks", "price double", "quantity double")
        self.book = handle.getValueState("book", BOOK)
        self.waiting = handle.getMapState("waiting", "observed bigint, parcel bigint", f"events array<struct<us:bigint,number:bigint,late:boolean,kind:string,first:bigint,bids:{LEVELS},asks:{LEVELS},known:boolean>>")

    def _keep(self, events: list[tuple]) -> None:
        """Stores events, in the order in which they count."""
        events.sort()
        for i in range(0, len(events), CHUNK):
            at, parcel = events[i][0], 0
            while self.waiting.containsKey((at, parcel)):
                parcel += 1
            self.waiting.updateValue((at, parcel), (events[i : i + CHUNK],))
            self.handle.registerTimer(-(-at // 1000))  # the watermark counts whole milliseconds

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        levels = lambda x: [] if x is None else [(float(y["price"]), float(y["quantity"])) for y in x]
        self._keep([(int(r.us), int(r.last_id), r.kind != "snapshot", r.kind, int(r.first_id), levels(r.bids), levels(r.asks), bool(r.known)) for pdf in rows for r in pdf.itertuples(index=False)])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parcels = [tuple(k) for k in self.waiting.keys() if k[0] <= now]
        known = self.book.get() if self.book.exists() else ()
        if not parcels and not (known and known[2] and now > known[3] + self.silence):
            yield pd.DataFrame()
            return
        book = Book(*({p[0]: q[0] for p, q in side.iterator()} for side in (self.bids, self.asks)), *known, silence=self.silence, top=self.top)
        pairs = lambda side: [(x[0], x[1]) for x in side]
        due, later, rows = [], [], []
        for parcel in parcels:
            for us, number, late, kind, first, bids, asks, complete in self.waiting.getValue(parcel)[0]:
                (due if us <= now else later).append((us, number, late, kind, first, pairs(bids), pairs(asks), complete))
            self.waiting.removeKey(parcel)
        self._keep(later)
        for us, number, _, kind, first, bids, asks, complete in sorted(due):
            rows.append(book.quiet(us))
            rows.append(book.apply(us, kind, first, number, bids, asks, complete))
        rows.append(book.quiet(now))
        for side, state in ((book.bids, self.bids), (book.asks, self.asks)):
            for price in side.changed:  # only these are written
                if price in side.quantity:
                    state.updateValue((price,), (side.quantity[price],))
                elif state.containsKey((price,)):
                    state.removeKey((price,))
        self.book.update((book.last, book.loaded, book.synchronised, book.observed, book.known))
        if book.synchronised:
            self.handle.registerTimer((book.observed + self.silence) // 1000 + 1)
        frame = pd.DataFrame([r for r in rows if r is not None], columns=_NAMES)
        frame["observed_at"] = pd.to_datetime(frame["observed_at"], unit="us")
        for name in ("bids", "asks"):
            frame[name] = [[{"price": p, "quantity": q} for p, q in x] for x in frame[name]]
        for k, v in zip(self.keys, key):
            frame.insert(0, k, v)
        yield frame


def books(events: DataFrame, key: str = "symbol", delay: str = "10 seconds", silence: float = 2.0, top: int = 100) -> DataFrame:
    """A row for each event of a stream of books, and one where a book falls silent: `key` and ROWS.

    In: `key`, kind ('snapshot' or 'delta'), first_id, last_id, observed_at, available_at, fetched_at (timestamps; the last two
    may be null, then provenance is incomplete), bids and asks (arrays of price and quantity; quantity 0 deletes; null is
    none). Rows without observed_at or last_id are left out; a null first_id is last_id. Levels are sent best first, `top`
    of a side at most, and none while a book is out of step. Equal events come out as often as they come in. Needs the
    RocksDB state store (`streaming.drained` sets it)."""
    times = [F.col(c).cast("timestamp") for c in ("available_at", "fetched_at")]
    rows = events.where("observed_at is not null and last_id is not null").select(
        key, F.col("observed_at").cast("timestamp").alias("_at"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("us"), "kind", F.coalesce("first_id", "last_id").alias("first_id"), "last_id", F.col("bids").cast(LEVELS).alias("bids"), F.col("asks").cast(LEVELS).alias("asks"), (times[0].isNotNull() & times[1].isNotNull()).alias("known")
    ).withWatermark("_at", delay)
    out = f"`{key}` {events.schema[key].dataType.simpleString()}, {ROWS}"
    return rows.groupBy(key).transformWithStateInPandas(_Books([key], round(silence * 1e6), top), out, "Append", "EventTime")
