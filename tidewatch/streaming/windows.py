"""Sliding point-in-time windows on a stream: what was known at T of the samples in (T - w, T], for every T of a grid.

A sample counts from the moment on that it was observed, available and fetched: its known time, which is the stream's
event time. Once the watermark passes T, everything that is known at T has arrived, and T's windows are sent, once.
Samples that come early, or whose known time lies in the future, wait in the state; those that come after the watermark
has passed their known time are late, and dropped.

The state of a key is a map of slots, not of samples. All T and all window lengths are multiples of one unit, so samples
of the same unit of observation and the same unit of knowledge are in the same windows, and one row of counts, sums,
first and last sample stands for all of them. A key has at most (longest window / unit) * (longest delay / unit) slots,
however many samples it gets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.operators.microstructure import WINDOWS, described

#: Places of a sample's order in a slot's row: observed, available, fetched (microseconds), value.
_ORDER = 4


class Slots:
    """Rows of slots: n; (known values, sum) of the value and each sum; order of the first and the last sample; for each
    series how many samples have it, and order and value of the first and the last that does."""

    def __init__(self, sums: int, series: int):
        self.sums, self.series = sums, series
        self.ends = 1 + 2 * (1 + sums)
        self.pairs = self.ends + 2 * _ORDER
        self.width = self.pairs + series * (1 + 2 * (_ORDER + 1))

    def of(self, order: np.ndarray, sums: np.ndarray, series: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups, a row for each) of samples: order (samples x 4), sums and series (samples x each; NaN is null)."""
        rank = np.where(np.isnan(order), -np.inf, order)  # a null value is the least
        at = np.lexsort((rank[:, 3], rank[:, 2], rank[:, 1], rank[:, 0], group))
        order, sums, series, group = order[at], sums[at], series[at], group[at]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        last = np.append(first[1:], len(group)) - 1
        out = np.full((len(first), self.width), np.nan)
        out[:, 0] = last - first + 1
        for k, x in enumerate([order[:, 3], *sums.T]):
            out[:, 1 + 2 * k] = np.add.reduceat(~np.isnan(x), first, dtype=np.int64)
            out[:, 2 + 2 * k] = np.add.reduceat(np.nan_to_num(x), first)
        out[:, self.ends : self.ends + _ORDER], out[:, self.ends + _ORDER : self.pairs] = order[first], order[last]
        number = np.repeat(np.arange(len(first)), last - first + 1)
        for k, x in enumerate(series.T):
            have, place = np.flatnonzero(~np.isnan(x)), self.pairs + k * (1 + 2 * (_ORDER + 1))
            out[:, place] = np.bincount(number[have], minlength=len(first))
            own, begin = np.unique(number[have], return_index=True)
            end = np.append(begin[1:], len(have)) - 1
            for j, rows in enumerate((have[begin], have[end] if len(have) else have)):
                out[np.ix_(own, np.arange(place + 1 + j * 5, place + 6 + j * 5))] = np.column_stack([order[rows], x[rows]])
        return group[first], out

    def merged(self, rows: np.ndarray) -> np.ndarray:
        """One row for all of `rows`, one at least."""
        out = rows[0].copy()
        out[: self.ends] = rows[:, : self.ends].sum(axis=0)
        best = lambda block, pick: pick(range(len(block)), key=lambda i: tuple(np.where(np.isnan(block[i, :_ORDER]), -np.inf, block[i, :_ORDER])))
        first, last = rows[:, self.ends : self.ends + _ORDER], rows[:, self.ends + _ORDER : self.pairs]
        out[self.ends : self.ends + _ORDER], out[self.ends + _ORDER : self.pairs] = first[best(first, min)], last[best(last, max)]
        for k in range(self.series):
            place = self.pairs + k * (1 + 2 * (_ORDER + 1))
            out[place] = rows[:, place].sum()
            own = rows[rows[:, place] > 0]
            if len(own):
                first, last = own[:, place + 1 : place + 6], own[:, place + 6 : place + 11]
                out[place + 1 : place + 6], out[place + 6 : place + 11] = first[best(first, min)], last[best(last, max)]
        return out


class _Windows(StatefulProcessor):
    """State of a key: its slots, and the last T of which windows were sent. Times are microseconds."""

    def __init__(self, keys: list[str], unit: int, every: int, windows: list[int], sums: list[str], series: list[str]):
        self.keys, self.unit, self.every, self.windows, self.sums, self.series = keys, unit, every, windows, sums, series
        self.slots = Slots(len(sums), len(series))

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getMapState("slots", "observed bigint, known bigint", "row array<double>")
        self.sent = handle.getValueState("sent", "at bigint")

    @staticmethod
    def _columns(pdf: pd.DataFrame, kind: str, names: list[str]) -> np.ndarray:
        return pdf[[f"{kind}{k}" for k in range(len(names))]].to_numpy(float)

    def _first_at(self, known: int) -> int:
        """The first T of the grid at which a slot of this unit of knowledge counts."""
        return -(-known * self.unit // self.every) * self.every

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wake = None
        for pdf in (p for p in rows if len(p)):
            order = pdf[["us_t", "us_a", "us_f", "v"]].to_numpy(float)
            times = pdf[["us_t", "us_a", "us_f"]].to_numpy(np.int64)
            observed, known = -(-times[:, 0] // self.unit), -(-times.max(axis=1) // self.unit)
            use = observed * self.unit > -(-known * self.unit // self.every) * self.every - max(self.windows)  # else never in a window
            both, group = np.unique(np.column_stack([observed, known])[use], axis=0, return_inverse=True)
            if not len(both):
                continue
            numbers, made = self.slots.of(order[use], self._columns(pdf, "sum", self.sums)[use], self._columns(pdf, "series", self.series)[use], group.reshape(-1))
            for (o, k), row in zip(both[numbers].tolist(), made):
                old = self.state.getValue((o, k))
                self.state.updateValue((o, k), ((row if old is None else self.slots.merged(np.stack([np.array(old[0], float), row]))).tolist(),))
            soon = min(self._first_at(int(k)) for k in both[:, 1])
            wake = soon if wake is None else min(wake, soon)
        if wake is not None:
            self.handle.registerTimer(wake // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000 // self.every * self.every
        done = self.sent.get()[0] if self.sent.exists() else None
        if done is not None and done >= upto:
            yield pd.DataFrame()
            return
        held = [(o, k, row[0]) for (o, k), row in self.state.iterator()]
        observed, known = (np.array([h[i] for h in held], np.int64) * self.unit for i in (0, 1))
        values = np.array([h[2] for h in held], float).reshape(len(held), self.slots.width)
        begins = -(-known // self.every) * self.every
        out, at = [], min(begins.tolist(), default=upto + self.every)
        at = at if done is None else max(at, done + self.every)
        while at <= upto:
            usable = known <= at
            for w in self.windows:
                mine = np.flatnonzero(usable & (observed > at - w))
                if len(mine):
                    out.append((at, w, self.slots.merged(values[mine])))
            at += self.every
        self.sent.update((upto,))
        need = np.maximum(begins, upto + self.every)  # the next T that a slot may count at
        dead = observed <= need - max(self.windows)
        for i in np.flatnonzero(dead).tolist():
            self.state.removeKey((held[i][0], held[i][1]))
        if (~dead).any():
            self.handle.registerTimer(int(need[~dead].min()) // 1000)
        yield self._frame(key, out)

    def _frame(self, key: tuple, out: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        if not out:
            return pd.DataFrame()
        s, rows = self.slots, np.stack([r for _, _, r in out])
        known = lambda k: np.where(rows[:, 1 + 2 * k] > 0, rows[:, 2 + 2 * k], np.nan)
        frame = {c: [v] * len(out) for c, v in zip(self.keys, key)}
        frame |= {"_us": [a for a, _, _ in out], "seconds": [w // 1_000_000 for _, w, _ in out], "n": rows[:, 0].astype(np.int64), "first_value": rows[:, s.ends + 3], "last_value": rows[:, s.ends + 7], "total": known(0)}
        frame |= {"_first": rows[:, s.ends] / 1e6, "_last": rows[:, s.ends + 4] / 1e6, "_fetched": rows[:, s.ends + 6] / 1e6}
        frame |= {c: known(k + 1) for k, c in enumerate(self.sums)}
        for k, c in enumerate(self.series):
            place = s.pairs + k * 11
            for j, end in enumerate(("first", "last")):
                frame[f"{c}_{end}"] = np.where(rows[:, place] >= 2, rows[:, place + 5 + 5 * j], np.nan)
        return pd.DataFrame(frame)


def sliding_windows(samples: DataFrame, every: int, windows: Sequence[int], event_time: str, value: Column, available: Column, fetched: Column, keys: Sequence[str], delay: str = "10 minutes", sums: Mapping[str, Column] | None = None, series: Mapping[str, Column] | None = None) -> DataFrame:
    """The stream of what `trailing_windows` says of a table: a row for each key, T and window (column `seconds`) that has a
    sample, for T on the grid of `every` seconds, sent once the watermark (the known time less `delay`) has passed T.

    samples is a stream; times are timestamps. Rows without availability or fetch are never known and left out. A null
    value counts as a sample; equal samples count as often as they come. A key's order of arrival doesn't matter within
    `delay`. Needs the RocksDB state store (`streaming.drained` sets it)."""
    if not set(windows) <= set(WINDOWS):
        raise ValueError(f"windows of {sorted(set(windows) - set(WINDOWS))} seconds; there are {sorted(WINDOWS)}")
    sums, series, keys = dict(sums or {}), dict(series or {}), list(keys)
    stamp = lambda c: F.unix_micros(c.cast("timestamp"))
    t, kinds = F.col(event_time), {f.name: f.dataType.simpleString() for f in samples.schema}
    known = F.greatest(*(c.cast("timestamp") for c in (t, available, fetched)))
    rows = samples.where(t.isNotNull() & available.isNotNull() & fetched.isNotNull()).select(
        *keys, known.alias("_known"), stamp(t).alias("us_t"), stamp(available).alias("us_a"), stamp(fetched).alias("us_f"), value.cast("double").alias("v"),
        *(c.cast("double").alias(f"{kind}{k}") for kind, named in (("sum", sums), ("series", series)) for k, c in enumerate(named.values())),  # rows reach Python as named tuples: no leading underscore
    ).withWatermark("_known", delay)
    unit = math.gcd(every, *windows)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_us bigint, seconds bigint, n bigint, first_value double, last_value double, total double, _first double, _last double, _fetched double", *(f"`{k}` double" for k in sums), *(f"`{k}_{end}` double" for k in series for end in ("first", "last"))])
    us = 1_000_000
    state = _Windows(keys, unit * us, every * us, [w * us for w in sorted(set(windows))], list(sums), list(series))
    found = rows.groupBy(*keys).transformWithStateInPandas(state, out, "Append", "EventTime")
    doubles = [c for c, kind in found.dtypes if kind == "double"]
    found = found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles} | {"at": F.timestamp_micros("_us"), "_at": F.col("_us") / 1e6})
    limit = lambda k: F.element_at(F.create_map(*(F.lit(x) for w in WINDOWS for x in (w, WINDOWS[w][k]))), F.col("seconds").cast("int"))
    return described(found, "at", [*keys, "seconds"], F.col("seconds"), limit(0), limit(1), list(sums), list(series))
