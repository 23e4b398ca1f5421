"""Exact nearest analogs over an index of pivots: many scenarios of metric, components and filters in one pass of history.

The index keeps history by cells, sorted by the distance to the cell's pivot. Each query has a normaliser of its own, the
means and deviations of what it may be compared with, as a scale of its own for every component. The index measures by the
scales of all history; a query's distances are at least the index's, times the smallest ratio of the two scales. So by the
triangle inequality a row at distance r from its pivot is at least ratio * |d(query, pivot) - r| away from the query. Cells
and rows beyond the k-th best that a query has so far are passed over, nearest cells first; what is left is measured.

Cosine distances of vectors that each query centres anew have no such bound: for that metric all candidates are measured.
Measuring is by matrices of rows and queries, so a pair costs some products, and memory is that of a matrix, whatever the
length of history: vectors of many components that don't cluster are measured nearly all, their number times the queries'.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.scratch import kept

#: Queries that one pass takes, pivots, and rows of the sample that pivots come from (and first bounds on the k-th best).
BLOCK, PIVOTS, SAMPLE = 2000, 256, 2048
#: Pairs that are measured at once, rows and queries of a matrix, and what rounding may cost a bound.
PAIRS, TILE, SLACK = 100_000, 512, 1e-9
METRICS = ("euclidean", "manhattan", "cosine")


@dataclass(frozen=True)
class Scenario:
    """What a query is compared with and how: `excluded` components are left out, lookback is a bound on the age in the
    unit of `time`, providers are those that count (all, if there are none)."""

    name: str
    metric: str = "euclidean"
    excluded: tuple[int, ...] = ()
    k: int = 5
    min_history: int = 20
    same_regime: bool = False
    lookback: int | None = None
    providers: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.metric not in METRICS or self.k < 1 or self.min_history < self.k or (self.lookback is not None and self.lookback <= 0):
            raise ValueError(f"scenario {self.name}")


@dataclass(frozen=True)
class Index:
    """History by cell (-1 where a component is unknown), with each row's distances to its pivot in every space."""

    table: DataFrame
    spaces: tuple[tuple[int, ...], ...]
    means: np.ndarray
    scales: np.ndarray
    pivots: np.ndarray
    sample: dict[str, np.ndarray] = field(repr=False)


def _columns(batch: pa.RecordBatch | pa.Table, size: int) -> dict[str, np.ndarray]:
    """Columns of rows as arrays; vectors as a matrix, unknown components as NaN."""
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), float)
    text = lambda c: np.array(["" if x is None else x for x in batch.column(c).to_pylist()], object)
    whole = lambda c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy(), np.int64)
    return {"time": whole("time"), "known": whole("known"), "regime": text("regime"), "provider": text("provider"), "v": flat.reshape(-1, size)}


def _selected(size: int, excluded: Sequence[int]) -> np.ndarray:
    return np.array([k for k in range(size) if k not in set(excluded)], np.int64)


def build(history: DataFrame, size: int, spaces: Sequence[tuple[int, ...]] = ((),), pivots: int = PIVOTS) -> Index:
    """The index of history: time (bigint, unique), known (bigint: from when on it may be used), regime and provider (strings),
    v (array of `size` doubles, null where unknown). spaces: the sets of excluded components that scenarios will ask for;
    a scenario of another set is answered too, without bounds. Pivots are far from one another in a sample of the smallest
    hashes. Rows without time, known or v are left out."""
    rows = history.where("time is not null and known is not null and v is not null").select("time", "known", "regime", "provider", "v")
    stats = rows.agg(*(f(F.get("v", k)).alias(f"{n}{k}") for k in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()  # two numbers a component
    means = np.array([stats[f"m{k}"] or 0.0 for k in range(size)])
    scales = np.array([stats[f"s{k}"] if (stats[f"s{k}"] or 0) > 1e-12 else 1.0 for k in range(size)])
    sample = _columns(rows.orderBy(F.xxhash64("time"), "time").limit(SAMPLE).toArrow(), size)
    z = (sample["v"] - means) / scales
    z = z[~np.isnan(z).any(axis=1)]
    chosen = [0] if len(z) else []
    far = np.sqrt(((z - z[0]) ** 2).sum(axis=1)) if len(z) else np.empty(0)
    while len(chosen) < min(pivots, len(z)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((z - z[chosen[-1]]) ** 2).sum(axis=1)))
    centres, spaces = z[chosen].reshape(len(chosen), size), tuple(dict.fromkeys(map(tuple, spaces)))
    names = [f"{m}{k}" for k in range(len(spaces)) for m in ("l2_", "l1_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_columns(batch, size)["v"] - means) / scales
            clear = np.flatnonzero(~np.isnan(x).any(axis=1)) if len(centres) else np.empty(0, np.int64)
            cell, out = np.full(len(x), -1, np.int32), [np.full(len(x), np.nan) for _ in names]
            if len(clear):
                near = (x[clear] ** 2).sum(axis=1)[:, None] - 2 * x[clear] @ centres.T + (centres**2).sum(axis=1)
                cell[clear] = near.argmin(axis=1)
                gap = np.abs(x[clear] - centres[cell[clear]])
                for k, excluded in enumerate(spaces):
                    own = gap[:, _selected(size, excluded)]
                    out[2 * k][clear], out[2 * k + 1][clear] = np.sqrt((own**2).sum(axis=1)), own.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), *map(pa.array, out)], names=[*batch.schema.names, "cell", *names])

    made = rows.mapInArrow(run, "time bigint, known bigint, regime string, provider string, v array<double>, cell int, " + ", ".join(f"{n} double" for n in names))
    # A cell with a third of all rows is split by distance, then by time.
    dealt = made.repartitionByRange("cell", "l2_0", "time").sortWithinPartitions("cell", "l2_0", "time")
    return Index(kept(dealt, "analogs"), spaces, means, scales, centres, sample)


@dataclass
class _Asked:
    """Queries of a block as arrays."""

    time: np.ndarray
    cutoff: np.ndarray
    regime: np.ndarray
    v: np.ndarray


def _fits(rows: dict[str, np.ndarray], s: Scenario) -> np.ndarray:
    """Which rows any query may be compared with: all selected components known, and a provider that counts."""
    clear = ~np.isnan(rows["v"][:, _selected(rows["v"].shape[1], s.excluded)]).any(axis=1)
    return clear & np.isin(rows["provider"].astype(str), s.providers) if s.providers else clear


def _by_regime(rows: dict[str, np.ndarray], asked: _Asked, s: Scenario, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows and of queries that may meet by their regime."""
    if not s.same_regime:
        yield np.arange(len(rows["time"])), some
        return
    regimes, own = rows["regime"].astype(str), asked.regime[some].astype(str)
    for name in np.unique(regimes):
        mine = some[own == name]
        if len(mine):
            yield np.flatnonzero(regimes == name), mine


def _sums(rows: dict[str, np.ndarray], asked: _Asked, s: Scenario, means: np.ndarray) -> np.ndarray:
    """queries x (1 + 2 * size): number, sums and squares of the components of what each may be compared with. Rows of equal
    regime and provider stand by known time, so a query is a difference of running sums. With a lookback they stand by time:
    a query's rows are a slice of it, and only rows nearer to its cutoff than the longest delay are looked at each."""
    size, fit = rows["v"].shape[1], _fits(rows, s)
    rows = {k: a[fit] for k, a in rows.items()}
    x = np.nan_to_num(rows["v"] - means)
    data, out = np.column_stack([np.ones(len(x)), x, x**2]), np.zeros((len(asked.time), 1 + 2 * size))
    for rest, mine in _by_regime(rows, asked, s, np.arange(len(asked.time))) if len(x) else ():
        by = "known" if s.lookback is None else "time"
        order = rest[np.argsort(rows[by][rest], kind="stable")]
        known, time, cutoff = rows["known"][order], rows["time"][order], asked.cutoff[mine]
        running = np.vstack([np.zeros(data.shape[1]), np.cumsum(data[order], axis=0)])
        if s.lookback is None:
            out[mine] += running[np.searchsorted(known, cutoff, side="left")]
        else:
            delay = known - time
            first = np.searchsorted(time, asked.time[mine] - s.lookback, side="left")
            sure = np.maximum(first, np.searchsorted(time, cutoff - delay.max(), side="left"))  # before it: known in time
            last = np.maximum(sure, np.searchsorted(time, cutoff - delay.min(), side="left"))  # from it on: known too late
            out[mine] += running[sure] - running[first]
            q = 0
            while q < len(mine):  # as many queries as have some PAIRS to look at
                end = max(q + 1, int(np.searchsorted(np.cumsum((last - sure)[q:]), PAIRS, side="right")) + q)
                n = (last - sure)[q:end]
                at = np.repeat(np.arange(q, end), n)
                row = np.arange(len(at)) + np.repeat(sure[q:end] - np.cumsum(n) + n, n)
                ok = known[row] < cutoff[at]
                np.add.at(out, mine[at[ok]], data[order[row[ok]]])
                q = end
        # A query that is history itself is no candidate of its own.
        sorted_time, place = np.sort(rows["time"][rest]), rest[np.argsort(rows["time"][rest], kind="stable")]
        i = np.minimum(np.searchsorted(sorted_time, asked.time[mine]), len(rest) - 1)
        own = (sorted_time[i] == asked.time[mine]) & (rows["known"][place[i]] < cutoff)
        out[mine[own]] -= data[place[i[own]]]
    return out


def _measure(x: np.ndarray, q: np.ndarray, mean: np.ndarray, scale: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of vectors under each pair's normaliser."""
    a, b = (x - mean) / scale, (q - mean) / scale
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    if metric == "manhattan":
        return np.abs(a - b).sum(axis=1)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    zero = (na <= 1e-12) | (nb <= 1e-12)
    cosine = 1 - np.clip((a * b).sum(axis=1) / np.where(zero, 1, na * nb), -1, 1)
    return np.where((na <= 1e-12) & (nb <= 1e-12), 0.0, np.where(zero, 1.0, cosine))


class _Rough:
    """Distances of rows and queries as matrices, up to rounding: a normaliser of each query's own is a weight and a shift, so
    Euclidean and cosine distances are products of matrices. `scale` is as _measure has it."""

    def __init__(self, metric: str, v: np.ndarray, mean: np.ndarray, scale: np.ndarray, centre: np.ndarray):
        self.metric, self.centre = metric, centre
        self.q, shift = v - centre, mean - centre
        self.weight = 1 / scale**2 if metric != "manhattan" else 1 / scale
        if metric == "manhattan":
            self.about = (np.abs(self.q) * self.weight).sum(axis=1)
            return
        point = self.q if metric == "euclidean" else shift
        self.square = np.hstack([self.weight, -2 * self.weight * point])
        self.about = (self.weight * point**2).sum(axis=1)
        if metric == "cosine":
            self.product = self.weight * (self.q - shift)
            self.less = (self.product * shift).sum(axis=1)
            self.length = np.sqrt((self.weight * (self.q - shift) ** 2).sum(axis=1))

    def of(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        """rows x some: distances, less what rounding may have added to them."""
        x = x - self.centre
        if self.metric == "manhattan":
            out = np.empty((len(x), len(some)))
            for j, q in enumerate(some):
                gap = x - self.q[q]
                out[:, j] = np.abs(gap, out=gap) @ self.weight[q]
            return out - SLACK * (out + self.about[some])
        square = np.hstack([x * x, x]) @ self.square[some].T + self.about[some]
        if self.metric == "euclidean":
            return np.sqrt(np.maximum(0, square * (1 - SLACK) - SLACK * self.about[some]))
        # A row that all but equals the mean has lost its length to rounding: it counts as nearest, and is measured.
        lost = (square <= 1e-3 * self.about[some] + 1e-20) | (self.length[some] <= 1e-10)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = 1 - (x @ self.product[some].T - self.less[some]) / (np.sqrt(square) * self.length[some])
        return np.where(lost, -1.0, far - SLACK)


class _Search:
    """A task's best candidates of every query in one scenario, and how many pairs it has measured. Rows and queries meet as
    matrices of TILE rows; the pairs of one that may be among the k nearest are measured again, each by itself."""

    def __init__(self, s: Scenario, index: dict, asked: _Asked, mean: np.ndarray, scale: np.ndarray, ready: np.ndarray):
        self.s, self.asked, self.mean, self.scale, self.ready = s, asked, mean, scale, ready
        self.own = own = _selected(asked.v.shape[1], s.excluded)
        self.rough = _Rough(s.metric, asked.v[:, own], mean[:, own], scale[:, own], index["means"][own])
        m = len(asked.time)
        self.n, self.time, self.distance = np.zeros(m, np.int64), np.zeros((m, s.k), np.int64), np.full((m, s.k), np.inf)
        self.bound, self.measured = np.full(m, np.inf), 0
        self.space = index["spaces"].index(s.excluded) if s.excluded in index["spaces"] and s.metric != "cosine" and len(index["pivots"]) else None
        if self.space is not None:
            gap = lambda p: np.abs((asked.v - index["means"]) / index["scales"] - p)[:, own]
            self.to_pivot = np.stack([(np.sqrt((gap(p) ** 2).sum(axis=1)) if s.metric == "euclidean" else gap(p).sum(axis=1)) for p in index["pivots"]], axis=1)
            self.ratio = (index["scales"][own] / scale[:, own]).min(axis=1)

    def add(self, rows: dict[str, np.ndarray], some: np.ndarray, count: bool = True, cell: int = -1, radius: np.ndarray | None = None) -> None:
        """Measures the allowed pairs of rows with the queries `some`; of a cell's rows those that its pivot doesn't part."""
        fit = np.flatnonzero(_fits(rows, self.s))
        if not len(fit):
            return
        rows = {k: rows[k][fit] for k in ("time", "known", "regime", "v")}
        some = some[np.argsort(self.asked.cutoff[some], kind="stable")]
        for at, mine in _by_regime(rows, self.asked, self.s, some):
            at = at[np.argsort(rows["known"][at], kind="stable")]
            for i in range(0, len(at), TILE):
                part = at[i : i + TILE]
                known, time = rows["known"][part], rows["time"][part]
                q = mine[np.searchsorted(self.asked.cutoff[mine], known[0], side="right") :]  # what comes after the first of them
                if self.s.lookback is not None:
                    q = q[self.asked.time[q] - self.s.lookback <= time.max()]
                for j in range(0, len(q), TILE):
                    self._tile(known, time, rows["v"][part][:, self.own], q[j : j + TILE], count, cell, None if radius is None else radius[fit[part]])

    def _tile(self, known: np.ndarray, time: np.ndarray, x: np.ndarray, some: np.ndarray, count: bool, cell: int, radius: np.ndarray | None) -> None:
        own, last = self.asked.time[some], self.asked.cutoff[some]
        ok = known[:, None] < last
        ok &= time[:, None] != own
        if self.s.lookback is not None:
            ok &= time[:, None] >= own - self.s.lookback
        if radius is not None:
            ok &= np.abs(radius[:, None] - self.to_pivot[some, cell]) * self.ratio[some] * (1 - SLACK) - SLACK <= self.bound[some]
        self.measured += int(ok.sum()) * count
        r, c = ok.any(axis=1), ok.any(axis=0)
        if not r.all() or not c.all():
            ok, time, x, some = ok[r][:, c], time[r], x[r], some[c]
        if not ok.size:
            return
        rough = np.where(ok, self.rough.of(x, some), np.inf)
        limit = self.bound[some]
        if np.isinf(limit).any() and len(x) > self.s.k:  # no k rows yet: these k, whatever rounding has done to them
            limit = np.minimum(limit, self._kth(rough, x, some))
        r, c = np.nonzero(ok & ~(rough > limit))
        for i in range(0, len(r), PAIRS):
            row, q = r[i : i + PAIRS], some[c[i : i + PAIRS]]
            far = _measure(x[row], self.asked.v[q][:, self.own], self.mean[q][:, self.own], self.scale[q][:, self.own], self.s.metric)
            good = far <= self.bound[q]
            self._keep(q[good], time[row][good], far[good])

    def _kth(self, rough: np.ndarray, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The largest distance of the k rows that are nearest by rough ones: a bound on each query's k-th best."""
        k = self.s.k
        near = np.argpartition(rough, k - 1, axis=0)[:k]
        q = np.tile(some, k)
        far = _measure(x[near.ravel()], self.asked.v[q][:, self.own], self.mean[q][:, self.own], self.scale[q][:, self.own], self.s.metric)
        far = np.where(np.isinf(np.take_along_axis(rough, near, axis=0)), np.inf, far.reshape(k, -1)).max(axis=0)
        return np.where(np.isnan(far), np.inf, far * (1 + SLACK) + SLACK)

    def _keep(self, query: np.ndarray, time: np.ndarray, distance: np.ndarray) -> None:
        if not len(query):
            return
        who, at = np.unique(query, return_inverse=True)
        had = np.arange(self.s.k) < self.n[who][:, None]
        query = np.append(np.nonzero(had)[0], at)
        time, distance = np.append(self.time[who][had], time), np.append(self.distance[who][had], distance)
        order = np.lexsort((time, distance, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        stay = rank < self.s.k
        place = who[query[stay]], rank[stay]
        self.time[place], self.distance[place] = time[order][stay], distance[order][stay]
        self.n[who] = np.minimum(self.s.k, np.bincount(query, minlength=len(who)))
        full = who[self.n[who] == self.s.k]
        # The same pair may come out an ulp apart in another batch.
        self.bound[full] = np.minimum(self.bound[full], self.distance[full, -1] * (1 + SLACK) + SLACK)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, times and distances of what is kept."""
        q, r = np.nonzero(np.arange(self.s.k) < self.n[:, None])
        return q, self.time[q, r], self.distance[q, r]

    def start(self, sample: dict[str, np.ndarray]) -> None:
        """First bounds by the sample, whose rows are met again where they stand in history."""
        self.add(sample, self.ready, count=False)
        self.n[:] = 0

    def batch(self, rows: dict[str, np.ndarray], cell: np.ndarray, radius: np.ndarray | None) -> None:
        if self.space is None:
            return self.add(rows, self.ready)
        edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        parts = [(int(cell[i]), i, j) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
        low = {(p, i): self._least(p, radius[i:j]) for p, i, j in parts}
        for p, i, j in sorted(parts, key=lambda x: float(low[x[0], x[1]].sum())):  # nearest cells first
            part, some = {k: a[i:j] for k, a in rows.items()}, self.ready[low[p, i] <= self.bound[self.ready]]
            self.add(part, some, True, p, None if p < 0 else radius[i:j])

    def _least(self, p: int, radius: np.ndarray) -> np.ndarray:
        """The least distance of each ready query to a row of the cell."""
        if p < 0:
            return np.zeros(len(self.ready))
        to = self.to_pivot[self.ready, p]
        return np.maximum(0, np.maximum(to - radius.max(), radius.min() - to)) * self.ratio[self.ready] * (1 - SLACK) - SLACK


def search(index: Index, queries: DataFrame, scenarios: Sequence[Scenario]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, states, work) of every query in every scenario.

    queries: query (bigint), time (bigint), cutoff (bigint), regime, v; a stated set, taken in blocks of BLOCK. A row of history
    may be compared with a query if it is known before the cutoff, isn't the query's own time, has all components that the
    scenario selects and passes its filters. matches: query, scenario, candidate (its time), distance, rank: the k nearest,
    equal distances by time. states: query, scenario, n (what it may be compared with) and reasons (an empty array if it is
    READY): QUERY_REGIME_NO_DATA, MISSING_SIGNALS, INSUFFICIENT_HISTORY. work: scenario, measured, possible (pairs). Empty
    tables give no rows."""
    spark, size = index.table.sparkSession, len(index.means)
    source = kept(queries.select("query", "time", "cutoff", "regime", "v").withColumn("_row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-source.count() // BLOCK))
    found = []
    for k in range(blocks):
        block = source.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == k).orderBy("_row").toArrow()  # BLOCK, give or take
        if block.num_rows:
            found.append(_searched(index, block, list(scenarios), size))
    if not found:
        empty = lambda ddl: spark.createDataFrame([], ddl)
        return empty("query bigint, scenario string, candidate bigint, distance double, rank int"), empty("query bigint, scenario string, n bigint, reasons array<string>"), empty("scenario string, measured bigint, possible bigint")
    matches, states, work = (reduce(DataFrame.unionByName, frames) for frames in zip(*found))
    return matches, states, work.groupBy("scenario").agg(F.sum("measured").alias("measured"), F.sum("possible").alias("possible"))


def _searched(index: Index, block: pa.Table, scenarios: list[Scenario], size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = index.table.sparkSession
    flat = np.asarray(block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)
    names = block.column("query").to_numpy()
    asked = _Asked(block.column("time").to_numpy().astype(np.int64), block.column("cutoff").to_numpy().astype(np.int64), np.array([x or "" for x in block.column("regime").to_pylist()], object), flat)
    shared = spark.sparkContext.broadcast((asked, scenarios, index.means))  # BLOCK vectors
    width = 1 + 2 * size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted, means = shared.value
        sums = np.zeros((len(wanted), len(own.time), width))
        for batch in batches:
            rows = _columns(batch, size)
            for k, s in enumerate(wanted):
                sums[k] += _sums(rows, own, s, means)
        k, q = np.nonzero(sums[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(q), pa.array(list(sums[k, q]), pa.list_(pa.float64()))], names=["k", "q", "sums"])

    made = index.table.select("time", "known", "regime", "provider", "v").mapInArrow(count, "k bigint, q bigint, sums array<double>")
    total = made.groupBy("k", "q").agg(*(F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(width))).toArrow()  # a row a query and scenario
    sums = np.zeros((len(scenarios), len(names), width))
    sums[total.column("k").to_numpy(), total.column("q").to_numpy()] = np.stack([total.column(f"s{i}").to_numpy() for i in range(width)], axis=1) if total.num_rows else 0
    n = np.rint(sums[:, :, 0])
    part = sums[:, :, 1:] / np.maximum(n, 1)[:, :, None]
    deviation = np.sqrt(np.maximum(part[:, :, size:] - part[:, :, :size] ** 2, 0))
    mean, scale = part[:, :, :size] + index.means, np.where(deviation > 1e-12 * np.maximum(1, np.abs(index.means)), deviation, 1.0)
    states, ready = [], []
    for k, s in enumerate(scenarios):
        lacks = np.isnan(asked.v[:, _selected(size, s.excluded)]).any(axis=1)
        bad = asked.regime == "NO_DATA"
        few = n[k] < s.min_history
        ready.append(np.flatnonzero(~(lacks | bad | few)))
        states += [(int(q), s.name, int(c), [r for r, x in (("INSUFFICIENT_HISTORY", f), ("MISSING_SIGNALS", m), ("QUERY_REGIME_NO_DATA", b)) if x]) for q, c, f, m, b in zip(names, n[k], few, lacks, bad)]
    about = {"spaces": index.spaces, "means": index.means, "scales": index.scales, "pivots": index.pivots}
    asking = spark.sparkContext.broadcast((about, mean, scale, ready, index.sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, wanted, _), (where, means, scales, fit, sample) = shared.value, asking.value
        tasks = [_Search(s, where, own, means[k], scales[k], fit[k]) for k, s in enumerate(wanted)]
        for t in tasks:
            t.start(sample)
        for batch in batches:
            rows, cell = _columns(batch, size), batch.column("cell").to_numpy()
            for t in tasks:
                radius = None if t.space is None else batch.column(f"{'l2_' if t.s.metric == 'euclidean' else 'l1_'}{t.space}").to_numpy()
                t.batch(rows, cell, radius)
        for k, t in enumerate(tasks):
            query, time, distance = t.found()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(query, -1)), pa.array(np.full(len(query) + 1, k, np.int64)), pa.array(np.append(time, t.measured)), pa.array(np.append(distance, 0.0))], names=["q", "k", "candidate", "distance"])

    raw = kept(index.table.mapInArrow(run, "q bigint, k bigint, candidate bigint, distance double"), "matches")  # k a query, scenario and task
    label = spark.createDataFrame([(i, s.name, s.k, int(n[i][ready[i]].sum())) for i, s in enumerate(scenarios)], "k bigint, scenario string, most int, possible bigint")
    asks = spark.createDataFrame([(i, int(q)) for i, q in enumerate(names)], "q bigint, query bigint")
    best = raw.where("q >= 0").withColumn("rank", F.row_number().over(Window.partitionBy("q", "k").orderBy("distance", "candidate")))
    matches = best.where(F.col("rank") <= max(s.k for s in scenarios)).join(F.broadcast(label), "k").where("rank <= most").join(F.broadcast(asks), "q").select("query", "scenario", "candidate", "distance", "rank")
    work = raw.where("q < 0").groupBy("k").agg(F.sum("candidate").alias("measured")).join(F.broadcast(label), "k").select("scenario", "measured", "possible")
    return matches, spark.createDataFrame(states, "query bigint, scenario string, n bigint, reasons array<string>"), work


def sensitivity(matches: DataFrame, states: DataFrame, regimes: DataFrame, base: str, min_ready: int = 3, min_overlap: float = 0.4, min_agreement: float = 0.6) -> DataFrame:
    """query, ready, min_overlap, agreement, reasons, stable: whether the matches of the base scenario stand in the others.

    regimes: candidate, regime. Scenarios that are READY count: the overlap (Jaccard) of their candidates with the base's, and
    whether their nearest one is of the regime of the base's nearest. reasons: BASE_NOT_READY alone, or FEW_READY,
    OVERLAP, REGIME."""
    lists = matches.groupBy("query", "scenario").agg(F.collect_set("candidate").alias("found"), F.min_by("candidate", "rank").alias("candidate")).join(regimes.select("candidate", "regime"), "candidate", "left")  # k each
    own = lists.where(F.col("scenario") == base).select("query", F.col("found").alias("base"), F.col("regime").alias("base_regime"))
    ready = states.where(F.size("reasons") == 0).select("query", "scenario")
    both = ready.where(F.col("scenario") != base).join(lists, ["query", "scenario"], "left").join(own, "query")
    same = F.size(F.array_intersect("found", "base")) / F.size(F.array_union("found", "base"))
    told = both.groupBy("query").agg(F.count("*").alias("ready"), F.min(same).alias("min_overlap"), F.avg(F.col("regime").eqNullSafe(F.col("base_regime")).cast("double")).alias("agreement"))
    out = states.where(F.col("scenario") == base).select("query", (F.size("reasons") == 0).alias("_base")).join(told, "query", "left").withColumn("ready", F.coalesce("ready", F.lit(0)))
    reasons = F.when(~F.col("_base"), F.array(F.lit("BASE_NOT_READY"))).otherwise(F.array_compact(F.array(
        F.when(F.col("ready") < min_ready, F.lit("FEW_READY")), F.when(F.coalesce(F.col("min_overlap") < min_overlap, F.lit(True)), F.lit("OVERLAP")), F.when(F.coalesce(F.col("agreement") < min_agreement, F.lit(True)), F.lit("REGIME")),
    )))
    return out.withColumn("reasons", reasons).withColumn("stable", F.size("reasons") == 0).drop("_base")


def fold_votes(tests: DataFrame, matches: DataFrame, states: DataFrame, stable: DataFrame, base: str, outcomes: DataFrame, strength: float = 1.0) -> DataFrame:
    """tests (query, actual, prior and whatever else), each with score and reasons: the similarity-weighted share of its
    analogs' outcomes, drawn to its fold's rate `prior`, where the base scenario is READY and stands in the others; else
    no score and the reasons why. outcomes: candidate, outcome (boolean)."""
    sim = 1 / (1 + F.col("distance"))
    votes = matches.where(F.col("scenario") == base).join(outcomes.select("candidate", "outcome"), "candidate").groupBy("query").agg(F.sum(sim * F.col("outcome").cast("double")).alias("_yes"), F.sum(sim).alias("_all"))
    told = states.where(F.col("scenario") == base).select("query", F.col("reasons").alias("_unready")).join(stable.select("query", F.col("reasons").alias("_unstable")), "query")
    why = F.when(F.size("_unready") > 0, F.col("_unready")).otherwise(F.col("_unstable"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("prior") * strength + F.col("_yes")) / (strength + F.col("_all"))))
    return tests.join(told, "query").join(votes, "query", "left").withColumn("reasons", why).withColumn("score", F.when(F.size("reasons") == 0, score)).drop("_yes", "_all", "_unready", "_unstable")
