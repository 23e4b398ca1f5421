"""Nearest historical analogs over vectors and their votes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.scratch import kept


def distance(a: Column, b: Column, metric: str) -> Column:
    """euclidean, manhattan or cosine distance of two double arrays; two zero vectors are 0 apart by cosine, one is 1."""
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if metric == "manhattan":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) == 0) & (norm(b) == 0), F.lit(0.0)).when((norm(a) == 0) | (norm(b) == 0), F.lit(1.0)).otherwise(1 - dot / (norm(a) * norm(b)))


#: Vectors of the query set that one pass over history takes: what is sent everywhere is this many vectors.
BLOCK = 2000
#: Slices of history that each give their own best, and rows of one that meet a block at once.
SLICES, ROWS = 64, 1024


def normaliser(history: DataFrame, vector: str, size: int) -> tuple[Column, Column]:
    """(means, scales) of the components of history's vectors as array literals; a component that doesn't vary has scale 1.
    One aggregate of 2 * size numbers."""
    parts = [f(F.get(vector, k)).alias(f"{n}{k}") for k in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = history.agg(*parts).first()
    scales = [row[f"s{k}"] if row[f"s{k}"] is not None and row[f"s{k}"] > 1e-12 else 1.0 for k in range(size)]
    return F.array(*(F.lit(row[f"m{k}"] or 0.0) for k in range(size))), F.array(*map(F.lit, scales))


def normalised(v: Column, means: Column, scales: Column) -> Column:
    """(v - mean) / scale by component."""
    return F.zip_with(F.zip_with(v, means, lambda x, m: x - m), scales, lambda x, s: x / s)


def _far(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, as `distance` has them."""
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    if metric == "manhattan":
        return np.abs(x - q).sum(axis=1)
    na, nb = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    zero = (na == 0) | (nb == 0)
    return np.where((na == 0) & (nb == 0), 0.0, np.where(zero, 1.0, 1 - (x * q).sum(axis=1) / np.where(zero, 1, na * nb)))


class _Best:
    """A task's k nearest rows of every query of a block. Distances of all pairs come by matrix products, up to rounding
    (by the Manhattan metric: themselves); those that may be among the k best are measured."""

    def __init__(self, queries: np.ndarray, order: np.ndarray, k: int, metric: str, prior: bool):
        self.v, self.order, self.k, self.metric, self.prior = queries, order, k, metric, prior
        self.square = (queries**2).sum(axis=1)
        self.query, self.candidate, self.distance = np.empty(0, np.int64), order[:0], np.empty(0)
        self.bound, self.n = np.full(len(queries), np.inf), np.zeros(len(queries), np.int64)

    def _rough(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """queries x rows: distances (Euclidean ones squared), and what rounding may have added."""
        if self.metric == "manhattan":
            return np.stack([np.abs(x - q).sum(axis=1) for q in self.v]), 1e-9
        square = (x**2).sum(axis=1)
        if self.metric == "euclidean":
            both = self.square[:, None] + square
            return both - 2 * (self.v @ x.T), 1e-9 * both + 1e-12
        length = np.sqrt(self.square)[:, None] * np.sqrt(square)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = 1 - (self.v @ x.T) / length
        return np.where(length > 0, far, np.where((self.square[:, None] == 0) & (square == 0), 0.0, 1.0)), 1e-9

    def add(self, x: np.ndarray, order: np.ndarray) -> None:
        allowed = order < self.order[:, None] if self.prior else order != self.order[:, None]
        self.n += allowed.sum(axis=1)
        rough, slack = self._rough(x)
        rough = np.where(allowed, rough - slack, np.inf)
        limit = self.bound**2 if self.metric == "euclidean" else self.bound
        if np.isinf(limit).any() and len(order) > self.k:  # no k rows yet: the k best of these, and what rounding may have moved
            limit = np.minimum(limit, np.partition(rough + 2 * slack, self.k - 1, axis=1)[:, self.k - 1])
        q, r = np.nonzero(allowed & (rough <= limit[:, None]))
        if len(q):
            self._keep(q, order[r], _far(x[r], self.v[q], self.metric))

    def _keep(self, query: np.ndarray, candidate: np.ndarray, distance: np.ndarray) -> None:
        query, candidate, distance = np.append(self.query, query), np.append(self.candidate, candidate), np.append(self.distance, distance)
        at = np.lexsort((candidate, distance, query))
        query = query[at]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        stay = rank < self.k
        self.query, self.candidate, self.distance = query[stay], candidate[at][stay], distance[at][stay]
        last = np.flatnonzero(rank[stay] == self.k - 1)
        self.bound[self.query[last]] = self.distance[last] * (1 + 1e-9)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def nearest(queries: DataFrame, history: DataFrame, vector: str, order: str, k: int, metric: str, min_history: int = 1, prior_only: bool = True) -> DataFrame:
    """query, candidate, distance, rank: the k nearest rows of each query, earlier ones only (prior_only) or any but itself.

    `queries` is a stated set (query, query_vector, query_order, one row each); it meets all of history in blocks of BLOCK
    queries, so what is sent everywhere doesn't grow with it. Partial top-k: history is dealt to SLICES tasks, each gives its
    k best of a query, and those meet. A task holds a block, ROWS rows and a matrix of both, however long history is.
    min_history: queries with fewer candidates get none. Rows whose vector is null, has a null or another length than
    the queries' are no candidates, and such queries get none."""
    spark, kind = history.sparkSession, history.schema[order].dataType.simpleString()
    clear = lambda c: F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))
    asked = kept(queries.select("query", F.col("query_vector").cast("array<double>").alias("v"), F.col("query_order").cast(kind).alias("o"), F.pmod(F.xxhash64("query"), F.lit(2**31 - 1)).alias("_h")).where(clear("v") & F.col("o").isNotNull()), "asked")
    told = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    own = f"query {queries.schema['query'].dataType.simpleString()}, candidate {kind}, distance double"
    if not told.n:
        return spark.createDataFrame([], own + ", rank int")
    blocks = -(-told.n // BLOCK)
    rows = history.select(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v")).where(clear("v") & (F.size("v") == told.size) & F.col("o").isNotNull()).repartition(SLICES, "o")
    rows = kept(rows, "history") if blocks > 1 else rows
    found = []
    for b in range(blocks):
        block = asked.where((F.size("v") == told.size) & (F.col("_h") % blocks == b)).drop("_h").toArrow().combine_chunks()  # BLOCK vectors, give or take
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors, orders = (shared.value.column(c).combine_chunks() for c in ("query", "v", "o"))
            ids, vectors, orders = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, vectors, orders))
            best = _Best(_matrix(vectors), orders.to_numpy(zero_copy_only=False), k, metric, prior_only)
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    best.add(_matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False))
            seen = np.flatnonzero(best.n)  # how many candidates: a row without one
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.append(best.query, seen))), pa.concat_arrays([pa.array(best.candidate, orders.type), pa.nulls(len(seen), orders.type)]), pa.array(np.append(best.distance, np.zeros(len(seen)))), pa.array(np.append(np.zeros(len(best.query), np.int64), best.n[seen]))], names=["query", "candidate", "distance", "n"])

        found.append(rows.mapInArrow(run, own + ", n bigint"))
    every = reduce(DataFrame.unionByName, found)
    best = every.where("candidate is not null")
    if min_history > 1:
        every = kept(every, "nearest")
        enough = every.groupBy("query").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_history).select("query")
        best = every.where("candidate is not null").join(enough, "query", "left_semi")
    whole = Window.partitionBy("query").orderBy("distance", "candidate")
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query", "candidate", "distance", "rank")


def vote(neighbours: DataFrame, actual: Column, prior: float = 0.5, strength: float = 1.0) -> DataFrame:
    """query, n, probability: similarity-weighted share of `actual`, drawn to the prior, within [0, 1]."""
    sim = 1 / (1 + F.col("distance"))
    p = (prior * strength + F.sum(sim * actual.cast("double"))) / (strength + F.sum(sim))
    return neighbours.groupBy("query").agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("probability"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """query, jaccard of the candidates of two neighbour tables."""
    x = a.groupBy("query").agg(F.collect_set("candidate").alias("x"))  # k at most
    y = b.groupBy("query").agg(F.collect_set("candidate").alias("y"))
    return x.join(y, "query").select("query", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))
