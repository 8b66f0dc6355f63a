"""Nearest neighbours by inner product through an inverted multi-index.

The two halves of a vector are quantised apart, so K + K centroids name K x K cells. For a
query the cells are taken by falling sum of its two half products, from a heap; it stops
when the entries left are expected to hold less than ``miss`` of its true neighbours, seen
from the cells' sizes and the spread of vectors round their centroids. Entries of the taken
cells are reranked by the exact product. Data without structure cost many cells, clustered
data few; nothing is cut by a fixed number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questloom.llm.common import unclashed

_TAIL_AT = np.linspace(-6, 6, 2401)
_TAIL = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in _TAIL_AT])


def _tail(x: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above ``x``."""
    return np.interp(x, _TAIL_AT, _TAIL, left=1.0, right=0.0)


@dataclass
class Codebooks:
    """Centroids of both halves and, for each, the variance per dimension round it."""

    first: np.ndarray
    second: np.ndarray
    spread: tuple[np.ndarray, np.ndarray]

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        return _nearest(x[:, :cut], self.first) * len(self.second) + _nearest(x[:, cut:], self.second)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(1), 1)


def _centroids(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's k-means from random distinct rows; a half without columns is one point."""
    if not x.shape[1]:
        return np.zeros((1, 0)), np.zeros(1)
    rows = np.unique(x, axis=0)
    now = rows[np.random.default_rng(1).permutation(len(rows))[:k]]
    for _ in range(rounds):
        at = _nearest(x, now)
        sums = np.zeros_like(now)
        np.add.at(sums, at, x)
        many = np.bincount(at, minlength=len(now))
        now = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], now)
    at = _nearest(x, now)
    rest, many = ((x - now[at]) ** 2).mean(1), np.bincount(at, minlength=len(now))
    # A centroid of few rows borrows from the mean of all centroids.
    own = np.bincount(at, rest, len(now))
    usual = (own / np.maximum(many, 1))[many > 1].mean() if (many > 1).any() else 0.0
    return now, (own + 8 * usual) / (many + 8)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector takes part, and their dimension.

    Vectors that are null, zero, hold a null or non-finite component, or have another
    length than the commonest one (the least of equally common ones) take no part.
    """
    v = F.col(vector)
    number = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.filter(v.isNotNull() & F.coalesce(number, F.lit(False)) & F.exists(v, lambda x: x != 0))
    sizes = clean.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 0
    return clean.filter(F.size(v) == dim), dim


def fit(rows: DataFrame, vector: str, id_col: str, k: int = 32, sample: int = 16_384, rounds: int = 12) -> Codebooks:
    """Codebooks of ``k`` centroids a half, from at most ``sample`` rows drawn by their id."""
    total = rows.count()
    drawn = F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-total // sample)))) == 0

    def train(part: pa.Table) -> pa.Table:
        x = matrix(part.column("vec").combine_chunks())
        cut = x.shape[1] // 2
        out = []
        for half, y in enumerate((x[:, :cut], x[:, cut:])):
            found, spread = _centroids(y, k, rounds)
            out += [(half, float(s), c.tolist()) for s, c in zip(spread, found, strict=True)]
        return pa.table(
            {"half": pa.array([h for h, *_ in out], pa.int32()), "spread": pa.array([s for _, s, _ in out]),
             "c": pa.array([c for *_, c in out], pa.list_(pa.float64()))}
        )

    taken = rows.filter(drawn).select(F.col(vector).alias("vec")).limit(sample).withColumn("one", F.lit(0))
    got = taken.groupBy("one").applyInArrow(train, "half int, spread double, c array<double>").collect()
    halves = [[r for r in got if r.half == h] for h in (0, 1)]
    return Codebooks(*[np.array([r.c for r in h]).reshape(len(h), -1) for h in halves], tuple(np.array([r.spread for r in h]) for h in halves))


def cell_counts(rows: DataFrame, vector: str, books: Codebooks) -> np.ndarray:
    """Entries per cell: as many numbers as there are cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(books.cells, np.int64)
        for b in batches:
            if b.num_rows:
                many += np.bincount(books.cell_of(matrix(b.column(0))), minlength=books.cells)
        at = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(many[at])], names=["cell", "n"])

    out = np.zeros(books.cells, np.int64)
    for r in rows.select(vector).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def by_falling_sum(first: list[float], second: list[float]) -> Iterator[tuple[int, int]]:
    """Pairs of places of two lists by falling sum; the heap holds one pair per place of the first."""
    a, b = sorted(range(len(first)), key=first.__getitem__, reverse=True), sorted(range(len(second)), key=second.__getitem__, reverse=True)
    x, y = [-first[i] for i in a], [-second[j] for j in b]
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def cells_to_visit(q: np.ndarray, books: Codebooks, counts: np.ndarray, k: int, miss: float, least: int) -> list[list[int]]:
    """For each query the cells that hold entries, nearest first, up to the expected miss."""
    if not len(q):
        return []
    cut = books.first.shape[1]
    first, second = q[:, :cut] @ books.first.T, q[:, cut:] @ books.second.T
    sums = (first[:, :, None] + second[:, None, :]).reshape(len(q), -1)
    long = [(part**2).sum(1)[:, None] for part in (q[:, :cut], q[:, cut:])]
    wide = np.sqrt((long[0] * books.spread[0])[:, :, None] + (long[1] * books.spread[1])[:, None, :]).reshape(len(q), -1)
    wide = np.maximum(wide, 1e-12)
    lo, hi = (sums - 6 * wide).min(1, keepdims=True), (sums + 6 * wide).max(1, keepdims=True)
    for _ in range(24):  # the score that about k entries are expected to reach
        mid = (lo + hi) / 2
        above = (counts * _tail((mid - sums) / wide)).sum(1, keepdims=True) >= k + 1
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    hope = counts * _tail((lo - sums) / wide)
    seconds, out = len(books.second), []
    for r in range(len(q)):
        left, seen, mine, chance = float(hope[r].sum()), 0, [], hope[r].tolist()
        for i, j in by_falling_sum(first[r].tolist(), second[r].tolist()):
            if left <= miss * k and seen >= least:
                break
            cell = i * seconds + j
            if counts[cell]:
                mine.append(cell)
                seen += int(counts[cell])
                left -= chance[cell]
        out.append(mine)
    return out


@dataclass
class Shards:
    """Cells laid end to end and cut into equal parts; a large cell spans several."""

    start: np.ndarray
    counts: np.ndarray
    target: int

    def of_entries(self, cells: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return (self.start[cells] + spread % self.counts[cells]) // self.target

    def of_cells(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each cell beside every shard that holds a part of it."""
        first = self.start[cells] // self.target
        many = (self.start[cells] + self.counts[cells] - 1) // self.target - first + 1
        at = np.repeat(np.arange(len(cells)), many)
        return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)


def _sent(rows: DataFrame, books: Codebooks, counts: np.ndarray, shards: Shards, k: int, miss: float, least: int) -> DataFrame:
    """Entries to their shard, queries to the shards of the cells they visit."""
    kind = rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = matrix(part.column(1))
                cells = books.cell_of(x)
                places = shards.of_entries(cells, part.column(2).to_numpy().astype(np.uint64)).astype(np.int64)
                asks = np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False))
                row, place, lists = [np.arange(len(x))], [places], [[c] for c in cells.tolist()]
                for r, cells_of in zip(asks, cells_to_visit(x[asks], books, counts, k, miss, least), strict=True):
                    mine = np.array(cells_of, np.int64)
                    i, to = shards.of_cells(mine)
                    order = np.argsort(to, kind="stable")
                    i, to = i[order], to[order]
                    goes, first = np.unique(to, return_index=True)
                    row.append(np.full(len(goes), r)), place.append(goes)
                    lists += [mine[g].tolist() for g in np.split(i, first[1:])]
                rows_at = pa.array(np.concatenate(row))
                asked = np.arange(len(rows_at)) >= len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(place)), pa.array(asked), part.column(0).take(rows_at), part.column(1).take(rows_at), pa.array(lists, pa.list_(pa.int32()))],
                    names=["shard", "asks", "id", "vec", "cells"],
                )

    return rows.mapInArrow(run, f"shard long, asks boolean, id long, vec {kind}, cells array<int>")


class _Best:
    """The k best entries of each query so far, by exact product, then by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.floor = np.full(len(ids), -np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        near = self.x[rows] @ x.T
        at, entry = np.nonzero(near >= self.floor[rows][:, None])
        at = rows[at]
        other = ids[entry] != self.ids[at]
        at, entry = at[other], entry[other]
        self.new.append((at, ids[entry], np.einsum("ij,ij->i", self.x[at], x[entry])))
        self.size += len(at)
        if self.size > 1 << 18:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, ids, score = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        # A row that occurs twice is one neighbour.
        again = np.lexsort((np.arange(len(at)), ids, at))
        fresh = np.ones(len(at), bool)
        fresh[again[1:]] = (at[again[1:]] != at[again[:-1]]) | (ids[again[1:]] != ids[again[:-1]])
        at, ids, score = at[fresh], ids[fresh], score[fresh]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == self.k - 1
        self.floor[at[last]] = score[last] - 1e-9 * (1 + np.abs(score[last]))
        few = rank < self.k
        self.kept, self.new, self.size = (at[few], ids[few], score[few]), [], 0
        return self.kept


def _answers(sent: DataFrame, tasks: int, k: int) -> DataFrame:
    """Each shard's best entries for the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ids, x, cells = None, [], None, None, None
        for b in batches:
            shard_of, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for at, to in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if at == to:
                    continue
                if shard_of[at] != shard:
                    shard, held, ids = shard_of[at], [], None
                part = b.slice(at, to - at)
                if not asks[at]:
                    held.append((part.column(2).to_numpy(), matrix(part.column(3)), part.column(4).flatten().to_numpy()))
                    continue
                if ids is None:  # all entries of a shard come before its queries
                    if not held:
                        continue
                    ids, x, cells = (np.concatenate(c) for c in zip(*held, strict=True))
                    order, held = np.argsort(cells, kind="stable"), []
                    ids, x, cells = ids[order], x[order], cells[order]
                for lot in range(0, part.num_rows, 512):
                    yield _ask(part.slice(lot, 512), ids, x, cells, k)

    rows = sent.repartition(tasks, "shard").sortWithinPartitions("shard", "asks")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _ask(part: pa.RecordBatch, ids: np.ndarray, x: np.ndarray, cells: np.ndarray, k: int) -> pa.RecordBatch:
    asked, lists = part.column(2).to_numpy(), part.column(4)
    best = _Best(asked, matrix(part.column(3)), k)
    sizes = np.diff(lists.offsets.to_numpy())
    visits, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(asked)), sizes)
    order = np.argsort(visits, kind="stable")
    visits, rows = visits[order], rows[order]
    kinds, first = np.unique(visits, return_index=True)
    for cell, who in zip(kinds, np.split(rows, first[1:]), strict=True):
        lo, hi = np.searchsorted(cells, cell, "left"), np.searchsorted(cells, cell, "right")
        for at in range(lo, hi, 8192):
            best.offer(who, ids[at : min(at + 8192, hi)], x[at : min(at + 8192, hi)])
    at, found, score = best.settle()
    return pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])


def nearest_neighbours(
    rows: DataFrame, asks: Column, k: int = 20, miss: float = 0.05, vector: str = "embedding", id_col: str = "vec_id",
    centroids: int = 32, sample: int = 16_384, shard_rows: int = 262_144, least_shards: int = 16,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row that ``asks``.

    Candidates are all rows but those of the query's own id; a row that occurs twice counts
    once; ties go to the smaller id. Rows without an id or a usable vector (see ``usable``)
    take no part. Only the codebooks are fitted on a sample; every row is indexed. ``miss``
    is the share of neighbours that a query may expect to lose. Without usable rows the
    result is empty.
    """
    spark = rows.sparkSession
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    base = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind).alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks"))
    clean, dim = usable(base.filter(F.col("id").isNotNull()), "vec")
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(clean, "vec", "id", centroids, sample)
    counts = cell_counts(clean, "vec", books)
    total = int(counts.sum())
    number = max(least_shards, -(-total // shard_rows))
    shards = Shards(np.cumsum(counts) - counts, np.maximum(counts, 1), max(1, -(-total // number)))
    spread = F.xxhash64("id", F.monotonically_increasing_id()).alias("spread")
    sent = _sent(clean.select("id", "vec", spread, "asks"), books, counts, shards, k, miss, min(total, 16 * k))
    found = _answers(sent, number, k).repartition("query_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, every: int = 20, **options) -> DataFrame:
    """The rows whose id is divisible by ``every`` asked against all rows."""
    plain = unclashed(rows, "vec_id", "embedding")
    return nearest_neighbours(plain, F.col("vec_id") % every == 0, **options)
