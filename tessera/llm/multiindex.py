"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has its own codebook of K centroids (k-means on at most about SAMPLE rows); a
vector's cell is its pair of centroids, and every row is indexed.  A query scores the centroids of each
half, and a heap walks the pairs from the nearest summed distance outwards (the multi-sequence order)
until the cells passed hold a share of the distinct vectors.  The share is calibrated: on the sample,
against brute force, the walk must have met AIM of the true neighbours.  Distance is the negative inner
product, which adds up over the halves.  Rows of the visited cells are reranked by the exact inner
product of the original vectors.

The codebooks grow with the table: about ROWS_A_CELL rows a cell, so that a walk costs about what the
rows of its cells cost, up to SAMPLE / 16 centroids.  Cells are laid out in blocks of about BLOCK rows, near ones together (squares of
TILE x TILE centroids, those of a half in the order of their main direction); a cell with more rows spreads over several blocks by
id, so a vector that a third of the rows share is scanned by many tasks.  Copies count once in the walk
(cells are counted by distinct vectors), so a crowded cell doesn't end it early.  Queries meet blocks in
tiles of about QUERY_TILE; there, a cell's rows are multiplied with the queries that visit the cell and no others.

Defined results: those of exact top-k search (topk.py), but zero vectors take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sampled, ship
from .topk import QUERY_TILE, matrix, merge, select, tile_pairs, usable

SAMPLE, AIM, BLOCK, ROWS_A_CELL, TILE = 20_000, 0.94, 4096, 48, 8


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((len(c), 0))
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def layout(books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All cells, near ones after each other."""
    place = []
    for c in books:
        main = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0] if c.shape[1] else np.zeros(0)
        place.append(np.argsort(np.argsort(c @ main, kind="stable")))
    a, b = np.repeat(place[0], len(place[1])), np.tile(place[1], len(place[0]))
    return np.lexsort((b, a, b // TILE, a // TILE))


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells from the least sum of distances on, until they hold `enough`; counts: first x second."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    a, b, width, held, out = a.tolist(), b.tolist(), len(second), 0, []
    rows = counts.tolist()
    heap, seen = [(da[0] + db[0], 0, 0)], [0] * len(da)
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        if n := rows[a[i]][b[j]]:
            held += n
            out.append(a[i] * width + b[j])
        # (i, j + 1) follows in its row, and the first of a row brings in the next row
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


class MultiIndex:
    """Two codebooks and the share of distinct vectors that a walk passes."""

    def __init__(self, sample: np.ndarray, k: int, centroids: int, aim: float = AIM):
        self.half = sample.shape[1] // 2
        self.books = k_means(sample[:, : self.half], centroids), k_means(sample[:, self.half :], centroids)
        self.share = self._calibrate(np.unique(sample, axis=0), k, aim)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * len(self.books[1]) + nearest(x[:, self.half :], self.books[1])

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -q[:, : self.half] @ self.books[0].T, -q[:, self.half :] @ self.books[1].T

    def _calibrate(self, sample: np.ndarray, k: int, aim: float, queries: int = 300) -> float:
        if len(sample) <= k + 1:
            return 1.0
        q = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
        s = sample[q] @ sample.T
        s[np.arange(len(q)), q] = -np.inf
        top = np.argpartition(-s, k, 1)[:, :k]
        cell = self.cells(sample)
        first, second = self.distances(sample[q])
        counts = np.bincount(cell, minlength=len(self.books[0]) * len(self.books[1]))
        all_ = (first[:, :, None] + second[:, None, :]).reshape(len(q), -1)
        order = np.argsort(all_, 1, kind="stable")
        passed = np.empty_like(order)
        np.put_along_axis(passed, order, np.cumsum(counts[order], 1), 1)
        met = np.sort(np.take_along_axis(passed, cell[top], 1).ravel())
        return float(met[min(len(met) - 1, int(aim * len(met)))]) / len(sample)


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample_rows: int = SAMPLE, aim: float = AIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (over `id`) holds."""
    spark = vectors.sparkSession
    ship(spark)
    table, d, n = usable(vectors, id_col, vector_col, zero=False)
    taken = table.where(sampled(F.xxhash64("id", F.lit(1)), sample_rows / max(1, n))).select("v")
    sample = np.array([r["v"] for r in taken.toLocalIterator()], np.float64).reshape(-1, d)  # about sample_rows vectors
    if n and not len(sample):
        raise ValueError(f"no vector was sampled of {n}: raise sample_rows ({sample_rows})")
    if not len(sample):
        sample = np.zeros((1, d))
    index = MultiIndex(sample, k, max(4, min(int((n / ROWS_A_CELL) ** 0.5), len(sample) // 16)), aim)
    width, cells = len(index.books[1]), len(index.books[0]) * len(index.books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.Table.from_batches([batch]), "v", d)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(x).astype(np.int32))], names=["id", "v", "cell"])

    placed = cut(table.mapInArrow(assign, "id long, v array<double>, cell int"))
    # copies collapse before the shuffle of the second step; at most one row a cell comes back
    held = placed.groupBy("cell", F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n")).collect()
    distinct, rows = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in held:
        distinct[r["cell"]], rows[r["cell"]] = r["distinct"], r["n"]
    parts = np.maximum(1, -(-rows // BLOCK))
    base = np.zeros(cells, np.int64)
    block, filled = 0, 0
    for c in (c for c in layout(index.books) if rows[c]):
        if parts[c] > 1 or filled + rows[c] > BLOCK:
            block, filled = block + (filled > 0), 0
        base[c] = block
        filled += rows[c]
        if parts[c] > 1:
            block, filled = block + int(parts[c]), 0
    blocks = block + 1
    # at least k rows besides the query's own, where there are as many
    enough, counts = max(index.share * distinct.sum(), min(k + 1, distinct.sum())), distinct.reshape(-1, width)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(pa.Table.from_batches([batch]), "v", d)
            first, second = index.distances(q)
            at, to, seen = [], [], []
            for k_ in range(len(q)):
                by: dict[int, list[int]] = {}
                for c in walk(first[k_], second[k_], counts, enough):
                    for b in range(base[c], base[c] + parts[c]):
                        by.setdefault(b, []).append(c)
                at += [k_] * len(by)
                to += by.keys()
                seen += by.values()
            some = batch.select(["id", "v"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(to, pa.int64()), pa.array(seen, pa.list_(pa.int32()))], names=["id", "v", "block", "cells"])

    queries = placed.where(is_query).dropDuplicates(["id"])
    query_tiles = max(1, -(-queries.count() // QUERY_TILE))
    asked = queries.mapInArrow(visit, "id long, v array<double>, block long, cells array<int>").withColumn("qt", F.pmod(F.xxhash64("id"), F.lit(query_tiles)))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            to = base[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], names=["id", "v", "cell", "block"])

    there = placed.mapInArrow(locate, "id long, v array<double>, cell int, block long").withColumn("qt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_tiles - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        order = pa.array(np.argsort(right.column("cell").to_numpy(), kind="stable"))
        right = right.take(order)
        q, x = matrix(left, "v", d), matrix(right, "v", d)
        ids, (names, starts) = right.column("id").to_numpy(), np.unique(right.column("cell").to_numpy(), return_index=True)
        ends, number = np.append(starts[1:], len(x)), {int(c): j for j, c in enumerate(names)}
        queries = left.column("id").to_numpy()
        for a in range(0, len(q), 256):
            some = q[a : a + 256]
            visits = np.zeros((len(names), len(some)), bool)
            for i, cells_ in enumerate(left.column("cells")[a : a + 256].to_pylist()):
                visits[[number[c] for c in cells_ if c in number], i] = True
            scores = np.full((len(some), len(x)), -np.inf)
            for j in np.flatnonzero(visits.any(1)):
                at = np.flatnonzero(visits[j])
                scores[at, starts[j] : ends[j]] = some[at] @ x[starts[j] : ends[j]].T
            for query, v, row in zip(queries[a : a + 256], some, scores):
                open_ = np.flatnonzero((row > -np.inf) & (ids != query))
                if not len(open_):
                    continue
                at = open_[select(row[open_], ids[open_], k, 1e-9 * (1 + np.abs(row[open_]).max()))]
                # one order of addition for every row, so that equal vectors tie exactly
                exact = np.add.accumulate(x[at] * v, axis=1)[:, -1]
                best = np.lexsort((ids[at], -exact))[:k]
                yield query, ids[at][best], exact[best]

    return merge(tile_pairs(asked, there, ["block", "qt"], run, "double"), k, blocks)
