"""Exact top-k search by tiled matrix products.

Vectors are dealt by a hash of their id into tiles of about TILE rows, queries into tiles of about
QUERY_TILE, and each pair of tiles is one task's matrix product.  A task selects the k best of its
tile for each query; the lists are merged in a tree of fan-in FAN_IN, so that no task sees more than
FAN_IN x k entries of a query at a time.  The work is that of all pairs, stated as queries x rows; what
leaves a task is k rows for each query and tile.

Defined results: vectors that are null, empty, of another length than the most common one, or hold a
null or non-finite component take no part, nor do rows without an id; a query's own row is every row
with its id; repeated query ids count once (any one of the rows); ties go to the smaller id; fewer than
k candidates are all returned; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

TILE, QUERY_TILE, FAN_IN = 4096, 2048, 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> tuple[DataFrame, int, int]:
    """(id, v array<double>) of the rows that take part, their length and how many there are."""
    v = F.col(f"`{vector_col}`")
    table = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    table = table.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if not zero:
        table = table.where(F.exists("v", lambda x: x != 0))
    lengths = table.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d, n = (lengths[0]["d"], lengths[0]["n"]) if lengths else (1, 0)
    return table.where(F.size("v") == d), d, n


def matrix(table: pa.Table, column: str, d: int) -> np.ndarray:
    """A list column as rows of a matrix."""
    values = table.column(column).combine_chunks()
    return np.asarray(values.flatten(), np.float64).reshape(-1, d)


def select(scores: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Places that may be among the k best: all whose score is within slack of the k-th best."""
    open_ = np.flatnonzero(scores > -np.inf)
    if len(open_) > k:
        s = scores[open_]
        open_ = open_[s >= np.partition(s, len(s) - k)[len(s) - k] - slack]
    return open_


def tile_pairs(queries: DataFrame, rows: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], Iterator[tuple]], kind: str) -> DataFrame:
    """run(queries, rows) of each pair of tiles with equal keys; yields (query_id, ids, scores)."""
    score_type = pa.int64() if kind == "long" else pa.float64()

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        q, i, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64 if kind == "long" else float)]
        if left.num_rows and right.num_rows:
            for query, ids, scores in run(left, right):
                q.append(np.full(len(ids), query, np.int64))
                i.append(ids)
                s.append(scores)
        return pa.table({"query_id": pa.array(np.concatenate(q), pa.int64()), "vec_id": pa.array(np.concatenate(i), pa.int64()), "score": pa.array(np.concatenate(s), score_type)})

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(apply, f"query_id long, vec_id long, score {kind}")


def merge(lists: DataFrame, k: int, tiles: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's lists, merged in a tree."""
    best = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id"))
    lists = lists.withColumn("__tile", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, tiles))))
    while tiles > FAN_IN:
        tiles = -(-tiles // FAN_IN)
        lists = lists.withColumn("__tile", F.pmod("__tile", F.lit(tiles))).withColumn("rank", best("__tile")).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", best()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: integer inner products of floor(scale x components).

    is_query is a condition over the column `id`.
    """
    spark = vectors.sparkSession
    ship(spark)
    table, d, n = usable(vectors, id_col, vector_col)
    table = cut(table.select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v")))
    queries = table.where(is_query).dropDuplicates(["id"]).select(F.col("id").alias("id"), F.col("v").alias("v"))
    tiles, query_tiles = max(1, -(-n // TILE)), max(1, -(-queries.count() // QUERY_TILE))
    deal = lambda df, own, m, other, p: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(m))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        q, x = matrix(left, "v", d), matrix(right, "v", d)
        ids = right.column("id").to_numpy()
        exact = np.abs(q).max() * np.abs(x).max() * d < 2.0**53
        s = q @ x.T if exact else (q.astype(np.int64) @ x.astype(np.int64).T)
        for query, row in zip(left.column("id").to_numpy(), s):
            row = row.astype(np.float64) if exact else row
            others = np.flatnonzero(ids != query)
            at = others[select(row[others], ids[others], k)]
            at = at[np.lexsort((ids[at], -row[at]))][:k]
            yield query, ids[at], row[at].astype(np.int64)

    lists = tile_pairs(deal(queries, "qt", query_tiles, "t", tiles), deal(table, "t", tiles, "qt", query_tiles), ["t", "qt"], run, "long")
    return merge(lists, k, tiles)
