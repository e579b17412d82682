"""Best-fit packing by exact complements.

Packing depends only on how many pieces there are of each length, so the plan is made from a
histogram of at most `capacity` counters, whatever the size of the corpus.  Each step of the plan
fills one kind of sequence and takes as many copies of it as availability allows:

1. a piece and the single length that completes it,
2. a piece and a pair of lengths whose sum is the gap,
3. a piece and a triple of lengths whose sum is the gap,
4. what is left, in decreasing length, into the tightest gap that holds it (best fit).

Pieces then get their place by rank among the pieces of their length.  Ranks come from counts for
each (length, salt) and a row number within it, so that no length, however frequent, meets in a task.  Ids and
other columns take no part in that: they move once, to their place.

Defined results: null or empty texts are one piece holding the end id; null ids are kept; repeated
rows are packed as often as they occur, ties by (doc_id, piece) are interchangeable pieces of equal
length; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, cut, ship, trimmed
from .encoding import encoder
from .steps import STEP_BYTES, steps

CAPACITY, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k.json"
#: Rows of one length that are numbered in one task.
RANK_ROWS = 100_000


class _Plan:
    """Availability by length, and the kinds of sequence taken so far with their numbers."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.kinds = capacity, []
        self.free = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.free[length] += n

    def take(self, kind: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in kind:
            need[x] += 1
        copies = min(int(self.free[x]) // n for x, n in need.items())
        if copies > 0:
            for x, n in need.items():
                self.free[x] -= n * copies
            self.kinds.append((kind, copies))

    def pairs(self, total: int, largest: int) -> np.ndarray:
        """The larger parts of the available pairs with this sum: the index of pair sums by address."""
        a = np.arange(min(largest, total - 1), (total - 1) // 2, -1)
        return a[(self.free[a] > 0) & (self.free[total - a] > 0)] if len(a) else a


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequence (lengths in order) with how many there are of each; uses every piece once."""
    p = _Plan(counts, capacity)
    p.take((capacity,))
    order = range(capacity - 1, 0, -1)
    for x in order:
        if p.free[x] and capacity - x <= x:
            p.take((x, capacity - x))
    for x in order:
        if p.free[x]:
            for a in p.pairs(capacity - x, x):
                p.take((x, int(a), int(capacity - x - a)))
                if not p.free[x]:
                    break
    for x in order:
        gap = capacity - x
        a = min(x, gap - 2)
        while p.free[x] and a >= (gap + 2) // 3:
            if p.free[a]:
                for b in p.pairs(gap - a, a):
                    p.take((x, a, int(b), int(gap - a - b)))
            a -= 1
    return [k for k in p.kinds if k[1]] + _best_fit(p.free, capacity)


def _best_fit(free: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing length over counts: equal bins stay together as one kind."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    held = np.zeros(capacity + 1, np.int64)

    def put(kind: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(kind)
        bins[gap][kind] = bins[gap].get(kind, 0) + n
        held[gap] += n

    for x in range(capacity, 0, -1):
        n = int(free[x])
        while n:
            fits = np.flatnonzero(held[x:])
            if len(fits):
                gap = x + int(fits[0])
                kind, there = bins[gap].popitem()
                some = min(n, there)
                held[gap] -= there
                if there > some:
                    put(kind, there - some)
                put((*kind, x), some)
            else:
                each = min(capacity // x, n)
                some = n // each
                put((x,) * each, some)
                some *= each
            n -= some
    return [(kind, n) for kinds in bins.values() for kind, n in kinds.items() if n]


def _places(kinds: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of each range of ranks."""
    ranges, used, base = defaultdict(list), defaultdict(int), 0
    for kind, copies in kinds:
        at = 0
        for x in kind:
            ranges[x].append((used[x], base, at))
            used[x] += copies
            at += x
        base += copies
    return {x: tuple(np.array(v, np.int64).T) for x, v in ranges.items()}


def cut_pieces(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, the first may be shorter."""
    first = n_ids if n_ids <= capacity else n_ids % capacity
    starts = [0] if first else []
    starts += range(first, n_ids, capacity) if n_ids > capacity else []
    return [(s, (starts[i + 1] if i + 1 < len(starts) else n_ids) - s) for i, s in enumerate(starts)]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents encoded and cut: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with ids the pieces themselves fill a worker: fewer words at hand, shorter steps
        encode = encoder(vocabulary, 120_000).encode if with_ids else encoder(vocabulary).encode
        for batch in trimmed(batches):
            for some in steps(batch, 1, STEP_BYTES // 4 if with_ids else STEP_BYTES):
                rows = []
                ids = some.column(0).to_pylist()
                for doc_id, data in zip(ids, encode(some.column(1))):
                    data += end
                    for k, (start, n) in enumerate(cut_pieces(len(data) // 4, capacity)):
                        part = data[4 * start : 4 * (start + n)]
                        rows.append((doc_id, k, start, n, zlib.crc32(part), part)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, kind)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a length from 1 to capacity get sequence_id (long) and offset (long).

    Places are found for (row number, length) alone; then the rows, with whatever they carry, move once.
    """
    ship(parts.sparkSession)
    names = parts.columns
    parts = cut(parts.withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan_sequences(counts, capacity), capacity)
    salts = F.element_at(F.array(*[F.lit(-(-counts.get(x, 1) // RANK_ROWS)) for x in range(1, capacity + 1)]), F.col("length").cast("int"))
    salted = parts.select("__row", "length", F.pmod(F.xxhash64("__row"), salts.cast("long")).cast("int").alias("__salt"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).select(F.col("length").alias("__length"), F.col("__salt").alias("__s"), F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__row")) - 1)
    ranked = ranked.join(offsets, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__s"))).select("__row", "length", (F.col("__rank") + F.col("__before")).alias("__rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        claim("places")
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            own = length == x
            first, base, at = places[int(x)]
            k = np.searchsorted(first, rank[own], "right") - 1
            sequence[own], offset[own] = base[k] + rank[own] - first[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__place", place("length", "__rank")).select(F.col("__row").alias("__r"), "__place.sequence_id", "__place.offset")
    # the small side is hashed, so that rows with ids are not sorted
    return parts.join(placed.hint("shuffle_hash"), F.col("__row") == F.col("__r")).select(*names, "sequence_id", "offset")
