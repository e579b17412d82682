"""Sharding by histogram sort, with DataFrame operations only.

Every row has a key of 128 bits: xxhash64 of its text, then xxhash64 of its id.  Equal texts are
neighbours in key order.  The splitters between shards are found by counting: one pass gives the
exact bytes below 4096 probes (the first 12 bits of the key); wherever no probe is within tolerance of
a target, the next pass lays 4096 probes inside the one interval that holds it, and so on through the
key.  Passes read a table of keys and sizes, not texts, and bring at most 4096 counts for each open
target to the driver.  When all splitters meet the tolerance the rows are exchanged once, and each
gets its slot from the counts below it.

A boundary falls inside a group of equal texts only if the group is larger than the tolerance; then
ids decide, so a group that holds a third of all rows spreads over as many shards as it fills.

Law `bytes`: shard sizes differ from the mean by at most the tolerance and one document.

Defined results: a null text has size 1, its crc32 is that of no bytes; null ids share the key of
the empty id; repeated rows (equal text and id) stay together; an empty table gives no rows; other
columns are carried along untouched unless `columns` says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIGIT, DIGITS = 12, 10
#: Of the mean bytes of a shard.
TOLERANCE = 0.001
#: Rows that get their slots in one task.
CELL_ROWS = 250_000


def _digit(k: int) -> Column:
    """The k-th group of 12 bits of the key; five are from each hash, the last with 4 bits of it left over."""
    h = F.col("__h") if k < 5 else F.col("__g")
    return F.shiftrightunsigned(h, 64 - DIGIT * (k % 5 + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def _matches(prefix: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a & b, [_digit(i) == d for i, d in enumerate(prefix)], F.lit(True))


def splitters(keys: DataFrame, shards: int, weight: str = "__size", tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Digits of each splitter: rows whose leading digits are at least these lie above it."""
    total = keys.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    open_at = {t: ((), 0) for t in range(1, shards)}  # target: prefix that holds it, weight below that prefix
    done: dict[int, tuple[int, ...]] = {}
    for k in range(DIGITS):
        prefixes = sorted({p for p, _ in open_at.values()})
        if not prefixes:
            break
        # one pass for all open targets; the row of each prefix is told by its place in the list
        which = reduce(lambda c, i: c.when(_matches(prefixes[i]), F.lit(i)), range(1, len(prefixes)), F.when(_matches(prefixes[0]), F.lit(0)))
        inside = reduce(lambda a, b: a | b, [_matches(p) for p in prefixes])
        found = keys.where(inside).groupBy(which.alias("p"), _digit(k).alias("d")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).collect()
        counts: dict[tuple[int, ...], list] = {p: [] for p in prefixes}
        for r in found:
            counts[prefixes[r["p"]]].append((r["d"], r["w"], r["n"]))
        still = {}
        for t, (prefix, below) in open_at.items():
            goal = total * t / shards
            for d, w, n in sorted(counts[prefix]):
                if below + w >= goal:
                    break
                below += w
            after = below + w
            if min(goal - below, after - goal) <= slack or n == 1 or k == DIGITS - 1:
                done[t] = (*prefix, d) if goal - below <= after - goal else (*prefix, d + 1)
            else:
                still[t] = ((*prefix, d), below)
        open_at = still
    return [done[t] for t in sorted(done)]


def _at_least(splitter: tuple[int, ...]) -> Column:
    """Whether a key is at or above a splitter; a last digit of 4096 means past all keys with that prefix."""
    out = F.lit(True)
    for i in range(len(splitter) - 1, -1, -1):
        d = _digit(i)
        out = (d > splitter[i]) | ((d == splitter[i]) & out) if i < len(splitter) - 1 else d >= splitter[i]
    return out


def histogram_shards(docs: DataFrame, shards: int = 16, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with size, text_crc32, law, shard, slot and grown_shard, in key order by shard and slot."""
    # carried columns by place, so that no name of the caller's meets one of these
    names = docs.columns if columns is None else columns
    text = F.col(f"`{text_col}`")
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)],
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("__h"),
        F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("__g"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("__size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__crc"),
    )
    keys = cut(keyed.select("__h", "__g", "__size") if text_col in names else keyed)
    rows = keyed if text_col in names else keys
    bounds = splitters(keys, shards)
    shard = reduce(lambda a, b: a + b, [_at_least(b).cast("int") for b in bounds], F.lit(0))
    # Cells are the probes of the first pass; one with many rows is dealt further by id.
    heavy = [r["d"] for r in keys.groupBy(_digit(0).alias("d")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).collect()]  # at most 4096
    fine = F.shiftrightunsigned(F.col("__g"), 54).cast("int") if heavy else F.lit(0)
    cell = (_digit(0) * 1024 + F.when(_digit(0).isin(heavy), fine).otherwise(0)) if heavy else _digit(0) * 1024
    placed = lambda df: df.withColumn("__shard", shard).withColumn("__cell", cell)
    before = F.sum("n").over(Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    # At most 4096 + 1024 x (heavy probes) cells, plus one for each splitter.
    below = placed(keys).groupBy(F.col("__shard").alias("s"), F.col("__cell").alias("c")).agg(F.count(F.lit(1)).alias("n")).select("s", "c", F.coalesce(before, F.lit(0)).alias("__below"))
    ranked = placed(rows).withColumn("__rn", F.row_number().over(Window.partitionBy("__shard", "__cell").orderBy("__h", "__g")) - 1)
    ranked = ranked.join(below, (F.col("__shard") == F.col("s")) & (F.col("__cell") == F.col("c")))
    own = {"size": F.col("__size"), "text_crc32": F.col("__crc"), "law": F.lit("bytes"), "shard": F.col("__shard"), "slot": (F.col("__below") + F.col("__rn")).cast("long"), "grown_shard": F.lit(None).cast("int")}
    return ranked.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c not in own], *[e.alias(n) for n, e in own.items()])
