"""Near-duplicates: fast similarity sketches, banding, exact verification, components.

A document is the set of its distinct word shingles.  Its sketch has T coordinates, filled in rounds
(Dahlgaard, Knudsen and Thorup, 2017): in round i < T each element is hashed to a bin and a value
i + h; in round T + i every element competes for bin i; a bin keeps its least value, and rounds end
when no bin is empty.  Each coordinate then agrees for two sets with the probability of their Jaccard
similarity, concentrated like independent samples, in about O(n + T log T) steps.

1. Documents with equal shingle sets are one class, named by the least id; copies are combined before the
   shuffle.  If an id has several texts, classes can share a name: a slot tells them apart, and all
   their sketches stand for the id.
2. Classes that agree on one of BANDS bands of ROWS coordinates meet in a bucket.  At a similarity of
   0.8 a pair meets nowhere with probability (1 - 0.8^4)^30 = 1.4e-7.  Buckets with the same members
   are compared once.
3. In a bucket, coordinates (8 bits of each) are compared over whole sketches; members that agree in at least
   FLOOR of them (0.62, 4.9 standard deviations below 0.8) are linked.  Components of these links are clusters.
4. In a cluster, shingle sets are rebuilt from the texts and compared exactly.  Components of the exact links
   are the result.

What meets is united by links to the least member, at most one a member, never all pairs.  A group (bucket
or cluster) too large for a task, by members or by shingles, is dealt in two steps (`united`).  First into
chunks that share about ANCHORS members, so that the whole group is read once and the chunks of a true
group of copies come together through the anchors.  Then, only if the group is still in several parts,
members outside its largest part meet every chunk of the others.  So a group of copies costs its size, no
two parts stay uncompared, and no pair inside a part that is one already is compared again.

Defined results: null or blank texts have no shingles, link with nothing and are their own component;
a text with fewer words than a shingle is one shingle; rows with a null id count only for n_shingles
(component null, kept false); classes named by one repeated id share a component and the links of each; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, drop, ship, trimmed
from .components import connected_components
from .steps import steps

ROWS, BANDS = 4, 30
T = ROWS * BANDS
FLOOR = 0.62
#: Members and shingles that a task compares at once; members that all chunks of a larger group share; salts
#: of a join with the few groups that are larger.
BLOCK, SHINGLES, ANCHORS, SALTS = 1500, 1_000_000, 48, 64
_STEP = 1 << 20
_KNOWN_WORDS = 500_000
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    known = _known
    claim("shingles", known.clear)
    if len(known) > _KNOWN_WORDS:
        known.clear()
    for w in set(tokens).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([known[w] for w in tokens], np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix((out + h[k : len(h) - n + 1 + k]) * _M3 + np.uint64(k))
    return np.unique(out)


def sketch(elements: np.ndarray, t: int = T) -> np.ndarray:
    """The fast similarity sketch of a set of hashes: t coordinates of 64 bits, round in the high bits."""
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, first = len(elements), 0
    if not n:
        return best
    size = max(1, int(2 * t * np.log(t) / n) + 1)
    while first < t:
        rounds = np.arange(first, min(t, first + size), dtype=np.uint64)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _M3)
        bins = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)
        values = (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, bins.ravel().astype(np.int64), values.ravel())
        first += size
        # a bin filled in an earlier round keeps that value: the round is in its high bits
        if int(best.max() >> np.uint64(32)) < t:
            return best
    empty = np.flatnonzero(best == np.iinfo(np.uint64).max)
    for k in empty:
        h = mix(elements + np.array([t + k + 1], np.uint64) * _M3)
        best[k] = (np.uint64(t + int(k)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
    return best


def _hash_sketch(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, coordinates cut to 8 bits) of a set."""
    s = mix(sketch(elements))
    bands = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        bands = mix(bands * _M3 + s[k::ROWS])
    return mix(bands + np.arange(BANDS, dtype=np.uint64)), (s & np.uint64(0xFF)).astype(np.uint8)


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, set (two 64-bit hashes of the shingle set), bands, coordinates of each document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in steps(batch, 1, _STEP):
                yield signed(some)

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b, bands, coordinates = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            x = shingles(text, words)
            n.append(len(x))
            with np.errstate(over="ignore"):
                a.append(mix(x).sum(dtype=np.uint64))
                b.append(mix(x * _M1 + np.uint64(7)).sum(dtype=np.uint64))
            p, q = _hash_sketch(x) if len(x) else (None, None)
            bands.append(None if p is None else p.view(np.int64))
            coordinates.append(None if q is None else q.tobytes())
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(coordinates, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "a", "b", "bands", "coordinates"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, a long, b long, bands array<long>, coordinates binary")


def unite(labels: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], first: int | None = None) -> np.ndarray:
    """labels, those of rows that are near made equal.

    near(i, others) tells which others are near row i; the first rows (all if None) are compared with the rows after them.
    """
    labels = np.unique(labels, return_inverse=True)[1]
    for i in range(len(labels) if first is None else first):
        left = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if len(left) and len(hit := left[near(i, left)]):
            labels[np.isin(labels, labels[hit])] = labels[i]
            if (labels == labels[0]).all():
                break
    return labels


def _stars(ids: np.ndarray, parts: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Each part linked with the label it now belongs to: (least id of the part, least id of the label)."""
    least, out = {}, {}
    for i, p, k in zip(ids.tolist(), parts.tolist(), labels.tolist()):
        least[k] = min(i, least.get(k, i))
        out[p] = (min(i, out[p][0]) if p in out else i, k)
    return [(u, least[k]) for u, k in out.values() if u != least[k]]


def grouped(df: DataFrame, keys: list[str], links) -> DataFrame:
    """u, v: links within the groups of df by keys, as `unite` finds them.

    df has, after the keys, id, part (rows of one part are linked already), bulk (the group's largest part) and
    a payload.  Groups stream through a sorted partition, so that a task holds one of them at a time and small
    ones cost no call of Spark each.  links: payload -> near, as `unite` takes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> list[tuple[int, int]]:
            table = pa.Table.from_batches(held)
            held.clear()
            if table.num_rows < 2:
                return []
            bulk = table.column(2).to_numpy().astype(bool)
            if bulk.any():  # the rows of the largest part after the others: they are near each other already
                table = table.take(pa.array(np.argsort(bulk, kind="stable")))
            ids, parts = table.column(0).to_numpy(), table.column(1).to_numpy()
            found = unite(parts, links(table.column(3)), int((~bulk).sum()) if bulk.any() else None)
            return _stars(ids, parts, found)

        def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))], 1).astype(np.int64)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            found: list[tuple[int, int]] = []
            for a, b in zip(edges, edges[1:]):
                if held and tuple(key[a]) != last:
                    found += close()
                last = tuple(key[a].tolist())
                part = batch.slice(a, b - a)
                held.append(pa.RecordBatch.from_arrays(part.columns[len(keys) :], names=part.schema.names[len(keys) :]))
            yield packed(found)
        if held:
            yield packed(close())

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def _salted(rows: DataFrame, few: DataFrame, key: str, by: str, how: str) -> DataFrame:
    """rows with the columns of few (one row for each large group), joined on key; the rows of a group spread over SALTS tasks."""
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by, F.lit(3)), F.lit(SALTS)).cast("int")).join(few, [key, "__salt"], how).drop("__salt")


def _chunk(by: str, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(seed)), blocks).cast("long")


def united(members: DataFrame, payload: Callable[[DataFrame], DataFrame], links, disjoint: bool) -> DataFrame:
    """node, component: what the links within groups join, with at most about BLOCK members of a group in a task.

    members: group, id, blocks (how many tasks' worth the group is), size (its members).  payload adds the column
    that links(payload) compares.  disjoint: an id is in one group only.
    """
    large = members.where("blocks > 1")
    shared = F.pmod(F.xxhash64("id", F.lit(5)), F.col("size")) < ANCHORS
    tasks = F.when(F.col("blocks") <= 1, F.array(F.lit(0).cast("long"))).when(shared, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(_chunk("id", F.col("blocks"), 4)))
    first = payload(members.select("group", F.explode(tasks).alias("task"), "id")).select("group", "task", "id", F.col("id").alias("part"), F.lit(False).alias("bulk"), "payload")
    first = cut(grouped(first, ["group", "task"], links).distinct())
    more = bool(large.limit(1).count())
    if disjoint and not more:  # each group was seen whole: its links are stars already
        return first.select(F.col("u").alias("node"), F.col("v").alias("component"))
    joined = connected_components(first)
    if not more:
        return joined
    # large groups whose members are in several parts yet
    labelled = large.select("group", "id", "size", "blocks").distinct().join(joined, F.col("id") == F.col("node"), "left").select("group", "id", "blocks", "size", F.coalesce("component", "id").alias("part"))
    parts = labelled.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"), F.first("blocks").alias("blocks"), F.first("size").alias("size"))
    worth = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(n * F.col("blocks") / F.col("size")))
    open_ = parts.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.max("n").alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"), F.first("blocks").alias("blocks"), F.first("size").alias("size"))
    open_ = open_.where("parts > 1").select("group", "most", worth(F.col("top")).alias("whole"), worth(F.col("all") - F.col("top")).alias("strays"))
    left = _salted(labelled, open_, "group", "id", "inner").withColumn("bulk", F.col("part") == F.col("most"))
    own_whole, own_stray = _chunk("id", F.col("whole"), 6), _chunk("id", F.col("strays"), 7)
    n, m = F.col("whole"), F.col("strays")
    each = lambda count, task: F.transform(F.sequence(F.lit(0).cast("long"), count - 1), task)
    # tasks 0 to n x m - 1: a chunk of the largest part and a block of strays; then pairs of blocks of strays
    pairs = F.when(m > 1, each(m, lambda y: n * m + F.least(y, own_stray) * m + F.greatest(y, own_stray))).otherwise(F.array().cast("array<long>"))
    tasks = F.when(F.col("bulk"), each(m, lambda y: own_whole * m + y)).otherwise(F.concat(each(n, lambda x: x * m + own_stray), pairs))
    second = payload(left.select("group", F.explode(tasks).alias("task"), "id", "part", "bulk")).select("group", "task", "id", "part", "bulk", "payload")
    second = cut(grouped(second, ["group", "task"], links).distinct())
    if not second.limit(1).count():
        return joined
    return connected_components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(second))


def _sketch_links(coordinates: pa.ChunkedArray):
    s = np.frombuffer(b"".join(coordinates.to_pylist()), np.uint8).reshape(-1, T)
    return lambda i, left: (s[left] == s[i]).mean(1) >= FLOOR


def _exact_links(words: int, percent: int):
    def links(texts: pa.ChunkedArray):
        sets = [shingles(t, words) for t in texts.to_pylist()]
        sizes = np.array([len(x) for x in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(code, kind="stable")]
        edges = np.append(0, np.cumsum(np.bincount(code)))
        starts = np.append(0, np.cumsum(sizes))

        def near(i: int, left: np.ndarray) -> np.ndarray:
            own = code[starts[i] : starts[i + 1]]
            if len(left) <= 2:
                both = np.array([len(np.intersect1d(own, code[starts[j] : starts[j + 1]], assume_unique=True)) for j in left])
            else:
                lengths = edges[own + 1] - edges[own]
                at = np.repeat(edges[own] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
                both = np.bincount(owners[at], minlength=len(sets))[left]
            return (both > 0) & (100 * both >= percent * (sizes[i] + sizes[left] - both))

        return near

    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    signed = cut(signatures(docs, words, id_col, text_col))
    # equal sets have equal sketches: any row's will do
    classes = signed.where("n > 0 and doc_id is not null").groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("coordinates").alias("coordinates"))
    classes = cut(classes.withColumn("slot", F.xxhash64("a", "b", "n")))
    rows = classes.select("id", "slot", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id", "slot")).alias("who")).where("size > 1")
    buckets = buckets.groupBy("size", "who").agg(F.min("key").alias("group"))
    meeting = cut(rows.join(buckets, F.col("key") == F.col("group")).select("group", "id", "slot", "size", F.ceil(F.col("size") / BLOCK).alias("blocks")))
    sketches = classes.select("id", F.col("coordinates").alias("payload"))
    clusters = cut(united(meeting, lambda x: x.join(sketches, "id"), _sketch_links, disjoint=False))
    drop(meeting)
    inside = clusters.select(F.col("node").alias("id"), F.col("component").alias("group")).union(clusters.select(F.col("component").alias("id"), F.col("component").alias("group")).distinct())
    # at least two rows: those of an id are few
    weighed = inside.join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id")
    large = weighed.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    large = large.select("group", "size", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / SHINGLES)).alias("blocks")).where("blocks > 1")
    dealt = cut(_salted(inside, large, "group", "id", "left").select("group", "id", F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks")))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("payload")).where("payload is not null")
    joined = united(dealt, lambda x: x.join(texts, "id"), _exact_links(words, percent), disjoint=True)
    named = classes.join(joined, F.col("id") == F.col("node"), "left").select("a", "b", "n", F.coalesce("component", "id").alias("__component"))
    out = signed.where("n > 0").select("doc_id", "n", "a", "b").join(named, ["a", "b", "n"], "left").select("doc_id", "n", "__component")
    out = out.union(signed.where("n = 0").select("doc_id", "n", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("__component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
