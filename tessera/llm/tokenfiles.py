"""Token ids in binary files with Elias-Fano document boundaries.

A file holds blocks.  A block is a JSON header (length first, 32 bits), the concatenated ids (16 bits
each where the vocabulary allows, else 32), the boundaries and the document ids.  Boundaries are the
end positions of the documents, ascending, as an Elias-Fano sequence: the low `width` bits of each
value packed, and the high bits in unary.  That takes about 2 + log2(ids / documents) bits a document,
against 64 for an offset table.  `select(i)` finds the i-th one bit through counts kept for every 64
bytes, so a single document is read without decoding the boundaries before it.

Files are in ascending id order (null ids first): texts are range-partitioned by id, each partition is
one file, and a file is written under a name of its own attempt and renamed when it is whole, so a
task that runs again replaces it.

Defined results: a null text is an empty document with only the end id; rows with equal ids follow
each other ordered by text; an empty table gives no files and no rows; other columns are never read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, parallelism, ship, trimmed
from .encoding import encoder
from .steps import steps

VOCABULARY, END_ID = "word_bpe_49k.json", 2
MAGIC = b"TOKENEF1"
#: ids of one block; a longer document is a block of its own.
BLOCK_IDS = 2_000_000
_STRIDE = 64


class EliasFano:
    """An ascending sequence of non-negative integers, each found by select."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high)
        pad = -len(ones) % _STRIDE
        self.ranks = np.append(0, np.cumsum(np.append(ones, np.zeros(pad, ones.dtype)).reshape(-1, _STRIDE).sum(1, dtype=np.int64)))

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        width = max(0, int((int(v[-1]) // n).bit_length()) - 1) if n else 0
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        block = int(np.searchsorted(self.ranks, i, "right")) - 1
        part = np.unpackbits(self.high[block * _STRIDE : (block + 1) * _STRIDE], bitorder="little")
        at = block * _STRIDE * 8 + int(np.flatnonzero(part)[i - self.ranks[block]])
        first = i * self.width
        raw = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8], bitorder="little")[first % 8 :][: self.width]
        return ((at - i) << self.width) | sum(int(b) << k for k, b in enumerate(raw))

    def selected(self, i: np.ndarray) -> np.ndarray:
        """The values of these places, in any order: select for many at once."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.int64)
        rows = np.append(self.high, np.zeros(-len(self.high) % _STRIDE, np.uint8)).reshape(-1, _STRIDE)
        low = np.append(self.low, np.zeros(8, np.uint8))
        for a in range(0, len(i), 1 << 14):
            some = i[a : a + (1 << 14)]
            block = np.searchsorted(self.ranks, some, "right") - 1
            ones = np.cumsum(np.bitwise_count(rows[block]), 1, dtype=np.int64)  # up to each byte of the block
            rest = some - self.ranks[block]
            byte = (ones <= rest[:, None]).sum(1)
            rest -= np.where(byte > 0, np.take_along_axis(ones, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
            bits = np.unpackbits(rows[block, byte][:, None], axis=1, bitorder="little")
            bit = (np.cumsum(bits, 1) <= rest[:, None]).sum(1)
            at = (block * _STRIDE + byte) * 8 + bit
            value = np.zeros(len(some), np.int64)
            for k in range(self.width):
                p = some * self.width + k
                value |= (low[p >> 3].astype(np.int64) >> (p & 7) & 1) << k
            out[a : a + (1 << 14)] = ((at - some) << self.width) | value
        return out

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return (at.astype(np.int64) << self.width) + (bits << np.arange(self.width)).sum(1)

    @property
    def nbytes(self) -> int:
        return len(self.low) + len(self.high)


def write_block(out, doc_ids: list[int | None], ids: list[bytes]) -> int:
    """Write one block of documents to a stream, return its ids."""
    values = np.frombuffer(b"".join(ids), "<u4")
    wide = bool(len(values)) and int(values.max()) > 0xFFFF
    ends = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids]))
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    keys = EliasFano.encode(np.array(known, np.int64) - least)
    body = [values.astype("<u4" if wide else "<u2").tobytes(), ends.low.tobytes(), ends.high.tobytes(), keys.low.tobytes(), keys.high.tobytes()]
    head = json.dumps({"docs": len(ids), "ids": len(values), "wide": wide, "nulls": len(ids) - len(known), "least": least, "end_width": ends.width, "key_width": keys.width, "bytes": [len(b) for b in body]}).encode()
    out.write(struct.pack("<I", len(head)) + head + b"".join(body))
    return len(values)


class Block:
    """A block as it was read: ids, boundaries and document ids."""

    def __init__(self, head: dict, body: list[bytes]):
        self.docs, self.n_ids = head["docs"], head["ids"]
        self.ids = np.frombuffer(body[0], "<u4" if head["wide"] else "<u2")
        raw = [np.frombuffer(b, np.uint8) for b in body[1:]]
        self.ends = EliasFano(head["docs"], head["end_width"], raw[0], raw[1])
        keys = EliasFano(head["docs"] - head["nulls"], head["key_width"], raw[2], raw[3])
        self.doc_ids = [None] * head["nulls"] + (keys.all() + head["least"]).tolist()

    def document(self, i: int) -> np.ndarray:
        """ids of the i-th document, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def read_blocks(stream) -> Iterator[Block]:
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while size := stream.read(4):
        head = json.loads(stream.read(struct.unpack("<I", size)[0]))
        yield Block(head, [stream.read(n) for n in head["bytes"]])


def _open(path: str):
    """pyarrow's file system of a path; Spark's names of the same stores are known too."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        path = ours + path[len(theirs) :] if path.startswith(theirs) else path
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """Write the files; returns (part, documents, ids) of each, as many as there are partitions."""
    spark = docs.sparkSession
    ship(spark)
    end = np.array([end_id], "<u4").tobytes()
    store, root = _open(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, total, n = context.partitionId(), 0, 0
        encode, keys, ids, size, out = encoder(vocabulary).encode, [], [], 0, None
        there, base = _open(path)
        mine = f"{base}/part-{part:06d}.{context.taskAttemptId()}.tmp"
        for batch in trimmed(batches):
            for some in steps(batch):
                if out is None:
                    out = there.open_output_stream(mine)
                    out.write(MAGIC)
                for key, data in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    if size and size + len(data) // 4 >= BLOCK_IDS:
                        total += write_block(out, keys, ids)
                        keys, ids, size = [], [], 0
                    keys.append(key)
                    ids.append(data + end)
                    size += len(data) // 4 + 1
                    n += 1
        if out is not None:
            total += write_block(out, keys, ids)
            out.close()
            there.move(mine, f"{base}/part-{part:06d}.tokens")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = max(parallelism(spark), docs._jdf.queryExecution().toRdd().getNumPartitions())
    made = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = sorted(tuple(r) for r in made.mapInArrow(run, "part int, docs long, ids long").collect())  # one row a file
    with store.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps({"vocabulary": vocabulary, "end_id": end_id, "parts": found}).encode())
    return found


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rows of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    ship(spark)
    store, root = _open(path)
    with store.open_input_stream(f"{root}/index.json") as f:
        parts = json.loads(f.read())["parts"]
    base, bases = 0, []
    for part, _, n in parts:
        bases.append((part, base))
        base += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, top = _open(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part, at = bases[k]
                with there.open_input_stream(f"{top}/part-{part:06d}.tokens") as f:
                    for block in read_blocks(f):
                        ends = block.ends.selected(np.arange(block.docs))
                        starts = np.append(0, ends[:-1])
                        wide = block.ids.astype("<u4").tobytes()
                        crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                        columns = {"doc_id": pa.array(block.doc_ids, pa.int64()), "start": pa.array(starts + at), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())}
                        if with_ids:
                            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(block.ids.astype(np.int32)))
                        yield pa.RecordBatch.from_pydict(columns)
                        at += block.n_ids

    return spark.range(0, len(bases), 1, max(1, len(bases))).mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Write the documents to token files in the shared folder (or at `path`) and read them back."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write(docs, path, vocabulary, end_id)
    return read(spark, path, with_ids)
