"""What the operators share: the shared folder, cut lineage, and shipping the package to executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: "weakref.WeakSet" = weakref.WeakSet()
_set_up: "weakref.WeakSet" = weakref.WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests on one machine), a folder of the local machine is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc not in _set_up:
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.checkpoint.dir", named)
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        _set_up.add(sc)
    return named or sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder: lineage ends there, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote of df, when nothing reads it any more."""
    spark = df.sparkSession
    written = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if written.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that their Python can import it."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(target))
    _shipped.add(sc)


_holder: list = ["", None]


def claim(owner: str, forget=None) -> None:
    """In a Python worker: an operator that keeps words at hand takes the place of the one before it.

    Workers outlive stages; without this the caches of a pipeline's operators would add up.
    """
    if _holder[0] != owner:
        if _holder[1]:
            _holder[1]()
        if _holder[0]:
            _give_back()
        _holder[:] = [owner, forget]


def _give_back(cycles: bool = True) -> None:
    """Freed memory goes back to the system, where the allocators keep it."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator[pa.RecordBatch], every: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """The batches; what a worker has freed goes back to the system after so many bytes and at the end.

    Workers live on between tasks; without this each would keep the memory of the largest step it has seen.
    """
    passed = 0
    for batch in batches:
        passed += batch.nbytes
        yield batch
        if passed >= every:
            del batch
            _give_back(cycles=False)
            passed = 0
    _give_back(cycles=False)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def sampled(h: Column, fraction: float) -> Column:
    """Whether a 64-bit hash falls under a fraction of its range, however small the fraction is."""
    return F.lit(True) if fraction >= 1 else h < F.lit(max(-(2**63) + 1, int(-(2**63) + fraction * 2.0**64))).cast("long")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
