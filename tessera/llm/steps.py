"""Batches in steps of bounded bytes, so that long texts don't fill a worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
STEP_BYTES = 4 << 20


def steps(batch: pa.RecordBatch, column: int = 1, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    marks = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0) > 0)
    edges = [0, *[int(m) for m in marks if m], batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
