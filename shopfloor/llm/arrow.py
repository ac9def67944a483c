"""Arrow helpers shared by the operators' tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of ``batch`` of about ``limit`` text bytes (one row at least), nulls as empty."""
    at = batch.schema.get_field_index(column)
    texts = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
    batch = batch.set_column(at, column, texts)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a non-null large_string array, and its offsets counted from 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]
