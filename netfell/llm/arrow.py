"""Arrow batches in and out of mapInArrow functions, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time by one Python worker, unless a single text is longer.
SLICE_BYTES = 2 << 20


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value; 0 for null."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, width)
    return np.diff(ends.astype(np.int64))


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column number ``text`` has about ``most`` bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = (np.cumsum(sizes(batch.column(text))) - 1) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, and the start of each value in them with the end of the last."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]
