"""Arrow batches in and out of ``mapInArrow`` functions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_ROWS = 262_144


def chunks(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS, size: int = 128 << 20) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``rows`` rows or ``size`` bytes: large
    enough for vectorised work, bounded however large the partition is."""
    held, n, b = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            b += batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held)
            held, n, b = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def ints(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    """A numeric column as int64, NULL as ``null``."""
    return column.combine_chunks().cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column over one flat buffer, cut by ``lengths`` (bytes)."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.Array, dtype) -> np.ndarray:
    """The values of a binary column behind one another, as one array."""
    if not len(column):
        return np.array([], dtype=dtype)
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
    data = column.buffers()[2]
    if data is None:
        return np.array([], dtype=dtype)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(dtype)
