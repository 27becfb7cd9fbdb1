"""Rows of Arrow batches in slices of bounded size.

A batch has up to 10,000 rows, or as many as Spark's bound of bytes lets through,
and as Python objects it takes several times its bytes. Codecs and tables work on
one row at a time, so they get a few rows at a time, and hand on what these give.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def release() -> None:
    """Gives memory that a batch has used, and that allocators keep, back to the system: workers live on, idle or for another task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _ends(columns: list[pa.Array]) -> np.ndarray:
    """Running totals of the rows' bytes; values of a fixed width count as 16."""
    total = np.full(len(columns[0]), 16 * len(columns), np.int64)
    for c in columns:
        if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(total)


def sliced(batches: Iterator, limit: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    """Rows as tuples, in lists of at most `limit` bytes, or one row where it is longer. `batches` are arrays, or tuples of them."""
    for batch in batches:
        columns = list(batch) if isinstance(batch, tuple) else [batch]
        del batch
        ends, row = _ends(columns), 0
        while row < len(ends):
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield list(zip(*(c.slice(row, stop - row).to_pylist() for c in columns), strict=True))
            row = stop
        del columns
        release()
