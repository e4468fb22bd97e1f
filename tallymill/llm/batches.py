"""Arrow batches as bounded runs of rows."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a run of its own.
RUN_BYTES = 2 << 20


#: Bytes of batches after which a worker gives freed memory back.
SETTLE = 16 << 20
_since = 0


@lru_cache(None)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim if sys.platform == "linux" else None
    except (OSError, AttributeError):  # another C library
        return None


def settle(size: int) -> None:
    """Count the bytes of a batch that is done; now and then give back memory that the allocators keep, as workers live on beside the next stages' tasks."""
    global _since
    _since += size
    if _since >= SETTLE:
        _since = 0
        pa.default_memory_pool().release_unused()
        if _trim() is not None:
            _trim()(0)


def runs(batch: pa.RecordBatch, column: str = "text", most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` holds about ``most`` bytes at most."""
    if not batch.num_rows:
        return
    ends = spans(batch.column(column))[1][1:]
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else ends[0] * 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    settle(int(ends[-1]))


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the ranges start .. start + len, end to end."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes (0 for an empty one)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
