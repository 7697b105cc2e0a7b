"""Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """Return what was freed to the system, as two workers and a JVM share an executor's memory; only glibc has to be told."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch, column: str, most: int = 8 << 20):
    """Slices of a batch whose column holds about ``most`` bytes, as results are larger than their rows."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch[column]).to_pylist()):
        held += n or 0
        if held > most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
