"""Words of many texts as numbers, exactly: Arrow dictionaries over blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of a text column; a longer text is in a batch of its own or ends one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(number of each of some ascending byte ranges, the distinct ranges' bytes by number)."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    lo, hi = int(start[0]), int(end[-1])
    step = np.zeros(hi - lo + 1, np.int8)
    step[start - lo] += 1
    step[end - lo] -= 1
    body = data[lo:hi][np.cumsum(step[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def blocks(n: int, size: int, ahead: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, last) of stretches lo..hi of n words; up to last they may be looked at too, so that no run of ahead + 1 words is cut."""
    for lo in range(0, n, size):
        hi = min(lo + size, n)
        yield lo, hi, min(hi + ahead, n)
