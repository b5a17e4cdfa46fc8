"""Words, word hashes, shingles and Arrow helpers that run inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS_KEPT = 100_000  # entries of a task's word cache before it starts anew
MASK = (1 << 64) - 1
#: Odd multipliers for the places of a window, drawn once from a hash so that any number can be had.
PLACES = np.array([xxhash.xxh64_intdigest(b"place%d" % i) | 1 for i in range(64)], dtype=np.uint64)

NOT_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Lower-cases A-Z and blanks every ASCII byte that is neither a digit nor a letter.
ALNUM = bytes(32 if b in NOT_WORD else b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered while the cache is small."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` as a task of a worker that outlives it: what it has freed goes back to the system.

    Python workers are reused, and their allocators keep freed memory. Without this, each stage of a pipeline
    adds the peak of the one before to its own.
    """
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` words; a shorter, non-empty text is one window."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, PLACES[-1] * np.uint64(width), dtype=np.uint64)
        for i in range(width):
            total += hashes[i:n - width + 1 + i] * PLACES[i % 60] + np.uint64(i // 60)
    return mix(total)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about ``limit`` bytes of text, a longer text by itself."""
    for batch in batches:
        sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()],
                         dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal, non-null ``keys`` from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    last = None

    def done():
        return pa.Table.from_batches(held)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield done()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield done()


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
