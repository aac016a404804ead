"""Shared helpers: staged tables, and word hashing over Arrow text buffers."""

from __future__ import annotations

import ctypes
import functools
import inspect
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txnrisk.session import shared_path

#: Text handled at once inside a task; bounds the numpy temporaries.
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 4096


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared folder and read it
    back: computed once, lineage cut, safe against lost executors."""
    path = shared_path(df.sparkSession, f"llm-{uuid.uuid4().hex}", label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -------------------------------------------------------------- worker memory
def give_back() -> None:
    """Return free memory to the system, Arrow's and the C library's (if it can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(work):
    """``work`` for an Arrow step, whose free memory goes when the task (of a
    generator) or the group ends: a Python worker waits for its next task
    beside the executor, and what it keeps counts with the executor's memory."""
    if inspect.isgeneratorfunction(work):
        def run(batches):
            try:
                yield from work(batches)
            finally:
                give_back()
    else:
        def run(left, right):  # Spark counts the arguments: a key and its rows, or both sides' rows
            try:
                return work(left, right)
            finally:
                give_back()
    return functools.wraps(work)(run)


# ---------------------------------------------------------------- word hashing
#: Bytes between words: space and 0x09-0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64 (an odd base)."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column, max_bytes: int = CHUNK_BYTES, max_rows: int = CHUNK_ROWS):
    """Yield (first row, bytes, offsets) over pieces of an Arrow text column.

    ``offsets`` has rows + 1 entries into ``bytes``; null texts are empty.
    Texts are never cut: one longer than ``max_bytes`` makes its own chunk.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + max_rows)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Start and end byte of every word, and each row's first word index
    (rows + 1 entries).  Words never cross from one row into the next."""
    size = len(data)
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = ~SEPARATOR[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < size)]
    start[edges] |= inside[1:-1][edges]
    end[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11,
                step: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word's bytes; temporaries stay bounded by ``step`` words."""
    codes, out = byte_codes(seed), np.empty(len(starts), dtype=np.uint64)
    base = int(np.random.default_rng(seed + 1).integers(1 << 60, 1 << 62)) * 2 + 1
    for lo in range(0, len(starts), step):
        s, e = starts[lo:lo + step], ends[lo:lo + step]
        size = e - s
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        value = codes[data[at + np.repeat(s, size)]] * powers(base, int(size.max()))[at]
        out[lo:lo + step] = np.add.reduceat(value, first) + size.astype(np.uint64)
    return mix(out)


def gram_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (one per start position)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    base = np.random.default_rng(seed).integers(1 << 60, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out += words[j:len(words) - n + 1 + j] * base[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
