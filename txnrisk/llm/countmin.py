"""Count-min sketches over 64-bit keys, as far as "at least twice" is asked.

Tasks sketch their own keys, the sketches are merged block by block, and the
merged counts leave one bitmap per sketch row: the cells counted at least
twice.  A bitmap has a fixed size, ``2 ** bits / 8`` bytes, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txnrisk.llm import common

BLOCK_BITS = 18
#: Keys that a task gathers before it sends a partial sketch on.
FLUSH_KEYS = 1 << 22
SCHEMA = "sketch_row int, block long, counts binary"


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Each key's cell in one sketch row."""
    return common.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> np.uint64(64 - bits)


def pack_gaps(values: np.ndarray) -> bytes:
    """Sorted values as gaps of one byte; 255 stands for "255 and more"."""
    gap = np.diff(values, prepend=np.uint64(0)).astype(np.int64)
    last = np.cumsum(gap // 255 + 1) - 1
    out = np.full(int(last[-1]) + 1 if len(last) else 0, 255, dtype=np.uint8)
    out[last] = gap % 255
    return out.tobytes()


def unpack_gaps(blob: bytes) -> np.ndarray:
    x = np.frombuffer(blob, dtype=np.uint8)
    return np.cumsum(x, dtype=np.int64)[x < 255]


def sketch_batches(key_arrays, rows: int, bits: int):
    """Arrow batches of SCHEMA for an iterator of key arrays."""
    held, size, kind = [], 0, np.uint32 if bits <= 32 else np.uint64

    def flush():
        for row in range(rows):
            cell = np.concatenate([cells(keys, row, bits).astype(kind) for keys in held])
            cell.sort()
            first = np.append(True, cell[1:] != cell[:-1])
            more = ~np.append(first[1:], True)[first]  # whether the cell has two or more
            cell = cell[first]
            edge = np.flatnonzero(np.append(True, (cell[1:] ^ cell[:-1]) >> BLOCK_BITS))
            local = ((cell[a:b] & ((1 << BLOCK_BITS) - 1)).astype(np.uint64) * np.uint64(2) + more[a:b]
                     for a, b in zip(edge, np.append(edge[1:], len(cell))))
            yield pa.record_batch({"sketch_row": pa.array([row] * len(edge), pa.int32()),
                                   "block": pa.array((cell[edge] >> BLOCK_BITS).astype(np.int64)),
                                   "counts": pa.array([pack_gaps(x) for x in local], pa.binary())})

    for keys in key_arrays:
        if len(keys):
            held.append(keys)
            size += len(keys)
        if size >= FLUSH_KEYS:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def merged_bitmaps(sketches: DataFrame, rows: int, bits: int) -> list[np.ndarray]:
    """Merge partial sketches; ``rows * 2 ** bits / 8`` bytes reach the driver at most."""

    def merge(key, table):
        total = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        for blob in table.column("counts"):
            x = unpack_gaps(blob.as_py())
            total[x >> 1] = np.minimum(total[x >> 1] + 1 + (x & 1).astype(np.uint8), 2)
        twice = total > 1
        keep = [True] if twice.any() else []
        return pa.table({"sketch_row": pa.array([key[0].as_py()] * len(keep), pa.int32()),
                         "block": pa.array([key[1].as_py()] * len(keep), pa.int64()),
                         "bits": pa.array([np.packbits(twice).tobytes()] * len(keep), pa.binary())})

    bitmaps = [np.zeros(1 << bits >> 3, dtype=np.uint8) for _ in range(rows)]
    width = 1 << (BLOCK_BITS - 3)
    for r in sketches.groupBy("sketch_row", "block").applyInArrow(merge, "sketch_row int, block long, bits binary").toLocalIterator():
        bitmaps[r.sketch_row][r.block * width:(r.block + 1) * width] = np.frombuffer(r.bits, dtype=np.uint8)
    return bitmaps


def estimated_twice(bitmaps: list[np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key's estimate is two or more (never false for one that has)."""
    hit = np.ones(len(keys), dtype=bool)
    for row, bitmap in enumerate(bitmaps):
        c = cells(keys, row, bits)
        hit &= (bitmap[(c >> np.uint64(3)).astype(np.int64)] >> (7 - (c & np.uint64(7))).astype(np.uint8)) & 1 > 0
    return hit
