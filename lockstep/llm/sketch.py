"""Count-min sketches of 64-bit keys, built by partition, merged by a shuffle.

Cells stop at 2, since all that is asked is whether a key may have come more than once. Each
partition sends the cells it touched; blocks of cells are merged apart; what is left is a bitmap
of the cells that reached 2. Its size is chosen from the expected number of keys and bounded by
MAX_BITS, so the bitmap can be broadcast. Beyond that size more keys than necessary count as
repeated, and none that is repeated is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lockstep.llm.common import partitions

DEPTH = 2
# 2**29 cells a row: two bitmaps of 64 MB.
MIN_BITS, MAX_BITS = 16, 29
BLOCK_BITS = 16
# Keys that a task holds before it sends a partial sketch.
HELD_KEYS = 4_000_000


def width_bits(expected_keys: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, int(2 * expected_keys).bit_length()))


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (keys >> np.uint64(row * 32)) & np.uint64((1 << bits) - 1)


def _partial(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    parts, once, more = [], [], []
    for row in range(DEPTH):
        cells, counts = np.unique(_cells(keys, row, bits), return_counts=True)
        block, low = cells >> np.uint64(BLOCK_BITS), (cells & np.uint64(0xFFFF)).astype(np.uint16)
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(cells) else []
        for lo, hi in zip(starts, [*starts[1:], len(cells)], strict=True):
            again = counts[lo:hi] > 1
            parts.append((row << (bits - BLOCK_BITS)) + int(block[lo]))
            once.append(low[lo:hi][~again].tobytes())
            more.append(low[lo:hi][again].tobytes())
    return pa.record_batch(
        [pa.array(parts, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
        ["part", "once", "more"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells = blocks.setdefault(part, np.zeros(1 << BLOCK_BITS, np.uint8))
            at = np.frombuffer(once, np.uint16)
            cells[at] = np.minimum(cells[at] + 1, 2)
            cells[np.frombuffer(more, np.uint16)] = 2
    full = {part: np.packbits(cells > 1) for part, cells in blocks.items() if (cells > 1).any()}
    yield pa.record_batch(
        [pa.array(list(full), pa.int32()), pa.array([b.tobytes() for b in full.values()], pa.binary())],
        ["part", "bits"],
    )


class Repeated:
    """The merged sketch: may(keys) tells which keys may have come more than once."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def may(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row in range(DEPTH):
            cells = _cells(keys, row, self.bits)
            byte = self.bitmap[row, (cells >> np.uint64(3)).astype(np.int64)]
            out &= ((byte >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & np.uint8(1)) == 1
        return out


def repeated(rows: DataFrame, keys_of: Callable, expected_keys: int) -> Repeated:
    """The merged sketch of all keys that keys_of yields, as uint64 arrays, for each Arrow batch."""
    bits = width_bits(expected_keys)

    def partial(batches):
        held, n = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= HELD_KEYS:
                    yield _partial(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield _partial(np.concatenate(held), bits)

    # A merging task holds a share of DEPTH << bits bytes of cells, 64 MB at most.
    tasks = max(partitions(rows.sparkSession), (DEPTH << bits) >> 26)
    merged = (
        rows.mapInArrow(partial, "part int, once binary, more binary")
        .repartition(tasks, "part")
        .mapInArrow(_merge, "part int, bits binary")
    )
    bitmap = np.zeros((DEPTH, 1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    flat = bitmap.reshape(-1, 1 << (BLOCK_BITS - 3))
    for batch in merged.toArrow().to_batches():
        for part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            flat[part] = np.frombuffer(packed, np.uint8)
    return Repeated(bits, bitmap.reshape(DEPTH, -1))
