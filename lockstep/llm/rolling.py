"""Hashes of words and byte strings over whole Arrow batches, with numpy.

A span's hash is a sum of random values times powers of an odd number, modulo 2**64, taken as the
difference of two prefix sums and mixed. It depends on the span's content alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Batches are worked on in slices of about this many bytes, so that arrays of eight bytes for each stay
# in the cache; a longer text is a slice by itself.
SLICE_BYTES = 250_000
# Low bits that hold a position where hash and position are compared as one number.
PLACE_BITS = np.uint64(30)
PLACE = np.uint64((1 << 30) - 1)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Roll:
    """One family of span hashes; equal seeds give equal hashes everywhere."""

    def __init__(self, seed: int):
        draws = np.random.RandomState(seed).randint(0, 2**32, 514).astype(np.uint64)
        self.values = (draws[0:512:2] << np.uint64(32)) | draws[1:512:2]
        base = ((int(draws[512]) << 32) | int(draws[513])) & ~7 | 3
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.ups = self.downs = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ups) < n + 1:
            size = max(n + 1, SLICE_BYTES + 1)
            self.ups, self.downs = _powers_of(self.base, size), _powers_of(self.inverse, size)
        return self.ups, self.downs

    def prefix(self, values: np.ndarray) -> np.ndarray:
        ups, _ = self._powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * ups[: len(values)], out=out[1:])
        return out

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.values[data])

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        _, downs = self._powers(len(prefix))
        return mixed((prefix[hi] - prefix[lo]) * downs[lo] + (hi - lo).astype(np.uint64))

    def runs(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hash of every span of one length, by its start."""
        n = max(len(prefix) - length, 0)
        _, downs = self._powers(len(prefix))
        return mixed((prefix[length : length + n] - prefix[:n]) * downs[:n] + np.uint64(length))


def sliding(of: Callable, values: np.ndarray, length: int) -> np.ndarray:
    """np.minimum or np.maximum over every window of one length, by doubling."""
    out, width = values, 1
    while width * 2 <= length:
        out, width = of(out[: len(out) - width], out[width:]), width * 2
    rest = length - width
    return of(out[: len(out) - rest], out[rest:]) if rest else out


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and bounds of the texts in slices of a batch; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind, empty = np.int32, b"" if pa.types.is_binary(column.type) else ""
    else:
        kind, empty = np.int64, ""
    if column.null_count:
        column = pc.fill_null(column, empty)
    if not len(column):
        return
    _, where, what = column.buffers()
    bounds = np.frombuffer(where, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def words(
    data: np.ndarray, bounds: np.ndarray, blanks: np.ndarray = _BLANK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text.

    blanks: which of the 256 bytes stand between words, ASCII white space if not given.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    blank = blanks[data]
    first, last = ~blank, ~blank
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first[1:] &= blank[:-1] | edge[1:-1]
    last[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def anchors(hashes: np.ndarray, bounds: np.ndarray, gram: int, window: int):
    """Windows of each text and the gram of least hash in each.

    hashes: of the grams by their start; bounds: of the texts, in the same unit. Returns the
    starts of all whole windows and the start of the anchor in each, the leftmost of the least.
    Equal windows have their anchors at the same place inside.
    """
    inside = window - gram + 1
    if len(hashes) < inside:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding(np.minimum, (hashes >> PLACE_BITS << PLACE_BITS) | place, inside)
    valid = np.zeros(len(least) + 1, np.int32)
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - window + 1, bounds[:-1])
    np.add.at(valid, np.minimum(lo, len(least)), 1)
    np.add.at(valid, np.minimum(hi, len(least)), -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    return starts, (least[starts] & PLACE).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
