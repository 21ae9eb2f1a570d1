"""Vectorised byte-level text helpers shared by the operators.

Texts arrive as Arrow string columns.  They are looked at as one flat byte
buffer plus row offsets, so that word limits, hashes of substrings and sliding
minima are a handful of numpy passes and no Python code runs per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Largest slice (bytes of text) that is looked at at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

#: True for the six ASCII white-space bytes that separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (the splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Hashes of arbitrary substrings of a sequence, from prefix sums.

    The hash is a polynomial modulo 2**64 over random symbol values, mixed
    with the length.  Substrings must be shorter than 1024 symbols: beyond
    that, modulus 2**64 has known systematic collisions.
    """

    LONGEST = 1023

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * _power(_BASE, n), out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Prefix:
        return cls(_TABLE[data])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _power(_INVERSE, len(self.sums))
        raw = (self.sums[end] - self.sums[start]) * inverse[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix((self.sums[length:] - self.sums[:n]) * _power(_INVERSE, n))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offs[0]), int(offs[-1])
    bytes_ = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return bytes_, offs - lo


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes each, one row at least."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = max(lo + 1, min(hi, rows))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~IS_SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    kind = inside[at[:-1]]
    starts, ends = at[:-1][kind], at[1:][kind]
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, in three linear passes."""
    n = len(values)
    if n < width:
        return values[:0]
    if width == 1:
        return values.copy()
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
