"""Words of UTF-8 text columns as 64-bit hashes, straight from Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; only A-Z are lower-cased. Texts are
taken in chunks of about a quarter of a megabyte (a longer text is a chunk of its own), so memory stays bounded.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
try:
    _LIBC = ctypes.CDLL(None)
except OSError:
    _LIBC = None
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers can be divided out modulo 2**64
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_byte_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_byte_values[65:91] = _byte_values[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


class Words(NamedTuple):
    """rows: the slice of the batch; hashes: of all words in order; starts: each row's first word, and the total."""

    rows: slice
    hashes: np.ndarray
    starts: np.ndarray
    begin: np.ndarray  # byte offsets of words in data
    end: np.ndarray
    data: np.ndarray
    row_bytes: np.ndarray  # byte offsets of the rows in data, and its length
    sums: np.ndarray  # running sums that give the hash of any run of bytes


def release() -> None:
    """Gives memory that this worker no longer uses back to the system: other work's caches, and freed blocks."""
    if (tokens := sys.modules.get("tessera.llm.tokens")) is not None:
        tokens.forget()
    trim()


def trim() -> None:
    """Gives freed blocks back to the system."""
    pa.default_memory_pool().release_unused()
    if (give := getattr(_LIBC, "malloc_trim", None)) is not None:
        give(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _P)]), dtype=np.uint64)
            _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _P_INVERSE)]), dtype=np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    """Chunks of whole rows with the hashes of their words."""
    release()
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        yield hashed(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], slice(row, stop))
        row = stop


def hashed(data: np.ndarray, row_bytes: np.ndarray, rows: slice) -> Words:
    size = len(data)
    edge = np.ones(size + 1, bool)  # a word begins after a space or at a row's start
    np.take(_IS_SPACE, data, out=edge[1:])
    inside = ~edge[1:]
    edge[row_bytes] = True
    begin = np.flatnonzero(inside & edge[:-1])
    last = inside.copy()
    last[:-1] &= edge[1:-1] | ~inside[1:]
    rows_end = row_bytes[1:][row_bytes[1:] > row_bytes[:-1]] - 1
    last[rows_end] |= inside[rows_end]
    end = np.flatnonzero(last) + 1
    _grow(size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_byte_values[data] * _powers[:size], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * _inverses[begin])
    return Words(rows, hashes, np.searchsorted(begin, row_bytes), begin, end, data, row_bytes, sums)


def runs(w: Words, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte runs inside words; with seed 0 those of whole words equal ``hashes``."""
    with np.errstate(over="ignore"):
        return mix((w.sums[end] - w.sums[begin]) * _inverses[begin] + np.uint64(seed) * np.uint64(0xA0761D6478BD642F))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside rows, and each row's first (plus the total).

    A row with fewer words gives its whole sequence as one; a row without words gives none.
    """
    counts = np.diff(w.starts)
    n = len(w.hashes)
    with np.errstate(over="ignore"):
        factor = np.uint64(0xD6E8FEB86659FD93)
        full = np.zeros(max(n - width + 1, 0), np.uint64)
        for k in range(width):
            full = full * factor + w.hashes[k : n - width + 1 + k]
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    starts = np.concatenate([[0], np.cumsum(per_row)])
    index = np.arange(starts[-1]) - np.repeat(starts[:-1], per_row) + np.repeat(w.starts[:-1], per_row)
    out = np.zeros(starts[-1], np.uint64)
    whole = np.repeat(counts >= width, per_row)
    out[whole] = full[index[whole]]
    with np.errstate(over="ignore"):
        for row in np.flatnonzero((counts > 0) & (counts < width)):
            h = np.uint64(counts[row])
            for x in w.hashes[w.starts[row] : w.starts[row + 1]]:
                h = h * factor + x
            out[starts[row]] = h
    return mix(out), starts
