"""Words of Arrow text columns as numpy arrays: boundaries and 64-bit hashes without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
STEP = np.uint64(0xD6E8FEB86659FD93)
HASHED = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """BASE**j and its inverse for j below n at least, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(2 * HASHED, 1 << (n - 1).bit_length())
        _powers.clear()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 19, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Row slices of about `most` text bytes and at most `rows` rows, never less than a row: bounds memory, cuts no text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right"))
        end = max(at + 1, min(end, at + rows))
        yield batch.slice(at, end - at)
        at = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null reads as empty."""
    column = pc.fill_null(column, "")
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    where = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, where - where[0]


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word: a run of bytes outside SPACE within one row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = rows[(rows > 0) & (rows < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(rows, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with another table of 256 letters it is another hash. Words are read HASHED bytes at a time, which bounds memory and changes no hash."""
    found, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + HASHED, side="right")))
        a, b = start[at:stop] - start[at], end[at:stop] - start[at]
        some = data[start[at] : end[stop - 1]]
        up, down = powers(len(some) + 1)
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum((some.astype(np.uint64) + np.uint64(1) if letters is None else letters[some]) * up[: len(some)], out=total[1:])
        found[at:stop] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * STEP)
        at = stop
    return found


def run_hashes(word: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words (rows are not looked at): one value for each start."""
    n = max(0, len(word) - k + 1)
    h = np.full(n, salt * 2 + 1, np.uint64)
    for i in range(k):
        h = h * STEP + word[i : i + n]
    return mix(h)


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and the C library keep it else, and Spark's workers live for many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
