"""Vectorised views of text columns: flat byte buffers, word bounds, 64-bit hashes.

A text column becomes one ``uint8`` buffer with row offsets; everything after that is
array arithmetic over whole batches, with no Python loop over words.
"""

from __future__ import annotations

import ctypes
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed one by one, so a word of many megabytes costs no more than its bytes.
LONG_WORD = 2048


@lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: idle Python workers stay alive beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def steady(rows):
    """A function over batches that leaves no freed memory behind between them and at the end."""

    def run(batches):
        for out in rows(batches):
            yield out
            del out
            release()
        release()

    return run


def one(f):
    """The same for a function of one group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = f(key, table)
        release()
        return out

    return run


def two(f):
    """The same for a function of two groups."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(key, left, right)
        release()
        return out

    return run


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(column, limit: int = 4 << 20):
    """(first, last) row ranges of a string column, each of about ``limit`` bytes; a single row is never cut."""
    _, off = flat(column)
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n+1 offsets of each row's words."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = inside[edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes a step."""
    lens = (ends - starts).astype(np.int64)
    h = lens.astype(U64) * U64(0x9E3779B97F4A7C15)
    if not len(h):
        return h
    padded = np.empty(len(buf) + 8, np.uint8)
    padded[: len(buf)], padded[len(buf) :] = buf, 0
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
    long = np.flatnonzero(lens > LONG_WORD)
    here, at, left = None, starts, lens
    while True:
        part = eight[at] & keep[np.minimum(left, 8)]
        if here is None:
            h = mix(h ^ part)
        else:
            h[here] = mix(h[here] ^ part)
        more = (left > 8) & (left <= LONG_WORD)
        here = np.flatnonzero(more) if here is None else here[more]
        if not len(here):
            break
        at, left = at[more] + 8, left[more] - 8
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


_BASE, _INVERSE = 0x9E6C63D0876A9A47, pow(0x9E6C63D0876A9A47, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, x, U64)]), dtype=U64) for x in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def rolling(units: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``length`` units (modulo 2**64): n - length + 1 values."""
    n = len(units) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, inverse = _tables(len(units))
    sums = np.zeros(len(units) + 1, U64)
    np.cumsum(units * power, out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * inverse[:n])


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' item offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the ranges start..start+len, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.arange(total) + np.repeat(starts - before, lens)


def strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """A large_string array over the rows of a UTF-8 buffer."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
