"""Texts of an Arrow batch as bytes: slices of bounded size, words and their hashes, by numpy."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

#: Seconds between two returns of free memory.
TRIM_SECONDS = 1.0
_trimmed = [0.0]


def trim(now: bool = False) -> None:
    """Gives free memory back to the system. An executor's memory is shared by its JVM and the Python workers of
    all stages, and workers live on between tasks with what the allocator keeps."""
    if now or time.monotonic() - _trimmed[0] >= TRIM_SECONDS:
        pa.default_memory_pool().release_unused()
        give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
        if give:
            give(0)
        _trimmed[0] = time.monotonic()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives free memory back between batches and at its end."""

    def trimming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            trim()
        trim(now=True)

    return trimming


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """Likewise a function for applyInArrow."""

    def trimming(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return trimming


def lean_cogroup(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Likewise a function for applyInArrow of two groups."""

    def trimming(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        trim()
        return out

    return trimming


_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 over a uint64 array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_KEY = splitmix(np.arange(1000, 1256, dtype=np.uint64))
_place_key = splitmix(np.arange(64, dtype=np.uint64)) | np.uint64(1)


def place_keys(n: int) -> np.ndarray:
    """Odd 64-bit multipliers for places 0 to n - 1."""
    global _place_key
    if len(_place_key) < n:
        _place_key = splitmix(np.arange(max(n, 2 * len(_place_key)), dtype=np.uint64)) | np.uint64(1)
    return _place_key[:n]


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space parts, and of words of letters, digits and all non-ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Slice(NamedTuple):
    """Rows lo to hi of a batch: their bytes, and where each row starts (one entry more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch; null is empty, and other types of column fail."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    return col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and the offsets of its rows."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, offs


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a text column in slices of about `most` bytes, at least one row each."""
    data, offs = raw(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


class Words(NamedTuple):
    """Words of a slice: their first bytes, ends, hashes, and each row's first word (one entry more)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def words(part: Slice, kind: np.ndarray) -> Words:
    """The words of each row, A-Z lowered: maximal runs of bytes of that kind, never across rows."""
    low = LOWER[part.data]
    inside = kind[low]
    n = len(low)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(part.starts), np.int64))
    cut = np.zeros(n + 1, dtype=bool)  # rows start here
    cut[part.starts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts
    places = np.cumsum(long) - long
    used = low[inside]
    off = np.arange(len(used)) - np.repeat(places, long)
    mixed = BYTE_KEY[used] * place_keys(int(long.max()))[off]
    return Words(starts, ends, splitmix(np.add.reduceat(mixed, places) + long.astype(np.uint64)), np.searchsorted(starts, part.starts))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, for Spark."""
    return x.view(np.int64)
