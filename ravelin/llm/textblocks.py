"""Vectorised byte-level text primitives shared by the operators.

A *block* is a bounded run of rows of one Arrow batch, seen as one ``uint8``
array plus row offsets. Everything below works on whole blocks with numpy, so
that no Python code runs for each word of the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
_MASK = (1 << 64) - 1


def freeing(work: Callable) -> Callable:
    """A task's function that gives memory back at its end: workers live on, from stage to stage."""

    def run(batches):
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits that mixes well."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(seed: int, n: int, odd: bool = True) -> np.ndarray:
    """n reproducible 64-bit constants."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & _MASK)
    x = splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start)
    return x | np.uint64(1) if odd else x


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of sorted disjoint ranges: the number of each one's string among the distinct ones, and those.

    Strings are told apart by their bytes, so different ones never meet.
    """
    if not len(starts):
        return np.zeros(0, np.int64), []
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    flat = buf[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    off = np.concatenate(([0], np.cumsum(ends - starts)))
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(flat)])
    coded = column.dictionary_encode()
    own = coded.dictionary
    edges = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1].tolist()
    data = own.buffers()[2].to_pybytes() if own.buffers()[2] is not None else b""
    return coded.indices.to_numpy().astype(np.int64), [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def hashes(strings: list[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of byte strings (XXH3, which is not linear in them)."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in strings), np.uint64, len(strings))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each range; equal strings have equal hashes wherever they stand, in any block."""
    codes, strings = distinct(buf, starts, ends)
    return hashes(strings, seed)[codes] if len(codes) else np.zeros(0, np.uint64)


def gram_hashes(buf: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the ``size`` bytes (8 at least) that begin at each place, mixed after each eight of them."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    out = np.full(n, constants(seed, 1)[0], np.uint64)
    for at in [*range(0, size - 8, 8), size - 8]:
        out = splitmix(out ^ eights[at : at + n])
    return out


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1, from 0) of a string array without nulls."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` text bytes each, one row at least."""
    if batch.num_rows == 0:
        return
    at = batch.schema.get_field_index(column)
    _, off = utf8(plain(batch.column(at)))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def table_of(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


SPACES = table_of(b"\x20\x09\x0a\x0b\x0c\x0d")
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by one sort (``np.unique`` hashes integers, which takes far longer here)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row its first word (n + 1). ``cut``: places where a word always begins."""
    inside = ~separators[buf]
    n = len(buf)
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1] if cut is None else ~inside[:-1] | cut[1:]
        end[:-1] &= ~inside[1:] if cut is None else ~inside[1:] | cut[1:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        start[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indices of ragged ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges ``first[i]:first[i+1]`` (0 where empty)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
