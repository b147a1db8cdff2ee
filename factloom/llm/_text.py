"""Byte-level tokenising and hashing of text columns, vectorised over Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Because
those bytes never occur inside a multi-byte UTF-8 sequence, working on bytes equals working on
code points. Work is sliced at word ends, so memory follows the slice and the longest single
word, not the batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_LOWER_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


class _Tables:
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            if n > 4 * SLICE_BYTES:
                return _powers(_BASE, n), _powers(_INVERSE, n)
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up, cls.down


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    if values is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    data = np.frombuffer(values, dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def _slices(space: np.ndarray, n: int):
    """Cut [0, n) after white space, at about SLICE_BYTES a slice."""
    at = 0
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n:
            tail = space[at:end]
            back = int(np.argmax(tail[::-1])) if tail.any() else -1
            if back >= 0:
                end -= back
                break
            end = min(n, end + SLICE_BYTES)  # one word longer than a slice
        yield at, end
        at = end


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words in order, and n+1 offsets of the rows in them."""
    data, off = utf8(column)
    n = len(data)
    space = _SPACE[data]
    out, starts = [], []
    rows = off[:-1]
    for a, b in _slices(space, n):
        part = space[a:b]
        first = ~part
        first[1:] &= part[:-1]
        if a and not space[a - 1]:
            first[0] = False
        # a row's first byte starts a word even where the row before ends in one
        inner = rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)] - a
        first[inner] = ~part[inner]
        if not part[0]:
            first[0] = True
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        up, down = _Tables.of(b - a)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_LOWER_BYTE[data[a:b]] * up[: b - a], begin)
            out.append(mix(sums * down[begin]))
        starts.append(begin + a)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(starts), off).astype(np.int64)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0xCA9B0C7EBA1DA115))


def shingles(words: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `width`-word shingles by row, sorted within a row, and the rows' offsets. A row
    of fewer words has its whole sequence as its one shingle; one without words has none."""
    n = np.diff(off)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][row]
    end = off[1:][row]
    h = mix(words[first] + np.uint64(1))
    for k in range(1, width):
        there = first + k < end
        h[there] = pair(h[there], words[first[there] + k])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.searchsorted(row[keep], np.arange(len(n) + 1)).astype(np.int64)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Zero-copy parts of a batch whose texts hold about `limit` bytes each (one row at least);
    of a list column, about `limit` items."""
    i = batch.schema.get_field_index(column)
    col = batch.column(i)
    n = batch.num_rows
    if n == 0:
        return
    measure = pa.compute.list_value_length if pa.types.is_list(col.type) or pa.types.is_large_list(col.type) else pa.compute.binary_length
    size = pa.compute.fill_null(measure(col), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Spark keeps its Python workers, and
    what they hold on to counts against the executor while other tasks run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def small_batches(spark: SparkSession) -> None:
    """Keep the batches sent to Python workers small where the session has the stock limits:
    long texts would make batches of 10,000 rows too large."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
