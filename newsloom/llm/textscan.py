"""Vectorised reading of Arrow text columns: words, their hashes and their n-grams.

Everything works on slices of some megabytes of whole documents, so the memory
of a task does not depend on the size of a batch, only on the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: The bytes that part words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE, name: str = "up") -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 64), base, np.uint64)
        have[0] = 1
        have = _powers[name] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit depends on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most limit bytes, or of one row that is longer."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch, each with its text's bytes and offsets."""
    data, at = buffers(batch.column(column))
    for i, j in slices(at):
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and n + 1 offsets of the documents' words."""
    dark = ~space[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = dark[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = dark[1:]
    edge = at[(at > 0) & (at < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(dark & ~before), np.flatnonzero(dark & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of which any stretch's hash is a difference."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(len(data)), out=sums[1:])
    return sums


def stretches(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from starts to ends."""
    down = powers(len(sums), _BASE_INVERSE, "down")
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return stretches(prefix(data), starts, ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries, one for each start; the caller drops those that cross documents."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += hashes[j : j + m]
    return mix(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of width values, the index of the first with the smallest upper half."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    low = (values & _U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return (low & _U(0xFFFFFFFF)).astype(np.int64)


def anchor_runs(order: np.ndarray, off: np.ndarray, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: runs of windows of `length` units in one document that have the same anchor.

    order ranks the parts of `part` units at each start; a window's anchor is the
    first of its parts that ranks lowest, so equal windows have equal anchors at
    equal places. Returns, for each run, its document, first window, number of
    windows and anchor (indexes in the slice). off: n + 1 offsets of documents.
    """
    none = np.zeros(0, np.int64)
    at = sliding_argmin(order, length - part + 1)
    if not len(at):
        return none, none, none, none
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    windows = np.flatnonzero(np.arange(len(at)) + length <= off[doc + 1])
    if not len(windows):
        return none, none, none, none
    at = at[windows]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [len(at)])))
    return doc[windows[first]], windows[first], count, at[first]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
