"""Columns of texts as flat numpy arrays: bytes, words, word hashes and window anchors, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: The bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _ODD, dtype=np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[:n], _inverse[:n]


class Rolling:
    """Hashes of any range of a sequence of 64-bit values, in constant time per range."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k consecutive values."""
        n = len(self._sums) - k
        return mix((self._sums[k:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


class Texts(NamedTuple):
    """Bytes of several texts behind each other; text i is data[starts[i]:starts[i + 1]]."""

    data: np.ndarray
    starts: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(whole[starts[0] : starts[-1]], starts - starts[0])


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about `most` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    at = texts_of(batch.column(column)).starts
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words(NamedTuple):
    """Words of several texts; those of text i are first[i]:first[i + 1], word j is data[start[j]:end[j]]."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def words_of(texts: Texts) -> Words:
    """Words are the longest runs of bytes other than white space; a text's end ends its word."""
    data, starts = texts
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    limits = starts[1:-1]
    limits = limits[(limits > 0) & (limits < len(data))]
    begins[limits] |= inside[1:-1][limits]
    ends[limits - 1] |= inside[1:-1][limits - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(start, starts), start, end, Rolling(_BYTE[data]).ranges(start, end))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest value, the first if equal, in every window of `width` values. Values are cut to 40 bits, so a
    piece holds fewer than 2**24 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    piece = 1 << 23
    if n > piece:
        return np.concatenate([lowest(values[i : i + piece + width - 1], width) + i for i in range(0, n, piece)])
    rows = -(-len(values) // width)
    keyed = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    keyed[: len(values)] = (values & ~_U((1 << 24) - 1)) | np.arange(len(values), dtype=np.uint64)
    grid = keyed.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & _U((1 << 24) - 1)).astype(np.int64)


class Blocks(NamedTuple):
    """Windows of one sequence that share an anchor: windows first..last (their starts), the anchor's place, the hash of
    the anchor's k values and that of all values which the block's windows hold."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    whole: np.ndarray


def blocks_of(values: np.ndarray, width: int, k: int) -> Blocks:
    """Cuts the windows of `width` values into blocks by their anchor: the k values of lowest hash within the window. Equal
    windows have equal anchors at equal places, so they lie in blocks of equal key."""
    if len(values) < width:
        none = np.zeros(0, dtype=np.int64)
        return Blocks(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    rolling = Rolling(values)
    grams = rolling.windows(k)
    anchors = lowest(grams, width - k + 1)
    change = np.flatnonzero(np.diff(anchors)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [len(anchors) - 1]])
    at = anchors[first]
    return Blocks(first, last, at, grams[at], rolling.ranges(first, last + width) ^ mix((at - first).astype(np.uint64)))
