"""Whole text columns as NumPy arrays: bytes, words and their hashes.

Helpers for functions that run inside ``mapInArrow``; a batch is worked on in
slices of bounded bytes, however long single texts are.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: each input bit reaches all output bits."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = keys(256, 11)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_STEP = 0x9E3779B97F4A7C55

_b = np.arange(256)
#: Bytes of words that end at the six ASCII white space characters.
SPACED = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)


def powers(n: int, step: int = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), _U(step), dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def tidy(run, encoder: bool = False):
    """``run`` for ``mapInArrow``, giving back its memory when a task ends: workers live on, and wait, between stages.

    A worker keeps its tokenizer for the next task of ``encoder``s, and drops
    it when it turns to other work.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sys.modules.get("visiontables.llm.bpe")
        if coder is not None and not encoder and coder.drop():
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more at the end); null is empty."""
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(buf: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each row's first word (one more at the end). Words never cross rows."""
    inside = kind[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``start[i] .. start[i] + size[i] - 1`` of all i, end to end."""
    if not len(size):
        return np.zeros(0, np.int64)
    total = np.cumsum(size)
    return np.arange(total[-1]) + np.repeat(start - (total - size), size)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case."""
    if not len(start):
        return np.zeros(0, _U)
    size = end - start
    total = np.cumsum(size)
    first = total - size
    place = np.arange(total[-1]) - np.repeat(first, size)
    value = _BYTE[buf[place + np.repeat(start, size)]] * powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(_U))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, given each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's items, given each row's first item; 0 for rows without any."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
