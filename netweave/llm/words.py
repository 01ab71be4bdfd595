"""Hashes of the words of many texts at once, on the bytes of an Arrow string column."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text stands alone.
CHUNK_BYTES = 1 << 20

def tidy() -> None:
    """Give freed memory back to the machine: a Python worker outlives its task, and what it holds is an executor's."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def tidied(run: Callable) -> Callable:
    """A function on batches that tidies up when it is through."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


_B = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_B_INV = pow(_B, -1, 1 << 64)
_MASK = (1 << 64) - 1

#: 0 for separators; letters and digits by value, capitals as small letters; bytes of other scripts as they are.
_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = np.arange(128, 256)
for _c in range(128):
    if chr(_c).isalnum():
        _CLASS[_c] = ord(chr(_c).lower())

_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        _powers[:] = []
        for base in (_B, _B_INV):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def running_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums to hash any run of ``values`` by: ``(sums[end] - sums[begin]) * scale[begin]`` depends on the run alone.

    One array is all that is made, whatever the steps.
    """
    power, scale = power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    part = sums[1:]
    part[:] = values
    part *= power[: len(values)]
    np.cumsum(part, out=part)
    return sums, scale


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets (from 0) of runs of rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null row may span bytes
        gone = np.asarray(texts.is_null())
        lengths = np.where(gone, 0, np.diff(offsets))
        if lengths.sum() != offsets[-1] - offsets[0]:
            yield from text_chunks(texts.fill_null("" if not pa.types.is_binary(texts.type) else b""), chunk_bytes)
            return
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1)
        stop = min(stop, n)
        yield at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one more than texts).

    A word is a run of letters and digits; case of ASCII letters doesn't count.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    cls = _CLASS[data]
    is_word = cls > 0
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = is_word[first]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    last = first[1:] - 1
    ends[last] = is_word[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends)
    total, inverse = running_hash(cls)
    hashes = mix((total[end + 1] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the text each belongs to; a shorter text with words has one, of all its words."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(bounds)
    rows = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), rows)
    at = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows) + bounds[:-1][owner]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    end = bounds[1:][owner]
    short = count[owner] < width
    for k in range(width):
        part = padded[at + k] * np.uint64(pow(_B, 2 * k + 3, 1 << 64))
        if short.any():
            part[short & (at + k >= end)] = 0
        out += part
    return mix(out), owner
