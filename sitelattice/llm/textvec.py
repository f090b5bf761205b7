"""Vectorised text primitives over Arrow string columns.

Python operators of this subpackage read whole texts through ``mapInArrow``.
The bytes of a batch arrive as one contiguous buffer, so words, shingles and
character n-grams of thousands of documents are found and hashed by a handful
of numpy passes instead of a Python loop for each document.

Words are the maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``;
only ``A-Z`` are lower-cased.  A null text counts as an empty one.  Nothing is
ever cut: a batch is processed in slices of a few MB, but always at document
boundaries, so a very long document simply makes its own slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_WHITE = (0x20, *range(0x09, 0x0E))
_FOLD = bytes(0x20 if i in _WHITE else i for i in range(256))
_FOLD_LOWER = bytes(i + 32 if 65 <= i <= 90 else _FOLD[i] for i in range(256))
_PUNCTUATION = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another one for each seed."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive row ranges of about ``most`` text bytes, a longer document alone."""
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    start, total = 0, 0
    cut = np.cumsum(size)
    while start < len(size):
        stop = int(np.searchsorted(cut, total + most, "right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start, total = stop, int(cut[stop - 1])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and where each row starts (n + 1 offsets)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """The words of consecutive documents: byte range, document and first word of each document."""

    data: np.ndarray  # folded bytes: each white space is a blank
    padded: bytes  # the same with eight blanks after them
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @cached_property
    def first(self) -> np.ndarray:
        """Index of each document's first word, n + 1 values."""
        return np.searchsorted(self.start, self.at)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    @cached_property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, which are read eight at a time."""
        eight = np.ndarray((len(self.data) + 1,), "<u8", self.padded, 0, (1,))
        size = self.end - self.start
        value = mix(eight[self.start] & _LOW_BYTES[np.minimum(size, 8)])
        longer, k = np.flatnonzero(size > 8), 8
        while len(longer):
            part = eight[self.start[longer] + k] & _LOW_BYTES[np.minimum(size[longer] - k, 8)]
            value[longer] = mix(value[longer] * np.uint64(0x9E3779B97F4A7C15) + part, k)
            k += 8
            longer = longer[size[longer] > k]
        return value

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of n words that lies in one document."""
        if len(self.start) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        value = self.hash[: len(self.hash) - n + 1]
        for i in range(1, n):
            value = mix(value * np.uint64(0xA0761D6478BD642F) + self.hash[i : len(self.hash) - n + 1 + i], i)
        inside = np.flatnonzero(self.doc[: len(value)] == self.doc[n - 1 :])
        return value[inside], inside

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def fold_bytes(data: np.ndarray, lower: bool = True) -> bytes:
    """The bytes with each white space turned into a blank and, if asked, ``A-Z`` lower-cased."""
    return data.tobytes().translate(_FOLD_LOWER if lower else _FOLD)


def words(column: pa.Array, lower: bool = True) -> Words:
    return split(*text_buffer(column), lower)


def split(data: np.ndarray, at: np.ndarray, lower: bool = True) -> Words:
    padded = fold_bytes(data, lower) + b" " * 8
    data = np.frombuffer(padded, np.uint8, len(data))
    filled = data != 0x20
    begins, ends = filled.copy(), filled.copy()
    begins[1:] &= ~filled[:-1]
    ends[:-1] &= ~filled[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = filled[edge]
    ends[edge - 1] = filled[edge - 1]
    return Words(data, padded, at, np.flatnonzero(begins), np.flatnonzero(ends) + 1)


def plain_words(column: pa.Array) -> Words:
    """Words without their ASCII punctuation; those made of nothing else vanish."""
    data, at = text_buffer(column)
    gone = np.flatnonzero(_PUNCTUATION[data])
    kept = data.tobytes().translate(None, _PUNCTUATION.nonzero()[0].astype(np.uint8).tobytes())
    return split(np.frombuffer(kept, np.uint8), at - np.searchsorted(gone, at))


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 text, each white space a blank, ``A-Z`` lower-cased; where each document's begin."""
    data = np.frombuffer(fold_bytes(data), np.uint8)
    if not len(data) or data.max() < 0x80:
        return data, at
    start = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[start]
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
    value = (lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint8)[size]).astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        value[longer] = value[longer] << np.uint32(6) | data[np.minimum(start[longer] + k, len(data) - 1)] & np.uint8(0x3F)
    return value, np.searchsorted(start, at)


def char_grams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of every run of n bytes, or characters, that lies in one document; where each document's runs start."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(data) < n or not first[-1]:
        return np.zeros(0, np.uint32), first
    value = data[: len(data) - n + 1].astype(np.uint32)
    for i in range(1, n):
        value = value * np.uint32(0x01000193) + data[i : len(data) - n + 1 + i]
    value *= np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA6B)
    value ^= value >> np.uint32(13)
    if first[-1] == len(value):
        return value, first
    inside = np.ones(len(value), bool)
    for edge in at[1:-1]:
        inside[max(edge - n + 1, 0) : edge] = False
    return value[inside], first
