"""Words of whole Arrow string columns as numpy arrays, without a Python loop over words.

Texts are taken as UTF-8 bytes. Every word class used here is decided by ASCII
bytes alone, so cutting bytes and cutting code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; a longer text is taken whole, by itself.
CHUNK_BYTES = 1 << 20


def byte_class(inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    """256 booleans: the bytes of ``inside``, or all but those of ``outside``."""
    table = np.zeros(256, bool) if inside is not None else np.ones(256, bool)
    table[list(inside if inside is not None else outside or b"")] = inside is not None
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_class(outside=b"\x20\x09\x0a\x0b\x0c\x0d")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, all beyond ASCII
WORD_CHARS = byte_class(inside=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _CODES[LOWER]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd multiplier modulo 2**64 and their inverses, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            inverse = pow(_MULTIPLIER, -1, 2**64)
            made = []
            for factor in (_MULTIPLIER, inverse):
                x = np.full(size, factor, np.uint64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            if size > 8 * CHUNK_BYTES:  # one giant text: don't keep its tables
                return made[0], made[1]
            self.up, self.down = made
        return self.up, self.down


_POWERS = _Powers()


class Words(NamedTuple):
    """Words of some rows: row i has words ``rows[i]`` to ``rows[i + 1]``; a word is ``data[start:end]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased unless told otherwise."""
        return span_hashes(self.data, self.start, self.end, lower)

    def suffix_hashes(self, n: int) -> np.ndarray:
        """Hashes of the last ``n`` bytes of each lower-cased word, or of all if it is shorter."""
        return span_hashes(self.data, np.maximum(self.start, self.end - n), self.end, True)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of byte spans by differences of one running polynomial sum."""
    up, down = _POWERS.upto(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_CODES if lower else _CODES)[data] * up[: len(data)], out=running[1:])
    return mix64((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The maximal runs of bytes of ``table`` within each row of ``data[offsets[i]:offsets[i + 1]]``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, rows: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and about ``limit`` bytes of one string column; a longer text is a slice by itself."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(length)
    low = 0
    while low < len(batch):
        before = int(upto[low - 1]) if low else 0
        high = min(low + rows, max(low + 1, int(np.searchsorted(upto, before + limit, "right"))))
        yield batch.slice(low, high - low)
        low = high


def chunks(column: pa.Array, table: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, one past the last, their words), about ``limit`` bytes at once."""
    data, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, split_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], table)
        low = high
