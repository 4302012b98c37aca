"""Words of whole texts as numpy arrays, taken straight from Arrow's UTF-8 buffers.

A word is a run of ASCII letters and digits and of any characters beyond ASCII; A-Z count as a-z.
Every byte of a character beyond ASCII is 0x80 or more, so runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of text that are turned into arrays at once; a longer text is taken alone.
CHUNK = 1 << 21
#: The same where many arrays over the characters or words of a chunk are held at a time, some of 8 bytes each.
PART = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(LOWER.astype(np.uint64) + np.uint64(1))


class Words(NamedTuple):
    """Words of some rows: hash, row within the chunk, first and last byte (exclusive) within raw."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray

    def text(self, first: int, last: int) -> list[bytes]:
        """The lower-cased words first..last (exclusive)."""
        return [LOWER[self.raw[a:b]].tobytes() for a, b in zip(self.start[first:last], self.end[first:last], strict=True)]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as ''."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `size` bytes together; every row is in one."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _ODD, np.uint64)]))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of the rows that offsets delimits."""
    raw, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = IS_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    heads, tails = at[:-1][full], at[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), start, end, raw)
    length = end - start
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    value = _VALUE[raw[inside]] * _powers(int(length.max()))[place]
    return Words(mix(np.add.reduceat(value, begin)), np.searchsorted(at, start, side="right") - 1, start, end, raw)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, whatever rows they lie in (see `whole`)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _ODD + hashes[k : k + m]
    return mix(out)


def whole(rows: np.ndarray, n: int) -> np.ndarray:
    """True for each n consecutive words that lie in one row."""
    m = len(rows) - n + 1
    return rows[:m] == rows[n - 1 :] if m > 0 else np.zeros(0, bool)
