"""Words of whole texts as 64-bit hashes, by numpy over the bytes of a batch.

A word is a maximal run of letters, digits and bytes of non-ASCII characters after
A-Z became a-z, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  All bytes of a
non-ASCII UTF-8 character count as word bytes, so working on bytes equals working
on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tendersift.llm.common import STEP_BYTES

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 0x30) & (_BYTE <= 0x39)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_LOWER = (_BYTE >= 0x61) & (_BYTE <= 0x7A)

#: 1 for bytes of a word, 0 for bytes between words.
WORD_CLASS = (_DIGIT | _UPPER | _LOWER | (_BYTE >= 0x80)).astype(np.uint8)
#: The same with 2 for printable punctuation, whose runs are tokens too.
TOKEN_CLASS = np.where(WORD_CLASS == 1, 1, np.where((_BYTE > 0x20) & (_BYTE < 0x7F), 2, 0)).astype(np.uint8)
#: A-Z to a-z.
FOLD = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _PRIME, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    column = column.cast(pa.large_string()).view(large) if pa.types.is_string(column.type) else column.cast(large)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Tokens:
    """Tokens of the rows first .. first+rows-1 of a batch; start and end are byte offsets in the batch."""

    first: int
    rows: int
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def per_row(self) -> np.ndarray:
        """Where the tokens of each row start, and at last their number."""
        return np.searchsorted(self.row, np.arange(self.first, self.first + self.rows + 1))


def _tokens_of(raw: np.ndarray, edges: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each token; edges are offsets that no token crosses."""
    kind = classes[raw]
    change = np.empty(len(raw) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[edges] = True
    cut = np.flatnonzero(change)
    runs, stops = cut[:-1], cut[1:]
    if not len(runs):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    place = np.arange(len(raw)) - np.repeat(runs, stops - runs)
    value = (FOLD[raw].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    sums = np.add.reduceat(value, runs)
    real = kind[runs] != 0
    return mix(sums[real]), runs[real], stops[real]


def tokens(column: pa.Array, classes: np.ndarray = WORD_CLASS, step: int = STEP_BYTES) -> Iterator[Tokens]:
    """Whole rows at a time, of about step bytes; a longer row is cut at non-word bytes while it is hashed."""
    raw, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        parts, lo, hi = [], int(at[i]), int(at[j])
        while lo < hi:
            mid = hi
            if hi - lo > 2 * step:
                mid = lo + step
                while mid < hi and classes[raw[mid]]:  # on to the end of this token
                    mid += 1
            inner = at[i + 1 : j]
            edges = inner[(inner > lo) & (inner < mid)] - lo
            h, s, e = _tokens_of(raw[lo:mid], edges, classes)
            parts.append((h, s + lo, e + lo))
            lo = mid
        if parts:
            h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            h, s, e = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        yield Tokens(i, j - i, h, np.searchsorted(at, s, "right") - 1, s, e)
        i = j


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width consecutive tokens."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _PRIME + hashes[k : k + n]
    return mix(out)
