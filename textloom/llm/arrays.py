"""Vectorised text primitives on Arrow string columns (numpy only, whole texts, no per-word Python).

A word is a maximal run of ASCII letters and digits and of characters beyond ASCII.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def _is_word_byte() -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        lut[a:b] = True
    return lut


WORD_BYTE = _is_word_byte()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs in every process."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a newline, and the offset at which each begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def row_slices(column: pa.Array, size: int = PIECE):
    """(first row, rows) of consecutive slices of about ``size`` bytes of text, a row at least."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(length)
    at = 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + size, side="right")))
        yield at, to - at
        at = to


def pieces(buf: np.ndarray, size: int = PIECE):
    """Consecutive (from, to) ranges of about ``size`` bytes that cut no word."""
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + size)
        while to < n and WORD_BYTE[buf[to]] and WORD_BYTE[buf[to - 1]]:
            step = np.flatnonzero(~WORD_BYTE[buf[to : to + 4096]])
            to = to + int(step[0]) if len(step) else min(n, to + 4096)
        yield at, to
        at = to


def spans(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a piece."""
    flags = np.empty(len(piece) + 2, dtype=np.int8)
    flags[0] = flags[-1] = 0
    flags[1:-1] = WORD_BYTE[piece]
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    return edge[::2], edge[1::2]


class Hasher:
    """Polynomial hashes of byte ranges by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << int(n - 1).bit_length()
            ones = np.ones(n, np.uint64)
            ones[1:] = _MUL
            self.power = np.cumprod(ones)
            ones[1:] = _INV
            self.inverse = np.cumprod(ones)

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.power[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])


def word_hashes(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and the word at which each text begins (one entry more than texts)."""
    buf, offsets = text_bytes(column)
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in pieces(buf):
        s, e = spans(buf[a:b])
        if len(s):
            hashes.append(hasher.ranges(buf[a:b], s, e))
            begins.append(s + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
