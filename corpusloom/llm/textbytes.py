"""Whole texts of an Arrow batch as one byte array, and hashes of their words by array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_rng = np.random.default_rng(20_240_229)
#: Random odd-free constants: a value for each byte, and the odd base of the polynomial.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of at most so many bytes together, or of one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def pieces(body: np.ndarray, apart: np.ndarray, most: int = 2 * BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of at most so many bytes that end before a byte that stands apart words, or are one longer word."""
    a, n = 0, len(body)
    while a < n:
        b = min(n, a + most)
        while b < n:
            stops = np.flatnonzero(apart[body[a + 1 : b]][::-1][:65536]) if b - a > 1 else ()
            if len(stops):
                b -= 1 + int(stops[0])
                break
            further = np.flatnonzero(apart[body[b : b + most]])
            b = b + int(further[0]) if len(further) else min(n, b + most)
            if len(further):
                break
        yield a, b
        a = b


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _powers[inverse]
    if len(have) < n:
        steps = np.full(max(n, 1 << 16), INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(steps)
        if len(have) > 4 * BLOCK_BYTES:  # made for one very long text: not kept
            _powers[inverse] = have[: 2 * BLOCK_BYTES].copy()
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(body: np.ndarray) -> np.ndarray:
    """h with h[b] - h[a] = sum of value(byte j) * BASE**j over a <= j < b."""
    h = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[body] * powers(len(body)), out=h[1:])
    return h


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal bytes wherever they lie."""
    return mixed((h[ends] - h[starts]) * powers(len(h), True)[starts])


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all): maximal runs of word bytes that cross no text border."""
    n = len(is_word)
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = is_word[inner]
    end[inner - 1] = is_word[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)
