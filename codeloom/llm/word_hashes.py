"""Words of Arrow text batches as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered. Its hash is the sum,
modulo 2**64, of a fixed random value of each byte times a fixed random odd factor of its place in
the word, taken as the difference of two prefix sums and then mixed. The factors follow no power
law, so no pattern of letters cancels out by its form, as mirrored words do in a polynomial modulo a
power of two. Equal words have equal hashes everywhere; a sum of random terms that loses the low
bits common to all byte differences makes two different words share one with a chance near 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at a time; a longer document is a piece of its own.
PIECE_BYTES = 2_000_000
#: Bytes hashed at a time within a piece, as that takes eight-byte arrays of a value per byte.
HASH_BYTES = 250_000

def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_factors = np.zeros(0, np.uint64)


def _place_factors(n: int) -> np.ndarray:
    """Odd factors of the first ``n`` places at least."""
    global _factors
    if len(_factors) < n:
        places = np.arange(1, max(HASH_BYTES, n) + 1, dtype=np.uint64)
        _factors = mix(places * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _factors


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each text (one more than texts) and the bytes; null is empty."""
    if pa.types.is_null(column.type):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bounds, raw


def pieces(bounds: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` bytes together, or one row."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def hash_words(bounds: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more than texts)."""
    low, high = int(bounds[0]), int(bounds[-1])
    data, n = raw[low:high], high - low
    starts_at = bounds - low
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    in_word = ~_SPACE[data]
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1]
    edge = starts_at[(starts_at > 0) & (starts_at < n)]
    begins[edge] |= in_word[edge]
    ends = in_word.copy()
    ends[:-1] &= ~in_word[1:] | begins[1:]
    begin = np.flatnonzero(begins)
    end = np.flatnonzero(ends)
    place = np.arange(n)
    place -= np.maximum.accumulate(np.where(begins, place, 0))
    factors = _place_factors(n)
    running = _VALUES[data]
    running *= factors[place]
    np.cumsum(running, out=running)
    sums = running[end] - running[begin] + _VALUES[data[begin]] * factors[0]
    sums += (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(sums), np.searchsorted(begin, starts_at)


def hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row and the end) for pieces of a batch."""
    bounds, raw = text_buffers(column)
    for first, last in pieces(bounds):
        found, starts, n = [], [np.zeros(1, np.int64)], 0
        own = bounds[first : last + 1]
        for low, high in pieces(own, HASH_BYTES):
            words, begins = hash_words(own[low : high + 1], raw)
            found.append(words)
            starts.append(begins[1:] + n)
            n += len(words)
        yield first, last, np.concatenate(found), np.concatenate(starts)
