"""Hashes in numpy: polynomial prefix hashes of bytes, and hashes of words and shingles.

``prefix[i]`` is the sum of ``TABLE[byte] * BASE**position`` before ``i``, in
64-bit arithmetic; the hash of any substring is then one subtraction and one
product with an inverse power.  Such hashes collide for strings that are built
for it, whatever the base, so whoever uses them compares bytes as well.  Words
are hashed eight bytes at a time by a mixing that isn't linear in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tidemark.llm._common import forget

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the odd base of the polynomial.
TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Words are split at the space and at bytes 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True

#: Bytes with A-Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER = _LOWER.tobytes()
#: The lowest k bytes of a number; a key; bytes of a text whose words are hashed together; words from this size on are hashed by a library.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_KEY = _RNG.integers(0, 1 << 64, 2, dtype=np.uint64)
_BLOCK, _LONG_WORD = 1 << 20, 2048

_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i below ``n``."""
    global _POWERS
    if len(_POWERS[0]) < n:
        made = []
        for base in (BASE, INVERSE):
            row = np.full(max(n, 1 << 16), base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _POWERS = tuple(made)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """One more entry than ``data`` has bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over the whole."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def text_chunks(texts: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    forget()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each of some strings of ``data``, with A-Z in lower case; those of up to eight bytes and one size never collide."""
    lower = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", lower, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * _KEY[0] + _KEY[1])
    at, place, left = np.flatnonzero(size <= _LONG_WORD), starts, size
    if len(at) < len(starts):
        for i in np.flatnonzero(size > _LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(lower[starts[i] : ends[i]].tobytes(), int(_KEY[0]))
        place, left = starts[at], size[at]
    while len(at):
        out[at] = mix((out[at] ^ (eights[place] & _LOWEST[np.minimum(left, 8)])) + _KEY[1])
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    return out


def _some_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and where each text's begin."""
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[edge] = inside[edge]  # a word also begins where a text does
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    stops[before] = inside[before]
    return word_hashes(data, starts, np.flatnonzero(stops) + 1), np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts, the texts they are in, and where each text's words begin (one more entry than texts).

    A long text's words are hashed about ``_BLOCK`` bytes at a time.
    """
    if len(offsets) == 2 and len(data) > 2 * _BLOCK:
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + _BLOCK)
            while end < len(data) and not IS_SPACE[data[end]]:  # to the end of the word there
                gaps = np.flatnonzero(IS_SPACE[data[end : end + 4096]])
                end = end + int(gaps[0]) if len(gaps) else min(len(data), end + 4096)
            parts.append(_some_words(data[at:end], np.array([0, end - at]))[0])
            at = end
        hashes = np.concatenate(parts)
        bounds = np.array([0, len(hashes)])
    else:
        hashes, bounds = _some_words(data, offsets)
    return hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of some texts, and where each text's begin.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], n) + np.repeat(bounds[:-1], n)
    size = np.repeat(np.minimum(counts, k), n)
    out = size.astype(np.uint64)
    for j in range(k):
        there = size > j
        out[there] = mix(out[there] * np.uint64(BASE) + hashes[at[there] + j])
    return out, begins
