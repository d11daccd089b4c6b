"""Words and word n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

All functions run inside tasks. A text is cut into words on single bytes, so
every byte of a multi-byte character has to be a word byte or none of them.
Upper-case A-Z hashes like a-z. Hashes have 64 bits; two of the distinct words
or n-grams that are compared with each other collide with odds of about one in
10**10 for ten thousand million comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about this many bytes, which bounds the arrays.
SLICE_BYTES = 1 << 20

# White space of ``[^\x20\x09-\x0D]+``.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False

# ASCII letters and digits and everything beyond ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[48:58] = ALNUM_WORD[65:91] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_GRAM_BASE = 0xD6E8FEB86659FD93
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of a slice: byte positions, hashes; text d has words bounds[d] to bounds[d + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(
    batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most_bytes`` of text: rows, text bytes, row offsets. NULL is empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        full = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(first + 1, full), len(texts))
        yield (
            batch.slice(first, last - first),
            data[offsets[first] : offsets[last]],
            offsets[first : last + 1] - offsets[first],
        )
        first = last


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE, np.uint64)])


def find_words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> Words:
    """Maximal runs of word bytes; a run ends where its text ends."""
    inside = word_byte[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first] = inside[first]
    stop[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _powers[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _inverses[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def ngrams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their bounds by text.

    A text with fewer words, but not none, has all its words as its one n-gram.
    """
    count = np.diff(words.bounds)
    of_text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(of_text))
    rest = words.bounds[1:][of_text] - at
    keep = (rest >= size) | (at == words.bounds[:-1][of_text])
    at, length = at[keep], np.minimum(rest[keep], size)
    total = length.astype(np.uint64)
    padded = np.r_[words.hashes, np.zeros(size, np.uint64)]
    factor = 1
    for k in range(size):
        factor = factor * _GRAM_BASE & (1 << 64) - 1
        total += np.where(k < length, padded[at + k] * np.uint64(factor), np.uint64(0))
    per_text = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    return mixed(total), np.r_[0, np.cumsum(per_text)]
