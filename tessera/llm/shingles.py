"""Word shingles of whole texts, by numpy over Arrow buffers.

Words are maximal runs without blanks (bytes 0x20, 0x09 to 0x0D), A-Z lower-cased.  A text's set holds the 64-bit hashes of
its distinct five-word shingles; with fewer words, one hash of the whole sequence; without words it is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_PIECE = 1 << 21  # bytes hashed at once


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_VALUE = mix64(_LOWER + np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS = np.cumprod(np.full(_PIECE + 1, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
_INVERSES = np.cumprod(np.full(_PIECE + 1, pow(_BASE, -1, 1 << 64), np.uint64)) * np.uint64(_BASE)
_PLACES = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= _PIECE:
        return _POWERS[: n + 1], _INVERSES[: n + 1]
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    return np.cumprod(np.full(n + 1, _BASE, np.uint64)) * inverse, np.cumprod(np.full(n + 1, inverse, np.uint64)) * np.uint64(_BASE)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the bytes: sums of byte values times powers of a base, from the word's start."""
    blank = np.ones(len(data) + 2, bool)
    np.equal(data, 32, out=blank[1:-1])
    blank[1:-1] |= data - np.uint8(9) < 5
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE.take(data) * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_hashes` of a long text, a bounded piece at a time, cut at blanks."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        if end < len(data):
            blanks = np.flatnonzero(_SEPARATOR[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                after = np.flatnonzero(_SEPARATOR[data[end:]])
                end = end + int(after[0]) + 1 if len(after) else len(data)
        hashes, starts, ends = word_hashes(data[at:end])
        parts.append((hashes, starts + at, ends + at))
        at = end
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes."""
    k = len(words)
    if not k:
        return words
    if k < WORDS:
        return mix64(np.array([(words * _PLACES[:k]).sum() + np.uint64(k)], np.uint64))
    sums = words[: k - WORDS + 1] * _PLACES[0]
    for j in range(1, WORDS):
        sums = sums + words[j : k - WORDS + 1 + j] * _PLACES[j]
    out = np.sort(mix64(sums))
    return out[np.r_[True, out[1:] != out[:-1]]]


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow string array (null: empty); texts are hashed many at a time."""
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, values = texts.buffers()
    at = np.frombuffer(bounds, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _PIECE // 2)) - 1)
        last = min(last, len(texts))
        if at[last] - at[first] > _PIECE // 2 or last == first + 1:
            for i in range(first, last):
                yield shingle_set(words_of(data[at[i] : at[i + 1]])[0]) if valid[i] else np.zeros(0, np.uint64)
        else:
            # a blank after each text keeps words apart
            sizes = np.diff(at[first : last + 1])
            joined = np.full(int(sizes.sum()) + last - first, 32, np.uint8)
            begin = at[first:last] - at[first] + np.arange(last - first)
            place = np.ones(len(joined), bool)
            place[begin + sizes] = False
            joined[place] = data[at[first] : at[last]]
            words, starts, _ = word_hashes(joined)
            cut = np.searchsorted(starts, np.r_[begin, len(joined)])
            for i in range(last - first):
                yield shingle_set(words[cut[i] : cut[i + 1]]) if valid[first + i] else np.zeros(0, np.uint64)
        first = last
