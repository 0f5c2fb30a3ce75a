"""Words, word hashes and shingle sets of whole texts, computed on Arrow buffers.

A batch of texts stays one UTF-8 buffer. Words are runs of bytes other than
0x09-0x0D and 0x20, which never occur inside a multi-byte character, so no text
is decoded or split into Python strings. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes looked at in one go; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = LENGTH_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _BASE)


_BYTE = stream(1, 256)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A"): ord("Z") + 1] = _BYTE[ord("a"): ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the 0, 1, ... n-1."""
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        found = np.cumprod(steps)
        if n > CHUNK_BYTES + 1:
            return found
        _powers[name] = found
    return _powers[name][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (n + 1 offsets). Null: no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~space[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = inside[1:-1][inner]
    ends[inner - 1] = inside[1:-1][inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def power_up(n: int) -> np.ndarray:
    return _power("up", _BASE, n)


def power_down(n: int) -> np.ndarray:
    return _power("down", _BASE_INVERSE, n)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def gathered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The spans of ``data``, one behind the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return data[np.repeat(stops - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``fold`` lower-cases A-Z."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * power_up(n), out=sums[1:])
        found = (sums[stops] - sums[starts]) * power_down(n + 1)[starts]
        return mix(found + (stops - starts).astype(np.uint64) * _STEP)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words of one text; of all words where it has fewer."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    with np.errstate(over="ignore"):
        total, factor = np.zeros(n - k + 1, dtype=np.uint64), _STEP
        for i in range(k):
            total = total + words[i: n - k + 1 + i] * factor
            factor = factor * _STEP
        return mix(total + np.uint64(k))


def word_hashes(texts: pa.Array, fold: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each text in the batch, and its word hashes in order."""
    data, offsets = buffers(texts)
    for first, last in chunks(offsets):
        part, at = data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        starts, stops, before = spans(part, at)
        found = span_hashes(part, starts, stops, fold)
        for i in range(last - first):
            yield first + i, found[before[i]: before[i + 1]]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each text, and its sorted distinct shingle hashes, A-Z lower-cased."""
    for i, words in word_hashes(texts, fold=True):
        yield i, np.unique(shingles(words, width))
