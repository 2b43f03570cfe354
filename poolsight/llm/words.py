"""Hashes of words and word shingles, computed on the bytes of a text with NumPy.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Its hash is the sum of a
random number per byte value times a power of its place, taken from running sums, then mixed. Two
different words agree with a chance of about 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about this many bytes, cut at white space.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _values() -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table[65:91] = table[97:123]
    return table


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


_VALUE, _SPACE = _values(), _spaces()


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return of(_BASE), of(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = _powers(1 << max(17, (n - 1).bit_length()))
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [n]))
    start, end = edge[0::2], edge[1::2]
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=run[1:])
    return mix((run[end] - run[start]) * inverse[start])


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text (its UTF-8 bytes as uint8), in order."""
    if len(data) <= PIECE:
        return _piece_hashes(data) if len(data) else np.zeros(0, np.uint64)
    parts, at = [], 0
    while at < len(data):
        to = at + PIECE
        while to < len(data):
            found = np.flatnonzero(_SPACE[data[to : to + PIECE]])
            if len(found):
                to += int(found[0])
                break
            to += PIECE
        parts.append(_piece_hashes(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, none gives an empty set."""
    words = word_hashes(data)
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        total = mix(total * np.uint64(_BASE) + words[i : len(words) - width + 1 + i])
    return np.unique(total)


def byte_arrays(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each text of an Arrow column, without copies; null counts as empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    store = column.buffers()[2]
    data = np.frombuffer(store, np.uint8) if store is not None else np.zeros(0, np.uint8)
    filled = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if ok else data[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], filled)]
