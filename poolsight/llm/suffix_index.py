"""A bidirectional FM-index over a set of distinct words, and searches with one error in it.

The text is every word with a delimiter in front, read as a circle, so that each word has a delimiter
on both sides. Its suffixes are sorted once forwards and once backwards. A pattern is an interval of
suffix ranks in both orders at once (`low`, `mirror`, `size`); it can be extended by a symbol on
either side. All states of a search step are NumPy arrays, so one call extends many patterns.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

DELIMITER = 0
#: Words searched at once, and the most symbols they may have together.
SEARCH_WORDS, SEARCH_SYMBOLS = 8192, 1 << 20


def suffix_order(codes: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of the rotations of a circular text without period, in sorted order."""
    n = len(codes)
    step = max(1, 56 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) | np.roll(codes, -k)
    while True:
        order = np.argsort(key, kind="stable")
        change = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(change)))
        if change.all():
            return order
        key = rank * n + np.roll(rank, -step)
        step *= 2


class Ranks:
    """Symbols before each suffix as a wavelet matrix: counts of a symbol, and of smaller ones, in any range."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        first = np.searchsorted(np.sort(symbols), np.arange(1 << bits))
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - bit))).astype(np.int32))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        start = self._descend(np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), np.arange(1 << bits))[0]
        #: From a place in the last level to the rank of the longer suffix.
        self.shift = first - start

    def _descend(self, a: np.ndarray, b: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(a), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            za, zb = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            less += np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        return a, b, less

    def extend(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, size, smaller symbols in the range) after `symbol` is put in front."""
        a, b, less = self._descend(low, low + size, symbol)
        return a + self.shift[symbol], b - a, less

    def branch(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, symbol, low, size, smaller symbols) for every symbol that occurs in a row's range."""
        row, symbol, less = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        a, b = low, low + size
        for zeros in self.zeros:
            za, zb = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            left, right = zb > za, b - a > zb - za
            row = np.concatenate((row[left], row[right]))
            symbol = np.concatenate((symbol[left] * 2, symbol[right] * 2 + 1))
            less = np.concatenate((less[left], (less + zb - za)[right]))
            a, b = (
                np.concatenate((za[left], (zeros[-1] + a - za)[right])),
                np.concatenate((zb[left], (zeros[-1] + b - zb)[right])),
            )
        return row, symbol, a + self.shift[symbol], b - a, less


class States(NamedTuple):
    """Patterns by the word that is searched for (`word`) and their intervals of suffix ranks."""

    word: np.ndarray
    low: np.ndarray
    mirror: np.ndarray
    size: np.ndarray

    def take(self, rows: np.ndarray) -> States:
        return States(*(x[rows] for x in self))


def _join(parts: list[States]) -> States:
    return States(*(np.concatenate(x) for x in zip(*parts)))


class WordIndex:
    """Index over `words`, which are distinct and not empty."""

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.alphabet = np.unique(np.concatenate(points))
        bits = max(1, int(len(self.alphabet)).bit_length())
        lengths = np.array([len(p) for p in points])
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        place = np.ones(len(text), bool)
        place[starts] = False
        text[place] = np.searchsorted(self.alphabet, np.concatenate(points)) + 1
        order = suffix_order(text, bits)
        self.before = Ranks(np.roll(text, 1)[order], bits)
        #: The word behind each delimiter, by rank: suffixes that start with one come first.
        self.word_at = np.searchsorted(starts, order[: len(words)])
        flipped = text[::-1].copy()
        self.after = Ranks(np.roll(flipped, 1)[suffix_order(flipped, bits)], bits)
        self.n = len(text)

    def codes(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length, -1 for those that the index does not have."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)

    def _extend(self, s: States, symbol: np.ndarray, right: bool) -> States:
        s, symbol = s.take(symbol >= 0), symbol[symbol >= 0]
        if right:
            mirror, size, less = self.after.extend(s.mirror, s.size, symbol)
            s = States(s.word, s.low + less, mirror, size)
        else:
            low, size, less = self.before.extend(s.low, s.size, symbol)
            s = States(s.word, low, s.mirror + less, size)
        return s.take(s.size > 0)

    def _branch(self, s: States, right: bool) -> tuple[States, np.ndarray]:
        if right:
            row, symbol, mirror, size, less = self.after.branch(s.mirror, s.size)
            return States(s.word[row], s.low[row] + less, mirror, size), symbol
        row, symbol, low, size, less = self.before.branch(s.low, s.size)
        return States(s.word[row], low, s.mirror[row] + less, size), symbol

    def one_error(self, words: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(position in `words`, indexed word) for words of one length and indexed words one error away.

        With `right`, the first half must match exactly and the error lies behind it; otherwise the second
        half must match and the error lies before it. A pair is returned once.
        """
        pattern = self.codes(words)
        length = pattern.shape[1]
        exact = length // 2 if right else length - length // 2
        if not right:
            pattern = pattern[:, ::-1]
        count = len(words)
        zero = np.zeros(count, np.int64)
        clean = States(np.arange(count), zero, zero, np.full(count, self.n))
        clean = self._extend(clean, zero + DELIMITER, right)
        for p in range(exact):
            clean = self._extend(clean, pattern[clean.word, p], right)
        wrong = clean.take(np.zeros(0, np.int64))
        for p in range(exact, length + 1):
            grown, symbol = self._branch(clean, right)
            letter = symbol != DELIMITER
            grown, symbol = grown.take(letter), symbol[letter]
            wrong = _join([wrong, grown])  # one symbol too many before p
            if p == length:
                break
            same = symbol == pattern[grown.word, p]
            wrong = _join([
                self._extend(wrong, pattern[wrong.word, p], right),
                grown.take(~same),  # another symbol at p
                clean,  # no symbol at p
            ])
            clean = grown.take(same)
        done = self._extend(wrong, np.full(len(wrong.word), DELIMITER), right)
        pairs = np.unique(done.word * len(self.word_at) + self.word_at[done.low])
        return pairs // len(self.word_at), pairs % len(self.word_at)


def near_pairs(index: WordIndex, words: list[str], right: bool):
    """(positions in `words`, indexed words) in bounded pieces; words of any length."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if not len(group):
            continue
        most = max(1, min(SEARCH_WORDS, SEARCH_SYMBOLS // max(int(lengths[group[0]]), 1)))
        for at in range(0, len(group), most):
            part = group[at : at + most]
            mine, found = index.one_error([words[i] for i in part], right)
            yield part[mine], found
