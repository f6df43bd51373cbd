"""FM-index over the words of a few documents, in numpy.

Texts are sequences of word numbers, each ended by a separator.  The suffix order comes from
prefix doubling that sorts only what is still tied; separators are told apart by their place, so
a tie ends with its text.  A wavelet matrix over the Burrows-Wheeler transform answers rank and
access in one step for each bit of a word number, for many positions at once.  Suffix positions
are sampled at every text's start and every few words after it, so a walk back never leaves
its text.
"""

from __future__ import annotations

import numpy as np


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Suffix array of symbols whose ranks are given; the last symbol and all separators are unique."""
    n = len(rank)
    follow = np.append(rank[1:], 0)
    key = rank.astype(np.int64) << 32 | follow
    order = np.argsort(key, kind="stable")
    slots = np.arange(n)
    head, key = np.empty(n, np.int64), key[order]
    width, tied = 2, slots
    while True:
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        starts = np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))
        head[order[tied]] = tied[starts]
        alone = fresh & np.append(fresh[1:], True)
        tied = tied[~alone]
        if not len(tied):
            return order
        suffixes = order[tied]
        key = head[suffixes] << 32 | head[np.minimum(suffixes + width, n - 1)]
        by_key = np.argsort(key, kind="stable")
        order[tied], key = suffixes[by_key], key[by_key]
        width *= 2


class WaveletMatrix:
    """Rank and access on a sequence of numbers, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bits = max(int(top).bit_length(), 1)
        n = len(values)
        padded = (n // 64 + 1) * 64
        for level in reversed(range(self.bits)):
            bit = (values >> level & 1).astype(bool)
            packed = np.zeros(padded, bool)
            packed[:n] = bit
            words = np.packbits(packed, bitorder="little").view("<u8")
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, n - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])
        # where the run of each number starts after the last level
        self.run = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & low)

    def _down(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, before, zeros) in zip(reversed(range(self.bits)), self.levels):
            ones = self._ones(words, before, at)
            at = np.where(numbers >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number occurs before its position."""
        return self._down(numbers, at) - self.run[numbers]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each position and how often it occurs before."""
        numbers = np.zeros(len(at), np.int64)
        for words, before, zeros in self.levels:
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(words, before, at)
            at = np.where(bit, zeros + ones, at - ones)
            numbers = numbers << 1 | bit
        return numbers, at - self.run[numbers]


class FMIndex:
    """Index over texts of word numbers from 1 to top."""

    def __init__(self, texts: list[np.ndarray], top: int, sample: int = 16):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        n, d = int((lengths + 1).sum()), len(texts)
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts + lengths] = False
        symbols[inside] = np.concatenate(texts) if texts else symbols[:0]
        rank = symbols + (d - 1)
        rank[~inside] = np.arange(d)
        order = suffix_order(rank)
        counts = np.bincount(symbols[inside], minlength=top + 1)
        #: first row of the suffixes that start with each word number
        self.first = d + np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(symbols[order - 1], top)  # before position 0 comes a separator
        offset = np.arange(n) - np.repeat(self.starts, lengths + 1)
        self.marked = (offset % sample == 0)[order]
        self.sampled, self.sample_rank = order[self.marked], np.cumsum(self.marked) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase (phrases: one a row, all of one length), from its end backwards."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        alive = np.flatnonzero(low < high)
        for column in range(phrases.shape[1] - 2, -1, -1):
            word = phrases[alive, column]
            low[alive] = self.first[word] + self.wavelet.rank(word, low[alive])
            high[alive] = self.first[word] + self.wavelet.rank(word, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        found, at, waiting, steps = np.zeros(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(waiting):
            here = self.marked[at]
            found[waiting[here]] = self.sampled[self.sample_rank[at[here]]] + steps
            waiting, at = waiting[~here], at[~here]
            if len(waiting):
                words, before = self.wavelet.access(at)
                at = self.first[words] + before
            steps += 1
        return found
