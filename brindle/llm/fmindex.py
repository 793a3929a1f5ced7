"""A compressed FM-index over integer symbols, with numpy."""

from __future__ import annotations

import numpy as np

_ONE, _SIX, _LOW = np.uint64(1), np.uint64(6), np.uint64(63)


class BitRank:
    """A bit vector, packed, that counts the ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        small = np.packbits(bits, bitorder="little")
        packed[: len(small)] = small
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (_ONE << (at.astype(np.uint64) & _LOW)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    """A wavelet tree, its levels stored one after the other: how often a symbol stands before a place."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[BitRank, int]] = []
        now = symbols
        for k in range(self.depth - 1, -1, -1):
            bits = (now >> k & 1).astype(bool)
            self.levels.append((BitRank(bits), int((~bits).sum())))
            now = np.concatenate([now[~bits], now[bits]])
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.ones(at)
            at = np.where(symbols >> k & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.start[symbols]


class FMIndex:
    """Finds patterns of up to ``order`` symbols in a text of symbols 0 .. sigma - 1.

    Suffixes are sorted by their first ``order`` symbols, which is all that patterns of that length see. Symbol 0 is
    the separator, which no pattern has; the text must end with it.
    """

    def __init__(self, text: np.ndarray, sigma: int, order: int = 4) -> None:
        rank, width = text.astype(np.int64), 1
        while width < order:
            step = min(width, order - width)
            shifted = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            _, rank = np.unique(rank * (int(rank.max()) + 1) + shifted, return_inverse=True)
            width += step
        self.suffixes = np.argsort(rank, kind="stable")
        sorted_rank = rank[self.suffixes]
        self.classes = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(text[self.suffixes - 1].astype(np.int64), sigma)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: for each row of symbols the range of suffixes that begin with it."""
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, k]
            low = self.first[c] + self.wavelet.rank(c, low)
            high = self.first[c] + self.wavelet.rank(c, high)
        return low, high

    def least(self, keys: np.ndarray) -> np.ndarray:
        """For each suffix the least key (one per text place) among the suffixes with the same first symbols."""
        sizes = np.diff(np.append(self.classes, len(keys)))
        return np.repeat(np.minimum.reduceat(keys[self.suffixes], self.classes), sizes)
