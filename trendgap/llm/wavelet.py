"""A wavelet matrix in numpy: how often a class occurs before any place of a sequence."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with the number of ones before every word of 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, rest = places >> 6, (places & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)


class WaveletMatrix:
    """Values below 2^levels. Level by level, from the highest bit, the sequence is parted
    stably into those with the bit unset and those with it set."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.size, self.levels = len(values), []
        for level in reversed(range(levels)):
            bit = (values >> level) & 1
            self.levels.append((level, Bits(bit), self.size - int(np.count_nonzero(bit))))
            one = bit.astype(bool)
            values = np.concatenate((values[~one], values[one]))

    def rank(self, value: int, places: np.ndarray) -> np.ndarray:
        """Occurrences of `value` before each place."""
        at = np.append(np.asarray(places, np.int64), 0)  # the last one: where its class begins
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = zeros + ones if value >> level & 1 else at - ones
        return at[:-1] - at[-1]

    def count(self, values: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """Occurrences of any of the values before each place."""
        return sum((self.rank(v, places) for v in values), np.zeros(len(places), np.int64))

    def first(self, values: tuple[int, ...], low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The smallest place of low..high before which there are `wanted` occurrences of
        any of the values, counted from the beginning; `high` where there are fewer. A
        bisection on ranks, for all places at once."""
        low, high = low.copy(), high.copy()
        while np.any(low < high):
            middle = (low + high) >> 1
            enough = self.count(values, middle) >= wanted
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low
