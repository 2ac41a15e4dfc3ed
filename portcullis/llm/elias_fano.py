"""Elias-Fano sequences in numpy: non-decreasing integers, with access and successor search for many at a time."""

from __future__ import annotations

import numpy as np


def _select(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place of each word's nth set bit."""
    place = np.zeros(len(words), np.uint64)
    nth = nth.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words >> place & np.uint64((1 << width) - 1)).astype(np.int64)
        on = nth >= below
        nth = nth - below * on
        place += np.where(on, np.uint64(width), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """The low bits as they are (in whole bytes), the high bits in unary, with counts for each word."""

    def __init__(self, arrays: dict[str, np.ndarray], low_bits: int):
        self.low, self.high, self.before = arrays["low"], arrays["high"], arrays["before"]
        self.low_bits = np.uint64(low_bits)
        self.n = len(self.low)

    @classmethod
    def arrays(cls, values: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
        n = len(values)
        top = int(values[-1]) if n else 0
        ideal = max(0, (top // max(n, 1)).bit_length() - 1)
        width = next(w for w in (1, 2, 4, 8) if ideal <= 8 * w)
        bits = min(ideal, 8 * width)
        values = values.astype(np.uint64)
        low = (values & np.uint64((1 << bits) - 1)).astype(f"<u{width}")
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-((int(place[-1]) if n else 0) + 2) // 64) * 64
        unary = np.zeros(size, np.uint8)
        unary[place] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.cumsum(np.bitwise_count(high).astype(np.int64))
        before = np.concatenate([[0], ones]).astype("<u4" if n < 1 << 32 else "<u8")
        return {"low": low, "high": high, "before": before}, bits

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at the places."""
        return self._value(at, self._place_of_one(at))

    def access_two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places and at the places after them."""
        place = self._place_of_one(at)
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        rest = self.high[word] >> bit >> np.uint64(1)
        step = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        after = place + 1 + step
        if len(far := np.flatnonzero(rest == 0)):  # the next one is in another word
            after[far] = self._place_of_one(at[far] + 1)
        return self._value(at, place), self._value(at + 1, after)

    def _value(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (place - at).astype(np.uint64) << self.low_bits | self.low[at].astype(np.uint64)

    def _place_of_one(self, nth: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, nth.astype(self.before.dtype), "right") - 1
        return word * 64 + _select(self.high[word], nth - self.before[word])

    def _place_of_zero(self, nth: np.ndarray) -> np.ndarray:
        """The place of each nth zero; -1 before the first, and past all for those that there aren't."""
        if not hasattr(self, "_zeros"):
            self._zeros = np.arange(len(self.before)) * 64 - self.before.astype(np.int64)
        word = np.searchsorted(self._zeros, nth, "right") - 1
        inside = word < len(self.high)
        word = np.clip(word, 0, len(self.high) - 1)
        place = word * 64 + _select(~self.high[word], np.maximum(nth - self._zeros[word], 0))
        return np.where(nth < 0, -1, np.where(inside, place, self.n + nth))

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values with these high bits: where they begin and end."""
        zero = self._place_of_zero(high - 1)
        begin = np.minimum(zero + 1 - high, self.n)
        word, bit = np.minimum((zero + 1) >> 6, len(self.high) - 1), ((zero + 1) & 63).astype(np.uint64)
        rest = ~self.high[word] >> bit
        end = begin + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        if len(far := np.flatnonzero((rest == 0) | (zero + 1 >= len(self.high) * 64))):
            end[far] = np.minimum(self._place_of_zero(high[far]) - high[far], self.n)
        return begin, end

    def find(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place in [low, high) of each value; -1 where it isn't."""
        if not len(value) or not self.n:
            return np.full(len(value), -1)
        value = value.astype(np.uint64)
        top = (value >> self.low_bits).astype(np.int64)
        rest = value & ((np.uint64(1) << self.low_bits) - np.uint64(1))
        begin, end = self._bucket(top)
        at, end = np.maximum(begin, low), np.minimum(end, high)
        while len(open_ := np.flatnonzero(end - at > 1)):  # those of equal high bits are few, and sorted: halve
            middle = (at[open_] + end[open_]) // 2
            below = self.low[middle].astype(np.uint64) <= rest[open_]
            at[open_] = np.where(below, middle, at[open_])
            end[open_] = np.where(below, end[open_], middle)
        place = np.minimum(at, self.n - 1)
        return np.where((end > at) & (self.low[place].astype(np.uint64) == rest), at, -1)
