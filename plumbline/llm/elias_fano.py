"""Elias-Fano sequences in one memory-mapped block: monotone numbers in about log2(range / count) + 2 bits each.

A number is split into low bits, kept as whole bytes side by side, and a high part, kept in unary in a bit vector whose
zeros are counted per 64-bit word. All operations take arrays.
"""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, laid out one after the other in one anonymous memory map."""
    sizes = [-(-a.nbytes // 8) * 8 for a in arrays]
    block = mmap.mmap(-1, max(8, sum(sizes)))
    out, at = [], 0
    for a, size in zip(arrays, sizes):
        view = np.frombuffer(block, a.dtype, a.size, at).reshape(a.shape)
        view[...] = a
        out.append(view)
        at += size
    return out


class EliasFano:
    def __init__(self, values: np.ndarray, top: int):
        """`values` ascend and are at most `top`."""
        n = len(values)
        self.n = n
        self.shift = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        high = (values >> U(self.shift)).astype(np.int64)
        places = high + np.arange(n)
        words = (int(places[-1]) if n else 0) // 64 + 2
        self.highest = int(high[-1]) if n else -1
        bits = np.zeros(words * 64, np.uint8)
        bits[places] = 1
        unary = np.packbits(bits, bitorder="little").view(U)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(unary).astype(np.int64))])
        low = values & U((1 << self.shift) - 1)
        self.width = -(-self.shift // 8)
        self.low, self.unary, self.zeros = mapped([np.ascontiguousarray(low.view(np.uint8).reshape(n, 8)[:, :self.width]), unary, zeros])

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """Numbers with a smaller high part: place of the high-th zero, less the zeros before."""
        word = np.searchsorted(self.zeros, high, "left") - 1  # holds the wanted zero, counted from 1 to high
        left = high - self.zeros[np.maximum(word, 0)]
        bits = ~self.unary[np.clip(word, 0, len(self.unary) - 1)]
        place = np.zeros(len(high), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = bits & U((1 << step) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            up = left > count
            left = np.where(up, left - count, left)
            place = np.where(up, place + step, place)
            bits = np.where(up, bits >> U(step), part)
        return np.where(high <= 0, 0, word * 64 + place + 1 - high)

    def lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, :self.width] = self.low[at]
        return out.view(U).ravel()

    def successor(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number not below each value among places first .. last - 1 (or last), and whether it is equal."""
        high = np.minimum((values >> U(self.shift)).astype(np.int64), self.highest + 1)
        wanted = values & U((1 << self.shift) - 1)
        a, b = np.maximum(self._begin(high), first), np.minimum(self._begin(np.minimum(high + 1, self.highest + 1)), last)
        b = np.where(high > self.highest, last, b)
        a = np.where(high > self.highest, last, np.minimum(a, last))
        end = np.maximum(a, b)
        low, top = a.copy(), end.copy()
        open_ = np.flatnonzero(low < top)
        while len(open_):
            middle = (low[open_] + top[open_]) // 2
            under = self.lows(middle) < wanted[open_]
            low[open_] = np.where(under, middle + 1, low[open_])
            top[open_] = np.where(under, top[open_], middle)
            open_ = open_[low[open_] < top[open_]]
        equal = low < end
        at = np.flatnonzero(equal)
        equal[at] = self.lows(low[at]) == wanted[at]
        return low, equal

    def get(self, at: np.ndarray) -> np.ndarray:
        """Numbers at places: the place of the i-th one in the unary bits gives the high part."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, at, "right") - 1
        left = at - ones[word] + 1
        bits = self.unary[word]
        place = np.zeros(len(at), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = bits & U((1 << step) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            up = left > count
            left = np.where(up, left - count, left)
            place = np.where(up, place + step, place)
            bits = np.where(up, bits >> U(step), part)
        high = word * 64 + place - at
        return (high.astype(U) << U(self.shift)) | self.lows(at)
