"""Bit vectors with rank and select, and monotone sequences, answered for whole arrays at once."""

from __future__ import annotations

import numpy as np

BLOCK_WORDS = 8  # words per entry of the rank directory
U1, U6, U63 = np.uint64(1), np.uint64(6), np.uint64(63)


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, the first bit lowest, padded to whole directory blocks."""
    raw = np.packbits(bits, bitorder="little")
    size = -(-max(len(raw), 1) // (8 * BLOCK_WORDS)) * 8 * BLOCK_WORDS
    out = np.zeros(size, dtype=np.uint8)
    out[: len(raw)] = raw
    return out.view(np.uint64)


class Bits:
    """A bit vector over packed words, with a count of ones every 512 bits."""

    def __init__(self, words: np.ndarray, size: int, directory: np.ndarray | None = None):
        self.words, self.size = words, size
        if directory is None:
            ones = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
            directory = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        self.directory = directory

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & U1).astype(bool)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, dtype=np.int64)
        block, word = at >> 9, at >> 6
        out = self.directory[np.minimum(block, len(self.directory) - 1)].astype(np.int64)
        for k in range(BLOCK_WORDS):
            w = (block << 3) + k
            full = w < word
            out += np.where(full, np.bitwise_count(self.words[np.where(full, w, 0)]), 0)
        inside = (at & 63) > 0
        mask = (U1 << (at & 63).astype(np.uint64)) - U1
        part = np.bitwise_count(self.words[np.where(inside, word, 0)] & mask)
        return out + np.where(inside, part, 0)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) bit of the kind; each must exist."""
        k = np.asarray(k, dtype=np.int64)
        counts = self.directory.astype(np.int64)
        if not one:
            counts = (np.arange(len(counts), dtype=np.int64) << 9) - counts
        block = np.searchsorted(counts, k, "right") - 1
        left = k - counts[block]
        word = block << 3
        done = np.zeros(len(k), dtype=bool)
        for _ in range(BLOCK_WORDS):
            w = self.words[np.minimum(word, len(self.words) - 1)]
            n = np.bitwise_count(w if one else ~w).astype(np.int64)
            done |= left < n
            left = np.where(done, left, left - n)
            word = np.where(done, word, word + 1)
        w = self.words[np.minimum(word, len(self.words) - 1)]
        w = w if one else ~w
        at = np.zeros(len(k), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = w & ((U1 << np.uint64(half)) - U1)
            n = np.bitwise_count(low).astype(np.int64)
            up = left >= n
            left = np.where(up, left - n, left)
            w = np.where(up, w >> np.uint64(half), low)
            at += np.where(up, half, 0)
        return (word << 6) + at


class EliasFano:
    """A sorted sequence of integers below 2**64: low bits packed, high bits in unary."""

    def __init__(self, n: int, shift: int, low: np.ndarray, high: Bits):
        self.n, self.shift, self.low, self.high = n, shift, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = max((top // max(n, 1)).bit_length() - 1, 0)
        low = np.zeros((n * shift) // 64 + 2, dtype=np.uint64)
        if shift and n:
            part = values & ((U1 << np.uint64(shift)) - U1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(shift)
            word, bit = (at >> U6).astype(np.int64), at & U63
            np.bitwise_or.at(low, word, part << bit)
            over = bit + np.uint64(shift) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - bit[over]))
        high = (values >> np.uint64(shift)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 2, dtype=bool)
        bits[high + np.arange(n)] = True
        return cls(n, shift, low, Bits(pack_bits(bits), len(bits)))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(at), dtype=np.uint64)
        bit0 = at.astype(np.uint64) * np.uint64(self.shift)
        word, bit = (bit0 >> U6).astype(np.int64), bit0 & U63
        out = self.low[word] >> bit
        over = bit > 0
        out |= np.where(over, self.low[word + 1] << ((np.uint64(64) - bit) & U63), np.uint64(0))
        return out & ((U1 << np.uint64(self.shift)) - U1)

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64)
        high = self.high.select(at, True) - at
        return (high.astype(np.uint64) << np.uint64(self.shift)) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element not below each value (n if none): the successor."""
        values = np.asarray(values, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(values), dtype=np.int64)
        top = self.high.size - self.n - 2  # the largest high part
        wanted = (values >> np.uint64(self.shift)).astype(np.float64)
        high = np.minimum(wanted, top + 1).astype(np.int64)
        # Elements of high part h stand between the zeros h - 1 and h.
        lo = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), False) - high + 1, 0)
        hi = np.where(high <= top, self.high.select(np.minimum(high, top), False) - high, self.n)
        hi = np.where(high <= top, hi, lo)
        target = values & ((U1 << np.uint64(self.shift)) - U1)
        open_ = lo < hi
        while open_.any():
            mid = (lo + hi) >> 1
            at = np.flatnonzero(open_)
            below = np.zeros(len(values), dtype=bool)
            below[at] = self._low(mid[at]) < target[at]
            lo = np.where(open_ & below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
            open_ = lo < hi
        return lo

    def has(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each value and whether it is there."""
        at = self.find(values)
        there = at < self.n
        there[there] = self.get(at[there]) == np.asarray(values, dtype=np.uint64)[there]
        return at, there

    def arrays(self) -> list[np.ndarray]:
        sizes = np.array([self.n, self.shift, self.high.size], dtype=np.int64)
        return [sizes, self.low, self.high.words, self.high.directory]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> EliasFano:
        sizes, low, words, directory = arrays
        n, shift, size = (int(x) for x in sizes)
        return cls(n, shift, low, Bits(words, size, directory))
