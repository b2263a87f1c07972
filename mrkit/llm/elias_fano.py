"""Monotone sequences in few bits, with vectorised access and successor search."""

from __future__ import annotations

import mmap

import numpy as np

ONE, SIX, WORD = np.uint64(1), np.uint64(6), np.uint64(63)


class Bits:
    """A bit vector with counts per word, for the position of the k-th one or zero."""

    def __init__(self, positions: np.ndarray, size: int):
        words = np.zeros(size // 64 + 1, dtype=np.uint64)
        if len(positions):
            positions = positions.astype(np.uint64)
            word = (positions >> SIX).astype(np.int64)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            words[word[first]] = np.bitwise_or.reduceat(ONE << (positions & WORD), first)
        self.words = mapped(words)
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.ones = mapped(np.concatenate([[0], ones[:-1]]))
        self.zeros = mapped(64 * np.arange(len(words)) - self.ones)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        rest, bits = k - before[word], self.words[word] if bit else ~self.words[word]
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << width) - 1)
            inside = np.bitwise_count(low).astype(np.int64)
            beyond = rest >= inside
            rest, place = rest - np.where(beyond, inside, 0), place + np.where(beyond, width, 0)
            bits = np.where(beyond, bits >> np.uint64(width), low)
        return place


class EliasFano:
    """A sorted sequence of unsigned 64-bit integers: low bits in full, high bits in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = low = max(0, (top // max(n, 1)).bit_length() - 1)
        self.shift, self.mask = np.uint64(low), np.uint64((1 << low) - 1)
        high = (values >> self.shift).astype(np.int64)
        self.buckets = (top >> low) + 1
        self.high = Bits(high + np.arange(n), n + self.buckets + 1)
        self.low = mapped(_pack(values & self.mask, low))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * self.shift
        word, shift = (at >> SIX).astype(np.int64), at & WORD
        # A shift by 64 is not defined, so the upper part goes in two steps.
        upper = (self.low[word + 1] << ONE) << (WORD - shift)
        return ((self.low[word] >> shift) | upper) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self.high.select(i, 1) - i).astype(np.uint64)
        return (high << self.shift) | self._low(i)

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The first place in ``[begin, end)`` whose value is ``x`` or more; ``end`` if there is none."""
        end = self.n if end is None else end
        x = x.astype(np.uint64)
        bucket = np.minimum((x >> self.shift).astype(np.int64), self.buckets)
        lo = np.where(bucket > 0, self.high.select(np.maximum(bucket - 1, 0), 0) - bucket + 1, 0)
        hi = np.where(bucket < self.buckets, self.high.select(np.minimum(bucket, self.buckets - 1), 0) - bucket, lo)
        lo, hi, wanted = np.clip(lo, begin, end), np.clip(hi, begin, end), x & self.mask
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            middle = (lo + hi) >> 1
            open_ = lo < hi
            less = open_ & (self._low(np.minimum(middle, max(self.n - 1, 0))) < wanted)
            lo, hi = np.where(less, middle + 1, lo), np.where(open_ & ~less, middle, hi)
        return lo

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of ``x`` in ``[begin, end)``, or -1."""
        if not self.n:
            return np.full(len(x), -1)
        end = np.broadcast_to(self.n if end is None else end, len(x))
        at = self.successor(x, begin, end)
        there = at < end
        there[there] = self[at[there]] == x[there].astype(np.uint64)
        return np.where(there, at, -1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits each, one after the other in 64-bit words, and a word more."""
    words = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> SIX).astype(np.int64), at & WORD
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
        words[word[first] + 1] |= np.bitwise_or.reduceat((values >> ONE) >> (WORD - shift), first)
    return words


def mapped(values: np.ndarray) -> np.ndarray:
    """A copy in a memory map of its own, which is given back as a whole and never written to a local disk."""
    if not values.nbytes:
        return values
    copy = np.frombuffer(mmap.mmap(-1, values.nbytes), dtype=values.dtype)
    copy[:] = values
    return copy
