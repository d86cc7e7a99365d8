"""Elias-Fano sequences and a three-level n-gram trie in memory-mapped levels.

A monotone sequence of n values below u takes about 2 + log2(u / n) bits a
value: the low bits are packed, the high bits stand in unary in a bit vector
with a rank directory.  A level keeps, for each of its grams, a monotone
pointer to its first child; the contexts of one gram ascend from the last
context of the gram before, so that the whole level is monotone, and one is
found by a successor search between its parent's pointers.
"""

from __future__ import annotations

import mmap
import os

import numpy as np

U = np.uint64
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_PLACE = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _k = 0
    for _i in range(8):
        if _b >> _i & 1:
            _PLACE[_b, _k] = _i
            _k += 1


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0); ``before``: set bits before each word."""
    word = np.searchsorted(before, k, side="right") - 1
    left = (k - before[word]).astype(np.int64)
    parts = words[word].view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_COUNT[parts], axis=1, dtype=np.int64)
    at = (upto <= left[:, None]).sum(1)
    row = np.arange(len(k))
    left -= np.where(at > 0, upto[row, at - 1], 0)
    return word * 64 + at * 8 + _PLACE[parts[row, at], left]


class EliasFano:
    """A sorted sequence of uint64 below ``universe``; equal values are allowed."""

    CHUNK = 1 << 17

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = _COUNT[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        at = np.arange(n, dtype=np.int64) * low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        low = np.zeros((n * low_bits >> 6) + 2, U)
        part = values & U((1 << low_bits) - 1)
        if n and low_bits:
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = shift + U(low_bits) > U(64)
            low[word[over] + 1] |= part[over] >> (U(64) - shift[over])
        top = (values >> U(low_bits)).astype(np.int64)
        size = n + int(universe - 1 >> low_bits) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view(U))

    def access(self, i: np.ndarray) -> np.ndarray:
        top = (_select(self.high, self.ones, i) - i).astype(U)
        if not self.low_bits:
            return top
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        over = shift > U(0)
        value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return top << U(self.low_bits) | value & U((1 << self.low_bits) - 1)

    def _before_bucket(self, top: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``top``."""
        out = np.zeros(len(top), np.int64)
        some = top > 0
        k = top[some] - 1
        out[some] = _select(~self.high, self.zeros, k) - k
        return out

    def find(self, x: np.ndarray, since: np.ndarray | None = None, until: np.ndarray | None = None) -> np.ndarray:
        """Place of each value (its successor, if equal), or -1; only places
        in [since, until) of each value count, if given."""
        out = np.full(len(x), -1, np.int64)
        for a in range(0, len(x), self.CHUNK):
            some = x[a:a + self.CHUNK]
            top = (some >> U(self.low_bits)).astype(np.int64)
            # a value above all others is in no bucket
            top = np.minimum(top, len(self.high) * 64 - self.n - 1)
            at, end = self._before_bucket(top), self._before_bucket(top + 1)
            if since is not None:
                at = np.maximum(at, since[a:a + self.CHUNK])
                end = np.minimum(end, until[a:a + self.CHUNK])
            # binary search for the successor inside the bucket
            open_ = np.flatnonzero(at < end)
            while len(open_):
                middle = (at[open_] + end[open_]) >> 1
                got = self.access(middle)
                same = got == some[open_]
                out[a + open_[same]] = middle[same]
                less = got < some[open_]
                at[open_] = np.where(less, middle + 1, at[open_])
                end[open_] = np.where(less, end[open_], middle)
                open_ = open_[~same & (at[open_] < end[open_])]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.asarray([self.n, self.low_bits, len(self.low), len(self.high)], np.int64), self.low, self.high]


#: Bits of a context's hash in level 2, and of the context before it in level 3.
NEAR_BITS = 36
FAR_BITS = 28


class Children:
    """A level: pointers from each parent to its first child, and the children."""

    def __init__(self, pointers: EliasFano, values: EliasFano):
        self.pointers, self.values = pointers, values

    @classmethod
    def of(cls, parents: int, parent: np.ndarray, value: np.ndarray) -> Children:
        """``(parent, value)`` sorted; a parent may have no child."""
        starts = np.searchsorted(parent, np.arange(parents + 1))
        last = np.zeros(parents, U)
        some = starts[1:] > starts[:-1]
        last[some] = value[starts[1:][some] - 1]
        top = np.cumsum(last)
        whole = value + (top - last)[parent]
        return cls(EliasFano.of(starts.astype(U), len(value) + 1),
                   EliasFano.of(whole, int(top[-1]) + 1 if parents else 1))

    def find(self, parent: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Place of ``value`` among the children of ``parent`` (-1: no parent), or -1."""
        out = np.full(len(parent), -1, np.int64)
        asked = np.flatnonzero(parent >= 0)
        own, back = np.unique(parent[asked], return_inverse=True)
        since, until = (self.pointers.access(own + k).astype(np.int64) for k in (0, 1))
        before = np.zeros(len(own), U)
        before[since > 0] = self.values.access(since[since > 0] - 1)
        out[asked] = self.values.find(before[back] + value[asked], since[back], until[back])
        return out

    def parts(self) -> list[np.ndarray]:
        return self.pointers.parts() + self.values.parts()


class Trie:
    """Level 1: words (sorted hashes) with their counts; level 2: the context
    of each word; level 3: the context before it.  Levels 1 and 2 have a
    quantised back-off probability and context weight, level 3 a probability."""

    _QUANTISED = ("backoff", "weight", "backoff2", "weight2", "prob")

    def __init__(self, words: EliasFano, near: Children, far: Children, counts, *quantised):
        self.words, self.near, self.far, self.counts = words, near, far, counts
        self.backoff, self.weight, self.backoff2, self.weight2, self.prob = quantised

    @classmethod
    def build(cls, words, counts, of_word, near, of_pair, far, *quantised) -> Trie:
        """``words`` sorted; (of_word, near) and (of_pair, far) sorted, without repeats."""
        return cls(EliasFano.of(words, 1 << 64), Children.of(len(words), of_word, near),
                   Children.of(len(near), of_pair, far), counts, *quantised)

    def mapped(self, file: int = -1) -> Trie:
        """The same trie with all levels in one memory map, of ``file`` (a
        descriptor) or anonymous."""
        arrays = [*self.words.parts(), *self.near.parts(), *self.far.parts(), np.asarray(self.counts, np.int64),
                  *(np.asarray(getattr(self, name), np.int16) for name in self._QUANTISED)]
        size = sum(-(-a.nbytes // 8) * 8 for a in arrays)
        if file >= 0:
            os.truncate(file, size)
        area = mmap.mmap(file, size)
        for a in arrays:
            area.write(a.tobytes() + bytes(-a.nbytes % 8))
        return Trie.from_buffer(area)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """Views into ``buffer`` (a memory map, or bytes); nothing is copied."""
        at = 0

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(buffer, dtype, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        def sequence():
            n, low_bits, low, high = (int(x) for x in take(np.int64, 4))
            return EliasFano(n, low_bits, take(U, low), take(U, high))

        words, near, far = sequence(), Children(sequence(), sequence()), Children(sequence(), sequence())
        sizes = (words.n, words.n, near.values.n, near.values.n, far.values.n)
        return cls(words, near, far, take(np.int64, words.n), *(take(np.int16, n) for n in sizes))
