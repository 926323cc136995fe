"""Elias-Fano sequences and a two-level n-gram trie made of them, laid out for memory mapping.

A strictly or weakly rising sequence is kept as ``low`` bits, packed, and the rest as unary gaps in a bitmap, with
the number of ones before each 64-bit word of it, by which the k-th one or zero is found; all three are read where they
are mapped, and nothing is unpacked. The trie's first level holds context ids, each with the quantised weight of its
back-off and a pointer to where its successors begin; the second holds the successor ids of all contexts in one rising
sequence, each id relative to the last value of the context before, so that a search within a context is a search for
``id + base`` in the whole, and the quantised smoothed probability of each. All look-ups take arrays.
"""

from __future__ import annotations

import mmap
from typing import BinaryIO

import numpy as np

#: Range of the quantised log10 probabilities, in 65,534 steps; 0 stands for no entry.
RANGE = 16.0
STEPS = 65_534


class EliasFano:
    """A rising sequence of non-negative integers."""

    def __init__(self, size: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.size, self.bits, self.low, self.words, self.before = size, bits, low, high.view("<u8"), before.view("<u4")
        self.mask = np.uint64((1 << bits) - 1)
        # a 64-bit window at every byte of the packed low bits
        self.windows = np.ndarray((max(1, len(low) - 7),), "<u8", buffer=low, strides=(1,))

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        """Header, low bits, bitmap and its counts of ones of a sequence."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        flat = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.concatenate([np.packbits(flat, bitorder="little"), np.zeros(8, np.uint8)])
        low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)])
        flags = np.zeros(-(-(n + (top >> bits) + 2) // 64) * 64, np.uint8)
        flags[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little")
        ones = np.bitwise_count(high.view("<u8")).astype("<u4")
        before = np.concatenate([np.cumsum(ones, dtype="<u4") - ones, np.zeros(len(ones) % 2, "<u4")]).view(np.uint8)
        return [np.array([n, bits, len(low), len(high)], "<i8").view(np.uint8), low, high, before]

    @classmethod
    def load(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at a byte of ``data``, and where it ends."""
        n, bits, low, high = data[at : at + 32].view("<i8").tolist()
        a, b, c = at + 32, at + 32 + low, at + 32 + low + high
        end = c + -(-high // 16) * 8
        return cls(n, bits, data[a:b], data[b:c], data[c : c + high // 2]), end

    def lows(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.bits
        return (self.windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    @staticmethod
    def in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of each word, by halves."""
        place = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = word & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            over = k >= ones
            k = k - np.where(over, ones, 0)
            place += np.where(over, half, 0)
            word = np.where(over, word >> np.uint64(half), low)
        return place

    def one(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one in the bitmap."""
        word = np.searchsorted(self.before, k, "right") - 1
        return 64 * word + self.in_word(self.words[word], k - self.before[word])

    def zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero: words are halved by the zeros before them."""
        a, b = np.zeros(len(k), np.int64), np.full(len(k), len(self.before), np.int64)
        while (b - a > 1).any():
            mid = (a + b) >> 1
            less = 64 * mid - self.before[mid].astype(np.int64) <= k
            a, b = np.where(less, mid, a), np.where(less, b, mid)
        return 64 * a + self.in_word(~self.words[a], k - (64 * a - self.before[a].astype(np.int64)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.one(at) - at) << self.bits) | self.lows(at).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands, or -1. Its high part names a short run; the run is halved by low bits."""
        high = values >> self.bits
        inside = (values >= 0) & (high + 1 < 64 * len(self.words) - self.size)
        h = np.where(inside, high, 0)
        start = np.where(h > 0, self.zero(np.maximum(h - 1, 0)) + 1, 0) - h
        end = np.minimum(self.zero(h) - h, self.size)
        low = values.astype(np.uint64) & self.mask
        a, b = start.copy(), end.copy()
        active = np.flatnonzero(inside & (a < b))
        while len(active):
            mid = (a[active] + b[active]) >> 1
            less = self.lows(mid) < low[active]
            a[active[less]] = mid[less] + 1
            b[active[~less]] = mid[~less]
            active = active[a[active] < b[active]]
        hit = np.flatnonzero(inside & (a < end))
        out = np.full(len(values), -1, np.int64)
        same = hit[self.lows(a[hit]) == low[hit]]
        out[same] = a[same]
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    code = np.rint(-np.log10(p) / RANGE * STEPS)
    return (np.clip(code, 0, STEPS) + 1).astype("<u2")


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, 0.0, 10.0 ** (-(codes.astype(float) - 1) / STEPS * RANGE))


class Trie:
    """Contexts with their back-off, their successors and the quantised probability of each pair."""

    def __init__(self, data: np.ndarray):
        at, levels = 8, []
        for _ in range(3):
            level, at = EliasFano.load(data, at)
            levels.append(level)
        self.contexts, self.pointers, self.successors = levels
        n, pairs = self.contexts.size, int(data[:8].view("<i8")[0])
        self.backoff = data[at : at + 2 * n].view("<u2")
        self.codes = data[at + 2 * n : at + 2 * (n + pairs)].view("<u2")

    @staticmethod
    def write(out: BinaryIO, context: np.ndarray, successor: np.ndarray, p: np.ndarray, backoff: np.ndarray | None = None) -> None:
        """From pairs in order of context, then successor, each pair once; ``backoff`` has one weight a context."""
        first = np.flatnonzero(np.diff(context, prepend=-1))
        counts = np.diff(np.append(first, len(context)))
        # a context's values start after the last one of the context before
        last = successor[first + counts - 1] + 1 if len(first) else np.zeros(0, np.int64)
        base = np.cumsum(last) - last
        rising = np.repeat(base, counts) + successor + 1
        out.write(np.array([len(context)], "<i8").tobytes())
        for values in (context[first], np.append(first, len(context)), rising):
            for part in EliasFano.parts(values):
                out.write(part.tobytes())
        out.write(quantised(np.ones(len(first)) if backoff is None else backoff).tobytes())
        out.write(quantised(p).tobytes())

    @classmethod
    def mapped(cls, file: BinaryIO) -> Trie:
        file.flush()
        return cls(np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8))

    def lookup(self, context: np.ndarray, successor: np.ndarray, lower: np.ndarray | None = None) -> np.ndarray:
        """Code of each pair. One that the trie hasn't got has code 0, or, where the codes of the successors'
        ``lower`` order are given, the code of that times the context's back-off. Runs of one context are looked up
        once."""
        out = np.zeros(len(context), "<u2") if lower is None else lower.astype(np.int64)
        heads = np.flatnonzero(np.diff(context, prepend=-1))
        many = np.diff(np.append(heads, len(context)))
        place = self.contexts.find(context[heads])
        found = place >= 0
        begin, end, base = (np.zeros(len(heads), np.int64) for _ in range(3))
        begin[found], end[found] = self.pointers.get(place[found]), self.pointers.get(place[found] + 1)
        later = begin > 0
        base[later] = self.successors.get(begin[later] - 1)
        if lower is not None:
            out += np.repeat(np.where(found, self.backoff[np.maximum(place, 0)].astype(np.int64) - 1, 0) if len(self.backoff) else 0, many)
        known = np.flatnonzero(np.repeat(found, many))
        begin, end, base = (np.repeat(x, many)[known] for x in (begin, end, base))
        at = self.successors.find(base + successor[known] + 1)
        hit = (at >= begin) & (at < end)
        out[known[hit]] = self.codes[at[hit]]
        return out
