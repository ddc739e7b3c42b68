"""An FM-index over a sequence of integers: suffix array, wavelet matrix, backward search, locate.

All operations work on arrays of queries at once, so a search costs a few numpy calls for each place of
the longest phrase and not for each phrase.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with rank: 64-bit words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate((bits.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8))), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)


class Wavelet:
    """A wavelet matrix: rank of any symbol, and the symbol of any place, in one step a bit."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        now = seq
        for k in range(self.depth - 1, -1, -1):
            bits = (now >> k) & 1 == 1
            self.levels.append(Bits(bits))
            self.zeros.append(int((~bits).sum()))
            now = np.concatenate((now[~bits], now[bits]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each place."""
        lo, hi = np.zeros_like(i), i
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i)
            a = bits.rank(i)
            out = out << 1 | one
            i = np.where(one, zeros + a, i - a)
        return out


class FmIndex:
    """The index of a sequence of symbols from 1; every `sample`-th place keeps its suffix position."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        full = np.concatenate((seq.astype(np.int64), [0]))  # 0 ends the sequence
        order = suffix_array(full)
        last = full[order - 1]
        self.n = len(full)
        self.wavelet = Wavelet(last, symbols)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(full, minlength=symbols))))
        kept = order % sample == 0
        self.marked, self.places = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of phrases of one length: the range of suffixes that begin with each."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            lo, hi = self.below[c] + self.wavelet.rank(c, lo), self.below[c] + self.wavelet.rank(c, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of those suffixes: back through the text to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            here = self.marked.get(at)
            out[open_[here]] = self.places[self.marked.rank(at[here])] + steps
            open_, at = open_[~here], at[~here]
            c = self.wavelet.get(at)
            at = self.below[c] + self.wavelet.rank(c, at)
            steps += 1
        return out
