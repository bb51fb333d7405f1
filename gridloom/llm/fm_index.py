"""An FM-index over word symbols: wavelet-matrix ranks, backward search and sampled suffix positions.

Symbols 1..V are words of the phrases to look up; 0 is a boundary (the end of a document, or a word that no phrase has).  A
suffix ends at its first boundary and boundaries are ordered by place, so no phrase reaches over one.  All steps work on
arrays: many phrases, and many rows of the index, move one step at a time.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: rank and access over an alphabet of any size."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.zeros = [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            one = ((now >> level) & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(len(now) - int(one.sum()))
            now = np.concatenate([now[~one], now[one]])
        self.first = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        return self._walk(symbol, i) - self.first[symbol]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, ones = bits[i].astype(np.int64), bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one == 1, zeros + ones, i - ones)
        return symbol, i - self.first[symbol]


def suffix_order(symbols: np.ndarray, top: int) -> np.ndarray:
    """Start places of all suffixes in order.  The first round sorts by as many symbols as fit 62 bits; later rounds double."""
    n = len(symbols)
    width = max(1, int(top).bit_length())
    span = max(1, 62 // width)
    key = symbols.astype(np.int64)
    open_ = symbols != 0  # no boundary so far
    for k in range(1, span):
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - k)] = symbols[k:]
        follow[~open_] = 0
        key = (key << width) | follow
        open_ = open_ & (follow != 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~open_[order[1:]]  # what has met a boundary is settled by place
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = span
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        by = np.lexsort((rank[at + h], rank[at]))
        at = at[by]
        a, b = rank[at], rank[at + h]
        order[rows] = at
        head[rows[1:]] |= (a[1:] == a[:-1]) & (b[1:] != b[:-1])
        # within a tie each new head starts a finer group
        rank[at] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[rows]
        h *= 2


class FMIndex:
    """Counts and places of phrases in one shard's symbols (which end with a boundary)."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 32):
        order = suffix_order(symbols, top)
        before = symbols[order - 1].astype(np.int64)
        before[order == 0] = 0
        self.n = len(symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.wavelet = Wavelet(before, top)
        marked = (order % sample == 0) | (before == 0)
        self.marked = Bits(marked)
        self.samples = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases; each row of ``phrases`` holds its words from the left, padded with 0."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back].astype(np.int64)
            both = self.less[np.tile(symbol, 2)] + self.wavelet.rank(np.tile(symbol, 2), np.concatenate([low[live], high[live]]))
            low[live], high[live] = both[: len(live)], both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix: step back to the nearest sampled one."""
        rows, place = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            now = rows[live]
            found = self.marked[now] == 1
            place[live[found]] += self.samples[self.marked.rank(now[found])]
            live, now = live[~found], now[~found]
            symbol, rank = self.wavelet.access_rank(now)
            rows[live] = self.less[symbol] + rank
            place[live] += 1
        return place
