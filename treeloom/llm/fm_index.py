"""A compressed full-text index (FM-index) of integer symbols, searched for many queries at a time.

The Burrows-Wheeler transform of the text is kept in a wavelet tree laid out level by level (a wavelet
matrix): per level one bit per symbol, packed, with a running count every 64 bits. A backward-search step
costs two rank lookups per level, done for all queries at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start of every suffix in sorted order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = ((now >> level) & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the text ends up on the lowest level, going the way of ``symbol``."""
        for k in range(self.levels):
            block = at >> 6
            below = self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[k][block] + np.bitwise_count(below)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Index of a text of symbols 1..top; 0 ends it."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        text = np.concatenate([symbols, [0]])
        order = suffix_order(text)
        self.n = len(text)
        self.top = top
        self.bwt = WaveletMatrix(text[order - 1], top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])[: top + 1]
        every = np.arange(top + 1)
        self.base = self.bwt.descend(every, np.zeros(top + 1, dtype=np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in [lo, hi) that follow ``symbol``, as the interval of symbol + match."""
        both = self.bwt.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) - np.tile(self.base[symbol], 2)
        both += np.tile(self.first[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def matches(self, queries: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, start, end) of maximal stretches of at least ``least`` symbols that occur in the text.

        queries: one row each, padded; a symbol outside 1..top occurs nowhere. Backward search extends each match
        to the left as far as it goes. After a break at position i, stretches that begin at i end by i + least at
        the latest unless a longer one was just reported, so the search goes on from that end.
        """
        m = len(queries)
        end = lengths.astype(np.int64).copy()
        at, lo, hi = end - 1, np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        live = np.flatnonzero(end >= least)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            symbol = queries[live, at[live]].astype(np.int64)
            known = (symbol >= 1) & (symbol <= self.top)
            new_lo, new_hi = self.extend(np.where(known, symbol, 0), lo[live], hi[live])
            good = known & (new_lo < new_hi)
            go = live[good]
            lo[go], hi[go] = new_lo[good], new_hi[good]
            at[go] -= 1
            whole, broken = go[at[go] < 0], live[~good]
            size = end[broken] - at[broken] - 1
            hit = size >= least
            for q, start in ((whole, np.zeros(len(whole), dtype=np.int64)), (broken[hit], at[broken[hit]] + 1)):
                if len(q):
                    found.append((q, start, end[q].copy()))
            end[whole] = 0
            end[broken] = np.where(hit, at[broken] + least, end[broken] - 1)
            at[broken] = end[broken] - 1
            lo[broken], hi[broken] = 0, self.n
            live = live[end[live] >= least]
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
