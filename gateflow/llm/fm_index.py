"""FM-index over a sequence of small integers, in NumPy.

Symbol 0 parts runs that no pattern crosses: each 0 counts as a symbol of its own,
ordered by place, so suffixes are told apart within their run. The transformed
sequence is held as a wavelet matrix (one bit row per level with counts before
each 64-bit block); places are kept for every `rate`-th position and after each 0,
and found for the others by stepping back through the text.
"""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray, bits: int) -> np.ndarray:
    """Positions in order of their suffixes; seq ends with 0.

    A first sort takes as many symbols as fit one integer, then the sorted length
    doubles for positions that are still tied.
    """
    n, packed = len(seq), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)  # no 0 met so far
    for j in range(packed):
        symbol = np.zeros(n, np.int64)
        symbol[: max(0, n - j)] = seq[j:]
        symbol[~open_] = 0
        key = (key << bits) | symbol
        open_ &= symbol > 0
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.ones(n, bool)  # a group of tied positions begins
    begins[1:] = (key[1:] != key[:-1]) | ~open_[order][1:]
    first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    length = packed
    while True:
        tied = np.flatnonzero(~(begins & np.append(begins[1:], True)))
        if not len(tied):
            return order
        positions = order[tied]
        key = first[tied] * (n + 1) + rank[positions + length]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[tied] = positions[by]
        begins[tied[1:]] = key[1:] != key[:-1]
        first[tied] = np.maximum.accumulate(np.where(begins[tied], tied, 0))
        rank[order[tied]] = first[tied]
        length *= 2


class _Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.blocks)
        self.before = np.zeros(len(self.blocks), np.int32)
        np.cumsum(counts[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.blocks[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Index of `seq` (ends with 0; symbols below `size`)."""

    def __init__(self, seq: np.ndarray, size: int, rate: int = 8):
        bits = max(1, int(size - 1).bit_length())
        order = suffix_order(seq, bits)
        self.n, self.rate = len(seq), rate
        last = seq[order - 1]
        self.levels: list[tuple[_Bits, int]] = []
        row = last.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            zeros = row[~bit]
            self.levels.append((_Bits(bit), len(zeros)))
            row = np.concatenate([zeros, row[bit]])
        self.bits = bits
        smaller = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=size), out=smaller[1:])
        self.smaller = smaller
        symbols = np.arange(size)
        self.base = smaller[:-1] - self._path(symbols, np.zeros(size, np.int64))
        kept = (order % rate == 0) | (last == 0)
        self.kept = _Bits(kept)
        self.places = order[kept].astype(np.int32)

    def _path(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Row followed down the levels by the bits of a symbol."""
        for depth, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - depth)) & 1
            ones = bits.ones(row)
            row = np.where(one == 1, zeros + ones, row - ones)
        return row

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern (one a line, no 0), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        live = np.arange(len(patterns))
        symbol = patterns[:, -1]
        lo, hi = self.smaller[symbol], self.smaller[symbol + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            symbol = patterns[live, j]
            lo = self.base[symbol] + self._path(symbol, lo)
            hi = self.base[symbol] + self._path(symbol, hi)
        low[live], high[live] = lo, hi
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each row."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            known = self.kept.at(at) == 1
            out[todo[known]] = self.places[self.kept.ones(at[known])] + steps
            todo, at = todo[~known], at[~known]
            symbol = np.zeros(len(at), np.int64)
            for bits, zeros in self.levels:  # the symbol before, and its row below
                one = bits.at(at).astype(np.int64)
                ones = bits.ones(at)
                symbol = (symbol << 1) | one
                at = np.where(one == 1, zeros + ones, at - ones)
            at = self.base[symbol] + at
            steps += 1
        return out
