"""Simple-8b: runs of non-negative integers packed into 64-bit words.

A word is a selector in its upper 4 bits and a payload of 60 bits that holds as many
values as the selector says, each in the same number of bits, the first value lowest.
The largest count whose values all fit is taken, so packing is greedy from the left.
A value of more than 60 bits is an escape: a word with selector 0, then the value as it
is. Such a value has one of its upper 4 bits set, so no raw word looks like an escape,
and every word's kind shows from the word before it.

Values come in lists (documents), and lists are cut into blocks of BLOCK values. Each
block starts a new word, and the word it starts at is kept; so blocks are packed and
unpacked side by side, each step taking one word of every block. What the last word of
a block holds beyond the block's values is zero and not read.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
ESCAPE = 0
#: Fixed values of the coding: values per word and bits per value of each selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: How the largest width of each count of neighbours follows from two smaller counts.
_SUMS = ((1, 1), (2, 1), (2, 2), (4, 1), (3, 3), (4, 3), (4, 4), (5, 5), (6, 6), (8, 7), (10, 10), (15, 15), (30, 30), (60, 60))


def block_sizes(lengths: np.ndarray) -> np.ndarray:
    """Values in each block of lists of these lengths; an empty list has no block."""
    n = -(-lengths // BLOCK)
    sizes = np.full(int(n.sum()), BLOCK, np.int64)
    full = lengths > 0
    sizes[np.cumsum(n)[full] - 1] = (lengths - (n - 1) * BLOCK)[full]
    return sizes


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; none for 0."""
    high = values >> np.uint64(32)
    part = np.where(high > 0, high, values).astype(np.float64)
    return (np.frexp(part)[1] + np.where(high > 0, 32, 0)).astype(np.uint8)


def pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of lists that stand one after another."""
    values, lengths = np.asarray(values, np.uint64), np.asarray(lengths, np.int64)
    sizes = block_sizes(lengths)
    blocks = len(sizes)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    most = int(COUNTS.max())
    rows = np.repeat(np.arange(blocks), sizes)
    columns = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table = np.zeros((blocks, BLOCK + most), np.uint64)
    table[rows, columns] = values
    need = np.zeros(table.shape, np.uint8)
    need[rows, columns] = widths(values)
    widest = {1: need}
    for a, b in _SUMS:
        end = need.shape[1] - (a + b) + 1
        widest[a + b] = np.maximum(widest[a][:, :end], widest[b][:, a : a + end])
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, ESCAPE, -1):  # from few values to many
        choice[widest[int(COUNTS[s])][:, :BLOCK] <= BITS[s]] = s
    # one word of every unfinished block at a time
    place, active, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(active):
        at = place[active]
        chosen = choice[active, at]
        steps.append((active, at, chosen))
        place[active] = at + COUNTS[chosen]
        active = active[place[active] < sizes[active]]
    block, at, chosen = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(block, kind="stable")
    block, at, chosen = block[order], at[order], chosen[order]
    taken = 1 + (chosen == ESCAPE)
    ends = np.cumsum(taken)
    where = ends - taken
    words = np.zeros(int(ends[-1]), np.uint64)
    for s in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[where[own]] = 1
            words[where[own] + 1] = table[block[own], at[own]]
            continue
        n, bits = int(COUNTS[s]), int(BITS[s])
        packed = np.full(len(own), s << 60, np.uint64)
        for k in range(n if bits else 0):
            packed |= table[block[own], at[own] + k] << np.uint64(k * bits)
        words[where[own]] = packed
    return words, where[np.searchsorted(block, np.arange(blocks))]


def unpack(words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Values of all lists, one after another."""
    lengths = np.asarray(lengths, np.int64)
    sizes = block_sizes(lengths)
    out = np.zeros(int(lengths.sum()), np.uint64)
    if not len(sizes):
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    escape = np.zeros(len(words), bool)
    escape[:] = selector == ESCAPE
    raw = np.zeros(len(words), bool)
    raw[1:] = escape[:-1]
    counts = np.where(raw, 1, np.where(escape, 0, COUNTS[selector]))
    before = np.cumsum(counts) - counts
    per_block = np.diff(np.append(first, len(words)))
    within = before - np.repeat(before[first], per_block)
    counts = np.minimum(counts, np.repeat(sizes, per_block) - within)
    target = np.repeat(np.cumsum(sizes) - sizes, per_block) + within
    out[target[raw]] = words[raw]
    packed = ~raw & ~escape
    for s in np.unique(selector[packed]).tolist():
        own = np.flatnonzero(packed & (selector == s))
        bits = int(BITS[s])
        if not bits:
            continue  # zeros, as `out` has them
        mask = np.uint64((1 << bits) - 1)
        for k in range(int(COUNTS[s])):
            held = own[counts[own] > k]
            out[target[held] + k] = (words[held] >> np.uint64(k * bits)) & mask
    return out
