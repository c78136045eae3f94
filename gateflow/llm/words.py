"""Words of texts as 64-bit digests, found on whole UTF-8 buffers at once.

A word is a maximal run of word bytes. ASCII letters A-Z count as a-z; every byte
of a non-ASCII character is a word byte. Digests are polynomial over the bytes
modulo 2**64 and then mixed, so equal words have equal digests on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser on uint64 (the multipliers of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _table(is_word) -> np.ndarray:
    """uint64 value of each byte, 0 for bytes outside words."""
    byte = np.arange(256)
    folded = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    values = mix(folded.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    return np.where([is_word(int(b)) for b in folded], values, np.uint64(0))


#: Words parted by ASCII white space only.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of a-z, 0-9 and every character beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES)
        steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 8 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


@dataclass
class Words:
    """digest of each word; counts: words of each text of the slice, in order."""

    digests: np.ndarray
    counts: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than texts) and the bytes; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0] : offsets[-1]]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` bytes, a longer text alone."""
    offsets, _ = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_digests(texts: pa.Array, table: np.ndarray) -> Words:
    """Digests of the words of a slice of texts (see `slices`). A text longer than a
    slice is worked through in pieces that end between words."""
    offsets, body = buffers(texts)
    if len(body) <= 4 * SLICE_BYTES:
        return _digests(offsets, body, table)
    parts, counts = [], []
    for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        n = 0
        while lo < hi:
            end = _between_words(body, lo, hi, table)
            parts.append(_digests(np.array([0, end - lo]), body[lo:end], table).digests)
            n, lo = n + len(parts[-1]), end
        counts.append(n)
    return Words(np.concatenate(parts), np.array(counts, np.int64))


def _between_words(body: np.ndarray, lo: int, hi: int, table: np.ndarray) -> int:
    """End of a piece from `lo`: after its last byte outside words, or, where one word
    fills it, before the next such byte."""
    end = lo + SLICE_BYTES
    if end >= hi:
        return hi
    gaps = np.flatnonzero(table[body[lo:end]] == 0)
    if len(gaps):
        return lo + int(gaps[-1]) + 1
    while end < hi:
        gaps = np.flatnonzero(table[body[end : end + SLICE_BYTES]] == 0)
        if len(gaps):
            return end + int(gaps[0])
        end += SLICE_BYTES
    return hi


def _digests(offsets: np.ndarray, body: np.ndarray, table: np.ndarray) -> Words:
    if not len(body):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64))
    values = table[body]
    inside = values != 0
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[offsets] = True  # a word ends with its text
    before = np.empty(len(body) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(body), dtype=bool)
    after[:-1] = inside[1:]
    after[-1] = False
    ends = np.flatnonzero(inside & (~after | edge[1:]))
    sums = np.cumsum(values * _power("up", _BASE, len(body)))
    lead = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    digests = mix((sums[ends] - lead) * _power("down", _INVERSE, len(body))[starts])
    return Words(digests, np.diff(np.searchsorted(starts, offsets)))
