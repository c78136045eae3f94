"""Sets of word shingles as sorted 64-bit digests, and their hashed bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gateflow.llm.words import SPACED, mix, slices, word_digests

WIDTH = 5


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct shingles; fewer words make one shingle of
    them all, no words none."""
    weights = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for i, j in slices(texts):
        words = word_digests(texts.slice(i, j - i), SPACED)
        d = words.digests
        rolled = np.zeros(max(0, len(d) - width + 1), np.uint64)
        for k in range(width if len(rolled) else 0):
            rolled += d[k : len(d) - width + 1 + k] * weights[k]
        rolled = mix(rolled)
        at = 0
        for n in words.counts.tolist():
            if n >= width:
                own = np.sort(rolled[at : at + n - width + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif n:
                short = (d[at : at + n] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n


def set_digest(shingles: np.ndarray) -> int:
    """64-bit digest of a set, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(shingles: np.ndarray, times: int) -> bytes:
    """Parity of the shingles in each of 2**k buckets, at least `times` as many as
    shingles and 64, so the map grows with the set and stays telling."""
    size = max(64, 1 << (times * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmap of fewer buckets (bytes) from a larger one: halves by parity."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def linked(shared, total, percent: int):
    """Whether sets with `shared` common and `total` summed sizes reach a Jaccard
    similarity of `percent` / 100, in whole numbers."""
    return 100 * shared >= percent * (total - shared)
