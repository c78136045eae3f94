import random

import numpy as np
import pyarrow as pa
from brute import alnum, spaced

from gateflow.llm.fm_index import FMIndex
from gateflow.llm.words import ALNUM, SPACED, slices, word_digests

TEXTS = ["", None, "One two", "  a\tb\nA ", "é É ß x1-x2", "a" * 5000, "x y " * 900, "\x1f\x00z", "日本 語"]


def test_digests_are_those_of_words():
    for table, words in ((SPACED, spaced), (ALNUM, alnum)):
        found = word_digests(pa.array(TEXTS), table)
        want = [words(t) for t in TEXTS]
        assert found.counts.tolist() == [len(w) for w in want]
        flat = [w for own in want for w in own]
        by = {}
        for w, d in zip(flat, found.digests.tolist(), strict=True):
            assert by.setdefault(w, d) == d
        assert len(set(by.values())) == len(by)


def test_slices_cover_texts_once():
    texts = pa.array(["ab" * k for k in range(40)] + [None, ""])
    for limit in (1, 30, 10_000):
        ranges = list(slices(texts, limit))
        assert [i for i, j in ranges for i in range(i, j)] == list(range(len(texts)))
    assert list(slices(pa.array([], pa.string()))) == []


def test_index_finds_every_place():
    rng = np.random.default_rng(1)
    for _ in range(40):
        size = int(rng.integers(2, 9))
        seq = np.append(rng.integers(0, size, rng.integers(1, 150)), 0)
        index = FMIndex(seq, size, rate=int(rng.integers(1, 9)))
        for m in (1, 2, 4):
            patterns = rng.integers(1, size, (15, m))
            for p, low, high in zip(patterns, *index.ranges(patterns), strict=True):
                want = [i for i in range(len(seq) - m + 1) if (seq[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_long_repeats_are_sorted():
    random.seed(3)
    part = [random.randint(1, 5) for _ in range(300)]
    seq = np.array(part * 4 + [0] + part * 2 + [0])
    index = FMIndex(seq, 6)
    low, high = index.ranges(np.array([part[:50]]))
    assert high[0] - low[0] == 6
