"""Byte-level BPE encoding and decoding of whole texts, by tree concatenation.

A text is cut into leaves of at most `leaf` characters. A cut stands, if it can,
where the vocabulary's split pattern always parts a text: before white space that
follows something else, or between a letter and a digit, or before a sign that
follows a letter or digit, or beside a special token. Tokens on both sides of such a cut join as they are.
Text without such a place is one long run of a single kind of character, which the
pattern keeps in one piece; it is cut inside the run. There the halves are encoded
apart, and a window of tokens around the join is encoded again and grown until it
begins with a token of the left half and ends with a token of the right half at
the same places. Every pair of neighbours then stands in the encoding of one
string, which is what makes a BPE encoding of the whole run.

Leaves of long texts are rows of their own, so the leaves of one text are encoded
by many tasks; joins of neighbours go up a tree, two halves at a time.

Null counts as empty; an empty text has no tokens. Rows are independent: repeated
rows give repeated rows (long texts are told apart by a row number), an empty
table gives an empty result. The special token is found as ordinary text finds
it, and its place never lies across a cut.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import prepared, stored

#: Characters of a leaf, and tokens on each side of a window at first.
LEAF = 1 << 14
WINDOW = 8
#: A cut is sought in ranges of this many characters at least.
RANGE = 128
_KIND = regex.compile(r"(?P<space>\p{White_Space})|(?P<letter>\p{L})|(?P<digit>\p{N})")
#: The split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte for each character by which vocabulary files write a byte: printable
    ones as themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Encoder and decoder of a vocabulary file's content (JSON text)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in self.special:  # special tokens may be listed among the others
            ranks.pop(t.encode(), None)
        self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of: list[bytes] = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.in_special = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        self.longest_special = max(map(len, self.special), default=0)

    def leaf(self, text: str) -> list[int]:
        return self.coder.encode(text, allowed_special="all")

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def cut(self, text: str, lo: int, hi: int) -> tuple[int, bool]:
        """Place of a cut in text[lo:hi], and whether it lies inside a run.

        The last safe place in the range is taken, else one within the run.
        """
        edges = [e for m in self._special_near(text, lo, hi) for e in m.span() if lo <= e < hi]
        if edges:  # what stands on either side of a special token is encoded apart
            return max(edges), False
        kinds = [kind(c) for c in text[lo - 1 : hi]]
        for i in range(len(kinds) - 1, 0, -1):
            a, b = kinds[i - 1], kinds[i]
            if a != b and a != "space" and (b == "space" or a in ("letter", "digit")):
                if not self._within_special(text, lo - 1 + i):
                    return lo - 1 + i, False
        # no such place: white space, then signs, then letters or digits at most,
        # so the longest run takes a third of the range
        ends = [i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]]
        runs = list(zip([0, *ends], [*ends, len(kinds)], strict=True))
        start, end = max(runs, key=lambda r: r[1] - r[0])
        return lo - 1 + (start + end) // 2, True

    def _within_special(self, text: str, at: int) -> bool:
        return any(m.start() < at < m.end() for m in self._special_near(text, at, at))

    def _special_near(self, text: str, lo: int, hi: int):
        if self.in_special is None:
            return []
        w = self.longest_special
        return self.in_special.finditer(text, max(0, lo - w), hi + w)

    def leaves(self, text: str, size: int = LEAF) -> list[tuple[str, bool]]:
        """Leaves in order; the flag tells that the cut before a leaf is in a run."""
        if size < 2 * RANGE:
            raise ValueError(f"leaves need at least {2 * RANGE} characters")
        out, at, within = [], 0, False
        while len(text) - at > size:
            place, inside = self.cut(text, at + size - RANGE, at + size)
            if inside:
                place, inside = self.cut(text, at + size // 2, at + size)
            out.append((text[at:place], within))
            at, within = place, inside
        return [*out, (text[at:], within)]

    def concatenate(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of a run's text from those of its halves; only the tokens of
        the run around the join may change."""
        n = WINDOW
        while True:
            a, d = max(0, len(left) - n), min(n, len(right))
            a, d = self._whole(left, a, -1), self._whole(right, d, 1)
            inner = self._run(left[a:], right[:d])
            if inner is not None:
                i, j = inner
                window = left[a + i :] + right[:j]
                again = self.leaf(b"".join(map(self.bytes_of.__getitem__, window)).decode())
                # a side that reaches the run's own end needs no agreement there
                free_left, free_right = a + i == 0 or i > 0, j == len(right) or j < d
                if (free_left or again[0] == window[0]) and (free_right or again[-1] == window[-1]):
                    return left[: a + i] + again + right[j:]
            n *= 2

    def _whole(self, ids: list[int], at: int, step: int) -> int:
        """Nearest place from `at` on that parts two characters."""
        while 0 < at < len(ids) and self.bytes_of[ids[at]][0] & 0xC0 == 0x80:
            at += step
        return at

    def _run(self, left: list[int], right: list[int]) -> tuple[int, int] | None:
        """Part of the window that belongs to the run across the join: tokens
        left[i:] and right[:j]. A token that also holds other characters (the
        blank before a word) begins the run and belongs to it."""
        text = [self.bytes_of[t] for t in left], [self.bytes_of[t] for t in right]
        before, after = (b"".join(x).decode("utf-8", "replace") for x in text)
        if not before or not after:
            return None
        k = kind(before[-1])
        start = len(before)
        while start and kind(before[start - 1]) == k:
            start -= 1
        end = 0
        while end < len(after) and kind(after[end]) == k:
            end += 1
        if start and k != "space" and before[start - 1] == " ":
            start -= 1
        if k == "space" and end < len(after):
            end -= 1  # the last blank goes with what follows
        at, i = len(before[:start].encode()), 0
        while at > 0:
            at -= len(text[0][i])
            i += 1
        at, j = len(after[:end].encode()), 0
        while at > 0 and at >= len(text[1][j]):
            at -= len(text[1][j])
            j += 1
        return i, j

    def tree(self, parts: list[tuple[list[int], bool]]) -> list[int]:
        """Join neighbours two at a time until one encoding is left."""
        while len(parts) > 1:
            up = []
            for i in range(0, len(parts) - 1, 2):
                (left, flag), (right, inside) = parts[i], parts[i + 1]
                up.append((self.concatenate(left, right) if inside else left + right, flag))
            parts = up + parts[len(up) * 2 :]
        return parts[0][0]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Whole text in this process, by the same leaves and joins."""
        return self.tree([(self.leaf(t), inside) for t, inside in self.leaves(text, leaf)])


@lru_cache(1 << 16)
def kind(c: str) -> str:
    m = _KIND.match(c)
    return m.lastgroup if m else "sign"


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(content) -> Vocabulary:
    """The worker's vocabulary, from a broadcast of the file's content."""
    if content.value not in _loaded:
        _loaded.clear()
        _loaded[content.value] = Vocabulary(content.value)
    return _loaded[content.value]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def _mapped(one: Callable, schema: pa.Schema, flat: bool = False):
    """mapInArrow function that applies `one` to each row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                made = one(*(v.as_py() for v in row))
                out.extend(made if flat else [made])
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names
            )

    return run


_CODED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGEST = pa.schema(
    [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
_LEAF = pa.schema(
    [("row", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("leaves", pa.int64()), ("inside", pa.bool_()), ("leaf", pa.string())]
)
_PART = pa.schema(
    [("row", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("leaves", pa.int64()), ("inside", pa.bool_()), ("ids", pa.binary())]
)
_TYPES = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema)


def bpe(
    docs: DataFrame,
    vocabulary_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    digests: bool = False,
    leaf: int = LEAF,
) -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids (packed) and decoded text.

    With `digests` the last two are given as SHA-256 in hex, made where the ids
    are, so neither ids nor decoded texts are moved.
    """
    spark = docs.sparkSession
    prepared(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB
    out = _DIGEST if digests else _CODED
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def result(i, ids: list[int], v: Vocabulary) -> tuple:
        data, decoded = packed(ids), v.decode(ids)
        if not digests:
            return i, len(ids), data, decoded
        return i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def short(i, t: str) -> tuple:
        v = _vocabulary(content)
        return result(i, v.leaf(t), v)

    def split(row, i, t: str) -> list[tuple]:
        parts = _vocabulary(content).leaves(t, leaf)
        return [(row, i, k, len(parts), inside, piece) for k, (piece, inside) in enumerate(parts)]

    def encode(row, i, place, leaves, inside, piece: str) -> tuple:
        return row, i, place, leaves, inside, packed(_vocabulary(content).leaf(piece))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves come sorted by text and place; one text is held at a time."""
        v, held = _vocabulary(content), []
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                held.append((np.frombuffer(row["ids"], "<u4").tolist(), row["inside"]))
                if len(held) == row["leaves"]:
                    made.append(result(row["id"], v.tree(held), v))
                    held = []
            columns = list(zip(*made, strict=True)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], names=out.names
            )

    done = rows.where(F.length("text") <= leaf).mapInArrow(_mapped(short, out), _ddl(out))
    long = rows.where(F.length("text") > leaf).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    # row numbers are settled by writing the leaves once
    leaves = stored(long.mapInArrow(_mapped(split, _LEAF, flat=True), _ddl(_LEAF)), "bpe-leaves")
    parts = leaves.repartition(F.col("row"), F.col("place")).mapInArrow(_mapped(encode, _PART), _ddl(_PART))
    joined = parts.repartition("row").sortWithinPartitions("row", "place").mapInArrow(join, _ddl(out))
    return done.union(joined).withColumnsRenamed({"id": doc_id})
