"""Benchmark decontamination with one FM-index per training shard.

A shard is a stretch of a scan partition's documents with about `shard_words`
words. Its words become numbers in the vocabulary of the phrases; a stretch of
other words is one separator, since no phrase can cross it. Test phrases are
searched backwards in the shard's FM-index, located, and their places merged into
removal spans per document. Shards hold whole documents, so nothing is shuffled
and every row is answered where it was read.

Phrases: `window` consecutive words of an item; an item with fewer words, but not
none, is one phrase. Items are taken in blocks of bounded size; if there are
several blocks, rows are written once with a number, each block is searched over
all rows, and the spans are merged by that number.

Words are compared by 64-bit digests. Null and empty texts have no words. Rows
that repeat an id, and rows without one, are answered row by row. Items with a null
id count under the empty name. An empty item table finds nothing; an empty table gives an empty
result. Very long texts make a shard of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.fm_index import FMIndex
from gateflow.llm.tables import numbered, prepared
from gateflow.llm.words import ALNUM, slices, word_digests

WINDOW = 10
SHARD_WORDS = 1_500_000
#: Bytes of item text that are searched, and broadcast, at a time.
BLOCK_BYTES = 16 << 20


class Phrases:
    """Distinct phrases of a block of items, and which items have each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        words = word_digests(texts, ALNUM)
        self.vocabulary, numbers = np.unique(words.digests, return_inverse=True)
        numbers = numbers + 1  # 0 is every other word
        self.names = [name for name, _ in items]
        by_phrase: dict[tuple[int, ...], list[int]] = {}
        at = 0
        for k, n in enumerate(words.counts.tolist()):
            own = numbers[at : at + n].tolist()
            at += n
            for i in range(max(1, n - window + 1) if n else 0):
                have = by_phrase.setdefault(tuple(own[i : i + window]), [])
                if not have or have[-1] != k:
                    have.append(k)
        phrases = sorted(by_phrase, key=lambda p: (len(p), p))
        self.items = [np.asarray(by_phrase[p]) for p in phrases]
        self.by_length: list[tuple[int, np.ndarray]] = []  # (index of the first, phrases of one length)
        lengths = [len(p) for p in phrases]
        for size in sorted(set(lengths)):
            i = lengths.index(size)
            self.by_length.append((i, np.asarray([p for p in phrases if len(p) == size], np.int64)))

    def number(self, digests: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(digests), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, digests), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == digests, at + 1, 0).astype(np.int32)


def search(counts: np.ndarray, numbers: np.ndarray, phrases: Phrases) -> list[tuple[list[list[int]], list[int]]]:
    """Of each document of a shard: merged spans [start, end) of its words, items."""
    total = len(numbers)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    found = [([], []) for _ in counts]
    known = np.flatnonzero(numbers)
    if not len(known):
        return found
    # a separator wherever the next known word isn't the next word of the same text
    text = np.searchsorted(bounds, known, side="right")
    joined = (np.diff(known) == 1) & (np.diff(text) == 0)
    step = np.concatenate([[0], np.cumsum(np.where(joined, 1, 2))])
    seq = np.zeros(step[-1] + 2, np.int64)
    seq[step] = numbers[known]
    place = np.zeros(len(seq), np.int64)
    place[step] = known
    index = FMIndex(seq, len(phrases.vocabulary) + 1)
    starts, sizes, which = [], [], []
    for first, table in phrases.by_length:
        low, high = index.ranges(table)
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        if not len(hit):
            continue
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        starts.append(place[index.locate(rows)])
        sizes.append(np.full(len(rows), table.shape[1]))
        which.append(np.repeat(first + hit, times))
    if not starts:
        return found
    start, which = np.concatenate(starts), np.concatenate(which)
    cover = np.zeros(total + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + np.concatenate(sizes), -1)
    hit = np.cumsum(cover[:-1]) > 0
    document = np.searchsorted(bounds, start, side="right") - 1
    for d, w in np.unique(np.stack([document, which], 1), axis=0).tolist():
        found[d][1].extend(phrases.items[w].tolist())
    for d in np.unique(document).tolist():
        own = np.concatenate([[False], hit[bounds[d] : bounds[d + 1]], [False]])
        edges = np.flatnonzero(own[1:] != own[:-1])
        found[d][0].extend(edges.reshape(-1, 2).tolist())
        found[d][1][:] = sorted(set(found[d][1]))
    return found


_OUT = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_DDL = "n_words long, spans array<array<bigint>>, items array<string>"


def _searched(docs: DataFrame, items: list[tuple[str, str | None]], window: int, shard_words: int) -> DataFrame:
    """(id, n_words, spans, items) of rows (id, text); ids of any type pass through."""
    given = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES of text

    def answer(ids: list, counts: list, numbers: list, phrases: Phrases) -> pa.RecordBatch:
        n_words = np.concatenate(counts)
        found = search(n_words, np.concatenate(numbers), phrases)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(ids),
                pa.array(n_words, pa.int64()),
                pa.array([s for s, _ in found], _OUT.field("spans").type),
                pa.array([[phrases.names[i] for i in own] for _, own in found], _OUT.field("items").type),
            ],
            names=["id", *_OUT.names],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(given.value, window)
        ids, counts, numbers, held = [], [], [], 0
        for batch in batches:
            for i, j in slices(batch.column(1)):
                words = word_digests(batch.column(1).slice(i, j - i), ALNUM)
                ids.append(batch.column(0).slice(i, j - i))
                counts.append(words.counts)
                numbers.append(phrases.number(words.digests))
                held += len(words.digests)
                if held >= shard_words:
                    yield answer(ids, counts, numbers, phrases)
                    ids, counts, numbers, held = [], [], [], 0
        if ids:
            yield answer(ids, counts, numbers, phrases)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, {_DDL}")


def _blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of about `limit` bytes, each made when it is asked for."""
    block, size = [], 0
    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).toLocalIterator():
        block.append((row[0], row[1]))
        size += 64 + len((row[1] or "").encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
    id_type: str = "long",
) -> DataFrame:
    """One row per row of `docs`: id (as `id_type`), n_words, spans (merged, of words), n_hit,
    item_ids (sorted as strings, distinct), n_items, contaminated."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast(id_type).alias("id"), F.col(text).alias("text"))
    blocks = _blocks(items, item_id, item_text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = _searched(rows, first, window, shard_words)
    else:
        rows, row = numbered(rows)
        rows = rows.select(F.struct(F.col(row).alias("row"), "id").alias("id"), "text")
        out = reduce(DataFrame.union, (_searched(rows, b, window, shard_words) for b in chain([first, second], blocks)))
        out = out.groupBy("id").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
        out = out.withColumn("spans", merged("spans")).withColumn("id", F.col("id")["id"])
    items_of = F.array_sort(F.array_distinct("items"))
    return out.select(
        F.col("id").alias(doc_id),
        "n_words",
        "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        items_of.alias("item_ids"),
        F.size(items_of).cast("long").alias("n_items"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def merged(spans: str):
    """Spans of several blocks as one list without overlaps."""
    empty = F.array().cast("array<array<bigint>>")

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(done) > 0) & (s[0] <= F.try_element_at(done, F.lit(-1))[1]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def items_digest(item_ids: str):
    """SHA-256 of sorted item ids joined by commas."""
    return F.sha2(F.concat_ws(",", item_ids), 256)
