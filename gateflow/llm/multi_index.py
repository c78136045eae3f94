"""Exact inner-product search with an inverted multi-index, and hard negatives from it.

Vectors of whole numbers are cut into two halves, each half has a codebook, and the pair
of nearest codewords is a vector's cell. The score of a query with any row of a cell is
at most, per half, that of its codeword plus the query's length times the codeword's
radius, the largest distance of a row to it. Per query the cells are visited by a heap
over the two sorted lists of half bounds, largest sum first (a multi-sequence).

A query asks for the best rows of one or several windows of scores. A first wave visits
cells until they hold FIRST_ROWS rows and gives each window a floor, its last wanted
score so far. A second wave goes on from there and stops at the first sum below all
floors: no row of any later cell can be among those asked for, so results are exact.

Cells in a row, of SHELF_ROWS rows or one larger cell, stand on a shelf, whose rows are
dealt over blocks. Queries travel in chunks, each with the cells it visits, once to every
shelf; a task scores a chunk against a block as one matrix product. Codebooks are learned from SAMPLE rows at most,
those with the smallest digests of their row number; every row is indexed. What is
broadcast has a size by the codebooks alone: CODEWORDS squared cells at most.
Scores are exact: products in floating point where no sum can pass 2**53, else in whole
numbers of any size; a score that a long cannot hold stops the run.

Rows with a null label or vector, or a component that is null or not finite, take no part.
A shorter vector counts as padded with zeros, an empty one is all zeros. Null ids come
after all others among equal scores and are never anchors. Rows that repeat an id are
rows of their own: each answers for itself, and another row of its id may be its
positive. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateflow.llm.tables import stored

#: Rows a cell should have, codewords of a half at most, rows the codebooks see at most.
CELL_ROWS, CODEWORDS, SAMPLE, STEPS = 64, 128, 16_384, 8
FIRST_ROWS, SHELF_ROWS, BLOCK_ROWS, CHUNK = 2048, 4096, 1024, 256
LEAST, MOST = -(2**62), 2**62


def codebook(points: np.ndarray, size: int) -> np.ndarray:
    """Codewords of points by Lloyd's steps from evenly spaced ones."""
    distinct = np.unique(points, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)]
    for _ in range(STEPS):
        own = nearest_word(points, words)
        counts = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def nearest_word(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * points @ words.T, axis=1)


def distances(points: np.ndarray, words: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - words[own]) ** 2).sum(axis=1))


@dataclass
class Cells:
    """Codebooks of both halves; rows and largest distances per cell."""

    words: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]

    def shelves(self, rows: int) -> np.ndarray:
        """Shelf of each cell: neighbours share one until it has `rows` rows."""
        shelf, held, out = 0, 0, []
        for n in self.counts.ravel().tolist():
            if held and held + n > rows:
                shelf, held = shelf + 1, 0
            out.append(shelf)
            held += n
        return np.array(out, np.int64)

    def half_bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per half: score of each codeword, length of each query, and the bound, which
        has some room for the errors of floating point."""
        out, at = [], 0
        for half, (words, radii) in enumerate(zip(self.words, self.radii, strict=True)):
            part = queries[:, at : at + words.shape[1]]
            at += words.shape[1]
            length = np.sqrt((part * part).sum(axis=1))
            score = part @ words.T
            radius = radii.max(axis=1 - half)
            room = 1 + 1e-9 * length[:, None] * (np.sqrt((words * words).sum(axis=1)) + radius)
            out.append((score, length, score + length[:, None] * radius + room))
        return out

    def visits(self, queries: np.ndarray, floors: np.ndarray | None, ceilings: np.ndarray | None) -> Iterator[list[int]]:
        """Cells each query visits: those of the first wave, or, when `floors` (and the
        highest score of interest) are given, those of the second."""
        (s1, l1, b1), (s2, l2, b2) = self.half_bounds(queries)
        r1, r2 = self.radii
        for q in range(len(queries)):
            order1, order2 = np.argsort(-b1[q], kind="stable").tolist(), np.argsort(-b2[q], kind="stable").tolist()
            first, second = b1[q].tolist(), b2[q].tolist()
            if floors is not None:
                room = (b1[q] - s1[q] - l1[q] * r1.max(axis=1))[:, None] + (b2[q] - s2[q] - l2[q] * r2.max(axis=0))[None, :]
                middle = s1[q][:, None] + s2[q][None, :]
                reach = l1[q] * r1 + l2[q] * r2 + room
                useful = (self.counts > 0) & (middle + reach >= floors[q]) & (middle - reach <= ceilings[q])
            else:
                useful = self.counts > 0
            heap, cells, seen = [(-(first[order1[0]] + second[order2[0]]), 0, 0)], [], 0
            while heap:
                bound, i, j = heapq.heappop(heap)
                a, b = order1[i], order2[j]
                if floors is not None and -bound < floors[q]:
                    break  # certified: every later cell stays below all floors
                if floors is None or seen >= FIRST_ROWS:
                    if useful[a, b]:
                        cells.append(a * len(second) + b)
                seen += int(self.counts[a, b])
                if floors is None and seen >= FIRST_ROWS:
                    break
                if j + 1 < len(order2):
                    heapq.heappush(heap, (-(first[a] + second[order2[j + 1]]), i, j + 1))
                if j == 0 and i + 1 < len(order1):
                    heapq.heappush(heap, (-(first[order1[i + 1]] + second[order2[0]]), i + 1, 0))
            yield cells


def best(scores: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """Which usable scores of each row are among its k largest, ties included."""
    if scores.shape[1] <= k:
        return usable
    held = np.where(usable, scores, LEAST - 1)
    last = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
    return usable & (held >= last[:, None])


def _matrix(data: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(data), kind).reshape(len(data), dim)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal first columns, which come sorted; `most` rows of a group at a time."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        held = []
        for row in group:
            held.append(row)
            if len(held) == most:
                yield key, held
                held = []
        if held:
            yield key, held


class MultiIndex:
    """Index of rows (row, id, label, v): number of the row, id, label, whole numbers."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
        self.n, self.dim = facts["n"], facts["dim"] or 0
        most = facts["most"] or 0
        self.exact = self.dim * most**2 < 2**53
        self.kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        dim, kind = self.dim, self.kind
        padded = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("v", pa.binary())])

        def pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                table = np.zeros((len(sizes), dim), kind)
                table[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                yield _batch([*batch.columns[:3], [r.tobytes() for r in table]], padded)

        self.rows = stored(rows.select("row", "id", "label", "v").mapInArrow(pad, "row long, id long, label long, v binary"), "vectors")
        sample = self._sample().collect()  # SAMPLE vectors at most
        self.cells = self._learned(_matrix([r["v"] for r in sample], dim, kind).astype(float))
        self.blocks = self._filed()

    def _sample(self) -> DataFrame:
        """Vectors of the SAMPLE smallest digests. Each task sends the driver that many rows
        to choose from, so all but about twice as many are left out before. Should there be
        fewer, by chance, codebooks are learned from those: they decide on speed only."""
        digest, rows = F.xxhash64("row"), self.rows
        if self.n > 2 * SAMPLE:
            rows = rows.where(digest < -(2**63) + 2**64 * 2 * SAMPLE // self.n)
        return rows.orderBy(digest, "row").limit(SAMPLE).select("v")

    def _learned(self, points: np.ndarray) -> Cells:
        size = max(1, min(CODEWORDS, isqrt(self.n // CELL_ROWS)))
        half = self.dim // 2
        words = tuple(codebook(p, size) if len(p) else np.zeros((1, p.shape[1])) for p in (points[:, :half], points[:, half:]))
        shape = tuple(len(w) for w in words)
        return Cells(words, np.zeros(shape, np.int64), (np.zeros(shape), np.zeros(shape)))

    def _filed(self) -> DataFrame:
        """(shelf, rows, ids, none, labels, vectors, cells) of blocks of about BLOCK_ROWS
        rows of a shelf; counts and radii of the cells on the way."""
        words, dim, kind = self.cells.words, self.dim, self.kind
        told = pa.schema([("cell", pa.int64()), ("far1", pa.float64()), ("far2", pa.float64()), ("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("v", pa.binary())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _matrix(batch.column(3).to_pylist(), dim, kind).astype(float)
                halves = points[:, : dim // 2], points[:, dim // 2 :]
                own = [nearest_word(p, w) for p, w in zip(halves, words, strict=True)]
                far = [distances(p, w, o) for p, w, o in zip(halves, words, own, strict=True)]
                yield _batch([own[0] * len(words[1]) + own[1], *far, *batch.columns], told)

        filed = stored(self.rows.mapInArrow(assign, "cell long, far1 double, far2 double, row long, id long, label long, v binary"), "cells")
        sizes = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2"))
        for r in sizes.collect():  # a row per cell, CODEWORDS squared at most
            at = divmod(r["cell"], len(words[1]))
            self.cells.counts[at], self.cells.radii[0][at], self.cells.radii[1][at] = r["n"], r["far1"], r["far2"]
        shelves = self.cells.shelves(SHELF_ROWS)
        blocks = -(-np.bincount(shelves, weights=self.cells.counts.ravel()).astype(int) // BLOCK_ROWS)
        places = [(c, int(s), int(blocks[s])) for c, s in enumerate(shelves.tolist())]
        placed = F.broadcast(self.spark.createDataFrame(places, "cell long, shelf long, blocks long"))  # a row per cell
        # rows of a shelf are dealt over its blocks by their number, so a large cell is many blocks
        block = F.pmod(F.xxhash64("row"), "blocks").alias("block")
        dealt = filed.join(placed, "cell").select("shelf", block, "row", "id", "label", "v", "cell")
        names = ("rows", "ids", "none", "labels", "vectors", "cells")
        packed = pa.schema([("shelf", pa.int64()), *((c, pa.binary()) for c in names)])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (shelf, _), group in _groups(batches, 2, BLOCK_ROWS):
                _, _, rows, ids, labels, vectors, cells = zip(*group, strict=True)
                number = lambda x: np.array(x, "<i8").tobytes()
                none = np.array([i is None for i in ids], np.uint8).tobytes()
                columns = number(rows), number([i or 0 for i in ids]), none, number(labels), b"".join(vectors), number(cells)
                yield _batch([[shelf], *([c] for c in columns)], packed)

        sorted_ = dealt.repartition("shelf", "block").sortWithinPartitions("shelf", "block", "row")
        return stored(sorted_.mapInArrow(pack, "shelf long, " + ", ".join(f"{c} binary" for c in names)), "index")

    def _planned(self, queries: DataFrame, chunks: int, windows: int, first: bool) -> DataFrame:
        """(shelf, from, queries of a chunk that visit it): rows, labels, vectors, windows,
        and which cells each visits, counted from the shelf's first."""
        dim, kind = self.dim, self.kind
        cells = self.spark.sparkContext.broadcast((self.cells, self.cells.shelves(SHELF_ROWS)))  # CODEWORDS squared cells
        names = ("q_rows", "q_labels", "q_vectors", "q_low", "q_high", "q_cells")
        schema = pa.schema([("shelf", pa.int64()), ("from", pa.int64()), *((c, pa.binary()) for c in names)])

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, shelf_of = cells.value
            starts = np.searchsorted(shelf_of, np.arange(shelf_of[-1] + 2))
            for _, group in _groups(batches, 1, 2 * CHUNK):
                _, rows, labels, vectors, low, high = zip(*group, strict=True)
                pad = lambda lists, rest: np.array([[*x, *[rest] * (windows - len(x))] for x in lists], np.int64)
                table, low, high = _matrix(vectors, dim, kind), pad(low, MOST), pad(high, LEAST)
                rows, labels = np.array(rows, np.int64), np.array(labels, np.int64)
                floors, ceilings = (None, None) if first else (low.min(axis=1), high.max(axis=1))
                visited = np.zeros((len(rows), len(shelf_of)), bool)
                for q, found in enumerate(known.visits(table.astype(float), floors, ceilings)):
                    visited[q, found] = True
                for shelf, (lo, hi) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                    own = np.flatnonzero(visited[:, lo:hi].any(axis=1))
                    if len(own):
                        bits = np.packbits(visited[own, lo:hi], axis=1).tobytes()
                        yield _batch([[shelf], [lo], *([x[own].tobytes()] for x in (rows, labels, table, low, high)), [bits]], schema)

        chunk = F.pmod(F.xxhash64("row"), F.lit(chunks))
        asked = queries.select(chunk.alias("chunk"), "row", "label", "v", "low", "high")
        # a task per chunk: few bytes, but a heap per query, and merged they were one task
        dealt = asked.repartition(chunks, "chunk").sortWithinPartitions("chunk", "row")
        return dealt.mapInArrow(plan, "shelf long, from long, " + ", ".join(f"{c} binary" for c in names))

    def _scored(self, queries: DataFrame, chunks: int, windows: int, k: int, same: bool, first: bool) -> DataFrame:
        """(query, window, score, id, row): best rows of each visited block."""
        dim, kind, exact = self.dim, self.kind, self.exact
        visits = stored(self._planned(queries, chunks, windows, first), "visits")
        schema = pa.schema([(c, pa.int64()) for c in ("query", "window", "score", "id", "row")])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    own = {name: batch.column(name)[at].as_buffer() for name in batch.schema.names if name not in ("shelf", "from")}
                    number = lambda name: np.frombuffer(own[name], "<i8")
                    q_rows, rows, ids = number("q_rows"), number("rows"), number("ids")
                    none = np.frombuffer(own["none"], np.uint8)
                    visited = np.unpackbits(np.frombuffer(own["q_cells"], np.uint8).reshape(len(q_rows), -1), axis=1)
                    seen = visited[:, number("cells") - batch.column("from")[at].as_py()] > 0
                    low, high = (number(c).reshape(len(q_rows), windows) for c in ("q_low", "q_high"))
                    exactly = np.float64 if exact else object
                    left, right = (np.frombuffer(own[c], kind).reshape(n, dim).astype(exactly) for c, n in (("q_vectors", len(q_rows)), ("vectors", len(rows))))
                    scores = (left @ right.T).astype(np.int64)
                    usable = seen & ((number("q_labels")[:, None] == number("labels")) == same) & (q_rows[:, None] != rows)
                    for w in range(windows):
                        here = usable & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
                        q, r = np.nonzero(best(scores, here, k))
                        if len(q):
                            told = pa.array(ids[r], mask=none[r] > 0)
                            yield _batch([q_rows[q], np.full(len(q), w), scores[q, r], told, rows[r]], schema)

        # chunks come again with each shelf, which files keep once: by the size of its files
        # Spark would send the table whole through the driver, a hundred times as large there
        return visits.hint("merge").join(self.blocks, "shelf").mapInArrow(score, "query long, window long, score long, id long, row long")

    def search(self, queries: DataFrame, asks: DataFrame, n: int, windows: int, k: int, same: bool) -> DataFrame:
        """The k best rows of each window, exactly: (query, window, score, id, row, rank).

        queries: (row, label, v), `n` of them; asks: (query, window, low, high), windows
        numbered from 0 to `windows` - 1 in each query. Rows have the query's label if
        `same`, else another one, and are never the query itself.
        """
        chunks = max(1, -(-n // CHUNK))
        order = Window.partitionBy("query", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        def asking(told: DataFrame) -> DataFrame:
            by_window = F.sort_array(F.collect_list(F.struct("window", "low", "high")))  # `windows` at most
            lists = told.groupBy("query").agg(by_window.alias("w"))
            return queries.join(lists, F.col("row") == F.col("query")).select("row", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))

        seen = stored(ranked(self._scored(asking(asks), chunks, windows, k, same, first=True)), "first-wave")
        floors = seen.where(F.col("rank") == k).select("query", "window", F.col("score").alias("floor"))
        floored = asks.join(floors, ["query", "window"], "left").withColumn("low", F.greatest("low", "floor")).drop("floor")
        more = self._scored(asking(floored), chunks, windows, k, same, first=False)
        return stored(ranked(seen.drop("rank").unionByName(more)), "found")


def usable_vector(vector: str) -> Column:
    """Whether a vector has finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of
    each anchor and each of its best rows of the same label, the best rows of other
    labels whose score is within `percent` of the positive's.

    `anchors` marks anchors over the columns `id` and `label`, and `label` gives the
    label over the columns of `vectors`; components become floor(scale * x).
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(usable_vector(vector)).select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
    rows = stored(rows.where(F.col("label").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "vector-rows")
    index = MultiIndex(rows)
    queries = stored(index.rows.where(anchors & F.col("id").isNotNull()), "anchors")
    n = queries.count()
    every = queries.select(F.col("row").alias("query"), F.lit(0).cast("long").alias("window"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    near = index.search(queries, every, n, 1, positives, same=True)
    low, high = percent
    # low * p <= 100 * x <= high * p in whole numbers
    window = near.select(
        "query",
        (F.col("rank") - 1).cast("long").alias("window"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.expr(f"-((-{low} * score - pmod(-{low} * score, 100L)) div 100L)").alias("low"),
        F.expr(f"({high} * score - pmod({high} * score, 100L)) div 100L").alias("high"),
    )
    window = stored(window, "windows")
    asks = window.where("low <= high").select("query", "window", "low", "high")
    found = index.search(queries, asks, n, positives, negatives, same=False)
    told = window.select("query", "window", "positive_id", "positive_score").join(
        queries.select(F.col("row").alias("query"), F.col("id").alias("anchor_id")), "query"
    )
    return found.join(told, ["query", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
