"""N-gram Jaccard self-join: size-banded tiles, hashed bitmaps, exact intersection.

Sets are the distinct word shingles of a text. Equal sets are one node from the
start. Two sets that reach the similarity share one of the first
n - ceil(n * similarity) + 1 shingles of each, in any fixed order of shingles;
the order here puts shingles that are frequent in some stretch of the table last.

A tile holds the nodes with such a shingle whose sizes lie in one band or the next
(bands are as wide as the similarity lets sizes differ). Tiles with one node go.

1. In each tile all nodes of a band are paired with the first of them, as many
   pairs as nodes. Bitmaps, one bit per bucket of hashed shingles, bound the
   overlap from above: where k bits differ, at least k shingles are in one set
   only. Pairs that pass are compared by exact intersection of sorted arrays.
2. Components of the links found so far make most tiles one component. In tiles
   that hold several, nodes of different components are held against sizes and
   bitmaps; of the pairs that pass, a spanning forest, the most similar bitmaps
   first, is compared exactly. Large groups so grow together by about as many
   comparisons as nodes. Nodes without a partner that passes are out from then on,
   and the others go on with larger bitmaps.
3. What pairs of different components are left then, all those that pass sizes and
   bitmaps, are compared exactly. Tiles are cut into blocks and the pairs of blocks
   dealt out, so a hot tile is many tasks.

Each pair that reaches the similarity is so either compared or in one component
already: no link between components is lost, and no group is expanded into all
its pairs. Sets are held by 64-bit digests of their shingles.

Null, empty and blank texts have no shingles, link with nothing and are their own
component. Rows that repeat an id or a text are answered row by row; equal texts
share a component. A null id never names a component of several rows unless all
their ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.components import components
from gateflow.llm.shingles import WIDTH, bitmap, folded, linked, set_digest, shingle_sets
from gateflow.llm.tables import prepared, stored

PERCENT = 75
#: Frequent shingles: seen so often among this many shingles of one task, and so
#: many of them kept (the most frequent). They only set the order of shingles.
STRETCH, OFTEN, FREQUENT = 1_000_000, 6, 200_000
#: Nodes of a block of a tile; rounds that compare forests before all pairs.
BLOCK, FORESTS = 1_000, 2


def band(n: int, percent: int) -> int:
    """Sets of a band or of neighbouring bands may reach the similarity, others not."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _batch(columns: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def frequent(docs: DataFrame, width: int) -> DataFrame:
    """(shingle, n) of the most frequent shingles; n counts texts, in stretches where it is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def often():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            pick = counts >= OFTEN
            return _batch([values[pick].view(np.int64), counts[pick]], ["shingle", "n"], [pa.int64(), pa.int64()])

        for batch in batches:
            for own in shingle_sets(batch.column(0), width):
                held.append(own)
                size += len(own)
                if size >= STRETCH:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    seen = docs.select("text").mapInArrow(run, "shingle long, n long")
    return seen.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT)


class Order:
    """Order of shingles: frequent ones last, by the power of two of their count."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by = np.argsort(shingles)
        self.shingles = shingles[by]
        self.levels = np.log2(np.maximum(counts[by], 1)).astype(np.int64) + 1
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.shingles & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def first(self, own: np.ndarray, k: int) -> np.ndarray:
        """The first k of a sorted set."""
        maybe = np.flatnonzero(self.maybe[(own & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(maybe):
            return own[:k]
        at = np.minimum(np.searchsorted(self.shingles, own[maybe]), len(self.shingles) - 1)
        level = np.zeros(len(own), np.int64)
        level[maybe] = np.where(self.shingles[at] == own[maybe], self.levels[at], 0)
        return own[np.argsort(level, kind="stable")[:k]]


def nodes_of(docs: DataFrame, width: int) -> DataFrame:
    """(id, key, sid, n, bits, fine) per document; key is a digest of the text, sid
    null without shingles. The last two are bitmaps, `fine` with four times as many
    buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, ns, bits, fine = [], [], [], []
            for own in shingle_sets(batch.column(1), width):
                ns.append(len(own))
                sids.append(set_digest(own) if len(own) else None)
                bits.append(bitmap(own, 1) if len(own) else None)
                fine.append(bitmap(own, 4) if len(own) else None)
            yield _batch(
                [batch.column(0), batch.column(2), sids, ns, bits, fine],
                ["id", "key", "sid", "n", "bits", "fine"],
                [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()],
            )

    keyed = docs.select("id", "text", F.xxhash64("text").alias("key"))
    return keyed.mapInArrow(run, "id long, key long, sid long, n long, bits binary, fine binary")


def tile_rows(docs: DataFrame, often: DataFrame, width: int, percent: int) -> DataFrame:
    """(shingle, band, sid): each set under its first shingles; copies that are met
    in one batch are given once."""
    pairs = often.toArrow()  # at most FREQUENT rows
    given = docs.sparkSession.sparkContext.broadcast(
        (pairs.column(0).to_numpy().astype(np.int64).view(np.uint64), pairs.column(1).to_numpy())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*given.value)
        for batch in batches:
            firsts, bands, sids, met = [], [], [], set()
            for own in shingle_sets(batch.column(1), width):
                if not len(own) or (sid := set_digest(own)) in met:
                    continue
                met.add(sid)
                firsts.append(order.first(own, prefix(len(own), percent)))
                bands.append(band(len(own), percent))
                sids.append(sid)
            if not firsts:
                continue
            sizes = [len(f) for f in firsts]
            yield _batch(
                [np.concatenate(firsts).view(np.int64), np.repeat(np.array(bands, np.int32), sizes), np.repeat(np.array(sids, np.int64), sizes)],
                ["shingle", "band", "sid"],
                [pa.int64(), pa.int32(), pa.int64()],
            )

    return docs.mapInArrow(run, "shingle long, band int, sid long")


def _by_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut so that a shingle's rows come together unless
    they are more than a batch; a cut then repeats the rows of the last band."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols]
            held = [c[cut:] for c in cols]
        elif len(cols[0]) >= 200_000:
            yield cols
            keep = np.flatnonzero(cols[1] == cols[1][-1])[:1]  # the pivot of the open band
            held = [c[keep] for c in cols]
        else:
            held = cols
    if held is not None and len(held[0]):
        yield held


def tiles(rows: DataFrame) -> DataFrame:
    """(shingle, band, pivot, sid) of nodes that have company: one row per node and
    shingle, pivot the first node of the band; with company only in the next band,
    the first node of that band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, bands, sid in _by_shingle(batches):
            new = np.append(True, (shingle[1:] != shingle[:-1]) | (bands[1:] != bands[:-1]) | (sid[1:] != sid[:-1]))
            shingle, bands, sid = shingle[new], bands[new], sid[new]
            begins = np.append(True, (shingle[1:] != shingle[:-1]) | (bands[1:] != bands[:-1]))
            start = np.flatnonzero(begins)
            size = np.diff(np.append(start, len(sid)))
            near = np.zeros(len(start), bool)  # the next group is the next band of the same shingle
            near[:-1] = (shingle[start[1:]] == shingle[start[:-1]]) & (bands[start[1:]] == bands[start[:-1]] + 1)
            after = np.append(False, near[:-1])
            keep = (size > 1) | near | after
            pivot = sid[start]
            # the pivot of a band is itself paired with the pivot of the next
            lead = np.where(near, np.append(pivot[1:], 0), pivot)
            group = np.cumsum(begins) - 1
            pivots = pivot[group]
            pivots[start] = lead
            rows = keep[group]
            if rows.any():
                yield _batch(
                    [shingle[rows], bands[rows], pivots[rows], sid[rows]],
                    ["shingle", "band", "pivot", "sid"],
                    [pa.int64(), pa.int32(), pa.int64(), pa.int64()],
                )

    return rows.repartition("shingle").sortWithinPartitions("shingle", "band", "sid").mapInArrow(
        run, "shingle long, band int, pivot long, sid long"
    )


def bound(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Shingles that are in one set of each pair only, at least."""
    out = np.empty(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        size = min(len(x), len(y))
        out[i] = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return out


def passing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and bitmaps let them be similar."""
    side = lambda x: nodes.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * low >= percent * high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = bound(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            keep = linked((n - apart) // 2, n, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def exact(pairs: DataFrame, docs: DataFrame, ids: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity, by intersection of sorted arrays.

    `ids` names a document for each node, by id and digest of its text, as ids may be
    null or repeat; only those texts are cut into shingles again, so no array is kept
    for nodes without a candidate.
    """
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct().join(ids, "sid")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(set_digest(own), own) for own in shingle_sets(batch.column(1), width)]
            mine = {s: own.tobytes() for (s, own), sid in zip(sets, batch.column(0).to_pylist(), strict=True) if s == sid}
            yield _batch([list(mine), list(mine.values())], ["sid", "own"], [pa.int64(), pa.binary()])

    named = F.col("doc.id").eqNullSafe(F.col("node.id")) & (F.xxhash64("doc.text") == F.col("node.key"))
    texts = docs.alias("doc").join(wanted.alias("node"), named).select("node.sid", "doc.text")
    sets = stored(texts.mapInArrow(arrays, "sid long, own binary").dropDuplicates(["sid"]), "ngram-sets")
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("own").alias(f"own_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(linked(shared, len(x) + len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def apart(n: np.ndarray, label: np.ndarray, bits: list[bytes], side: np.ndarray, percent: int):
    """Pairs (i, j) of a cell's rows that labels, sizes and bitmaps allow, and the
    share of their summed sizes that lies in one set only, at least."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    alone = not len(right)
    if alone:
        right = left
    n_l, n_r = n[left][:, None], n[right][None, :]
    ok = (label[left][:, None] != label[right][None, :]) & (100 * n_r >= percent * n_l) & (100 * n_l >= percent * n_r)
    i, j = np.nonzero(np.triu(ok, 1) if alone else ok)
    i, j = left[i], right[j]
    if not len(i):
        return i, j, np.zeros(0, np.float32)
    words = np.array([len(x) // 8 for x in bits])
    width = np.minimum(words[i], words[j])
    total = n[i] + n[j]
    differ = np.empty(len(i), np.int64)
    for w in np.unique(width).tolist():
        these = np.flatnonzero(width == w)
        rows, at = np.unique(np.concatenate([i[these], j[these]]), return_inverse=True)
        maps = np.stack([folded(np.frombuffer(bits[k], np.uint64), w) for k in rows.tolist()])
        for lo in range(0, len(these), 20_000):
            part = slice(lo, min(lo + 20_000, len(these)))
            x, y = maps[at[: len(these)][part]], maps[at[len(these) :][part]]
            differ[these[part]] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    passes = linked((total - differ) // 2, total, percent)
    return i[passes], j[passes], (differ[passes] / total[passes]).astype(np.float32)


def forest(i: np.ndarray, j: np.ndarray, share: np.ndarray, label: np.ndarray) -> list[int]:
    """Pairs (their places) of a spanning forest of the components, least share
    first: each component offers its best pair to another, until none has one."""
    root = np.unique(label, return_inverse=True)[1]
    order = np.argsort(share, kind="stable")
    kept = []
    while len(order):
        order = order[root[i[order]] != root[j[order]]]
        if not len(order):
            break
        # the first pair in order of each component, on either side
        ends = np.stack([root[i[order]], root[j[order]]], axis=1).ravel()
        first = np.unique(np.unique(ends, return_index=True)[1] // 2)
        for k in order[first].tolist():
            x, y = root[i[k]], root[j[k]]
            if x != y:
                root[root == max(x, y)] = min(x, y)
                kept.append(k)
    return kept


ACTIVE = "a long, b long, shingle long"


def across(rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs (a, b) of different components in one cell whose sizes and bitmaps
    pass: all of them, or a forest per cell. Rows: shingle, i, j (cell), side, n,
    sid, label, bits, sorted by cell.

    The left block of a cell meets the right one; a block meets itself in the cell
    (i, i). Besides pairs (shingle null), each node that some partner passes with is
    given as (a, null, shingle): only those can be in a pair later, as components
    only grow together.
    """

    def compare(shingle: int, cell: list[np.ndarray], bits: list[bytes], met: set) -> None:
        side, n, sid, label = cell
        if len(label) < 2 or (label == label[0]).all():
            return
        i, j, share = apart(n, label, bits, side, percent)
        if not len(i):
            return
        met.update((x, None, shingle) for x in np.unique(sid[np.concatenate([i, j])]).tolist())
        if not all_pairs:
            kept = np.array(forest(i, j, share, label), np.int64)
            i, j = i[kept], j[kept]
        low, high = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
        met.update((a, b, None) for a, b in zip(low.tolist(), high.tolist(), strict=True))

    def out(met: set) -> pa.RecordBatch:
        rows = list(met)
        return _batch([[r[k] for r in rows] for k in range(3)], ["a", "b", "shingle"], [pa.int64()] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[np.ndarray] | None = None  # rows of the last cell, which may go on
        bits: list[bytes] = []
        met: set = set()

        def cells_of(last: bool):
            """Compare the whole cells that are held; what remains may go on."""
            key = columns[:3]
            edge = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            bounds = [0, *edge.tolist(), *([len(key[0])] if last else [])]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    compare(int(key[0][lo]), [c[lo:hi] for c in columns[3:]], bits[lo:hi], met)
            return bounds[-1]

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            columns = own if columns is None else [np.concatenate([a, b]) for a, b in zip(columns, own, strict=True)]
            bits = bits + batch.column(7).to_pylist()
            done = cells_of(last=False)
            columns, bits = [c[done:] for c in columns], bits[done:]
            if len(met) > 100_000:
                yield out(met)
                met.clear()
        if columns is not None and len(columns[0]):
            cells_of(last=True)
        yield out(met)

    return rows.mapInArrow(run, ACTIVE)


def cells(found: DataFrame, nodes: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Rows of `across`: tiles that hold several components, in pairs of blocks."""
    here = found.select("shingle", "sid").join(labels, "sid", "left").select("shingle", "sid", F.coalesce("label", "sid").alias("label"))
    mixed = (
        here.groupBy("shingle")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m"))
        .where("low < high")
        .select("shingle", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    dealt = (
        here.join(mixed, "shingle")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "shingle",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "sid",
            "label",
        )
    )
    return (
        dealt.join(nodes, "sid")
        .select("shingle", "i", "j", "side", "n", "sid", "label", "bits")
        .repartition("shingle", "i", "j")
        .sortWithinPartitions("shingle", "i", "j")
    )


def merged(labels: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(sid, label) after links (a, b), `most` of them, between nodes have tied their components."""
    for x in ("a", "b"):
        known = labels.select(F.col("sid").alias(x), F.col("label").alias(f"label_{x}"))
        links = links.join(known, x, "left").withColumn(x, F.coalesce(f"label_{x}", x)).drop(f"label_{x}")
    over = stored(components(links, most), "ngram-labels", 2 * most).select(F.col("node").alias("label"), F.col("label").alias("top"))
    alone = over.select(F.col("label").alias("sid"), "top").join(labels.select("sid"), "sid", "left_anti")
    grown = labels.join(over, "label", "left").select("sid", F.coalesce("top", "label").alias("label"))
    return grown.union(alone)


def ngram_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id that
    links reach)."""
    prepared(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = stored(nodes_of(docs, width), "ngram-profiles")
    sets = profiles.where("sid is not null")
    # the document that stands for a node: the smallest id, null after all others
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")
    nodes = sets.groupBy("sid").agg(first, F.max("n").alias("n"), F.max("bits").alias("bits"))
    nodes = stored(nodes.select("sid", "first.id", "first.key", "n", "bits"), "ngram-nodes")
    ids, maps = nodes.select("id", "key", "sid"), nodes.select("sid", "n", "bits")
    found = stored(tiles(tile_rows(docs, frequent(docs, width), width, percent)), "ngram-tiles")

    stars = found.where("pivot <> sid").select(F.least("pivot", "sid").alias("a"), F.greatest("pivot", "sid").alias("b")).distinct()
    near = stored(passing(stars, maps, percent), "ngram-pairs")
    links = stored(exact(near, docs, ids, width, percent), "ngram-links", near.count())
    n = links.count()
    labels = stored(components(links, n), "ngram-labels", 2 * n).withColumnRenamed("node", "sid")
    tested, active, by = near, found, maps
    for step in range(FORESTS + 1):
        met = stored(across(cells(active, by, labels, block), percent, step == FORESTS), "ngram-met")
        given = met.where("b is not null").select("a", "b").distinct()
        if given.isEmpty():  # no pair of different components passes any more
            break
        fresh = stored(given.join(tested, ["a", "b"], "left_anti"), "ngram-pairs", met.count())
        links = stored(exact(fresh, docs, ids, width, percent), "ngram-links", fresh.count())
        if n := links.count():
            labels = stored(merged(labels, links, n), "ngram-labels", labels.count() + 2 * n)
        tested = tested.union(fresh)
        active = met.where("b is null").select("shingle", F.col("a").alias("sid")).distinct()
        # the nodes left are few: larger bitmaps exclude nearly all that aren't similar
        left = nodes.select("id", "sid").join(active.select("sid").distinct(), "sid").alias("node")
        own = F.col("profile.id").eqNullSafe(F.col("node.id")) & (F.col("profile.sid") == F.col("node.sid"))
        by = profiles.alias("profile").join(left, own)
        by = by.select("profile.sid", "profile.n", F.col("profile.fine").alias("bits")).dropDuplicates(["sid"])
    groups = labels.withColumnRenamed("label", "top")

    smallest = nodes.join(groups, "sid").groupBy("top").agg(F.min("id").alias("component_id"))
    named = groups.join(smallest, "top").select("sid", "component_id")
    own = sets.groupBy("sid").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    answer = stored(
        own.join(named, "sid", "full").select("sid", F.coalesce("component_id", "least").alias("component_id")), "ngram-components", nodes.count()
    )
    return profiles.join(answer, "sid", "left").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
