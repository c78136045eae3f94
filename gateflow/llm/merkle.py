"""Merkle manifest of a dataset: a persistent tree whose versions share nodes.

Each row is a leaf, the digest of its fields. The leaves of one source, in ascending
order of their id, make a tree: while several nodes remain, every WIDTH consecutive ones
become the digest of their digests (as hex text). The sources' roots, in order of the
source, make one more tree the same way, whose root stands for the dataset.

Nodes are never changed. A tampered leaf makes a version of the tree: only the leaf's
ancestors are copied, all other nodes are shared with the original. Aligned blocks of
SPAN nodes are worked on in one task, two levels at a time: on the way up a block gives
its top node to the next round; on the way down it gets the siblings on its own way to
the root, copies the ancestors inside itself and goes on copying along that way. So
each block makes its versions alone, whatever block of an upper round they meet in.

Nothing larger than a block is held in one task: a source that has most of the rows is
as many blocks as it needs. Places of leaves come from a range sort and the counts of
its tasks. Rounds and levels follow from the number of leaves; that is the one number
the driver sees.

A null field is written as `-`, an empty text as a text of no bytes. Null sources are a
source of their own, the first; null ids come first in their source. Rows that repeat an
id stand in the order of their leaves; equal leaves cannot be told apart, and each has
its own place. A tree of a single leaf has that leaf as root. An empty table has no
root, and an empty result. Only the named fields are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.llm.running import sums_before
from gateflow.llm.tables import stored

WIDTH = 16
#: Nodes of an aligned block: two levels.
SPAN = WIDTH * WIDTH


def digest(content: bytes) -> bytes:
    return hashlib.sha256(content).hexdigest().encode()


def levels_of(n: int) -> int:
    """Levels a round adds to a tree that enters it with n nodes."""
    return 0 if n <= 1 else 1 if n <= WIDTH else 2


class Block:
    """Nodes of an aligned block, its leaves first, and the siblings on its way up."""

    def __init__(self, leaves: list[bytes], n: int, way: Sequence[bytes] = ()):
        self.levels, self.way = [leaves], list(way)
        for _ in range(levels_of(n)):
            below = self.levels[-1]
            self.levels.append([digest(b"".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])

    def siblings(self, at: int) -> list[bytes]:
        """Siblings on the left and on the right of a leaf and of each of its ancestors
        up to the root, as hex digests in a row."""
        out = []
        for level in self.levels[:-1]:
            run = at // WIDTH * WIDTH
            out += [b"".join(level[run:at]), b"".join(level[at + 1 : run + WIDTH])]
            at //= WIDTH
        return out + self.way


def version(leaf: bytes, siblings: Sequence[bytes]) -> list[bytes]:
    """The nodes a version copies when this leaf stands in place of the original: the
    leaf's ancestors, the root last (the leaf itself if it is the root)."""
    copies = [leaf]
    for left, right in zip(siblings[::2], siblings[1::2], strict=True):
        copies.append(digest(left + copies[-1] + right))
    return copies[1:] or copies


def field(value: Column) -> Column:
    """A field as it enters a leaf: its bytes behind their number."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def placed(rows: DataFrame, tree: str, by: Sequence[str]) -> DataFrame:
    """Rows with `index`, their place in their tree in the order `by`, and `n`, the rows
    of the tree. Rows are dealt by ranges, so a large tree is spread over many tasks."""
    schema = rows.schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", part long, at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            more = [pa.array(np.full(n, part, np.int64)), pa.array(at + np.arange(n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*schema.names, "part", "at"])
            at += n

    order = [F.col(c).asc_nulls_first() for c in (tree, *by)]
    split = F.monotonically_increasing_id()  # parts a run of equal rows over tasks
    dealt = rows.withColumn("_row", split).repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row")
    kept = stored(dealt.drop("_row").mapInArrow(run, ddl), "placed")
    counts = kept.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("first"))
    before = sums_before(stored(counts, "placed-counts"), "part", "own", [tree], "before")
    totals = before.groupBy(tree).agg(F.sum("own").alias("n")).withColumnRenamed(tree, "_tree")
    known = before.join(totals, F.col(tree).eqNullSafe(F.col("_tree")))
    known = known.select(F.col(tree).alias("_of"), F.col("part").alias("_part"), (F.col("before") - F.col("first")).alias("_base"), "n")
    on = (F.col("part") == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_of"))
    return kept.join(known, on).select(*schema.names, (F.col("at") + F.col("_base")).alias("index"), "n")


#: Columns of nodes on their way through a round; `way` only in the row before a block's nodes.
_NODE = "tree string, index long, n long, digest string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows (tree, block, ...) that come sorted by block."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:2]):
        yield key, list(group)


def _frames(made: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in made:
        held.append(row)
        if len(held) == size:
            yield _frame(held, schema)
            held = []
    yield _frame(held, schema)


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def risen(nodes: DataFrame, round_: int) -> DataFrame:
    """All nodes that a round makes of nodes (tree, index, n, digest): the same columns
    and `level` within the tree, and whether the node goes on as its block's `top`. A
    tree that is done goes on as it is, at level -1."""
    out = f"{_NODE}, level int, top int"
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (tree, block), rows in _blocks(batches):
                n = rows[0][3]
                levels = Block([r[4].encode() for r in rows], n).levels
                for k, level in enumerate(levels):
                    at, last = block * SPAN // WIDTH**k, k == len(levels) - 1
                    for i, d in enumerate(level if k or last else ()):
                        yield tree, block if last else at + i, -(-n // SPAN), d.decode(), 2 * round_ + k if k else -1, int(last)

        return _frames(made(), schema)

    block = F.floor(F.col("index") / SPAN).cast("long")
    rows = nodes.select("tree", block.alias("block"), "index", "n", "digest")
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    return dealt.mapInArrow(run, out)


class Tree:
    """Trees over nodes (tree, index, n, digest, and what else leaves carry)."""

    def __init__(self, leaves: DataFrame):
        most = leaves.agg(F.max("n")).first()[0] or 0
        self.leaves = leaves
        self.rounds, self.made = [leaves.select("tree", "index", "n", "digest")], []
        while True:
            up = stored(risen(self.rounds[-1], len(self.made)), "merkle-nodes")
            self.made.append(up)
            self.rounds.append(up.where("top = 1").select("tree", "index", "n", "digest"))
            most = -(-most // SPAN)
            if most <= 1:
                break

    def roots(self) -> DataFrame:
        """(tree, root) of each tree."""
        return self.rounds[-1].select("tree", F.col("digest").alias("root"))

    def nodes(self) -> DataFrame:
        """(tree, level, index, digest) of all nodes above the leaves, each once."""
        out = None
        for up in self.made:
            own = up.where("level > 0").select("tree", "level", "index", "digest")
            out = own if out is None else out.unionByName(own)
        return out

    def down(self, tops: DataFrame, made: Callable[[Block, int, tuple, list], tuple], out: str, extra: Sequence[str]) -> DataFrame:
        """`made(block, place, leaf, top)` for each leaf, with the siblings up to the root.

        `tops` has a row per tree: the siblings `way` from its root on, and the text
        columns `extra`, which reach `made` as `top`; `leaf` holds what leaves carry.
        """
        ways = tops.select("tree", F.lit(0).cast("long").alias("index"), "way", *extra)
        for nodes in reversed(self.rounds[1:-1]):
            step = f"tree string, index long, way array<string>{''.join(f', {e} string' for e in extra)}"
            onward = lambda block, at, leaf, top: (leaf[0], leaf[1], [x.decode() for x in block.siblings(at)], *top)
            ways = stored(self._descended(nodes, ways, onward, step, extra), "merkle-ways")
        return self._descended(self.leaves, ways, made, out, extra)

    @staticmethod
    def _descended(nodes: DataFrame, ways: DataFrame, made: Callable, out: str, extra: Sequence[str]) -> DataFrame:
        carried = [c for c in nodes.columns if c not in ("tree", "index", "n", "digest")]
        block = F.floor(F.col("index") / SPAN).cast("long")
        rows = nodes.select("tree", block.alias("block"), "index", "n", "digest", *carried).withColumns(
            {"way": F.lit(None).cast("array<string>"), **{e: F.lit(None).cast("string") for e in extra}}
        )
        # the row of a block's way stands before the block's nodes
        heads = ways.select("tree", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), "way", *extra)
        both = rows.unionByName(heads, allowMissingColumns=True)
        schema, kept = _arrow(out), 5 + len(carried)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def one() -> Iterator[tuple]:
                for _, (head, *group) in _blocks(batches):
                    if not group:
                        continue
                    whole = Block([r[4].encode() for r in group], group[0][3], [x.encode() for x in head[kept]])
                    for at, r in enumerate(group):
                        yield made(whole, at, (r[0], r[2], *r[4:kept]), list(head[kept + 1 :]))

            return _frames(one(), schema)

        return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "index").mapInArrow(run, out)


def manifest(
    docs: DataFrame, fields: Sequence[str], tampered: Column, changed: dict[str, Column], tree: str = "source", order: str = "doc_id"
) -> DataFrame:
    """One row per row of `docs`: id, leaf, subroot, root, proof_sha256 (digest of the
    siblings up to the root), folded_root (root of the version with the leaf that
    `changed` gives for rows that are `tampered`, else with the original leaf),
    verified, and copies (nodes the version copies; the others are shared)."""
    leaf = lambda columns: F.sha2(F.concat(*[field(c) for c in columns]), 256)
    rows = docs.select(
        F.col(tree).cast("string").alias("tree"),
        F.col(order).cast("long").alias("id"),
        leaf([F.col(f) for f in fields]).alias("digest"),
        F.when(tampered, leaf([changed.get(f, F.col(f)) for f in fields])).alias("other"),
    )
    leaves = stored(placed(stored(rows, "merkle-leaves"), "tree", ["id", "digest"]), "merkle-placed")
    sources = Tree(leaves)
    one = F.lit("").alias("tree")
    roots = stored(sources.roots().select(one, F.col("tree").alias("source"), F.col("root").alias("digest")), "merkle-roots")
    dataset = Tree(stored(placed(roots, "tree", ["source"]), "merkle-sources"))
    top = dataset.roots().select(one, F.array().cast("array<string>").alias("way"), "root")

    def to_source(block: Block, at: int, leaf: tuple, top: list) -> tuple:
        return leaf[3], [x.decode() for x in block.siblings(at)], leaf[2], top[0]

    ways = stored(dataset.down(top, to_source, "tree string, way array<string>, subroot string, root string", ["root"]), "merkle-tops")

    def proven(block: Block, at: int, leaf: tuple, top: list) -> tuple:
        _, _, own, i, other = leaf
        subroot, root = top
        siblings = block.siblings(at)
        copies = version((own if other is None else other).encode(), siblings)
        folded = copies[-1].decode()
        return i, own, subroot, root, digest(b"".join(siblings)).decode(), folded, int(folded == root), len(copies)

    out = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified int, copies int"
    found = sources.down(ways, proven, out, ["subroot", "root"])
    return found.withColumn("verified", F.col("verified") == 1).withColumnRenamed("id", order)
