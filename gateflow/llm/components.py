"""Connected components of links, by joins and aggregates on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import stored


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, label) for every node of `links` (a, b), label the smallest node of
    its component.

    Large-star and small-star steps alternate: each node's larger neighbours are
    tied to its smallest neighbour, then its smaller ones, until nothing changes.
    Only smallest neighbours are aggregated, and edges are joined back by node, so
    no list of neighbours is ever built. Null and equal ends are left out. `most` says
    how many links there are at most, if known.
    """
    both = links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = stored(both, "edges", most)
    while True:
        held = edges.count()
        starred = stored(_small(_large(edges)), "edges", held)
        if starred.count() == held and starred.join(edges, ["lo", "hi"], "left_anti").isEmpty():
            break
        edges = starred
    # every remaining edge ties a node to the smallest of its component
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )


def _large(edges: DataFrame) -> DataFrame:
    """Tie larger neighbours of each node to its smallest neighbour or itself."""
    near = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    )
    least = near.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return (
        near.join(least, "node")
        .where("other > node")
        .select(F.col("low").alias("lo"), F.col("other").alias("hi"))
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("low"))
    joined = edges.join(least, "hi")
    return (
        joined.select(F.col("low").alias("lo"), F.col("lo").alias("hi"))
        .union(joined.select(F.col("low").alias("lo"), "hi"))
        .where("lo <> hi")
        .distinct()
    )
