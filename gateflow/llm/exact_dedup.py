"""Exact deduplication against a persistent digest index.

The index is a Parquet table in a folder of the caller's, bucketed and sorted by
digest. A batch is reduced to one row per digest, brought to the buckets, merged
against the index with a sort-merge anti-join, and what is new is appended as one
more sorted file per bucket. The index side is never shuffled.

Texts are equal when identical after every run of ASCII white space became one
space. Null counts as empty, so null and empty texts are equal to each other.
Rows that repeat an id and a text are copies of one document: all of them carry
that id as `keep_id` and are marked kept if it is the smallest. A null id is
larger than any other id; a group of null ids only keeps them. An empty table
gives an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.llm.tables import stored

WHITE = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256))


class DigestIndex:
    """Digests seen so far with the id that stays for each, in a folder at `path`.

    `buckets` is fixed when the folder is first used and kept there; a later session
    that gives another number is refused. Each bucket should hold some 100 MB at the
    size expected. Folders are told apart by their whole path, with or without a slash
    at its end.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.buckets = spark, int(buckets)
        path = re.sub(r"(?<=.)/+$", "", path)
        same = re.sub("/+", "/", path.removeprefix("file:"))
        self.name = f"digest_index_{sha256(same.encode()).hexdigest()[:24]}"
        kept = self._kept(f"{path}/_buckets")
        if kept not in (None, self.buckets):
            raise ValueError(f"the index at {path} has {kept} buckets, not {self.buckets}")
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # of an earlier folder there; the folder's files stay
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        if kept is None:
            if not self.table().isEmpty():
                raise ValueError(f"{path} holds rows, but not the number of its buckets")
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{path}/_buckets")

    def _kept(self, path: str) -> int | None:
        try:
            return self.spark.read.parquet(path).first()["buckets"]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of `groups` (one per digest) whose digest the index lacks."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        """Add rows (digest, keep_id) that the index lacks. Run again after a
        failure, `unseen` finds nothing that was already appended."""
        laid = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
        laid.sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256; and the
    column `row`, if named, which tells rows apart.

    keep_id comes from the index where an earlier batch had the text; group_size
    counts the rows of this batch.
    """
    own = [F.col(row).alias("row")] if row else []
    digests = stored(docs.select(F.col(doc_id).cast("long").alias("id"), digest_of(F.col(text)).alias("digest"), *own), "digests")
    groups = stored(
        digests.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "digest-groups", digests.count()
    )
    index.append(index.unseen(groups))
    held = index.table().select("digest", F.col("keep_id").alias("held_id"))
    # only what differs from "alone and new" is joined back, so the side is small
    # and the exchange below can be split where one digest has most of the rows
    shared = stored(
        groups.join(held.hint("merge"), "digest")
        .where((F.col("n") > 1) | ~F.col("held_id").eqNullSafe(F.col("keep_id")))
        .select("digest", "held_id", "n"),
        "digest-shared",
        groups.count(),
    )
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("held_id"))
    return digests.join(shared, "digest", "left").select(
        F.col("id").alias(doc_id),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["row"] if row else []),
    )
