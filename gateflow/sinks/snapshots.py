"""Partitioned tables with published versions.

A change is staged first: the partitions it meets are written anew to a folder of their
own, and a manifest lists the folder of every partition. Readers see nothing of it until
one small row that names the manifest is added to the published versions; so they see
all of a change or nothing, and a job that dies between the two steps has left the table
as it was. Running it again stages it again. Folders that no version names are left for
the table's owner to remove.

One writer at a time: a change that was staged on another version than the published
one is refused. What reaches the driver is a row per partition, as for any partitioned
table that Spark lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateflow.functions.headers import quoted
from gateflow.sinks.tables import conform, last_per_key, scratch_path, upsert_update, write_table

_PUBLISHED = "version long, snap string, ledger string, schema string"


@dataclass(frozen=True)
class Staged:
    """A change that is written, but not published."""

    base: int
    snap: str
    ledger: str | None
    schema: str


class SnapshotTable:
    """Table at `path`, partitioned by `partition_by`.

    With a declared schema, rows are cast to it, its column comments are kept with each
    version and come back on reading, and columns named in `non_negative` may not hold
    negative counts: such a change is refused, with the number of its rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        partition_by: Sequence[str],
        sort_by: Sequence[str] = (),
        schema: T.StructType | None = None,
        non_negative: Sequence[str] = (),
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.partition_by, self.sort_by = list(partition_by), list(sort_by)
        self.schema, self.non_negative = schema, list(non_negative)

    # --- reading

    def _published(self) -> Staged | None:
        """The version that readers see."""
        try:
            rows = self.spark.read.schema(_PUBLISHED).parquet(f"{self.path}/published")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        last = rows.orderBy(F.desc("version")).first()
        return last and Staged(last["version"], last["snap"], last["ledger"], last["schema"])

    def version(self) -> int:
        """Number of published changes."""
        now = self._published()
        return now.base if now else 0

    def _manifest(self, now: Staged) -> DataFrame:
        """(partition columns, folder) of a version."""
        return self.spark.read.parquet(f"{self.path}/manifests/{now.snap}")

    def _rows(self, schema: str, folders: list[str]) -> DataFrame:
        kinds = T.StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kinds)
        reader = self.spark.read.option("basePath", f"{self.path}/data").schema(kinds)
        return reader.parquet(*[f"{self.path}/data/{unquote(f)}" for f in folders]).select(
            *[F.col(quoted(f.name)).alias(f.name, metadata=f.metadata) for f in kinds]
        )

    def read(self) -> DataFrame:
        """Rows of the published version; filters on partition columns prune folders."""
        now = self._published()
        if now is None:
            raise ValueError(f"nothing is published at {self.path}")
        return self._rows(now.schema, [r["folder"] for r in self._manifest(now).collect()])

    # --- staging

    def _write(self, rows: DataFrame, snap: str) -> tuple[DataFrame, str]:
        """Folders of the partitions that rows fall in, once they are written there."""
        if self.schema is not None:
            rows = conform(rows, self.schema)
        schema = T.StructType([f for f in rows.schema if f.name not in self.partition_by] + [rows.schema[p] for p in self.partition_by])
        negative = Observation()
        if self.non_negative:
            counts = [F.count_if(F.col(quoted(c)) < 0).alias(c) for c in self.non_negative]
            rows = rows.observe(negative, *counts)
        folder = f"{self.path}/data/snap={snap}"
        write_table(rows, folder, partition_by=self.partition_by, sort_by=self.sort_by)
        if self.non_negative and (bad := {c: n for c, n in negative.get.items() if n}):
            raise ValueError("negative counts: " + ", ".join(f"{n} rows of {c}" for c, n in sorted(bad.items())))
        own = "snap=" + snap + "/" + "/".join(["([^/]+)"] * len(self.partition_by))
        names = F.regexp_extract("_metadata.file_path", f"({own})/[^/]+$", 1).alias("folder")
        written = self.spark.read.schema(schema).parquet(folder)
        return written.select(*self.partition_by, names).distinct(), schema.json()

    def _stage(self, now: Staged | None, rows: DataFrame, replaced: DataFrame | None, ledger: str | None = None) -> Staged:
        """Write rows; they replace the partitions in `replaced`, or are added."""
        snap = uuid.uuid4().hex[:16]
        folders, schema = self._write(rows, snap)
        if now is not None:
            kept = self._manifest(now)
            if replaced is not None:
                gone = replaced.toDF(*[f"_{p}" for p in self.partition_by])
                same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in self.partition_by])
                kept = kept.join(gone, same, "left_anti")
            folders = kept.unionByName(folders)
        folders.coalesce(1).write.parquet(f"{self.path}/manifests/{snap}")  # a row per partition
        return Staged(now.base if now else 0, snap, ledger or (now.ledger if now else None), schema)

    def publish(self, staged: Staged) -> int:
        """Let readers see a staged change; the number of the new version."""
        if self.version() != staged.base:
            raise ValueError(f"{self.path} was changed after version {staged.base}: stage again")
        row = [(staged.base + 1, staged.snap, staged.ledger, staged.schema)]
        self.spark.createDataFrame(row, _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return staged.base + 1

    # --- changes

    def stage_append(self, rows: DataFrame) -> Staged:
        """Rows beside those that are there."""
        return self._stage(self._published(), rows, None)

    def stage_upsert(self, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> Staged:
        """New rows replace rows with the same key. Only partitions that new rows fall
        in are read and written; a key stays in its partition."""
        new = write_table(last_per_key(new, keys, order), scratch_path(self.spark, "upsert-new"))
        now, met, old = self._met(new)
        if now is None:
            return self._stage(None, new, None)
        kept = old.join(new.select(*keys), list(keys), "left_anti")
        return self._stage(now, kept.unionByName(new.select(*old.columns)), met)

    def stage_update(self, new: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str | Column] = ()) -> Staged:
        """Insert new keys; on a known key only `cols` take the new value. Old rows keep
        their number, also those with null or repeated keys."""
        new = write_table(last_per_key(new, keys, order), scratch_path(self.spark, "update-new"))
        now, met, old = self._met(new)
        if now is None:
            return self._stage(None, new, None)
        return self._stage(now, upsert_update(old, new.select(*old.columns), keys, cols), met)

    def _met(self, new: DataFrame) -> tuple[Staged | None, DataFrame, DataFrame | None]:
        """Published version, partitions that new rows fall in, and the old rows there."""
        now, met = self._published(), new.select(*self.partition_by).distinct()
        if now is None:
            return None, met, None
        named = met.toDF(*[f"_{p}" for p in self.partition_by])
        same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in self.partition_by])
        folders = [r["folder"] for r in self._manifest(now).join(named, same, "left_semi").collect()]
        return now, met, self._rows(now.schema, folders)

    # --- loads of files

    def append_files(self, paths: Sequence[str], read: Callable[[list[str]], DataFrame]) -> int:
        """Append what `read` makes of those files that were never loaded; the version
        after it.

        Loaded files are known by the digest of their lines, whatever their name and the
        order of lines. Rows and digests are published together, so a load that is
        repeated, or run again after it died, adds nothing twice.
        """
        now = self._published()
        files = file_digests(self.spark, paths)
        fresh = files.groupBy("digest").agg(F.min("file").alias("file"))
        known = None
        if now is not None and now.ledger is not None:
            known = self.spark.read.parquet(f"{self.path}/ledger/{now.ledger}")
            fresh = fresh.join(known.select("digest"), "digest", "left_anti")
        fresh = write_table(fresh, scratch_path(self.spark, "fresh-files"))
        names = sorted(unquote(r["file"]) for r in fresh.select("file").collect())  # as Spark lists them to read them
        if not names:
            return now.base if now else 0
        ledger = uuid.uuid4().hex[:16]
        (fresh if known is None else known.unionByName(fresh)).write.parquet(f"{self.path}/ledger/{ledger}")
        return self.publish(self._stage(now, read(names), None, ledger))


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, digest) of text files by size, number of lines and sums over the digests of
    lines: files stay splittable, and one row per file and task is shuffled."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.xxhash64("value").alias("h"),
        F.xxhash64("value", F.lit(1)).alias("g"),
    )
    sums = lines.groupBy("file", "size").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
        F.sum(F.col("g").cast("decimal(38,0)")).alias("t"),
    )
    return sums.select("file", F.sha2(F.concat_ws(":", "size", "n", "x", "s", "t"), 256).alias("digest"))
