"""Parquet tables: replace, append, upsert, declared schema, layout."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateflow.functions.headers import quoted

_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables a job writes for itself.

    It is the folder named in spark.checkpoint.dir. Only a local session without
    that setting gets a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="run-")
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _laid_out(
    df: DataFrame, partition_by: Sequence[str], sort_by: Sequence[str | Column]
) -> DataFrame:
    """Rows of a table partition together, in files of even size.

    The rebalance hint lets adaptive execution split a partition that holds most
    of the rows and merge small ones, so a hot month is not one task.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    return sorted_within(df, [*partition_by, *sort_by]) if sort_by else df


def sorted_within(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Rows sorted within tasks; an expression is a column while they are, as a sort would
    evaluate it for each comparison."""
    made = {f"_order_{i}": key for i, key in enumerate(keys) if not isinstance(key, str)}
    names = [key if isinstance(key, str) else f"_order_{i}" for i, key in enumerate(keys)]
    return df.withColumns(made).sortWithinPartitions(*names).drop(*made) if made else df.sortWithinPartitions(*names)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str | Column] = (),
    cut: int = 1,
) -> DataFrame:
    """Write a table and return it as read back.

    With sort_by the Parquet minimum and maximum per row group let a lookup by
    station skip most of a partition. Tasks are `cut` times smaller than the session
    advises: advised is the shuffled, packed size, and rows that pack well take many times
    that while they are sorted.
    """
    spark = df.sparkSession
    writer = _laid_out(df, partition_by, sort_by).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _set(spark, _smaller(spark, cut)):
        writer.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the writes inside; the session has its own again afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write_spread(
    df: DataFrame, path: str, partition_by: Sequence[str], values: int, replace: bool = False, grows: int = 1
) -> DataFrame:
    """Write a table by a few partition values without moving a row.

    Each task has a file open per value, up to `values` of them; it neither shuffles nor
    sorts its rows, as write_table does so that many values don't make a file per value
    and task. Beyond that number Spark sorts what is left of a task. Rows read from a table
    that write_table laid out so keep its order. With `replace` only partitions that rows
    fall in are replaced. `grows` is the number of rows that one row of the last shuffle
    becomes: tasks are cut so much smaller.
    """
    spark = df.sparkSession
    settings = {"spark.sql.maxConcurrentOutputFileWriters": str(values), **_smaller(spark, grows)}
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if replace:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    with _set(spark, settings):
        writer.parquet(path)
    return spark.read.parquet(path)


def _smaller(spark: SparkSession, times: int) -> dict[str, str]:
    """Setting for tasks so many times smaller than the session advises, 1 MB at least."""
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    return {advised: str(max(1 << 20, _bytes(spark.conf.get(advised)) // times))} if times > 1 else {}


def _bytes(size: str) -> int:
    """Bytes of a size as settings give it, such as 64MB."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def write_lookup(df: DataFrame, path: str, key: str, sort_by: Sequence[str], buckets: int) -> DataFrame:
    """Second access path of a table: rows by `key`, in `buckets` buckets, each file
    sorted by the key and `sort_by`, with a bloom filter on the key.

    A lookup of one key opens one bucket, and there the row groups that hold it; Spark
    prunes buckets by one column, so further columns of a lookup are found by the sort
    order. The rebalance hint deals rows as buckets do, so a bucket is one file, and a key
    that has most of the rows is several. Later sessions get the table by `lookup`.
    """
    spark = df.sparkSession
    laid = df.hint("rebalance", buckets, key)
    writer = laid.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort_by)
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true", "path": path}
    writer.options(**bloom).saveAsTable(_lookup_name(path))
    return spark.table(_lookup_name(path))


def lookup(spark: SparkSession, path: str, schema: T.StructType, key: str, sort_by: Sequence[str], buckets: int) -> DataFrame:
    """Table that write_lookup left at `path`, with the layout it was written in."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    order = ", ".join(quoted(c) for c in (key, *sort_by))
    spark.sql(f"DROP TABLE IF EXISTS {_lookup_name(path)}")  # the name only, its files stay
    spark.sql(
        f"CREATE TABLE {_lookup_name(path)} ({columns}) USING parquet "
        f"CLUSTERED BY ({quoted(key)}) SORTED BY ({order}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_lookup_name(path))


def _lookup_name(path: str) -> str:
    return "lookup_" + sha256(path.rstrip("/").encode()).hexdigest()[:24]


def append_by_date(df: DataFrame, path: str, date_col: str, first: bool = False) -> DataFrame:
    """Append all dates in one write; the first write replaces the table."""
    return write_table(df, path, "overwrite" if first else "append", [date_col])


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str | Column] = ()) -> DataFrame:
    """Replace only those partitions of a table that the new rows fall in."""
    (
        _laid_out(df, partition_by, sort_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema with column comments; stop on extra or absent columns."""
    want, have = set(schema.names), set(df.columns)
    if want != have:
        raise ValueError(f"absent: {sorted(want - have)}, extra: {sorted(have - want)}")
    return df.select(
        *[
            F.col(quoted(f.name)).cast(f.dataType).alias(f.name, metadata=f.metadata or {})
            for f in schema
        ]
    )


def last_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()
) -> DataFrame:
    """One row per key, the last in the given order; combined before the shuffle.

    Without an order the row with the largest values is kept, so the result does
    not depend on how the rows were spread.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*[F.col(quoted(c)) for c in rest])
    last = F.max_by(row, F.struct(*order) if order else row)
    return (
        df.groupBy(*keys)
        .agg(last.alias("_row"))
        .select(*keys, *[F.col(f"_row.{quoted(c)}") for c in rest])
        .select(*df.columns)
    )


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()
) -> DataFrame:
    """New rows replace old rows with the same key.

    When new holds a key twice, the last row in the given order wins.
    """
    new = last_per_key(new, keys, order)
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*old.columns))


def upsert_update(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """Insert new keys; on a known key only cols take the new value, also a null one.

    Only the new side is made unique. Old rows keep their number: each takes the
    new value of its key, and rows with a null key match nothing and stay.
    """
    new = last_per_key(new, keys, order)
    fresh = new.select(*keys, F.lit(True).alias("_there"), *[F.col(quoted(c)).alias(f"_new_{c}") for c in cols])
    value = lambda c: F.when(F.col("_there"), F.col(quoted(f"_new_{c}"))).otherwise(F.col(quoted(c))).alias(c)
    updated = old.join(fresh, list(keys), "left").select(
        *[value(c) if c in cols else F.col(quoted(c)) for c in old.columns]
    )
    added = new.join(old.select(*keys).distinct(), list(keys), "left_anti")
    return updated.unionByName(added.select(*old.columns))


def upsert_table(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """Upsert into a partitioned table; only partitions met by new rows are rewritten.

    A key must stay in its partition, so the partition columns belong to the keys
    or follow from them. The merged rows go to a scratch table first, because a
    path cannot be overwritten while it is read.
    """
    staged = write_table(last_per_key(new, keys, order), scratch_path(spark, "upsert-new"))
    # one row per partition that is met: the values reach the scan as partition filters
    met = staged.select(*partition_by).distinct().collect()
    if not met:
        return spark.read.parquet(path)
    here = reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in partition_by]) for r in met],
    )
    if len(partition_by) == 1 and all(r[0] is not None for r in met):
        here = F.col(partition_by[0]).isin([r[0] for r in met])
    old = spark.read.parquet(path).where(here)
    kept = old.join(staged.select(*keys), list(keys), "left_anti")
    merged = kept.unionByName(staged.select(*old.columns))
    return replace_partitions(write_table(merged, scratch_path(spark, "upsert")), path, partition_by)
