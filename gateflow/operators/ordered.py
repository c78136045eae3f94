"""First rows, top rows and nested lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key. Spark keeps one row per key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop repeated keys, keeping the row of the first file and line."""
    return first_by(df, keys, order).drop(*order)


def top_net_flow(mart: DataFrame, n: int = 20) -> DataFrame:
    """The n rows with the largest net flow; ties in key order."""
    return mart.orderBy(
        F.col("net_flow").desc(), "station_id", "station", "line", "hour"
    ).limit(n)


def bucket_of(name: Column, buckets: int) -> Column:
    """Bucket of a name: spread evenly by a digest of the name."""
    digest = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10)
    return (digest.cast("bigint") % F.lit(buckets)).cast("int")


def stations_by_line(stations: DataFrame, buckets: int) -> DataFrame:
    """Stations of a line as nested lists ordered by name, one per line and bucket.

    With one bucket it is one list per line. The caller chooses the number, so the
    shape of the result never depends on how many stations there are.
    """
    rest = [c for c in stations.columns if c not in ("line_num", "display_name")]
    item = F.struct("display_name", *rest)
    return (
        stations.withColumn("bucket", bucket_of(F.col("display_name"), buckets))
        .groupBy("line_num", "bucket")
        .agg(F.sort_array(F.collect_list(item)).alias("stations"))
    )
