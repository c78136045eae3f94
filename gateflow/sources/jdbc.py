"""JDBC scan and write of tables, as option sets over Spark's own source."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Partitioning:
    """Split of a scan by a number, date or timestamp column."""

    column: str
    lower: str
    upper: str
    n: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.n),
        }


def read_options(
    opts: Mapping[str, str], table: str, partition: Partitioning | None = None
) -> dict[str, str]:
    out = {"fetchsize": "10000", **opts, "dbtable": table}
    return {**out, **partition.options()} if partition else out


def read_jdbc(
    spark: SparkSession,
    opts: Mapping[str, str],
    table: str,
    partition: Partitioning | None = None,
) -> DataFrame:
    """Table scan; without a partitioning it is one task, fit for small tables only."""
    return spark.read.format("jdbc").options(**read_options(opts, table, partition)).load()


def write_options(
    opts: Mapping[str, str], table: str, batch: int = 10_000, connections: int | None = None
) -> dict[str, str]:
    out = {**opts, "dbtable": table, "batchsize": str(batch), "truncate": "true"}
    return {**out, "numPartitions": str(connections)} if connections else out


def write_jdbc(
    df: DataFrame,
    opts: Mapping[str, str],
    table: str,
    batch: int = 10_000,
    connections: int | None = None,
) -> None:
    """Replace the rows of a table; truncate keeps its declared column types.

    connections bounds how many tasks write at once.
    """
    writer = df.write.format("jdbc").options(**write_options(opts, table, batch, connections))
    writer.mode("overwrite").save()
