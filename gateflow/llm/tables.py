"""Tables and scratch folders that the operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.sinks.tables import scratch_path

#: Folder that holds the package.
_HOME = str(Path(__file__).resolve().parents[2])


def prepared(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package from whatever folder the job
    was started; a cluster gets it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _HOME])


#: Bytes of rows that Python gets at a time from here on, unless the session says
#: otherwise: numbers about whole texts take several times the texts' size.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def in_small_batches(spark: SparkSession) -> None:
    prepared(spark)
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table that one task writes.
ROWS = 500_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, and
    a lost executor costs no more than the tasks after the write.

    `rows`, for tables of numbers and digests, says how many rows there are at most. They
    are then written by as many tasks as that takes, not a file by each task that made some.
    """
    spark = df.sparkSession
    prepared(spark)
    if rows is not None:
        df = df.repartition(1 + rows // ROWS)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number of their own, and the name of its column, which no other
    column has. Written once, so that every later read has the same numbers."""
    name = "row_number"
    while name in (c.lower() for c in df.columns):
        name += "_"
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
