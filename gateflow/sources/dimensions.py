"""Station and calendar dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.config import EXTERNAL_STATION_CODE, STATION_NUMBER, WEEKDAY, WEEKEND
from gateflow.functions.dates import is_weekend
from gateflow.functions.headers import quoted, strip_name
from gateflow.sources.csv import read_wide_csv


def load_station_dim(df: DataFrame) -> DataFrame:
    """Strip the column names; the external code column becomes the station number."""
    names = [strip_name(c) for c in df.columns]
    if EXTERNAL_STATION_CODE in names:
        names = [STATION_NUMBER if n == EXTERNAL_STATION_CODE else n for n in names]
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in zip(df.columns, names)])


def read_station_dim(spark: SparkSession, path: str, types: dict[str, str] | None = None, **how) -> DataFrame:
    """Station master from its file; columns in `types` are cast, a text that is no value
    of the type becomes null."""
    dim = load_station_dim(read_wide_csv(spark, path, marker=STATION_NUMBER, **how))
    for column, kind in (types or {}).items():
        dim = dim.withColumn(column, F.col(quoted(column)).try_cast(kind))
    return dim


def date_axis(spark: SparkSession, start: str, end: str, unit: str = "day") -> DataFrame:
    """Every day, month or year start in [start, end]."""
    first = F.lit(start).cast("date")
    if unit != "day":
        first = F.trunc(first, unit)
    step = F.expr(f"interval 1 {unit}")
    days = F.sequence(first, F.lit(end).cast("date"), step)
    return spark.range(1).select(F.explode(days).alias("base_date"))


def default_label(date):
    return F.when(is_weekend(date), F.lit(WEEKEND)).otherwise(F.lit(WEEKDAY))


def calendar(
    spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None
) -> DataFrame:
    """One row per date with its label: holiday name, else weekend, else weekday.

    holidays: base_date, holiday_name; the first name in text order wins when a
    date has several, so a date never gets two rows, and there are no more names
    to broadcast than days in the range.
    """
    days = date_axis(spark, start, end)
    label = default_label(F.col("base_date"))
    if holidays is None:
        return days.withColumn("day_label", label)
    names = (
        holidays.where(F.col("base_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("base_date")
        .agg(F.min("holiday_name").alias("holiday_name"))
    )
    return days.join(F.broadcast(names), "base_date", "left").select(
        "base_date", F.coalesce("holiday_name", label).alias("day_label")
    )
