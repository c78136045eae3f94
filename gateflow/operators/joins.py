"""Joins of facts to dimensions.

Dimensions are aggregated to one row per key first, so a join cannot multiply
rows. One is broadcast by hint only when its number of rows is bounded; else Spark
decides by size, and joins that shuffle have adaptive skew handling for hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.config import COLLATION
from gateflow.functions.names import bare_name
from gateflow.sources.dimensions import default_label


def _collated(c, collation):
    return F.collate(c, collation) if collation else c


def unique_codes(dim: DataFrame, collation: str | None = COLLATION) -> DataFrame:
    """Smallest station number per trimmed name, so the join cannot multiply rows."""
    key = _collated(F.trim("station_clean"), collation)
    return dim.groupBy(key.alias("_name")).agg(F.min("station_no").alias("station_id"))


def name_map(
    fact: DataFrame, dim: DataFrame, name: str = "station", collation: str | None = COLLATION
) -> DataFrame:
    """Cleaned name -> station_id for the distinct names of a fact table that match.

    Spark joins on a collated key by sorting both sides, so only the distinct names
    are matched under the collation. Store the map before it is used for several
    tables: read back, its size is known and Spark decides on a broadcast.
    """
    # made plain once per spelling, not once per row
    names = fact.select(name).distinct().select(bare_name(F.col(name)).alias("_plain")).distinct()
    codes = unique_codes(dim, collation)
    matched = names.join(codes, _collated(F.col("_plain"), collation) == F.col("_name"))
    return matched.select("_plain", "station_id")


def match_station(fact: DataFrame, mapping: DataFrame, name: str = "station") -> DataFrame:
    """Add station_id by cleaned name from a name map; null when unmatched."""
    return (
        fact.withColumn("_key", bare_name(F.col(name)))
        .join(mapping, F.col("_key") == F.col("_plain"), "left")
        .select(*fact.columns, "station_id")
    )


def with_day_label(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add the day label; dates outside the calendar are weekday or weekend.

    Labels are one row per date, so there are at most 366 per year to broadcast.
    """
    labels = calendar.groupBy("base_date").agg(F.max("day_label").alias("_label"))
    labels = F.broadcast(labels.where(F.col("base_date").isNotNull()))
    return (
        daily.join(labels, "base_date", "left")
        .withColumn("day_label", F.coalesce("_label", default_label(F.col("base_date"))))
        .drop("_label")
    )
