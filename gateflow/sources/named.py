"""Queries over named tables with bound parameters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def query_named(
    spark: SparkSession,
    text: str,
    tables: Mapping[str, DataFrame] | None = None,
    args: Mapping[str, Any] | None = None,
) -> DataFrame:
    """SQL over views; values are bound as :name, never pasted into the text."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=dict(args or {}))
