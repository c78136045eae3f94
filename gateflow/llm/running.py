"""Places of rows in a total order, found from counts of sorted stretches.

Rows are sorted over many tasks; each task counts its own, and only the counts, a row
per task (and key), are summed up along the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counts that one window sums; their sums are summed by another.
STRETCH = 4096


def sums_before(counts: DataFrame, order: str, value: str, keys: list[str], name: str) -> DataFrame:
    """Counts with the sum of `value` over the rows of the same keys that stand before,
    in a column `name`. `order` is a whole number, unique within the keys."""
    group = F.floor(F.col(order) / STRETCH)
    cut = counts.withColumn("_group", group)
    along = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("_inner", F.coalesce(F.sum(value).over(along), F.lit(0)))
    over = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    outer = (
        cut.groupBy(*keys, "_group")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_outer", F.coalesce(F.sum("_sum").over(over), F.lit(0)))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_group").alias("_of_group"), "_outer")
    )
    on = F.col("_group") == F.col("_of_group")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = inner.join(outer, on)
    return joined.select(*counts.columns, (F.col("_inner") + F.col("_outer")).cast("long").alias(name))
