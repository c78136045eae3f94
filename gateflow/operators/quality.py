"""Data-quality checks; each is one pass and a small result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gateflow.functions.dates import parse_date
from gateflow.functions.headers import quoted
from gateflow.functions.names import byte_view
from gateflow.functions.numbers import clean_count, clean_counts, round_ratio


def fail_rate(int_flow: DataFrame, col: str = "station_id") -> DataFrame:
    """Percent of rows without a matched station."""
    missing = F.count_if(F.col(col).isNull())
    return int_flow.agg(
        F.count(F.lit(1)).alias("n_rows"),
        missing.alias("n_unmatched"),
        round_ratio(missing * 100, F.count(F.lit(1)), 2).alias("fail_rate"),
    )


def reconcile(layers: Mapping[str, DataFrame], cols: Sequence[str]) -> DataFrame:
    """Row counts and sums of two layers in one row, with their differences.

    The layers are stacked under a tag and summed once, each side combined in
    its own tasks.
    """
    (a, left), (b, right) = layers.items()
    tagged = left.select(F.lit(a).alias("_layer"), *cols).unionByName(
        right.select(F.lit(b).alias("_layer"), *cols)
    )
    out = []
    for name in (a, b):
        mine = F.col("_layer") == name
        out.append(F.count_if(mine).alias(f"n_{name}"))
        out += [F.sum(F.when(mine, F.col(c))).alias(f"{c}_{name}") for c in cols]
    sums = tagged.agg(*out)
    return sums.select(
        "*",
        (F.col(f"n_{a}") - F.col(f"n_{b}")).alias("n_diff"),
        *[(F.col(f"{c}_{a}") - F.col(f"{c}_{b}")).alias(f"{c}_diff") for c in cols],
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def coverage_gaps(df: DataFrame, date: str = "base_date", unit: str = "month") -> DataFrame:
    """Days, months or years without a row between the first and the last date."""
    period = F.col(date) if unit == "day" else F.trunc(F.col(date), unit)
    seen = df.where(F.col(date).isNotNull()).groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    )
    span = seen.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    every = span.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("period")
    )
    return every.join(seen, "period", "left_anti")


def reject_counts(
    df: DataFrame, date: str, counts: Sequence[str] = (), group: Sequence[str] = ()
) -> DataFrame:
    """Unreadable dates, unreadable counts and negative counts in delivered text."""
    raw_date = F.col(quoted(date))
    bad_date = F.trim(raw_date).isNotNull() & (F.trim(raw_date) != "") & parse_date(raw_date).isNull()
    values = [(F.col(quoted(c)), clean_count(F.col(quoted(c)), keep_null=True)) for c in counts]

    def total(flags):
        return reduce(lambda x, y: x + y, [F.count_if(f) for f in flags]) if flags else F.lit(0)

    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(F.trim(raw_date), F.lit("")) == "").alias("n_no_date"),
        F.count_if(bad_date).alias("n_bad_date"),
        total([raw.isNotNull() & v.isNull() for raw, v in values]).cast("bigint").alias("n_bad_count"),
        total([raw.isNull() for raw, v in values]).cast("bigint").alias("n_no_count"),
        total([v < 0 for raw, v in values]).cast("bigint").alias("n_negative"),
    )


class ObservedLoad:
    """reject_counts without a pass of its own: the action that writes `rows`, or what is
    made of them, counts as it goes.

    The values of the group column are given, so that each has its own counters; rows
    with another value are counted under null. `counts` waits for that action.
    """

    def __init__(self, df: DataFrame, date: str, counts: Sequence[str], group: str, values: Sequence[str]):
        self.group, self.values, self.seen = group, [*values, None], Observation()
        raw_date = F.col(quoted(date))
        no_date = F.coalesce(F.trim(raw_date), F.lit("")) == ""
        bad_date = F.coalesce((F.trim(raw_date) != "") & parse_date(raw_date).isNull(), F.lit(False))
        cells = F.array(*[F.col(quoted(c)) for c in counts]).cast("array<string>")
        n = range(len(counts))
        several = lambda flags: reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))
        no_count = several(F.col("_cells")[i].isNull() for i in n)
        flags = {
            "n_rows": F.lit(1),
            "n_no_date": no_date.cast("int"),
            "n_bad_date": bad_date.cast("int"),
            "n_bad_count": several(F.col("_values")[i].isNull() for i in n) - no_count,
            "n_no_count": no_count,
            "n_negative": several(F.coalesce(F.col("_values")[i] < 0, F.lit(False)) for i in n),
        }
        self.names = list(flags)
        # flags are columns of the row, so a metric only adds a number: metrics that read
        # the cells would each read all of them, in every group
        told = df.withColumn("_cells", cells).withColumn("_values", clean_counts(F.col("_cells"), keep_null=True))
        told = told.withColumns({f"_{n}": f for n, f in flags.items()})
        here = [F.col(quoted(group)).eqNullSafe(F.lit(v)) for v in values]
        here.append(~reduce(lambda a, b: a | b, here))
        metrics = [
            F.sum(F.when(own, F.col(f"_{name}"))).cast("bigint").alias(f"{i}_{name}")
            for i, own in enumerate(here)
            for name in flags
        ]
        told = told.drop("_cells", "_values").observe(self.seen, *metrics)
        self.rows = told.drop(*[f"_{n}" for n in flags])

    def counts(self, spark: SparkSession) -> DataFrame:
        """A row per value of the group column that occurred."""
        got = self.seen.get
        rows = [(v, *(got[f"{i}_{n}"] or 0 for n in self.names)) for i, v in enumerate(self.values) if got[f"{i}_n_rows"]]
        return spark.createDataFrame(rows, f"`{self.group}` string, " + ", ".join(f"{n} long" for n in self.names))


def suspicious_headers(headers: Sequence[str]) -> list[tuple[str, str]]:
    """Header names with characters other than letters, digits, blanks, dots, brackets
    and the signs of hour slots, with their bytes in hex."""
    odd = [h for h in headers if any(not (c.isalnum() or c in "() .:~-") for c in h)]
    return [(h, h.encode("utf-8").hex().upper()) for h in dict.fromkeys(odd)]


def suspicious_names(df: DataFrame, col: str) -> DataFrame:
    """Names with characters other than letters, digits, blanks, dots and brackets."""
    names = df.groupBy(F.col(quoted(col)).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return names.where(F.col("name").rlike(r"[^\p{L}\p{N}() .]")).select(
        "name", "n_rows", byte_view(F.col("name")).alias("bytes")
    )


def level_shift(
    daily: DataFrame, factor: float = 2.0, tolerance: float = 0.25, row_tolerance: float = 0.1
) -> DataFrame:
    """Years whose average changed by about the factor while the row count stayed.

    Each year is compared with the year before; shift is up, down or null.
    """
    yearly = daily.groupBy(F.year("base_date").alias("yr")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("on_cnt") + F.col("off_cnt")).alias("total"),
    )
    before = yearly.select(
        (F.col("yr") + 1).alias("yr"),
        F.col("n_rows").alias("prev_rows"),
        F.col("total").alias("prev_total"),
    )
    level = (F.col("total").cast("double") * F.col("prev_rows")) / F.nullif(
        F.col("prev_total").cast("double") * F.col("n_rows"), F.lit(0.0)
    )
    rows = F.col("n_rows").cast("double") / F.col("prev_rows").cast("double")
    same_rows = rows.between(1 - row_tolerance, 1 + row_tolerance)
    up = level.between(factor * (1 - tolerance), factor * (1 + tolerance))
    down = level.between((1 - tolerance) / factor, (1 + tolerance) / factor)
    return yearly.join(before, "yr", "left").select(
        "yr",
        "n_rows",
        F.col("total").cast("bigint").alias("total"),
        round_ratio(F.col("total"), F.col("n_rows"), 2).alias("average"),
        F.round(level, 4).alias("level_ratio"),
        F.round(rows, 4).alias("row_ratio"),
        F.when(same_rows & up, "up").when(same_rows & down, "down").alias("shift"),
    )
