"""Marts kept up to date month by month, from sums that can be added up.

Every mart over a longer period is a function of sums per month: counts, sums and sums of
squares of whole numbers, which add exactly in any order. `MONTHLY` names those tables;
each of their months depends on the rows of that month only. A delivery touches some
months: of these, the hourly and daily tables and the monthly sums are made again, all
other months stay as they are on disk. Growth looks back a year, so its touched months
are these and those one year later. The marts are then read off the sums, which have a
row per station, line and month, whatever the number of delivered rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.config import THRESHOLDS, WEEKDAY, YEARS, Thresholds
from gateflow.functions.dates import month_start, year_later
from gateflow.functions.numbers import round_ratio
from gateflow.operators.filters import between_dates, matched_only
from gateflow.operators.reshape import hourly_kpi
from gateflow.plans import marts
from gateflow.plans.layers import int_flow, raw_order
from gateflow.plans.metrics import maturity
from gateflow.sinks.tables import conform, replace_partitions, scratch_path, write_spread, write_table

MONTH = "part_month"
_EXACT = "decimal(38,0)"


def _total(c: str | Column) -> Column:
    return F.sum(c).cast("bigint")


# --- sums per month -----------------------------------------------------------------------


def flow_sums(daily: DataFrame) -> DataFrame:
    """Days, flow and squared flow per station, line, day label and month."""
    flow = marts.both_ways().cast(_EXACT)
    return daily.groupBy(MONTH, "stn_name", "line_num", "day_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flow).cast(_EXACT).alias("s"), F.sum(flow * flow).cast(_EXACT).alias("q")
    )


def profile_sums(kpi: DataFrame) -> DataFrame:
    """The sums of the station profile, per month. Rows without traffic count as 0, so
    that no month is left without a row and keeps what it had before."""
    traffic = (F.col("on_cnt") > 0) | (F.col("off_cnt") > 0)
    counts = ["on_cnt", "off_cnt", *(c for c in kpi.columns if c.startswith("peak_"))]
    rows = kpi.withColumns({c: F.when(traffic, F.col(c)).otherwise(0).cast("bigint") for c in counts})
    return rows.groupBy(MONTH, "stn_name").agg(*marts.profile_totals())


def place_sums(daily: DataFrame) -> DataFrame:
    """Boardings and alightings per station, line and month. The daily table has the names
    of the raw layer in standard form already, and a row per day."""
    return daily.groupBy(MONTH, "stn_name", "line_num").agg(_total("on_cnt").alias("on_cnt"), _total("off_cnt").alias("off_cnt"))


def hour_sums(flow: DataFrame) -> DataFrame:
    """Boardings and alightings per station, line, hour and month, unmatched ones too."""
    keys = [MONTH, "station_id", "station", "line", "hour"]
    return flow.groupBy(*keys).agg(_total("boarding").alias("boarding"), _total("alighting").alias("alighting"))


#: Table of monthly sums -> what it is made of.
MONTHLY: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "flow_sums": ("daily_trend", flow_sums),
    "profile_sums": ("hourly_kpi", profile_sums),
    "place_sums": ("daily_trend", place_sums),
    "hour_sums": ("int_flow", hour_sums),
    "site_sums": ("hourly_kpi", lambda kpi: marts.monthly_site_sums(kpi, F.col(MONTH))),
}


# --- marts from sums ----------------------------------------------------------------------


def spread(n: Column, s: Column, q: Column, kind: str = "pop") -> Column:
    """Coefficient of variation from count, sum and sum of squares; null when the average
    is 0. The root is taken of a whole number, so nothing cancels."""
    n, s, q = (x.cast(_EXACT) for x in (n, s, q))
    around = F.sqrt((n * q - s * s).cast("double"))
    if kind == "samp":
        around = F.when(n > 1, around * F.sqrt(F.try_divide(n.cast("double"), (n - 1).cast("double"))))
    return F.try_divide(around, s.cast("double"))


def station_metrics(
    sums: DataFrame,
    year: int = 2021,
    years: Sequence[int] = YEARS,
    t: Thresholds = THRESHOLDS,
    tasks: int | None = None,
) -> DataFrame:
    """plans.metrics.station_metrics from flow_sums.

    Groups are wide and there may be as many in each scan task as there are stations and
    lines; with `tasks` rows, a few per month, are dealt to so many tasks before they are
    grouped.
    """
    yr = F.year(MONTH)
    if tasks:
        sums = sums.repartition(tasks, "stn_name", "line_num")

    def part(condition: Column) -> tuple[Column, Column]:
        own = lambda c: F.sum(F.when(condition, F.col(c))).cast(_EXACT)
        return own("s"), F.coalesce(own("n"), F.lit(0).cast(_EXACT))

    s1, c1 = part(yr == year)
    s0, c0 = part(yr == year - 1)
    now = lambda c: F.sum(F.when(yr == year, F.col(c)))
    told = sums.groupBy("stn_name", "line_num").agg(
        round_ratio(*part((yr == year) & (F.col("day_label") == WEEKDAY)), 0).alias("weekday_avg"),
        *[round_ratio(*part(yr == y), 0).alias(f"v{y}") for y in years],
        F.round(spread(now("n"), now("s"), now("q")), 3).alias("volatility"),
        (s1 * c0).alias("_cur"),
        (s0 * c1).alias("_prev"),
        (c1 * c0).alias("_den"),
    )
    c, p = F.col("_cur"), F.col("_prev")
    return told.select(
        "stn_name",
        "line_num",
        "weekday_avg",
        round_ratio(c - p, F.col("_den"), 0).alias("diff_amount"),
        *[f"v{y}" for y in years],
        "volatility",
        maturity(c, p, t).alias("market_maturity"),
        round_ratio((c - p) * 100, p, 2).alias("growth_rate"),
    )


def shock_mart(sums: DataFrame, base_year: int = 2019, shock_year: int = 2020) -> DataFrame:
    """plans.marts.shock_mart from flow_sums."""
    yr = F.year(MONTH)
    mean = lambda y: F.try_divide(
        F.sum(F.when(yr == y, F.col("s"))).cast("double"), F.sum(F.when(yr == y, F.col("n"))).cast("double")
    )
    a, b = f"v{base_year}", f"v{shock_year}"
    told = sums.groupBy("stn_name").agg(
        mean(base_year).alias(a),
        mean(shock_year).alias(b),
        spread(F.sum("n"), F.sum("s"), F.sum("q"), "samp").alias("volatility"),
        F.count_if(yr.isin(base_year, shock_year)).alias("_months"),
    )
    return told.where("_months > 0").select(
        "stn_name", a, b, F.try_divide(F.col(b) - F.col(a), F.col(a)).alias("shock_index"), "volatility"
    )


def station_spatial(sums: DataFrame) -> DataFrame:
    """plans.marts.station_spatial from place_sums."""
    totals = sums.groupBy("stn_name", "line_num").agg(
        _total("on_cnt").alias("total_on_cnt"),
        _total("off_cnt").alias("total_off_cnt"),
        (_total("on_cnt") - _total("off_cnt")).alias("net_flow_cnt"),
    )
    return conform(totals, marts.SPATIAL_SCHEMA)


def station_hours(sums: DataFrame) -> DataFrame:
    """plans.marts.station_hour_totals from hour_sums."""
    return matched_only(sums).groupBy("station_id", "station", "line", "hour").agg(
        _total("boarding").alias("boarding"),
        _total("alighting").alias("alighting"),
        (_total("boarding") - _total("alighting")).alias("net_flow"),
    )


def station_profile(sums: DataFrame, start: str, end: str, t: Thresholds = THRESHOLDS) -> DataFrame:
    """plans.marts.station_profile from profile_sums; the period holds whole months."""
    months = between_dates(sums, MONTH, start, end)
    names = [c for c in sums.columns if c not in (MONTH, "stn_name")]
    base = months.groupBy("stn_name").agg(*[_total(c).alias(c) for c in names]).where("total > 0")
    return marts.profile_of(base, t)


# --- the tables on disk -------------------------------------------------------------------


def _flow_by_month(spark: SparkSession, path: str, months: Sequence[date] | None) -> None:
    """Hourly, daily and intermediate rows and the monthly sums of some months, or all.

    Raw rows are stored by month in the order of raw_order; hourly and intermediate rows are written
    along them, row by row, and need no shuffle of their own.
    """
    replace = months is not None

    def table(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        return df.where(F.col(MONTH).isin(list(months))) if replace else df

    def along(df: DataFrame, name: str) -> None:
        rows = df.withColumn(MONTH, month_start(F.col("base_date")))
        write_spread(rows, f"{path}/{name}", [MONTH], marts.OPEN_MONTHS, replace)

    def write(df: DataFrame, name: str, sort: Sequence[str]) -> None:
        put = replace_partitions if replace else write_table
        put(df, f"{path}/{name}", partition_by=[MONTH], sort_by=sort)

    calendar = spark.read.parquet(f"{path}/calendar")
    along(hourly_kpi(table("raw")), "hourly_kpi")
    write(marts.daily_trend(table("hourly_kpi"), calendar, [MONTH]), "daily_trend", ["stn_name", "base_date"])
    along(int_flow(table("raw"), spark.read.parquet(f"{path}/name_map")), "int_flow")
    for name, (source, sums) in MONTHLY.items():
        write(sums(table(source)), name, [])


def growth_of(sums: DataFrame, period: tuple[str, str], months: Sequence[date] | None = None) -> DataFrame:
    """Growth against the year before from flow_sums, of some months or all of the period.
    Of the sums only those months and the ones a year before are read."""
    within = between_dates(sums, MONTH, *period)
    if months is not None:
        back = [m.replace(year=m.year - 1) for m in months]
        within = within.where(F.col(MONTH).isin([*months, *back]))
    totals = within.groupBy(F.col(MONTH).alias("base_ym"), "stn_name").agg(_total("s").alias("monthly_total_passenger"))
    now = totals if months is None else totals.where(F.col("base_ym").isin(list(months)))
    before = totals.select(
        year_later(F.col("base_ym")).alias("base_ym"), "stn_name", F.col("monthly_total_passenger").alias("prev_year_passenger")
    )
    both = now.join(before, ["base_ym", "stn_name"], "left")
    rate = round_ratio(F.col("monthly_total_passenger") * 100, F.col("prev_year_passenger"), 2)
    return both.select("base_ym", "stn_name", "monthly_total_passenger", "prev_year_passenger", rate.alias("recovery_rate"))


class Marts:
    """Marts below `path` that are refreshed by months."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        period: tuple[str, str] = marts.PERIOD,
        profile_period: tuple[str, str] = marts.PROFILE_PERIOD,
        shock_years: tuple[int, int] = (2019, 2020),
        divisor: int = THRESHOLDS.traffic_divisor,
    ):
        self.spark, self.path = spark, path
        self.period, self.profile_period, self.shock_years, self.divisor = period, profile_period, shock_years, divisor

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def build(self, raw: DataFrame, station_dim: DataFrame, calendar: DataFrame) -> Mapping[str, DataFrame]:
        """All tables from the raw layer, which is evaluated once."""
        raw = raw.withColumn(MONTH, month_start(F.col("base_date")))
        stored = write_table(raw, f"{self.path}/raw", partition_by=[MONTH], sort_by=raw_order())
        write_table(calendar, f"{self.path}/calendar")
        write_table(marts.name_map(stored, station_dim), f"{self.path}/name_map")
        _flow_by_month(self.spark, self.path, None)
        write_table(growth_of(self.table("flow_sums"), self.period), f"{self.path}/growth_trend", partition_by=["base_ym"])
        return self._totals()

    def refresh(self, raw: DataFrame, station_dim: DataFrame) -> Mapping[str, DataFrame]:
        """Take the rows of `raw` in place of all rows of the months they fall in, and
        make again what depends on those months.

        Names that the name map lacks are matched and added first.
        """
        raw = raw.withColumn(MONTH, month_start(F.col("base_date")))
        # evaluated once; what follows reads the stored rows
        raw = write_table(raw, scratch_path(self.spark, "delivered"), partition_by=[MONTH], sort_by=raw_order())
        write_spread(raw, f"{self.path}/raw", [MONTH], marts.OPEN_MONTHS, replace=True)
        months = sorted(r[0] for r in raw.select(MONTH).distinct().collect())  # a row per month
        touched = self.table("raw").where(F.col(MONTH).isin(months))
        known = self.table("name_map")
        fresh = marts.name_map(touched, station_dim).join(known, known.columns[0], "left_anti")
        fresh.coalesce(1).write.mode("append").parquet(f"{self.path}/name_map")
        _flow_by_month(self.spark, self.path, months)
        later = sorted({*months, *(m.replace(year=m.year + 1) for m in months)})
        replace_partitions(growth_of(self.table("flow_sums"), self.period, later), f"{self.path}/growth_trend", ["base_ym"])
        return self._totals()

    def _totals(self) -> Mapping[str, DataFrame]:
        """Marts over all months, from the monthly sums."""
        plans = {
            "station_spatial": station_spatial(self.table("place_sums")),
            "station_hours": station_hours(self.table("hour_sums")),
            "station_profile": station_profile(self.table("profile_sums"), *self.profile_period),
            "site_scores": marts.scores_of(
                between_dates(self.table("site_sums"), MONTH, *self.period).withColumnRenamed(MONTH, "base_ym"), self.divisor
            ),
            "shock": shock_mart(self.table("flow_sums"), *self.shock_years),
        }
        small = {name: write_table(df, f"{self.path}/{name}") for name, df in plans.items()}
        columns = ["base_ym", "stn_name", "monthly_total_passenger", "prev_year_passenger", "recovery_rate"]
        growth = self.table("growth_trend").select(*columns)
        return {"hourly_kpi": self.table("hourly_kpi"), "daily_trend": self.table("daily_trend"), "growth_trend": growth, **small}
