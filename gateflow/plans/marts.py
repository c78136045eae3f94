"""Marts over the raw, intermediate and hourly layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateflow.config import (
    AREA_COMMERCIAL,
    AREA_MIXED,
    AREA_OFFICE,
    EVENING_PROFILE,
    EVENING_SHORT,
    LUNCH,
    MONTHLY_BIZ,
    MORNING,
    PROFILE_BIZ,
    THRESHOLDS,
    Thresholds,
)
from gateflow.functions.dates import month_start, month_text, year_later
from gateflow.functions.names import station_name
from gateflow.functions.numbers import digits_int, exceeds, in_window, round_ratio, sum_when
from gateflow.operators.filters import between_dates, in_years, matched_only, with_traffic
from gateflow.operators.joins import name_map, with_day_label
from gateflow.operators.reshape import hourly_kpi
from gateflow.plans.layers import int_flow, raw_order
from gateflow.sinks.tables import conform, write_spread, write_table

PERIOD = ("2017-01-01", "2021-12-31")
PROFILE_PERIOD = ("2018-01-01", "2021-12-31")
#: Months that a task writing along a table by month may have files open for; a scan task
#: takes no more files than that, each of one month.
OPEN_MONTHS = 32
#: Raw rows, sorted, take over ten times their shuffled size.
RAW_CUT = 4


def both_ways() -> Column:
    """Boardings plus alightings of a row."""
    return F.col("on_cnt") + F.col("off_cnt")


def _field(name: str, kind: T.DataType, comment: str) -> T.StructField:
    return T.StructField(name, kind, True, {"comment": comment})


SPATIAL_SCHEMA = T.StructType(
    [
        _field("stn_name", T.StringType(), "standard station name with suffix"),
        _field("line_num", T.IntegerType(), "line number"),
        _field("total_on_cnt", T.LongType(), "boardings over the whole period"),
        _field("total_off_cnt", T.LongType(), "alightings over the whole period"),
        _field("net_flow_cnt", T.LongType(), "boardings minus alightings"),
    ]
)


def _total(c: str) -> Column:
    return F.sum(c).cast("bigint")


# --- totals -----------------------------------------------------------------------


def station_spatial(raw: DataFrame) -> DataFrame:
    """Totals per station and line over the whole period. Names are made standard once
    per spelling, not once per row."""
    spelled = raw.groupBy("station", "line").agg(
        _total("boarding").alias("boarding"), _total("alighting").alias("alighting")
    )
    keys = [station_name(F.col("station")).alias("stn_name"), digits_int(F.col("line")).alias("line_num")]
    totals = spelled.groupBy(*keys).agg(
        _total("boarding").alias("total_on_cnt"),
        _total("alighting").alias("total_off_cnt"),
        (_total("boarding") - _total("alighting")).alias("net_flow_cnt"),
    )
    return conform(totals, SPATIAL_SCHEMA)


def station_hour_totals(flow: DataFrame) -> DataFrame:
    """Totals per matched station, line and hour."""
    return (
        matched_only(flow)
        .groupBy("station_id", "station", "line", "hour")
        .agg(
            _total("boarding").alias("boarding"),
            _total("alighting").alias("alighting"),
            (_total("boarding") - _total("alighting")).alias("net_flow"),
        )
    )


def peak_boarding(mart: DataFrame) -> DataFrame:
    """Morning and evening boardings per station."""
    hour = F.col("hour").cast("int")
    return mart.groupBy("station").agg(
        sum_when(in_window(hour, MORNING), F.col("boarding")).alias("morning_peak"),
        sum_when(in_window(hour, EVENING_SHORT), F.col("boarding")).alias("evening_peak"),
    )


def dealt_by_month(kpi: DataFrame, tasks: int) -> DataFrame:
    """Rows with their month, dealt by month and station to `tasks` tasks. What groups by
    these and more needs no other shuffle, and no hash table of a whole scan task; the
    caller takes a number of tasks that goes with the number of rows."""
    rows = kpi.withColumn("part_month", month_start(F.col("base_date")))
    return rows.repartition(tasks, "part_month", "stn_name")


def daily_trend(kpi: DataFrame, calendar: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """One row per date, station and line; with a calendar also the day label. `also` names
    columns that follow from the date and are kept, as the month of dealt_by_month."""
    daily = kpi.groupBy(*also, "base_date", "stn_name", "line_num").agg(
        _total("on_cnt").alias("on_cnt"),
        _total("off_cnt").alias("off_cnt"),
        (_total("on_cnt") + _total("off_cnt")).alias("total_flow"),
    )
    return daily if calendar is None else with_day_label(daily, calendar)


def monthly_total(daily: DataFrame) -> DataFrame:
    return daily.groupBy(month_start(F.col("base_date")).alias("base_ym"), "stn_name").agg(
        F.sum(both_ways()).cast("bigint").alias("monthly_total_passenger")
    )


# --- growth against the year before -------------------------------------------------


def growth_trend(
    daily: DataFrame,
    start: str = PERIOD[0],
    end: str = PERIOD[1],
    form: str = "window",
    month_col: str | None = None,
) -> DataFrame:
    """Month against the same month one year before, per station, in percent.

    The window form looks twelve months back by value, so a gap in the months
    gives null and not another month; it aggregates once, where the join form
    aggregates both sides.
    """
    months = monthly_total(between_dates(daily, "base_date", start, end, month_col))
    if form == "window":
        number = F.year("base_ym") * 12 + F.month("base_ym")
        back = Window.partitionBy("stn_name").orderBy(number).rangeBetween(-12, -12)
        both = months.withColumn(
            "prev_year_passenger", F.sum("monthly_total_passenger").over(back)
        )
    elif form == "join":
        before = months.select(
            year_later(F.col("base_ym")).alias("base_ym"),
            "stn_name",
            F.col("monthly_total_passenger").alias("prev_year_passenger"),
        )
        both = months.join(before, ["base_ym", "stn_name"], "left")
    else:
        raise ValueError(f"unknown form {form!r}")
    return both.select(
        "base_ym",
        "stn_name",
        "monthly_total_passenger",
        "prev_year_passenger",
        round_ratio(
            F.col("monthly_total_passenger") * 100, F.col("prev_year_passenger"), 2
        ).alias("recovery_rate"),
    )


def available_months(growth: DataFrame) -> DataFrame:
    """Distinct months, newest first, as YYYY-MM."""
    months = growth.groupBy("base_ym").agg(F.count(F.lit(1)).alias("n"))
    return months.select(month_text(F.col("base_ym")).alias("base_ym")).orderBy(
        F.col("base_ym").desc()
    )


# --- profile and site scores ----------------------------------------------------------


def profile_base(
    kpi: DataFrame,
    start: str = PROFILE_PERIOD[0],
    end: str = PROFILE_PERIOD[1],
    month_col: str | None = None,
) -> DataFrame:
    """Sums per station by hour window; stations without traffic are left out."""
    rows = with_traffic(between_dates(kpi, "base_date", start, end, month_col))
    return rows.groupBy("stn_name").agg(*profile_totals()).where("total > 0")


def profile_totals() -> list[Column]:
    """Sums of a profile, over hourly rows."""
    hour = F.col("hour")
    return [
        F.sum(both_ways()).cast("bigint").alias("total"),
        sum_when(in_window(hour, MORNING), both_ways()).alias("morning"),
        sum_when(in_window(hour, LUNCH), both_ways()).alias("lunch"),
        sum_when(in_window(hour, EVENING_PROFILE), both_ways()).alias("evening"),
        _total("peak_morning_off").alias("morning_off"),
        _total("peak_evening_off").alias("evening_off"),
    ]


def area_type(t: Thresholds = THRESHOLDS) -> Column:
    morning, evening = F.col("morning_off"), F.col("evening_off")
    return (
        F.when(exceeds(morning, evening, t.area_ratio), AREA_OFFICE)
        .when(exceeds(evening, morning, t.area_ratio), AREA_COMMERCIAL)
        .otherwise(AREA_MIXED)
    )


def station_profile(
    kpi: DataFrame,
    start: str = PROFILE_PERIOD[0],
    end: str = PROFILE_PERIOD[1],
    t: Thresholds = THRESHOLDS,
    month_col: str | None = None,
) -> DataFrame:
    """Share of the hour windows in percent, area type and suggested business."""
    return profile_of(profile_base(kpi, start, end, month_col), t)


def profile_of(base: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Profile from the sums of profile_base."""
    kind = F.col("area_type")
    biz = F.when(kind == AREA_OFFICE, PROFILE_BIZ[AREA_OFFICE])
    biz = biz.when(kind == AREA_COMMERCIAL, PROFILE_BIZ[AREA_COMMERCIAL])
    return base.withColumn("area_type", area_type(t)).select(
        "stn_name",
        F.col("total").alias("total_cnt"),
        *[
            round_ratio(F.col(w) * 100, F.col("total"), 2).alias(f"{w}_ratio")
            for w in ("morning", "lunch", "evening")
        ],
        "area_type",
        biz.otherwise(PROFILE_BIZ[AREA_MIXED]).alias("recommended_biz"),
    )


def monthly_site(
    kpi: DataFrame,
    start: str = PERIOD[0],
    end: str = PERIOD[1],
    month_col: str | None = None,
) -> DataFrame:
    """Monthly sums per station: total, alightings, morning and evening alightings."""
    rows = between_dates(kpi, "base_date", start, end, month_col)
    return monthly_site_sums(rows, month_start(F.col("base_date")).alias("base_ym"))


def monthly_site_sums(kpi: DataFrame, month: Column) -> DataFrame:
    return kpi.groupBy(month, "stn_name").agg(
        F.sum(both_ways()).cast("bigint").alias("total"),
        _total("off_cnt").alias("total_off"),
        _total("peak_morning_off").alias("morning_off"),
        _total("peak_evening_off").alias("evening_off"),
    )


def site_scores(
    kpi: DataFrame,
    start: str = PERIOD[0],
    end: str = PERIOD[1],
    divisor: int = THRESHOLDS.traffic_divisor,
    month_col: str | None = None,
) -> DataFrame:
    """Monthly traffic, office and night scores with a suggested business.

    Here the business follows the plain comparison, without the ratio that the
    station profile asks for.
    """
    return scores_of(monthly_site(kpi, start, end, month_col), divisor)


def scores_of(sums: DataFrame, divisor: int = THRESHOLDS.traffic_divisor) -> DataFrame:
    """Scores from the sums of monthly_site."""
    morning, evening, off = F.col("morning_off"), F.col("evening_off"), F.col("total_off")
    office_biz, night_biz, mixed_biz = MONTHLY_BIZ
    return sums.select(
        "base_ym",
        "stn_name",
        round_ratio(F.col("total"), F.lit(divisor), 2).alias("total_traffic_score"),
        round_ratio(morning * 100, off, 2).alias("office_score"),
        round_ratio(evening * 100, off, 2).alias("night_life_score"),
        F.when(morning > evening, office_biz)
        .when(evening > morning, night_biz)
        .otherwise(mixed_biz)
        .alias("recommended_biz"),
    )


# --- shock and volatility ---------------------------------------------------------------


def pivot_years(daily: DataFrame, years: Sequence[int], value: str = "total_flow") -> DataFrame:
    """Average daily flow per station, one column per year."""
    rows = in_years(daily, "base_date", years).withColumn("yr", F.year("base_date"))
    wide = rows.groupBy("stn_name").pivot("yr", list(years)).avg(value)
    return wide.select("stn_name", *[F.col(str(y)).alias(f"v{y}") for y in years])


def variation(value: Column, kind: str = "pop") -> Column:
    """Coefficient of variation as an aggregate; null when the average is 0."""
    spread = {"pop": F.stddev_pop, "samp": F.stddev_samp}[kind]
    return F.try_divide(spread(value), F.avg(value))


def volatility(daily: DataFrame, kind: str = "samp", value: str = "total_flow") -> DataFrame:
    """Coefficient of variation over all days, per station."""
    return daily.groupBy("stn_name").agg(variation(F.col(value), kind).alias("volatility"))


def shock_mart(daily: DataFrame, base_year: int = 2019, shock_year: int = 2020) -> DataFrame:
    """Relative change between two years next to the volatility of all days.

    Stations need a day in one of the two years. Averages and volatility come
    from one aggregate, so nothing is joined.
    """
    flow, yr = F.col("total_flow"), F.year("base_date")
    a, b = f"v{base_year}", f"v{shock_year}"
    return (
        daily.groupBy("stn_name")
        .agg(
            F.avg(F.when(yr == base_year, flow)).alias(a),
            F.avg(F.when(yr == shock_year, flow)).alias(b),
            variation(flow, "samp").alias("volatility"),
            F.count_if(yr.isin(base_year, shock_year)).alias("_days"),
        )
        .where("_days > 0")
        .select(
            "stn_name",
            a,
            b,
            F.try_divide(F.col(b) - F.col(a), F.col(a)).alias("shock_index"),
            "volatility",
        )
    )


# --- all marts ----------------------------------------------------------------------------


def build_marts(
    raw: DataFrame,
    station_dim: DataFrame,
    calendar: DataFrame,
    path: str,
    period: tuple[str, str] = PERIOD,
    profile_period: tuple[str, str] = PROFILE_PERIOD,
    shock_years: tuple[int, int] = (2019, 2020),
    divisor: int = THRESHOLDS.traffic_divisor,
    grown: int = 0,
) -> Mapping[str, DataFrame]:
    """Write raw, name map, intermediate layer and all marts below path; return the
    marts as read back.

    raw is evaluated once: what follows reads the stored copy. It is stored by month and
    sorted by standard name and date; hourly and intermediate rows are written along it, row by
    row, so they are laid out the same way without a shuffle of their own. `grown` says
    that raw comes in that order already, from rows that each became so many
    (layers.raw_from_files by month).

    The two tables that others are built from are partitioned by month and
    sorted by station; the others read them, not the raw layer.
    """
    by_month = {"partition_by": ["part_month"], "sort_by": ["stn_name", "base_date"]}
    month = month_start(F.col("base_date"))
    raw = raw.withColumn("part_month", month)
    if grown:
        raw = write_spread(raw, f"{path}/raw", ["part_month"], OPEN_MONTHS, grows=grown)
    else:
        raw = write_table(raw, f"{path}/raw", partition_by=["part_month"], sort_by=raw_order(), cut=RAW_CUT)
    along = lambda df, name: write_spread(df.withColumn("part_month", month), f"{path}/{name}", ["part_month"], OPEN_MONTHS)
    kpi = along(hourly_kpi(raw), "hourly_kpi")
    daily = write_table(
        daily_trend(kpi, calendar).withColumn("part_month", month),
        f"{path}/daily_trend",
        **by_month,
    )
    m = "part_month"
    mapping = write_table(name_map(raw, station_dim), f"{path}/name_map")
    flow = along(int_flow(raw, mapping), "int_flow")
    plans = {
        "station_spatial": station_spatial(raw),
        "station_hours": station_hour_totals(flow),
        "station_profile": station_profile(kpi, *profile_period, month_col=m),
        "site_scores": site_scores(kpi, *period, divisor=divisor, month_col=m),
        "growth_trend": growth_trend(daily, *period, month_col=m),
        "shock": shock_mart(daily, *shock_years),
    }
    small = {name: write_table(df, f"{path}/{name}") for name, df in plans.items()}
    return {"hourly_kpi": kpi, "daily_trend": daily, **small}
