"""Composite queries over the marts, for one, some or all stations in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateflow.config import (
    DEFAULT_AREA,
    THRESHOLDS,
    YEAR_WEIGHTS,
    YEARS,
    Thresholds,
)
from gateflow.functions.names import format_station, join_key
from gateflow.functions.numbers import round_ratio
from gateflow.operators.filters import in_month, in_years, pick, pick_pairs
from gateflow.operators.ordered import first_by
from gateflow.plans import metrics as m
from gateflow.plans.marts import both_ways

SCORES = ("total_traffic_score", "office_score", "night_life_score")


def profile_with_scores(profile: DataFrame, scores: DataFrame, year: int) -> DataFrame:
    """Profile with the monthly scores of a year; one row without scores if there are none."""
    of_year = in_years(scores, "base_ym", [year]).select(
        "stn_name", "base_ym", *SCORES, "recommended_biz"
    )
    return profile.select("stn_name", "area_type").join(of_year, "stn_name", "left")


def first_month(profile: DataFrame, scores: DataFrame, year: int) -> DataFrame:
    """Scores of the first month of the year, per station."""
    return first_by(profile_with_scores(profile, scores, year), ["stn_name"], ["base_ym"])


def station_report(
    daily: DataFrame,
    profile: DataFrame,
    scores: DataFrame,
    year: int = 2021,
    stations: Sequence[str] | None = None,
    line: int | None = None,
    pairs: Sequence[tuple[str, int]] | None = None,
    years: Sequence[int] = YEARS,
    recovery_years: tuple[int, int] = (2019, 2020),
    year_weights: Mapping[int, float] = YEAR_WEIGHTS,
    t: Thresholds = THRESHOLDS,
) -> DataFrame:
    """Report per station and line: metrics, grade, business, texts.

    A station without rows gives no row. The filters are equalities on the marts
    and reach their scans.
    """
    if stations is not None:
        names = [format_station(s) for s in stations]
        daily, profile, scores = (pick(df, stn_name=names) for df in (daily, profile, scores))
    if pairs is not None:
        pairs = [(format_station(s), n) for s, n in pairs]
        daily = pick_pairs(daily, ["stn_name", "line_num"], pairs)
        names = sorted({s for s, _ in pairs})
        profile, scores = (pick(df, stn_name=names) for df in (profile, scores))
    daily = pick(daily, line_num=line)

    whole = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    traffic, office, night = (number(c) for c in SCORES)
    score = (traffic + office + night) / 3
    base, shock = (f"v{y}" for y in recovery_years)

    rows = m.station_metrics(daily, year, years, t).join(
        first_month(profile, scores, year), "stn_name", "left"
    )
    rows = rows.select(
        F.col("stn_name").alias("station_name"),
        "line_num",
        whole("weekday_avg").alias("weekday_avg"),
        number("growth_rate").alias("growth_rate"),
        whole("diff_amount").alias("diff_amount"),
        number("volatility").alias("volatility"),
        "market_maturity",
        m.grade(score, t).alias("location_grade"),
        m.analysis_score(score, t).alias("analysis_score"),
        F.coalesce("area_type", F.lit(DEFAULT_AREA)).alias("commercial_type"),
        m.insight(F.col("stn_name"), year, whole("diff_amount")).alias("insight_text"),
        *[whole(f"v{y}").alias(f"v{y}") for y in years],
        m.recovery(whole(base), whole(shock)).alias("recovery_rate"),
        m.recommendations(F.col("recommended_biz"), office, night).alias("recommendations"),
    )
    rows = m.normalise_year(rows, year_weights)
    return rows.select(
        "*",
        m.strategy(F.col("market_maturity")).alias("strategy"),
        *m.recovery_view(F.col("recovery_rate"), t),
        m.growth_mark(F.col("growth_rate")).alias("growth_mark"),
    )


def compare(
    daily: DataFrame,
    profile: DataFrame,
    scores: DataFrame,
    pairs: Sequence[tuple[str, int]],
    year: int = 2021,
    years: Sequence[int] = YEARS,
    **options,
) -> DataFrame:
    """Comparison of two or more (station, line) pairs in one job."""
    if len(pairs) < 2:
        raise ValueError("compare takes two or more stations")
    report = station_report(
        daily, profile, scores, year, pairs=pairs, years=years, **options
    )
    return report.select(
        "station_name",
        "line_num",
        "location_grade",
        "recovery_rate",
        "recovery_percent",
        *[f"v{y}" for y in years],
    )


def station_list(
    spatial: DataFrame,
    dim: DataFrame,
    profile: DataFrame,
    scores: DataFrame,
    year: int = 2021,
    t: Thresholds = THRESHOLDS,
) -> DataFrame:
    """Stations that have coordinates, with area type, mean score of the year and grade.

    Each side is brought to one row per name before the joins, so names that
    occur several times cannot multiply rows; a mean over multiplied rows would
    be the same.
    """
    key = F.col("_key")
    places = dim.groupBy(join_key(F.col("station_clean")).alias("_key")).agg(
        F.max("lat").alias("lat"), F.max("lng").alias("lng")
    )
    areas = profile.groupBy(join_key(F.col("stn_name")).alias("_key")).agg(
        F.max("area_type").alias("area_type")
    )
    # two decimals each, so the sum is exact whatever the order of the rows
    points = [F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,2)") for c in SCORES]
    means = (
        in_years(scores, "base_ym", [year])
        .groupBy(join_key(F.col("stn_name")).alias("_key"))
        .agg(
            F.sum(points[0] + points[1] + points[2]).cast("double").alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    names = spatial.groupBy("stn_name", "line_num").agg(F.count(F.lit(1)).alias("_rows"))
    joined = (
        names.withColumn("_key", join_key(F.col("stn_name")))
        .join(places, "_key")
        .join(areas, "_key", "left")
        .join(means, "_key", "left")
    )
    score = F.coalesce(F.col("_sum") / F.col("_n") / 3, F.lit(0.0))
    return joined.select(
        F.col("stn_name").alias("display_name"),
        "line_num",
        "lat",
        "lng",
        "area_type",
        score.alias("avg_score"),
        m.grade(score, t).alias("location_grade"),
    )


def hourly_pattern(
    kpi: DataFrame,
    month: str,
    station: str | None = None,
    line: int | None = None,
    month_col: str | None = None,
) -> DataFrame:
    """Average of the daily sums per hour in a month, per station and line.

    The hourly mart has several rows per key, so days are summed first. The
    station name is taken as given.
    """
    keys = ["stn_name", "line_num", "hour"]
    rows = pick(in_month(kpi, "base_date", month, month_col), stn_name=station, line_num=line)
    days = rows.groupBy(*keys, "base_date").agg(
        F.sum("on_cnt").alias("day_on"), F.sum("off_cnt").alias("day_off")
    )
    mean = lambda c: round_ratio(F.sum(c), F.count(c), 0).cast("bigint")
    return (
        days.groupBy(*keys)
        .agg(mean("day_on").alias("avg_on"), mean("day_off").alias("avg_off"))
        .orderBy(*keys)
    )


def calendar_heatmap(
    daily: DataFrame,
    month: str,
    station: str | None = None,
    t: Thresholds = THRESHOLDS,
    month_col: str | None = None,
) -> DataFrame:
    """Daily totals of a month over all lines, with intensity and calendar offset.

    The windows run over the at most 31 rows of a station and month.
    """
    rows = in_month(daily, "base_date", month, month_col)
    rows = pick(rows, stn_name=format_station(station))
    days = rows.groupBy("stn_name", "base_date").agg(
        F.sum(both_ways()).cast("bigint").alias("count"), F.max("day_label").alias("day_label")
    )
    per_station = Window.partitionBy("stn_name")
    most = F.max("count").over(per_station)
    ratio = F.col("count") / F.when(most == 0, 1).otherwise(most)
    return days.select(
        "stn_name",
        "base_date",
        "count",
        "day_label",
        F.greatest(F.lit(t.heat_floor), ratio).alias("intensity"),
        F.weekday(F.min("base_date").over(per_station)).alias("first_offset"),
    ).orderBy("stn_name", "base_date")


def daily_flow(daily: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Flow of each date and station over all lines. `also` names columns that follow from
    the date; rows dealt by them and the station are not dealt again."""
    flow = daily.groupBy(*also, "base_date", "stn_name").agg(
        F.sum(both_ways()).cast("bigint").alias("total_flow"), F.max("day_label").alias("day_label")
    )
    return flow.drop(*also)


def station_history(
    daily: DataFrame, station: str | None = None, also: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """Flow by date with the kind of day, for one station or each station.

    One station's rows are sorted as a whole. For all of them each station is
    brought to one task, of `tasks` if given, so dates are in order within a station
    without a sort of the whole table.
    """
    flow = daily_flow(pick(daily, stn_name=station), also).select(
        "stn_name", F.year("base_date").alias("yr"), "base_date", "total_flow", "day_label"
    )
    if station is not None:
        return flow.orderBy("stn_name", "base_date")
    dealt = flow.repartition(tasks, "stn_name") if tasks else flow.repartition("stn_name")
    return dealt.sortWithinPartitions("stn_name", "base_date")
