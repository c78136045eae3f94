"""Metric rules on top of the marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.config import (
    DOWN,
    EVENING_REASON,
    EVENING_SHORT,
    FLOW_TYPES,
    GROW_STRATEGY,
    KEEP_STRATEGY,
    MATURITY,
    MORNING,
    NO_BIZ,
    OFFICE_REASON,
    THRESHOLDS,
    UP,
    WEEKDAY,
    YEAR_WEIGHTS,
    YEARS,
    Thresholds,
)
from gateflow.functions.numbers import (
    exceeds,
    grouped_digits,
    in_window,
    round_ratio,
    round_ratio_binary,
    sum_when,
)
from gateflow.plans.marts import both_ways, variation

_EXACT = "decimal(38,0)"


def _mean(condition: Column) -> tuple[Column, Column]:
    """Sum and row count of the flow under a condition, exact in whole numbers."""
    value = F.when(condition, both_ways())
    return F.sum(value).cast(_EXACT), F.count(value).cast(_EXACT)


def _against(year: int) -> tuple[Column, Column, Column]:
    """This year's and last year's average over the same denominator.

    (s1/c1, s0/c0) = (s1*c0, s0*c1) / (c1*c0), so the two are compared and
    divided without rounding in between.
    """
    yr = F.year("base_date")
    s1, c1 = _mean(yr == year)
    s0, c0 = _mean(yr == year - 1)
    return s1 * c0, s0 * c1, c1 * c0


def maturity(cur: Column, prev: Column, t: Thresholds = THRESHOLDS) -> Column:
    """Growth, mature or decline by the ratio to last year; without one, decline."""
    grow, mature, decline = MATURITY
    known = prev > 0
    return (
        F.when(known & exceeds(cur, prev, t.growth_above), grow)
        .when(known & exceeds(cur, prev, t.mature_from, or_equal=True), mature)
        .otherwise(decline)
    )


def year_averages(
    daily: DataFrame, year: int, years: Sequence[int] = YEARS
) -> DataFrame:
    """Average daily flow per year, of weekdays, and the change to the year before."""
    yr = F.year("base_date")
    cur, prev, den = _against(year)
    return daily.groupBy("stn_name", "line_num").agg(
        round_ratio(*_mean((yr == year) & (F.col("day_label") == WEEKDAY)), 0).alias("weekday_avg"),
        round_ratio(cur - prev, den, 0).alias("diff_amount"),
        *[round_ratio(*_mean(yr == y), 0).alias(f"v{y}") for y in years],
    )


def station_metrics(
    daily: DataFrame,
    year: int = 2021,
    years: Sequence[int] = YEARS,
    t: Thresholds = THRESHOLDS,
) -> DataFrame:
    """All metrics of a year, one row per station and line, from one aggregate."""
    yr = F.year("base_date")
    cur, prev, den = _against(year)
    sums = daily.groupBy("stn_name", "line_num").agg(
        round_ratio(*_mean((yr == year) & (F.col("day_label") == WEEKDAY)), 0).alias("weekday_avg"),
        *[round_ratio(*_mean(yr == y), 0).alias(f"v{y}") for y in years],
        F.round(variation(F.when(yr == year, both_ways()), "pop"), 3).alias("volatility"),
        cur.alias("_cur"),
        prev.alias("_prev"),
        den.alias("_den"),
    )
    c, p = F.col("_cur"), F.col("_prev")
    return sums.select(
        "stn_name",
        "line_num",
        "weekday_avg",
        round_ratio(c - p, F.col("_den"), 0).alias("diff_amount"),
        *[f"v{y}" for y in years],
        "volatility",
        maturity(c, p, t).alias("market_maturity"),
        round_ratio((c - p) * 100, p, 2).alias("growth_rate"),
    )


def grade(score: Column, t: Thresholds = THRESHOLDS) -> Column:
    """S, A or B; no score gives B."""
    return F.when(score >= t.grade_s, "S").when(score >= t.grade_a, "A").otherwise("B")


def analysis_score(score: Column, t: Thresholds = THRESHOLDS) -> Column:
    return F.round(score * t.score_scale, 1)


def recovery(base: Column, shock: Column) -> Column:
    """Shock year over base year; a base of 0 or null counts as 1."""
    safe = F.when(base.isNull() | (base == 0), 1).otherwise(base)
    return round_ratio_binary(F.coalesce(shock, F.lit(0)), safe)


def normalise_year(
    df: DataFrame, weights: Mapping[int, float] = YEAR_WEIGHTS, prefix: str = "v"
) -> DataFrame:
    """Year columns times their weight, rounded down; for a change of counting rules."""
    return df.withColumns(
        {
            f"{prefix}{y}": F.floor(F.col(f"{prefix}{y}") * F.lit(w)).cast("bigint")
            for y, w in weights.items()
            if f"{prefix}{y}" in df.columns
        }
    )


def recommendations(biz: Column, office: Column, night: Column) -> Column:
    """List with the suggested business and the reason, or a no-data entry."""
    known = F.coalesce(biz, F.lit("")) != ""
    reason = F.when(office > night, OFFICE_REASON).otherwise(EVENING_REASON)
    return F.array(
        F.struct(
            F.when(known, biz).otherwise(NO_BIZ[0]).alias("category"),
            F.when(known, reason).otherwise(NO_BIZ[1]).alias("desc"),
        )
    )


def insight(name: Column, year: int, diff: Column) -> Column:
    """Sentence on the change against the year before."""
    return F.concat(
        name,
        F.lit(f"은 {year}년 기준 전년 대비 유동인구가 약 "),
        grouped_digits(F.abs(diff)),
        F.lit("명 "),
        F.when(diff < 0, DOWN).otherwise(UP),
        F.lit("하였습니다."),
    )


def strategy(market_maturity: Column) -> Column:
    return F.when(market_maturity == MATURITY[2], KEEP_STRATEGY).otherwise(GROW_STRATEGY)


def recovery_view(rate: Column, t: Thresholds = THRESHOLDS) -> list[Column]:
    """Display values of the recovery rate: percent, capped percent, band."""
    percent = F.round(rate * 100, 1)
    return [
        percent.alias("recovery_percent"),
        F.least(percent, F.lit(100.0)).alias("recovery_capped"),
        (rate > t.recovery_band).alias("recovery_good"),
    ]


def growth_mark(rate: Column) -> Column:
    return F.when(rate > 0, "▲").otherwise("▼")


def flow_type(kpi: DataFrame, keys: Sequence[str] = ("stn_name",)) -> DataFrame:
    """Inflow, outflow or mixed by morning boardings, evening alightings and net flow."""
    hour = F.col("hour")
    sums = kpi.groupBy(*keys).agg(
        sum_when(in_window(hour, MORNING), F.col("on_cnt")).alias("morning_on"),
        sum_when(in_window(hour, EVENING_SHORT), F.col("off_cnt")).alias("evening_off"),
        (F.sum("on_cnt") - F.sum("off_cnt")).cast("bigint").alias("net_flow"),
    )
    morning, evening = F.col("morning_on"), F.col("evening_off")
    kind = (
        F.when((evening > morning) & (F.col("net_flow") > 0), "in")
        .when(morning > evening, "out")
        .otherwise("mixed")
    )

    def text(place: int) -> Column:
        known = kind
        out = F.when(known == "in", _value(FLOW_TYPES["in"][place]))
        out = out.when(known == "out", _value(FLOW_TYPES["out"][place]))
        return out.otherwise(_value(FLOW_TYPES["mixed"][place]))

    return sums.select(
        *keys,
        "morning_on",
        "evening_off",
        "net_flow",
        text(0).alias("flow_type"),
        text(1).alias("description"),
        text(2).alias("recommend"),
    )


def _value(v) -> Column:
    return F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
