"""Filters written as ranges on plain columns, so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day(text: str) -> Column:
    return F.lit(date.fromisoformat(text))


def between_dates(
    df: DataFrame, col: str, a: str, b: str, month_col: str | None = None
) -> DataFrame:
    """Inclusive date range; month_col is the partition column of month starts, if any."""
    if month_col:
        df = df.where(F.col(month_col).between(_day(a[:8] + "01"), _day(b)))
    return df.where(F.col(col).between(_day(a), _day(b)))


def in_month(df: DataFrame, col: str, month: str, month_col: str | None = None) -> DataFrame:
    """Dates of one month, given as YYYY-MM."""
    first = date.fromisoformat(f"{month}-01")
    after = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    if month_col:
        df = df.where(F.col(month_col) == F.lit(first))
    return df.where((F.col(col) >= F.lit(first)) & (F.col(col) < F.lit(after)))


def in_years(df: DataFrame, col: str, years: Sequence[int]) -> DataFrame:
    """Dates of the given years, as one range per run of years."""
    runs: list[list[int]] = []
    for y in sorted(set(years)):
        if runs and runs[-1][1] == y - 1:
            runs[-1][1] = y
        else:
            runs.append([y, y])
    cond = F.lit(False)
    for a, b in runs:
        cond = cond | F.col(col).between(F.lit(date(a, 1, 1)), F.lit(date(b, 12, 31)))
    return df.where(cond)


def with_traffic(df: DataFrame, on: str = "on_cnt", off: str = "off_cnt") -> DataFrame:
    """Rows with any boarding or alighting."""
    return df.where((F.col(on) > 0) | (F.col(off) > 0))


def matched_only(df: DataFrame, col: str = "station_id") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def pick(df: DataFrame, **wanted) -> DataFrame:
    """Equality per column, or membership for a list; None leaves the column free."""
    for col, value in wanted.items():
        if value is None:
            continue
        values = list(value) if isinstance(value, (list, tuple, set)) else None
        df = df.where(F.col(col).isin(values) if values is not None else F.col(col) == F.lit(value))
    return df


def pick_pairs(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple]) -> DataFrame:
    """Rows whose columns equal one of the given value tuples."""
    cond = F.lit(False)
    for values in pairs:
        one = F.lit(True)
        for c, v in zip(cols, values):
            one = one & (F.col(c) == F.lit(v))
        cond = cond | one
    return df.where(cond)


def valid_dates(df: DataFrame, col: str = "base_date") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def search_stations(
    df: DataFrame,
    text: str | None = None,
    line: int | None = None,
    area: str | None = None,
    grade: str | None = None,
    locale: str = "ko",
) -> DataFrame:
    """Stations whose name holds the text, with optional line, area type and grade.

    Ordered by name in the order of the locale.
    """
    if text:
        df = df.where(F.coalesce(F.col("display_name"), F.lit("")).contains(text))
    df = pick(df, line_num=line, area_type=area, location_grade=grade)
    return order_by_locale(df, "display_name", locale, ["line_num"])


def order_by_locale(
    df: DataFrame, col: str, locale: str = "ko", then: Sequence[str] = ()
) -> DataFrame:
    return df.orderBy(F.collate(F.col(col), locale), *then)
