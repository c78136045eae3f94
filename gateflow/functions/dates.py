"""Column expressions for dates; hour 24 is a code, so times are never built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateflow.functions.names import trim_space

# accepted shapes, an optional time of day being ignored
_TIME = r"(?:[ T]\d{1,2}:.*)?$"
_YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME
_COMPACT = r"^(\d{4})(\d{2})(\d{2})" + _TIME
_DAY_FIRST = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME
_PARTS = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"


def parse_date(c: Column) -> Column:
    """Date from mixed texts: year first, compact, then day first; else null.

    A text whose month cannot be one is read with day and month exchanged.
    The shapes exclude each other, so they are rewritten to one shape and cast;
    that is cheaper per row than failing one date format after the other. Full dates
    without blanks, in any of the three shapes, are known by their places, without patterns.
    The patterns stand in a function of an array, which Spark does not compile: in one method
    with what else is done to a row they made it too long for the JVM to compile it.
    """
    sign = F.substring(c, 3, 1)
    turned = sign.isin("-", "/", ".") & (F.substring(c, 6, 1) == sign)
    plain = (
        F.when(F.length(c) == 8, F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))
        .when(turned, F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 4, 2), F.substring(c, 1, 2)))
        .otherwise(c)
    )
    known = plain.try_cast("date")
    full = (F.length(c) <= 10) & (F.length(plain) == 10) & (known.cast("string") == plain)
    return F.when(full, known).otherwise(F.transform(F.array(c.cast("string")), _searched)[0])


def _searched(c: Column) -> Column:
    s = F.regexp_replace(trim_space(c), _YEAR_FIRST, "$1-$3-$4")
    s = F.regexp_replace(s, _COMPACT, "$1-$2-$3")
    s = F.regexp_replace(s, _DAY_FIRST, "$4-$3-$1")
    iso = F.regexp_extract(s, _PARTS, 0)
    exchanged = F.regexp_replace(iso, _PARTS, "$1-$3-$2")
    return F.coalesce(iso.try_cast("date"), exchanged.try_cast("date"))


def iso_text(c: Column) -> Column:
    """Eight-digit dates, with or without dashes, as YYYY-MM-DD; other texts unchanged."""
    s = trim_space(F.replace(c, F.lit("-"), F.lit("")))
    return F.when(
        F.char_length(s) == 8,
        F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)),
    ).otherwise(s)


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM").cast("date")


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def year_later(c: Column) -> Column:
    return F.add_months(c, 12)


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5
