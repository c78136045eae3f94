"""Column expressions for counts, ratios and rounding.

Ratios of counts are rounded in whole numbers, so a result does not depend on
the order in which partitions were summed and ties go up as in exact decimals.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateflow.config import LINE_SUFFIX

_WIDE = "decimal(38,0)"


#: What clean_count strips, unless told otherwise.
STRIP = r'[",\s]'
#: Parts cells that are looked at together.
_SEP = "\x01"


def clean_count(c: Column, strip: str = STRIP, keep_null: bool = False) -> Column:
    """Count given as text; quotes, commas and blanks are ignored.

    Anything that is not a number becomes 0, or stays null with keep_null.
    """
    # a cast that fails costs an exception, so commas go first
    bare = F.replace(c, F.lit(","), F.lit("")) if re.fullmatch(strip, ",") else c
    plain = bare.try_cast("bigint")
    text = F.regexp_replace(c, strip, "")
    # a cast alone would take 5d and 7f for numbers
    text = F.when(text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), text)
    value = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    # most cells are a number as it is written, which needs no pattern
    value = F.when(plain.cast("string") == bare, plain).otherwise(value)
    return value if keep_null else F.coalesce(value, F.lit(0).cast("bigint"))


def clean_counts(cells: Column, strip: str = STRIP, keep_null: bool = False) -> Column:
    """clean_count of each text of an array.

    A rule per cell is a function that Spark does not compile. So cells that are all numbers as
    they are written, or are but for commas, are read as one array; only rows with another cell
    go cell by cell. Empty cells count as numbers here, as they are null either way.
    """
    plain = cells.try_cast("array<bigint>")
    bare = F.replace(F.array_join(cells, _SEP, ""), F.lit(","), F.lit(""))
    parted = F.split(bare, _SEP).try_cast("array<bigint>")
    value = F.when(plain.cast("array<string>") == cells, plain)
    if strip in (",", STRIP):
        same = (F.array_join(parted.cast("array<string>"), _SEP, "") == bare) & (F.size(parted) == F.size(cells))
        value = value.when(same, parted)
    value = value.otherwise(F.transform(cells, lambda c: clean_count(c, strip, keep_null=True)))
    return value if keep_null else F.transform(value, lambda c: F.coalesce(c, F.lit(0).cast("bigint")))


def digits_int(c: Column) -> Column:
    """Digits of a text as an integer; 0 when there are none.

    A text that is a number once the line suffix is gone needs no pattern search.
    """
    plain = F.replace(c, F.lit(LINE_SUFFIX), F.lit("")).try_cast("int")
    searched = F.regexp_replace(c, "[^0-9]", "").try_cast("int")
    return F.coalesce(F.when(plain >= 0, plain), searched, F.lit(0))


def in_window(hour: Column, window: tuple[int, int]) -> Column:
    return hour.between(*window)


def sum_when(condition: Column, value: Column) -> Column:
    """Sum of value over the rows that satisfy condition, 0 when none does."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("bigint")


def row_total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def exceeds(a: Column, b: Column, factor: Decimal, or_equal: bool = False) -> Column:
    """a > b * factor for counts, compared in whole numbers so no digit is lost."""
    places = max(0, -factor.as_tuple().exponent)
    left = a.cast(_WIDE) * F.lit(10**places).cast(_WIDE)
    right = b.cast(_WIDE) * F.lit(int(factor.scaleb(places))).cast(_WIDE)
    return left >= right if or_equal else left > right


def round_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """num / den rounded half away from zero; null when den is null or 0."""
    n = num.cast(_WIDE)
    d = F.nullif(den.cast(_WIDE), F.lit(0).cast(_WIDE))
    doubled = F.abs(n) * F.lit(2 * 10**digits).cast(_WIDE) + F.abs(d)
    whole = F.call_function("div", doubled, F.abs(d) * F.lit(2))
    signed = F.when((n < 0) != (d < 0), -whole).otherwise(whole)
    return signed.cast("double") / F.lit(float(10**digits))


def round_ratio_binary(num: Column, den: Column) -> Column:
    """num / den to two digits, as rounding the binary double does it.

    Away from ties this is the usual rounding. At an exact tie the double may
    lie a little above or below the tie, which decides; only a tie that the
    double holds exactly goes to the even neighbour. The error of the double is
    found exactly by multiplying its upper and lower half separately.
    For counts: num >= 0 and den > 0.
    """
    n, d = num.cast("bigint"), den.cast("bigint")
    halves = F.call_function("div", n * 200, d)
    tie = ((n * 200) % d == 0) & (halves % 2 == 1)
    x = n.cast("double") / d.cast("double")
    split = x * F.lit(134217729.0)  # 2**27 + 1
    upper = split - (split - x)
    error = (upper * 200 - halves) + (x - upper) * 200
    low = F.call_function("div", halves - 1, F.lit(2))
    step = F.when(error > 0, 1).when(error < 0, 0).otherwise(low % 2)
    return F.when(tie, (low + step).cast("double") / F.lit(100.0)).otherwise(
        round_ratio(n, d, 2)
    )


def grouped_digits(c: Column) -> Column:
    """Whole number with thousands commas."""
    return F.format_number(c, 0)
