import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gateflow.config import HOURS, SLOTS
from gateflow.functions import dates, headers, names, numbers


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in df.select("i", expr(F.col("s")).alias("v")).orderBy("i").collect()]


def test_station_names(spark):
    texts = [" 서울역(1호선) ", "역삼", "역삼역", "강남", "동역사", None]
    assert values(spark, texts, names.station_name) == [
        "서울역", "삼역", "삼역", "강남역", "동사역", None,
    ]
    assert values(spark, texts, lambda c: names.station_name(c, "suffix")) == [
        "서울역", "역삼역", "역삼역", "강남역", "동역사역", None,
    ]
    assert values(spark, ["강남", "강남역", "", None], names.with_suffix) == [
        "강남역", "강남역", "", None,
    ]
    assert [names.format_station(s) for s in ("강남", "강남역", "", None)] == [
        "강남역", "강남역", "", None,
    ]


def test_trim_covers_all_white_space(spark):
    texts = ["　a b ", "\t x\r\n", " y "]
    assert values(spark, texts, names.trim_space) == [t.strip() for t in texts]
    assert values(spark, texts, F.trim) == [t.strip(" ") for t in texts]


def test_dates(spark):
    texts = [
        "2017-02-01", "20170201", "01/02/2017", "12/25/2017", " 1/2/2017 ", "2017.2.1",
        "2017-02-03 10:00", "31/02/2017", "junk", "", None, "2017-13-01",
    ]
    d = date(2017, 2, 1)
    assert values(spark, texts, dates.parse_date) == [
        d, d, d, date(2017, 12, 25), d, d, date(2017, 2, 3), None, None, None, None, date(2017, 1, 13),
    ]
    assert values(spark, ["20170102", "2017-01-02", " 1/2/17", "x"], dates.iso_text) == [
        "2017-01-02", "2017-01-02", "1/2/17", "x",
    ]


def test_month_arithmetic_clamps(spark):
    df = spark.createDataFrame([(date(2020, 2, 29),)], "d date")
    got = df.select(dates.year_later(F.col("d")), dates.month_start(F.col("d"))).first()
    assert tuple(got) == (date(2021, 2, 28), date(2020, 2, 1))


def test_clean_count(spark):
    texts = ['"1,234"', " 5 ", "12.7", "-", "", None, "9007199254740993", "-3"]
    assert values(spark, texts, numbers.clean_count) == [1234, 5, 12, 0, 0, 0, 9007199254740993, -3]
    kept = values(spark, texts, lambda c: numbers.clean_count(c, keep_null=True))
    assert kept[3:6] == [None, None, None]


def test_digits_int(spark):
    texts = ["2호선", "05", "호선", "9호선(2단계)", "-7", "5.0", None]
    assert values(spark, texts, numbers.digits_int) == [2, 5, 0, 92, 7, 50, 0]


def test_round_ratio_is_exact(spark):
    cases = [(1, 8, 2, 0.13), (-1, 8, 2, -0.13), (401, 40000, 3, 0.01), (1005, 1000, 2, 1.01),
             (5, 2, 0, 3.0), (-5, 2, 0, -3.0), (1, 0, 2, None), (0, 7, 2, 0.0), (None, 3, 1, None)]
    for n, d, digits, want in cases:
        df = spark.createDataFrame([(n, d)], "n bigint, d bigint")
        assert df.select(numbers.round_ratio(F.col("n"), F.col("d"), digits)).first()[0] == want


def test_round_ratio_binary_equals_python(spark):
    random.seed(7)
    pairs = [(n, d) for d in (8, 16, 40, 200, 1000) for n in range(1, 2 * d)]
    pairs += [(random.randint(0, 10**7), random.randint(1, 10**6)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = df.select("n", "d", numbers.round_ratio_binary(F.col("n"), F.col("d")).alias("v")).collect()
    assert [(r.n, r.d, r.v) for r in got if r.v != round(r.n / r.d, 2)] == []


def test_exceeds_keeps_the_fraction(spark):
    df = spark.createDataFrame([(2299, 2420), (2300, 2420), (105, 100)], "a bigint, b bigint")
    a, b = (F.col(c).cast("decimal(38,0)") for c in "ab")
    at_least = [r[0] for r in df.select(numbers.exceeds(a, b, Decimal("0.95"), True)).collect()]
    above = [r[0] for r in df.select(numbers.exceeds(a, b, Decimal("1.05"))).collect()]
    assert at_least == [True, True, True]
    assert above == [False, False, False]
    close = spark.createDataFrame([(23, 25)], "a bigint, b bigint")
    a, b = (F.col(c).cast("decimal(38,0)") for c in "ab")
    assert not close.select(numbers.exceeds(a, b, Decimal("0.95"), True)).first()[0]


def test_slot_names():
    cols = ["연번", "날짜", "호선", "역번호", "역명", "구분", "05~06", "06:00-07:00", "2합계", "합계"]
    assert headers.slot_columns(cols, "colon") == ["06:00-07:00"]
    assert headers.slot_columns(cols, "digit") == ["05~06", "06:00-07:00"]
    assert headers.slot_columns(cols, "clock") == ["05~06", "06:00-07:00"]
    assert headers.key_columns([" 날짜1", "수송일자 날짜", "역명"])["base_date"] == " 날짜1"
    assert [headers.hour_code(s) for s in SLOTS] == list(HOURS)
    assert headers.slot_map(["x", "y"]) == {"x": 5, "y": 6}
    assert headers.distinct_names(["a", "", "a"]) == ["a", "Unnamed: 1", "a.1"]
    with pytest.raises(ValueError):
        headers.slot_columns(cols, "other")


def test_slot_hour_of_data(spark):
    assert values(spark, list(SLOTS), names.slot_hour) == list(HOURS)


def test_suffixed_numbers_are_no_counts(spark):
    texts = ["5d", "7f", "1D ", "0x1", "1,234", " 12 ", "-3", "4.0", "1e3", "", None, "NaN", "Infinity", "."]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    got = [r[0] for r in df.select(numbers.clean_count(F.col("c"))).collect()]
    assert got == [0, 0, 0, 0, 1234, 12, -3, 4, 1000, 0, 0, 0, 0, 0]


def test_counts_with_commas_and_other_signs(spark):
    texts = ["6,850", "0,05", "-1,000", ",", "40d", "1,2.5", "5,", "+3"]
    assert values(spark, texts, numbers.clean_count) == [6850, 5, -1000, 0, 0, 12, 5, 3]
    assert values(spark, texts, lambda c: numbers.clean_count(c, strip=" ")) == [0, 0, 0, 0, 0, 0, 0, 3]


def test_counts_of_an_array_are_cleaned_as_each_is(spark):
    odd = ["5", "4,932", "1,2,3", "", None, " 8 ", "007", "+7", "-5", "-5,000", "5d", "7f", "1e3", "2.7", ".5", "abc", ",", "9" * 30, '"1"', "1\x012", "\x01"]
    pick = random.Random(6)
    rows = [[x] for x in odd] + [[], ["1", "2"], ["1", None], ["1,000", None, ""], ["1,000", "7"], ["1\x01", "2"], ["\x01", "1"], ["3,0", "1\x012"]]
    rows += [[pick.choice(odd) for _ in range(pick.randint(2, 5))] for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "cells array<string>")
    for strip in (",", numbers.STRIP, r"[;,]"):
        for keep in (True, False):
            got, want = df.select(
                numbers.clean_counts(F.col("cells"), strip, keep).alias("got"),
                F.transform("cells", lambda c: numbers.clean_count(c, strip, keep)).alias("want"),
            ).toPandas().T.values.tolist()
            assert [list(x) for x in got] == [list(x) for x in want]
