"""Registered queries do the whole of their rows, and inputs are made without waste."""

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - registers the queries

from conftest import plan_of, rows
from gateflow.functions.dates import parse_date
from gateflow.functions.numbers import clean_count
from gateflow.operators.filters import valid_dates
from gateflow.sinks.tables import write_spread
from gateflow.sources import csv
from workload import fixtures
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_station_list_has_every_line(spark):
    lines = {r.line_num for r in QUERIES["c3_station_list"](spark, SF).select("line_num").distinct().collect()}
    assert lines == {r.line_num for r in QUERIES["a13_station_lines"](spark, SF).select("line_num").distinct().collect()}


def test_hourly_pattern_has_every_station_and_line(spark):
    assert rows(QUERIES["c5_hourly_pattern"](spark, SF)) == rows(QUERIES["a7_hourly_pattern"](spark, SF))


def test_deliveries_are_made_when_asked_for_and_without_moving_lines(spark, tmp_path):
    made = fixtures._Deliveries(spark, SF)
    assert made["c"].endswith("/c") and list(made) == ["c"]
    plan = plan_of(fixtures._wide(spark, SF, fixtures._counts(spark, SF)))
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "place" in x]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
    aggregates = [i for i, x in enumerate(plan.splitlines()) if "HashAggregate" in x]
    assert max(aggregates) < plan.splitlines().index(dealt[0])  # counts are dealt, not forty sums


def test_every_file_of_a_delivery_begins_with_its_header(spark):
    path = fixtures.deliveries(spark, SF)["a"]
    lines = spark.read.text(path).select("value", "_metadata.file_path")
    files = {f.split("/")[-1] for f in spark.read.text(path).inputFiles()}
    headers = lines.where(lines.value == ",".join(fixtures.LAYOUTS["a"]))
    assert {r.file_path.split("/")[-1] for r in headers.collect()} == files


def test_cells_are_parsed_once_whatever_asks_for_them(spark):
    df = csv.read_wide_csv(spark, fixtures.deliveries(spark, SF)["a"])
    dated = valid_dates(df.select(parse_date(F.col("날짜")).alias("base_date")))
    assert plan_of(dated).count("from_csv(") <= 1


def test_plain_counts_and_dates_need_no_pattern_but_mean_the_same(spark):
    texts = ["0", "-5", "12", "1,234", "5d", "7f", " 8", "+9", "007", "1e3", "2.9", "\x015", "", None, "9" * 25]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(clean_count(F.col("x"), keep_null=True)).collect()
    assert [r[0] for r in got] == [0, -5, 12, 1234, None, None, 8, 9, 7, 1000, 2, None, None, None, None]
    days = ["2021-02-03", "20210203", "03/02/2021", "03-02-2021", "2021-2-3", "2021-13-02", "01/13/2021", "03/02-2021", "2021", "미상"]
    got = spark.createDataFrame([(x,) for x in days], "x string").select(parse_date(F.col("x")).cast("string")).collect()
    feb = "2021-02-03"
    assert [r[0] for r in got] == [feb, feb, feb, feb, feb, "2021-02-13", "2021-01-13", None, None, None]


def test_few_partition_values_are_written_without_a_shuffle_or_a_sort(spark, tmp_path):
    df = spark.range(0, 4000, 1, 4).selectExpr("id", "id % 3 as kind")
    stored = write_spread(df, f"{tmp_path}/spread", ["kind"], 4)
    assert len(stored.inputFiles()) == 4 * 3 and rows(stored) == rows(df)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_ingest_reads_each_delivery_once(spark):
    assert plan_of(QUERIES["e4_ingest_wide"](spark, SF)).count("FileScan") == 3  # not once per direction


def test_deliveries_sort_by_their_names(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "_write_delivery", lambda *a: None)
    for _ in range(4):
        paths = fixtures._Deliveries(spark, "unused")
        assert sorted("dbca", key=lambda k: paths[k]) == list("abcd")
