"""Tables written along the raw layer, in its order and without a shuffle of their own."""

import random
import re
from datetime import date, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from gateflow.config import SLOTS
from gateflow.functions.names import station_name
from gateflow.operators.reshape import to_raw_long
from gateflow.plans import marts, refresh
from gateflow.plans.layers import raw_from_files
from gateflow.sinks import tables as t
from workload import fixtures as fx
from workload.registry import QUERIES

PERIOD = ("2019-01-01", "2020-12-31")
RAW = "base_date date, hour string, station string, line string, boarding bigint, alighting bigint"
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture(scope="module")
def raw(spark):
    pick = random.Random(5)
    names = [" 강남역(2)", "강남", "서울역", "x", "강남구청"]
    data = [
        (date(2019, 4, 1) + timedelta(days=pick.randrange(200)), f"{pick.randint(5, 24):02d}", pick.choice(names), "2호선", pick.randrange(90), 3)
        for _ in range(3000)
    ]
    return spark.createDataFrame([*data, (None, "05", "x", "1호선", 1, 2)], RAW).repartition(4)


@pytest.fixture(scope="module")
def dims(spark):
    stations = spark.createDataFrame([("강남", "1"), ("서울", "2")], "station_clean string, station_no string")
    return stations, spark.createDataFrame([(date(2019, 5, 1), "노동절")], "base_date date, day_label string")


def in_order(spark, folder: str, *keys: str) -> int:
    """Files whose rows are sorted by the keys; all of them are, or this fails."""
    files = spark.read.parquet(folder).inputFiles()
    for f in files:
        rows = [tuple(r) for r in spark.read.parquet(f).select(*keys).collect()]
        assert rows == sorted(rows, key=lambda r: tuple((v is not None, v) for v in r)), f
    return len(files)


def test_hourly_rows_are_written_along_raw(spark, raw, dims):
    path = t.scratch_path(spark, "along")
    marts.build_marts(raw, *dims, path, PERIOD, PERIOD, (2019, 2020), 10)
    assert "part_month" in spark.read.parquet(f"{path}/raw").columns
    assert in_order(spark, f"{path}/hourly_kpi", "stn_name", "base_date") >= 8
    for name in ("hourly_kpi", "int_flow"):
        got = spark.read.parquet(f"{path}/{name}")
        assert got.count() == 3001
        assert got.where(~F.col("part_month").eqNullSafe(F.trunc("base_date", "MM"))).count() == 0


def test_files_by_month_are_the_same_rows(spark, tmp_path):
    head = ",".join(["날짜", "호선", "역번호", "역명", "구분", *SLOTS])
    lines = [
        f"2019-{m:02d}-{d:02d},2호선,1,{name},{way},{','.join(str(d * m + i) for i in range(20))}"
        for m in (3, 1, 2) for d in (9, 2) for name in ("서울역", "강남(2)") for way in ("승차", "하차")
    ]
    (tmp_path / "a.csv").write_text("\n".join([head, *lines]))
    columns = {str(tmp_path): "구분"}
    plain = raw_from_files(spark, [str(tmp_path)], columns)
    laid = raw_from_files(spark, [str(tmp_path)], columns, by_month=True)
    assert sorted(map(repr, laid.collect())) == sorted(map(repr, plain.collect())) and plain.count() == 480
    path = t.scratch_path(spark, "by-month")
    t.write_spread(laid.withColumn("part_month", F.trunc("base_date", "MM")), path, ["part_month"], 32, grows=20)
    assert in_order(spark, path, "station", "base_date") == 3
    assert "REBALANCE" in plan_of(laid) and "REBALANCE" not in plan_of(plain)


def test_spread_settings_are_the_sessions_again(spark):
    before = spark.conf.get(ADVISED)
    df = spark.range(6).selectExpr("id", "id % 2 as p")
    path = t.scratch_path(spark, "spread")
    t.write_spread(df, path, ["p"], 4, grows=20)
    got = t.write_spread(df.where("p = 1").selectExpr("id + 10 as id", "p"), path, ["p"], 4, replace=True)
    assert sorted(r.id for r in got.collect()) == [0, 2, 4, 11, 13, 15]
    assert spark.conf.get(ADVISED) == before and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert [t._bytes(s) for s in ("64MB", "7", "2k", "1g")] == [64 << 20, 7, 2048, 1 << 30]


def test_long_rows_take_their_names_from_the_wide_row(spark):
    """Names and hours are texts of the wide row, not made again for each of twenty rows."""
    wide = spark.createDataFrame([(" 서울역 ", "2호선", date(2019, 1, 1), "7", None)], "station string, line string, base_date date, h05 string, h24 string")
    long = to_raw_long(wide, wide, {"h05": 5, "h24": 24})
    above = plan_of(long).split("Expand")[0]
    assert "trim" not in above and "lpad" not in above and "replace" not in above
    got = sorted(tuple(r)[1:] for r in long.select("base_date", "station", "line", "hour", "boarding", "alighting").collect())
    assert got == [("서울역", "2", "05", 0, 7), ("서울역", "2", "05", 7, 0), ("서울역", "2", "24", 0, 0), ("서울역", "2", "24", 0, 0)]


SF = "/root/testdata/sf0.001"


@pytest.fixture
def few_rows_per_task(monkeypatch):
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 100)


@pytest.mark.parametrize("name", ["c6_daily_flow", "c6_station_history"])
def test_days_are_grouped_by_as_many_tasks_as_the_rows_need(spark, few_rows_per_task, name):
    """One shuffle of the rows, by a number of tasks that follows theirs, and none for groups."""
    n = fx.tasks(spark, SF)
    assert n == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fx.tasks(spark, "/root/testdata/sf0.01") == 10 * n
    plan = plan_of(QUERIES[name](spark, SF))
    dealt = re.findall(r"hashpartitioning\((.*), (\d+)\), (\w+)", plan)
    of_rows = [(re.sub(r"#\d+L?", "", by), int(k)) for by, k, _ in dealt if "stn_name" in by]
    history = [("stn_name", n)] if name == "c6_station_history" else []
    assert of_rows == [*history, ("part_month, stn_name", n)]


def test_metrics_are_grouped_by_as_many_tasks_as_the_rows_need(spark, few_rows_per_task):
    """Sums are dealt before their wide groups are made, so that no scan task has all of them."""
    plan = plan_of(QUERIES["m6_from_monthly_sums"](spark, SF))
    assert re.findall(r"hashpartitioning\((.*?)#\d+, (.*?)#\d+, (\d+)\), (\w+)", plan) == [
        ("stn_name", "line_num", str(fx.tasks(spark, SF)), "REPARTITION_BY_NUM")
    ]


def test_a_sort_key_is_made_once_per_row(spark, raw):
    """An expression in the sort itself would be evaluated for every comparison."""
    laid = t.sorted_within(raw, ["hour", F.upper("station"), "base_date"])
    sort = re.search(r"Sort \[(.*?)\]", plan_of(laid)).group(1)
    assert "upper" not in sort and laid.columns == raw.columns and laid.count() == 3001


def test_refreshed_hourly_rows_are_written_along_raw(spark, raw, dims):
    """A build and a refresh leave hourly rows in order, and a second scan of what is
    delivered is not made."""
    path = t.scratch_path(spark, "kept")
    kept = refresh.Marts(spark, path, PERIOD, PERIOD, (2019, 2020), divisor=10)
    kept.build(raw, *dims)
    kept.refresh(raw.where("base_date >= '2019-06-01' and base_date < '2019-08-01'"), dims[0])
    assert kept.table("raw").count() == kept.table("hourly_kpi").count() == kept.table("int_flow").count() == 3001
    assert in_order(spark, f"{path}/hourly_kpi", "stn_name", "base_date") >= 8
    names = [station_name(F.col("station")).alias("stn_name"), "base_date"]
    for f in kept.table("raw").inputFiles():
        rows = [tuple(r) for r in spark.read.parquet(f).select(*names).collect()]
        assert rows == sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_raw_of_the_marts_is_sorted_in_tasks_smaller_than_advised(spark, raw, tmp_path, monkeypatch):
    """Sorted rows take many times their shuffled size, so advised tasks fill memory."""
    before, advised, write = spark.conf.get(ADVISED), {}, DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        advised[path.rsplit("/", 1)[-1]] = t._bytes(spark.conf.get(ADVISED))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    dims = fx.station_dim(spark, "/root/testdata/sf0.001"), fx.days(spark, "/root/testdata/sf0.001")
    built = marts.build_marts(raw, *dims, str(tmp_path / "marts"), PERIOD, PERIOD, (2019, 2020), 10)
    assert advised["raw"] < t._bytes(before) == advised["daily_trend"]
    assert spark.conf.get(ADVISED) == before
    assert built["hourly_kpi"].count() == raw.count()
