import random
from datetime import date, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from gateflow.plans import marts, metrics, refresh
from gateflow.sinks.tables import scratch_path

PERIOD = ("2019-01-01", "2020-12-31")
RAW = "base_date date, hour string, station string, line string, boarding bigint, alighting bigint"


@pytest.fixture(scope="module")
def delivered(spark):
    pick = random.Random(3)
    data = []
    for _ in range(3000):
        d = date(2019, 4, 1) + timedelta(days=pick.randrange(500))
        on = pick.choice([0, 0, 3, 17, 250])
        data.append((d, f"{pick.randint(5, 24):02d}", pick.choice([" 강남역(2)", "서울역", "Café", "x"]), f"{pick.randint(1, 3)}호선", on, 0 if on else pick.randint(0, 90)))
    return spark.createDataFrame(data, RAW).repartition(4)


@pytest.fixture(scope="module")
def dims(spark):
    stations = spark.createDataFrame([("강남", "1"), ("서울", "2"), ("CAFE", "3")], "station_clean string, station_no string")
    days = spark.createDataFrame([(date(2019, 5, 1), "노동절")], "base_date date, day_label string")
    return stations, days


def built(spark, raw, dims):
    kept = refresh.Marts(spark, scratch_path(spark, "marts"), PERIOD, PERIOD, (2019, 2020), divisor=10)
    return kept, kept.build(raw, *dims)


@pytest.fixture(scope="module")
def full(spark, delivered, dims):
    return built(spark, delivered, dims)


def test_refreshed_months_equal_a_full_build(spark, delivered, dims, full):
    late = F.trunc("base_date", "MM").isin(date(2019, 5, 1), date(2020, 3, 1))
    _, whole = full
    kept, _ = built(spark, delivered.where(~late | (F.col("boarding") == 3)), dims)
    untouched = lambda name: {f for f in kept.table(name).inputFiles() if "=2019-04-01" in f or "=2020-06-01" in f}
    before = {name: untouched(name) for name in ("raw", "hourly_kpi", "daily_trend", "int_flow", "growth_trend", *refresh.MONTHLY)}
    got = kept.refresh(delivered.where(late), dims[0])
    assert all(before.values()) and before == {name: untouched(name) for name in before}
    for name, df in whole.items():
        cols = sorted(df.columns)
        assert sorted(map(repr, got[name].select(cols).collect())) == sorted(map(repr, df.select(cols).collect())), name
    # twice is once
    again = kept.refresh(delivered.where(late), dims[0])
    assert sorted(map(repr, again["shock"].collect())) == sorted(map(repr, whole["shock"].collect()))


def test_marts_from_sums_equal_those_from_rows(spark, delivered, dims, full):
    kept, got = full
    plain = marts.build_marts(delivered, *dims, scratch_path(spark, "plain"), PERIOD, PERIOD, (2019, 2020), 10)
    for name, df in plain.items():
        cols = [c for c in sorted(df.columns) if c not in ("volatility", "shock_index", "v2019", "v2020")]
        assert sorted(map(repr, got[name].select(cols).collect())) == sorted(map(repr, df.select(cols).collect())), name
    near = {r.stn_name: r for r in plain["shock"].collect()}
    for r in got["shock"].collect():
        assert tuple(r)[1:] == pytest.approx(tuple(near[r.stn_name])[1:], rel=1e-12, nan_ok=True)
    daily = kept.table("daily_trend")
    want = {(r.stn_name, r.line_num): r for r in metrics.station_metrics(daily, 2020).collect()}
    told = refresh.station_metrics(kept.table("flow_sums"), 2020)
    assert {(r.stn_name, r.line_num): r for r in told.collect()} == want
    assert "daily_trend" not in plan_of(told)


def test_a_refresh_reads_the_touched_months_only(spark, full):
    kept, _ = full
    growth = refresh.growth_of(kept.table("flow_sums"), PERIOD, [date(2020, 5, 1)])
    plan = plan_of(growth)
    assert "part_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    months = [r[0] for r in growth.select("base_ym").distinct().collect()]
    assert months == [date(2020, 5, 1)]
    scanned = kept.table("raw").where(F.col("part_month").isin([date(2020, 5, 1)]))
    assert "part_month" in plan_of(scanned).split("PartitionFilters: [")[1].split("]")[0]


def test_spread_of_few_or_equal_days(spark):
    df = spark.createDataFrame([(1, 5, 25), (2, 10, 50), (2, 0, 0), (3, 6, 14)], "n int, s int, q int")
    got = [tuple(r) for r in df.select(*[refresh.spread(F.col("n"), F.col("s"), F.col("q"), k) for k in ("pop", "samp")]).collect()]
    assert got[0] == (0.0, None) and got[1] == (0.0, 0.0) and got[2] == (None, None)
    assert got[3] == pytest.approx(((2 / 3) ** 0.5 / 2, 0.5))
