from datetime import date

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from gateflow.config import BIN_LABELS, HOURS, Thresholds
from gateflow.operators import joins, ordered, reshape
from gateflow.plans import marts, metrics, reports
from gateflow.sinks.tables import scratch_path, write_table

DAILY = "base_date date, stn_name string, line_num int, on_cnt bigint, off_cnt bigint, day_label string"
KPI = "base_date date, stn_name string, line_num int, hour int, on_cnt bigint, off_cnt bigint"


def test_unpivot_and_pivot_give_the_input_back(spark):
    slots = {f"h{h:02d}": h for h in HOURS}
    data = [(f"s{i}", *[i * 100 + h for h in HOURS]) for i in range(5)]
    wide = spark.createDataFrame(data, "s string, " + ", ".join(f"{c} bigint" for c in slots))
    long = reshape.unpivot_slots(wide, ["s"], slots)
    assert "Exchange" not in plan_of(long)
    back = long.groupBy("s").pivot("hour", list(HOURS)).agg(F.sum("value"))
    assert rows(back) == rows(wide)


def test_joined_directions_equal_a_join(spark):
    on = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), (None, 1, 7)], "k string, hour int, on_cnt bigint")
    off = spark.createDataFrame([("a", 1, 2), ("c", 1, 3), (None, 1, 4)], "k string, hour int, off_cnt bigint")
    assert rows(reshape.join_directions(on, off, ["k", "hour"])) == rows(on.join(off, ["k", "hour"]))


def test_two_hour_bins(spark):
    full = [("full", h, h) for h in HOURS]
    df = spark.createDataFrame(full + [("part", h, h) for h in HOURS[:-1]], "s string, hour int, value bigint")
    got = {(r.s, r.bin): r.value for r in reshape.two_hour_bins(df, ["s"]).collect()}
    assert [got["full", b] for b in range(11)] == [5, 13, 17, 21, 25, 29, 33, 37, 41, 45, 24]
    assert [got["part", b] for b in range(11)] == [0] * 11
    assert len(BIN_LABELS) == 11


def test_match_keeps_rows_and_ignores_case_and_accents(spark):
    fact = spark.createDataFrame([("Café역(x)", 1), (" CAFE ", 2), ("none", 3)], "station string, v int")
    dim = spark.createDataFrame([("cafe", "2"), ("CAFÉ ", "1")], "station_clean string, station_no string")
    got = joins.match_station(fact, joins.name_map(fact, dim))
    assert sorted((r.v, r.station_id) for r in got.collect()) == [(1, "1"), (2, "1"), (3, None)]


def test_stored_name_map_is_broadcast_by_its_size(spark):
    fact = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 7).alias("station"), "id")
    dim = spark.createDataFrame([("S1", "1"), ("s2", "2")], "station_clean string, station_no string")
    mapping = write_table(joins.name_map(fact, dim), scratch_path(spark, "map"))
    plan = plan_of(joins.match_station(fact, mapping))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_building_a_plan_runs_no_job(spark):
    fact = spark.range(10).select(F.concat(F.lit("s"), "id").alias("station"))
    dim = spark.createDataFrame([("s1", "1")], "station_clean string, station_no string")
    spark.sparkContext.setJobGroup("plans", "none may run")
    joins.match_station(fact, joins.name_map(fact, dim))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_growth_is_null_over_a_gap(spark):
    data = [(date(2018, m, 1), "x", 1, 10, 0, "평일") for m in (1, 3)]
    data += [(date(2019, m, 5), "x", 1, 15, 0, "평일") for m in (1, 2, 3)]
    daily = spark.createDataFrame(data, DAILY)
    for form in ("window", "join"):
        got = {r.base_ym: r.recovery_rate for r in marts.growth_trend(daily, form=form).collect()}
        assert got[date(2019, 1, 1)] == 150.0 and got[date(2019, 2, 1)] is None


def test_profile_windows_and_thresholds(spark):
    d = date(2019, 1, 1)
    data = [(d, "tie", 1, 8, 0, 13), (d, "tie", 1, 20, 0, 10),
            (d, "office", 1, 8, 0, 14), (d, "office", 1, 20, 0, 10),
            (d, "late", 1, 22, 0, 14), (d, "zero", 1, 8, 0, 0)]
    kpi = reshape.peak_flags(spark.createDataFrame(data, KPI))
    got = {r.stn_name: r for r in marts.station_profile(kpi).collect()}
    assert set(got) == {"tie", "office", "late"}
    assert got["tie"].area_type == "혼합형" and got["office"].area_type == "오피스형"
    assert got["late"].area_type == "상업/유흥형" and got["late"].evening_ratio == 0.0


def _report(spark, daily, profile, scores, **kw):
    p = spark.createDataFrame(profile, "stn_name string, area_type string")
    s = spark.createDataFrame(
        scores,
        "base_ym date, stn_name string, total_traffic_score double, office_score double,"
        " night_life_score double, recommended_biz string",
    )
    return reports.station_report(spark.createDataFrame(daily, DAILY), p, s, **kw)


def _days(year, n, name="x역", line=2):
    return (date(year, 3, 4), name, line, n, 0, "평일")


def test_report_without_profile_or_year_before(spark):
    r = _report(spark, [_days(2021, 100), _days(2018, 7)], [], []).first()
    assert (r.commercial_type, r.recommendations[0].category) == ("복합 상권", "데이터 없음")
    assert (r.market_maturity, r.diff_amount, r.growth_rate) == ("정체/쇠퇴기", 0, 0.0)
    assert (r.v2018, r.v2021, r.recovery_rate, r.location_grade) == (3, 100, 0.0, "B")
    assert r.growth_mark == "▼" and r.strategy == "기존 고객 유지 및 효율화 전략"


def test_report_uses_the_first_month_of_the_year(spark):
    scores = [(date(2021, 2, 1), "x역", 1.0, 50.0, 30.0, "B"), (date(2021, 1, 1), "x역", 0.5, 20.0, 37.0, "A"),
              (date(2020, 1, 1), "x역", 9.0, 90.0, 90.0, "C")]
    daily = [_days(2021, 2105), _days(2020, 2000), _days(2019, 8000)]
    r = _report(spark, daily, [("x역", "오피스형")], scores, stations=["x"], line=2).first()
    assert (r.recommendations[0].category, r.recommendations[0].desc) == ("A", "저녁/주말 상권 특화 전략 추천")
    assert (r.location_grade, r.analysis_score) == ("S", 84.3)
    assert (r.market_maturity, r.growth_rate, r.diff_amount) == ("성장기", 5.25, 105)
    assert r.insight_text == "x역은 2021년 기준 전년 대비 유동인구가 약 105명 증가하였습니다."
    assert r.recovery_rate == 0.25 and r.recovery_percent == 25.0 and not r.recovery_good


@pytest.mark.parametrize("now, want", [(105, "성숙기"), (106, "성장기"), (95, "성숙기"), (94, "정체/쇠퇴기")])
def test_maturity_borders(spark, now, want):
    daily = spark.createDataFrame([_days(2021, now), _days(2020, 100)], DAILY)
    assert metrics.station_metrics(daily).first().market_maturity == want


def test_unknown_station_gives_no_row_and_compare_takes_two_or_more(spark):
    assert _report(spark, [_days(2021, 1)], [], [], stations=["y"]).count() == 0
    daily = spark.createDataFrame([_days(2021, 1)], DAILY)
    with pytest.raises(ValueError):
        reports.compare(daily, daily, daily, [("x", 2)])


def test_pattern_sums_a_day_before_it_averages(spark):
    d1, d2 = date(2021, 5, 1), date(2021, 5, 2)
    data = [(d1, "x", 2, 8, 10, 0), (d1, "x", 2, 8, 0, 4), (d2, "x", 2, 8, 5, 0), (date(2021, 6, 1), "x", 2, 8, 99, 9)]
    got = reports.hourly_pattern(spark.createDataFrame(data, KPI), "2021-05", "x", 2)
    assert rows(got) == [("x", 2, 8, 8, 2)]


def test_heatmap(spark):
    daily = spark.createDataFrame(
        [(date(2021, 5, 1), "x역", 1, 1, 0, "주말"), (date(2021, 5, 1), "x역", 2, 1, 0, "주말"),
         (date(2021, 5, 3), "x역", 1, 100, 0, "평일")], DAILY)
    got = reports.calendar_heatmap(daily, "2021-05", "x").collect()
    assert [(r["count"], r.intensity, r.first_offset) for r in got] == [(2, 0.1, 5), (100, 1.0, 5)]
    none = daily.withColumns({"on_cnt": F.lit(0), "off_cnt": F.lit(0)})
    assert {r.intensity for r in reports.calendar_heatmap(none, "2021-05").collect()} == {0.1}


def test_station_list_does_not_multiply(spark):
    spatial = spark.createDataFrame([("가역", 1), ("나역", 2)], "stn_name string, line_num int")
    dim = spark.createDataFrame([("가", 1.0, 2.0), ("가", 3.0, 1.0), ("나", 5.0, 5.0)],
                                "station_clean string, lat double, lng double")
    profile = spark.createDataFrame([("가역", "혼합형")], "stn_name string, area_type string")
    scores = spark.createDataFrame(
        [(date(2021, 1, 1), "가역", 1.0, 50.0, None), (date(2021, 2, 1), "가역", 1.0, 44.0, 10.0)],
        "base_ym date, stn_name string, total_traffic_score double, office_score double, night_life_score double")
    got = {r.display_name: r for r in reports.station_list(spatial, dim, profile, scores).collect()}
    assert (got["가역"].lat, got["가역"].lng, got["가역"].location_grade) == (3.0, 2.0, "A")
    assert got["가역"].avg_score == pytest.approx(53 / 3)
    assert (got["나역"].avg_score, got["나역"].area_type, got["나역"].location_grade) == (0.0, None, "B")


def test_lists_do_not_depend_on_the_number_of_stations(spark):
    for n in (1000, 1001):
        df = spark.range(n).select(F.lit(1).alias("line_num"), F.concat(F.lit("s"), "id").alias("display_name"))
        (whole,) = ordered.stations_by_line(df, 1).collect()
        names = [s.display_name for s in whole.stations]
        assert names == sorted(names) and len(names) == n
        parts = ordered.stations_by_line(df, 4).collect()
        assert sorted(r.bucket for r in parts) == [0, 1, 2, 3] and sum(len(r.stations) for r in parts) == n


def test_history_is_in_date_order_within_a_station(spark):
    rows = [(date(2021, 1, 1 + (7 * i) % 28), f"s{i % 3}", 1, i, i, "평일") for i in range(84)]
    df = spark.createDataFrame(rows, "base_date date, stn_name string, line_num int, on_cnt bigint, off_cnt bigint, day_label string")
    got = [(r.stn_name, r.base_date) for r in reports.station_history(df).collect()]
    for s in ("s0", "s1", "s2"):
        own = [d for n, d in got if n == s]
        assert own == sorted(own) and len(own) == len(set(own))
    assert [r.base_date for r in reports.station_history(df, "s1").collect()] == sorted({d for n, d in got if n == "s1"})


def test_top_rows_need_no_full_sort(spark):
    mart = spark.createDataFrame([("1", "a", "1", "05", i) for i in range(50)],
                                 "station_id string, station string, line string, hour string, net_flow bigint")
    top = ordered.top_net_flow(mart, 20)
    assert "TakeOrderedAndProject" in plan_of(top)
    assert [r.net_flow for r in top.collect()] == list(range(49, 29, -1))


def test_flow_type(spark):
    d = date(2021, 1, 1)
    data = [(d, "in", 1, 18, 50, 40), (d, "in", 1, 8, 10, 0), (d, "out", 1, 7, 9, 0), (d, "mixed", 1, 20, 0, 5)]
    got = {r.stn_name: r for r in metrics.flow_type(spark.createDataFrame(data, KPI)).collect()}
    assert got["in"].flow_type == "유입형 (상업/여가)" and got["in"].recommend == ["음식점", "카페", "주점"]
    assert got["out"].flow_type == "유출형 (주거 중심)" and got["mixed"].flow_type == "복합형"


def test_traffic_divisor_is_a_parameter():
    assert Thresholds().traffic_divisor == 1_000_000


def test_reports_are_in_order(spark):
    rows = [(date(2021, 1, 1 + (5 * i) % 28), "s", 1, (7 * i) % 20 + 5, i, 1, 0, 0, 0, 0, 0, 0) for i in range(60)]
    names = ["peak_morning_on", "peak_lunch_on", "peak_evening_on", "peak_morning_off", "peak_lunch_off", "peak_evening_off"]
    kpi = spark.createDataFrame(rows, "base_date date, stn_name string, line_num int, hour int, on_cnt bigint, off_cnt bigint, " + ", ".join(f"{n} bigint" for n in names))
    hours = [r.hour for r in reports.hourly_pattern(kpi, "2021-01").collect()]
    assert hours == sorted(set(hours)) and len(hours) > 10
    growth = spark.createDataFrame([(date(2020 + i % 2, 1 + (5 * i) % 12, 1),) for i in range(24)], "base_ym date")
    months = [r.base_ym for r in marts.available_months(growth).collect()]
    assert months == sorted(set(months), reverse=True) and len(months) > 10
    daily = spark.createDataFrame([(r[0], "s역", 1, 1, 1, 2, "평일") for r in rows], "base_date date, stn_name string, line_num int, on_cnt bigint, off_cnt bigint, total_flow bigint, day_label string")
    days = [r.base_date for r in reports.calendar_heatmap(daily, "2021-01").collect()]
    assert days == sorted(days) and len(days) > 10
