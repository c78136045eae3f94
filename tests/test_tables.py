import uuid
from datetime import date

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateflow.operators import filters, quality
from gateflow.sinks import tables as t
from gateflow.sources import jdbc
from gateflow.sources.dimensions import calendar, load_station_dim, read_station_dim
from gateflow.sources.named import query_named


@pytest.fixture
def path(spark):
    return t.scratch_path(spark, f"test-{uuid.uuid4().hex[:6]}")


def frame(spark, data):
    return spark.createDataFrame(data, "d date, k string, v int, w int")


D1, D2 = date(2019, 1, 1), date(2019, 2, 1)


def test_scratch_is_the_shared_folder(spark):
    assert t.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_upsert_twice_equals_once(spark):
    old = frame(spark, [(D1, "a", 1, 1), (D1, "b", 2, 2)])
    new = frame(spark, [(D1, "b", 9, 9), (D2, "c", 3, 3)])
    once = t.upsert(old, new, ["d", "k"])
    twice = t.upsert(once, new, ["d", "k"])
    assert rows(once) == rows(twice) == [(D1, "a", 1, 1), (D1, "b", 9, 9), (D2, "c", 3, 3)]


def test_upsert_takes_the_last_of_repeated_keys(spark):
    new = frame(spark, [(D1, "a", 1, 1), (D1, "a", 2, 5), (D1, "a", 3, 4)])
    assert rows(t.upsert(new.limit(0), new, ["d", "k"], order=["w"])) == [(D1, "a", 2, 5)]


def test_upsert_update_keeps_other_columns(spark):
    old = frame(spark, [(D1, "a", 1, 1), (D1, "b", 2, 2)])
    new = frame(spark, [(D1, "b", None, 9), (D2, "c", 3, 3)])
    assert t.upsert_update(old, new, ["d", "k"], ["v"]).orderBy("k").collect() == [
        (D1, "a", 1, 1), (D1, "b", None, 2), (D2, "c", 3, 3),
    ]


def test_upsert_table_touches_only_met_partitions(spark, path):
    t.append_by_date(frame(spark, [(D1, "a", 1, 1), (D2, "b", 2, 2)]), path, "d", first=True)

    def other_files():
        return {f for f in spark.read.parquet(path).inputFiles() if "d=2019-01-01" in f}

    before = other_files()
    new = frame(spark, [(D2, "b", 7, 7), (D2, "c", 8, 8)])
    got = t.upsert_table(spark, path, new, ["d", "k"], ["d"])
    assert rows(got.select("d", "k", "v")) == [(D1, "a", 1), (D2, "b", 7), (D2, "c", 8)]
    assert other_files() == before and before


def test_append_replaces_first(spark, path):
    t.append_by_date(frame(spark, [(D1, "x", 0, 0)]), path, "d", first=True)
    t.append_by_date(frame(spark, [(D1, "a", 1, 1)]), path, "d", first=True)
    got = t.append_by_date(frame(spark, [(D2, "b", 2, 2)]), path, "d")
    assert rows(got.select("d", "k")) == [(D1, "a"), (D2, "b")]


def test_conform(spark):
    schema = T.StructType([T.StructField("k", T.StringType(), True, {"comment": "key"}),
                           T.StructField("v", T.LongType())])
    got = t.conform(spark.createDataFrame([("1", "a")], "v string, k string"), schema)
    assert got.collect() == [("a", 1)]
    assert got.schema["k"].metadata == {"comment": "key"}
    with pytest.raises(ValueError, match="extra"):
        t.conform(spark.createDataFrame([("1", "a", 1)], "v string, k string, z int"), schema)


def test_month_range_reaches_the_scan(spark, path):
    df = frame(spark, [(D1, "a", 1, 1), (D2, "b", 2, 2)]).withColumn("m", F.trunc("d", "MM"))
    stored = t.write_table(df, path, partition_by=["m"], sort_by=["k"])
    plan = plan_of(filters.in_month(stored, "d", "2019-02", "m"))
    assert "GreaterThanOrEqual(d,2019-02-01)" in plan and "LessThan(d,2019-03-01)" in plan
    assert "PartitionFilters: [isnotnull(m" in plan
    assert filters.in_month(stored, "d", "2019-02", "m").count() == 1
    assert filters.in_month(stored, "d", "2019-12").count() == 0


def test_years_merge_to_ranges(spark):
    df = frame(spark, [(date(y, 6, 1), "a", y, 0) for y in range(2015, 2022)])
    got = filters.in_years(df, "d", [2019, 2016, 2018])
    assert sorted(r.v for r in got.collect()) == [2016, 2018, 2019]


def test_calendar_labels(spark):
    off = spark.createDataFrame([(date(2019, 1, 1), "신정"), (date(2019, 1, 5), "쉬는날"),
                                 (date(2019, 1, 5), "나중")], "base_date date, holiday_name string")
    got = [r.day_label for r in calendar(spark, "2019-01-01", "2019-01-07", off).orderBy("base_date").collect()]
    assert got == ["신정", "평일", "평일", "평일", "나중", "주말", "평일"]
    plain = calendar(spark, "2019-01-05", "2019-01-07").orderBy("base_date")
    assert [r.day_label for r in plain.collect()] == ["주말", "주말", "평일"]


def test_station_dimension_names(spark):
    df = spark.createDataFrame([("1", "x")], "` 고유역번호(외부역코드)` string, `station_clean ` string")
    assert load_station_dim(df).columns == ["역번호", "station_clean"]


def test_named_query_binds_values(spark):
    df = spark.createDataFrame([("a' or 1=1 --", 1), ("b", 2)], "k string, v int")
    got = query_named(spark, "select v from t_named where k = :k", {"t_named": df}, {"k": "a' or 1=1 --"})
    assert got.collect() == [(1,)]


def test_jdbc_options():
    part = jdbc.Partitioning("base_date", "2017-01-01", "2022-01-01", 60)
    got = jdbc.read_options({"url": "jdbc:x"}, "flows", part)
    assert got["numPartitions"] == "60" and got["partitionColumn"] == "base_date"
    assert "numPartitions" not in jdbc.read_options({"url": "jdbc:x"}, "flows")
    assert jdbc.write_options({"url": "jdbc:x"}, "marts", connections=8) == {
        "url": "jdbc:x", "dbtable": "marts", "batchsize": "10000", "truncate": "true", "numPartitions": "8",
    }


def test_checks(spark):
    df = frame(spark, [(D1, "a", 1, 1), (D1, "a", 2, 2), (date(2019, 4, 1), "b​", 3, 3)])
    assert rows(quality.duplicate_keys(df, ["d", "k"])) == [(D1, "a", 2)]
    assert rows(quality.coverage_gaps(df, "d")) == [(date(2019, 2, 1),), (date(2019, 3, 1),)]
    assert quality.coverage_gaps(df.limit(0), "d").count() == 0
    odd = quality.suspicious_names(df, "k").first()
    assert (odd.name, odd.bytes.hex, odd.bytes.n_bytes, odd.bytes.n_chars) == ("b​", "62E2808B", 4, 2)
    both = quality.reconcile({"a": df, "b": df.where("v < 3")}, ["v", "w"]).first()
    assert (both.n_diff, both.v_diff, both.w_diff) == (1, 3, 3)
    text = spark.createDataFrame([("2019-01-01", "1"), ("x", "-"), (None, "-4"), ("20190101", None)],
                                 "d string, n string")
    assert tuple(quality.reject_counts(text, "d", ["n"]).first()) == (4, 1, 1, 1, 1, 1)


def test_upsert_reads_only_the_partitions_it_meets(spark, monkeypatch):
    path = t.scratch_path(spark, "pruned")
    old = spark.createDataFrame([(d, k, 0) for d in range(5) for k in range(3)], "d int, k int, v int")
    t.write_table(old, path, partition_by=["d"])
    plans = []
    real = t.write_table
    monkeypatch.setattr(t, "write_table", lambda df, p, *a, **b: plans.append(plan_of(df)) or real(df, p, *a, **b))
    new = spark.createDataFrame([(3, 1, 7), (3, 9, 8), (9, 1, 9)], "d int, k int, v int")
    got = rows(t.upsert_table(spark, path, new, ["d", "k"], ["d"]).select("d", "k", "v"))
    want = [(d, k, 7 if (d, k) == (3, 1) else 0) for d in range(5) for k in range(3)] + [(3, 9, 8), (9, 1, 9)]
    assert got == sorted(want)
    assert any("PartitionFilters: [d#" in p and " IN (" in p for p in plans)


def test_column_upsert_keeps_old_rows(spark):
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 3), (None, 4, 4)], "k string, x int, y int")
    new = spark.createDataFrame([("b", 9, 9)], "k string, x int, y int")
    assert len(t.upsert_update(old, new, ["k"], ["x"]).collect()) == 5
    both = t.upsert_update(old, new.union(spark.createDataFrame([("a", 7, 7)], new.schema)), ["k"], ["x"])
    assert sorted((r.k or "", r.x, r.y) for r in both.collect()) == [("", 3, 3), ("", 4, 4), ("a", 7, 1), ("a", 7, 2), ("b", 9, 9)]


def test_counts_of_the_write_equal_those_of_a_pass(spark, path):
    data = [("2019-01-01", "승차", "1", "2"), ("bad", "승차", "5d", None), (" ", "하차", "-3", "x"), (None, "하차", "1", "1"), ("2019-01-02", "환승", "7f", "")]
    df = spark.createDataFrame(data, "d string, kind string, a string, b string")
    want = rows(quality.reject_counts(df, "d", ["a", "b"], ["kind"]))
    load = quality.ObservedLoad(df, "d", ["a", "b"], "kind", ["승차", "하차"])
    written = t.write_table(load.rows.where("a <> 'no'").select("a"), path)
    assert written.count() == 5
    got = {r["kind"]: tuple(r)[1:] for r in load.counts(spark).collect()}
    assert got == {(None if k == "환승" else k): tuple(v) for k, *v in want}
    # the counters sit in the plan of the write, whose scan is the only one
    scan = spark.read.parquet(path)
    observed = quality.ObservedLoad(scan.selectExpr("a as d", "a as kind", "a"), "d", ["a"], "kind", ["1"])
    assert plan_of(observed.rows).count("FileScan") == 1 and "CollectMetrics" in plan_of(observed.rows)


def test_odd_headers():
    assert quality.suspicious_headers(["날짜", "05:00~06:00", "호선​", "역명(부)", "a﻿", "a﻿"]) == [
        ("호선​", "호선​".encode().hex().upper()), ("a﻿", "61EFBBBF"),
    ]


def test_station_master_from_its_file(spark, tmp_path):
    file = tmp_path / "stations.csv"
    file.write_text(" 역명 ,고유역번호(외부역코드) ,lat, lng\n강남,222,37.5,127.0\n가,1,x,\n", encoding="utf-8")
    dim = read_station_dim(spark, str(file), {"lat": "double", "lng": "double"})
    assert dim.columns == ["역명", "역번호", "lat", "lng"]
    assert sorted(map(tuple, dim.collect())) == [("가", "1", None, None), ("강남", "222", 37.5, 127.0)]


def test_lookup_opens_one_bucket_and_equals_the_month_layout(spark, path):
    df = spark.range(6000).selectExpr("concat('s', id % 40) as k", "cast(id % 5 as int) as w", "id as v", "cast(id % 3 as int) as part")
    df = df.unionByName(spark.range(3000).selectExpr("'hot' as k", "cast(id % 5 as int) as w", "id as v", "cast(id % 3 as int) as part"))
    months = t.write_table(df, f"{path}/months", partition_by=["part"], sort_by=["k", "w"])
    found = t.write_lookup(df, f"{path}/by_key", "k", ["w", "v"], 8)
    again = t.lookup(spark.newSession(), f"{path}/by_key", found.schema, "k", ["w", "v"], 8)
    for table in (found, again):
        own = table.sparkSession
        own.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # the plan tells of buckets
        assert "SelectedBucketsCount: 1 out of 8" in plan_of(table.where("k = 's7' and w = 2"))
        own.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        for k in ("s7", "hot", "none"):
            ask = f"k = '{k}' and w = 2"
            assert rows(table.where(ask).select("k", "w", "v", "part")) == rows(months.where(ask).select("k", "w", "v", "part"))
    files = {f.rsplit("/", 1)[1] for f in found.inputFiles()}
    assert len(files) <= 8 + 8  # about a file per bucket, not one per task and bucket


def test_metrics_of_a_load_read_flags_not_cells(spark):
    df = spark.createDataFrame([("2019-01-01", "승차", "1,000"), ("bad", "하차", "5d")], "d string, kind string, a string")
    load = quality.ObservedLoad(df, "d", ["a"], "kind", ["승차", "하차"])
    node = next(x for x in plan_of(load.rows).split("\n") if "CollectMetrics" in x)
    assert "regexp_replace" not in node and "RLIKE" not in node
    load.rows.write.format("noop").mode("overwrite").save()
    assert sorted(tuple(r) for r in load.counts(spark).collect()) == [("승차", 1, 0, 0, 0, 0, 0), ("하차", 1, 0, 1, 1, 0, 0)]
