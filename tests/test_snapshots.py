from datetime import date

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from gateflow.plans.marts import SPATIAL_SCHEMA
from gateflow.sinks.snapshots import SnapshotTable, file_digests
from gateflow.sinks.tables import scratch_path
from gateflow.sources import csv

D1, D2, D3 = date(2019, 1, 1), date(2019, 2, 1), date(2019, 3, 1)


def frame(spark, data):
    return spark.createDataFrame(data, "d date, k string, v int, w int")


@pytest.fixture
def table(spark):
    return SnapshotTable(spark, scratch_path(spark, "snapshots"), ["d"])


def values(table):
    return sorted((tuple(r) for r in table.read().select("d", "k", "v", "w").collect()), key=repr)


def test_readers_see_all_of_a_change_or_nothing(spark, table):
    with pytest.raises(ValueError, match="nothing is published"):
        table.read()
    old = [(D1, "a", 1, 1), (D1, "b", 2, 2), (D2, "c", 3, 3)]
    table.publish(table.stage_append(frame(spark, old)))
    new = frame(spark, [(D1, "b", 9, 9), (D3, "d", 4, 4)])
    staged = table.stage_upsert(new, ["d", "k"])
    # the job stops here: nothing has happened for readers, in this session or another
    assert values(table) == old and table.version() == 1
    assert rows(SnapshotTable(spark.newSession(), table.path, ["d"]).read().select("d", "k", "v", "w")) == old
    # it is run again from the beginning
    after = [(D1, "a", 1, 1), (D1, "b", 9, 9), (D2, "c", 3, 3), (D3, "d", 4, 4)]
    table.publish(table.stage_upsert(new, ["d", "k"]))
    assert values(table) == after and table.version() == 2
    with pytest.raises(ValueError, match="stage again"):
        table.publish(staged)
    assert values(table) == after


def test_an_open_reader_keeps_its_version(spark, table):
    table.publish(table.stage_append(frame(spark, [(D1, "a", 1, 1)])))
    before = table.read()
    table.publish(table.stage_upsert(frame(spark, [(D1, "a", 2, 2)]), ["d", "k"]))
    assert rows(before.select("v")) == [(1,)] and rows(table.read().select("v")) == [(2,)]


def test_only_met_partitions_are_read_and_written(spark, table):
    table.publish(table.stage_append(frame(spark, [(D1, "a", 1, 1), (D2, "b", 2, 2)])))
    kept = {f for f in table.read().inputFiles() if "d=2019-01-01" in f}
    now, met, old = table._met(frame(spark, [(D2, "b", 3, 3)]))
    assert len(old.inputFiles()) == 1 and "d=2019-02-01" in old.inputFiles()[0]
    table.publish(table.stage_upsert(frame(spark, [(D2, "b", 3, 3)]), ["d", "k"]))
    assert {f for f in table.read().inputFiles() if "d=2019-01-01" in f} == kept
    one = table.read().where(F.col("d") == D1)
    assert "PartitionFilters: [isnotnull(d" in plan_of(one) and len([f for f in one.inputFiles()]) >= 1


def test_stored_update_of_one_column(spark, table):
    old = [(D1, "a", 1, 1), (D1, "a", 2, 2), (D1, None, 3, 3), (D2, "b", 4, 4)]
    table.publish(table.stage_append(frame(spark, old)))
    files = {f for f in table.read().inputFiles() if "d=2019-02-01" in f}
    table.publish(table.stage_update(frame(spark, [(D1, "a", 7, 70), (D1, "n", 8, 8), (D1, None, 9, 9)]), ["d", "k"], ["v"]))
    assert values(table) == sorted([(D1, "a", 7, 1), (D1, "a", 7, 2), (D1, None, 3, 3), (D1, None, 9, 9), (D1, "n", 8, 8), (D2, "b", 4, 4)], key=repr)
    assert {f for f in table.read().inputFiles() if "d=2019-02-01" in f} == files


def test_partition_values_with_signs_and_nulls(spark):
    table = SnapshotTable(spark, scratch_path(spark, "signs"), ["p", "q"])
    data = [("a/b", "x=1", 1), ("1", "é %", 2), (None, "01", 3)]
    new = lambda d: spark.createDataFrame(d, "p string, q string, v int")
    table.publish(table.stage_append(new(data)))
    assert rows(table.read().select("v", "p", "q")) == [(v, p, q) for p, q, v in data]
    table.publish(table.stage_upsert(new([("a/b", "x=1", 5), (None, "01", 6)]), ["p", "q"]))
    assert sorted(r["v"] for r in table.read().collect()) == [2, 3, 5, 6]  # a null key matches nothing


def test_declared_table_keeps_comments_and_refuses_negative_counts(spark):
    counts = ["total_on_cnt", "total_off_cnt"]
    path = scratch_path(spark, "declared")
    table = SnapshotTable(spark, path, ["line_num"], schema=SPATIAL_SCHEMA, non_negative=counts)
    good = spark.createDataFrame([("a", "2", "5", "7", "-2")], "stn_name string, line_num string, total_on_cnt string, total_off_cnt string, net_flow_cnt string")
    table.publish(table.stage_append(good))
    bad = good.unionByName(good.selectExpr("stn_name", "line_num", "'-1' as total_on_cnt", "'-4' as total_off_cnt", "net_flow_cnt")).unionByName(
        good.selectExpr("stn_name", "line_num", "'-3' as total_on_cnt", "total_off_cnt", "net_flow_cnt")
    )
    with pytest.raises(ValueError, match="2 rows of total_on_cnt|1 rows of total_off_cnt, 2 rows of total_on_cnt"):
        table.publish(table.stage_append(bad))
    back = SnapshotTable(spark.newSession(), path, ["line_num"]).read()
    assert rows(back.select("stn_name", "line_num", "total_on_cnt", "net_flow_cnt")) == [("a", 2, 5, -2)]
    told = {f.name: f.metadata.get("comment") for f in back.schema}
    assert told == {f.name: f.metadata["comment"] for f in SPATIAL_SCHEMA}


def test_a_file_is_loaded_once(spark, table, tmp_path):
    head = "날짜,k,v,w\n"
    (tmp_path / "in").mkdir()
    write = lambda name, *lines: (tmp_path / "in" / name).write_text(head + "\n".join(lines) + "\n", encoding="utf-8")
    write("a.csv", "2019-01-01,a,1,1", "2019-01-01,a,1,1")
    write("b.csv", "2019-02-01,b,2,2")

    def read(files):
        df = csv.read_many(spark, files)
        return df.select(F.to_date("`날짜`").alias("d"), "k", F.col("v").cast("int").alias("v"), F.col("w").cast("int").alias("w"))

    path = [str(tmp_path / "in")]
    once = [(D1, "a", 1, 1), (D1, "a", 1, 1), (D2, "b", 2, 2)]
    assert table.append_files(path, read) == 1 and values(table) == once
    assert table.append_files(path, read) == 1 and values(table) == once
    write("copy of a.csv", "2019-01-01,a,1,1", "2019-01-01,a,1,1")  # the same lines under another name
    write("c.csv", "2019-01-01,a,1,1")
    assert table.append_files(path, read) == 2
    assert values(table) == sorted([*once, (D1, "a", 1, 1)], key=repr)
    # a load that died before it was published leaves no trace in the ledger
    write("d.csv", "2019-03-01,e,5,5")
    with pytest.raises(RuntimeError):
        table.append_files(path, lambda files: (_ for _ in ()).throw(RuntimeError("lost")))
    assert table.append_files(path, read) == 3 and (D3, "e", 5, 5) in values(table)
    table.publish(table.stage_upsert(frame(spark, [(D3, "e", 6, 6)]), ["d", "k"]))
    assert table.append_files(path, read) == 4  # the ledger outlives other changes


def test_digests_of_files(spark, tmp_path):
    for name, text in (("a", "x\ny\n"), ("b", "y\nx\n"), ("c", "x\nx\n"), ("d", "y\ny\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r["file"][-5]: r["digest"] for r in file_digests(spark, [str(tmp_path)]).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3
