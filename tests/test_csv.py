import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from gateflow.config import SLOTS
from gateflow.plans.layers import flow_stats, raw_from_files, year_table
from gateflow.sources import csv

HEAD = "날짜,호선, 역번호 ,역명,구분," + ",".join(SLOTS) + ",합계"


def line(day, station="강남(2)", kind="승차", first='"1,000"', n=19):
    return f"{day},2호선,222,{station},{kind},{first}," + ",".join(["1"] * n) + ",9"


@pytest.fixture
def folder(tmp_path):
    def write(name, *files, encoding="utf-8"):
        d = tmp_path / name
        d.mkdir()
        for i, text in enumerate(files):
            (d / f"f{i}.csv").write_text(text, encoding=encoding)
        return str(d)

    return write


def test_header_on_line_zero_and_one(spark, folder):
    a = folder("a", "\n".join([HEAD, line("2019-01-02")]))
    b = folder("b", "\n".join(["표 제목,,", HEAD, line("2019-01-02")]))
    assert csv.detect_header(spark, a).line == 0
    assert csv.detect_header(spark, b).line == 1
    for path in (a, b):
        df = csv.read_wide_csv(spark, path)
        assert "역번호" in df.columns and df.count() == 1


def test_byte_order_mark_and_crlf(spark, folder):
    path = folder("a", "\r\n".join([HEAD, line("2019-01-02"), ""]), encoding="utf-8-sig")
    df = csv.read_wide_csv(spark, path)
    assert df.columns[0] == "날짜"
    assert [r["날짜"] for r in df.collect()] == ["2019-01-02"]


def test_every_file_has_its_header(spark, folder):
    text = "\n".join([HEAD, line("2019-01-02"), line("2019-01-03", kind="하차")])
    df = csv.read_wide_csv(spark, folder("a", text, text, HEAD))
    assert df.count() == 4


def test_files_with_other_headers_stop_the_read(spark, folder):
    other = HEAD.replace("역명,구분", "구분,역명")
    path = folder("a", HEAD + "\n" + line("2019-01-02"), other + "\n" + line("2019-01-02"))
    with pytest.raises(Exception, match="differ in their header"):
        csv.read_wide_csv(spark, path).collect()


def test_ingest(spark, folder):
    text = "\n".join(
        [HEAD, line("2019-01-02"), line("02/01/2019", first="-"), line("bad"),
         line("20190103", kind="하차")]
    )
    df = csv.read_wide_csv(spark, folder("a", text))
    assert csv.direction_columns(df, ["승차", "하차", "없음"]) == {
        "승차": "구분", "하차": "구분", "없음": None,
    }
    wide = csv.ingest_wide(df, "승차")
    got = wide.orderBy(F.col("승차합계")).collect()
    assert [r["승차합계"] for r in got] == [19, 1019]
    assert [(str(r.base_date), r.line, r.station_no) for r in got] == [("2019-01-02", "2", "222")] * 2
    assert csv.ingest_wide(df, "없음").count() == 0


def test_missing_and_surplus_slots(spark, folder):
    head = "날짜,호선,역번호,역명,구분,06~07,07~08"
    few = csv.ingest_wide(
        csv.read_wide_csv(spark, folder("a", head + "\n2019-01-02,2호선,1,x,승차,5,6")), "승차"
    ).first()
    assert (few[SLOTS[0]], few[SLOTS[1]], few[SLOTS[2]]) == (5, 6, 0)
    many = "날짜,호선,역번호,역명,구분," + ",".join(f"{h}~{h + 1}" for h in range(24))
    row = "2019-01-02,2호선,1,x,승차," + ",".join("1" for _ in range(24))
    wide = csv.ingest_wide(csv.read_wide_csv(spark, folder("b", many + "\n" + row)), "승차")
    assert wide.first()["승차합계"] == 20


def test_raw_layer_keeps_sums_and_plan_is_narrow(spark, folder):
    text = "\n".join([HEAD, line("2019-01-02"), line("2019-01-02", kind="하차", first="7")])
    path = folder("a", text)
    raw = raw_from_files(spark, [path], {path: "구분"})
    assert raw.count() == 40
    assert tuple(raw.agg(F.sum("boarding"), F.sum("alighting")).first()) == (1019, 26)
    assert "Exchange" not in plan_of(raw)


def test_long_table_keeps_null_apart_from_zero(spark, folder):
    path = folder("a", "\n".join([HEAD, line("2019-01-02", first="0"), line("2019-01-02", first="")]))
    long = flow_stats(spark, [path]).where("slot = '06:00이전'")
    assert sorted([r.n_people for r in long.collect()], key=str) == [0, None]


def test_year_table_first_file_and_line_win(spark, folder):
    a = folder("a", "날짜,공휴일구분,역번호\n20190101,신정,1\n2019-01-01,다름,1\n2019-01-02,평일,1")
    b = folder("b", "날짜, 역번호\n2019-01-01,1\n2019-01-01,2")
    got = {(r.base_date, r.station_no): r.day_kind for r in year_table(spark, [b, a]).collect()}
    assert got == {
        ("2019-01-01", "1"): "신정", ("2019-01-02", "1"): "평일", ("2019-01-01", "2"): "평일",
    }


def test_name_with_the_date_word_is_data(spark, folder):
    path = folder("a", "\n".join([HEAD, line("2019-01-02", station="날짜변경선")]))
    assert [r["역명"] for r in csv.read_wide_csv(spark, path).collect()] == ["날짜변경선"]


def test_quoted_line_break(spark, folder):
    text = "\n".join(["표 제목,,", HEAD, line("2019-01-02", station='"강\n남"'), line("2019-01-03")])
    path = folder("a", text, text)
    with pytest.raises(Exception, match="multi_line"):
        csv.read_wide_csv(spark, path).collect()
    got = csv.read_wide_csv(spark, path, multi_line=True)
    assert sorted((r["날짜"], r["역명"]) for r in got.collect()) == [("2019-01-02", "강\n남")] * 2 + [("2019-01-03", "강남(2)")] * 2
    ordered = csv.read_wide_csv(spark, path, multi_line=True, with_order=True)
    assert set(csv.ORDER) <= set(ordered.columns) and ordered.count() == 4


def test_raw_layer_reads_a_delivery_once(spark, folder):
    text = "\n".join([HEAD, line("2019-01-02"), line("2019-01-02", kind="하차")])
    paths = [folder("a", text), folder("b", text)]
    plan = plan_of(raw_from_files(spark, paths, {p: "구분" for p in paths}))
    assert plan.count("FileScan text") == 2


def test_split_and_whole_reads_of_quoted_line_breaks_are_equal(spark, folder):
    pick = random.Random(5)
    pieces = ["a", "b c", "\n", "\r\n", '""', ",", "\n\n", "역", "x" * 30]
    cell = lambda: '"' + "".join(pick.choice(pieces) for _ in range(pick.randint(0, 6))) + '"' if pick.random() < 0.4 else pick.choice(["1", "k", "", "긴 이름"])
    files = []
    for _ in range(3):
        body = [f"{i}," + ",".join(cell() for _ in range(3)) for i in range(pick.randint(0, 120))]
        files.append("\n".join(["날짜,p,q,r", *body]) + "\n")
    path = folder("a", *files)
    whole = spark.read.csv(path, "`날짜` string, p string, q string, r string", header=True, multiLine=True, quote='"', escape='"')
    want = sorted(tuple(x or "" for x in r) for r in whole.collect())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most, stretch in (("96", 3), ("700", 8), ("128m", 4096)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            csv.STRETCH = stretch
            df = csv.read_wide_csv(spark, path, multi_line=True, with_order=True)
            assert sorted(tuple(r[c] or "" for c in ("날짜", "p", "q", "r")) for r in df.collect()) == want
            ordered = [r["날짜"] for r in df.orderBy(*csv.ORDER).collect()]
            assert sorted(ordered) == sorted(r[0] for r in want)
            lines = spark.read.text(path, lineSep="\n")
            assert (lines.rdd.getNumPartitions() > 3) == (most != "128m")  # several tasks a file
        assert "SortMergeJoin" not in plan_of(csv.read_wide_csv(spark, path, multi_line=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        csv.STRETCH = 4096


def test_cell_over_several_blocks_and_never_closed(spark, folder):
    long = "\n".join(f"line {i}" for i in range(60))
    path = folder("a", f'날짜,p\n1,"{long}"\n2,x\n')
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        got = csv.read_wide_csv(spark, path, multi_line=True)
        assert sorted((r["날짜"], r["p"]) for r in got.collect()) == [("1", long), ("2", "x")]
        with pytest.raises(Exception, match="never closed"):
            csv.read_wide_csv(spark, folder("b", '날짜,p\n1,"open\n2,x\n'), multi_line=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_headers_of_many_files_are_found_in_one_job(spark, folder):
    heads = ["날짜,역번호", "역번호, 날짜 ,공휴일구분", "날짜,역번호,호선"]
    rows = ["2019-01-02,1", "1,2019-01-02,휴일", "2019-01-02,1,2호선"]
    texts = [("제목\n" if i % 6 == 1 else "") + heads[i % 3] + "\n" + "\n".join([rows[i % 3]] * (i % 5)) + "\n" for i in range(50)]
    path = folder("a", *texts, "", "\n \n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        df = csv.read_many(spark, [path], with_order=True)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs <= 3  # one action; adaptive execution runs its stages as jobs
    assert plan_of(df).count("FileScan text") == 4  # one header also stands below a title
    assert df.count() == sum(i % 5 for i in range(50))
    assert [g.header.line for g in csv.catalogue(spark, [path])].count(1) == 1
    assert sum(len(g.files) for g in csv.catalogue(spark, [path])) == 50
    assert df.where("`날짜` = '2019-01-02' and `역번호` = '1'").count() == df.count()


def test_names_of_files_may_hold_blanks_and_signs(spark, tmp_path):
    d = tmp_path / "승하차 자료"
    d.mkdir()
    for name in ("2019년 1월.csv", "a%20b+c.csv"):
        (d / name).write_text(HEAD + "\n" + line("2019-01-02") + "\n", encoding="utf-8")
    assert csv.read_many(spark, [str(d)]).count() == 2
    assert csv.ingest_many(spark, [str(d)], "승차").count() == 2


def test_files_of_one_header_are_one_scan(spark, folder):
    from workload import inputs

    text = "\n".join([HEAD, line("2019-01-02"), line("2019-01-03", kind="하차")])
    d = folder("many", *[text] * 6)
    loaded = inputs._wide_rows(spark, [f"{d}/f{i}.csv" for i in range(6)])
    assert loaded.count() == 12 and plan_of(loaded).count("FileScan") == 1


def test_the_rule_of_a_count_does_not_stand_in_the_plan_per_slot(spark, folder):
    df = csv.read_wide_csv(spark, folder("a", "\n".join([HEAD, line("2019-01-02")])))
    wide = csv.ingest_directions(df, ["승차", "하차"], "구분")
    assert wide.first()[SLOTS[0]] == 1000
    assert plan_of(wide).count("[eE]") <= 2  # not once per slot


def test_methods_over_a_delivery_are_short_enough_to_be_compiled(spark, folder):
    # the JVM leaves methods over 8,000 bytes to its interpreter
    path = folder("a", "\n".join([HEAD, line("2019-01-02"), line("2019-01-02", kind="하차")]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wide = csv.ingest_directions(csv.read_wide_csv(spark, path), ("승차", "하차"), "구분")
        for df in (wide, raw_from_files(spark, [path], columns={path: "구분"}), flow_stats(spark, [path])):
            stages = df._jdf.queryExecution().debug().codegenToSeq()
            assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dates_are_not_parsed_again_by_the_condition(spark, folder):
    path = folder("a", "\n".join([HEAD, line("2019-01-02"), line("미상"), line("2019-01-03", kind="-")]))
    wide = csv.ingest_directions(csv.read_wide_csv(spark, path), ("승차", "하차"), "구분")
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert not any("substring" in x for x in plan.split("\n") if x.lstrip(" +-:").startswith("Filter"))
    assert [str(r["base_date"]) for r in wide.collect()] == ["2019-01-02"]


def test_wide_rows_are_dealt_before_they_become_twenty(spark, folder):
    path = folder("a", "\n".join([HEAD, line("2019-01-02"), line("2019-01-02", kind="하차"), line("2019-01-04", station="역삼")]))
    dealt = raw_from_files(spark, [path], columns={path: "구분"}, together=["station", "line"])
    plan = plan_of(dealt)
    assert plan.index("Expand") < plan.index("hashpartitioning(station")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(dealt) == told(raw_from_files(spark, [path], columns={path: "구분"}))
