"""Sources, sinks and cleaning of deliveries (S, K, and the rows about them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateflow.config import ALIGHTING_WORD, BOARDING_WORD, DATE_WORD, HOLIDAY_KIND, HOURS, SLOTS
from gateflow.functions.dates import iso_text, month_start, parse_date
from gateflow.functions.headers import quoted, slot_columns
from gateflow.functions.numbers import clean_count, row_total
from gateflow.operators.filters import between_dates, in_month, pick, valid_dates
from gateflow.operators.quality import ObservedLoad, reject_counts
from gateflow.operators.reshape import hourly_kpi
from gateflow.plans.layers import flow_stats, raw_from_files, year_table
from gateflow.plans.marts import SPATIAL_SCHEMA, station_spatial
from gateflow.sinks import tables as t
from gateflow.sinks.snapshots import SnapshotTable
from gateflow.sources import csv
from gateflow.sources.dimensions import calendar, read_station_dim
from gateflow.sources.named import query_named
from workload import fixtures as fx
from workload.oracle import GOT_CHECK, GOT_TOTAL, LOST, sql, unreadable
from workload.registry import query


def n_rows():
    return F.count(F.lit(1)).alias("n_rows")


def _sum(c, name):
    return F.sum(c).cast("bigint").alias(name)


def _each(spark, sf, one):
    """`one(name, path)` of the deliveries a, b and c, stacked."""
    paths, out = fx.deliveries(spark, sf), None
    for name in "abc":
        part = one(name, paths[name])
        out = part if out is None else out.unionByName(part)
    return out


# --- sources -------------------------------------------------------------------------


@query(
    "s1_csv_scan",
    sql(
        "sent",
        f"""
    select delivery, case delivery when 'a' then strftime(base_date, '%Y%m%d') when 'c' then strftime(base_date, '%d/%m/%Y')
        else case when bad_date then '미상' else strftime(base_date, '%Y-%m-%d') end end as day_text, direction,
      count(*) as n_rows, max(length(station))::int as longest_name,
      sum(case when {unreadable('s08')} then 0 else s08 end)::bigint as at_eight,
      max(case when delivery = 'b' and s08 >= 1000 then 1 else 0 end)::int as has_comma
    from sent group by all""",
    ),
)
def _(spark, sf):
    def one(delivery, path):
        df = csv.read_wide_csv(spark, path)
        eight = F.col(quoted(slot_columns(df.columns, "clock")[HOURS.index(8)]))
        keys = [F.lit(delivery).alias("delivery"), F.col(DATE_WORD).alias("day_text"), F.col("구분").alias("direction")]
        return df.groupBy(*keys).agg(
            n_rows(),
            F.max(F.char_length("역명")).cast("int").alias("longest_name"),
            _sum(clean_count(eight), "at_eight"),
            F.max(F.when(eight.contains(","), 1).otherwise(0)).alias("has_comma"),
        )

    return _each(spark, sf, one)


@query(
    "s2_header_row",
    sql(
        "sent",
        """
    select delivery, direction,
      case when delivery <> 'a' then null when isodow(base_date) >= 6 then '주말' else '평일' end as day_kind,
      count(*) as n_rows, min(day) as first_day, max(day) as last_day, (delivery = 'a')::int as header_line
    from (select *, case delivery when 'a' then strftime(base_date, '%Y%m%d') when 'c' then strftime(base_date, '%d/%m/%Y')
        else case when bad_date then '미상' else strftime(base_date, '%Y-%m-%d') end end as day from sent)
    group by all""",
    ),
)
def _(spark, sf):
    def one(delivery, path):
        line = csv.detect_header(spark, path).line
        df = csv.read_wide_csv(spark, path)
        kind = F.col(HOLIDAY_KIND) if HOLIDAY_KIND in df.columns else F.lit(None).cast("string")
        keys = [F.lit(delivery).alias("delivery"), F.col("구분").alias("direction"), kind.alias("day_kind")]
        return df.groupBy(*keys).agg(
            n_rows(),
            F.min(DATE_WORD).alias("first_day"),
            F.max(DATE_WORD).alias("last_day"),
            F.lit(line).alias("header_line"),
        )

    return _each(spark, sf, one)


@query(
    "s3_many_files",
    sql(
        "sent",
        """
    select direction, line, count(*) as n_rows,
      count(*) filter (delivery = 'a') as n_day_kind, count(*) filter (delivery = 'a') as n_old_slot,
      count(*) filter (delivery <> 'a') as n_new_slot, count(*) filter (delivery = 'b') as n_last_slot
    from sent group by all""",
    ),
)
def _(spark, sf):
    paths = fx.deliveries(spark, sf)
    df = csv.read_many(spark, [paths[k] for k in "cab"], strip="all")
    return df.groupBy(F.col("구분").alias("direction"), F.col("호선").alias("line")).agg(
        n_rows(),
        F.count(HOLIDAY_KIND).alias("n_day_kind"),
        F.count(quoted("05~06")).alias("n_old_slot"),
        F.count(quoted("06:00이전")).alias("n_new_slot"),
        F.count(quoted("24:00이후")).alias("n_last_slot"),
    )


@query(
    "s5_station_dim",
    sql("dim", "select station_clean, station_no as number, lat, lng from dim"),
)
def _(spark, sf):
    """The station file as it is delivered: a CSV with blanks around its header's names."""
    path = t.scratch_path(spark, "stations")
    names = [" station_clean", "고유역번호(외부역코드) ", "lat ", " lng"]
    texts = fx.station_dim(spark, sf).select("station_clean", "station_no", F.col("lat").cast("string"), F.col("lng").cast("string"))
    texts.toDF(*names).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_station_dim(spark, path, {"lat": "double", "lng": "double"}).withColumnRenamed("역번호", "number")


@query("s6_calendar", sql("cal", "select base_date, day_label from cal"))
def _(spark, sf):
    return calendar(spark, *fx.PERIOD, fx.holidays(spark, sf))


@query(
    "s7_named_query",
    sql(
        "lab",
        """select stn_name, base_date, sum(total_flow)::bigint as total_flow, max(day_label) as day_label
        from lab where line_num = 3 and year(base_date) = 2000 group by all""",
    ),
)
def _(spark, sf):
    text = """
        select stn_name, base_date, sum(total_flow) as total_flow, max(day_label) as day_label
        from daily_flow
        where line_num = :line and base_date between make_date(:year, 1, 1) and make_date(:year, 12, 31)
        group by stn_name, base_date order by stn_name, base_date"""
    return query_named(
        spark, text, {"daily_flow": fx.labelled(spark, sf)}, {"line": 3, "year": 2000}
    )


# --- sinks ------------------------------------------------------------------------------


@query("k1_replace_table", sql("spatial", "select * from spatial"))
def _(spark, sf):
    path = t.scratch_path(spark, "replaced")
    marts = station_spatial(fx.raw_long(spark, sf))
    t.write_table(marts.where("net_flow_cnt > 0"), path)
    return t.write_table(marts, path)


@query(
    "k2_append_by_date",
    sql(
        "daily",
        """select cast(date_trunc('month', base_date) as date) as part_month, line_num, count(*) as n_rows,
        sum(total_flow)::bigint as total_flow from daily group by all""",
    ),
)
def _(spark, sf):
    path = t.scratch_path(spark, "appended")
    daily = fx.daily(spark, sf).withColumn("part_month", month_start(F.col("base_date")))
    t.append_by_date(daily.where("year(base_date) <= 1999"), path, "part_month", first=True)
    df = t.append_by_date(daily.where("year(base_date) > 1999"), path, "part_month")
    return df.groupBy("part_month", "line_num").agg(n_rows(), _sum("total_flow", "total_flow"))


@query(
    "k4_upsert",
    sql(
        "daily",
        """
    select base_date, stn_name, line_num,
      case when year(base_date) >= 2000 and line_num <= 4 then on_cnt + 1000 else on_cnt end as on_cnt, off_cnt
    from daily where year(base_date) <= 2000 or line_num <= 4""",
    ),
)
def _(spark, sf):
    path = t.scratch_path(spark, "upserted")
    daily = fx.daily(spark, sf).select(
        "base_date", "stn_name", "line_num", "on_cnt", "off_cnt",
        month_start(F.col("base_date")).alias("part_month"),
    )
    t.write_table(daily.where("year(base_date) <= 2000"), path, partition_by=["part_month"])
    new = daily.where("year(base_date) >= 2000 and line_num <= 4").withColumn(
        "on_cnt", F.col("on_cnt") + 1000
    )
    keys = ["base_date", "stn_name", "line_num"]
    return t.upsert_table(spark, path, new, keys, ["part_month"]).drop("part_month")


@query(
    "k5_upsert_update",
    sql(
        "lab",
        """
    select base_date, max(day_label) as day_label,
      case when base_date < date '1999-01-01' then max(day_label)
        else concat(max(day_label), '*') end as note,
      case when base_date > date '1999-12-31' then sum(total_flow)::bigint + 1
        else sum(total_flow)::bigint end as total_flow
    from lab group by base_date""",
    ),
)
def _(spark, sf):
    days = fx.labelled(spark, sf).groupBy("base_date").agg(
        F.max("day_label").alias("day_label"), _sum("total_flow", "total_flow")
    )
    days = days.withColumn("note", F.col("day_label"))
    old = days.where("base_date <= '1999-12-31'")
    new = days.where("base_date >= '1999-01-01'").select(
        "base_date",
        "day_label",
        F.concat("note", F.lit("*")).alias("note"),
        (F.col("total_flow") + 1).alias("total_flow"),
    )
    return t.upsert_update(old, new, ["base_date"], ["note"])


@query(
    "k7_conform",
    sql(
        "spatial",
        """select cast(stn_name as varchar) as stn_name, line_num, total_on_cnt, total_off_cnt, net_flow_cnt
        from spatial""",
    ),
)
def _(spark, sf):
    texts = station_spatial(fx.raw_long(spark, sf))
    texts = texts.select(*[F.col(c).cast("string").alias(c) for c in reversed(texts.columns)])
    return t.conform(texts, SPATIAL_SCHEMA)


@query(
    "k8_layout",
    sql(
        "kpi",
        """select base_date, stn_name, line_num, hour, on_cnt, off_cnt from kpi
        where base_date >= date '2000-02-01' and base_date < date '2000-03-01' and line_num = 2""",
    ),
)
def _(spark, sf):
    kpi = fx.kpi(spark, sf).withColumn("part_month", month_start(F.col("base_date")))
    path = t.scratch_path(spark, "layout")
    stored = t.write_table(
        kpi, path, partition_by=["part_month"], sort_by=["stn_name", "line_num", "base_date"]
    )
    rows = pick(in_month(stored, "base_date", fx.MONTH, "part_month"), line_num=2)
    return rows.select("base_date", "stn_name", "line_num", "hour", "on_cnt", "off_cnt")


@query(
    "k8_lookup",
    sql(
        "kpi",
        """select base_date, stn_name, line_num, hour, on_cnt, off_cnt from kpi
        where stn_name = 'Supplier#000000003역' and line_num in (1, 4)""",
    ),
)
def _(spark, sf):
    """One station and two lines of the hourly mart by its second access path."""
    path = t.scratch_path(spark, "by-station")
    by_station = t.write_lookup(fx.kpi(spark, sf), path, "stn_name", ["line_num", "base_date"], 16)
    rows = pick(by_station, stn_name="Supplier#000000003역", line_num=[1, 4])
    return rows.select("base_date", "stn_name", "line_num", "hour", "on_cnt", "off_cnt")


# --- deliveries ---------------------------------------------------------------------------


@query(
    "e4_ingest_wide",
    sql(
        "got",
        f"""
    select base_date, line, direction, count(*) as n_rows, sum({GOT_TOTAL})::bigint as total,
      sum({GOT_CHECK})::bigint as by_slot, min(station_no) as first_no
    from got where not bad_date group by all""",
    ),
)
def _(spark, sf):
    """Both directions from one reading of each delivery."""
    total = row_total([F.col(quoted(s)) for s in SLOTS])
    by_slot = row_total([F.col(quoted(s)) * h for s, h in zip(SLOTS, HOURS)])
    rows = _wide_rows(spark, [fx.deliveries(spark, sf)[k] for k in "abc"])
    return rows.groupBy("base_date", "line", "direction").agg(
        n_rows(), _sum(total, "total"), _sum(by_slot, "by_slot"), F.min("station_no").alias("first_no")
    )


_LOADED = f"""
    select date_trunc('month', base_date)::date as part_month, line, direction, count(*) as n_rows,
      sum(f * ({GOT_TOTAL}))::bigint as total, sum(f * ({GOT_CHECK}))::bigint as by_slot
    from (select *, {{factor}} as f from got where not bad_date or {{also}}) group by all"""


def _loaded(rows):
    total = row_total([F.col(quoted(s)) for s in SLOTS])
    by_slot = row_total([F.col(quoted(s)) * h for s, h in zip(SLOTS, HOURS)])
    return rows.groupBy("part_month", "line", "direction").agg(n_rows(), _sum(total, "total"), _sum(by_slot, "by_slot"))


def _wide_rows(spark, paths):
    """Both directions of deliveries in the fixed wide shape, with their month; a scan per
    header, also when the paths are single files."""
    out = None
    for group in csv.catalogue(spark, paths):
        wide = csv.ingest_directions(csv.read_delivered(spark, group), (BOARDING_WORD, ALIGHTING_WORD), "구분")
        out = wide if out is None else out.unionByName(wide)
    return out.withColumn("part_month", month_start(F.col("base_date")))


_CORRECTED = f"(delivery = 'b' and line = '{fx.LINE_OF_K}' and year(base_date) = {fx.YEAR_OF_K})"


@query("e4_load_twice", sql("got", _LOADED.format(factor=f"case when {_CORRECTED} then 2 else 1 end", also=_CORRECTED)))
def _(spark, sf):
    """Deliveries, then a correction of one of them; the correction is delivered twice."""
    paths = fx.deliveries(spark, sf)
    table = SnapshotTable(spark, t.scratch_path(spark, "loaded"), ["part_month"], ["station_no", "base_date"])
    keys = ["part_month", "base_date", "line", "station_no", "direction"]
    for names in ("abc", "k", "k"):
        rows = _wide_rows(spark, [paths[n] for n in names])
        table.publish(table.stage_upsert(rows, keys))
    return _loaded(table.read())


@query("k2_load_ledger", sql("got", _LOADED.format(factor="1", also="false")))
def _(spark, sf):
    """Deliveries appended one after another, and all of them again."""
    paths = fx.deliveries(spark, sf)
    table = SnapshotTable(spark, t.scratch_path(spark, "ledger"), ["part_month"])
    for names in ("ab", "c", "abc"):
        table.append_files([paths[n] for n in names], lambda files: _wide_rows(spark, files))
    return _loaded(table.read())


@query(
    "k5_stored_update",
    sql(
        "daily",
        """select base_date, stn_name, line_num, on_cnt,
        case when year(base_date) = 2000 and line_num = 3 then off_cnt + 5 else off_cnt end as off_cnt
        from daily where year(base_date) <= 2000 or line_num <= 4""",
    ),
)
def _(spark, sf):
    """One column of a stored table; rows of unknown keys are inserted whole."""
    daily = fx.daily(spark, sf).select(
        "base_date", "stn_name", "line_num", "on_cnt", "off_cnt", month_start(F.col("base_date")).alias("part_month")
    )
    table = SnapshotTable(spark, t.scratch_path(spark, "updated"), ["part_month"])
    table.publish(table.stage_append(daily.where("year(base_date) <= 2000")))
    keys = ["part_month", "base_date", "stn_name", "line_num"]
    fresh = daily.where("year(base_date) > 2000 and line_num <= 4")
    known = daily.where("year(base_date) = 2000 and line_num = 3")
    known = known.withColumns({"on_cnt": F.col("on_cnt") * 7, "off_cnt": F.col("off_cnt") + 5})  # on_cnt is not taken
    table.publish(table.stage_update(fresh.unionByName(known), keys, ["off_cnt"]))
    return table.read().drop("part_month")


@query(
    "k7_declared_table",
    sql("spatial", "select * from spatial"),
)
def _(spark, sf):
    """A table with a declared schema and counts that may not be negative."""
    texts = station_spatial(fx.raw_long(spark, sf))
    texts = texts.select(*[F.col(c).cast("string").alias(c) for c in reversed(texts.columns)])
    counts = ["total_on_cnt", "total_off_cnt"]
    table = SnapshotTable(spark, t.scratch_path(spark, "declared"), ["line_num"], schema=SPATIAL_SCHEMA, non_negative=counts)
    table.publish(table.stage_append(texts))
    return table.read()


@query(
    "e1_raw_from_files",
    sql(
        "got",
        f"""
    select hour, trim(station) as station, line, count(*) as n_rows,
      sum(case when direction = '승차' then v else 0 end)::bigint as boarding,
      sum(case when direction = '하차' then v else 0 end)::bigint as alighting
    from (unpivot (select station, line, direction, {', '.join(f'r{h:02d} as "{h:02d}"' for h in HOURS)}
      from got where not bad_date) on columns(* exclude (station, line, direction)) into name hour value v)
    group by all""",
    ),
)
def _(spark, sf):
    paths = [fx.deliveries(spark, sf)[k] for k in "abc"]
    raw = raw_from_files(spark, paths, columns={p: "구분" for p in paths}, together=["station", "line"])
    return raw.groupBy("hour", "station", "line").agg(
        n_rows(), _sum("boarding", "boarding"), _sum("alighting", "alighting")
    )


@query(
    "p3_align_slots",
    sql(
        "got",
        f"""select delivery, line, station_no, count(*) as n_rows, sum(r05)::bigint as first_slot,
        sum(r23)::bigint as slot_23, sum(r24)::bigint as last_slot, sum({GOT_CHECK})::bigint as by_slot
        from got group by all""",
    ),
)
def _(spark, sf):
    def one(delivery, path):
        df = csv.read_wide_csv(spark, path)
        ids = [F.regexp_replace("호선", "호선", "").alias("line"), F.col("역번호").alias("station_no")]
        wide = csv.align_slots(df, ids, slot_columns(df.columns, "clock"), [f"h{h:02d}" for h in HOURS])
        by_slot = row_total([F.col(f"h{h:02d}") * h for h in HOURS])
        return wide.groupBy(F.lit(delivery).alias("delivery"), "line", "station_no").agg(
            n_rows(), _sum("h05", "first_slot"), _sum("h23", "slot_23"), _sum("h24", "last_slot"), _sum(by_slot, "by_slot")
        )

    return _each(spark, sf, one)


@query(
    "p6_filter_direction",
    sql(
        "sent",
        """select delivery, line, station_no, direction, count(*) as n_rows
        from sent where direction = '하차' group by all""",
    ),
)
def _(spark, sf):
    def one(delivery, path):
        rows = csv.filter_direction(csv.read_wide_csv(spark, path), ALIGHTING_WORD)
        return rows.groupBy(
            F.lit(delivery).alias("delivery"),
            F.col("호선").alias("line"), F.col("역번호").alias("station_no"), F.col("구분").alias("direction"),
        ).agg(n_rows())

    return _each(spark, sf, one)


@query(
    "p8_default_column",
    sql(
        "sent",
        """select delivery, case when delivery = 'a' and isodow(base_date) >= 6 then '주말' else '평일' end
        as day_kind, count(*) as n_rows from sent group by all""",
    ),
)
def _(spark, sf):
    out = None
    for k in "abc":
        df = csv.read_wide_csv(spark, fx.deliveries(spark, sf)[k], strip="all")
        one = csv.with_default(df, HOLIDAY_KIND, "평일").groupBy(
            F.lit(k).alias("delivery"), F.col(HOLIDAY_KIND).alias("day_kind")
        ).agg(n_rows())
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "p12_clean_count",
    sql(
        "got",
        f"""select got.station_no, got.delivery, sum({GOT_TOTAL})::bigint as total, n_unreadable
        from got join (select station_no, delivery, sum({LOST})::bigint as n_unreadable from sent group by all)
          using (station_no, delivery) group by all""",
    ),
)
def _(spark, sf):
    def one(delivery, path):
        df = csv.read_wide_csv(spark, path)
        cells = [F.col(quoted(c)) for c in slot_columns(df.columns, "clock")]
        lost = [(c.isNotNull() & clean_count(c, keep_null=True).isNull()).cast("int") for c in cells]
        return df.groupBy(F.col("역번호").alias("station_no"), F.lit(delivery).alias("delivery")).agg(
            _sum(row_total([clean_count(c) for c in cells]), "total"), _sum(row_total(lost), "n_unreadable")
        )

    return _each(spark, sf, one)


@query(
    "p13_row_total",
    sql("wide", f"""select base_date, station_no, line,
        ({' + '.join(f'on_{h:02d}' for h in HOURS)})::bigint as total from wide"""),
)
def _(spark, sf):
    total = row_total([F.col(f"on_{h:02d}") for h in HOURS])
    return fx.wide(spark, sf).select("base_date", "station_no", "line", total.alias("total"))


@query(
    "l6_valid_dates",
    sql("sent", "select delivery, base_date, count(*) as n_rows from sent where not bad_date group by all"),
)
def _(spark, sf):
    def one(delivery, path):
        df = csv.read_wide_csv(spark, path)
        dated = valid_dates(df.select(parse_date(F.col(DATE_WORD)).alias("base_date")))
        return dated.groupBy(F.lit(delivery).alias("delivery"), "base_date").agg(n_rows())

    return _each(spark, sf, one)


@query(
    "f2_parse_date",
    sql(
        "sent",
        """select delivery, case when not bad_date then base_date end as base_date, count(*) as n_rows
        from sent group by all""",
    ),
)
def _(spark, sf):
    out = None
    for k in "abc":
        df = csv.read_wide_csv(spark, fx.deliveries(spark, sf)[k])
        one = df.groupBy(
            F.lit(k).alias("delivery"), parse_date(F.col(DATE_WORD)).alias("base_date")
        ).agg(n_rows())
        out = one if out is None else out.unionByName(one)
    return out


_REJECTS = f"""
    select delivery, direction, count(*) as n_rows, 0::bigint as n_no_date, count(*) filter (bad_date) as n_bad_date,
      sum({LOST})::bigint as n_bad_count, 0::bigint as n_no_count, 0::bigint as n_negative
    from sent group by all"""


@query("q6_reject_counts", sql("sent", _REJECTS))
def _(spark, sf):
    def one(delivery, path):
        df = csv.read_wide_csv(spark, path).withColumnRenamed("구분", "direction")
        told = reject_counts(df, DATE_WORD, slot_columns(df.columns, "clock"), ["direction"])
        return told.withColumn("delivery", F.lit(delivery))

    return _each(spark, sf, one)


@query("q6_during_the_write", sql("sent", _REJECTS))
def _(spark, sf):
    """The same counts, gathered by the load that writes the rows."""

    def one(delivery, path):
        df = csv.read_wide_csv(spark, path)
        load = ObservedLoad(df, DATE_WORD, slot_columns(df.columns, "clock"), "구분", [BOARDING_WORD, ALIGHTING_WORD])
        words = (BOARDING_WORD, ALIGHTING_WORD)
        t.write_table(csv.ingest_directions(load.rows, words, "구분"), t.scratch_path(spark, "observed"))
        return load.counts(spark).withColumnRenamed("구분", "direction").withColumn("delivery", F.lit(delivery))

    return _each(spark, sf, one)


_LONG_OLD = ", ".join(
    f'''cast(s{h:02d} as bigint) as "{f'{h:02d}~{h + 1:02d}' if h < 24 else '24~'}"''' for h in HOURS
)
_LONG_NEW = ", ".join(
    f'cast(s{h:02d} as bigint) as "{s.replace(" ", "")}"' for s, h in zip(SLOTS, HOURS)
)


@query(
    "c8_flow_stats",
    sql(
        "sent",
        f"""
    select delivery, direction, line, slot, count(*) as n_rows,
      count(case when {unreadable('v')} then null else v end) as n_counts,
      sum(case when {unreadable('v')} then null else v end)::bigint as total
    from (
      select * from (unpivot (select delivery, direction, line, {_LONG_OLD} from sent where delivery = 'a')
        on columns(* exclude (delivery, direction, line)) into name slot value v)
      union all
      select * from (unpivot (select delivery, direction, line, {_LONG_NEW} from sent where delivery <> 'a')
        on columns(* exclude (delivery, direction, line)) into name slot value v)
      where delivery = 'b' or slot <> '24:00이후')
    group by all""",
    ),
)
def _(spark, sf):
    paths = fx.deliveries(spark, sf)
    long = flow_stats(spark, [paths[k] for k in "abc"])
    date = F.col("base_date")
    delivery = (
        F.when(date.contains("/"), "c").when(date.contains("-") | (date == "미상"), "b").otherwise("a")
    )
    stored = t.write_spread(
        long.withColumn("delivery", delivery), t.scratch_path(spark, "flow_stats"), ["delivery", "direction"], 6
    )
    return stored.groupBy("delivery", "direction", "line", "slot").agg(
        n_rows(), F.count("n_people").alias("n_counts"), _sum("n_people", "total")
    )


@query(
    "c7_year_table",
    sql(
        "wide",
        """
    select base_date, station_no, arg_min(day_kind, place) as day_kind from (
      select case when year(base_date) <= 1997 then strftime(base_date, '%Y-%m-%d')
          when year(base_date) <= 2000 and month(base_date) = 2 and day(base_date) = 13 then '미상'
          when year(base_date) <= 2000 then strftime(base_date, '%Y-%m-%d')
          else strftime(base_date, '%d/%m/%Y') end as base_date,
        station_no,
        case when year(base_date) <= 1997 and isodow(base_date) >= 6 then '주말' else '평일' end as day_kind,
        1 as place from wide
      union all
      select strftime(base_date, '%Y-%m-%d'), station_no, '휴일', 2 from wide
      where base_date between date '1997-07-01' and date '1998-06-30')
    group by base_date, station_no""",
    ),
)
def _(spark, sf):
    paths = fx.deliveries(spark, sf)
    return year_table(spark, [paths[k] for k in "dbca"])


@query(
    "a14_dedupe_first",
    sql(
        "wide",
        """select base_date, station_no, arg_min(line, line) as line from wide group by all""",
    ),
)
def _(spark, sf):
    from gateflow.operators.ordered import dedupe_first

    rows = fx.wide(spark, sf).select("base_date", "station_no", "line", F.col("line").alias("_row"))
    return dedupe_first(rows, ["base_date", "station_no"], ["_row"])
