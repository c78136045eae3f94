"""Reshaping, filters, joins and scalar functions (P, L, J, U, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateflow.config import HOURS, MORNING, SLOTS
from gateflow.functions import dates, names, numbers
from gateflow.functions.headers import quoted
from gateflow.operators import filters as fl
from gateflow.operators import reshape as rs
from gateflow.operators.joins import match_station, with_day_label
from gateflow.plans import marts, reports
from workload import fixtures as fx
from workload.oracle import DEFAULT_LABEL, ratio, sql
from workload.registry import query


def n_rows():
    return F.count(F.lit(1)).alias("n_rows")
_H = ", ".join(f'on_{h:02d} as "{h}"' for h in HOURS)


def _sum(c, name=None):
    return F.sum(c).cast("bigint").alias(name or c)


# --- reshaping -----------------------------------------------------------------------


@query(
    "p1_unpivot",
    sql(
        "wide",
        f"""
    select station, hour::int as hour, count(*) as n_rows, sum(v)::bigint as value,
      count(*) filter (v = 0) as n_zero
    from (unpivot (select station, {_H} from wide) on columns(* exclude (station)) into name hour value v)
    group by all""",
    ),
)
def _(spark, sf):
    long = rs.unpivot_slots(
        fx.wide_side(spark, sf, "on"), ["base_date", "station", "line"], fx.WIDE_SLOTS
    )
    return long.groupBy("station", "hour").agg(
        n_rows(), _sum("value"), F.count_if(F.col("value") == 0).alias("n_zero")
    )


@query(
    "p4_slot_hour",
    sql(
        "wide",
        f"""
    select slot, hour, count(*) as n_rows, sum(v)::bigint as value from (
      select slot, case slot {' '.join(f"when '{s}' then {h}" for s, h in zip(SLOTS, HOURS))} end::int as hour, v
      from (unpivot (select station, {', '.join(f'off_{h:02d} as "{s}"' for s, h in zip(SLOTS, HOURS))} from wide)
        on columns(* exclude (station)) into name slot value v))
    group by all""",
    ),
)
def _(spark, sf):
    labelled = fx.wide(spark, sf).select(
        "station", *[F.col(f"off_{h:02d}").alias(s) for s, h in zip(SLOTS, HOURS)]
    )
    long = rs.unpivot_slots(labelled, ["station"], {s: s for s in SLOTS}, "value", "slot")
    return long.groupBy("slot", names.slot_hour(F.col("slot")).alias("hour")).agg(n_rows(), _sum("value"))


@query(
    "p5_raw_long",
    sql(
        "wide",
        f"""
    select base_date, station, line, count(*) as n_rows, sum(b)::bigint as boarding, sum(a)::bigint as alighting,
      sum(hour::int * (b + a))::bigint as by_hour
    from (
      select trim(station) as station, base_date, replace(line, '호선', '') as line, hour, v as b, 0 as a
      from (unpivot (select base_date, station, line, {_H} from wide)
        on columns(* exclude (base_date, station, line)) into name hour value v)
      union all
      select trim(station), base_date, replace(line, '호선', ''), hour, 0, v
      from (unpivot (select base_date, station, line, {_H.replace('on_', 'off_')} from wide)
        on columns(* exclude (base_date, station, line)) into name hour value v))
    group by all""",
    ),
)
def _(spark, sf):
    raw = rs.to_raw_long(
        fx.wide_side(spark, sf, "on"), fx.wide_side(spark, sf, "off"), fx.WIDE_SLOTS
    )
    by_hour = F.col("hour").cast("int") * (F.col("boarding") + F.col("alighting"))
    return raw.groupBy("base_date", "station", "line").agg(
        n_rows(), _sum("boarding"), _sum("alighting"), _sum(by_hour, "by_hour")
    )


@query(
    "p9_peak_flags",
    sql("kpi", """select base_date, stn_name, line_num, hour, peak_morning_on, peak_morning_off, peak_lunch_on,
      peak_lunch_off, peak_evening_on, peak_evening_off from kpi where on_cnt + off_cnt > 0"""),
)
def _(spark, sf):
    plain = fx.kpi(spark, sf).select("base_date", "stn_name", "line_num", "hour", "on_cnt", "off_cnt")
    flags = rs.peak_flags(plain.where("on_cnt + off_cnt > 0"))
    return flags.drop("on_cnt", "off_cnt")


@query("p10_hourly_kpi", sql("kpi", "select * from kpi"))
def _(spark, sf):
    return rs.hourly_kpi(fx.raw_long(spark, sf))


_OFF = _H.replace("on_", "off_")


@query(
    "p11_hourly_kpi_joined",
    sql(
        "wide",
        f"""
    select base_date, station as stn_name, line as line_num, count(*) as n_rows, sum(on_cnt)::bigint as on_cnt,
      sum(off_cnt)::bigint as off_cnt, sum(hour * (on_cnt - off_cnt))::bigint as by_hour
    from (
      select n.base_date, n.station, n.line, n.hour::int as hour, n.v as on_cnt, f.v as off_cnt
      from (unpivot (select base_date, station, line, {_H} from wide)
        on columns(* exclude (base_date, station, line)) into name hour value v) n
      join (unpivot (select base_date, station, line, {_OFF} from wide where line <> '7호선')
        on columns(* exclude (base_date, station, line)) into name hour value v) f
      on n.base_date = f.base_date and n.station = f.station and n.line = f.line and n.hour = f.hour)
    group by all""",
    ),
)
def _(spark, sf):
    off = fx.wide_side(spark, sf, "off").where("line <> '7호선'")  # keys absent on one side
    kpi = rs.hourly_kpi_joined(fx.wide_side(spark, sf, "on"), off, fx.WIDE_SLOTS, unique=True)
    by_hour = F.col("hour") * (F.col("on_cnt") - F.col("off_cnt"))
    return kpi.groupBy("base_date", "stn_name", "line_num").agg(
        n_rows(), _sum("on_cnt"), _sum("off_cnt"), _sum(by_hour, "by_hour")
    )


@query("p14_int_flow", sql("flow", "select * from flow"))
def _(spark, sf):
    return fx.flow(spark, sf)


# --- filters ------------------------------------------------------------------------------


@query(
    "l1_between_dates",
    sql("daily", "select * from daily where base_date between date '1999-03-15' and date '2000-02-29'"),
)
def _(spark, sf):
    span = ("1999-03-15", "2000-02-29")
    return fl.between_dates(fx.daily(spark, sf), "base_date", *span)


@query("l2_in_month", sql("daily", "select * from daily where strftime(base_date, '%Y-%m') = '1999-12'"))
def _(spark, sf):
    return fl.in_month(fx.daily(spark, sf), "base_date", "1999-12")


@query(
    "l3_with_traffic",
    sql(
        "kpi",
        """select stn_name, hour, on_cnt, off_cnt from kpi where peak_morning_on > 0 or peak_morning_off > 0""",
    ),
)
def _(spark, sf):
    rows = fl.with_traffic(fx.kpi(spark, sf), "peak_morning_on", "peak_morning_off")
    return rows.select("stn_name", "hour", "on_cnt", "off_cnt")


@query("l4_matched_only", sql("flow", "select station_id, station, boarding from flow where station_id is not null"))
def _(spark, sf):
    flow = fx.flow(spark, sf)
    return fl.matched_only(flow).select("station_id", "station", "boarding")


@query(
    "l5_equality",
    sql("daily", "select * from daily where line_num in (2, 5) and year(base_date) = 2000"),
)
def _(spark, sf):
    year = fl.in_years(fx.daily(spark, sf), "base_date", [2000])
    return fl.pick(year, line_num=[2, 5], stn_name=None)


@query("l7_group_filter", sql("pbase", "select * from pbase where stn_name not like '%0역'"))
def _(spark, sf):
    """Some stations have corrections that take back all they counted: their total is
    not positive, so they are left out."""
    kpi = fx.kpi(spark, sf)
    peaks = [c for c in kpi.columns if c.startswith("peak_")]
    taken_back = kpi.where(F.col("stn_name").endswith("0역")).withColumns(
        {"on_cnt": -marts.both_ways() - 1, "off_cnt": F.lit(1).cast("bigint"), **{c: F.lit(0).cast("bigint") for c in peaks}}
    )
    return marts.profile_base(kpi.unionByName(taken_back), *fx.PROFILE_PERIOD)


@query(
    "l8_in_years",
    sql("daily", "select year(base_date)::int as yr, count(*) as n_rows, sum(on_cnt)::bigint as on_cnt from daily where year(base_date) in (1996, 1999, 2000) group by all"),
)
def _(spark, sf):
    rows = fl.in_years(fx.daily(spark, sf), "base_date", [1999, 2000, 1996])
    return rows.groupBy(F.year("base_date").alias("yr")).agg(n_rows(), _sum("on_cnt"))


@query(
    "l9_search_stations",
    sql("stations", """select display_name, line_num, area_type, location_grade from stations
      where display_name like '%00000%' and area_type = '오피스형' and location_grade = 'A'"""),
)
def _(spark, sf):
    rows = fl.search_stations(_stations(spark, sf), "00000", area="오피스형", grade="A")
    return rows.select("display_name", "line_num", "area_type", "location_grade")


def _stations(spark, sf, year=fx.YEAR):
    raw, kpi = fx.raw_long(spark, sf), fx.kpi(spark, sf)
    return reports.station_list(
        marts.station_spatial(raw),
        fx.station_dim(spark, sf),
        marts.station_profile(kpi, *fx.PROFILE_PERIOD),
        marts.site_scores(kpi, *fx.PERIOD, divisor=10),
        year,
    )


# --- joins ------------------------------------------------------------------------------------


@query(
    "j1_match_station",
    sql(
        "flow",
        """select station, station_id, count(*) as n_rows, sum(boarding)::bigint as boarding
        from flow group by all""",
    ),
)
def _(spark, sf):
    flow = match_station(fx.raw_long(spark, sf), fx.name_map(spark, sf))
    return flow.groupBy("station", "station_id").agg(n_rows(), _sum("boarding"))


@query(
    "j2_join_directions",
    sql(
        "long",
        """
    select base_date, station, line, hour, on_cnt, off_cnt from
      (select base_date, station, line, hour, sum(boarding)::bigint as on_cnt from long
        where boarding > 0 group by all)
      join (select base_date, station, line, hour, sum(alighting)::bigint as off_cnt from long
        where alighting > 0 group by all) using (base_date, station, line, hour)""",
    ),
)
def _(spark, sf):
    keys = ["base_date", "station", "line", "hour"]
    long = fx.raw_long(spark, sf)
    on = long.where("boarding > 0").withColumnRenamed("boarding", "on_cnt")
    off = long.where("alighting > 0").withColumnRenamed("alighting", "off_cnt")
    return rs.join_directions(on, off, keys)


@query("j3_growth_trend", sql("growth", "select * from growth"))
def _(spark, sf):
    return marts.growth_trend(fx.daily(spark, sf), *fx.PERIOD)


@query("j3_growth_trend_join_form", sql("growth", "select * from growth"))
def _(spark, sf):
    return marts.growth_trend(fx.daily(spark, sf), *fx.PERIOD, form="join")


@query("j4_station_list", sql("stations", "select * from stations"))
def _(spark, sf):
    return _stations(spark, sf)


@query(
    "j5_profile_with_scores",
    sql(
        "profile scores",
        """select p.stn_name, p.area_type, s.base_ym, s.total_traffic_score, s.office_score,
        s.night_life_score, s.recommended_biz
        from profile p left join scores s on p.stn_name = s.stn_name and year(s.base_ym) = 2001""",
    ),
)
def _(spark, sf):
    kpi = fx.kpi(spark, sf)
    return reports.profile_with_scores(
        marts.station_profile(kpi, *fx.PROFILE_PERIOD),
        marts.site_scores(kpi, *fx.PERIOD, divisor=10),
        fx.YEAR,
    )


@query(
    "j6_pivot_and_volatility",
    sql(
        "daily",
        """
    select stn_name, v1999, v2000, round(volatility, 9) as volatility from
      (select stn_name, avg(total_flow) filter (year(base_date) = 1999) as v1999,
        avg(total_flow) filter (year(base_date) = 2000) as v2000 from daily
        where year(base_date) in (1999, 2000) group by all)
      join (select stn_name, stddev_samp(total_flow) / avg(total_flow) as volatility from daily group by all)
      using (stn_name)""",
    ),
)
def _(spark, sf):
    daily = fx.daily(spark, sf)
    spread = marts.volatility(daily).withColumn("volatility", F.round("volatility", 9))
    return marts.pivot_years(daily, fx.SHOCK).join(spread, "stn_name")


@query("j7_day_label", sql("lab", "select * from lab"))
def _(spark, sf):
    return with_day_label(fx.daily(spark, sf), fx.days(spark, sf))


@query(
    "u1_union_by_name",
    sql(
        "long",
        """select line, hour, sum(boarding)::bigint as boarding, sum(alighting)::bigint as alighting,
        count(*) as n_rows from long group by all""",
    ),
)
def _(spark, sf):
    long = fx.raw_long(spark, sf)
    on = long.where("boarding > 0").select("line", "hour", "boarding", F.lit(0).alias("alighting"))
    off = long.where("boarding = 0").select(F.lit(0).alias("boarding"), "alighting", "hour", "line")
    return on.unionByName(off).groupBy("line", "hour").agg(_sum("boarding"), _sum("alighting"), n_rows())


# --- scalar functions ---------------------------------------------------------------------


@query(
    "f1_station_name",
    sql(
        "long",
        """
    select station, concat(trim(replace(split_part(station, '(', 1), '역', '')), '역') as exact_name,
      concat(trim(regexp_replace(trim(split_part(station, '(', 1)), '역$', '')), '역') as suffix_name,
      trim(replace(split_part(station, '(', 1), '역', '')) as bare, count(*) as n_rows
    from long group by all""",
    ),
)
def _(spark, sf):
    s = F.col("station")
    return fx.raw_long(spark, sf).groupBy(
        "station",
        names.station_name(s).alias("exact_name"),
        names.station_name(s, "suffix").alias("suffix_name"),
        names.bare_name(s).alias("bare"),
    ).agg(n_rows())


@query(
    "f3_f4_line_number",
    sql(
        "long",
        """select line, cast(regexp_replace(line, '[^0-9]', '', 'g') as int) as line_num,
        trim(replace(line, '호선', '')) as line_text, cast(hour as int) as hour_num,
        coalesce(try_cast(regexp_replace(substr(line, 2), '[^0-9]', '', 'g') as int), 0) as no_digits,
        count(*) as n_rows from long group by all""",
    ),
)
def _(spark, sf):
    line = F.col("line")
    return fx.raw_long(spark, sf).groupBy(
        "line",
        numbers.digits_int(line).alias("line_num"),
        names.line_label(line).alias("line_text"),
        numbers.digits_int(F.col("hour")).alias("hour_num"),
        numbers.digits_int(F.substring(line, 2, 10)).alias("no_digits"),
    ).agg(n_rows())


@query(
    "f5_f6_trim_suffix",
    sql(
        "long",
        """
    select trim(station) as blanks, trim(station, chr(9) || chr(10) || ' ') as white,
      case when trim(station) like '%역' then trim(station) else concat(trim(station), '역') end as suffixed,
      count(*) as n_rows from long group by all""",
    ),
)
def _(spark, sf):
    s = F.col("station")
    padded = F.concat(F.lit("\t"), s, F.lit("\n "))
    return fx.raw_long(spark, sf).groupBy(
        F.trim(s).alias("blanks"),
        names.trim_space(padded).alias("white"),
        names.with_suffix(F.trim(s)).alias("suffixed"),
    ).agg(n_rows())


@query(
    "f7_f11_dates",
    sql(
        "daily",
        f"""
    select base_date, year(base_date)::int as yr, strftime(base_date, '%Y-%m') as month_text,
      cast(date_trunc('month', base_date) as date) as month_start,
      cast(base_date + interval 1 year as date) as year_later, (isodow(base_date) - 1)::int as weekday,
      {DEFAULT_LABEL} = '주말' as weekend, left(cast(base_date as varchar), 7) as prefix
    from daily group by base_date""",
    ),
)
def _(spark, sf):
    d = F.col("base_date")
    return fx.daily(spark, sf).select("base_date").distinct().select(
        "base_date",
        F.year(d).alias("yr"),
        dates.month_text(d).alias("month_text"),
        dates.month_start(d).alias("month_start"),
        dates.year_later(d).alias("year_later"),
        F.weekday(d).alias("weekday"),
        dates.is_weekend(d).alias("weekend"),
        F.left(d.cast("string"), F.lit(7)).alias("prefix"),
    )


@query(
    "f8_round_divide",
    sql(
        "daily",
        f"""select stn_name, line_num, {ratio('sum(on_cnt) * 100', 'sum(off_cnt)')} as percent,
        {ratio('sum(on_cnt) - sum(off_cnt)', 'count(*)', 0)} as mean_net,
        abs(sum(on_cnt) - sum(off_cnt))::bigint as gap from daily group by all""",
    ),
)
def _(spark, sf):
    return fx.daily(spark, sf).groupBy("stn_name", "line_num").agg(
        numbers.round_ratio(F.sum("on_cnt") * 100, F.sum("off_cnt"), 2).alias("percent"),
        numbers.round_ratio(F.sum("on_cnt") - F.sum("off_cnt"), F.count(F.lit(1)), 0).alias("mean_net"),
        F.abs(F.sum("on_cnt") - F.sum("off_cnt")).cast("bigint").alias("gap"),
    )


@query(
    "f9_case_between",
    sql(
        "kpi",
        """select case when hour between 7 and 9 then 'morning' when hour >= 19 then 'late' else 'other' end
        as part, sum(on_cnt)::bigint as on_cnt, count(*) as n_rows from kpi group by all""",
    ),
)
def _(spark, sf):
    h = F.col("hour")
    part = F.when(numbers.in_window(h, MORNING), "morning").when(h >= 19, "late").otherwise("other")
    return fx.kpi(spark, sf).groupBy(part.alias("part")).agg(_sum("on_cnt"), n_rows())


@query(
    "f10_byte_view",
    sql(
        "long",
        """select station, hex(encode(station)) as hex, octet_length(encode(station))::int as n_bytes,
        length(station)::int as n_chars from long group by station""",
    ),
)
def _(spark, sf):
    rows = fx.raw_long(spark, sf).select("station").distinct()
    return rows.select("station", names.byte_view(F.col("station")).alias("v")).select("station", "v.*")


@query(
    "f12_grouped_digits",
    sql(
        "spatial",
        """select stn_name, line_num, format('{:,}', abs(net_flow_cnt * 1000)) as net_text
        from spatial""",
    ),
)
def _(spark, sf):
    net = F.abs(F.col("net_flow_cnt") * 1000)
    return marts.station_spatial(fx.raw_long(spark, sf)).select(
        "stn_name", "line_num", numbers.grouped_digits(net).alias("net_text")
    )
