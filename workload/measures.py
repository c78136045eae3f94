"""Aggregates, ordered results, metrics, reports and checks (A, W, O, M, C, Q)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gateflow.config import SLOTS
from gateflow.functions.headers import quoted
from gateflow.operators import ordered, quality
from gateflow.operators.filters import between_dates, order_by_locale
from gateflow.operators.reshape import two_hour_bins
from gateflow.plans import marts, metrics, refresh, reports
from gateflow.plans.layers import raw_from_files
from gateflow.sinks.tables import replace_partitions, scratch_path, write_table
from workload import fixtures as fx
from workload.oracle import GOT_CHECK, GOT_TOTAL, grade, ratio, sql
from workload.registry import query
from workload.shapes import _stations


def n_rows():
    return F.count(F.lit(1)).alias("n_rows")


def _flow(spark, sf):
    return fx.flow(spark, sf)


def _profile(spark, sf):
    return marts.station_profile(fx.kpi(spark, sf), *fx.PROFILE_PERIOD)


def _scores(spark, sf):
    return marts.site_scores(fx.kpi(spark, sf), *fx.PERIOD, divisor=10)


# --- aggregates -----------------------------------------------------------------------


@query("a1_station_spatial", sql("spatial", "select * from spatial"))
def _(spark, sf):
    return marts.station_spatial(fx.raw_long(spark, sf))


@query("a2_station_hour_totals", sql("mart", "select * from mart"))
def _(spark, sf):
    return marts.station_hour_totals(_flow(spark, sf))


@query("a3_daily_trend", sql("lab", "select * from lab"))
def _(spark, sf):
    return marts.daily_trend(fx.kpi(spark, sf), fx.days(spark, sf))


@query(
    "a4_monthly_total",
    sql(
        "daily",
        """select cast(date_trunc('month', base_date) as date) as base_ym, stn_name,
        sum(total_flow)::bigint as monthly_total_passenger from daily group by all""",
    ),
)
def _(spark, sf):
    return marts.monthly_total(fx.daily(spark, sf))


@query("a5_monthly_site", sql("site", "select * from site"))
def _(spark, sf):
    return marts.monthly_site(fx.kpi(spark, sf), *fx.PERIOD)


@query("a6_profile_base", sql("pbase", "select * from pbase"))
def _(spark, sf):
    return marts.profile_base(fx.kpi(spark, sf), *fx.PROFILE_PERIOD)


_PATTERN = f"""
    select stn_name, line_num, hour, {ratio('sum(day_on)', 'count(*)', 0)}::bigint as avg_on,
      {ratio('sum(day_off)', 'count(*)', 0)}::bigint as avg_off
    from (select stn_name, line_num, hour, base_date, sum(on_cnt) as day_on, sum(off_cnt) as day_off
      from kpi where strftime(base_date, '%Y-%m') = '{fx.MONTH}' group by all)
    group by all"""


@query("a7_hourly_pattern", sql("kpi", _PATTERN))
def _(spark, sf):
    return reports.hourly_pattern(fx.kpi(spark, sf), fx.MONTH)


@query(
    "a8_peak_boarding",
    sql(
        "mart",
        """select station, sum(case when hour between '07' and '09' then boarding else 0 end)::bigint as morning_peak,
        sum(case when hour between '18' and '20' then boarding else 0 end)::bigint as evening_peak
        from mart group by station""",
    ),
)
def _(spark, sf):
    return marts.peak_boarding(marts.station_hour_totals(_flow(spark, sf)))


@query(
    "a9_year_averages",
    sql(
        "metrics",
        "select stn_name, line_num, weekday_avg, diff_amount, v1997, v1998, v1999, v2000, v2001 from metrics",
    ),
)
def _(spark, sf):
    return metrics.year_averages(fx.labelled(spark, sf), fx.YEAR, fx.YEARS)


@query(
    "a10_volatility",
    sql(
        "daily",
        """select stn_name, round(stddev_pop(total_flow) / avg(total_flow), 3) as population,
        round(stddev_samp(total_flow) / avg(total_flow), 9) as sample from daily group by all""",
    ),
)
def _(spark, sf):
    flow = F.col("total_flow")
    return fx.daily(spark, sf).groupBy("stn_name").agg(
        F.round(marts.variation(flow, "pop"), 3).alias("population"),
        F.round(marts.variation(flow, "samp"), 9).alias("sample"),
    )


@query(
    "a11_pivot_years",
    sql(
        "daily",
        """select stn_name, avg(total_flow) filter (year(base_date) = 1999) as v1999,
        avg(total_flow) filter (year(base_date) = 2000) as v2000 from daily
        where year(base_date) in (1999, 2000) group by all""",
    ),
)
def _(spark, sf):
    return marts.pivot_years(fx.daily(spark, sf), fx.SHOCK)


@query("a12_available_months", sql("growth", "select distinct strftime(base_ym, '%Y-%m') as base_ym from growth"))
def _(spark, sf):
    return marts.available_months(marts.growth_trend(fx.daily(spark, sf), *fx.PERIOD))


@query("a13_station_lines", sql("kpi", "select distinct stn_name, line_num from kpi"))
def _(spark, sf):
    return fx.kpi(spark, sf).select("stn_name", "line_num").distinct()


@query(
    "a15_max_per_group",
    sql("dim", """select lower(station_clean) as name, max(lat) as lat, max(lng) as lng, max(station_no) as station_no
      from dim group by 1"""),
)
def _(spark, sf):
    dim = fx.station_dim(spark, sf)
    return dim.groupBy(F.lower("station_clean").alias("name")).agg(
        *[F.max(c).alias(c) for c in ("lat", "lng", "station_no")]
    )


@query("a16_mean_score", sql("stations", "select display_name, line_num, avg_score from stations"))
def _(spark, sf):
    return _stations(spark, sf).select("display_name", "line_num", "avg_score")


@query(
    "a17_stations_by_line",
    sql(
        "stations",
        """
    select line_num, bucket, count(*) as n_stations,
      string_agg(display_name || ':' || location_grade, '|' order by display_name) as names
    from (select *, (('0x' || substr(md5(display_name), 1, 8))::bigint
        % 2)::int as bucket from stations)
    group by all""",
    ),
)
def _(spark, sf):
    lines = ordered.stations_by_line(_stations(spark, sf), 2)
    texts = F.transform("stations", lambda s: F.concat(s.display_name, F.lit(":"), s.location_grade))
    return lines.select(
        "line_num",
        "bucket",
        F.size("stations").cast("bigint").alias("n_stations"),
        F.array_join(texts, "|").alias("names"),
    )


_LABELS = ", ".join(f"'{x}'" for x in ("06시 이전", *(f"{h:02d}-{h + 2:02d}시" for h in range(6, 24, 2)), "24시 이후"))


@query(
    "a18_two_hour_bins",
    sql(
        "kpi",
        f"""
    select k.stn_name, bin::int as bin, ([{_LABELS}])[bin + 1] as bin_label,
      coalesce(sum(on_cnt) filter (slots >= 20 and bin = (case hour when 5 then 0 when 24 then 10
        else (hour - 6) // 2 + 1 end)), 0)::bigint as value
    from kpi k join (select stn_name, count(distinct hour) as slots from kpi group by 1) s using (stn_name),
      range(11) t(bin)
    group by all""",
    ),
)
def _(spark, sf):
    return two_hour_bins(fx.kpi(spark, sf), ["stn_name"], "hour", "on_cnt").withColumnRenamed(
        "on_cnt", "value"
    )


# --- ordered results --------------------------------------------------------------------


@query(
    "w1_first_month",
    sql(
        "firstm",
        """select stn_name, area_type, base_ym, total_traffic_score, office_score, night_life_score,
        recommended_biz from firstm""",
    ),
)
def _(spark, sf):
    return reports.first_month(_profile(spark, sf), _scores(spark, sf), fx.YEAR)


_HEAT = f"""
    select *, greatest(0.1::double, count::double / greatest(max(count) over (partition by stn_name), 1)) as intensity,
      (isodow(min(base_date) over (partition by stn_name)) - 1)::int as first_offset
    from (select stn_name, base_date, sum(total_flow)::bigint as count, max(day_label) as day_label from lab
      where strftime(base_date, '%Y-%m') = '{fx.MONTH}' group by all)"""


@query("w2_w3_c2_calendar_heatmap", sql("lab", _HEAT))
def _(spark, sf):
    daily = marts.daily_trend(fx.kpi(spark, sf), fx.days(spark, sf))
    return reports.calendar_heatmap(daily, fx.MONTH)


@query(
    "o1_top_net_flow",
    sql("mart", "select * from mart order by net_flow desc, station_id, station, line, hour limit 20"),
)
def _(spark, sf):
    return ordered.top_net_flow(marts.station_hour_totals(_flow(spark, sf)), 20)


@query("o2_o3_ordered_months", sql("monthly", "select base_ym, stn_name, t as total from monthly"))
def _(spark, sf):
    months = marts.monthly_total(between_dates(fx.daily(spark, sf), "base_date", *fx.PERIOD))
    return months.select(
        "base_ym", "stn_name", F.col("monthly_total_passenger").alias("total")
    ).orderBy("stn_name", F.col("base_ym").desc())


@query("o4_locale_order", sql("long", "select distinct station from long"))
def _(spark, sf):
    return order_by_locale(fx.raw_long(spark, sf).select("station").distinct(), "station")


# --- metrics ------------------------------------------------------------------------------


@query(
    "m1_net_flow",
    sql(
        "kpi",
        """select stn_name, hour, (sum(on_cnt) - sum(off_cnt))::bigint as net_flow,
        (sum(on_cnt) + sum(off_cnt))::bigint as total_flow from kpi group by all""",
    ),
)
def _(spark, sf):
    return fx.kpi(spark, sf).groupBy("stn_name", "hour").agg(
        (F.sum("on_cnt") - F.sum("off_cnt")).cast("bigint").alias("net_flow"),
        (F.sum("on_cnt") + F.sum("off_cnt")).cast("bigint").alias("total_flow"),
    )


@query("m2_m3_m4_station_profile", sql("profile", "select * from profile"))
def _(spark, sf):
    return _profile(spark, sf)


@query("m5_site_scores", sql("scores", "select * from scores"))
def _(spark, sf):
    return _scores(spark, sf)


@query("m6_m7_m8_station_metrics", sql("metrics", "select * from metrics"))
def _(spark, sf):
    return metrics.station_metrics(fx.labelled(spark, sf), fx.YEAR, fx.YEARS)


@query(
    "m9_shock_mart",
    sql(
        "daily",
        """
    select stn_name, v1999, v2000, round((v2000 - v1999) / v1999, 9) as shock_index,
      round(volatility, 9) as volatility from (
      select stn_name, avg(total_flow) filter (year(base_date) = 1999) as v1999,
        avg(total_flow) filter (year(base_date) = 2000) as v2000,
        stddev_samp(total_flow) / avg(total_flow) as volatility
      from daily group by all) where v1999 is not null or v2000 is not null""",
    ),
)
def _(spark, sf):
    mart = marts.shock_mart(fx.daily(spark, sf), *fx.SHOCK)
    return mart.withColumns({c: F.round(c, 9) for c in ("shock_index", "volatility")})


@query(
    "m10_m11_grade",
    sql(
        "scored",
        f"""select stn_name, {grade('score')} as location_grade, round(score * 4.4::double, 1) as analysis_score
        from scored""",
    ),
)
def _(spark, sf):
    first = reports.first_month(_profile(spark, sf), _scores(spark, sf), fx.YEAR)
    points = [F.coalesce(c, F.lit(0.0)) for c in reports.SCORES]
    score = (points[0] + points[1] + points[2]) / 3
    return first.select(
        "stn_name",
        metrics.grade(score).alias("location_grade"),
        metrics.analysis_score(score).alias("analysis_score"),
    )


_RECOVERY = (
    "cast(format('{:.2f}', coalesce(v2000, 0) / (case when coalesce(v1999, 0) = 0 then 1 else v1999 end)) as double)"
)


@query(
    "m12_m18_recovery",
    sql(
        "metrics",
        f"""
    select stn_name, line_num, recovery_rate, round(recovery_rate * 100, 1) as recovery_percent,
      least(round(recovery_rate * 100, 1), 100.0::double) as recovery_capped, recovery_rate > 0.8 as recovery_good,
      case when coalesce(growth_rate, 0) > 0 then '▲' else '▼' end as growth_mark
    from (select *, {_RECOVERY} as recovery_rate from metrics)""",
    ),
)
def _(spark, sf):
    rows = metrics.station_metrics(fx.labelled(spark, sf), fx.YEAR, fx.YEARS)
    base, shock = (F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("v1999", "v2000"))
    rate = F.col("recovery_rate")
    return rows.withColumn("recovery_rate", metrics.recovery(base, shock)).select(
        "stn_name",
        "line_num",
        "recovery_rate",
        *metrics.recovery_view(rate),
        metrics.growth_mark(F.coalesce("growth_rate", F.lit(0.0))).alias("growth_mark"),
    )


@query(
    "m13_normalise_year",
    sql("metrics", "select stn_name, line_num, floor(v1998 * 0.5)::bigint as v1998, v1999 from metrics"),
)
def _(spark, sf):
    rows = metrics.station_metrics(fx.labelled(spark, sf), fx.YEAR, fx.YEARS)
    return metrics.normalise_year(rows.select("stn_name", "line_num", "v1998", "v1999"), {1998: 0.5})


_CATEGORY = "coalesce(recommended_biz, '데이터 없음')"
_REASON = """case when recommended_biz is null then '추천 업종 정보를 불러올 수 없습니다.'
  when coalesce(office_score, 0) > coalesce(night_life_score, 0) then '오피스 상권 중심 전략 추천'
  else '저녁/주말 상권 특화 전략 추천' end"""


@query(
    "m14_recommendations",
    sql("firstm", f"select stn_name, {_CATEGORY} as category, {_REASON} as reason from firstm"),
)
def _(spark, sf):
    first = reports.first_month(_profile(spark, sf), _scores(spark, sf), fx.YEAR)
    office, night = (F.coalesce(c, F.lit(0.0)) for c in reports.SCORES[1:])
    items = metrics.recommendations(F.col("recommended_biz"), office, night)
    return first.select("stn_name", F.explode(items).alias("r")).select(
        "stn_name", "r.category", F.col("r.desc").alias("reason")
    )


_INSIGHT = """concat(stn_name, '은 2001년 기준 전년 대비 유동인구가 약 ',
  format('{:,}', abs(coalesce(diff_amount, 0))::bigint), '명 ',
  case when coalesce(diff_amount, 0) < 0 then '감소' else '증가' end, '하였습니다.')"""
_STRATEGY = """case when market_maturity = '정체/쇠퇴기' then '기존 고객 유지 및 효율화 전략'
  else '적극적인 마케팅 권장' end"""


@query(
    "m15_m17_texts",
    sql(
        "metrics",
        f"select stn_name, line_num, {_INSIGHT} as insight_text, {_STRATEGY} as strategy from metrics",
    ),
)
def _(spark, sf):
    rows = metrics.station_metrics(fx.labelled(spark, sf), fx.YEAR, fx.YEARS)
    diff = F.coalesce(F.col("diff_amount").cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select(
        "stn_name",
        "line_num",
        metrics.insight(F.col("stn_name"), fx.YEAR, diff).alias("insight_text"),
        metrics.strategy(F.col("market_maturity")).alias("strategy"),
    )


def _flow_type(place: str) -> str:
    texts = {
        "type": ("유입형 (상업/여가)", "유출형 (주거 중심)", "복합형"),
        "desc": (
            "퇴근 후 소비가 집중되는 핵심 상업지입니다.",
            "아침 출근 인구가 많은 주거 밀집 지역입니다.",
            "주거와 상업 기능이 혼재된 지역입니다.",
        ),
        "list": ("음식점|카페|주점", "편의점|세탁소|베이커리", "브런치 카페|피트니스|드럭스토어"),
    }[place]
    return (
        f"case when evening_off > morning_on and net_flow > 0 then '{texts[0]}' "
        f"when morning_on > evening_off then '{texts[1]}' else '{texts[2]}' end"
    )


@query(
    "m16_flow_type",
    sql(
        "kpi",
        f"""
    select stn_name, morning_on, evening_off, net_flow, {_flow_type('type')} as flow_type,
      {_flow_type('desc')} as description, {_flow_type('list')} as recommend from (
      select stn_name, sum(case when hour between 7 and 9 then on_cnt else 0 end)::bigint as morning_on,
        sum(case when hour between 18 and 20 then off_cnt * 3 else 0 end)::bigint as evening_off,
        (sum(on_cnt) - sum(off_cnt * 3))::bigint as net_flow from kpi group by all)""",
    ),
)
def _(spark, sf):
    kpi = fx.kpi(spark, sf).withColumn("off_cnt", F.col("off_cnt") * 3)  # so every arm is reached
    return metrics.flow_type(kpi).withColumn("recommend", F.array_join("recommend", "|"))


# --- reports ------------------------------------------------------------------------------


_REPORT = f"""
    select m.stn_name as station_name, line_num, coalesce(weekday_avg, 0)::bigint as weekday_avg,
      coalesce(growth_rate, 0) as growth_rate, coalesce(diff_amount, 0)::bigint as diff_amount,
      coalesce(volatility, 0) as volatility, market_maturity, {grade('coalesce(score, 0)')} as location_grade,
      round(coalesce(score, 0) * 4.4::double, 1) as analysis_score, coalesce(area_type, '복합 상권') as commercial_type,
      {_INSIGHT.replace('stn_name', 'm.stn_name')} as insight_text,
      {', '.join(f"{'floor(coalesce(v1998, 0) * 0.5)' if y == 1998 else f'coalesce(v{y}, 0)'}::bigint as v{y}" for y in fx.YEARS)},
      recovery_rate, {_CATEGORY} as category, {_REASON} as reason, {_STRATEGY} as strategy,
      round(recovery_rate * 100, 1) as recovery_percent,
      least(round(recovery_rate * 100, 1), 100.0::double) as recovery_capped, recovery_rate > 0.8 as recovery_good,
      case when coalesce(growth_rate, 0) > 0 then '▲' else '▼' end as growth_mark
    from (select *, {_RECOVERY} as recovery_rate from metrics) m left join scored f on m.stn_name = f.stn_name"""


def _report_inputs(spark, sf):
    return fx.labelled(spark, sf), _profile(spark, sf), _scores(spark, sf)


_OPTIONS = {
    "years": fx.YEARS,
    "recovery_years": fx.SHOCK,
    "year_weights": {1998: 0.5},
    "t": fx.LIMITS,
}


@query("c1_station_report", sql("metrics scored", _REPORT))
def _(spark, sf):
    report = reports.station_report(*_report_inputs(spark, sf), fx.YEAR, **_OPTIONS)
    first = F.col("recommendations")[0]
    return report.select(
        *[c for c in report.columns if c != "recommendations"],
        first["category"].alias("category"),
        first["desc"].alias("reason"),
    )


@query(
    "c3_station_list",
    sql("stations", "select * from stations"),
)
def _(spark, sf):
    return _stations(spark, sf)


PAIRS = [("Supplier#000000002", 2), ("Supplier#000000003역", 1), ("Supplier#000000005", 7)]


@query(
    "c4_compare",
    sql(
        "metrics scored",
        f"""select station_name, line_num, location_grade, recovery_rate, recovery_percent,
        v1997, v1998, v1999, v2000, v2001 from ({_REPORT})
        where (station_name, line_num) in (('Supplier#000000002역', 2), ('Supplier#000000003역', 1),
          ('Supplier#000000005역', 7))""",
    ),
)
def _(spark, sf):
    return reports.compare(*_report_inputs(spark, sf), PAIRS, fx.YEAR, **_OPTIONS)


@query(
    "c5_hourly_pattern",
    sql("kpi", _PATTERN),
)
def _(spark, sf):
    return reports.hourly_pattern(fx.kpi(spark, sf), fx.MONTH)


@query(
    "c6_daily_flow",
    sql(
        "lab",
        """select base_date, stn_name, sum(total_flow)::bigint as total_flow, max(day_label) as day_label
        from lab group by all""",
    ),
)
def _(spark, sf):
    return reports.daily_flow(fx.labelled_by_month(spark, sf), ["part_month"])


@query(
    "c6_station_history",
    sql(
        "lab",
        """select stn_name, year(base_date)::int as yr, base_date, sum(total_flow)::bigint as total_flow,
        max(day_label) as day_label from lab group by all""",
    ),
)
def _(spark, sf):
    return reports.station_history(fx.labelled_by_month(spark, sf), also=["part_month"], tasks=fx.tasks(spark, sf))


_MARTS = {
    "hourly_kpi": ("kpi", "sum(on_cnt)"),
    "daily_trend": ("lab", "sum(total_flow)"),
    "station_spatial": ("spatial", "sum(net_flow_cnt)"),
    "station_hours": ("mart", "sum(boarding)"),
    "station_profile": ("profile", "sum(total_cnt)"),
    "site_scores": ("scores", "sum(round(office_score * 100))"),
    "growth_trend": ("growth", "sum(round(recovery_rate * 100))"),
}


def built(spark, sf):
    """All marts, stored below a new path."""
    return marts.build_marts(
        fx.raw_long(spark, sf),
        fx.station_dim(spark, sf),
        fx.days(spark, sf),
        scratch_path(spark, "marts"),
        fx.PERIOD,
        fx.PROFILE_PERIOD,
        fx.SHOCK,
        divisor=10,
    )


def on_stored(spark, sf, tables):
    """Reports on stored marts, by name; the bench times them."""
    scored = tables["daily_trend"], tables["station_profile"], tables["site_scores"]
    return {
        "c1_station_report": reports.station_report(*scored, fx.YEAR, **_OPTIONS),
        "c4_compare": reports.compare(*scored, PAIRS, fx.YEAR, **_OPTIONS),
        "j4_station_list": reports.station_list(
            tables["station_spatial"], fx.station_dim(spark, sf), *scored[1:], fx.YEAR
        ),
        "c6_station_history": reports.station_history(tables["daily_trend"]),
        "m6_m7_m8_station_metrics": metrics.station_metrics(tables["daily_trend"], fx.YEAR, fx.YEARS),
        "a7_hourly_pattern": reports.hourly_pattern(tables["hourly_kpi"], fx.MONTH),
    }


@query(
    "c9_build_marts",
    sql(
        "kpi lab spatial mart profile scores growth",
        " union all ".join(
            f"select '{m}' as mart, count(*) as n_rows, {check}::bigint as checksum from {cte}"
            for m, (cte, check) in _MARTS.items()
        )
        + " union all select 'shock', count(distinct stn_name), sum(total_flow)::bigint from lab"
        " where year(base_date) in (1999, 2000)",
    ),
)
def _(spark, sf):
    tables = built(spark, sf)
    out = None
    for name, (_, check) in _MARTS.items():
        one = tables[name].selectExpr(
            f"'{name}' as mart", "1 as one", f"{check.replace('sum(', '(', 1)} as v"
        )
        one = one.groupBy("mart").agg(n_rows(), F.sum("v").cast("bigint").alias("checksum"))
        out = one if out is None else out.unionByName(one)
    flow = tables["daily_trend"].where("year(base_date) in (1999, 2000)")
    shock = tables["shock"].select("stn_name").join(flow, "stn_name").groupBy(
        F.lit("shock").alias("mart")
    ).agg(
        F.countDistinct("stn_name").alias("n_rows"), F.sum("total_flow").cast("bigint").alias("checksum")
    )
    return out.unionByName(shock)


_CHECKED = " union all ".join(
    f"select '{m}' as mart, count(*) as n_rows, {check}::bigint as checksum from {cte}" for m, (cte, check) in _MARTS.items()
)


@query("c9_refresh_months", sql("kpi lab spatial mart profile scores growth", _CHECKED))
def _(spark, sf):
    """Marts built while two months were delivered in part, then those months again."""
    late = F.trunc("base_date", "MM").isin(date(1999, 3, 1), date(2000, 2, 1))
    raw = fx.raw_long(spark, sf)
    kept = refresh.Marts(spark, scratch_path(spark, "refreshed"), fx.PERIOD, fx.PROFILE_PERIOD, fx.SHOCK, divisor=10)
    kept.build(raw.where(~late | (F.col("line") == "1호선")), fx.station_dim(spark, sf), fx.days(spark, sf))
    tables, out = kept.refresh(raw.where(late), fx.station_dim(spark, sf)), None
    for name, (_, check) in _MARTS.items():
        one = tables[name].selectExpr(f"'{name}' as mart", f"{check.replace('sum(', '(', 1)} as v")
        one = one.groupBy("mart").agg(n_rows(), F.sum("v").cast("bigint").alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out


def _flow_sums(spark, sf):
    """Sums per month, stored; the last year is merged into them."""
    daily = fx.labelled_by_month(spark, sf)
    path = scratch_path(spark, "flow-sums")
    write_table(refresh.flow_sums(daily.where("year(base_date) < 2001")), path, partition_by=["part_month"])
    return replace_partitions(refresh.flow_sums(daily.where("year(base_date) >= 2001")), path, ["part_month"])


@query("m6_from_monthly_sums", sql("metrics", "select * from metrics"))
def _(spark, sf):
    return refresh.station_metrics(_flow_sums(spark, sf), fx.YEAR, fx.YEARS, fx.LIMITS, fx.tasks(spark, sf))


@query(
    "c9_build_from_files",
    sql(
        "got",
        f"""
    select year(base_date)::int as yr, line, count(*) * 20 as n_rows, count(*) * 20 as n_int,
      sum(case when direction = '승차' then total else 0 end)::bigint as on_cnt,
      sum(case when direction = '하차' then total else 0 end)::bigint as off_cnt,
      sum(case when direction = '승차' then by_slot else 0 end)::bigint as on_by_hour,
      sum(total)::bigint as total_flow
    from (select base_date, line, direction, {GOT_TOTAL} as total, {GOT_CHECK} as by_slot from got where not bad_date)
    group by all""",
    ),
)
def _(spark, sf):
    """Files, raw, intermediate layer, marts: each from the stored one before."""
    paths = [fx.deliveries(spark, sf)[k] for k in "abc"]
    root = scratch_path(spark, "layers")
    tables = marts.build_marts(
        raw_from_files(spark, paths, columns={p: "구분" for p in paths}, by_month=True),
        fx.station_dim(spark, sf),
        fx.days(spark, sf),
        root,
        fx.PERIOD,
        fx.PROFILE_PERIOD,
        fx.SHOCK,
        divisor=10,
        grown=len(SLOTS),
    )
    keys = [F.year("base_date").alias("yr"), F.col("line_num").cast("string").alias("line")]
    hourly = tables["hourly_kpi"].groupBy(*keys).agg(
        n_rows(),
        F.sum("on_cnt").alias("on_cnt"),
        F.sum("off_cnt").alias("off_cnt"),
        F.sum(F.col("hour") * F.col("on_cnt")).cast("bigint").alias("on_by_hour"),
    )
    daily = tables["daily_trend"].groupBy(*keys).agg(F.sum("total_flow").cast("bigint").alias("total_flow"))
    line = F.regexp_replace("line", "[^0-9]", "").alias("line")
    typed = spark.read.parquet(f"{root}/int_flow").groupBy(F.year("base_date").alias("yr"), "line").agg(n_rows())
    typed = typed.groupBy("yr", line).agg(F.sum("n_rows").alias("n_int"))
    return hourly.join(daily, ["yr", "line"]).join(typed, ["yr", "line"])


# --- checks -------------------------------------------------------------------------------


@query(
    "q1_fail_rate",
    sql(
        "flow",
        f"""select count(*) as n_rows, count(*) filter (station_id is null) as n_unmatched,
        {ratio('count(*) filter (station_id is null) * 100', 'count(*)')} as fail_rate from flow""",
    ),
)
def _(spark, sf):
    return quality.fail_rate(_flow(spark, sf))


@query(
    "q2_q3_reconcile",
    sql(
        "long mart",
        """
    select *, n_raw - n_mart as n_diff, boarding_raw - boarding_mart as boarding_diff,
      alighting_raw - alighting_mart as alighting_diff from
      (select count(*) as n_raw, sum(boarding)::bigint as boarding_raw, sum(alighting)::bigint as alighting_raw from long),
      (select count(*) as n_mart, sum(boarding)::bigint as boarding_mart, sum(alighting)::bigint as alighting_mart from mart)""",
    ),
)
def _(spark, sf):
    layers = {
        "raw": fx.raw_long(spark, sf),
        "mart": marts.station_hour_totals(_flow(spark, sf)),
    }
    return quality.reconcile(layers, ["boarding", "alighting"])


@query(
    "q4_duplicate_keys",
    sql(
        "long",
        """select base_date, station, line, hour, count(*) as n_rows from long group by all having count(*) > 1""",
    ),
)
def _(spark, sf):
    return quality.duplicate_keys(fx.raw_long(spark, sf), ["base_date", "station", "line", "hour"])


_GAP_ROWS = "not (year(base_date) = 1999 and month(base_date) between 3 and 5) and base_date <> date '2000-02-29'"


@query(
    "q5_coverage_gaps",
    sql(
        "daily",
        f"""
    select 'day' as unit, cast(d as date) as period from (
      select unnest(generate_series(min(base_date), max(base_date), interval 1 day)) as d from daily where {_GAP_ROWS})
      where d not in (select base_date from daily where {_GAP_ROWS})
    union all
    select 'month', cast(d as date) from (
      select unnest(generate_series(date_trunc('month', min(base_date)), max(base_date), interval 1 month)) as d
      from daily where {_GAP_ROWS})
      where d not in (select date_trunc('month', base_date) from daily where {_GAP_ROWS})""",
    ),
)
def _(spark, sf):
    rows = fx.daily(spark, sf).where(_GAP_ROWS)
    gaps = [
        quality.coverage_gaps(rows, unit=u).select(F.lit(u).alias("unit"), "period")
        for u in ("day", "month")
    ]
    return gaps[0].unionByName(gaps[1])


@query(
    "q7_suspicious_names",
    sql(
        "long",
        r"""select station as name, count(*) as n_rows, hex(encode(station)) as hex,
        octet_length(encode(station))::int as n_bytes, length(station)::int as n_chars
        from long where regexp_matches(station, '[^\p{L}\p{N}() .]') group by station""",
    ),
)
def _(spark, sf):
    found = quality.suspicious_names(fx.raw_long(spark, sf), "station")
    return found.select("name", "n_rows", "bytes.*")


@query(
    "q8_level_shift",
    sql(
        "daily",
        f"""
    select yr, n_rows, total, {ratio('total', 'n_rows')} as average, round(level, 4) as level_ratio,
      round(rows, 4) as row_ratio,
      case when rows between 0.9 and 1.1 and level between 1.5 and 2.5 then 'up'
        when rows between 0.9 and 1.1 and level between 0.375 and 0.625 then 'down' end as shift
    from (select *, (total::double * lag(n_rows) over (order by yr)) / (lag(total) over (order by yr)::double * n_rows) as level,
        n_rows::double / lag(n_rows) over (order by yr) as rows
      from (select year(base_date)::int as yr, count(*) as n_rows,
        sum(case when year(base_date) >= 1998 then 2 else 1 end * (on_cnt + off_cnt))::bigint as total
        from daily group by all))""",
    ),
)
def _(spark, sf):
    doubled = F.when(F.year("base_date") >= 1998, 2).otherwise(1)
    daily = fx.daily(spark, sf).withColumns(
        {c: F.col(c) * doubled for c in ("on_cnt", "off_cnt")}
    )
    return quality.level_shift(daily)
