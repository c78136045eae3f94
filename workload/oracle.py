"""Building blocks of the DuckDB texts: the fixtures again, as named subqueries."""

from __future__ import annotations

from gateflow.config import HOURS
from workload.fixtures import BAD_COUNT, CSV_FACTOR, HOLIDAYS, PERIOD, PROFILE_PERIOD, SUFFIXED

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: str, text: str) -> None:
    _CTES[name] = (tuple(needs.split()), text)


def sql(needs: str, text: str) -> str:
    """Text preceded by the subqueries it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in _CTES[name][0]:
            add(n)
        order.append(name)

    for n in needs.split():
        add(n)
    if not order:
        return text.strip()
    blocks = ",\n".join(f"{n} as ({_CTES[n][1].strip()})" for n in order)
    return f"with {blocks}\n{text.strip()}"


def ratio(num: str, den: str, digits: int = 2) -> str:
    """num / den half away from zero, in whole numbers; den is never negative."""
    n, d = f"({num})::hugeint", f"({den})::hugeint"
    whole = f"(abs({n}) * {2 * 10**digits} + {d}) // (2 * {d})"
    return (
        f"(case when ({den}) is null or ({den}) = 0 then null "
        f"else ((case when ({num}) < 0 then -1 else 1 end) * ({whole}))::double / {10**digits}.0::double end)"
    )


define(
    "st",
    "",
    """
    select s_suppkey, concat(' ', s_name, case when s_suppkey % 2 = 0 then '역' else '' end,
      case when s_suppkey % 3 = 0 then concat('(', n_name, ')') else '' end, ' ') as station
    from supplier join nation on s_nationkey = n_nationkey""",
)
define(
    "long",
    "st",
    """
    select cast(l_shipdate as date) as base_date,
      lpad(cast(5 + case l_suppkey % 3 when 0 then l_orderkey % 10
        when 1 then l_orderkey % 20 else l_orderkey % 17 end as varchar), 2, '0') as hour,
      station, concat(cast(l_linenumber as varchar), '호선') as line,
      case when l_returnflag <> 'R' then cast(l_quantity as bigint) else 0::bigint end as boarding,
      case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0::bigint end as alighting,
      lpad(cast(l_suppkey as varchar), 4, '0') as station_no
    from lineitem join st on l_suppkey = s_suppkey""",
)
_peaks = ",\n".join(
    f"case when hour between {a} and {b} then {c}_cnt else 0 end as {name}_{c}"
    for name, a, b in (("peak_morning", 7, 9), ("peak_lunch", 11, 13), ("peak_evening", 19, 23))
    for c in ("on", "off")
)
define(
    "kpi",
    "long",
    f"""
    select *, {_peaks} from (
      select base_date, concat(trim(replace(split_part(station, '(', 1), '역', '')), '역') as stn_name,
        cast(replace(line, '호선', '') as int) as line_num, cast(hour as int) as hour,
        boarding as on_cnt, alighting as off_cnt from long)""",
)
define(
    "daily",
    "kpi",
    """
    select base_date, stn_name, line_num, sum(on_cnt)::bigint as on_cnt, sum(off_cnt)::bigint as off_cnt,
      sum(on_cnt + off_cnt)::bigint as total_flow from kpi group by all""",
)
_names = " ".join(
    f"when month(l_shipdate) = {m} and day(l_shipdate) = {d} then '{n}'" for (m, d), n in HOLIDAYS.items()
)
define(
    "hol",
    "",
    f"""
    select * from (select distinct cast(l_shipdate as date) as base_date,
      case {_names} end as holiday_name from lineitem) where holiday_name is not null""",
)
DEFAULT_LABEL = "case when isodow(base_date) >= 6 then '주말' else '평일' end"
define(
    "cal",
    "hol",
    f"""
    select base_date, coalesce(holiday_name, {DEFAULT_LABEL}) as day_label from (
      select cast(unnest(generate_series(date '{PERIOD[0]}', date '{PERIOD[1]}', interval 1 day)) as date)
        as base_date) left join hol using (base_date)""",
)
define(
    "lab",
    "daily cal",
    f"""
    select daily.*, coalesce(day_label, {DEFAULT_LABEL}) as day_label
    from daily left join cal using (base_date)""",
)
define(
    "monthly",
    "daily",
    f"""
    select cast(date_trunc('month', base_date) as date) as base_ym, stn_name,
      sum(on_cnt + off_cnt)::bigint as t from daily
    where base_date between date '{PERIOD[0]}' and date '{PERIOD[1]}' group by all""",
)
define(
    "growth",
    "monthly",
    f"""
    select c.base_ym, c.stn_name, c.t as monthly_total_passenger, p.t as prev_year_passenger,
      {ratio('c.t * 100', 'p.t')} as recovery_rate
    from monthly c left join monthly p
      on c.stn_name = p.stn_name and c.base_ym = p.base_ym + interval 1 year""",
)
define(
    "pbase",
    "kpi",
    f"""
    select stn_name, sum(on_cnt + off_cnt)::bigint as total,
      sum(case when hour between 7 and 9 then on_cnt + off_cnt else 0 end)::bigint as morning,
      sum(case when hour between 11 and 13 then on_cnt + off_cnt else 0 end)::bigint as lunch,
      sum(case when hour between 18 and 21 then on_cnt + off_cnt else 0 end)::bigint as evening,
      sum(pm)::bigint as morning_off, sum(pe)::bigint as evening_off
    from (select stn_name, hour, sum(on_cnt) as on_cnt, sum(off_cnt) as off_cnt,
        sum(peak_morning_off) as pm, sum(peak_evening_off) as pe from kpi
      where base_date between date '{PROFILE_PERIOD[0]}' and date '{PROFILE_PERIOD[1]}'
        and (on_cnt > 0 or off_cnt > 0) group by all)
    group by stn_name having sum(on_cnt + off_cnt) > 0""",
)


def _area(office: str, commercial: str, mixed: str) -> str:
    return (
        f"case when 10 * morning_off > 13 * evening_off then '{office}' "
        f"when 10 * evening_off > 13 * morning_off then '{commercial}' else '{mixed}' end"
    )


define(
    "profile",
    "pbase",
    f"""
    select stn_name, total as total_cnt, {ratio('morning * 100', 'total')} as morning_ratio,
      {ratio('lunch * 100', 'total')} as lunch_ratio, {ratio('evening * 100', 'total')} as evening_ratio,
      {_area('오피스형', '상업/유흥형', '혼합형')} as area_type,
      {_area('샌드위치/커피', '치킨/주점', '일반식당/카페')} as recommended_biz from pbase""",
)
define(
    "site",
    "kpi",
    f"""
    select cast(date_trunc('month', base_date) as date) as base_ym, stn_name,
      sum(on_cnt + off_cnt)::bigint as total, sum(off_cnt)::bigint as total_off,
      sum(peak_morning_off)::bigint as morning_off, sum(peak_evening_off)::bigint as evening_off
    from kpi where base_date between date '{PERIOD[0]}' and date '{PERIOD[1]}' group by all""",
)
define(
    "scores",
    "site",
    f"""
    select base_ym, stn_name, {ratio('total', '10')} as total_traffic_score,
      {ratio('morning_off * 100', 'total_off')} as office_score,
      {ratio('evening_off * 100', 'total_off')} as night_life_score,
      case when morning_off > evening_off then '오피스/카페/조식테이크아웃'
        when evening_off > morning_off then '주점/치킨/고깃집' else '복합상권/일반음식점' end as recommended_biz
    from site""",
)
define(
    "dim",
    "st",
    """
    select trim(replace(split_part(station, '(', 1), '역', '')) as station_clean,
      concat('N', lpad(cast(s_suppkey as varchar), 4, '0')) as station_no,
      s_suppkey / 1000.0::double + 37 as lat, s_suppkey / 1000.0::double + 127 as lng
    from st where s_suppkey % 7 <> 0
    union all
    select upper(trim(replace(split_part(station, '(', 1), '역', ''))),
      concat('Z', lpad(cast(s_suppkey as varchar), 4, '0')), 37.0, 127.0
    from st where s_suppkey % 10 = 0""",
)
define(
    "flow",
    "long dim",
    """
    select base_date, hour, station, line, station_id, boarding, alighting from long left join (
      select lower(strip_accents(trim(station_clean))) as k, min(station_no) as station_id from dim group by 1)
    on lower(strip_accents(trim(replace(split_part(station, '(', 1), '역', '')))) = k""",
)
define(
    "mart",
    "flow",
    """
    select station_id, station, line, hour, sum(boarding)::bigint as boarding,
      sum(alighting)::bigint as alighting, (sum(boarding) - sum(alighting))::bigint as net_flow
    from flow where station_id is not null group by all""",
)
define(
    "spatial",
    "long",
    """
    select concat(trim(replace(split_part(station, '(', 1), '역', '')), '역') as stn_name,
      cast(regexp_replace(line, '[^0-9]', '', 'g') as int) as line_num,
      sum(boarding)::bigint as total_on_cnt, sum(alighting)::bigint as total_off_cnt,
      (sum(boarding) - sum(alighting))::bigint as net_flow_cnt from long group by all""",
)
_cur, _prev = "year(base_date) = 2001", "year(base_date) = 2000"
define(
    "sums",
    "lab",
    f"""
    select stn_name, line_num,
      sum(f) filter ({_cur} and day_label = '평일') as ws, count(f) filter ({_cur} and day_label = '평일') as wc,
      sum(f) filter ({_cur}) * count(f) filter ({_prev}) as cur,
      sum(f) filter ({_prev}) * count(f) filter ({_cur}) as prev,
      count(f) filter ({_cur}) * count(f) filter ({_prev}) as den,
      {', '.join(f"{ratio(f'sum(f) filter (year(base_date) = {y})', f'count(f) filter (year(base_date) = {y})', 0)} as v{y}" for y in (1997, 1998, 1999, 2000, 2001))},
      round(stddev_pop(f) filter ({_cur}) / nullif(avg(f) filter ({_cur}), 0), 3) as volatility
    from (select *, on_cnt + off_cnt as f from lab) group by all""",
)
define(
    "metrics",
    "sums",
    f"""
    select stn_name, line_num, {ratio('ws', 'wc', 0)} as weekday_avg,
      {ratio('cur - prev', 'den', 0)} as diff_amount, v1997, v1998, v1999, v2000, v2001, volatility,
      case when prev > 0 and 100 * cur > 105 * prev then '성장기'
        when prev > 0 and 100 * cur >= 95 * prev then '성숙기' else '정체/쇠퇴기' end as market_maturity,
      {ratio('(cur - prev) * 100', 'prev')} as growth_rate from sums""",
)
define(
    "firstm",
    "profile scores",
    """
    select * from (select p.stn_name, p.area_type, s.base_ym, s.total_traffic_score, s.office_score,
        s.night_life_score, s.recommended_biz,
        row_number() over (partition by p.stn_name order by s.base_ym asc nulls first) as rn
      from profile p left join scores s on p.stn_name = s.stn_name and year(s.base_ym) = 2001)
    where rn = 1""",
)
define(
    "scored",
    "firstm",
    """
    select *, (coalesce(total_traffic_score, 0) + coalesce(office_score, 0)
      + coalesce(night_life_score, 0)) / 3 as score from firstm""",
)


def grade(score: str) -> str:
    return f"case when {score} >= 19.0 then 'S' when {score} >= 16.5 then 'A' else 'B' end"


define(
    "stations",
    "spatial dim profile scores",
    f"""
    select s.stn_name as display_name, s.line_num, lat, lng, area_type,
      coalesce(avg_score, 0.0) as avg_score, {grade('avg_score')} as location_grade
    from spatial s
    join (select lower(strip_accents(replace(trim(station_clean), '역', ''))) as k, max(lat) as lat, max(lng) as lng
      from dim group by 1) d on lower(strip_accents(replace(trim(s.stn_name), '역', ''))) = d.k
    left join (select lower(replace(trim(stn_name), '역', '')) as k, max(area_type) as area_type
      from profile group by 1) p on p.k = d.k
    left join (select lower(replace(trim(stn_name), '역', '')) as k,
        sum(cast(coalesce(total_traffic_score, 0) + coalesce(office_score, 0) + coalesce(night_life_score, 0)
          as decimal(18, 2)))::double / count(*) / 3 as avg_score
      from scores where year(base_ym) = 2001 group by 1) c on c.k = d.k""",
)

# --- wide rows and deliveries -----------------------------------------------------------

_sums = ",\n".join(
    f"sum(case when hour = '{h:02d}' then {c} else 0 end)::bigint as {m}_{h:02d}"
    for m, c in (("on", "boarding"), ("off", "alighting"))
    for h in HOURS
)
define("wide", "long", f"select base_date, station, line, station_no, {_sums} from long group by all")


def _side(word: str, mark: str) -> str:
    values = ", ".join(f"{mark}_{h:02d} * {CSV_FACTOR} as s{h:02d}" for h in HOURS)
    return f"select base_date, station, line, station_no, '{word}' as direction, {values} from wide"


define(
    "sent",
    "wide",
    f"""
    select *, case when year(base_date) <= 1997 then 'a' when year(base_date) <= 2000 then 'b' else 'c' end
      as delivery, (month(base_date) = 2 and day(base_date) = 13 and year(base_date) between 1998 and 2000)
      as bad_date
    from ({_side('승차', 'on')} union all {_side('하차', 'off')})""",
)


def unreadable(count: str) -> str:
    """Whether a count was delivered as a text that is no number."""
    letters = ", ".join(map(str, SUFFIXED))
    return f"((delivery = 'a' and {count} = {BAD_COUNT}) or (delivery = 'c' and {count} in ({letters})))"


def _read(h: int) -> str:
    gone = "or delivery = 'c'" if h == 24 else ""
    return f"case when {unreadable(f's{h:02d}')} {gone} then 0 else s{h:02d} end as r{h:02d}"


def _lost(h: int) -> str:
    gone = "and delivery <> 'c'" if h == 24 else ""
    return f"({unreadable(f's{h:02d}')} {gone})::int"


#: Counts of a delivered row that are no numbers; the last slot is absent from c.
LOST = " + ".join(_lost(h) for h in HOURS)


define(
    "got",
    "sent",
    f"""
    select base_date, trim(replace(line, '호선', '')) as line, station_no, station, direction, delivery,
      bad_date, {', '.join(_read(h) for h in HOURS)} from sent""",
)
GOT_TOTAL = " + ".join(f"r{h:02d}" for h in HOURS)
GOT_CHECK = " + ".join(f"{h} * r{h:02d}" for h in HOURS)
