"""Named queries over the event tables, each with the SQL that checks it.

The event table stands in for the instruments: an event is a sample, its type a
status channel, and instants are moved into the campaign so that every station,
flag and plume rule meets data. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StructType,
                               TimestampNTZType)

from driftline.functions import cond, times
from driftline.functions.angles import direction_of, wrap_once
from driftline.operators import (calibration, groups, intervals, rows, rule_tables, scan, stored,
                                 timebin, zeroes)
from driftline.operators.align import align_full, align_left
from driftline.operators.intervals import Interval
from driftline.operators.scan import Order
from driftline.operators.wind import true_wind, wind_average
from driftline.plans import products, rules
from driftline.session import new_folder
from driftline.sources import logs, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


# inputs ---------------------------------------------------------------------
# one text per derived table, valid in both engines

_MEASURED = {
    "date": "ts - INTERVAL '592' DAY",
    "event_id": "event_id",
    "user_id": "user_id",
    "event_type": "event_type",
    "so2": "value / 9.173",
    "noy": "value / 6.131",
    "no": "case when event_id % 7 <> 0 then value / 37.193 - 0.05 end",
    "no2": "case when event_id % 11 <> 0 then value / 19.377 - 0.13 end",
    "o3": "value / 3.119",
    "zero_box": "case when event_id % 13 = 0 then null when event_type = 'error' then 1 else 0 end",
    "so2_zero_channel": "case when event_type = 'signup' then 1 else 0 end",
}
_CO = {"date": "ts - INTERVAL '592' DAY", "co_calibrated": "value / 0.3117"}
_MET = {
    "date": "ts - INTERVAL '592' DAY",
    "event_id": "event_id",
    "lat": "60 + cast(user_id as double) / 200",
    "long": "cast(user_id as double) / 100 - 50",
    "speed": "value / 9.417",
    "heading": "cast((user_id * 13) % 360 as double)",
    "rel_ws": "value / 11.239",
    "rel_wd": "cast((user_id * 7) % 360 as double)",
    "air_temp": "value / 30.71",
    "air_humidity": "case when event_id % 17 <> 0 then 80 - value / 50.23 end",
}


def _select(mapping: dict[str, str]) -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in mapping.items()) + " from events"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _derived(spark: SparkSession, sf: str, mapping: dict[str, str]) -> DataFrame:
    return _events(spark, sf).select(*[F.expr(e).alias(n) for n, e in mapping.items()])


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(spark, sf, _MEASURED)


def co_table(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(spark, sf, _CO)


def met(spark: SparkSession, sf: str) -> DataFrame:
    return _derived(spark, sf, _MET)


_M = f"m as ({_select(_MEASURED)})"
_ORDER = Order(time="date", ties=("event_id",))
_BY_USER = Order(time="date", ties=("event_id",), series=("user_id",))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Computed doubles to six places; negative zero becomes zero."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def _r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 as {name or expression}"


def _rs(*names: str) -> str:
    return ", ".join(_r(n) for n in names)


# SQL building blocks --------------------------------------------------------

def _case(rules_, default: str = "null", instant: str = "date") -> str:
    """The conditional a rule set stands for, as SQL."""
    def literal(v):
        return str(v) if isinstance(v, int) else f"'{v}'"

    branches = []
    for r in rules_:
        if isinstance(r, str):
            branches.append(r)
            continue
        lower, upper = (">=", "<=") if r.closed else (">", "<")
        tests = [f"{instant} {op} timestamp '{_full(t)}'"
                 for op, t in ((lower, r.start), (upper, r.end)) if t is not None]
        branches.append(f"when {' and '.join(tests)} then {literal(r.label)}")
    return "case " + " ".join(branches) + f" else {default} end"


def _full(text: str) -> str:
    return {10: text + " 00:00:00", 16: text + ":00"}.get(len(text), text)


def _runs_sql(src: str, z: str, value: int = 1, part: str = "") -> str:
    """CTEs ending in ``runs``: src with row_pos, run_no, run_id, carried_id."""
    over = f"({'partition by ' + part if part else ''} order by date, event_id)"
    return f"""
  r0 as (select *, lag({z}) over {over} as p_, row_number() over {over} as row_pos from {src}),
  r1 as (select *, case when row_pos = 1 or p_ is null or {z} is null or p_ <> {z}
                   then 1 else 0 end as st_ from r0),
  r2 as (select *, sum(st_) over {over} as run_no,
                sum(case when {z} = {value} then st_ else 0 end) over {over} as carried_id from r1),
  runs as (select *, case when {z} = {value} then carried_id else 0 end as run_id from r2)"""


def _line_sql(src: str, cols: list[str], keep: str, x: str | None = None) -> str:
    """CTEs ending in ``lines``: src columns ``keep`` and each col interpolated."""
    ordered = "order by date, event_id"
    up = f"over ({ordered} rows between unbounded preceding and current row)"
    down = f"over ({ordered} rows between current row and unbounded following)"
    place = x or f"row_number() over ({ordered})"
    known = ", ".join(f"case when {c} is not null then x_ end as x_{c}" for c in cols)
    ends = ", ".join(
        f"last_value({c} ignore nulls) {up} as a_{c}, last_value(x_{c} ignore nulls) {up} as i_{c}, "
        f"first_value({c} ignore nulls) {down} as b_{c}, first_value(x_{c} ignore nulls) {down} as j_{c}"
        for c in cols)
    out = ", ".join(
        f"case when i_{c} = j_{c} then a_{c} "
        f"else a_{c} + (b_{c} - a_{c}) * (x_ - i_{c}) / (j_{c} - i_{c}) end as {c}" for c in cols)
    return f"""
  l0 as (select *, {place} as x_ from {src}),
  l1 as (select *, {known} from l0),
  l2 as (select *, {ends} from l1),
  lines as (select {keep}, {out} from l2)"""


# time averages --------------------------------------------------------------

_MEANS = ["no", "no2", "zero_box", "o3"]


def _mean_sql(unit: str, by: str = "", strict: bool = False) -> str:
    def mean(c):
        return f"case when count({c}) = count(*) then avg({c}) end" if strict else f"avg({c})"
    lead = f"{by}, " if by else ""
    return (f"with {_M} select {lead}date_trunc('{unit}', date) as date, "
            + ", ".join(_r(mean(c), c) for c in _MEANS)
            + f" from m group by all")


@query(_mean_sql("minute"))
def time_mean_minute(spark, sf):
    return rounded(timebin.time_average(measured(spark, sf), "1 minute", columns=_MEANS))


@query(_mean_sql("hour"))
def time_mean_hour(spark, sf):
    return rounded(timebin.time_average(measured(spark, sf), "1 hour", columns=_MEANS))


@query(_mean_sql("hour", strict=True))
def time_mean_strict(spark, sf):
    return rounded(timebin.time_average(measured(spark, sf), "1 hour", columns=_MEANS,
                                        strict=True))


@query(_mean_sql("hour", by="event_type"))
def time_mean_by_series(spark, sf):
    return rounded(timebin.time_average(measured(spark, sf), "1 hour", by=["event_type"],
                                        columns=_MEANS))


@query(f"""with {_M},
  a as (select event_type, time_bucket(interval '10 minutes', date) as date, avg(o3) as o3 from m group by all),
  s as (select event_type, min(date) as lo, max(date) as hi from a group by all),
  b as (select event_type, unnest(generate_series(lo, hi, interval '10 minutes')) as date from s)
  select event_type, date, {_r('o3')} from b left join a using (event_type, date)""")
def time_mean_padded(spark, sf):
    return rounded(timebin.time_average(measured(spark, sf), "10 minutes", by=["event_type"],
                                        columns=["o3"], pad=True))


@query(f"""with {_M},
  a as (select nullif(event_type, 'error') as event_type,
    time_bucket(interval '10 minutes', date) as date, avg(o3) as o3 from m group by all),
  s as (select event_type, min(date) as lo, max(date) as hi from a group by all),
  b as (select event_type, unnest(generate_series(lo, hi, interval '10 minutes')) as date from s)
  select b.event_type, b.date, {_r('o3')} from b left join a
    on b.event_type is not distinct from a.event_type and b.date = a.date""")
def time_mean_padded_unknown_series(spark, sf):
    """One series has no name; it is padded like any other."""
    df = measured(spark, sf).withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return rounded(timebin.time_average(df, "10 minutes", by=["event_type"], columns=["o3"],
                                        pad=True))


def _wind_sql(weight: str, speed: str) -> str:
    return f"""with w as ({_select(_MET)}),
  a as (select date_trunc('hour', date) as date, avg({weight} * sin(radians(rel_wd))) as u,
    avg({weight} * cos(radians(rel_wd))) as v, avg(rel_ws) as s from w group by all)
  select date, (round((degrees(atan2(u, v)) + 360) % 360, 6) % 360) + 0.0 as rel_wd,
    {_r(speed, 'rel_ws')} from a"""


def _hourly_wind(spark, sf, vector):
    out = timebin.time_average(met(spark, sf), "1 hour", columns=["rel_wd", "rel_ws"],
                               wind=[("rel_wd", "rel_ws")], vector_ws=vector)
    return rounded(out).withColumn("rel_wd", F.col("rel_wd") % 360)


@query(_wind_sql("rel_ws", "sqrt(u * u + v * v)"))
def wind_vector_mean(spark, sf):
    return _hourly_wind(spark, sf, True)


@query(_wind_sql("1", "s"))
def wind_unit_mean(spark, sf):
    return _hourly_wind(spark, sf, False)


# wind -----------------------------------------------------------------------

_TRUE_WIND_SQL = f"""w0 as ({_select(_MET)}),
  w1 as (select *, case when heading + rel_wd >= 360 then heading + rel_wd - 360
                   else heading + rel_wd end as true_wd from w0
         where lat is not null and air_humidity is not null),
  w2 as (select *, case when true_wd + 180 >= 360 then true_wd - 180 else true_wd + 180 end
                   as true_wd_towards from w1),
  w3 as (select *, rel_ws * sin(radians(true_wd_towards)) as u_rel,
                rel_ws * cos(radians(true_wd_towards)) as v_rel,
                speed / 1.9438 * sin(radians(heading)) as ship_motion_u,
                speed / 1.9438 * cos(radians(heading)) as ship_motion_v from w2),
  w4 as (select *, u_rel + ship_motion_u as u, v_rel + ship_motion_v as v from w3),
  w as (select *, sqrt(u * u + v * v) as ws from w4)"""


@query(f"""with {_TRUE_WIND_SQL} select event_id, {_rs('true_wd', 'true_wd_towards', 'u_rel',
  'v_rel', 'ship_motion_u', 'ship_motion_v', 'u', 'v', 'ws')} from w""")
def true_wind_rows(spark, sf):
    return rounded(true_wind(met(spark, sf)).select(
        "event_id", "true_wd", "true_wd_towards", "u_rel", "v_rel", "ship_motion_u",
        "ship_motion_v", "u", "v", "ws"))


@query(f"""with {_TRUE_WIND_SQL} select event_id,
  (round((degrees(atan2(-u, -v)) + 360) % 360, 6) % 360) + 0.0 as true_wd_corrected from w""")
def true_wind_corrected_direction(spark, sf):
    out = true_wind(met(spark, sf), corrected_direction=True)
    return rounded(out.select("event_id", "true_wd_corrected")).withColumn(
        "true_wd_corrected", F.col("true_wd_corrected") % 360)


_WIND_MINUTE_SQL = """wm0 as (select date_trunc('minute', date) as date, avg(lat) as lat, avg(long) as long,
    avg(speed) as speed, avg(heading) as heading, avg(air_temp) as air_temp,
    avg(air_humidity) as air_humidity,
    avg(ws * sin(radians(true_wd))) as tu, avg(ws * cos(radians(true_wd))) as tv,
    avg(rel_ws * sin(radians(rel_wd))) as ru, avg(rel_ws * cos(radians(rel_wd))) as rv
    from w group by all),
  wm as (select date, lat, long, speed, heading, air_temp, air_humidity,
    (degrees(atan2(ru, rv)) + 360) % 360 as rel_wd, sqrt(ru * ru + rv * rv) as rel_ws,
    (degrees(atan2(tu, tv)) + 360) % 360 as wd, sqrt(tu * tu + tv * tv) as ws from wm0)"""


@query(f"""with {_TRUE_WIND_SQL}, {_WIND_MINUTE_SQL}
  select date, {_rs('lat', 'long', 'speed', 'heading', 'air_temp', 'air_humidity', 'rel_ws', 'ws')},
    (round(rel_wd, 6) % 360) + 0.0 as rel_wd, (round(wd, 6) % 360) + 0.0 as wd from wm""")
def wind_minutes(spark, sf):
    out = rounded(wind_average(true_wind(met(spark, sf))))
    return out.withColumns({c: F.col(c) % 360 for c in ("wd", "rel_wd")})


# intervals ------------------------------------------------------------------

_STATION = _case(rules.stations())


@query(f"with {_M} select event_id, {_STATION} as station from m")
def interval_tag(spark, sf):
    return products.tag_station(measured(spark, sf)).select("event_id", "station")


@query(f"with {_M} select event_id, {_case(rules.stations(coarse=True))} as station from m")
def interval_tag_coarse(spark, sf):
    return products.tag_station(measured(spark, sf), coarse=True).select("event_id", "station")


@query(f"with {_M} select event_id, {_case(rules.bands())} as band from m")
def band_table(spark, sf):
    return intervals.band_table(measured(spark, sf), rules.bands()).select("event_id", "band")


def _many_rules() -> list[Interval]:
    """Overlapping five-hour legs every three hours, open and closed, and open ends."""
    first = datetime(2022, 5, 20)
    legs = [Interval(str(first + timedelta(hours=3 * i)), str(first + timedelta(hours=3 * i + 5)),
                     f"leg {i % 17}", closed=i % 2 == 0) for i in range(210)]
    return [*legs, Interval(None, "2022-05-19 12:00:00", "before"),
            Interval("2022-06-15 00:00:00", None, "after")]


@query(f"with {_M} select event_id, {_case(_many_rules(), chr(39) + 'none' + chr(39))} as leg from m")
def interval_tag_many_rules(spark, sf):
    return intervals.tag_intervals(measured(spark, sf), _many_rules(), "leg", "none") \
        .select("event_id", "leg")


_HIGH_SQL = _case(["when no > 3.0 then 'high no'", *_many_rules(), "when o3 > 40 then 'high o3'"],
                  "'none'")


@query(f"with {_M} select event_id, {_HIGH_SQL} as leg from m")
def interval_tag_many_rules_with_values(spark, sf):
    legs = [intervals.Value("no > 3.0", "high no"), *_many_rules(),
            intervals.Value("o3 > 40", "high o3")]
    return intervals.tag_intervals(measured(spark, sf), legs, "leg", "none") \
        .select("event_id", "leg")


@query(f"""with {_M} select event_id, {_case(rules.zeroing_flag(), '0')} as flag,
  {_case(rules.pollution(), '0')} as poll from m""")
def interval_flag(spark, sf):
    return products.pollution_flag(products.zeroing_flag(measured(spark, sf))) \
        .select("event_id", "flag", "poll")


_FLAG_NAMES = list(rules.flag_rules())


def _flags_sql(version: str) -> str:
    extra = {"co_flag": ["when co > 250 then 1"], "noy_flag": ["when noy < nox then 1"]} \
        if version == "current" else {}
    windows = {f: [r for r in rs if isinstance(r, Interval)]
               for f, rs in rules.flag_rules(version).items()}
    return ", ".join(f"{_case([*rs, *extra.get(f, [])], '0')} as {f}" for f, rs in windows.items())


@query(f"""with {_M}, n as (select *, no + no2 as nox, o3 * 6 as co from m)
  select event_id, {_r('nox')}, {_flags_sql('current')} from n""")
def instrument_flags(spark, sf):
    df = measured(spark, sf).withColumn("co", F.col("o3") * 6)
    return rounded(products.instrument_flags(df).select("event_id", "nox", *_FLAG_NAMES))


@query(f"with {_M} select event_id, {_flags_sql('v1')} from m")
def instrument_flags_first_version(spark, sf):
    return products.instrument_flags(measured(spark, sf), "v1").select("event_id", *_FLAG_NAMES)


@query(f"with {_M} select event_id, {_flags_sql('v2')} from m")
def instrument_flags_second_version(spark, sf):
    return products.instrument_flags(measured(spark, sf), "v2").select("event_id", *_FLAG_NAMES)


_PLUME = _case(["when rel_ws < 2.5 then 'ws'", "when rel_wd > 157.5 and rel_wd < 202.5 then 'wd'",
                *[r for r in rules.plume_rules() if isinstance(r, Interval)]], "'no'")
_STACK_CODE = ("case {} when 'no' then 0 when 'ws' then 1 when 'wd' then 2 "
               "when 'other_ship' then 3 when 'nox_spike' then 4 end")


@query(f"""with w as ({_select(_MET)}) select event_id, {_STACK_CODE.format(_PLUME)} as stack_flag,
  {_r("case when date between timestamp '2022-06-10 06:00:00' and timestamp '2022-06-10 12:30:00' "
      "then null else speed end", 'ws')} from w""")
def stack_flags(spark, sf):
    df = met(spark, sf).withColumn("ws", F.col("speed"))
    return rounded(products.stack_flags(df).select("event_id", "stack_flag", "ws"))


@query(f"""with w as ({_select(_MET)}), s as (select date, {_PLUME} as f from w)
  select date_trunc('hour', date) as date, """ + ", ".join(
    _r(f"avg(case when f = '{k}' then 1.0 else 0.0 end)", f"share_{k}") for k in rules.STACK_CODES)
       + " from s group by 1")
def stack_shares(spark, sf):
    return rounded(products.stack_fractions(products.stack_flags(met(spark, sf))))


# offsets --------------------------------------------------------------------

def _offset_sql(target: str, fix: bool = False) -> str:
    return "case station " + " ".join(
        f"when '{o.key}' then {target if fix else o.source} - ({o.offset})"
        for o in rules.offsets() if o.target == target) + " end"


@query(f"""with {_M}, s as (select *, {_STATION} as station from m)
  select event_id, {_r(_offset_sql('no'), 'no_corr')}, {_r(_offset_sql('no2'), 'no2_corr')} from s""")
def offset_apply(spark, sf):
    df = zeroes.apply_offsets(products.tag_station(measured(spark, sf)), rules.offsets())
    return rounded(df.select("event_id", "no_corr", "no2_corr"))


@query(f"""with {_M}, s as (select *, {_STATION} as station from m)
  select event_id, {_r(_offset_sql('no', True), 'no_corr')},
    {_r(_offset_sql('no2', True), 'no2_corr')} from s""")
def offset_apply_fixed_sources(spark, sf):
    df = zeroes.apply_offsets(products.tag_station(measured(spark, sf)), rules.offsets(),
                              fix_sources=True)
    return rounded(df.select("event_id", "no_corr", "no2_corr"))


@query(f"""with {_M} select event_id, {_r('no - (-0.0363139655120056)', 'no_corr')},
  {_r('no2 - (-0.134759009068831)', 'no2_corr')} from m""")
def offset_constant(spark, sf):
    df = zeroes.apply_constant(measured(spark, sf), rules.CONSTANT_ZEROES)
    return rounded(df.select("event_id", "no_corr", "no2_corr"))


_CLEAN_ZEROES_SQL = f"""{_M},
  m1 as (select *, coalesce(zero_box, 0) as zb, {_STATION} as station from m
         where ({_case(rules.zero_job_calibration(), '0')}) = 0),
  {_runs_sql('m1', 'zb')},
  z as (select * from runs where run_id > 0 and station not in ('Sailing home', 'Reykjavik')
        and run_id not in (12, 2, 25, 15, 3, 16, 7))"""


def _clean(spark, sf):
    return products.zero_job_rows(measured(spark, sf))


def _station_zeroes(spark, sf, **options):
    return products.station_zero_table(measured(spark, sf), _ORDER, **options)


@query(f"""with {_CLEAN_ZEROES_SQL} select station,
  {_r('case when count(o3) = count(*) then avg(o3) end', 'no')},
  {_r('case when max(cast(event_id % 397 = 0 as integer)) = 0 then avg(so2) end', 'no2')}
  from z group by station""")
def station_zero_means(spark, sf):
    """One channel without gaps, one whose few gaps make the strict mean missing."""
    df = measured(spark, sf).withColumns({
        "no": F.col("o3"), "no2": F.when(F.col("event_id") % 397 != 0, F.col("so2"))})
    return rounded(products.station_zero_table(df, _ORDER))


@query(f"""with {_CLEAN_ZEROES_SQL} select station, {_r('median(no)', 'no')},
  {_r('median(no2)', 'no2')} from z group by station""")
def station_zero_medians(spark, sf):
    return rounded(_station_zeroes(spark, sf, stat="median"))


@query(f"""with {_CLEAN_ZEROES_SQL}, o as (select station, median(no) as no, median(no2) as no2
    from z group by station)
  select event_id, {_r('m1.no - o.no', 'no_corr')}, {_r('m1.no2 - o.no2', 'no2_corr')}
  from m1 left join o on m1.station is not distinct from o.station""")
def offset_table_computed(spark, sf):
    table = _station_zeroes(spark, sf, stat="median")
    out = zeroes.apply_offset_table(_clean(spark, sf), table, ["no", "no2"])
    return rounded(out.select("event_id", "no_corr", "no2_corr"))


@query(f"""with {_CLEAN_ZEROES_SQL} select distinct station from m1
  where not exists (select 1 from z where z.station is not distinct from m1.station)""")
def offset_table_missing_stations(spark, sf):
    return zeroes.missing_keys(_clean(spark, sf), _station_zeroes(spark, sf))


# intervals as a table ---------------------------------------------------------

#: Rules made from the events: windows of their type, open or closed, some without a bound,
#: some that end before they start, most of them overlapping.
_WINDOWS = {
    "start": "case when event_id % 997 <> 3 then ts - INTERVAL '592' DAY end",
    "end": "case when event_id % 991 <> 5 then ts - INTERVAL '592' DAY "
           "+ INTERVAL '1' MINUTE * (event_id % 173 - 3) end",
    "label": "case when event_id % 19 <> 0 then concat(event_type, ' ', cast(user_id as varchar(9))) end",
    "p": "case when event_id % 7 <> 0 then case when event_id % 997 = 3 or event_id % 991 = 5 "
         "then 1000 else user_id end end",
    "closed": "event_id % 2 = 0",
}


def _window_table(spark, sf):
    return _events(spark, sf).where("event_id % 3 = 0").select(
        *[F.expr(e).alias(n) for n, e in _WINDOWS.items()])


_WINDOW_SQL = f"""w as ({_select(_WINDOWS).replace('"end"', 'end')} where event_id % 3 = 0),
  i as (select *, coalesce("start", timestamp '0001-01-01') as lo,
    coalesce("end", timestamp '9999-01-01') as hi from w where label is not null),
  j as (select m.event_id, i.label, i.p from m join i on m.date >= lo and m.date <= hi
    where closed or (m.date > lo and m.date < hi)),
  k as (select event_id, first(label order by p nulls last, label) as label from j group by 1)"""


@query(f"""with {_M}, {_WINDOW_SQL} select event_id, label from m left join k using (event_id)""")
def rule_table_tag(spark, sf):
    """A rule table as long as a third of the events, its stretches met range by range."""
    return rule_tables.tag_by_table(measured(spark, sf), _window_table(spark, sf), "label",
                                    few=100, range_rows=20_000).select("event_id", "label")


@query(f"""with {_M}, {_WINDOW_SQL.replace('% 3 = 0', '% 101 = 0')}
  select event_id, case when label is null then 0 else 1 end as flag from m left join k using (event_id)""")
def rule_table_flag(spark, sf):
    """A short rule table: its stretches become conditions."""
    table = _events(spark, sf).where("event_id % 101 = 0").select(
        *[F.expr(e).alias(n) for n, e in _WINDOWS.items()])
    return rule_tables.flag_by_table(
        measured(spark, sf), table.withColumn("label", F.when(F.col("label").isNotNull(), 1)),
        "flag").select("event_id", "flag")


@query("""with w as (select event_id, ts as lo, ts + INTERVAL '1' MINUTE * (event_id % 173) as hi,
    user_id as p, event_type as label from events where event_id % 4 = 0),
  v as (select * from w where lo < hi),
  c as (select t as a, lead(t) over (order by t) as b
    from (select distinct unnest([lo, hi]) as t from v)),
  s as (select a, b, first(label order by p, label) as label from c join v on lo <= a and hi >= b
    group by all)
  select label, cast(sum(datediff('microsecond', a, b)) as bigint) as covered from s group by 1""")
def rule_table_stretches(spark, sf):
    """How long each label is in force after the overlaps are resolved, in many ranges."""
    table = _events(spark, sf).where("event_id % 4 = 0").select(
        # open bounds a microsecond apart hold [lo, hi)
        (F.col("ts") - F.expr("INTERVAL '0.000001' SECOND")).alias("start"),
        F.expr("ts + INTERVAL '1' MINUTE * (event_id % 173)").alias("end"),
        F.col("event_type").alias("label"), F.col("user_id").alias("p"))
    found = rule_tables.resolve_intervals(table, cuts=500)
    return found.groupBy("label").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))


# joins ----------------------------------------------------------------------

def _channel_means(spark, sf):
    df = timebin.time_average(measured(spark, sf), "1 minute", by=["event_type"], columns=["o3"])
    return [df.filter(F.col("event_type") == t).select("date", F.col("o3").alias(t))
            for t in _CHANNELS]


_CHANNELS = ("error", "click", "view", "signup", "purchase")
_CHANNELS_SQL = f"""{_M},
  a as (select event_type, date_trunc('minute', date) as date, avg(o3) as o3 from m group by all),
  {", ".join(f"t_{t} as (select date, o3 as {t} from a where event_type = '{t}')" for t in _CHANNELS)}"""


def _aligned_sql(join: str) -> str:
    first, *others = _CHANNELS
    return (f"with {_CHANNELS_SQL} select date, {_rs(*_CHANNELS)} from t_{first} "
            + " ".join(f"{join} join t_{t} using (date)" for t in others))


@query(_aligned_sql("left"))
def align_left_minutes(spark, sf):
    first, *others = _channel_means(spark, sf)
    return rounded(align_left(first, others))


@query(_aligned_sql("full"))
def align_full_minutes(spark, sf):
    return rounded(align_full(_channel_means(spark, sf)))


@query(_aligned_sql("full"))
def align_full_unique_minutes(spark, sf):
    return rounded(align_full(_channel_means(spark, sf), unique=True))


@query("""with a as (select date_trunc('day', l_shipdate) as date, sum(l_quantity) as shipped
    from lineitem group by 1),
  b as (select o_orderdate as date, o_orderkey from orders)
  select date, cast(shipped as double) as shipped, o_orderkey from a full join b using (date)""")
def align_full_repeated_keys(spark, sf):
    shipped = _table(spark, sf, "lineitem").groupBy(
        times.time_bin(F.col("l_shipdate"), "1 day").alias("date")).agg(
        F.sum("l_quantity").alias("shipped"))
    ordered = _table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"), "o_orderkey")
    return align_full([shipped, ordered])


_REPEATED_SQL = """with a as (select cast(ts as date) as date, event_id from events
    where event_type = 'error' and event_id % 5 = 0),
  b as (select o_orderdate as date, o_orderkey from orders where o_orderkey % 3 = 0),
  c as (select date_trunc('day', l_shipdate) as date, l_returnflag, count(*) as shipped
    from lineitem group by all),
  d as (select case when n_nationkey % 4 = 0 then null else timestamp '1994-01-01'
    + interval (n_nationkey * 7) day end as date, n_name from nation)
  select date, event_id, o_orderkey, l_returnflag, shipped, n_name
  from a full join b using (date) full join c using (date) full join d using (date)"""


def _repeated(spark, sf):
    """Four tables that all repeat instants; one has rows without an instant."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz").alias("date")
    return [
        _events(spark, sf).where("event_type = 'error' and event_id % 5 = 0").select(
            day("ts"), "event_id"),
        _table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(
            day("o_orderdate"), "o_orderkey"),
        _table(spark, sf, "lineitem").groupBy(day("l_shipdate"), "l_returnflag").agg(
            F.count(F.lit(1)).alias("shipped")),
        _table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 4 != 0, F.expr(
            "TIMESTAMP_NTZ '1994-01-01' + make_dt_interval(cast(n_nationkey * 7 as int))"))
            .alias("date"), "n_name")]


@query(_REPEATED_SQL)
def align_full_many_repeated(spark, sf):
    return align_full(_repeated(spark, sf))


@query(_REPEATED_SQL)
def align_full_many_repeated_cut(spark, sf):
    """The same with every key of more than two rows in a table cut into parts."""
    return align_full(_repeated(spark, sf), key_rows=2)


# groups ---------------------------------------------------------------------

@query(f"""with {_M}, s as (select *, {_STATION} as station from m) select station,
  {_r('case when count(no) = count(*) then avg(no) end', 'no')},
  {_r('case when count(o3) = count(*) then avg(o3) end', 'o3')} from s group by 1""")
def station_mean_strict(spark, sf):
    df = products.tag_station(measured(spark, sf))
    return rounded(groups.group_mean(df, ["station"], ["no", "o3"], strict=True))


@query(f"""with {_M}, s as (select *, {_STATION} as station from m)
  select station, {_r('avg(no)', 'no')}, {_r('avg(o3)', 'o3')} from s group by 1""")
def station_mean(spark, sf):
    return rounded(groups.group_mean(products.tag_station(measured(spark, sf)),
                                     ["station"], ["no", "o3"]))


_MEDIAN_SQL = f"""with {_M}, s as (select *, {_STATION} as station from m)
  select station, {_r('median(no)', 'no')}, {_r('median(o3)', 'o3')} from s group by 1"""


@query(_MEDIAN_SQL)
def station_median(spark, sf):
    return rounded(groups.group_median(products.tag_station(measured(spark, sf)),
                                       ["station"], ["no", "o3"]))


@query(_MEDIAN_SQL)
def station_median_bracketed(spark, sf):
    return rounded(groups.group_median(products.tag_station(measured(spark, sf)),
                                       ["station"], ["no", "o3"], max_rows=0))


@query(f"""with {_M} select event_type,
  {_r('case when count(no) = count(*) then stddev_samp(no) end', 'no')},
  {_r('case when count(o3) = count(*) then stddev_samp(o3) end', 'o3')} from m group by 1""")
def group_sd_strict(spark, sf):
    return rounded(groups.group_sd(measured(spark, sf), ["event_type"], ["no", "o3"]))


@query(f"""select {_r('avg(distinct value)', 'value_mean')},
  {_r('stddev_samp(distinct value)', 'value_sd')} from events""")
def distinct_stats(spark, sf):
    return rounded(groups.distinct_stats(_events(spark, sf), ["value"]))


@query("select distinct event_type from events")
def distinct_values(spark, sf):
    return groups.distinct_values(_events(spark, sf), "event_type")


# ordered scans --------------------------------------------------------------

def _status(spark, sf):
    return measured(spark, sf).withColumn("zb", F.coalesce("zero_box", F.lit(0)))


_STATUS_SQL = f"{_M}, st as (select *, coalesce(zero_box, 0) as zb from m)"
_RUN_IDS_SQL = f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')}
  select event_id, cast(run_id as bigint) as id from runs"""


@query(_RUN_IDS_SQL)
def run_ids(spark, sf):
    return zeroes.zero_cycles(measured(spark, sf), "zero_box", _ORDER).select("event_id", "id")


@query(_RUN_IDS_SQL)
def run_ids_by_day(spark, sf):
    return scan.run_id(_status(spark, sf), "zb", 1, _ORDER, scan="day").select("event_id", "id")


def _stored(spark, sf, df, order, **options):
    """A layout in a new folder, made from the events."""
    return stored.store_slices(df, order, new_folder(spark, "layout"), f"{sf}/events.parquet",
                               **options)


@query(_RUN_IDS_SQL)
def run_ids_stored(spark, sf):
    slices = _stored(spark, sf, _status(spark, sf), _ORDER)
    return scan.run_id(slices, "zb", 1, _ORDER).select("event_id", "id")


@query(_RUN_IDS_SQL)
def run_ids_by_range(spark, sf):
    return scan.run_id(_status(spark, sf), "zb", 1, _ORDER, scan="range").select("event_id", "id")


@query(f"""with {_STATUS_SQL}, k as (select *, nullif(event_type, 'click') as kind from st),
  {_runs_sql('k', 'zb', part='kind')} select event_id, cast(run_id as bigint) as id from runs""")
def run_ids_null_series_by_day(spark, sf):
    df = _status(spark, sf).withColumn("kind", F.nullif("event_type", F.lit("click")))
    order = replace(_ORDER, series=("kind",))
    return scan.run_id(df, "zb", 1, order, scan="day").select("event_id", "id")


@query(f"""with {_M}, {_runs_sql('m', 'zero_box', part='user_id')}
  select event_id, cast(run_id as bigint) as id, cast(carried_id as bigint) as carried from runs""")
def run_ids_per_series(spark, sf):
    df = scan.run_id(measured(spark, sf), "zero_box", 1, _BY_USER)
    return scan.run_id(df, "zero_box", 1, _BY_USER, out="carried", carry=True) \
        .select("event_id", "id", "carried")


@query(f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')} select max(zb) as value,
  cast(run_no as bigint) as run_no, cast(min(row_pos) as bigint) as start_idx,
  cast(max(row_pos) as bigint) as end_idx, count(*) as n, min(date) as start_ts,
  max(date) as end_ts from runs group by run_no""")
def run_table(spark, sf):
    return scan.runs(_status(spark, sf), "zb", _ORDER)


@query(f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')} select cast(run_id as bigint) as id,
  count(*) as n from runs where run_id > 0 group by 1""")
def run_lengths(spark, sf):
    return scan.run_lengths(_status(spark, sf), "zb", 1, _ORDER)


def _positions_sql(ident: str) -> str:
    over = f"over (partition by {ident} order by date, event_id"
    return f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')}
  select event_id, cast({ident} as bigint) as id, row_number() {over}) as from_start,
    row_number() {over.replace('date, event_id', 'date desc, event_id desc')}) as from_end from runs"""


@query(_positions_sql("run_id"))
def run_positions(spark, sf):
    return scan.with_run_position(_status(spark, sf), "zb", 1, _ORDER).select(
        "event_id", "id", "from_start", "from_end")


@query(_positions_sql("carried_id"))
def run_positions_carried_by_day(spark, sf):
    return scan.with_run_position(_status(spark, sf), "zb", 1, _ORDER, grouping="carry",
                                  scan="day").select("event_id", "id", "from_start", "from_end")


@query(f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')},
  q as (select *, row_number() over (partition by run_id order by date, event_id) as a,
    row_number() over (partition by run_id order by date desc, event_id desc) as b from runs)
  select event_id, cast(run_id as bigint) as id,
    {_r('case when run_id > 0 and (a <= 1 or b <= 1) then null else o3 end', 'o3')} from q""")
def trim_runs(spark, sf):
    return rounded(scan.trim_runs(_status(spark, sf), ["o3"], "zb", 1, _ORDER, 1, 1)
                   .select("event_id", "id", "o3"))


@query(f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')},
  q as (select *, row_number() over (partition by run_id order by date, event_id) as a,
    row_number() over (partition by run_id order by date desc, event_id desc) as b from runs)
  select event_id, case when a <= 2 or b <= 1 then 1 else 0 end as edge_flag from q""")
def run_edges(spark, sf):
    return scan.flag_run_edges(_status(spark, sf), "zb", 1, _ORDER, 2, 1) \
        .select("event_id", "edge_flag")


_POSITION_SQL = "select event_id, row_number() over (order by ts, event_id) as idx from events"


@query(_POSITION_SQL)
def row_position(spark, sf):
    return scan.with_position(measured(spark, sf), _ORDER).select("event_id", "idx")


@query(_POSITION_SQL)
def row_position_by_day(spark, sf):
    return scan.with_position(measured(spark, sf), _ORDER, scan="day").select("event_id", "idx")


@query("""select event_id, cast(sum(user_id) over (partition by event_type order by ts, event_id)
  as bigint) as total from events""")
def running_sum(spark, sf):
    order = Order("date", ("event_id",), ("event_type",))
    return scan.running_sum(measured(spark, sf), F.col("user_id"), "total", order) \
        .select("event_id", "total")


_DIFF_SQL = f"""with {_M} select event_id,
  {_r('no - lag(no) over (order by date, event_id)', 'diff')} from m"""


@query(_DIFF_SQL)
def diff(spark, sf):
    return rounded(scan.diff(measured(spark, sf), "no", _ORDER).select("event_id", "diff"))


@query(_DIFF_SQL)
def diff_by_day(spark, sf):
    return rounded(scan.diff(measured(spark, sf), "no", _ORDER, scan="day")
                   .select("event_id", "diff"))


_SPARSE = {"date": "ts", "event_id": "event_id", "user_id": "user_id",
           "v": "case when event_id % 7 = 0 then value end"}
_SPARSE_SQL = f"sp as ({_select(_SPARSE)})"
_LOCF_SQL = f"""with {_SPARSE_SQL} select event_id, last_value(v ignore nulls) over
  (order by date, event_id rows between unbounded preceding and current row) as v from sp"""
_LINE_SQL = f"""with {_SPARSE_SQL}, {_line_sql('sp', ['v'], 'event_id')}
  select event_id, {_r('v')} from lines"""


@query(_LOCF_SQL)
def locf(spark, sf):
    return scan.locf(_derived(spark, sf, _SPARSE), "v", _ORDER).select("event_id", "v")


@query(_LOCF_SQL)
def locf_by_day(spark, sf):
    return scan.locf(_derived(spark, sf, _SPARSE), "v", _ORDER, scan="day").select("event_id", "v")


@query(_LINE_SQL)
def interpolate(spark, sf):
    return rounded(scan.interpolate(_derived(spark, sf, _SPARSE), "v", _ORDER)
                   .select("event_id", "v"))


@query(_LINE_SQL)
def interpolate_stored(spark, sf):
    slices = _stored(spark, sf, _derived(spark, sf, _SPARSE), _ORDER, max_rows=50)
    return rounded(scan.interpolate(slices, "v", _ORDER).select("event_id", "v"))


@query(_LINE_SQL)
def interpolate_by_day(spark, sf):
    return rounded(scan.interpolate(_derived(spark, sf, _SPARSE), "v", _ORDER, scan="day")
                   .select("event_id", "v"))


@query(_LINE_SQL)
def interpolate_by_range(spark, sf):
    return rounded(scan.interpolate(_derived(spark, sf, _SPARSE), "v", _ORDER, scan="range")
                   .select("event_id", "v"))


@query(f"""with {_SPARSE_SQL}, {_line_sql('sp', ['v'], 'event_id', "epoch_us(date) / 1e6")}
  select event_id, {_r('v')} from lines""")
def interpolate_in_time(spark, sf):
    return rounded(scan.interpolate(_derived(spark, sf, _SPARSE), "v", _ORDER, x="time")
                   .select("event_id", "v"))


# zero levels ----------------------------------------------------------------

@query(f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')},
  g as (select run_id, avg(no) as zero_no, median(no2) as zero_no2 from runs where run_id > 0 group by 1)
  select event_id, cast(run_id as bigint) as id, {_rs('zero_no', 'zero_no2')}
  from runs left join g using (run_id)""")
def run_statistic_attached(spark, sf):
    mean = zeroes.run_statistic(_status(spark, sf), ["no"], "zb", _ORDER)
    return rounded(zeroes.run_statistic(mean, ["no2"], "zb", _ORDER, stat="median", scan="day")
                   .select("event_id", "id", "zero_no", "zero_no2"))


def _zero_sql(stat_no: str, stat_no2: str, keep_no: str = "no", keep_no2: str = "no2",
              skip: str = "", key: str = "run_id", trim: str = "", source: str = "st") -> str:
    """Zero level per group, attached, interpolated by position and subtracted."""
    trimmed = f"""
  t0 as (select *, row_number() over (partition by run_id order by date, event_id) as a_ from runs),
  t as (select * exclude (no, no2), {trim.format('no')} as no, {trim.format('no2')} as no2 from t0)""" \
        if trim else "\n  t as (select * from runs)"
    valid = f"run_id > 0{' and run_id not in ' + skip if skip else ''}"
    return f"""with {_STATUS_SQL}, s as (select *, {_STATION} as station from {source}),
  {_runs_sql('s', 'zb')},{trimmed},
  g0 as (select {key}, {stat_no} as gno, {stat_no2} as gno2 from t where run_id > 0 group by {key}),
  g as (select {key}, case when {keep_no} then gno end as gno,
               case when {keep_no2} then gno2 end as gno2 from g0),
  f as (select t.*, case when {valid} then gno end as zero_no,
               case when {valid} then gno2 end as zero_no2 from t left join g using ({key})),
  {_line_sql('f', ['zero_no', 'zero_no2'], 'event_id, run_id, no, no2')}
  select event_id, cast(run_id as bigint) as id, {_rs('zero_no', 'zero_no2')},
    {_r('no - zero_no', 'no_corr')}, {_r('no2 - zero_no2', 'no2_corr')} from lines"""


_LEVEL = ["event_id", "id", "zero_no", "zero_no2", "no_corr", "no2_corr"]


def _level(spark, sf, **options):
    df = products.tag_station(_status(spark, sf))
    return rounded(zeroes.interpolated_zero(df, ["no", "no2"], "zb", _ORDER, **options)
                   .select(*_LEVEL))


_MEAN_STRICT = "case when count({0}) = count(*) then avg({0}) end"


@query(_zero_sql(_MEAN_STRICT.format("no"), _MEAN_STRICT.format("no2"), "true", "true"))
def interpolated_zero(spark, sf):
    return _level(spark, sf, strict=True)


@query(_zero_sql("median(no)", "median(no2)", "gno between -0.25 and 1.25", "gno2 <= 3"))
def interpolated_zero_median(spark, sf):
    return _level(spark, sf, stat="median", reject={"no": (-0.25, 1.25), "no2": (None, 3)})


@query(_zero_sql("avg(no)", "avg(no2)", "true", "true", skip="(1, 14)",
                 trim="case when a_ <= 1 then null else {} end"))
def interpolated_zero_trimmed(spark, sf):
    return _level(spark, sf, head=1, trim_background=True, skip_ids=(1, 14))


@query(_zero_sql("median(no)", "median(no2)", "true", "true", key="station"))
def interpolated_zero_by_station(spark, sf):
    return _level(spark, sf, stat="median", by="station")


@query(_zero_sql("median(no)", "median(no2)", "true", "true", source=f"""(
    select * exclude (no, no2), case when nox_flag = 1 then null else no end as no,
      case when nox_flag = 1 then null else no2 end as no2
    from (select *, {_flags_sql('v2')} from st) where flag_all = 0)"""))
def interpolated_zero_cleaned(spark, sf):
    """The earlier job: rows cleaned by their flags first."""
    clean = products.older_zero_rows(products.instrument_flags(measured(spark, sf), "v2"))
    return rounded(zeroes.interpolated_zero(clean, ["no", "no2"], "zero_box", _ORDER,
                                            stat="median").select(*_LEVEL))


@query(_zero_sql("median(no)", "median(no2)", "true", "true", key="station",
                 source=f"(select * from st where ({_case(rules.zeroing_flag(), '0')}) = 0)"))
def interpolated_zero_by_station_cleaned(spark, sf):
    return rounded(zeroes.interpolated_zero(
        products.station_zero_rows(measured(spark, sf)), ["no", "no2"], "zero_box", _ORDER,
        stat="median", by="station").select(*_LEVEL))


@query(f"""with {_M}, {_runs_sql('m', 'so2_zero_channel')},
  g0 as (select run_id, median(so2) as z from runs where run_id > 0 group by 1),
  g as (select run_id, case when z >= 2.5 then z end as zero_so2 from g0),
  f as (select runs.*, zero_so2 from runs left join g using (run_id)),
  {_line_sql('f', ['zero_so2'], 'event_id, so2')}
  select event_id, {_r('zero_so2')}, {_r('so2 - zero_so2', 'so2_corr')} from lines""")
def interpolated_zero_so2(spark, sf):
    out = zeroes.interpolated_zero(measured(spark, sf), ["so2"], "so2_zero_channel", _ORDER,
                                   stat="median", reject={"so2": (2.5, None)})
    return rounded(out.select("event_id", "zero_so2", "so2_corr"))


@query(_zero_sql("avg(no)", "avg(no2)", "true", "true"))
def interpolated_zero_by_day(spark, sf):
    return _level(spark, sf, scan="day")


_DIAG_SQL = f"""{_M}, d0 as (select *, o3 * 6 as co, no + no2 as nox from m),
  d1 as (select *, {_flags_sql('current')} from d0),
  d2 as (select date, event_id, so2, zero_box, flag_all, nox_flag,
    case when flag_all + nox_flag > 0 then 1 else 0 end as flag,
    {_case(rules.no2_zero_drop(), '0')} as zero_flag, no2 as raw_no2 from d1),
  d3 as (select *, case when (zero_box = 1 and zero_flag = 1) is null then null
    when zero_box = 1 and zero_flag = 1 then null else raw_no2 end as no2 from d2),
  {_runs_sql('d3', 'zero_box')},
  g as (select run_id, median(no2) as zero_med_no2, avg(no2) as zero_mean_no2
        from runs where run_id > 0 group by 1)"""


def _diagnostics(spark, sf):
    df = products.instrument_flags(measured(spark, sf).withColumn("co", F.col("o3") * 6))
    return zeroes.zero_diagnostics(df, "no2", ["so2"], _ORDER, rules.no2_zero_drop())


@query(f"""with {_DIAG_SQL},
  f as (select runs.*, zero_med_no2, zero_mean_no2, zero_med_no2 as zero_med_no2_line,
               zero_mean_no2 as zero_mean_no2_line from runs left join g using (run_id)),
  {_line_sql('f', ['zero_med_no2_line', 'zero_mean_no2_line'],
             'event_id, run_id, so2, no2, flag, zero_flag, zero_med_no2, zero_mean_no2')}
  select event_id, cast(run_id as bigint) as id, flag, zero_flag, {_rs('so2', 'no2',
    'zero_med_no2', 'zero_mean_no2', 'zero_med_no2_line', 'zero_mean_no2_line')} from lines""")
def zero_diagnostics(spark, sf):
    return rounded(_diagnostics(spark, sf)[0].select(
        "event_id", "id", "flag", "zero_flag", "so2", "no2", "zero_med_no2", "zero_mean_no2",
        "zero_med_no2_line", "zero_mean_no2_line"))


@query(f"""with {_DIAG_SQL} select {_r('avg(distinct zero_mean_no2)', 'zero_mean_no2_mean')},
  {_r('stddev_samp(distinct zero_mean_no2)', 'zero_mean_no2_sd')},
  {_r('avg(distinct zero_med_no2)', 'zero_med_no2_mean')},
  {_r('stddev_samp(distinct zero_med_no2)', 'zero_med_no2_sd')}
  from g where zero_mean_no2 is not null""")
def zero_diagnostics_spread(spark, sf):
    return rounded(_diagnostics(spark, sf)[1])


# detection limits and calibration -------------------------------------------

_LOD_SQL = f"""with {_STATUS_SQL}, {_runs_sql('st', 'zb')},
  l as (select run_id, 2 * case when count(o3) = count(*) then stddev_samp(o3) end as no_sd,
    2 * case when count(so2) = count(*) then stddev_samp(so2) end as no2_sd
    from runs where {{}} group by 1),
  l2 as (select *, sqrt(no_sd * no_sd + no2_sd * no2_sd) as nox_sd from l)
  select cast(run_id as bigint) as id, {_rs('no_sd', 'no2_sd', 'nox_sd')},
    {_r('no_sd / sqrt(6)', 'no_lod')}, {_r('no2_sd / sqrt(6)', 'no2_lod')},
    {_r('nox_sd / sqrt(6)', 'nox_lod')} from l2"""


def _complete(spark, sf):
    """Channels without gaps, so that the strict deviations exist."""
    return measured(spark, sf).withColumns({"no": F.col("o3"), "no2": F.col("so2")})


@query(_LOD_SQL.replace("from st)", f"from st where ({_case(rules.zero_job_calibration(), '0')}) = 0)", 1)
       .format("run_id in (4, 16, 28, 37)"))
def lod(spark, sf):
    return rounded(products.detection_limits(_complete(spark, sf), _ORDER))


@query(_LOD_SQL.format("run_id > 0"))
def lod_every_cycle(spark, sf):
    cycles = zeroes.zero_cycles(_complete(spark, sf), "zero_box", _ORDER)
    return rounded(groups.lod(cycles.filter("id > 0"), "no", "no2", ["id"]))


_SENS = {"date": "ts", "event_id": "event_id", "co": "case when event_id % 9 <> 0 then value end",
         "sens": "cast(floor(event_id / 50) as double) + case when event_type = 'error' then 1 else 0 end"}
_SENS_SQL = f"""s0 as ({_select(_SENS)}),
  s1 as (select *, sens - lag(sens) over (order by date, event_id) as change from s0),
  {_runs_sql('s1', 'change', 0)}"""


def _edge_sql(ident: str, edge: int, after: str) -> str:
    return f"""with {_SENS_SQL},
  q as (select *, row_number() over (partition by {ident} order by date, event_id) as a,
    row_number() over (partition by {ident} order by date desc, event_id desc) as b from runs)
  select event_id, {after.format(f'case when a <= {edge} or b <= {edge} then 1 else 0 end')} as co_cal
  from q"""


@query(_edge_sql("carried_id", 2, "case when co is null then 0 else {} end"))
def calibration_from_sensitivity(spark, sf):
    return calibration.calibration_from_sensitivity(
        _derived(spark, sf, _SENS), "sens", _ORDER, edge=2).select("event_id", "co_cal")


@query(_edge_sql("run_id", 199, "{}"))
def calibration_from_sensitivity_pooled(spark, sf):
    return calibration.calibration_from_sensitivity(
        _derived(spark, sf, _SENS), "sens", _ORDER, edge=199, carry=False, scan="day") \
        .select("event_id", "co_cal")


_OVERRIDDEN = " ".join(
    f"when (date > timestamp '{_full(lo)}' and date < timestamp '{_full(hi)}') then 0"
    for lo, hi in rules.NO_CAL_OVERRIDES)
_CAL_SQL = f"""{_M},
  o0 as (select *, case {_OVERRIDDEN} else so2_zero_channel end as c0 from m),
  o as (select *, case when zero_box is null then null when zero_box <> 0 then 0 else c0 end
    as nox_cal from o0)"""


@query(f"with {_CAL_SQL} select event_id, cast(nox_cal as integer) as nox_cal from o")
def override_flag(spark, sf):
    df = measured(spark, sf).withColumn("nox_cal", F.col("so2_zero_channel"))
    return rows.override_flag(df, "nox_cal", rules.NO_CAL_OVERRIDES, "zero_box") \
        .select("event_id", "nox_cal")


def _response_sql(head: int, tail: int, src: str = "o") -> str:
    return f"""with {_CAL_SQL}, {_BLOCKS_SQL}, {_runs_sql(src, 'nox_cal')},
  q as (select *, row_number() over (partition by run_id order by date, event_id) as a,
    row_number() over (partition by run_id order by date desc, event_id desc) as b
    from runs where run_id > 0)
  select cast(run_id as bigint) as id,
    {_r(f'avg(case when a > {head} and b > {tail} then o3 end)', 'o3')} from q group by 1"""


# long calibrations, some of them broken by an unknown or a set zero box
_BLOCK_STATUS = "case when event_id % 40 < 15 then 1 else 0 end"
_BLOCK_BOX = "case when event_id % 400 = 47 then null when event_id % 200 = 88 then 1 else 0 end"
_BLOCKS_SQL = f"""b0 as (select * exclude (zero_box), {_BLOCK_STATUS} as status,
    {_BLOCK_BOX} as zero_box from m),
  b1 as (select *, case {_OVERRIDDEN} else status end as c0 from b0),
  b as (select *, case when zero_box is null then null when zero_box <> 0 then 0 else c0 end
    as nox_cal from b1)"""


def _response(df, **options):
    return rounded(calibration.calibration_response(
        df, "o3", "nox_cal", _ORDER, rules.NO_CAL_OVERRIDES, **options))


@query(_response_sql(6, 2, "b"))
def calibration_response(spark, sf):
    return _response(measured(spark, sf).withColumns(
        {"nox_cal": F.expr(_BLOCK_STATUS), "zero_box": F.expr(_BLOCK_BOX)}))


@query(_response_sql(1, 0))
def calibration_response_short_trim(spark, sf):
    df = measured(spark, sf).withColumn("nox_cal", F.col("so2_zero_channel"))
    return _response(df, head=1, tail=0, scan="day")


# masks, conditions, columns -------------------------------------------------

_NOX_KEPT = "case when nox_flag = 0 and nox_cal = 0 and coalesce(zero_box, 0) = 0 then {} end"


@query(f"""with {_M}, d0 as (select *, o3 * 6 as co, no + no2 as nox from m),
  d1 as (select *, {_flags_sql('current')} from d0)
  select event_id, {_r('case when co_flag = 0 then co end', 'co')},
    {', '.join(_r(_NOX_KEPT.format(c), c) for c in ('no', 'no2', 'nox'))},
    {_r('case when noy_flag = 0 and noy_cal = 0 and noy_zero = 0 then noy end', 'noy')},
    {_r('case when o3_flag = 0 then o3 end', 'o3')}, {_r('so2')} from d1 where flag_all = 0""")
def qc_mask(spark, sf):
    df = products.instrument_flags(measured(spark, sf).withColumn("co", F.col("o3") * 6))
    return rounded(products.qc_mask(df).select("event_id", *products.SPECIES))


_OLDER_MASKED = ("o3", "co", "no_corr", "no2_corr", "so2_corr", "noy")


def _older_masked_sql(value: str) -> str:
    flags = {"o3": "o3_flag", "co": "co_flag co_cal", "no_corr": "nox_flag zero_box nox_cal",
             "no2_corr": "nox_flag zero_box nox_cal", "so2_corr": "so2_flag so2_zero_channel",
             "noy": "noy_cal noy_flag noy_zero"}[value]
    return f"case when {' and '.join(f'{f} = 0' for f in [*flags.split(), 'flag_all'])} then {value} end"


@query(f"""with {_M}, d0 as (select *, no as no_corr, no2 as no2_corr, so2 as so2_corr, o3 * 6 as co,
    case when event_id % 19 <> 0 then cast(event_id % 5 = 0 as integer) end as co_cal from m),
  d1 as (select *, {_flags_sql('v2')} from d0)
  select event_id, {', '.join(_r(_older_masked_sql(c), c) for c in _OLDER_MASKED)} from d1""")
def qc_mask_older(spark, sf):
    df = measured(spark, sf).withColumns({
        "no_corr": F.col("no"), "no2_corr": F.col("no2"), "so2_corr": F.col("so2"),
        "co": F.col("o3") * 6,
        "co_cal": F.expr("case when event_id % 19 <> 0 then cast(event_id % 5 = 0 as integer) end")})
    out = products.qc_mask_older(products.instrument_flags(df, "v2"))
    return rounded(out.select("event_id", *_OLDER_MASKED))


@query("""select event_id, cast(case when event_id % 7 <> 0 then value end < 10 as integer) as flag
  from events""")
def lod_flag(spark, sf):
    value = F.expr("case when event_id % 7 <> 0 then value end")
    return _events(spark, sf).select("event_id", cond.below_limit(value, 10).alias("flag"))


@query(f"""with {_M} select event_id,
  {_r("case when date between timestamp '2022-06-01 00:00:00' and timestamp '2022-06-03 12:00:00' "
      "then null else o3 end", 'o3')} from m""")
def mask_interval(spark, sf):
    return rounded(rows.mask_interval(measured(spark, sf), "o3", "2022-06-01 00:00",
                                      "2022-06-03 12:00").select("event_id", "o3"))


@query("select event_id, case when value between 5 and 60.5 then value end as value from events")
def clip_to_null(spark, sf):
    return rows.clip_to_null(_events(spark, sf), "value", 5, 60.5).select("event_id", "value")


@query(f"""with {_M} select event_id,
  case when zero_box is null then null when zero_box = 1 then 'zero' else 'air' end as two_way,
  case when zero_box = 1 then 'zero' when no > 1 then 'high' else 'air' end as chain,
  case when event_type = 'view' then 1 when event_type = 'click' then 2 end as code from m""")
def conditionals(spark, sf):
    zero = F.col("zero_box") == 1
    return measured(spark, sf).select(
        "event_id", cond.r_ifelse(zero, F.lit("zero"), F.lit("air")).alias("two_way"),
        cond.case_when([(zero, F.lit("zero")), (F.col("no") > 1, F.lit("high"))], "air")
        .alias("chain"), cond.recode(F.col("event_type"), {"view": 1, "click": 2}).alias("code"))


@query(f"""with {_M} select event_id,
  coalesce(zero_box, 0) + so2_zero_channel > 0 as either,
  case when zero_box + so2_zero_channel > 0 then 1
       when zero_box + so2_zero_channel is null then null else 0 end as flag from m""")
def combine_flags(spark, sf):
    zb, so2 = F.col("zero_box"), F.col("so2_zero_channel")
    return measured(spark, sf).select("event_id", cond.any_set([zb, so2]).alias("either"),
                                      cond.combine_flags(zb, so2).alias("flag"))


@query("""select event_id, event_type from events where event_type not in ('error', 'view')""")
def exclude(spark, sf):
    return rows.exclude(_events(spark, sf), "event_type", ["error", "view"]) \
        .select("event_id", "event_type")


@query("""select event_id, event_type from events where event_type in ('error', 'view')""")
def only(spark, sf):
    return rows.only(_events(spark, sf), "event_type", ["error", "view"]) \
        .select("event_id", "event_type")


@query("""select event_id from events where ts > timestamp '2024-01-05 12:00:00'
  and ts < timestamp '2024-01-20 00:00:00'""")
def between_time(spark, sf):
    return rows.between_time(_events(spark, sf), "2024-01-05 12:00", "2024-01-20", time="ts") \
        .select("event_id")


@query(f"""with {_M} select event_id, {_rs('no', 'no2')} from m
  where no is not null and no2 is not null""")
def drop_incomplete(spark, sf):
    return rounded(rows.drop_incomplete(measured(spark, sf).select("event_id", "no", "no2")))


@query("""select 'a' || cast(o_custkey as varchar) as cust_key, o_totalprice as total_price_eur
  from orders where o_orderkey % 3 <> 0""")
def clean_and_remove_empty(spark, sf):
    # a third of the rows and one column hold nothing
    kept = F.col("o_orderkey") % 3 != 0
    df = _table(spark, sf, "orders").select(
        F.when(kept, F.concat(F.lit("a"), F.col("o_custkey"))).alias("Cust Key"),
        F.when(kept, F.col("o_totalprice")).alias("totalPrice (EUR)"),
        F.lit(None).cast("double").alias("Nothing"))
    return rows.remove_empty(rows.clean_names(df))


@query("""select c_custkey as id, c_acctbal as balance, c_mktsegment as segment from customer
  union all select s_suppkey, s_acctbal, null from supplier""")
def union_missing(spark, sf):
    customers = _table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    suppliers = _table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return rows.bind_rows(customers, suppliers)


@query("""select c_custkey as id, c_acctbal as balance from customer
  union all select s_suppkey, s_acctbal from supplier""")
def union_strict(spark, sf):
    customers = rows.rename_channels(_table(spark, sf, "customer").select("c_custkey", "c_acctbal"),
                                     {"c_custkey": "id", "c_acctbal": "balance"})
    suppliers = rows.rename_channels(_table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"),
                                     {"s_suppkey": "id", "s_acctbal": "balance"})
    return rows.bind_rows(customers, suppliers, strict=True)


@query(f"""with {_M} select event_id, 'no' as name, {_r('no', 'value')} from m
  union all select event_id, 'no2', {_r('no2', 'value')} from m
  union all select event_id, 'o3', {_r('o3', 'value')} from m""")
def species_long(spark, sf):
    return rounded(products.species_table(measured(spark, sf), ["no", "no2", "o3"], ["event_id"]))


@query(f"""with {_M} select date, {_r('o3', 'value')}, 'O3' as species from m
  union all select ts - INTERVAL '592' DAY, {_r('value / 0.3117', 'value')}, 'CO' from events""")
def tagged_union(spark, sf):
    return rounded(rows.tagged_union({"O3": (measured(spark, sf), "o3"),
                                      "CO": (co_table(spark, sf), "co_calibrated")}))


# instants and angles --------------------------------------------------------

@query("select event_id, date_trunc('second', ts + interval 500 millisecond) as date from events")
def round_second(spark, sf):
    return _events(spark, sf).select("event_id", times.round_second(F.col("ts")).alias("date"))


@query("select event_id, ts - interval 1 hour as date from events")
def shift_clock(spark, sf):
    return _events(spark, sf).select("event_id", times.shift(F.col("ts"), -1).alias("date"))


@query("select event_id, cast(hour(ts) as integer) as hour from events")
def hour_of_day(spark, sf):
    return _events(spark, sf).select("event_id", F.hour("ts").alias("hour"))


@query("select event_id, date_trunc('minute', ts) as date from events")
def floor_minute(spark, sf):
    return _events(spark, sf).select("event_id", times.time_bin(F.col("ts"), "1 minute").alias("date"))


@query("""select event_id, date_trunc('second', ts) as ymd, date_trunc('second', ts) as mdy,
  date_trunc('second', ts) as dmy, cast(null as timestamp) as bad from events""")
def parse_instants(spark, sf):
    ts = F.col("ts")
    return _events(spark, sf).select(
        "event_id",
        times.parse_ymd_hms(F.date_format(ts, "yyyy/MM/dd HH-mm-ss")).alias("ymd"),
        times.parse_mdy_hms(F.date_format(ts, "MM/dd/yyyy HH:mm:ss")).alias("mdy"),
        times.parse_dmy_hms(times.join_text(F.date_format(ts, "dd/MM/yyyy"),
                                            F.date_format(ts, "H:m:s"))).alias("dmy"),
        times.parse_mdy_hms(F.date_format(ts, "yyyy-MM-dd")).alias("bad"))


@query("""select event_id, (user_id * 7) % 720 - case when (user_id * 7) % 720 >= 360 then 360 else 0
  end as wrapped, (round((degrees(atan2(value, user_id - 200)) + 360) % 360, 6) % 360) + 0.0 as direction
  from events""")
def wrap_angle(spark, sf):
    df = _events(spark, sf).select(
        "event_id", wrap_once((F.col("user_id") * 7) % 720).alias("wrapped"),
        direction_of(F.col("value"), (F.col("user_id") - 200).cast("double")).alias("direction"))
    return rounded(df).withColumn("direction", F.col("direction") % 360)


# files ----------------------------------------------------------------------

@query(f"""with {_M} select event_id, date_trunc('second', date) as date, {_r('no')}, zero_box,
  case when event_type = 'view' then null else event_type end as event_type from m""")
def csv_table(spark, sf):
    """Written and read back; two texts stand for a missing value."""
    path = new_folder(spark, "csv")
    text = measured(spark, sf).select(
        "event_id", F.date_trunc("second", "date").cast("timestamp_ntz").alias("date"),
        F.coalesce(F.col("no").cast("string"), F.lit("NA")).alias("no"),
        F.coalesce(F.col("zero_box").cast("string"), F.lit("missing")).alias("zero_box"),
        F.when(F.col("event_type") == "view", "missing").otherwise(F.col("event_type"))
        .alias("event_type"))
    tables.write_table(text, path, "csv", sort_by=["date", "event_id"])
    schema = (StructType().add("event_id", LongType()).add("date", TimestampNTZType())
              .add("no", DoubleType()).add("zero_box", IntegerType()))
    return rounded(tables.read_table(spark, path, schema))


@query(f"""with {_M} select date_trunc('hour', date) as date, {_r('avg(no)', 'no')} from m group by 1""")
def parquet_by_day(spark, sf):
    """Written in one folder per day, read back and averaged."""
    path = new_folder(spark, "daily")
    tables.write_table(measured(spark, sf).select("date", "no"), path)
    return rounded(timebin.time_average(spark.read.parquet(path), "1 hour", columns=["no"]))


#: Fields of a raw line, some of which cannot be converted, and what follows the last one.
_RAW = {
    "event_id": "cast(event_id as varchar(20))",
    "date": "case when event_id % 23 = 0 then 'yesterday' when event_id % 29 = 0 then 'NA' "
            "else substr(cast(ts as varchar(30)), 1, 19) end",
    "no": "case when event_id % 7 = 0 then 'missing' when event_id % 11 = 0 then '1,5' "
          "when event_id % 13 = 0 then '<0.3' when event_id % 17 = 0 then 'NaN' "
          "else cast(event_id % 100 as varchar(20)) end",
    "zero_box": "case when event_id % 19 = 0 then '1.5' else '1' end",
}
_TAIL = "case when event_id % 31 = 0 then ',more' when event_id % 37 = 0 then ',a,b' else '' end"


@query(f"""with r as (select {', '.join(f'{e} as "{n}"' for n, e in _RAW.items())}, {_TAIL} as tail,
    event_id % 41 = 0 as short from events),
  f as (select *, case when not short then zero_box end as z from r)
  select count(*) as n_rows, count(*) filter (short) as n_short,
    count(*) filter (not short and tail <> '') as n_long, cast(0 as bigint) as n_lost_event_id,
    count(*) filter ("date" = 'yesterday') as n_lost_date,
    count(*) filter (no in ('1,5', '<0.3')) as n_lost_no,
    count(*) filter (z = '1.5') as n_lost_zero_box from f""")
def csv_losses(spark, sf):
    """What a reader could not convert, counted while the table is written."""
    path, out = new_folder(spark, "raw"), new_folder(spark, "typed")
    quoted = {n: f"concat('\"', {e}, '\"')" if n == "no" else e for n, e in _RAW.items()}
    whole = F.concat(F.concat_ws(",", *[F.expr(e) for e in quoted.values()]), F.expr(_TAIL))
    short = F.concat_ws(",", *[F.expr(e) for e in list(quoted.values())[:3]])
    lines = _events(spark, sf).select(F.when(F.col("event_id") % 41 == 0, short).otherwise(
        whole).alias(",".join(_RAW)))
    # no field holds a tab, so the lines are written as they are
    lines.write.options(header=True, sep="\t", quote="\0").csv(path)
    schema = (StructType().add("event_id", LongType()).add("date", TimestampNTZType())
              .add("no", DoubleType()).add("zero_box", IntegerType()))
    seen = Observation()
    tables.read_table(spark, path, schema, observe=seen).write.parquet(out)
    return spark.createDataFrame([seen.get])


@query("""select row_number() over (order by date_trunc('second', ts - INTERVAL '592' DAY), event_id)
    as line, event_id from events""")
def csv_order(spark, sf):
    """The numbers of the lines of a sorted sink, over all its files."""
    path = new_folder(spark, "sorted")
    tables.write_table(measured(spark, sf).select(
        F.date_trunc("second", "date").cast("timestamp_ntz").alias("date"), "event_id"),
        path, "csv", sort_by=["date", "event_id"])
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n")).where("value <> 'date,event_id'")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file").orderBy("block", "n"))
    return lines.withColumn("inside", inside).join(files, "file").select(
        (F.col("before") + F.col("inside")).alias("line"),
        F.split("value", ",")[1].cast("bigint").alias("event_id"))


def _log_files(spark, sf):
    """Two sets of logger files, the first an hour ahead of UTC and with two headers."""
    base = _events(spark, sf)

    def written(ahead, types, columns):
        path = new_folder(spark, "logs")
        stamp = times.shift(F.col("ts"), ahead)
        tables.write_table(base.filter(F.col("event_type").isin(*types)).select(
            F.date_format(stamp, "MM/dd/yyyy HH:mm:ss").alias("TheTime"),
            F.col("event_id").alias("Event ID"),
            F.when(F.col("event_id") % 7 == 0, "missing")
            .otherwise(F.col("value").cast("string")).alias("t200up_023828_no"),
            (F.col("value") * 2).alias("Late Channel"),
            F.lit("NA").alias("Unused")).select(*columns), path, "csv")
        return path

    first = ("TheTime", "Event ID", "t200up_023828_no", "Unused")
    later = ("TheTime", "Late Channel", "t200up_023828_no", "Event ID", "Unused")
    return [([written(1, ["error"], first), written(1, ["view"], later)], 1),
            (written(0, ["click", "signup", "purchase"], later), 0)]


@query("""select date_trunc('second', ts) as date, cast(event_id as double) as event_id,
  case when event_id % 7 <> 0 then value end as no,
  case when event_type <> 'error' then value * 2 end as late_channel from events""")
def harmonise_logs(spark, sf):
    return logs.harmonise_logs(spark, _log_files(spark, sf), rules.LOGGER_CHANNELS)


@query(f"""with w as (select date_trunc('second', date) as date, * exclude (date)
    from ({_select(_MET)}) q)
  select date, {_rs('n.lat', 'n.long', 'n.speed', 'n.heading', 's.rel_ws', 's.rel_wd', 's.air_temp',
                    's.air_humidity').replace(' as n.', ' as ').replace(' as s.', ' as ')}
  from w n left join w s using (date)""")
def compile_met(spark, sf):
    """Headerless surface files and position files, joined on the second."""
    folder = new_folder(spark, "met")
    rows_ = met(spark, sf).withColumn("date", times.time_bin(F.col("date"), "1 second"))
    blank = F.lit("")
    (rows_.select(
        blank.alias("a"), F.date_format("date", "dd/MM/yyyy").alias("b"),
        F.date_format("date", "HH:mm:ss").alias("c"),
        *[blank.alias(f"f{i}") for i in range(7)],
        "rel_ws", "rel_wd", "air_temp", "air_humidity").write.csv(f"{folder}/surface"))
    tables.write_table(rows_.select(F.lit(1).alias("X"), "date", "lat", "long", "speed",
                                    "heading"), f"{folder}/mvpos", "csv")
    return rounded(logs.compile_met(logs.compile_navigation(spark, f"{folder}/mvpos", glob="*.csv"),
                                    logs.compile_surface_met(spark, f"{folder}/surface")))


# products -------------------------------------------------------------------

_MINUTE_SQL = f"""{_M}, {_TRUE_WIND_SQL}, {_WIND_MINUTE_SQL},
  g0 as (select date_trunc('second', date + interval 500 millisecond) as date, so2, noy, no, no2,
    zero_box, so2_zero_channel, o3 from m),
  g1 as (select *, {_STATION} as station from g0),
  g2 as (select date, so2, noy, zero_box, so2_zero_channel, o3, {_offset_sql('no')} as no_c,
    {_offset_sql('no2')} as no2_c from g1),
  g as (select date_trunc('minute', date) as date, avg(so2) as so2, avg(noy) as noy,
    avg(zero_box) as zero_box, avg(so2_zero_channel) as so2_zero_channel, avg(o3) as o3,
    avg(no_c) as no, avg(no2_c) as no2 from g2 group by 1),
  c0 as (select date_trunc('second', ts - INTERVAL '592' DAY + interval 500 millisecond) as date,
    value / 0.3117 as co from events),
  c as (select * from c0 where date < timestamp '2022-06-22 10:13:00')"""


def _product_sql(join: str) -> str:
    return f"""{_MINUTE_SQL}, j as ({join}),
  k as (select *, no + no2 as nox from j),
  f as (select *, {_flags_sql('current')}, {_STATION} as station,
    {_STACK_CODE.format(_PLUME)} as stack_flag from k),
  p as (select date, stack_flag, so2, case when co_flag = 0 then co end as co,
    case when nox_flag = 0 and nox_cal = 0 and coalesce(zero_box, 0) = 0 then no end as no,
    case when nox_flag = 0 and nox_cal = 0 and coalesce(zero_box, 0) = 0 then no2 end as no2,
    case when nox_flag = 0 and nox_cal = 0 and coalesce(zero_box, 0) = 0 then nox end as nox,
    case when noy_flag = 0 and noy_cal = 0 and noy_zero = 0 then noy end as noy,
    case when o3_flag = 0 then o3 end as o3 from f where flag_all = 0)"""


_LEFT = "select * from wm left join c using (date) left join g using (date)"
_FULL = "select * from wm full join c using (date) full join g using (date)"
_SPECIES = list(products.SPECIES)


def _inputs(spark, sf):
    return measured(spark, sf), co_table(spark, sf), true_wind(met(spark, sf).drop("event_id"))


@query(f"""with {_product_sql(_LEFT)} select date_trunc('hour', date) as date,
  {', '.join(_r(f'avg({s})', f'{s}_ppb') for s in _SPECIES)}, {_r('avg(stack_flag)', 'stack_flag')}
  from p group by 1""")
def hourly_product(spark, sf):
    return rounded(products.hourly_product(*_inputs(spark, sf)))


@query(f"""with {_product_sql(_FULL)} select date, stack_flag,
  {', '.join(_r(s, f'{s}_ppb') for s in _SPECIES)},
  0.00687::double as no_lod, 0.00687::double as noy_lod, 0.00988::double as no2_lod,
  0.012::double as nox_lod, cast(no < 0.00687 as integer) as no_flag,
  cast(no2 < 0.00988 as integer) as no2_flag, cast(noy < 0.00687 as integer) as noy_flag,
  cast(nox < 0.012 as integer) as nox_flag from p""")
def minute_product(spark, sf):
    return rounded(products.minute_product(*_inputs(spark, sf)))


@query(f"""with {_product_sql(_LEFT.replace('join c', 'join cm'))
                 .replace("), j as (", "), cm as (select date_trunc('minute', date) as date, "
                          "avg(co) as co from c group by 1), j as (")}
  select date_trunc('hour', date) as date,
  {', '.join(_r(f'avg({c})', f'{c}_ppb') for c in _SPECIES)}, {_r('avg(stack_flag)', 'stack_flag')}
  from p group by 1""")
def hourly_product_binned_co(spark, sf):
    return rounded(products.hourly_product(*_inputs(spark, sf), bin_first=True))


@query(f"""with {_product_sql(_LEFT)} select date, station, stack_flag,
  {', '.join(f'{f}' for f in _FLAG_NAMES)}, {_rs('nox', 'rel_ws')} from f""")
def minute_table_flagged(spark, sf):
    table = products.flagged_table(products.minute_table(*_inputs(spark, sf)))
    return rounded(table.select("date", "station", "stack_flag", *_FLAG_NAMES, "nox", "rel_ws"))


@query(f"""with {_MINUTE_SQL} select date, {_rs('so2', 'noy', 'zero_box', 'so2_zero_channel', 'o3',
  'no', 'no2')} from g""")
def corrected_minutes(spark, sf):
    return rounded(products.corrected_minutes(measured(spark, sf)))


def _older_minute_sql(where: str = "true") -> str:
    return f"""with {_M}, a as (select date_trunc('minute', date) as date,
    case when count(no) = count(*) then avg(no) end as no,
    case when count(o3) = count(*) then avg(o3) end as o3,
    avg(so2_zero_channel) as co_cal from m where {where} group by 1)
  select date, {_rs('no', 'o3')}, {_r("case when date < timestamp '2022-05-19 00:00:00' then 0 "
                                      "else co_cal end", 'co_cal')}, {_flags_sql('v1')} from a"""


def _older_minutes(spark, sf, **options):
    return rounded(products.older_one_minute(measured(spark, sf).select(
        "date", "no", "o3", F.col("so2_zero_channel").alias("co_cal")), **options))


@query(_older_minute_sql())
def older_one_minute(spark, sf):
    return _older_minutes(spark, sf)


@query(_older_minute_sql("date > timestamp '2022-05-26 00:00:00'"))
def older_one_minute_since(spark, sf):
    return _older_minutes(spark, sf, since="2022-05-26")


_OLDER_FLAGS = [f for f in rules.flag_rules("v2") if f != "co_flag"]
_OLDER_VALUES = ["o3", "no_corr", "no2_corr", "noy"]


@query(f"""with {_M},
  d0 as (select *, no - (-0.0363139655120056) as no_corr, no2 - (-0.134759009068831) as no2_corr,
    so2 as so2_corr from m),
  d1 as (select *, {_flags_sql('v2')}, {_case(rules.pollution(), '0')} as pollution from d0),
  d2 as (select date_trunc('second', date + interval 500 millisecond) as date, no, no2, zero_box,
    so2_zero_channel, pollution, {', '.join(_OLDER_FLAGS)},
    {', '.join(f'{_older_masked_sql(c)} as {c}' for c in [*_OLDER_VALUES, 'so2_corr'])} from d1),
  d3 as (select date_trunc('minute', date) as date, {', '.join(
      f'avg({c}) as {c}' for c in ['no', 'no2', 'zero_box', 'so2_zero_channel', 'pollution',
                                   *_OLDER_FLAGS, *_OLDER_VALUES])}, avg(so2_corr) as so2
    from d2 group by 1),
  c0 as (select date_trunc('second', ts - INTERVAL '592' DAY + interval 500 millisecond) as date,
    value / 0.3117 as co from events),
  c1 as (select *, {_case(rules.flag_rules('v2')['flag_all'], '0')} as co_flag_all,
    {_case(rules.flag_rules('v2')['co_flag'], '0')} as co_flag from c0
    where date < timestamp '2022-06-22 10:13:00'),
  c as (select * replace (case when co_flag_all = 0 and co_flag = 0 then co end as co) from c1)
  select date, co_flag_all, co_flag, {_rs('no', 'no2', 'zero_box', 'so2_zero_channel', 'pollution',
    *_OLDER_FLAGS, *_OLDER_VALUES, 'so2', 'co')} from d3 left join c using (date)""")
def older_minute_product(spark, sf):
    return rounded(products.older_minute_product(measured(spark, sf), co_table(spark, sf)))


@query(f"""with {_M} select event_id,
  {_case([*rules.flag_rules('v1')['flag_all'], *rules.pollution()], '0')} as flag_all from m""")
def instrument_flags_with_pollution(spark, sf):
    return products.instrument_flags(measured(spark, sf), "v1", polluted=True) \
        .select("event_id", "flag_all")


_HOUSEKEEPING = ("samp_pressure", "samp_flow", "rcell_temp", "box_temp", "pmt_temp")


@query(f"""with {_M} select date_trunc('second', date + interval 500 millisecond) as date, {_r('so2')},
  {', '.join(_r(f'o3 * {i}', name) for i, name in enumerate(_HOUSEKEEPING, 1))},
  cast(null as double) as conv_temp, so2_zero_channel from m""")
def so2_diagnostics(spark, sf):
    """The last channel is absent from the input."""
    channels = list(products.SO2_DIAGNOSTICS)[:-1]
    raw = measured(spark, sf).withColumns(
        {c: F.col("o3") * i for i, c in enumerate(channels, 1)})
    return rounded(products.so2_diagnostics(raw))


@query(f"""with {_product_sql(_LEFT)} select date, {_rs('so2', 'so2_zero_channel')},
  case when flag_all = 1 or so2_flag = 1 then 1 else 0 end as flag,
  case when stack_flag = 0 then 0 else 1 end as ship_flag from f""")
def so2_flags(spark, sf):
    table = products.flagged_table(products.minute_table(*_inputs(spark, sf)))
    return rounded(products.so2_flags(table))
