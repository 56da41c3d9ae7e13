"""Registered queries: key -> (Spark callable, SQL twin or None).

Each callable takes ``(spark, sf_dir)``, builds the domain views from the
test tables of that scale and returns a DataFrame. Results are passed through
``presentable`` so both engines emit the same column types: dates and
timestamps as text, doubles rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DecimalType, DoubleType, FloatType,
                               TimestampNTZType, TimestampType)

from delaylens.operators import prepare as P
from delaylens.operators import stats as S
from delaylens.plans.oracle import D, R, TS, with_views
from delaylens.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def round6(c):
    """Round half up to 6 decimals with plain IEEE steps (multiply, add,
    floor, divide) so every engine yields the same double; NaN and huge
    values pass through."""
    return F.when(F.abs(c) < 1e12, F.floor(c * 1e6 + 0.5) / 1e6).otherwise(c)


def presentable(df: DataFrame) -> DataFrame:
    """One projection (a single ``selectExpr``) with engine-neutral types."""
    exprs = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        t = f.dataType
        if isinstance(t, DateType):
            e = f"date_format({c}, 'yyyy-MM-dd')"
        elif isinstance(t, (TimestampType, TimestampNTZType)):
            e = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        elif isinstance(t, (DoubleType, FloatType, DecimalType)):
            v = f"CAST({c} AS DOUBLE)"
            e = f"CASE WHEN abs({v}) < 1e12 THEN floor({v} * 1e6 + 0.5D) / 1e6 ELSE {v} END"
        else:
            e = c
        exprs.append(f"{e} AS {c}")
    return df.selectExpr(*exprs)


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = lambda spark, sf_dir: presentable(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = with_views(sql)
        return fn
    return deco


# ---------------------------------------------------------------- domain views
def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixtures.load_views(spark, sf_dir)


def prepared(spark, sf_dir) -> DataFrame:
    return P.prepare_stop_times(views(spark, sf_dir)["st"])


def merged(spark, sf_dir) -> DataFrame:
    v = views(spark, sf_dir)
    return P.stop_times_with_stops(P.with_stop_keys(v["st"]), v["stops"])


# ------------------------------------------------------------- first slice
@register("hourly_stats", f"""
SELECT {D('date')} AS date, hour, gtfs_stop_id,
       {R('avg(current_stop_dep_delay)')} AS avg_delay,
       count(*) AS count,
       {R('stddev_samp(current_stop_dep_delay)')} AS std_delay
FROM prepared GROUP BY date, hour, gtfs_stop_id
""")
def q_hourly_stats(spark, sf_dir):
    return S.hourly_stats(prepared(spark, sf_dir))


@register("prepare_stop_times", f"""
SELECT rt_trip_id, gtfs_stop_id, {TS('current_stop_departure')} AS current_stop_departure,
       current_stop_dep_delay, gtfs_stop_sequence, gtfs_route_short_name, gtfs_direction_id,
       base_stop_id, {D('date')} AS date, hour
FROM prepared
""")
def q_prepare(spark, sf_dir):
    return prepared(spark, sf_dir)


@register("stop_times_with_stops", f"""
SELECT rt_trip_id, gtfs_stop_id, {TS('current_stop_departure')} AS current_stop_departure,
       current_stop_dep_delay, {TS('current_stop_arrival')} AS current_stop_arrival,
       current_stop_arr_delay, gtfs_stop_sequence, gtfs_route_short_name, gtfs_direction_id,
       {TS('created_at')} AS created_at, {TS('updated_at')} AS updated_at,
       base_stop_id, {D('date')} AS date, hour, stop_name,
       {R('avg_latitude')} AS avg_latitude, {R('avg_longitude')} AS avg_longitude
FROM merged
""")
def q_merged(spark, sf_dir):
    return merged(spark, sf_dir)


# ------------------------------------------------------------ statistics tab
@register("daily_stats", f"""
SELECT {D('date')} AS date, {R('avg(current_stop_dep_delay)')} AS avg_delay,
       {R('stddev_samp(current_stop_dep_delay)')} AS std_delay,
       count(*) AS total_records, count(DISTINCT gtfs_stop_id) AS unique_stops
FROM prepared GROUP BY date
""")
def q_daily_stats(spark, sf_dir):
    return S.daily_stats(prepared(spark, sf_dir))


@register("basic_stats", f"""
SELECT {D('date')} AS date, {R('avg(coalesce(current_stop_dep_delay, 0))')} AS avg_delay,
       max(coalesce(current_stop_dep_delay, 0)) AS max_delay,
       count(DISTINCT base_stop_id) AS total_stops
FROM merged WHERE hour BETWEEN 0 AND 24 GROUP BY date
""")
def q_basic_stats(spark, sf_dir):
    return S.basic_stats(merged(spark, sf_dir))


@register("delay_distribution", f"""
WITH f AS (SELECT date, coalesce(current_stop_dep_delay, 0) AS d FROM merged
           WHERE hour BETWEEN 0 AND 24),
bins AS (SELECT * FROM (VALUES (0, '0-60s'), (1, '60-120s'), (2, '120-180s'),
                               (3, '180-300s'), (4, '>300s')) b(bin_index, delay_range)),
dates AS (SELECT DISTINCT date FROM f)
SELECT {D('dates.date')} AS date, cast(bins.bin_index AS INTEGER) AS bin_index, bins.delay_range,
       (SELECT count(*) FROM f WHERE f.date = dates.date AND
          CASE bins.bin_index WHEN 0 THEN f.d <= 60 WHEN 1 THEN f.d > 60 AND f.d <= 120
                              WHEN 2 THEN f.d > 120 AND f.d <= 180
                              WHEN 3 THEN f.d > 180 AND f.d <= 300 ELSE f.d > 300 END) AS count
FROM dates, bins
""")
def q_delay_distribution(spark, sf_dir):
    return S.delay_distribution(merged(spark, sf_dir))


@register("hourly_trends", f"""
SELECT cast(date AS VARCHAR) AS "Date", hour AS "Hour", {R('avg(current_stop_dep_delay)')} AS avg_delay
FROM merged GROUP BY date, hour
""")
def q_hourly_trends(spark, sf_dir):
    return S.hourly_trends(merged(spark, sf_dir))


_STOP_MAP_SQL = """
SELECT date, base_stop_id, avg(avg_latitude) AS avg_latitude, avg(avg_longitude) AS avg_longitude,
       min(stop_name) AS stop_name, avg(coalesce(current_stop_dep_delay, 0)) AS avg_delay
FROM merged WHERE hour BETWEEN 0 AND 24 GROUP BY date, base_stop_id
"""


@register("stop_map", f"""
WITH m AS ({_STOP_MAP_SQL})
SELECT {D('date')} AS date, base_stop_id, {R('avg_latitude')} AS avg_latitude,
       {R('avg_longitude')} AS avg_longitude, stop_name, {R('avg_delay')} AS avg_delay,
       CASE WHEN avg_delay <= 60 THEN 'green' WHEN avg_delay <= 120 THEN 'yellow'
            WHEN avg_delay <= 180 THEN 'orange' WHEN avg_delay <= 300 THEN 'red'
            ELSE 'darkred' END AS color,
       {R('avg_delay / 60.0')} AS avg_delay_min,
       CASE WHEN avg_latitude IS NOT NULL AND avg_longitude IS NOT NULL THEN
         stop_name || ' - Avg Delay: ' || cast(cast(round_even(avg_delay, 0) AS BIGINT) AS VARCHAR) || ' secs ('
         || cast(cast(round_even(avg_delay / 60.0, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' mins)' END AS tooltip
FROM m
""")
def q_stop_map(spark, sf_dir):
    return S.stop_map(merged(spark, sf_dir))


@register("heatmap_points", f"""
WITH m AS ({_STOP_MAP_SQL})
SELECT {D('date')} AS date, {R('avg_latitude')} AS avg_latitude, {R('avg_longitude')} AS avg_longitude,
       {R('avg_delay / 60.0')} AS avg_delay_min
FROM m WHERE avg_latitude IS NOT NULL AND avg_longitude IS NOT NULL
""")
def q_heatmap_points(spark, sf_dir):
    return S.heatmap_points(S.stop_map(merged(spark, sf_dir)))


@register("map_center", f"""
SELECT {R('avg(avg_latitude)')} AS center_latitude, {R('avg(avg_longitude)')} AS center_longitude
FROM stops
""")
def q_map_center(spark, sf_dir):
    return S.map_center(views(spark, sf_dir)["stops"])


@register("data_freshness", f"""
SELECT {TS('max(updated_at)')} AS last_updated FROM merged
""")
def q_data_freshness(spark, sf_dir):
    return S.data_freshness(merged(spark, sf_dir))


@register("high_water_mark", f"""
SELECT {TS('max(current_stop_departure)')} AS max_departure FROM st
""")
def q_high_water_mark(spark, sf_dir):
    return S.high_water_mark(views(spark, sf_dir)["st"])


@register("newest_sample", f"""
SELECT rt_trip_id, gtfs_stop_id, {TS('current_stop_departure')} AS current_stop_departure,
       current_stop_dep_delay, gtfs_stop_sequence
FROM st ORDER BY current_stop_departure DESC NULLS LAST, rt_trip_id, gtfs_stop_sequence LIMIT 600
""")
def q_newest_sample(spark, sf_dir):
    st = views(spark, sf_dir)["st"].select("rt_trip_id", "gtfs_stop_id", "current_stop_departure",
                                           "current_stop_dep_delay", "gtfs_stop_sequence")
    return S.newest_sample(st, 600)


@register("filter_date_hours", f"""
SELECT {D('date')} AS date, {TS('current_stop_departure')} AS current_stop_departure,
       coalesce(current_stop_dep_delay, 0) AS current_stop_dep_delay, base_stop_id
FROM merged WHERE hour BETWEEN 6 AND 20
""")
def q_filter_date_hours(spark, sf_dir):
    m = merged(spark, sf_dir).select("date", "current_stop_departure", "current_stop_dep_delay",
                                     "base_stop_id")
    return P.filter_date_hours(m, hour_range=(6, 20))


@register("filtered_stop_times", f"""
SELECT p.*, s.stop_name, s.avg_latitude, s.avg_longitude
FROM (SELECT rt_trip_id, gtfs_stop_id, {TS('current_stop_departure')} AS current_stop_departure,
             current_stop_dep_delay, gtfs_stop_sequence, gtfs_route_short_name,
             gtfs_direction_id, base_stop_id, {D('date')} AS date, hour
      FROM prepared WHERE hour BETWEEN 7 AND 19) p
JOIN (SELECT base_stop_id, stop_name, {R('avg_latitude')} AS avg_latitude,
             {R('avg_longitude')} AS avg_longitude FROM stops) s
  ON p.base_stop_id = s.base_stop_id
""")
def q_filtered_stop_times(spark, sf_dir):
    v = views(spark, sf_dir)
    return P.filtered_stop_times(P.prepare_stop_times(v["st"]), v["stops"], hour_range=(7, 19))


@register("last_week_history", f"""
SELECT base_stop_id, gtfs_direction_id, {TS('current_stop_departure')} AS current_stop_departure,
       current_stop_dep_delay
FROM merged
WHERE current_stop_departure >= TIMESTAMP '2024-01-15 08:00:00' - INTERVAL 7 DAY
  AND current_stop_departure < TIMESTAMP '2024-01-15 08:00:00'
""")
def q_last_week_history(spark, sf_dir):
    return P.last_week_history(merged(spark, sf_dir), "2024-01-15 08:00:00")


@register("distinct_values", """
SELECT DISTINCT base_stop_id FROM merged WHERE base_stop_id IS NOT NULL
""")
def q_distinct_values(spark, sf_dir):
    return P.distinct_values(merged(spark, sf_dir), "base_stop_id")


# ------------------------------------------------------------------- trips
from delaylens.operators import trips as T  # noqa: E402

_ORDER = "PARTITION BY rt_trip_id ORDER BY gtfs_stop_sequence, current_stop_departure, gtfs_stop_id"

_PROCESSED_SQL = f"""
shifted AS (
  SELECT *, row_number() OVER ({_ORDER}) AS place,
         make_timestamp(epoch_us(current_stop_departure) + 1000000 * CAST(current_stop_dep_delay AS BIGINT)) AS real_departure,
         if(current_stop_arr_delay IS NULL, real_departure,
            make_timestamp(epoch_us(current_stop_arrival) + 1000000 * CAST(current_stop_arr_delay AS BIGINT))) AS real_arrival
  FROM __SRC__
),
processed AS (
  SELECT here.* EXCLUDE (place), before.gtfs_stop_id AS previous_stop_id,
         before.current_stop_arrival AS previous_stop_arrival, before.current_stop_departure AS previous_stop_departure,
         before.real_departure AS real_previous_stop_departure,
         (epoch_us(here.current_stop_arrival) - epoch_us(before.current_stop_departure)) / 1e6 AS planned_travel_time_seconds,
         (epoch_us(here.real_arrival) - epoch_us(before.real_departure)) / 1e6 AS real_travel_time_seconds,
         concat_ws('_', before.gtfs_stop_id, if(before.gtfs_stop_id IS NULL, NULL, here.gtfs_stop_id)) AS joined_ids,
         nullif(joined_ids, '') AS section_id
  FROM shifted here LEFT JOIN shifted before ON before.rt_trip_id = here.rt_trip_id AND before.place = here.place - 1
)"""


def processed_sql(src: str = "st") -> str:
    return _PROCESSED_SQL.replace("__SRC__", src)


@register("segments", f"""
WITH numbered AS (SELECT rt_trip_id, gtfs_stop_id, gtfs_stop_sequence, row_number() OVER ({_ORDER}) AS place FROM st)
SELECT b.rt_trip_id, b.gtfs_stop_sequence, a.gtfs_stop_id AS previous_stop_id, b.gtfs_stop_id AS current_stop_id,
       concat(a.gtfs_stop_id, '_', b.gtfs_stop_id) AS segment_id_full,
       concat(regexp_replace(a.gtfs_stop_id, 'Z.*', ''), '_', regexp_replace(b.gtfs_stop_id, 'Z.*', '')) AS segment_id_short
FROM numbered a JOIN numbered b ON a.rt_trip_id = b.rt_trip_id AND b.place = a.place + 1
""")
def q_segments(spark, sf_dir):
    return T.segments(views(spark, sf_dir)["st"])


_PROCESSED_COLS = f"""
  rt_trip_id, gtfs_stop_id, {TS('current_stop_departure')} AS current_stop_departure,
  current_stop_dep_delay, {TS('current_stop_arrival')} AS current_stop_arrival, current_stop_arr_delay,
  gtfs_stop_sequence, gtfs_route_short_name, gtfs_direction_id,
  {TS('created_at')} AS created_at, {TS('updated_at')} AS updated_at,
  {TS('real_departure')} AS real_departure, {TS('real_arrival')} AS real_arrival,
  {TS('previous_stop_departure')} AS previous_stop_departure,
  {TS('previous_stop_arrival')} AS previous_stop_arrival, previous_stop_id,
  {TS('real_previous_stop_departure')} AS real_previous_stop_departure,
  {R('real_travel_time_seconds')} AS real_travel_time_seconds,
  epoch_us(real_arrival) - epoch_us(real_previous_stop_departure) AS real_travel_time_us,
  {R('planned_travel_time_seconds')} AS planned_travel_time_seconds, section_id"""


@register("trip_travel_times", f"""
WITH {processed_sql()}
SELECT {_PROCESSED_COLS} FROM processed
""")
def q_trip_travel_times(spark, sf_dir):
    return T.trip_travel_times(views(spark, sf_dir)["st"])


@register("trip_lags", f"""
WITH {processed_sql()}
SELECT rt_trip_id, gtfs_stop_sequence, {TS('previous_stop_departure')} AS previous_stop_departure,
       {TS('previous_stop_arrival')} AS previous_stop_arrival, previous_stop_id,
       {TS('real_previous_stop_departure')} AS real_previous_stop_departure
FROM processed
""")
def q_trip_lags(spark, sf_dir):
    return T.trip_travel_times(views(spark, sf_dir)["st"]).select(
        "rt_trip_id", "gtfs_stop_sequence", "previous_stop_departure", "previous_stop_arrival",
        "previous_stop_id", "real_previous_stop_departure")


@register("next_stop_lead", f"""
SELECT rt_trip_id, gtfs_stop_sequence, gtfs_stop_id,
       lead(gtfs_stop_id) OVER ({_ORDER}) AS next_stop
FROM st
""")
def q_next_stop_lead(spark, sf_dir):
    return T.with_next_stop(views(spark, sf_dir)["st"]).select(
        "rt_trip_id", "gtfs_stop_sequence", "gtfs_stop_id", "next_stop")


@register("trip_segment_summary", f"""
WITH {processed_sql()},
agg AS (
  SELECT rt_trip_id, section_id,
    arg_min(current_stop_departure, gtfs_stop_sequence) FILTER (WHERE current_stop_departure IS NOT NULL) AS planned_start_time,
    arg_max(current_stop_arrival, gtfs_stop_sequence) FILTER (WHERE current_stop_arrival IS NOT NULL) AS planned_end_time,
    arg_min(real_departure, gtfs_stop_sequence) FILTER (WHERE real_departure IS NOT NULL) AS actual_start_time,
    arg_max(real_arrival, gtfs_stop_sequence) FILTER (WHERE real_arrival IS NOT NULL) AS actual_end_time
  FROM processed WHERE section_id IS NOT NULL GROUP BY rt_trip_id, section_id
)
SELECT rt_trip_id, section_id,
  {TS('planned_start_time')} AS planned_start_time, {TS('planned_end_time')} AS planned_end_time,
  {TS('actual_start_time')} AS actual_start_time, {TS('actual_end_time')} AS actual_end_time,
  {R('(epoch_us(planned_end_time) - epoch_us(planned_start_time)) / 1e6')} AS planned_travel_time_seconds,
  {R('(epoch_us(actual_end_time) - epoch_us(actual_start_time)) / 1e6')} AS actual_travel_time_seconds,
  {R('(epoch_us(actual_start_time) - epoch_us(planned_start_time)) / 1e6')} AS delay_seconds
FROM agg
""")
def q_trip_segment_summary(spark, sf_dir):
    return T.trip_segment_summary(T.trip_travel_times(views(spark, sf_dir)["st"]))


_SEGROW_COLS = f"""rt_trip_id, gtfs_stop_sequence, gtfs_direction_id,
  {TS('current_stop_departure')} AS current_stop_departure,
  {R('real_travel_time_seconds')} AS real_travel_time_seconds, segment_id_full, segment_id_short"""


@register("segment_rows", f"""
WITH {processed_sql()}
SELECT {_SEGROW_COLS} FROM (
  SELECT *, previous_stop_id || '_' || gtfs_stop_id AS segment_id_full,
         split_part(previous_stop_id, 'Z', 1) || '_' || split_part(gtfs_stop_id, 'Z', 1) AS segment_id_short
  FROM processed WHERE previous_stop_id IS NOT NULL)
""")
def q_segment_rows(spark, sf_dir):
    return T.segment_rows(views(spark, sf_dir)["st"], "edge").select(
        "rt_trip_id", "gtfs_stop_sequence", "gtfs_direction_id", "current_stop_departure",
        "real_travel_time_seconds", "segment_id_full", "segment_id_short")


@register("segment_rows_trip", f"""
WITH {processed_sql()},
s AS (SELECT rt_trip_id, lag(gtfs_stop_id) OVER ({_ORDER}) AS p, gtfs_stop_id AS c FROM st)
SELECT {_SEGROW_COLS} FROM (
  SELECT processed.*, s.p || '_' || s.c AS segment_id_full,
         split_part(s.p, 'Z', 1) || '_' || split_part(s.c, 'Z', 1) AS segment_id_short
  FROM processed JOIN s ON processed.rt_trip_id = s.rt_trip_id WHERE s.p IS NOT NULL)
""")
def q_segment_rows_trip(spark, sf_dir):
    return T.segment_rows(views(spark, sf_dir)["st"], "trip").select(
        "rt_trip_id", "gtfs_stop_sequence", "gtfs_direction_id", "current_stop_departure",
        "real_travel_time_seconds", "segment_id_full", "segment_id_short")


@register("next_stop", f"""
WITH n AS (SELECT base_stop_id, gtfs_direction_id,
                  lead(gtfs_stop_id) OVER ({_ORDER}) AS next_stop FROM merged),
c AS (SELECT base_stop_id, gtfs_direction_id, next_stop, count(*) AS cnt
      FROM n WHERE next_stop IS NOT NULL GROUP BY base_stop_id, gtfs_direction_id, next_stop),
r AS (SELECT *, row_number() OVER (PARTITION BY base_stop_id, gtfs_direction_id
                                   ORDER BY cnt DESC, next_stop) AS rn FROM c),
b AS (SELECT base_stop_id, gtfs_direction_id, next_stop AS next_stop_id,
             CASE WHEN regexp_matches(next_stop, '[SZ]')
                  THEN regexp_extract(next_stop, '^([^SZ]*)', 1) END AS next_base_stop_id
      FROM r WHERE rn = 1)
SELECT b.*, s.stop_name AS next_stop_name FROM b LEFT JOIN stops s ON s.base_stop_id = b.next_base_stop_id
""")
def q_next_stop(spark, sf_dir):
    v = views(spark, sf_dir)
    return T.next_stop(P.stop_times_with_stops(P.with_stop_keys(v["st"]), v["stops"]), v["stops"])


# ------------------------------------------------------------------ events
from delaylens.operators import events as EV  # noqa: E402


def calendar(spark, sf_dir) -> DataFrame:
    return EV.match_calendar(views(spark, sf_dir)["matches_raw"])


def _merged_cal(spark, sf_dir):
    v = views(spark, sf_dir)
    return (merged(spark, sf_dir),
            EV.match_calendar(v["matches_raw"]))


_FLAG_SQL = """
md AS (SELECT DISTINCT cast(kickoff AS DATE) AS d FROM matches),
f AS (SELECT m.*, current_stop_dep_delay AS x,
             coalesce(cast(current_stop_departure AS DATE) IN (SELECT d FROM md), false) AS is_event
      FROM merged m)"""

_CELLS_SQL = """
offs2 AS (SELECT * FROM (VALUES ('Match Day', 0), ('Week Before', -7)) o(comparison, off)),
cal2 AS (SELECT kickoff, cast(hour(kickoff) AS INTEGER) AS kickoff_hour, is_home, comparison,
                cast(kickoff AS DATE) + off AS day FROM matches, offs2),
cells AS (SELECT cal2.kickoff, cal2.kickoff_hour, cal2.is_home, cal2.comparison,
                 cast(hour(m.current_stop_departure) AS INTEGER) AS hour,
                 sum(m.current_stop_dep_delay) AS s, count(m.current_stop_dep_delay) AS c,
                 count(*) AS n
          FROM merged m JOIN cal2 ON cast(m.current_stop_departure AS DATE) = cal2.day
          GROUP BY cal2.kickoff, cal2.kickoff_hour, cal2.is_home, cal2.comparison,
                   hour(m.current_stop_departure))"""


@register("event_flag", f"""
WITH {_FLAG_SQL}
SELECT rt_trip_id, gtfs_stop_sequence, {D('date')} AS date, is_event FROM f
""")
def q_event_flag(spark, sf_dir):
    m, cal = _merged_cal(spark, sf_dir)
    return EV.event_flag(m, cal).select("rt_trip_id", "gtfs_stop_sequence", "date", "is_event")


_EVENT_STATS_SQL = f"""
WITH {_FLAG_SQL},
g AS (SELECT is_event, avg(x) AS avg_delay, cast(median(x) AS DOUBLE) AS median_delay,
             max(x) AS max_delay, min(x) AS min_delay, stddev_samp(x) AS std_delay,
             count(x) AS total_records, var_samp(x) AS v
      FROM f GROUP BY is_event),
e AS (SELECT * FROM g WHERE is_event), r AS (SELECT * FROM g WHERE NOT is_event),
w AS (SELECT
        CASE WHEN e.total_records > 1 AND r.total_records > 1 THEN
          (e.avg_delay - r.avg_delay) / sqrt(e.v / e.total_records + r.v / r.total_records) END AS t_statistic,
        CASE WHEN e.total_records > 1 AND r.total_records > 1 THEN
          power(e.v / e.total_records + r.v / r.total_records, 2)
          / (power(e.v / e.total_records, 2) / (e.total_records - 1)
             + power(r.v / r.total_records, 2) / (r.total_records - 1)) END AS welch_dof,
        CASE WHEN e.total_records > 0 AND r.total_records > 0 THEN
          (e.avg_delay - r.avg_delay) / sqrt((e.v + r.v) / 2) END AS effect_size
      FROM e, r)
SELECT g.is_event, {R('g.avg_delay')} AS avg_delay, {R('g.median_delay')} AS median_delay,
       g.max_delay, g.min_delay, {R('g.std_delay')} AS std_delay, g.total_records,
       {R('w.t_statistic')} AS t_statistic, {R('w.welch_dof')} AS welch_dof,
       {R('w.effect_size')} AS effect_size
FROM g LEFT JOIN w ON true
"""


@register("event_stats", _EVENT_STATS_SQL)
def q_event_stats(spark, sf_dir):
    return EV.event_stats(*_merged_cal(spark, sf_dir))


@register("cohens_d", f"""
WITH q AS ({_EVENT_STATS_SQL.strip()})
SELECT is_event, effect_size FROM q
""")
def q_cohens_d(spark, sf_dir):
    return EV.event_stats(*_merged_cal(spark, sf_dir)).select("is_event", "effect_size")


@register("event_hourly_stats", f"""
WITH {_FLAG_SQL}
SELECT is_event, cast(hour(current_stop_departure) AS INTEGER) AS hour,
       {R('avg(x)')} AS mean_delay, {R('median(x)')} AS median_delay,
       {R('stddev_samp(x)')} AS std_delay, count(x) AS count,
       CASE WHEN is_event THEN 'Match Days' ELSE 'Regular Days' END AS day_type
FROM f GROUP BY is_event, hour(current_stop_departure)
""")
def q_event_hourly_stats(spark, sf_dir):
    return EV.event_hourly_stats(*_merged_cal(spark, sf_dir))


@register("overall_impact", f"""
WITH {_FLAG_SQL},
ce AS (SELECT is_event, cast(hour(current_stop_departure) AS INTEGER) AS hour,
              sum(x) AS s, count(x) AS c FROM f GROUP BY is_event, hour(current_stop_departure)),
worst AS (SELECT hour, s / c AS m,
                 row_number() OVER (ORDER BY s / c DESC, hour) AS rn
          FROM ce WHERE is_event AND c > 0),
a AS (SELECT sum(s) FILTER (WHERE is_event) / nullif(sum(c) FILTER (WHERE is_event), 0) AS ma,
             sum(s) FILTER (WHERE NOT is_event) / nullif(sum(c) FILTER (WHERE NOT is_event), 0) AS na
      FROM ce)
SELECT {R('a.ma')} AS match_avg_delay, {R('a.na')} AS normal_avg_delay,
       (SELECT count(*) FROM matches) AS matches_analyzed,
       (SELECT count(*) FILTER (WHERE coalesce(is_home, false)) FROM matches) AS home_matches,
       (SELECT hour FROM worst WHERE rn = 1) AS worst_hour,
       {R('(SELECT m FROM worst WHERE rn = 1)')} AS worst_hour_mean_delay,
       {R('(a.ma / nullif(a.na, 0) - 1.0) * 100.0')} AS delay_increase_pct,
       {R('a.ma - a.na')} AS delay_difference
FROM a
""")
def q_overall_impact(spark, sf_dir):
    return EV.overall_impact(*_merged_cal(spark, sf_dir))


@register("comparison_days", f"""
WITH offs AS (SELECT * FROM (VALUES ('Match Day', 0), ('Day Before', -1), ('Day After', 1),
                                    ('Week Before', -7), ('Week After', 7)) o(comparison, off)),
cal AS (SELECT kickoff, comparison, cast(kickoff AS DATE) + off AS day FROM matches, offs)
SELECT {TS('cal.kickoff')} AS kickoff, cal.comparison, m.rt_trip_id, m.gtfs_stop_sequence,
       {TS('m.current_stop_departure')} AS current_stop_departure, m.current_stop_dep_delay
FROM merged m JOIN cal ON cast(m.current_stop_departure AS DATE) = cal.day
""")
def q_comparison_days(spark, sf_dir):
    m, cal = _merged_cal(spark, sf_dir)
    return EV.comparison_days(m, cal).select(
        "kickoff", "comparison", "rt_trip_id", "gtfs_stop_sequence", "current_stop_departure",
        "current_stop_dep_delay")


_WINDOWS_SQL = f"""
{_CELLS_SQL},
wins AS (SELECT * FROM (VALUES (0, '3 hours before', -3, 0), (1, '2 hours before', -2, 0),
                               (2, '1 hour before', -1, 0), (3, '1 hour after', 0, 1),
                               (4, '2 hours after', 0, 2), (5, '3 hours after', 0, 3))
         w(window_index, wname, s_off, e_off)),
mw AS (SELECT m.kickoff, w.window_index, w.wname,
              cast(hour(m.kickoff) AS INTEGER) + w.s_off AS start_hour,
              cast(hour(m.kickoff) AS INTEGER) + w.e_off AS end_hour,
              CASE WHEN w.wname LIKE '%before%' THEN 'Before' ELSE 'After' END AS is_before
       FROM matches m, wins w),
j AS (SELECT mw.*, cells.comparison, cells.hour, cells.s, cells.c, cells.n
      FROM mw LEFT JOIN cells ON cells.kickoff = mw.kickoff AND cells.hour >= mw.start_hour
                              AND cells.hour < mw.end_hour)"""


@register("match_hour_windows", f"""
WITH {_WINDOWS_SQL}
SELECT {TS('kickoff')} AS kickoff, cast(window_index AS INTEGER) AS window_index, comparison,
       coalesce(sum(n), 0) AS rows, sum(s) AS delay_sum, coalesce(sum(c), 0) AS delays
FROM j GROUP BY kickoff, window_index, comparison
""")
def q_match_hour_windows(spark, sf_dir):
    j = EV.match_hour_windows(*_merged_cal(spark, sf_dir))
    return (j.groupBy("kickoff", "window_index", "comparison")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum("s").alias("delay_sum"),
                 F.coalesce(F.sum("c"), F.lit(0)).alias("delays")))


@register("match_window_stats", f"""
WITH {_WINDOWS_SQL},
g AS (SELECT kickoff, window_index, wname, is_before, start_hour, end_hour,
             sum(s) FILTER (WHERE comparison = 'Match Day')
               / nullif(sum(c) FILTER (WHERE comparison = 'Match Day'), 0) AS match_avg,
             sum(s) FILTER (WHERE comparison = 'Week Before')
               / nullif(sum(c) FILTER (WHERE comparison = 'Week Before'), 0) AS regular_avg,
             coalesce(sum(n) FILTER (WHERE comparison = 'Match Day'), 0) AS sample_size
      FROM j GROUP BY kickoff, window_index, wname, is_before, start_hour, end_hour)
SELECT {TS('kickoff')} AS kickoff, cast(window_index AS INTEGER) AS window_index, wname AS "window",
       is_before, start_hour, end_hour, {R('match_avg')} AS match_avg, {R('regular_avg')} AS regular_avg,
       sample_size,
       {R('CASE WHEN regular_avg > 0 THEN (match_avg / regular_avg - 1.0) * 100.0 ELSE 0.0 END')} AS increase
FROM g
""")
def q_match_window_stats(spark, sf_dir):
    return EV.match_window_stats(*_merged_cal(spark, sf_dir))


_IMPACT_SQL = f"""
{_CELLS_SQL},
pk AS (SELECT kickoff, hour, s / c AS m,
              row_number() OVER (PARTITION BY kickoff ORDER BY s / c DESC, hour) AS rn
       FROM cells WHERE comparison = 'Match Day' AND c > 0),
g AS (SELECT kickoff, kickoff_hour, is_home,
             sum(s) FILTER (WHERE comparison = 'Match Day')
               / nullif(sum(c) FILTER (WHERE comparison = 'Match Day'), 0) AS match_avg,
             sum(s) FILTER (WHERE comparison = 'Week Before')
               / nullif(sum(c) FILTER (WHERE comparison = 'Week Before'), 0) AS regular_avg,
             sum(s) FILTER (WHERE comparison = 'Match Day' AND hour BETWEEN kickoff_hour - 2 AND kickoff_hour + 2)
               / nullif(sum(c) FILTER (WHERE comparison = 'Match Day'
                                         AND hour BETWEEN kickoff_hour - 2 AND kickoff_hour + 2), 0)
               AS match_time_avg
      FROM cells GROUP BY kickoff, kickoff_hour, is_home),
imp AS (SELECT g.*, pk.hour AS peak_hour, pk.m AS peak_hour_avg,
               CASE WHEN regular_avg > 0 THEN (match_avg / regular_avg - 1.0) * 100.0 ELSE 0.0 END AS inc
        FROM g LEFT JOIN pk ON pk.kickoff = g.kickoff AND pk.rn = 1)"""


@register("match_impact", f"""
WITH {_IMPACT_SQL}
SELECT {TS('kickoff')} AS kickoff, kickoff_hour, is_home, {R('match_avg')} AS match_avg,
       {R('regular_avg')} AS regular_avg, {R('match_time_avg')} AS match_time_avg, peak_hour,
       {R('peak_hour_avg')} AS peak_hour_avg, {R('inc')} AS delay_increase,
       {R('match_avg - regular_avg')} AS delay_difference,
       CASE WHEN inc > 0 THEN 'Above normal' ELSE 'Normal traffic' END AS impact
FROM imp
""")
def q_match_impact(spark, sf_dir):
    return EV.match_impact(*_merged_cal(spark, sf_dir))


@register("match_time_delay", f"""
WITH {_IMPACT_SQL}
SELECT {TS('kickoff')} AS kickoff, {R('match_time_avg')} AS match_time_avg FROM imp
""")
def q_match_time_delay(spark, sf_dir):
    return EV.match_impact(*_merged_cal(spark, sf_dir)).select("kickoff", "match_time_avg")


@register("peak_impact_hour", f"""
WITH {_IMPACT_SQL}
SELECT {TS('kickoff')} AS kickoff, peak_hour, {R('peak_hour_avg')} AS peak_hour_avg FROM imp
""")
def q_peak_impact_hour(spark, sf_dir):
    return EV.match_impact(*_merged_cal(spark, sf_dir)).select("kickoff", "peak_hour", "peak_hour_avg")


@register("match_hourly_compare", f"""
WITH {_CELLS_SQL}
SELECT {TS('kickoff')} AS kickoff, hour,
       CASE WHEN comparison = 'Match Day' THEN 'Match Day' ELSE 'Regular Day' END AS day_type,
       {R('s / nullif(c, 0)')} AS mean_delay
FROM cells
""")
def q_match_hourly_compare(spark, sf_dir):
    return EV.match_hourly_compare(*_merged_cal(spark, sf_dir))


@register("recommendations", f"""
WITH {_IMPACT_SQL},
c AS (SELECT kickoff, kickoff_hour, is_home, coalesce(match_avg > regular_avg * 1.2, false) AS hit FROM imp)
SELECT {TS('kickoff')} AS kickoff, rec_no, recommendation FROM (
  SELECT kickoff, 0 AS rec_no,
         printf('Consider additional public transport capacity %02d:00 - %02d:00',
                kickoff_hour - 1, kickoff_hour + 1) AS recommendation FROM c WHERE hit
  UNION ALL SELECT kickoff, 1, 'Review traffic light timing during peak impact hours' FROM c WHERE hit
  UNION ALL SELECT kickoff, 2, 'Deploy additional traffic officers at key intersections' FROM c WHERE hit
  UNION ALL SELECT kickoff, 3, 'Consider temporary parking restrictions in residential areas'
            FROM c WHERE hit AND coalesce(is_home, false)
  UNION ALL SELECT kickoff, 0, 'Current traffic management measures appear adequate for this type of match'
            FROM c WHERE NOT hit)
""")
def q_recommendations(spark, sf_dir):
    return EV.recommendations(*_merged_cal(spark, sf_dir))


# -------------------------------------------------------------- prediction
from delaylens.operators import predict as PR  # noqa: E402
from delaylens.plans.oracle import pred_columns, predict_sql, t_expr  # noqa: E402

WEEK_START = "2024-01-08 07:30:00"
SHORT_START = "2024-01-15 16:20:00"

_H_STOP = """h AS (SELECT base_stop_id, gtfs_direction_id, current_stop_departure AS ts,
                  cast(current_stop_dep_delay AS DOUBLE) AS v
           FROM merged WHERE current_stop_departure IS NOT NULL)"""


def _slot_sql(keys):
    kk = "".join(f"{x}, " for x in keys)
    return f"""slots AS (SELECT DISTINCT {kk}date_trunc('hour', ts) + INTERVAL 30 MINUTE AS target_ts FROM h)"""


def _grid_sql(keys, first, end, src="h"):
    kk = ", ".join(keys)
    keysel = f"(SELECT DISTINCT {kk} FROM {src}) k, " if keys else ""
    return f"""grid AS (SELECT {(kk + ', ') if keys else ''}g.target_ts
  FROM {keysel}generate_series(TIMESTAMP '{first}', TIMESTAMP '{end}', INTERVAL 15 MINUTE) g(target_ts)
  WHERE g.target_ts < TIMESTAMP '{end}')"""


def _history(spark, sf_dir):
    m, cal = _merged_cal(spark, sf_dir)
    return m, cal


def _pred_query(keys, mode, targets_sql_name="slots", label="delay", extra_ctes="", hist=_H_STOP,
                scale=""):
    return f"""
WITH {hist},
{extra_ctes},
{predict_sql('h', targets_sql_name, keys, mode, label, scale).strip()}
SELECT {pred_columns(keys, label)} FROM pred"""


@register("cell_stats", f"""
WITH {_H_STOP}
SELECT cast(hour(ts) AS INTEGER) AS hour, cast(isodow(ts) - 1 AS INTEGER) AS weekday,
       count(*) AS sample_size, {R('avg(v)')} AS base_mean, {R('stddev_samp(v)')} AS std,
       {R('median(v)')} AS median
FROM h GROUP BY hour(ts), isodow(ts) HAVING count(*) >= 5
""")
def q_cell_stats(spark, sf_dir):
    m, _ = _history(spark, sf_dir)
    return PR.cell_stats(m)


@register("confidence_interval", f"""
WITH {_H_STOP},
c AS (SELECT cast(hour(ts) AS INTEGER) AS hour, cast(isodow(ts) - 1 AS INTEGER) AS weekday, base_stop_id,
             count(*) AS sample_size, avg(v) AS base_mean, stddev_samp(v) AS std,
             cast(median(v) AS DOUBLE) AS median
      FROM h GROUP BY hour(ts), isodow(ts), base_stop_id HAVING count(*) >= 5),
ci AS (SELECT c.*, {t_expr('(c.sample_size - 1)')} AS t_value FROM c LEFT JOIN tq ON tq.dof = c.sample_size - 1)
SELECT hour, weekday, base_stop_id, sample_size, {R('base_mean')} AS base_mean, {R('std')} AS std,
       {R('median')} AS median, {R('t_value')} AS t_value,
       {R('t_value * std / sqrt(sample_size)')} AS margin_error,
       {R('base_mean - t_value * std / sqrt(sample_size)')} AS confidence_lower,
       {R('base_mean + t_value * std / sqrt(sample_size)')} AS confidence_upper
FROM ci
""")
def q_confidence_interval(spark, sf_dir):
    m, _ = _history(spark, sf_dir)
    return PR.confidence_interval(PR.cell_stats(m, ["base_stop_id"]))


def _predict_global(spark, sf_dir, mode):
    m, cal = _history(spark, sf_dir)
    counts = PR.minute_counts(m)
    return PR.predict(counts, PR.hour_slot_targets(counts), [], calendar=cal, recent_mode=mode)


@register("predict_stop_delay", _pred_query([], "bounded", extra_ctes=_slot_sql([])))
def q_predict_stop_delay(spark, sf_dir):
    return _predict_global(spark, sf_dir, "bounded")


@register("predict_stop_delay_open", _pred_query([], "open", extra_ctes=_slot_sql([])))
def q_predict_stop_delay_open(spark, sf_dir):
    return _predict_global(spark, sf_dir, "open")


_SD = ["base_stop_id", "gtfs_direction_id"]


@register("predict_stop_direction", _pred_query(_SD, "bounded", extra_ctes=_slot_sql(_SD)))
def q_predict_stop_direction(spark, sf_dir):
    m, cal = _history(spark, sf_dir)
    counts = PR.minute_counts(m, _SD)
    return PR.predict(counts, PR.hour_slot_targets(counts, _SD), _SD, calendar=cal, recent_mode="bounded")


@register("error_correction", _pred_query([], "bounded", extra_ctes=_slot_sql([])).replace(
    f"SELECT {pred_columns([])} FROM pred",
    f"SELECT {TS('target_ts')} AS datetime, {R('base_mean')} AS base_mean_delay, recent_n, "
    f"{R('error_correction')} AS error_correction, {R('adjusted')} AS mean_delay FROM pred"))
def q_error_correction(spark, sf_dir):
    return _predict_global(spark, sf_dir, "bounded").select(
        "datetime", "base_mean_delay", "recent_n", "error_correction", "mean_delay")


@register("reliability", _pred_query([], "bounded", extra_ctes=_slot_sql([])).replace(
    f"SELECT {pred_columns([])} FROM pred",
    f"SELECT {TS('target_ts')} AS datetime, sample_size, {R('margin_error')} AS margin_error, "
    f"{R('adjusted')} AS mean_delay, is_peak_hour, is_match_day, {R('reliability')} AS reliability "
    "FROM pred"))
def q_reliability(spark, sf_dir):
    return _predict_global(spark, sf_dir, "bounded").select(
        "datetime", "sample_size", "margin_error", "mean_delay", "is_peak_hour", "is_match_day",
        "reliability")


_WEEK_FIRST, _WEEK_END = PR.grid_times(WEEK_START, 24 * 7, 15, floor_to_hour=True)
_SHORT_FIRST, _SHORT_END = PR.grid_times(SHORT_START, 3, 15)


@register("predict_weekly", f"""
WITH {_H_STOP},
{_grid_sql(['base_stop_id'], _WEEK_FIRST, _WEEK_END)},
{predict_sql('h', 'grid', ['base_stop_id'], 'bounded').strip()}
SELECT {pred_columns(['base_stop_id'])}, strftime(target_ts, '%A') AS day_name,
       CASE WHEN hour(target_ts) BETWEEN 7 AND 9 THEN 'Morning Peak'
            WHEN hour(target_ts) BETWEEN 16 AND 18 THEN 'Evening Peak' ELSE 'Off-Peak' END AS time_period
FROM pred WHERE reliability >= 0.0
""")
def q_predict_weekly(spark, sf_dir):
    m, cal = _history(spark, sf_dir)
    return PR.predict_weekly(m, views(spark, sf_dir)["stops"], WEEK_START, ["base_stop_id"], calendar=cal)


@register("predict_short_term", f"""
WITH {_H_STOP},
{_grid_sql(['base_stop_id'], _SHORT_FIRST, _SHORT_END)},
{predict_sql('h', 'grid', ['base_stop_id'], 'bounded').strip()}
SELECT base_stop_id, {TS('target_ts')} AS datetime, {R('adjusted')} AS mean_delay,
       {R('adjusted - margin_error')} AS confidence_lower, {R('adjusted + margin_error')} AS confidence_upper
FROM pred
""")
def q_predict_short_term(spark, sf_dir):
    m, cal = _history(spark, sf_dir)
    return PR.predict_short_term(m, views(spark, sf_dir)["stops"], SHORT_START, ["base_stop_id"], calendar=cal)


# segments: history = segment rows of the merged stop times
# (three platform ids by stop sequence, so that segments repeat often enough to have populated cells)
_DENSE = """dense AS (
  SELECT * REPLACE ('U' || cast(100 + gtfs_stop_sequence % 3 AS VARCHAR) || 'Z1P' AS gtfs_stop_id) FROM merged)"""

_H_SEG_EDGE = f"""{_DENSE},
{processed_sql('dense')},
h AS (SELECT split_part(previous_stop_id, 'Z', 1) || '_' || split_part(gtfs_stop_id, 'Z', 1) AS segment_id_short,
             gtfs_direction_id, current_stop_departure AS ts,
             epoch_us(real_arrival) - epoch_us(real_previous_stop_departure) AS v
      FROM processed WHERE previous_stop_id IS NOT NULL AND current_stop_departure IS NOT NULL)"""

_H_SEG_TRIP = f"""{_DENSE},
{processed_sql('dense')},
sg AS (SELECT rt_trip_id, lag(gtfs_stop_id) OVER ({_ORDER}) AS p, gtfs_stop_id AS c FROM dense),
h AS (SELECT split_part(sg.p, 'Z', 1) || '_' || split_part(sg.c, 'Z', 1) AS segment_id_short,
             processed.gtfs_direction_id, processed.current_stop_departure AS ts,
             epoch_us(processed.real_arrival) - epoch_us(processed.real_previous_stop_departure) AS v
      FROM processed JOIN sg ON processed.rt_trip_id = sg.rt_trip_id
      WHERE sg.p IS NOT NULL AND processed.current_stop_departure IS NOT NULL)"""

_SEG = ["segment_id_short"]


def _dense_history(spark, sf_dir):
    m, cal = _history(spark, sf_dir)
    dense = F.concat(F.lit("U"), (F.lit(100) + F.col("gtfs_stop_sequence") % 3).cast("string"), F.lit("Z1P"))
    return m.withColumn("gtfs_stop_id", dense), cal


def _seg_history(spark, sf_dir, mode):
    m, cal = _dense_history(spark, sf_dir)
    return T.segment_rows(m, mode), cal


@register("predict_segment", _pred_query(_SEG, "bounded", extra_ctes=_slot_sql(_SEG),
                                         label="travel_time", hist=_H_SEG_EDGE, scale=" / 1e6"))
def q_predict_segment(spark, sf_dir):
    rows, cal = _seg_history(spark, sf_dir, "edge")
    hist = PR.narrow_history(rows, _SEG, "real_travel_time_us")
    return PR.predict_segments(hist, PR.hour_slot_targets(hist, _SEG), _SEG, calendar=cal,
                               recent_mode="bounded", materialize=False)


@register("predict_segment_trip", _pred_query(_SEG, "open", extra_ctes=_slot_sql(_SEG),
                                              label="travel_time", hist=_H_SEG_TRIP, scale=" / 1e6"))
def q_predict_segment_trip(spark, sf_dir):
    m, cal = _dense_history(spark, sf_dir)
    return PR.predict_trip_mode(T.stored_trips(m), None, _SEG, calendar=cal, recent_mode="open")


@register("predict_segment_short_term", f"""
WITH {_H_SEG_EDGE},
{_grid_sql(_SEG, _SHORT_FIRST, _SHORT_END)},
{predict_sql('h', 'grid', _SEG, 'bounded', 'travel_time', ' / 1e6').strip()}
SELECT segment_id_short, {TS('target_ts')} AS datetime, {R('adjusted')} AS mean_travel_time,
       {R('adjusted - margin_error')} AS confidence_lower, {R('adjusted + margin_error')} AS confidence_upper
FROM pred
""")
def q_predict_segment_short_term(spark, sf_dir):
    rows, cal = _seg_history(spark, sf_dir, "edge")
    rows = PR.narrow_history(rows, _SEG, "real_travel_time_us")
    return PR.predict_short_term(rows, rows, SHORT_START, _SEG, calendar=cal,
                                 value_col="real_travel_time_us", label="travel_time",
                                 unit_divisor=1e6, reduce=False)


# ------------------------------------------------------- sources and sinks
from delaylens.session import scratch_path  # noqa: E402
from delaylens.sources import files as IO  # noqa: E402
from delaylens.sources import parsing as PX  # noqa: E402

_ST_COLS = f"""rt_trip_id, gtfs_stop_id, {TS('current_stop_departure')} AS current_stop_departure,
  current_stop_dep_delay, {TS('current_stop_arrival')} AS current_stop_arrival, current_stop_arr_delay,
  gtfs_stop_sequence, gtfs_route_short_name, gtfs_direction_id,
  {TS('created_at')} AS created_at, {TS('updated_at')} AS updated_at"""
_ST_NAMES = ["rt_trip_id", "gtfs_stop_id", "current_stop_departure", "current_stop_dep_delay",
             "current_stop_arrival", "current_stop_arr_delay", "gtfs_stop_sequence",
             "gtfs_route_short_name", "gtfs_direction_id", "created_at", "updated_at"]

_PLATFORMS_SQL = """
plat AS (SELECT DISTINCT k.gtfs_stop_id, s.stop_name, s.avg_latitude, s.avg_longitude
         FROM keyed k JOIN stops s ON k.base_stop_id = s.base_stop_id),
norm AS (SELECT CASE WHEN regexp_matches(gtfs_stop_id, '[SZ]')
                     THEN regexp_extract(gtfs_stop_id, '^([^SZ]*)', 1) END AS base_stop_id,
                stop_name, avg(avg_latitude) AS avg_latitude, avg(avg_longitude) AS avg_longitude,
                '[''' || string_agg(gtfs_stop_id, ''', ''' ORDER BY gtfs_stop_id) || ''']' AS all_stop_ids
         FROM (SELECT DISTINCT * FROM plat) GROUP BY 1, 2)"""


def _platforms(spark, sf_dir):
    v = views(spark, sf_dir)
    keyed = P.with_stop_keys(v["st"]).select("gtfs_stop_id", "base_stop_id")
    return (keyed.join(v["stops"], "base_stop_id")
            .select("gtfs_stop_id", "stop_name", "avg_latitude", "avg_longitude").distinct())


def _stations(spark, sf_dir):
    return IO.normalize_stops(_platforms(spark, sf_dir))


@register("normalize_stops", f"""
WITH {_PLATFORMS_SQL}
SELECT base_stop_id, stop_name, {R('avg_latitude')} AS avg_latitude,
       {R('avg_longitude')} AS avg_longitude, all_stop_ids FROM norm
""")
def q_normalize_stops(spark, sf_dir):
    return _stations(spark, sf_dir).drop("stop_ids")


@register("stop_id_list", """
SELECT DISTINCT k.gtfs_stop_id FROM keyed k JOIN stops s ON k.base_stop_id = s.base_stop_id
""")
def q_stop_id_list(spark, sf_dir):
    return IO.stop_id_list(_stations(spark, sf_dir))


@register("scan_history", f"""
SELECT {_ST_COLS}, cast(year(current_stop_departure) AS INTEGER) AS year,
       cast(month(current_stop_departure) AS INTEGER) AS month,
       cast(day(current_stop_departure) AS INTEGER) AS day
FROM st WHERE gtfs_stop_id IN (SELECT DISTINCT k.gtfs_stop_id FROM keyed k JOIN stops s
                               ON k.base_stop_id = s.base_stop_id)
""")
def q_scan_history(spark, sf_dir):
    path = scratch_path(spark, "history")
    IO.write_history(views(spark, sf_dir)["st"], path, mode="overwrite")
    return IO.scan_history(spark, path, IO.stop_id_list(_stations(spark, sf_dir)))


_SPLIT_DAY = "2024-01-16"


@register("incremental_load", f"""
WITH old AS (SELECT * FROM st WHERE current_stop_departure < TIMESTAMP '{_SPLIT_DAY}'),
hwm AS (SELECT date_trunc('second', max(current_stop_departure) + INTERVAL 1 SECOND) AS t FROM old)
SELECT {_ST_COLS} FROM st WHERE current_stop_departure > (SELECT t FROM hwm)
""")
def q_incremental_load(spark, sf_dir):
    st = views(spark, sf_dir)["st"]
    path = scratch_path(spark, "incremental")
    split = F.lit(_SPLIT_DAY).cast("timestamp_ntz")
    IO.persist_stop_times(st.where(F.col("current_stop_departure") < split), path)
    new = IO.incremental_load(spark, path, st)
    return new.select(*_ST_NAMES)


@register("persist_stop_times", f"""
SELECT {_ST_COLS}, {D('cast(current_stop_departure AS DATE)')} AS date FROM st
""")
def q_persist_stop_times(spark, sf_dir):
    st = views(spark, sf_dir)["st"]
    path = scratch_path(spark, "persist")
    split = F.lit(_SPLIT_DAY).cast("timestamp_ntz")
    IO.persist_stop_times(st.where(F.col("current_stop_departure") < split), path)
    IO.persist_stop_times(st.where(F.col("current_stop_departure") >= split), path)  # append
    return spark.read.parquet(path).select(*_ST_NAMES, "date")


@register("export_csv", f"""
SELECT {_ST_COLS} FROM st
""")
def q_export_csv(spark, sf_dir):
    st = views(spark, sf_dir)["st"]
    path = scratch_path(spark, "csv")
    IO.export_csv(st, path)
    return (spark.read.schema(st.schema).option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


@register("merge_dedup", f"""
SELECT DISTINCT {_ST_COLS} FROM st
""")
def q_merge_dedup(spark, sf_dir):
    st = views(spark, sf_dir)["st"]
    old = st.where(F.col("current_stop_departure") < F.lit("2024-01-18").cast("timestamp_ntz"))
    new = st.where(F.col("current_stop_departure") >= F.lit("2024-01-12").cast("timestamp_ntz"))
    return IO.merge_dedup(old, new)


@register("read_stops", f"""
WITH {_PLATFORMS_SQL}
SELECT stop_name, {R('avg_longitude')} AS avg_longitude, {R('avg_latitude')} AS avg_latitude,
       base_stop_id, all_stop_ids FROM norm
""")
def q_read_stops(spark, sf_dir):
    path = scratch_path(spark, "stops_csv")
    IO.write_stops_csv(_stations(spark, sf_dir), path)
    return IO.read_stops(spark, path)


@register("upsert_stops", f"""
WITH {_PLATFORMS_SQL},
upd AS (SELECT base_stop_id, stop_name, avg_latitude, avg_longitude, all_stop_ids FROM norm),
ex AS (SELECT base_stop_id, stop_name, avg_latitude, avg_longitude, NULL AS all_stop_ids FROM stops)
SELECT base_stop_id, stop_name, {R('avg_latitude')} AS avg_latitude, {R('avg_longitude')} AS avg_longitude,
       all_stop_ids
FROM (SELECT * FROM ex WHERE base_stop_id NOT IN (SELECT base_stop_id FROM upd)
      UNION ALL SELECT * FROM upd)
""")
def q_upsert_stops(spark, sf_dir):
    existing = views(spark, sf_dir)["stops"]
    updates = _stations(spark, sf_dir).drop("stop_ids")
    return IO.upsert_stops(existing, updates)


@register("load_stop_times", f"""
SELECT rt_trip_id, gtfs_stop_id, {TS('current_stop_departure')} AS current_stop_departure,
       current_stop_dep_delay, gtfs_stop_sequence, gtfs_route_short_name, gtfs_direction_id,
       base_stop_id, {D('date')} AS date, hour
FROM prepared
""")
def q_load_stop_times(spark, sf_dir):
    path = scratch_path(spark, "prepared")
    IO.load_stop_times(views(spark, sf_dir)["st"], path)
    return spark.read.parquet(path).select(
        "rt_trip_id", "gtfs_stop_id", "current_stop_departure", "current_stop_dep_delay",
        "gtfs_stop_sequence", "gtfs_route_short_name", "gtfs_direction_id", "base_stop_id",
        "date", "hour")


@register("hourly_stats_table", f"""
SELECT {D('date')} AS date, hour, gtfs_stop_id,
       {R('avg(current_stop_dep_delay)')} AS avg_delay, count(*) AS count,
       {R('stddev_samp(current_stop_dep_delay)')} AS std_delay
FROM prepared GROUP BY date, hour, gtfs_stop_id
""")
def q_hourly_stats_table(spark, sf_dir):
    path = scratch_path(spark, "hourly")
    IO.hourly_stats_table(prepared(spark, sf_dir), path)
    return spark.read.parquet(path).select("date", "hour", "gtfs_stop_id", "avg_delay", "count",
                                           "std_delay")


@register("stops_lookup", f"""
SELECT base_stop_id, stop_name, {R('avg_latitude')} AS avg_latitude, {R('avg_longitude')} AS avg_longitude
FROM stops WHERE base_stop_id = 'U105'
""")
def q_stops_lookup(spark, sf_dir):
    return IO.stops_lookup(views(spark, sf_dir)["stops"], "U105")


@register("ad_hoc_parquet", f"""
SELECT rt_trip_id, gtfs_stop_sequence, gtfs_stop_id, stop_name,
       {TS('current_stop_departure')} AS current_stop_departure, current_stop_dep_delay
FROM merged WHERE stop_name = 'NATION_5'
""")
def q_ad_hoc_parquet(spark, sf_dir):
    path = scratch_path(spark, "adhoc")
    (merged(spark, sf_dir).select("rt_trip_id", "gtfs_stop_sequence", "gtfs_stop_id", "stop_name",
                                  "current_stop_departure", "current_stop_dep_delay")
     .repartition(4).write.mode("overwrite").parquet(path))
    return IO.ad_hoc_parquet(spark, f"{path}/*.parquet", "NATION_5")


@register("stops_from_geojson", f"""
SELECT DISTINCT k.gtfs_stop_id, s.stop_name,
       {R('s.avg_longitude')} AS lon, {R('s.avg_latitude')} AS lat
FROM keyed k JOIN stops s ON k.base_stop_id = s.base_stop_id
""")
def q_stops_from_geojson(spark, sf_dir):
    # one GeoJSON document per station, built from the observed platforms;
    # metro platforms carry their id under the fallback key
    plat = _platforms(spark, sf_dir).withColumn("base_stop_id", P.C.base_stop_id("gtfs_stop_id"))
    metro = F.col("gtfs_stop_id").contains("S")
    feature = F.struct(
        F.struct(F.when(~metro, F.col("gtfs_stop_id")).alias("gtfs_stop_id"),
                 F.when(metro, F.col("gtfs_stop_id")).alias("stop_id"),
                 F.col("stop_name").alias("stop_name")).alias("properties"),
        F.struct(F.array("avg_longitude", "avg_latitude").alias("coordinates")).alias("geometry"))
    docs = (plat.groupBy("base_stop_id")
            .agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")))
    out = PX.stops_from_geojson(docs)
    return out.select("gtfs_stop_id", "stop_name", F.col("coordinates")[0].alias("lon"),
                      F.col("coordinates")[1].alias("lat"))


@register("html_link_blocks", """
SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href,
       unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS label
FROM pages
""")
def q_html_link_blocks(spark, sf_dir):
    return PX.link_blocks(fixtures.read_table(spark, sf_dir, "pages"))


# --------------------------------------------------------------- streaming
from delaylens.streaming import streams as STR  # noqa: E402

ST2_DELAY_HOURS = 2


def _stream_st1(spark, sf_dir):
    st = views(spark, sf_dir)["st"]
    src = scratch_path(spark, "st-files")
    STR.split_into_day_files(st, src)
    sink = scratch_path(spark, "st1-sink")
    STR.incremental_stream(spark, f"{src}/*", st.schema, sink,
                           max_files_per_trigger=None).awaitTermination()
    return sink


@register("incremental_stream", f"""
SELECT {_ST_COLS} FROM st
""")
def q_incremental_stream(spark, sf_dir):
    sink = _stream_st1(spark, sf_dir)
    return spark.read.parquet(sink).select(*_ST_NAMES)


@register("hourly_stats_stream", f"""
SELECT {TS("date_trunc('hour', current_stop_departure)")} AS window_start,
       {TS("date_trunc('hour', current_stop_departure) + INTERVAL 1 HOUR")} AS window_end,
       gtfs_stop_id, {R('avg(current_stop_dep_delay)')} AS avg_delay, count(*) AS count,
       {R('stddev_samp(current_stop_dep_delay)')} AS std_delay
FROM st
GROUP BY date_trunc('hour', current_stop_departure), gtfs_stop_id
HAVING date_trunc('hour', current_stop_departure) + INTERVAL 1 HOUR
       <= (SELECT max(current_stop_departure) FROM st) - INTERVAL {ST2_DELAY_HOURS} HOUR
""")
def q_hourly_stats_stream(spark, sf_dir):
    sink = _stream_st1(spark, sf_dir)
    sink2 = scratch_path(spark, "st2-sink")
    STR.hourly_stats_stream(spark, sink, None, sink2, delay=f"{ST2_DELAY_HOURS} hours",
                            max_files_per_trigger=None).awaitTermination()
    return spark.read.parquet(sink2)


# -------------------------------------------------------------- clustering
from delaylens.operators import cluster as CL  # noqa: E402


def _clusters_sql(k: int, max_iter: int) -> str:
    """The start and all iterations as relations; once the centres stay, further iterations change nothing."""
    names = {"hour": "h", "delay": "d", "weekday": "w"}
    stats = ", ".join(f"sum(w * {c}) / sum(w) AS m_{c}, coalesce(nullif(sqrt(greatest((sum(w * {c} * {c}) - sum(w * {c}) * sum(w * {c}) / sum(w)) "
                      f"/ sum(w), 0)), 0), 1) AS s_{c}" for c in names)
    whole = ", ".join(f"cast(floor(1000 * ({c} - m_{c}) / s_{c} + 0.5) AS BIGINT) AS z{x}" for c, x in names.items())

    def far(i):
        return " + ".join(f"(z{x} - {x}{i}) * (z{x} - {x}{i})" for x in names.values())

    def least(n):
        return f"least({', '.join(far(i) for i in range(n))})"

    centre = ["c0 AS (SELECT zh AS h0, zd AS d0, zw AS w0 FROM z ORDER BY zh * zh + zd * zd + zw * zw, hour, delay, weekday LIMIT 1)"]
    for i in range(1, k):
        centre.append(f"c{i} AS (SELECT c{i - 1}.*, zh AS h{i}, zd AS d{i}, zw AS w{i} FROM z, c{i - 1} "
                      f"ORDER BY {least(i)} DESC, hour, delay, weekday LIMIT 1)")
    label = "CASE " + " ".join(f"WHEN {far(i)} = {least(k)} THEN {i}" for i in range(k)) + " END"
    steps = [f"k0 AS MATERIALIZED (SELECT * FROM c{k - 1})"]
    for r in range(max_iter):
        new = ", ".join(f"coalesce(cast(floor(sum(w * z{x}) FILTER (c = {i}) / sum(w) FILTER (c = {i})) AS BIGINT), any_value({x}{i})) AS {x}{i}"
                        for i in range(k) for x in names.values())
        steps.append(f"k{r + 1} AS MATERIALIZED (SELECT {new} FROM (SELECT *, {label} AS c FROM z, k{r}))")

    def mean(c):
        return f"sum(w * {c}) / sum(w)"

    def std(c):
        var = f"(sum(w * {c} * {c}) - sum(w * {c}) * sum(w * {c}) / sum(w)) / (sum(w) - 1)"
        return f"CASE WHEN sum(w) > 1 THEN sqrt(greatest({var}, 0)) END"

    def cents(x):
        return R(f"floor(({x}) * 100 + 0.5) / 100")

    return f"""
WITH points AS (
  SELECT cast(hour(current_stop_departure) AS DOUBLE) AS hour, cast(current_stop_dep_delay AS DOUBLE) AS delay,
         cast(isodow(current_stop_departure) - 1 AS DOUBLE) AS weekday, cast(count(*) AS DOUBLE) AS w
  FROM merged WHERE current_stop_departure IS NOT NULL AND current_stop_dep_delay IS NOT NULL GROUP BY ALL),
scale AS (SELECT {stats} FROM points),
z AS MATERIALIZED (SELECT points.*, {whole} FROM points, scale),
{", ".join(centre)},
{", ".join(steps)}
SELECT cast(c AS INTEGER) AS cluster, {cents(mean('delay'))} AS delay_mean, {cents(std('delay'))} AS delay_std,
       cast(sum(w) AS BIGINT) AS delay_count, {cents(mean('hour'))} AS hour_mean, {cents(std('hour'))} AS hour_std,
       {cents(mean('weekday'))} AS weekday_mean
FROM (SELECT *, {label} AS c FROM z, k{max_iter}) GROUP BY c"""


@register("delay_clusters", _clusters_sql(3, 20))
def q_delay_clusters(spark, sf_dir):
    summary, _ = CL.delay_clusters(merged(spark, sf_dir))
    return summary


@register("time_features", f"""
SELECT rt_trip_id, gtfs_stop_sequence, {TS('current_stop_departure')} AS current_stop_departure,
       cast(hour(current_stop_departure) AS INTEGER) AS hour,
       cast(isodow(current_stop_departure) - 1 AS INTEGER) AS weekday,
       isodow(current_stop_departure) - 1 IN (5, 6) AS is_weekend
FROM st WHERE current_stop_departure IS NOT NULL
""")
def q_time_features(spark, sf_dir):
    st = views(spark, sf_dir)["st"].select("rt_trip_id", "gtfs_stop_sequence", "current_stop_departure")
    return P.with_time_features(st)



from delaylens.plans import calendar_catalog, impact_catalog, stored_catalog  # noqa: E402,F401
