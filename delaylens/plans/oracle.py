"""SQL text of the fixture views and helpers for writing oracle queries.

The oracle queries run in a different SQL engine over the same parquet
tables; they are written independently of the DataFrame code and only share
the fixture rules and fixed parameters.
"""

from __future__ import annotations

from delaylens.functions.tdist import t975_sql_expansion, t975_sql_values, TABLE_MAX_DOF

LITERAL_MATCHES = """
  SELECT * FROM (VALUES
    ('06.01.2024', '19:00', 'D', 'FK Alpha'),
    ('10.01.2024', '21:00', 'V', 'FC Beta'),
    ('14.01.2024', '15:00', 'D', NULL),
    ('20.01.2024', '?', 'D', 'SK Gamma'),
    ('', '', 'V', 'FK Delta'),
    ('27.01.2024', '17:00', 'V', 'FK Alpha')
  ) AS m("Date", "Time", "Location", "Opponent")
"""

VIEWS = """
st AS (
  SELECT
    cast(user_id AS VARCHAR) || '_' || cast(cast(ts AS DATE) AS VARCHAR) AS rt_trip_id,
    'U' || cast(100 + (event_id * 7 + user_id) % 27 AS VARCHAR)
      || CASE WHEN event_id % 13 = 0 THEN 'S1'
              ELSE 'Z' || cast(1 + user_id % 4 AS VARCHAR) || 'P' END AS gtfs_stop_id,
    ts AS current_stop_departure,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast(floor(value) AS INTEGER) - 22 END
      AS current_stop_dep_delay,
    ts - INTERVAL '1' SECOND * cast(event_id % 40 AS INTEGER) AS current_stop_arrival,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(floor(value) AS INTEGER) - 25 END
      AS current_stop_arr_delay,
    cast(row_number() OVER (PARTITION BY user_id, cast(ts AS DATE) ORDER BY ts, event_id) AS INTEGER)
      AS gtfs_stop_sequence,
    event_type AS gtfs_route_short_name,
    cast(event_id % 2 AS INTEGER) AS gtfs_direction_id,
    ts AS created_at,
    ts AS updated_at
  FROM events
),
stops AS (
  SELECT 'U' || cast(100 + n_nationkey AS VARCHAR) AS base_stop_id,
         n_name AS stop_name,
         cast(50.095 + 0.001 * n_nationkey AS DOUBLE) AS avg_latitude,
         cast(14.404 + 0.003 * n_nationkey AS DOUBLE) AS avg_longitude
  FROM nation
),
matches_raw AS (""" + LITERAL_MATCHES + """),
matches AS (
  SELECT "Date", "Time", "Location",
         coalesce("Opponent", 'TBD') AS "Opponent",
         lower(trim("Location")) = 'd' AS is_home,
         try_strptime("Date" || ' ' || "Time", '%d.%m.%Y %H:%M') AS kickoff
  FROM matches_raw
  WHERE try_strptime("Date" || ' ' || "Time", '%d.%m.%Y %H:%M') IS NOT NULL
),
keyed AS (
  SELECT *,
         CASE WHEN regexp_matches(gtfs_stop_id, '[SZ]')
              THEN regexp_extract(gtfs_stop_id, '^([^SZ]*)', 1) END AS base_stop_id,
         cast(current_stop_departure AS DATE) AS date,
         cast(hour(current_stop_departure) AS INTEGER) AS hour
  FROM st
),
prepared AS (
  SELECT rt_trip_id, gtfs_stop_id, current_stop_departure, current_stop_dep_delay,
         gtfs_stop_sequence, gtfs_route_short_name, gtfs_direction_id,
         base_stop_id, date, hour
  FROM keyed
),
merged AS (
  SELECT k.*, s.stop_name, s.avg_latitude, s.avg_longitude
  FROM keyed k JOIN stops s ON k.base_stop_id = s.base_stop_id
),
tq AS (
  SELECT * FROM (VALUES __TVALUES__) AS tq(dof, t975)
)
"""


def with_views(body: str) -> str:
    """Prefix a query body with the fixture views."""
    views = VIEWS.strip().replace("__TVALUES__", t975_sql_values())
    text = body.strip()
    if text[:4].upper() == "WITH":
        return "WITH " + views + ",\n" + text[4:].lstrip()
    return "WITH " + views + "\n" + text


def t_expr(dof_sql: str, table_alias: str = "tq") -> str:
    """SQL for the 95 % t quantile of ``dof_sql``; needs a LEFT JOIN of ``tq``
    ``ON tq.dof = <dof>`` under ``table_alias``."""
    return (f"CASE WHEN {dof_sql} < 1 THEN NULL WHEN {dof_sql} <= {TABLE_MAX_DOF} "
            f"THEN {table_alias}.t975 ELSE {t975_sql_expansion(dof_sql)} END")


def R(x: str) -> str:
    v = f"cast({x} AS DOUBLE)"
    return f"(CASE WHEN abs({v}) < 1e12 THEN floor({v} * 1e6 + 0.5) / 1e6 ELSE {v} END)"


def D(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def TS(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def predict_sql(hist: str, targets: str, keys: list[str], mode: str, label: str = "delay",
                scale: str = "") -> str:
    """CTE chain ending in ``pred`` (one row per predictable target) for a
    history CTE ``hist`` (keys, ts, v) and a target CTE ``targets`` (keys,
    target_ts); the recent window is a plain range join here."""
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    on_cells = " AND ".join([f"c.{x} = tg.{x}" for x in keys] + [
        "c.hour = cast(hour(tg.target_ts) AS INTEGER)",
        "c.weekday = cast(isodow(tg.target_ts) - 1 AS INTEGER)"])
    on_rec = " AND ".join([f"h.{x} = b.{x}" for x in keys] + [
        "h.ts >= b.target_ts - INTERVAL 60 MINUTE"] + (["h.ts < b.target_ts"] if mode == "bounded" else []))
    bk = ", ".join(f"b.{x}" for x in keys)
    bkk = (bk + ", ") if keys else ""
    using = ", ".join(keys + ["target_ts"])
    return f"""
cells AS (SELECT cast(hour(ts) AS INTEGER) AS hour, cast(isodow(ts) - 1 AS INTEGER) AS weekday, {kk}
                 count(*) AS sample_size, avg(v){scale} AS base_mean, stddev_samp(v){scale} AS std,
                 cast(median(v) AS DOUBLE){scale} AS median
          FROM {hist} GROUP BY hour(ts), isodow(ts) {(', ' + k) if keys else ''} HAVING count(*) >= 5),
tg AS (SELECT DISTINCT {kk}target_ts FROM {targets}),
pbase AS (SELECT tg.*, c.sample_size, c.base_mean, c.std, c.median,
                {t_expr('(c.sample_size - 1)')} AS t_value
         FROM tg JOIN cells c ON {on_cells}
         LEFT JOIN tq ON tq.dof = c.sample_size - 1),
rec AS (SELECT {bkk}b.target_ts, count(h.ts) AS recent_n, sum(h.v){scale} AS recent_sum,
               count(h.v) AS recent_cnt
        FROM pbase b LEFT JOIN {hist} h ON {on_rec}
        GROUP BY {bkk}b.target_ts),
p1 AS (SELECT b.*, r.recent_n, r.recent_sum, r.recent_cnt,
              b.t_value * b.std / sqrt(b.sample_size) AS margin_error,
              CASE WHEN r.recent_n >= 3 THEN r.recent_sum / nullif(r.recent_cnt, 0) - b.base_mean
                   ELSE 0.0 END AS error_correction,
              coalesce(cast(b.target_ts AS DATE) IN (SELECT cast(kickoff AS DATE) FROM matches), false)
                AS is_match_day,
              hour(b.target_ts) IN (7, 8, 9, 16, 17, 18) AS is_peak_hour,
              isodow(b.target_ts) - 1 IN (5, 6) AS is_weekend
       FROM pbase b JOIN rec r USING ({using})),
p2 AS (SELECT *, base_mean + error_correction AS adjusted FROM p1),
pred AS (SELECT *,
           round_even((0.4 * least(1.0, sample_size / 30.0)
                       + 0.4 * (1.0 - least(1.0, 2.0 * margin_error / (abs(adjusted) + 1.0)))
                       + 0.2 * (CASE WHEN is_peak_hour THEN 0.8 ELSE 1.0 END)
                             * (CASE WHEN is_match_day THEN 0.9 ELSE 1.0 END)) * 100.0, 1) AS reliability
         FROM p2)"""


def pred_columns(keys: list[str], label: str = "delay") -> str:
    kk = "".join(f"{x}, " for x in keys)
    return f"""{kk}{TS('target_ts')} AS datetime, {R('adjusted')} AS mean_{label},
  {R('base_mean')} AS base_mean_{label}, {R('error_correction')} AS error_correction,
  {R('median')} AS median_{label}, {R('std')} AS std_{label},
  {R('adjusted - margin_error')} AS confidence_lower, {R('adjusted + margin_error')} AS confidence_upper,
  {R('margin_error')} AS margin_error, sample_size, {R('reliability')} AS reliability,
  is_match_day, is_weekend, is_peak_hour, recent_n"""
