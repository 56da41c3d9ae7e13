"""Registered queries of the stored tables (batches, versions, the kept summary) and of streams that use
them, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from delaylens.operators import predict as PR
from delaylens.plans.catalog import (_PLATFORMS_SQL, _SPLIT_DAY, _ST_COLS, _ST_NAMES, _pred_query, _stations, merged,
                                     prepared, register, views)
from delaylens.plans.oracle import D, R, TS, pred_columns
from delaylens.session import materialise, scratch_path
from delaylens.sources import fixtures, stored, summary
from delaylens.streaming import accounted
from delaylens.streaming import streams as STR


def _split():
    return F.lit(_SPLIT_DAY).cast("timestamp_ntz")


@register("append_batches", f"SELECT {_ST_COLS} FROM st")
def q_append_batches(spark, sf_dir):
    """Two batches, the second asked for twice: every row once."""
    st = views(spark, sf_dir)["st"]
    table = stored.StoredTable(spark, scratch_path(spark, "batches"))
    table.append(st.where(F.col("current_stop_departure") < _split()), "first")
    for _ in range(2):
        stored.append_incremental(table, st, "second", exact=True)
    return table.read().select(*_ST_NAMES)


_STATION = ["base_stop_id", "stop_name", "avg_latitude", "avg_longitude", "all_stop_ids"]


@register("upsert_stored", f"""
WITH {_PLATFORMS_SQL},
one AS (SELECT base_stop_id, stop_name, avg_latitude, avg_longitude, all_stop_ids FROM norm
        UNION ALL SELECT base_stop_id, stop_name, avg_latitude, avg_longitude, NULL FROM stops
        WHERE base_stop_id NOT IN (SELECT base_stop_id FROM norm)),
two AS (SELECT base_stop_id, stop_name || ' (moved)' AS stop_name, avg_latitude, avg_longitude, NULL AS all_stop_ids
        FROM stops WHERE base_stop_id LIKE '%3'
        UNION ALL SELECT base_stop_id || 'B', stop_name, avg_latitude, avg_longitude, NULL FROM stops WHERE base_stop_id LIKE '%7')
SELECT base_stop_id, stop_name, {R('avg_latitude')} AS avg_latitude, {R('avg_longitude')} AS avg_longitude, all_stop_ids
FROM (SELECT * FROM one WHERE base_stop_id NOT IN (SELECT base_stop_id FROM two) UNION ALL SELECT * FROM two)
""")
def q_upsert_stored(spark, sf_dir):
    stops = views(spark, sf_dir)["stops"].withColumn("all_stop_ids", F.lit(None).cast("string")).select(*_STATION)
    table = stored.StoredTable(spark, scratch_path(spark, "stations"))
    table.replace(stops)
    stored.upsert_table(table, _stations(spark, sf_dir).select(*_STATION))
    moved = stops.where(F.col("base_stop_id").endswith("3")).withColumn("stop_name", F.concat("stop_name", F.lit(" (moved)")))
    built = stops.where(F.col("base_stop_id").endswith("7")).withColumn("base_stop_id", F.concat("base_stop_id", F.lit("B")))
    return stored.upsert_table(table, moved.unionByName(built))


def _summary(spark, sf_dir) -> stored.StoredTable:
    rows = prepared(spark, sf_dir)
    table = stored.StoredTable(spark, scratch_path(spark, "summary"), ["date"])
    summary.update(table, rows.where(F.col("current_stop_departure") < _split()), "first")
    for _ in range(2):
        summary.update(table, rows.where(F.col("current_stop_departure") >= _split()), "second")
    return table


@register("hourly_summary", f"""
SELECT {D('date')} AS date, hour, gtfs_stop_id, {R('avg(current_stop_dep_delay)')} AS avg_delay, count(*) AS count,
       {R('stddev_samp(current_stop_dep_delay)')} AS std_delay
FROM prepared GROUP BY date, hour, gtfs_stop_id
""")
def q_hourly_summary(spark, sf_dir):
    return summary.hourly(_summary(spark, sf_dir))


@register("daily_summary", f"""
SELECT {D('date')} AS date, {R('avg(current_stop_dep_delay)')} AS avg_delay,
       {R('stddev_samp(current_stop_dep_delay)')} AS std_delay, count(*) AS total_records
FROM prepared GROUP BY date
""")
def q_daily_summary(spark, sf_dir):
    table = _summary(spark, sf_dir)
    summary.compact(table)
    return summary.daily(table).drop("unique_stops", "unique_trips")  # estimates; see tests/test_stored.py


_HELD = "event_id % 29 = 0"          # rows that arrive only at the end
_HELD_DAY, _OVERLAP_DAY = "2024-01-08", "2024-01-14"


def _arrivals(spark, sf_dir):
    """Three arrivals: up to a day, from two days before it on, then a replay of old days with held rows."""
    e = fixtures.read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u"), "ts", "event_id")
    st = views(spark, sf_dir)["st"]
    keyed = st.join(e.select(F.concat("u", F.lit("_"), F.to_date("ts").cast("string")).alias("t"), F.col("ts").alias("moment"), "event_id"),
                    (st["rt_trip_id"] == F.col("t")) & (st["current_stop_departure"] == F.col("moment")))
    old = F.col("current_stop_departure") < F.lit(_HELD_DAY).cast("timestamp_ntz")
    held = old & F.expr(_HELD)
    first = F.col("current_stop_departure") < _split()
    again = F.col("current_stop_departure") >= F.lit(_OVERLAP_DAY).cast("timestamp_ntz")
    return [keyed.where(c).select(*st.columns) for c in (first & ~held, again, old)]


@register("late_rows", f"""
WITH held AS (SELECT cast(user_id AS VARCHAR) || '_' || cast(cast(ts AS DATE) AS VARCHAR) AS t, ts AS moment
              FROM events WHERE {_HELD} AND ts < TIMESTAMP '{_HELD_DAY}'),
parts AS (
  SELECT 'sink' AS place, st.* FROM st WHERE NOT EXISTS (SELECT 1 FROM held WHERE t = rt_trip_id AND moment = current_stop_departure)
  UNION ALL SELECT 'late', st.* FROM st WHERE current_stop_departure < TIMESTAMP '{_HELD_DAY}')
SELECT place, rt_trip_id, gtfs_stop_sequence, {TS('current_stop_departure')} AS current_stop_departure FROM parts
""")
def q_late_rows(spark, sf_dir):
    """ST1 with the late table: replays inside the delay are duplicates, older arrivals are kept as late."""
    src, path, ckpt = (scratch_path(spark, x) for x in ("arrivals", "accounted", "accounted-checkpoint"))
    for n, rows in enumerate(_arrivals(spark, sf_dir)):
        rows.write.parquet(f"{src}/{n}")
        accounted.accounted_stream(spark, f"{src}/*", rows.schema, path, ckpt, delay="3 DAYS").awaitTermination()
    tables = accounted.Tables.at(spark, path)
    names = ["rt_trip_id", "gtfs_stop_sequence", "current_stop_departure"]
    return (tables.sink.read().select(F.lit("sink").alias("place"), *names)
            .unionByName(tables.late.read().select(F.lit("late").alias("place"), *names)))


_M3_DELAY_HOURS = 2


@register("error_correction_stream", _pred_query([], "bounded", extra_ctes="""
slots AS (SELECT DISTINCT date_trunc('hour', ts + INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE AS target_ts FROM h)""").replace(
    f"SELECT {pred_columns([])} FROM pred",
    f"SELECT {TS('target_ts')} AS target_ts, {R('base_mean')} AS base_mean, recent_n, {R('error_correction')} AS error_correction "
    f"FROM pred WHERE recent_n > 0 AND target_ts <= (SELECT max(ts) FROM h) - INTERVAL {_M3_DELAY_HOURS} HOUR "))
def q_error_correction_stream(spark, sf_dir):
    """Targets at half past every hour with recent rows that the watermark has passed."""
    rows = merged(spark, sf_dir)
    src, sink = scratch_path(spark, "m3-source"), scratch_path(spark, "m3-sink")
    rows.select("current_stop_departure", "current_stop_dep_delay").write.parquet(src)
    cells = materialise(PR.cell_stats(rows), "cells")
    STR.error_correction_stream(spark, src, None, sink, cells, delay=f"{_M3_DELAY_HOURS} hours").awaitTermination()
    return spark.read.parquet(sink).select("target_ts", "base_mean", "recent_n", "error_correction")
