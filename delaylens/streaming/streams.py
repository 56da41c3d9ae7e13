"""ST1 incremental stream, ST2 hourly statistics stream, M3 recent errors on a stream.

The batch loader keeps a high-water mark and silently loses late rows (any
row at or before the mark). The stream keeps them: files are read as they
arrive, the event time is watermarked, and duplicates of a (trip, stop
sequence) are dropped while their copies can still arrive, i.e. within the
watermark delay. State is bounded by that delay; a row older than the
watermark is dropped whether or not it was seen before - choose the delay
from the observed lateness, or use ``streaming.accounted``, which keeps such rows.

Each trigger takes all files that have arrived (Spark's default).
``max_files_per_trigger`` is a rate limit only: files are then taken in
arrival order, and rows of a later file that are older than the watermark
set by earlier batches are dropped as late - so it must not be used on
sources whose files are not written in event-time order (such as the
multi-file output of one ST1 batch read by ST2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from delaylens import constants as K
from delaylens.functions import columns as C
from delaylens.session import scratch_path

KEY = ["rt_trip_id", "gtfs_stop_sequence"]


def read_stop_time_files(spark: SparkSession, source_dir: str, schema: StructType,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def dedup_stop_times(stream: DataFrame, delay: str = "1 day",
                     event_col: str = "current_stop_departure") -> DataFrame:
    """Watermark on departure (as TIMESTAMP) + duplicate removal per key."""
    s = stream.withColumn(event_col, F.col(event_col).cast("timestamp"))
    return s.withWatermark(event_col, delay).dropDuplicatesWithinWatermark(KEY)


def incremental_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                       checkpoint_dir: str | None = None, delay: str = "1 day",
                       max_files_per_trigger: int | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """ST1: append new stop times from ``source_dir`` to a Parquet sink."""
    ckpt = checkpoint_dir or scratch_path(spark, "st1-checkpoint")
    s = dedup_stop_times(read_stop_time_files(spark, source_dir, schema, max_files_per_trigger),
                         delay)
    w = (s.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def hourly_stats_stream(spark: SparkSession, source_dir: str, schema: StructType | None, sink_dir: str,
                        checkpoint_dir: str | None = None, delay: str = "2 hours",
                        max_files_per_trigger: int | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """ST2: D1 over tumbling 1-hour event-time windows per platform; a window
    is appended once the watermark passes its end and never changes later.

    ``source_dir`` is meant to be the ST1 sink (deduplicated stop times), so
    replayed or overlapping input files are not counted twice.
    """
    ckpt = checkpoint_dir or scratch_path(spark, "st2-checkpoint")
    if schema is None:
        schema = spark.read.parquet(source_dir).schema
    s = read_stop_time_files(spark, source_dir, schema, max_files_per_trigger)
    s = s.withColumn("current_stop_departure", F.col("current_stop_departure").cast("timestamp"))
    agg = (s.withWatermark("current_stop_departure", delay)
           .groupBy(F.window("current_stop_departure", "1 hour").alias("w"), "gtfs_stop_id")
           .agg(F.avg("current_stop_dep_delay").alias("avg_delay"),
                F.count(F.lit(1)).alias("count"),
                F.stddev_samp("current_stop_dep_delay").alias("std_delay"))
           .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                   "gtfs_stop_id", "avg_delay", "count", "std_delay"))
    w = (agg.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def split_into_day_files(df: DataFrame, path: str, overlap_hours: int = 6,
                         replay_day=None) -> None:
    """Write stop times as one file batch per day, each batch also carrying
    the last ``overlap_hours`` of the previous day (duplicates), plus a
    replay of ``replay_day`` (default: the first day) - the arrival pattern
    the stream has to absorb. One distributed write: every row is routed to
    the batches it belongs to with ``explode`` and ``partitionBy``."""
    dep = F.col("current_stop_departure")
    day = F.to_date(dep)
    first = df.agg(F.min(day).alias("d")) if replay_day is None else None
    late = F.hour(dep) >= 24 - overlap_hours
    routes = F.array(F.date_format(day, "yyyy-MM-dd"))
    routes = F.when(late, F.concat(routes, F.array(F.date_format(F.date_add(day, 1), "yyyy-MM-dd")))) \
        .otherwise(routes)
    routed = df.withColumn("batch", F.explode(routes))
    if replay_day is None:
        replay = df.join(first, day == F.col("d"), "left_semi")
    else:
        replay = df.where(day == F.lit(replay_day).cast("date"))
    routed = routed.unionByName(replay.withColumn("batch", F.lit("replay")))
    routed.write.mode("overwrite").partitionBy("batch").parquet(path)


def error_correction_stream(spark: SparkSession, source_dir: str, schema: StructType | None, sink_dir: str, cells: DataFrame,
                            keys: Sequence[str] = (), checkpoint_dir: str | None = None, delay: str = "2 hours",
                            value_col: str = "current_stop_dep_delay", step_minutes: int = 60, offset_minutes: int = 30,
                            max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """M3 on a stream: for targets every ``step_minutes`` (``offset_minutes`` past the hour)
    the recent rows, their mean and the correction, appended once the
    watermark passes a target and never changed later.

    The rows before a target are a sliding event-time window of an hour that
    ends there, so the state holds, per key, the windows of the last hour and
    the delay, each a count and a sum, whatever the number of rows; the
    watermark removes them. ``cells`` is the static history (``predict.cell_stats``
    of the same keys), joined by hour and weekday of the target. Targets
    without recent rows have no row (their correction is 0).
    """
    if 60 % step_minutes:
        raise ValueError("targets must divide the hour")
    ckpt = checkpoint_dir or scratch_path(spark, "m3-checkpoint")
    if schema is None:
        schema = spark.read.parquet(source_dir).schema
    time, keys = "current_stop_departure", list(keys)
    s = read_stop_time_files(spark, source_dir, schema, max_files_per_trigger).withColumn(time, F.col(time).cast("timestamp"))
    window = F.window(time, f"{K.RECENT_WINDOW_MINUTES} minutes", f"{step_minutes} minutes", f"{offset_minutes % step_minutes} minutes")
    recent = (s.withWatermark(time, delay).groupBy(window.alias("w"), *keys)
              .agg(F.count(F.lit(1)).alias("recent_n"), F.sum(value_col).alias("recent_sum"), F.count(value_col).alias("recent_cnt"))
              .withColumn("target_ts", F.col("w.end"))
              .withColumns({"hour": F.hour("target_ts"), "weekday": C.weekday("target_ts")}))
    mean = F.try_divide(F.col("recent_sum"), F.col("recent_cnt"))
    correction = F.when(F.col("recent_n") >= K.MIN_RECENT, mean - F.col("base_mean")).otherwise(F.lit(0.0))
    out = (recent.join(cells.select("hour", "weekday", *keys, "base_mean", "sample_size"), ["hour", "weekday", *keys])
           .select(*keys, "target_ts", "base_mean", "recent_n", correction.alias("error_correction")))
    w = (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
