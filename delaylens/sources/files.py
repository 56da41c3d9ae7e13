"""File sources and sinks for stop times, stops and match calendars
(IO1-IO12, IO15-IO18).

Writes are single distributed jobs (``partitionBy`` date, bounded file
sizes through ``maxRecordsPerFile``); appends go by column name (Parquet is
self-describing), never by position.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType)

from delaylens.functions import columns as C
from delaylens.functions.joins import broadcast_if_small
from delaylens.operators.prepare import prepare_stop_times
from delaylens.operators.stats import hourly_stats

STOPS_CSV_SCHEMA = StructType([
    StructField("_index", IntegerType(), True),
    StructField("stop_name", StringType(), True),
    StructField("avg_longitude", DoubleType(), True),
    StructField("avg_latitude", DoubleType(), True),
    StructField("base_stop_id", StringType(), True),
    StructField("all_stop_ids", StringType(), True),
])

MATCH_CSV_COLUMNS = ("Home Team", "Away Team", "Opponent", "is_home", "Competition", "Round",
                     "Date", "Time", "Score", "Location", "datetime")
SEMICOLON_COLUMNS = ("Skip", "Location", "Date", "Time", "Opponent")
MAX_RECORDS_PER_FILE = 1_000_000
PUSHED_IDS, PUSHED_LISTS = 1_000, 100  # ids, and lists of them, that are sent to the Parquet reader as filters


# ------------------------------------------------------------ stop history
def _stop_id_frame(spark: SparkSession, stop_ids) -> DataFrame:
    if isinstance(stop_ids, DataFrame):
        return stop_ids.select(F.col(stop_ids.columns[0]).alias("gtfs_stop_id")).distinct()
    return spark.createDataFrame([(s,) for s in stop_ids], "gtfs_stop_id string")


def pushed_ids(column: str, ids: Sequence[str]) -> F.Column:
    """Membership in a list of ids as a filter that the Parquet reader can use to skip row groups.

    Lists up to the reader's threshold (``spark.sql.parquet.pushdown.inFilterThreshold``) reach it
    as they are, longer ones only as a range; they are cut into lists of that length by id order.
    """
    ids = sorted(set(ids))
    threshold = int(SparkSession.active().conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
    lists = [ids[k: k + max(1, threshold)] for k in range(0, len(ids), max(1, threshold))]
    if len(lists) > PUSHED_LISTS:
        return F.col(column).isin(ids)
    out = F.lit(False)
    for part in lists:
        out = out | F.col(column).isin(part)
    return out


def scan_history(spark: SparkSession, path: str, stop_ids, years: Sequence[int] = (2024, 2025),
                 start=None, year_col: str = "year") -> DataFrame:
    """IO1: history Parquet (partitioned by year/month/day) for some years
    and platform ids, optionally only departures after ``start``.

    The year filter prunes partitions and ``start`` is pushed into the scan.
    Platform ids, a Python list or an id DataFrame of up to ``PUSHED_IDS`` rows
    (a bounded read), become filters in the Parquet reader: with the layout of
    ``write_history`` min/max statistics and Bloom filters skip row groups
    without these ids. A longer id table is a semi-join: its side is broadcast
    once a bounded count proves it small, and from there on the planner's
    runtime filters (``session.DEFAULT_CONF``) thin the history before a shuffle.
    """
    df = spark.read.option("basePath", path).parquet(path)
    if year_col in df.columns and years is not None:
        df = df.where(F.col(year_col).isin(list(years)))
    if start is not None:
        df = df.where(F.col("current_stop_departure") > F.lit(start).cast("timestamp_ntz"))
    if isinstance(stop_ids, DataFrame):
        ids = _stop_id_frame(spark, stop_ids).where(F.col("gtfs_stop_id").isNotNull())
        few = [r[0] for r in ids.limit(PUSHED_IDS + 1).collect()]
        if len(few) > PUSHED_IDS:
            return df.join(broadcast_if_small(ids), "gtfs_stop_id", "left_semi")
        stop_ids = few
    return df.where(pushed_ids("gtfs_stop_id", list(stop_ids)))


def write_history(df: DataFrame, path: str, mode: str = "append", row_group_bytes: int = 32 << 20,
                  expected_ids: int = 20_000) -> None:
    """Lay out stop times as year/month/day partitions for lookups by platform.

    Rows are sorted by platform within each file, so that the row groups of a
    day cover ranges of ids, and carry Bloom filters of them; an id's rows then
    lie in one or two row groups of a file, and the others are never read.
    """
    dep = F.col("current_stop_departure")
    laid = df.withColumns({"year": F.year(dep), "month": F.month(dep), "day": F.dayofmonth(dep)})
    days = ["year", "month", "day"]
    (balanced_for_write(laid, days).sortWithinPartitions(*days, "gtfs_stop_id", "current_stop_departure")
     .write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.bloom.filter.enabled#gtfs_stop_id", "true")
     .option("parquet.bloom.filter.expected.ndv#gtfs_stop_id", expected_ids)
     .partitionBy(*days).parquet(path))


def stop_id_list(stops: DataFrame, column: str = "all_stop_ids") -> DataFrame:
    """IO2: platform ids of all stations as a sorted, distinct list.

    ``all_stop_ids`` holds list text such as ``['U187Z1P', 'U187Z2P']``; text
    that does not parse is kept whole as one id.
    """
    c = F.col(column)
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    ids = F.explode(F.coalesce(parsed, F.array(c)))
    return (stops.where(c.isNotNull()).select(ids.alias("gtfs_stop_id"))
            .distinct().orderBy("gtfs_stop_id"))


def high_water_mark_value(target: DataFrame):
    """Newest departure of the target (one scalar) or None when empty.

    A target with a ``date`` column is read in its newest dates only: the
    newest date comes from the partitions, departures from that date on.
    """
    if "date" in target.columns:
        newest = target.agg(F.max("date").alias("d")).first()["d"]
        if newest is not None:
            target = target.where((F.col("date") >= F.lit(newest)) | F.col("date").isNull())
    row = target.agg(F.max("current_stop_departure").alias("m")).first()
    return None if row is None else row["m"]


def incremental_rows(target: DataFrame | None, source: DataFrame, exact: bool = False) -> DataFrame:
    """IO3: source rows newer than the target's high-water mark.

    Missing or empty target -> everything. By default the threshold is the
    original one: the mark plus one second, truncated to whole seconds, rows
    strictly after it. ``exact=True`` takes rows strictly after the mark.
    The threshold is a literal, so it reaches the source scan; a source with a
    ``date`` column also gets the implied bound on it, which prunes date
    partitions. The streaming form (ST1) also keeps late rows.
    """
    hwm = None if target is None else high_water_mark_value(target)
    if hwm is None:
        return source
    lit = F.lit(hwm).cast("timestamp_ntz")
    threshold = lit if exact else F.date_trunc("second", F.timestamp_add("SECOND", F.lit(1), lit)) \
        .cast("timestamp_ntz")
    if "date" in source.columns:
        source = source.where((F.col("date") >= F.lit(hwm.date())) | F.col("date").isNull())
    return source.where(F.col("current_stop_departure") > threshold)


def incremental_load(spark: SparkSession, target_path: str, source: DataFrame,
                     exact: bool = False) -> DataFrame:
    """IO3+IO4: append the new rows to the Parquet table at ``target_path``
    (created on first use) and return the new rows' frame."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target_path)
    exists = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    # a table that is there but cannot be read is an error, not a first load
    target = spark.read.parquet(target_path) if exists else None
    new = incremental_rows(target, source, exact=exact)
    persist_stop_times(new, target_path)
    return new


def balanced_for_write(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """Deal rows by the partition columns before a ``partitionBy`` write with
    a REBALANCE hint: few files per date, and adaptive execution splits a hot
    date over several tasks by measured size. No sampling pass, so the plan
    below runs once."""
    return df.hint("rebalance", *[F.col(c) for c in partition_cols]) if partition_cols else df


def persist_stop_times(df: DataFrame, path: str, partition_by: Sequence[str] = ("date",),
                       balance: bool = True) -> None:
    """IO4/IO12: create or append; partitioned by date when present."""
    cols = [c for c in partition_by if c in df.columns]
    if "date" in partition_by and "date" not in df.columns and "current_stop_departure" in df.columns:
        df = df.withColumn("date", F.to_date("current_stop_departure"))
        cols = list(partition_by)
    if balance and cols:
        df = balanced_for_write(df, cols)
    w = df.write.mode("append").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    (w.partitionBy(*cols) if cols else w).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """IO5: CSV with a header row (one part file per task)."""
    (df.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def merge_dedup(old: DataFrame, new: DataFrame) -> DataFrame:
    """IO6/U2: old + new rows by column name, exact duplicates removed."""
    return old.unionByName(new, allowMissingColumns=True).dropDuplicates()


def load_stop_times(raw: DataFrame, path: str) -> None:
    """IO12: prepare (P1-P3) and append in one distributed write."""
    persist_stop_times(prepare_stop_times(raw), path)


def hourly_stats_table(prepared: DataFrame, path: str) -> None:
    """IO16: D1 stored as a Parquet table partitioned by date; date/hour
    lookups prune partitions instead of using an index."""
    (balanced_for_write(hourly_stats(prepared), ["date"])
     .write.mode("overwrite").partitionBy("date").parquet(path))


def ad_hoc_parquet(spark: SparkSession, glob: str, stop_name: str) -> DataFrame:
    """IO18: glob read of Parquet files, rows of one stop name (pushed down)."""
    return spark.read.parquet(glob).where(F.col("stop_name") == stop_name)


# ---------------------------------------------------------------- stops
def read_stops(spark: SparkSession, path: str) -> DataFrame:
    """IO7: the stops CSV (leading nameless index column dropped)."""
    return (spark.read.schema(STOPS_CSV_SCHEMA).option("header", True).csv(path)
            .drop("_index"))


def write_stops_csv(stops: DataFrame, path: str) -> None:
    """Stops CSV in the stored layout: index, name, lon, lat, id, id list."""
    (stops.select(F.lit(0).alias("_index"), "stop_name", "avg_longitude", "avg_latitude",
                  "base_stop_id", "all_stop_ids")
     .write.mode("overwrite").option("header", True).csv(path))


def id_list_text(ids_col) -> F.Column:
    """Sorted id array -> list text ``['a', 'b']``."""
    return F.concat(F.lit("['"), F.array_join(C.col(ids_col), "', '"), F.lit("']"))


def normalize_stops(platforms: DataFrame) -> DataFrame:
    """IO15: platforms -> stations: mean position, sorted platform id list
    (array and list text). Groups are stations: a handful of platforms."""
    p = platforms.withColumn("base_stop_id", C.base_stop_id("gtfs_stop_id"))
    g = (p.groupBy("base_stop_id", "stop_name")
         .agg(F.avg("avg_latitude").alias("avg_latitude"),
              F.avg("avg_longitude").alias("avg_longitude"),
              F.sort_array(F.collect_set("gtfs_stop_id")).alias("stop_ids")))
    return g.withColumn("all_stop_ids", id_list_text("stop_ids"))


def upsert_stops(existing: DataFrame, updates: DataFrame, key: str = "base_stop_id",
                 order_col: str | None = None) -> DataFrame:
    """IO11: insert new keys, replace existing ones (by column name).

    Several updates of one key keep the greatest ``order_col``, the last one
    written. Rows of a DataFrame have no order of their own: without
    ``order_col`` a repeated key is an error.
    """
    if order_col is None:
        if updates.groupBy(key).count().where(F.col("count") > 1).limit(1).count():
            raise ValueError(f"several updates of one {key}: name the column that orders them")
        upd = updates
    else:
        upd = (updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), F.col(order_col)).alias("_r"))
               .select("_r.*"))
    kept = existing.join(upd.select(key), key, "left_anti")
    return kept.unionByName(upd, allowMissingColumns=True)


def stops_lookup(stops: DataFrame, base_stop_id: str) -> DataFrame:
    """IO17: one station by id (an equality filter on the dimension)."""
    return stops.where(F.col("base_stop_id") == base_stop_id)


# -------------------------------------------------------------- matches
def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """IO8: the comma-separated match calendar, all text, then typed by
    ``events.match_calendar``."""
    from delaylens.operators.events import match_calendar
    schema = StructType([StructField(c, StringType(), True) for c in MATCH_CSV_COLUMNS])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return match_calendar(raw)


def read_matches_semicolon(spark: SparkSession, path: str) -> DataFrame:
    """IO9: ';'-separated calendar with positional columns (header skipped,
    first column dropped), home flag from Location, opponent default."""
    from delaylens.operators.events import match_calendar
    schema = StructType([StructField(c, StringType(), True) for c in SEMICOLON_COLUMNS])
    raw = (spark.read.schema(schema).option("header", True).option("sep", ";")
           .option("encoding", "UTF-8").csv(path).drop("Skip"))
    return match_calendar(raw)


def write_lines(spark: SparkSession, lines: Iterable[str], path: str) -> None:
    """Helper for tests and examples: small text files."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)
