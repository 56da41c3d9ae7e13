"""Domain views built from the generic test tables.

The stop-time table ``st`` is derived from ``events``, the stop dimension from
``nation`` and the match calendar is a six-row literal covering home, away,
missing opponent, undecided kickoff and missing date. The derivation rules
are the documented fixture rules; they are stated once here and once as SQL
text in ``delaylens.plans.oracle`` for the cross-engine check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# --- fixed values: the literal match calendar (Date, Time, Location, Opponent)
MATCH_ROWS = (
    ("06.01.2024", "19:00", "D", "FK Alpha"),
    ("10.01.2024", "21:00", "V", "FC Beta"),
    ("14.01.2024", "15:00", "D", None),
    ("20.01.2024", "?", "D", "SK Gamma"),
    ("", "", "V", "FK Delta"),
    ("27.01.2024", "17:00", "V", "FK Alpha"),
)
STATION_IDS = 27  # ids in the stop times: two more than nations, so that some have no station
MATCH_SCHEMA = StructType([StructField(n, StringType(), True)
                           for n in ("Date", "Time", "Location", "Opponent")])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stop_times_from_events(events: DataFrame) -> DataFrame:
    """Raw stop times: one row per event; a trip is a user's events of one day."""
    e = events
    day = F.to_date("ts")
    eid, uid = F.col("event_id"), F.col("user_id")
    base = F.concat(F.lit("U"), (F.lit(100) + (eid * 7 + uid) % STATION_IDS).cast("string"))
    suffix = F.when(eid % 13 == 0, F.lit("S1")).otherwise(
        F.concat(F.lit("Z"), (F.lit(1) + uid % 4).cast("string"), F.lit("P")))
    delay = F.floor("value").cast("int")
    trip_order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    return e.select(
        F.concat(uid.cast("string"), F.lit("_"), day.cast("string")).alias("rt_trip_id"),
        F.concat(base, suffix).alias("gtfs_stop_id"),
        F.col("ts").alias("current_stop_departure"),
        F.when(eid % 17 == 0, F.lit(None).cast("int")).otherwise(delay - 22)
        .alias("current_stop_dep_delay"),
        F.timestamp_add("SECOND", -(eid % 40).cast("int"), F.col("ts")).alias("current_stop_arrival"),
        F.when(eid % 5 == 0, F.lit(None).cast("int")).otherwise(delay - 25)
        .alias("current_stop_arr_delay"),
        F.row_number().over(trip_order).cast("int").alias("gtfs_stop_sequence"),
        F.col("event_type").alias("gtfs_route_short_name"),
        (eid % 2).cast("int").alias("gtfs_direction_id"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def stops_from_nation(nation: DataFrame) -> DataFrame:
    """Stop dimension: a station per nation, with coordinates near each other."""
    k = F.col("n_nationkey")
    return (nation
            .select(F.concat(F.lit("U"), (F.lit(100) + k).cast("string")).alias("base_stop_id"),
                    F.col("n_name").alias("stop_name"),
                    (F.lit(50.095).cast("decimal(10,3)") + F.lit(0.001).cast("decimal(10,3)") * k)
                    .cast("double").alias("avg_latitude"),
                    (F.lit(14.404).cast("decimal(10,3)") + F.lit(0.003).cast("decimal(10,3)") * k)
                    .cast("double").alias("avg_longitude")))


def match_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MATCH_ROWS), MATCH_SCHEMA)


def load_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``st`` (raw stop times), ``stops`` and ``matches_raw`` for one scale."""
    return {
        "st": stop_times_from_events(read_table(spark, sf_dir, "events")),
        "stops": stops_from_nation(read_table(spark, sf_dir, "nation")),
        "matches_raw": match_rows(spark),
    }
