"""Trip-level window operators.

Every window is partitioned by trip and ordered by stop sequence with
departure and platform id as tie-breakers, so results are deterministic.
Rows without a trip id form no trip (their lags and leads are NULL) and are
spread over partitions rather than gathered into one.
All lags/leads share one window spec: one exchange + one sort per plan.
A trip is small (tens of stops), so no partition of these windows can grow
with the data beyond one trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylens.functions import columns as C
from delaylens.functions.joins import dimension
from delaylens.operators.medians import VALUE, WEIGHT
from delaylens.operators.windows import KNOWN, LEAST, MOST, ROWS, SQUARES, SUM
from delaylens.session import bucketed, materialise

TRIP = "rt_trip_id"


def trip_key():
    """Window partition key: the trip id; rows without one form no trip and
    get a row-level key instead, so they never pile up in one partition."""
    row = F.xxhash64(F.col("gtfs_stop_id"), F.col("gtfs_stop_sequence"), F.col("current_stop_departure"))
    return F.coalesce(F.col(TRIP), F.concat(F.lit("\u0000no-trip:"), row.cast("string")))


TRIP_KEY = "_trip_key"


def with_trip_key(df: DataFrame) -> DataFrame:
    return df if TRIP_KEY in df.columns else df.withColumn(TRIP_KEY, trip_key())


def trip_order() -> Window:
    """Window over one trip; the frame must carry ``_trip_key`` (``with_trip_key``)."""
    return (Window.partitionBy(TRIP_KEY)
            .orderBy("gtfs_stop_sequence", "current_stop_departure", "gtfs_stop_id"))


def segments(stop_times: DataFrame) -> DataFrame:
    """Consecutive stop pairs of each trip; the first stop has none."""
    w = trip_order()
    prev = F.lag("gtfs_stop_id").over(w)
    return (with_trip_key(stop_times)
            .select(TRIP, "gtfs_stop_id", "gtfs_stop_sequence", "current_stop_departure",
                    prev.alias("previous_stop_id"))
            .where(F.col("previous_stop_id").isNotNull())
            .select(TRIP, "gtfs_stop_sequence", "previous_stop_id",
                    F.col("gtfs_stop_id").alias("current_stop_id"),
                    F.concat("previous_stop_id", F.lit("_"), "gtfs_stop_id").alias("segment_id_full"),
                    F.concat(C.short_stop_id("previous_stop_id"), F.lit("_"),
                             C.short_stop_id("gtfs_stop_id")).alias("segment_id_short")))


def with_real_times(stop_times: DataFrame) -> DataFrame:
    """Real departure = planned + departure delay; real arrival =
    planned arrival + arrival delay, or real departure when that is unknown."""
    dep, arr = F.col("current_stop_departure"), F.col("current_stop_arrival")
    real_dep = C.add_seconds(dep, "current_stop_dep_delay")
    real_arr = F.when(F.col("current_stop_arr_delay").isNotNull(),
                      C.add_seconds(arr, "current_stop_arr_delay")).otherwise(real_dep)
    return stop_times.withColumns({"real_departure": real_dep, "real_arrival": real_arr})


def trip_travel_times(stop_times: DataFrame, keep_trip_key: bool = False) -> DataFrame:
    """W2+W3: previous stop's planned/real times on one window, travel times
    in seconds (fraction kept) and the section id (NULL on first stops)."""
    w = trip_order()
    base = with_real_times(with_trip_key(stop_times))
    lagged = base.withColumns({
        "previous_stop_departure": F.lag("current_stop_departure").over(w),
        "previous_stop_arrival": F.lag("current_stop_arrival").over(w),
        "previous_stop_id": F.lag("gtfs_stop_id").over(w),
        "real_previous_stop_departure": F.lag("real_departure").over(w),
    })
    out = lagged.withColumns({
        "real_travel_time_seconds": C.seconds_between("real_arrival", "real_previous_stop_departure"),
        # the same in whole microseconds: sums of it are exact and do not
        # depend on partitioning or aggregation order
        "real_travel_time_us": F.timestamp_diff("MICROSECOND", F.col("real_previous_stop_departure"),
                                                F.col("real_arrival")),
        "planned_travel_time_seconds": C.seconds_between("current_stop_arrival",
                                                         "previous_stop_departure"),
        # '||' semantics: NULL when the previous stop is unknown
        "section_id": F.when(F.col("previous_stop_id").isNotNull(),
                             F.concat("previous_stop_id", F.lit("_"), "gtfs_stop_id")),
    })
    return out if keep_trip_key else out.drop(TRIP_KEY)


def with_next_stop(stop_times: DataFrame) -> DataFrame:
    """The next platform of the same trip."""
    return (with_trip_key(stop_times)
            .withColumn("next_stop", F.lead("gtfs_stop_id").over(trip_order())).drop(TRIP_KEY))


def in_trip_order(df: DataFrame) -> DataFrame:
    """O2: rows by trip, then stop sequence (departure and platform break ties);
    a range-partitioned sort, for results that are shown or written in order."""
    keys = [TRIP, "gtfs_stop_sequence", "current_stop_departure", "gtfs_stop_id", "current_stop_id"]
    return df.orderBy(*[c for c in keys if c in df.columns])


def trip_segment_summary(processed: DataFrame, trip_id: str | None = None) -> DataFrame:
    """Per (trip, section): first planned/real start and last planned/real
    end along the stop sequence (NULLs skipped), travel times and start delay.

    ``processed`` is the output of ``trip_travel_times``; rows without a
    section (first stops) are dropped. All trips at once unless ``trip_id``.
    """
    df = processed.where(F.col("section_id").isNotNull())
    if trip_id is not None:
        df = df.where(F.col(TRIP) == trip_id)
    seq = F.col("gtfs_stop_sequence")

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), seq))

    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), seq))

    agg = (df.groupBy(TRIP, "section_id")
           .agg(first("current_stop_departure").alias("planned_start_time"),
                last("current_stop_arrival").alias("planned_end_time"),
                first("real_departure").alias("actual_start_time"),
                last("real_arrival").alias("actual_end_time")))
    return agg.withColumns({
        "planned_travel_time_seconds": C.seconds_between("planned_end_time", "planned_start_time"),
        "actual_travel_time_seconds": C.seconds_between("actual_end_time", "actual_start_time"),
        "delay_seconds": C.seconds_between("actual_start_time", "planned_start_time"),
    })


def segment_rows(stop_times: DataFrame, mode: str = "edge") -> DataFrame:
    """Rows carrying a segment id and a real travel time.

    ``edge`` (default): each stop row is the end of its own segment - one
    window pass, no join, one row per stop after the first.
    ``trip``: the original many-to-many merge on trip id - every row of a
    trip is paired with every segment of that trip (k*(k-1) rows for k
    stops, bounded by the route length). Both sides come out of the same
    window partitioned by the trip key and are joined on that key, so the
    join adds no exchange; it is opt-in, for parity only.
    """
    processed = trip_travel_times(stop_times, keep_trip_key=(mode == "trip"))
    if mode == "edge":
        return (processed.where(F.col("previous_stop_id").isNotNull())
                .withColumns({
                    "segment_id_full": F.concat("previous_stop_id", F.lit("_"), "gtfs_stop_id"),
                    "segment_id_short": F.concat(C.short_stop_id("previous_stop_id"), F.lit("_"),
                                                 C.short_stop_id("gtfs_stop_id")),
                }))
    if mode == "trip":
        # the segments come from the same windowed frame (its previous stop),
        # so both join sides share the partitioning by trip: no extra exchange
        segs = (processed.where(F.col("previous_stop_id").isNotNull())
                .select(TRIP_KEY,
                        F.concat("previous_stop_id", F.lit("_"), "gtfs_stop_id").alias("segment_id_full"),
                        F.concat(C.short_stop_id("previous_stop_id"), F.lit("_"),
                                 C.short_stop_id("gtfs_stop_id")).alias("segment_id_short")))
        return processed.join(segs, TRIP_KEY, "inner").drop(TRIP_KEY)
    raise ValueError(f"unknown mode {mode!r}")


def next_stop(merged: DataFrame, stops: DataFrame) -> DataFrame:
    """For every (station, direction) the most frequent next platform
    (ties -> smallest id), its station and that station's name."""
    nxt = with_next_stop(merged.select(TRIP, "gtfs_stop_id", "gtfs_stop_sequence",
                                       "current_stop_departure", "base_stop_id",
                                       "gtfs_direction_id"))
    counts = (nxt.where(F.col("next_stop").isNotNull())
              .groupBy("base_stop_id", "gtfs_direction_id", "next_stop").count())
    best = (counts.groupBy("base_stop_id", "gtfs_direction_id")
            .agg(F.min_by("next_stop", F.struct(-F.col("count"), F.col("next_stop")))
                 .alias("next_stop_id")))
    best = best.withColumn("next_base_stop_id", C.base_stop_id("next_stop_id"))
    names = stops.select(F.col("base_stop_id").alias("next_base_stop_id"),
                         F.col("stop_name").alias("next_stop_name"))
    return best.join(dimension(names), "next_base_stop_id", "left")


INCIDENCE = "_times"  # how often a segment occurs in a trip


def stored_trips(stop_times: DataFrame, row_keys=()) -> DataFrame:
    """Travel time and segment of every stop row, written once in buckets of the
    trip key: what follows groups and joins by trip without another exchange.
    First stops have neither a segment nor a travel time."""
    segment = F.when(F.col("previous_stop_id").isNotNull(),
                     F.concat(C.short_stop_id("previous_stop_id"), F.lit("_"), C.short_stop_id("gtfs_stop_id")))
    rows = trip_travel_times(stop_times, keep_trip_key=True).select(
        TRIP_KEY, "current_stop_departure", "real_travel_time_us", *row_keys, segment.alias("segment_id_short"))
    return bucketed(rows, TRIP_KEY, "trips")


def incidence(trips: DataFrame) -> DataFrame:
    """The sparse trip x segment table: how often each segment occurs in each trip."""
    return (trips.where(F.col("segment_id_short").isNotNull()).groupBy(TRIP_KEY, "segment_id_short")
            .agg(F.count(F.lit(1)).alias(INCIDENCE)))


def trip_mode_moments(trips: DataFrame, row_keys=(), step_minutes: int = 30) -> DataFrame:
    """``trip``-mode samples of all segments as moments per slot of ``step_minutes``.

    In ``trip`` mode the sample of a segment is every row of every trip that
    contains it, once per occurrence. Counts and sums of such a sample are a
    product of two sparse tables, segment x trip (``incidence``) and trip x
    slot (rows, known values, sum, sum of squares, extremes), so rows never
    meet segments one by one. ``trips`` comes from ``stored_trips``: both
    factors and their join stay in its buckets, and partial sums per segment
    and slot are all that is shuffled.
    """
    us, width = C.epoch_us("current_stop_departure"), step_minutes * 60_000_000
    slot = F.timestamp_micros(us - F.pmod(us, F.lit(width))).cast("timestamp_ntz")
    v = F.col("real_travel_time_us")
    exact = v.cast("decimal(19,0)")
    per_trip = (trips.where(F.col("current_stop_departure").isNotNull())
                .groupBy(TRIP_KEY, *row_keys, slot.alias("current_stop_departure"))
                .agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("k"), F.sum(exact).alias("s"),
                     F.sum(exact * exact).alias("q"), F.min(v).alias("a"), F.max(v).alias("z")))
    times = F.col(INCIDENCE)
    whole = times.cast("decimal(10,0)")
    return materialise(
        incidence(trips).join(per_trip, TRIP_KEY).groupBy("segment_id_short", *row_keys, "current_stop_departure")
        .agg(F.sum(times * F.col("n")).alias(ROWS), F.sum(times * F.col("k")).alias(KNOWN),
             F.sum((whole * F.col("s")).cast("decimal(38,0)")).alias(SUM),
             F.sum((whole * F.col("q")).cast("decimal(38,0)")).alias(SQUARES),
             F.min("a").alias(LEAST), F.max("z").alias(MOST)), "trip-moments")


def trip_mode_values(trips: DataFrame, row_keys=()) -> DataFrame:
    """The same samples as weighted values: per-trip counts by (hour, weekday, keys, value) times the incidence."""
    v = F.col("real_travel_time_us")
    ts = F.col("current_stop_departure")
    counts = (trips.where(ts.isNotNull() & v.isNotNull())
              .groupBy(TRIP_KEY, *row_keys, F.hour(ts).alias("hour"), C.weekday(ts).alias("weekday"), v.alias(VALUE))
              .agg(F.count(F.lit(1)).alias("c")))
    return (incidence(trips).join(counts, TRIP_KEY)
            .select("segment_id_short", *row_keys, "hour", "weekday", VALUE, (F.col("c") * F.col(INCIDENCE)).alias(WEIGHT)))
