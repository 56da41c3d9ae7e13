"""Delay statistics (D1-D8, D21-D23) and the newest-rows sample (IO10).

All statistics are computed for every date at once (grouping by ``date``);
a dashboard selecting one date filters the result, which Catalyst pushes
below the aggregation. Aggregations are partial (map-side) + final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylens import constants as K
from delaylens.functions import columns as C
from delaylens.operators.prepare import filter_date_hours

DELAY = "current_stop_dep_delay"


def hourly_stats(prepared: DataFrame) -> DataFrame:
    """Per (date, hour, platform): mean delay, row count, sample std."""
    return (prepared.groupBy("date", "hour", "gtfs_stop_id")
            .agg(F.avg(DELAY).alias("avg_delay"),
                 F.count(F.lit(1)).alias("count"),
                 F.stddev_samp(DELAY).alias("std_delay")))


def daily_stats(prepared: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per date: mean, std, rows and distinct platforms.

    ``approx_distinct`` swaps the exact distinct count (an extra expand +
    shuffle on (date, platform)) for a HyperLogLog++ sketch.
    """
    distinct = (F.approx_count_distinct("gtfs_stop_id") if approx_distinct
                else F.count_distinct("gtfs_stop_id"))
    return (prepared.groupBy("date")
            .agg(F.avg(DELAY).alias("avg_delay"),
                 F.stddev_samp(DELAY).alias("std_delay"),
                 F.count(F.lit(1)).alias("total_records"),
                 distinct.alias("unique_stops")))


def basic_stats(merged: DataFrame, hour_range=(0, 24), date=None) -> DataFrame:
    """D3: per date: mean and max delay (NULL as 0) and distinct stations."""
    f = filter_date_hours(merged.select("date", "current_stop_departure", DELAY, "base_stop_id"),
                          date=date, hour_range=hour_range)
    return (f.groupBy("date")
            .agg(F.avg(DELAY).alias("avg_delay"),
                 F.max(DELAY).alias("max_delay"),
                 F.count_distinct("base_stop_id").alias("total_stops")))


def delay_distribution(merged: DataFrame, hour_range=(0, 24), date=None) -> DataFrame:
    """Per date, five delay bins in fixed order, empty bins kept as 0.

    One pass of conditional counts (no per-bin grouping), then ``stack``
    turns the five counts into rows.
    """
    f = filter_date_hours(merged.select("date", "current_stop_departure", DELAY),
                          date=date, hour_range=hour_range)
    d = F.col(DELAY)
    counts = []
    for i, (label, lo, hi) in enumerate(K.DELAY_BINS):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (d > lo)
        if hi is not None:
            cond = cond & (d <= hi)
        counts.append(F.count_if(cond).alias(f"b{i}"))
    agg = f.groupBy("date").agg(*counts)
    stack_args = ", ".join(f"{i}, '{label}', b{i}" for i, (label, _, _) in enumerate(K.DELAY_BINS))
    return agg.select("date", F.expr(f"stack({len(K.DELAY_BINS)}, {stack_args})")
                      .alias("bin_index", "delay_range", "count"))


def hourly_trends(merged: DataFrame, dates=None) -> DataFrame:
    """D5 (+U1): mean delay by hour for the given dates (all when None),
    labelled with the date text; NULL delays are skipped, not zeroed."""
    df = merged
    if dates is not None:
        df = df.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    return (df.groupBy("date", F.hour("current_stop_departure").alias("Hour"))
            .agg(F.avg(DELAY).alias("avg_delay"))
            .select(F.col("date").cast("string").alias("Date"), "Hour", "avg_delay"))


def stop_map(merged: DataFrame, hour_range=(0, 24), date=None) -> DataFrame:
    """D6 (+P10, P11): per date and station: mean position, name, mean delay
    (NULL as 0), its colour class and minutes, and the marker's tooltip where it has a position."""
    f = filter_date_hours(merged.select("date", "current_stop_departure", DELAY, "base_stop_id",
                                        "stop_name", "avg_latitude", "avg_longitude"),
                          date=date, hour_range=hour_range)
    agg = (f.groupBy("date", "base_stop_id")
           .agg(F.avg("avg_latitude").alias("avg_latitude"),
                F.avg("avg_longitude").alias("avg_longitude"),
                F.min("stop_name").alias("stop_name"),
                F.avg(DELAY).alias("avg_delay")))
    seconds = F.bround("avg_delay", 0).cast("bigint").cast("string")
    minutes = (F.bround(C.to_minutes("avg_delay") * 100, 0).cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")
    tooltip = F.concat("stop_name", F.lit(" - Avg Delay: "), seconds, F.lit(" secs ("), minutes, F.lit(" mins)"))
    return agg.withColumns({"color": C.delay_color("avg_delay"),
                            "avg_delay_min": C.to_minutes("avg_delay"),
                            "tooltip": F.when(F.col("avg_latitude").isNotNull() & F.col("avg_longitude").isNotNull(),
                                              tooltip)})


def heatmap_points(stop_map_df: DataFrame) -> DataFrame:
    """(date, lat, lon, mean delay in minutes) with known coordinates."""
    return (stop_map_df.where(F.col("avg_latitude").isNotNull() & F.col("avg_longitude").isNotNull())
            .select("date", "avg_latitude", "avg_longitude", "avg_delay_min"))


def map_center(stops: DataFrame) -> DataFrame:
    """Mean latitude and longitude of the stop dimension."""
    return stops.agg(F.avg("avg_latitude").alias("center_latitude"),
                     F.avg("avg_longitude").alias("center_longitude"))


def data_freshness(df: DataFrame) -> DataFrame:
    """Newest ``updated_at``."""
    return df.agg(F.max("updated_at").alias("last_updated"))


def high_water_mark(df: DataFrame) -> DataFrame:
    """Newest departure (the incremental-load watermark)."""
    return df.agg(F.max("current_stop_departure").alias("max_departure"))


SAMPLE_LEVELS_US = (3_600_000_000, 1_000_000)   # hour, second


def newest_sample(df: DataFrame, n: int = K.SAMPLE_ROWS, ts_col: str = "current_stop_departure",
                  levels_us=SAMPLE_LEVELS_US, ties=("rt_trip_id", "gtfs_stop_sequence"), ordered: bool = False) -> DataFrame:
    """IO10/O1: the newest ``n`` rows by departure (NULL departures last);
    ``ordered`` also returns them in that order (a range-partitioned sort).

    ``orderBy().limit(n)`` would make every partition send its own top ``n``
    rows to one final task. Here the table is read twice. The first read, of
    one column, counts rows by second, with counts by hour added up from them;
    from these the boundary second follows (where the n-th row lies) and how
    many of its rows are wanted. The second read takes every newer row, and
    the wanted ones of the boundary second in the order of departure and
    ``ties``; each task keeps that many of them at most.
    """
    if n < 1:
        return df.limit(0)
    ts = F.col(ts_col)
    coarse, fine = levels_us
    us = F.unix_micros(ts.cast("timestamp"))
    order = [ts.desc_nulls_last(), *[c for c in ties if c in df.columns]]
    # NULL departures are one bucket below all others
    seconds = (df.groupBy(F.floor(us / F.lit(float(fine))).cast("bigint").alias("b")).count()
               .withColumn("h", F.floor(F.col("b") * F.lit(fine) / F.lit(float(coarse))).cast("bigint")))
    before = Window.unboundedPreceding
    hours = seconds.groupBy("h").agg(F.sum("count").alias("of_hour"))
    newer = F.coalesce(F.sum("of_hour").over(Window.orderBy(F.col("h").desc_nulls_last()).rowsBetween(before, -1)), F.lit(0))
    # hours of the table's whole span are few; one of them holds the n-th row
    hour = hours.withColumn("newer", newer).where((F.col("newer") < n) & (F.col("newer") + F.col("of_hour") >= n)).select("h", "newer")
    inside = seconds.join(F.broadcast(hour.withColumnRenamed("h", "_h")), F.col("h").eqNullSafe(F.col("_h")))
    above = F.coalesce(F.sum("count").over(Window.orderBy(F.col("b").desc_nulls_last()).rowsBetween(before, -1)), F.lit(0)) + F.col("newer")
    edge = (inside.withColumn("above", above).where((F.col("above") < n) & (F.col("above") + F.col("count") >= n))
            .select("b", "above").first())
    if edge is None:                     # no more than n rows: all of them
        return df.orderBy(*order) if ordered else df
    second, wanted = edge["b"], n - edge["above"]
    if second is None:                   # all dated rows, and some without a departure
        sure, boundary = ts.isNotNull(), ts.isNull()
    else:
        sure, boundary = us >= (second + 1) * fine, (us >= second * fine) & (us < (second + 1) * fine)
        df = df.where(us >= second * fine)
    # a newer row is a group of its own, the boundary's rows are one: the limit reaches every task before the shuffle
    names = df.columns
    group, place = (next(x for k in range(len(names) + 1) if (x := f"_{name}{k}") not in names) for name in ("group", "place"))
    grouped = df.where(sure | boundary).withColumn(group, F.when(sure, F.monotonically_increasing_id()).otherwise(-1))
    ranked = grouped.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    sample = ranked.where(F.col(place) <= wanted).select(*names)
    return sample.orderBy(*order) if ordered else sample
