"""Preparation, projections and filters over stop times."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from delaylens.functions import columns as C
from delaylens.functions.joins import dimension

PREPARED_COLUMNS = ("rt_trip_id", "gtfs_stop_id", "current_stop_departure",
                    "current_stop_dep_delay", "gtfs_stop_sequence",
                    "gtfs_route_short_name", "gtfs_direction_id")


def parse_timestamp(c, fmt: str | None = None):
    """Timestamp from text (bad text -> NULL) or pass a timestamp through."""
    c = C.col(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def _as_timestamp(df: DataFrame, name: str):
    dtype = df.schema[name].dataType
    if isinstance(dtype, StringType):
        return parse_timestamp(name)
    return F.col(name)


def prepare_stop_times(df: DataFrame, include_base_stop_id: bool = True) -> DataFrame:
    """The seven working columns, departure parsed, station id, date, hour."""
    out = df.select(*[(_as_timestamp(df, c) if c == "current_stop_departure" else F.col(c)).alias(c)
                      for c in PREPARED_COLUMNS])
    if include_base_stop_id:
        out = out.withColumn("base_stop_id", C.base_stop_id("gtfs_stop_id"))
    return out.withColumns({"date": F.to_date("current_stop_departure"),
                            "hour": F.hour("current_stop_departure")})


def coerce_times(df: DataFrame, columns: Iterable[str] = ("current_stop_departure",
                                                           "current_stop_arrival",
                                                           "created_at", "updated_at")) -> DataFrame:
    """P5: the four time columns as timestamps (text parsed, bad -> NULL)."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: _as_timestamp(df, c) for c in present})


def with_stop_keys(df: DataFrame) -> DataFrame:
    """Keep every column, add station id, date and hour of the departure."""
    return coerce_times(df).withColumns({
        "base_stop_id": C.base_stop_id("gtfs_stop_id"),
        "date": F.to_date("current_stop_departure"),
        "hour": F.hour("current_stop_departure"),
    })


def with_time_features(df: DataFrame) -> DataFrame:
    """Weekday (Monday 0) and weekend flag; rows without departure dropped."""
    return (df.where(F.col("current_stop_departure").isNotNull())
            .withColumns({"hour": F.hour("current_stop_departure"),
                          "weekday": C.weekday("current_stop_departure")})
            .withColumn("is_weekend", C.is_weekend("weekday")))


def stop_times_with_stops(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Inner join with the stop dimension on the station id.

    The stop dimension is small (hundreds to thousands of rows); the planner
    broadcasts it from its estimated size and falls back to a sort-merge join
    beyond the broadcast threshold.
    """
    st = stop_times if "base_stop_id" in stop_times.columns else with_stop_keys(stop_times)
    return st.join(dimension(stops), "base_stop_id", "inner")


def filter_date_hours(df: DataFrame, date=None, hour_range=(0, 24),
                      fill_zero: bool = True) -> DataFrame:
    """One date (or all when ``date`` is None), hours inclusive at both
    ends, NULLs replaced by 0 as the statistics view does."""
    out = df
    if date is not None:
        out = out.where(F.col("date") == F.lit(date).cast("date"))
    lo, hi = hour_range
    out = out.where(F.hour("current_stop_departure").between(lo, hi))
    return out.fillna(0) if fill_zero else out


def filtered_stop_times(stop_times: DataFrame, stops: DataFrame, date=None,
                        hour_range=(0, 24), stop_ids: Iterable[str] | None = None) -> DataFrame:
    """Prepared stop times joined with stops, date + hour range filter,
    optional platform id list."""
    st = stop_times if "base_stop_id" in stop_times.columns else prepare_stop_times(stop_times)
    cond = F.col("hour").between(*hour_range)
    if date is not None:
        cond = cond & (F.col("date") == F.lit(date).cast("date"))
    st = st.where(cond)
    if stop_ids is not None:  # a literal list: an IN filter the scan can use
        st = st.where(F.col("gtfs_stop_id").isin(list(stop_ids)))
    dim = stops.select("base_stop_id", "stop_name", "avg_latitude", "avg_longitude")
    return st.join(dimension(dim), "base_stop_id", "inner")


def last_week_history(df: DataFrame, at, key_col: str = "base_stop_id", key=None,
                      direction: int | None = None, value_col: str = "current_stop_dep_delay"
                      ) -> DataFrame:
    """Rows of one stop (or segment) and direction in [at - 7 days, at)."""
    t = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else F.lit(at)
    cond = ((F.col("current_stop_departure") >= t - F.expr("INTERVAL 7 DAYS"))
            & (F.col("current_stop_departure") < t))
    if key is not None:
        cond = cond & (F.col(key_col) == key)
    if direction is not None:
        cond = cond & (F.col("gtfs_direction_id") == direction)
    return (df.where(cond)
            .select(key_col, "gtfs_direction_id", "current_stop_departure", value_col))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of one column (stops, directions, segments)."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
