"""Single-target conveniences with the call shapes of the original tool.

Each builds a one-row (or few-row) literal target / filter and runs the
set-based operator, so one prediction costs the same plan as a grid.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.operators import events as EV
from delaylens.operators import predict as PR
from delaylens.operators import stats as S
from delaylens.operators import trips as T


def _ts(t) -> dt.datetime:
    return dt.datetime.fromisoformat(t) if isinstance(t, str) else t


def compute_prediction(history: DataFrame, target_datetime, stop_id: str | None = None,
                       direction: int | None = None, calendar: DataFrame | None = None,
                       recent_mode: str = "bounded") -> DataFrame:
    """One prediction (0 or 1 row) for a time and optional station/direction."""
    keys, row, schema = [], [], []
    if stop_id:
        keys.append("base_stop_id"); row.append(stop_id); schema.append("base_stop_id string")
    if direction is not None:
        keys.append("gtfs_direction_id"); row.append(int(direction)); schema.append("gtfs_direction_id int")
    targets = history.sparkSession.createDataFrame(
        [tuple(row) + (_ts(target_datetime),)], ", ".join(schema + ["target_ts timestamp_ntz"]))
    return PR.predict(history, targets, keys, calendar=calendar, recent_mode=recent_mode)


def compute_segment_prediction(segment_rows: DataFrame, target_datetime, segment_id: str,
                               direction: int | None = None, calendar: DataFrame | None = None,
                               recent_mode: str = "bounded") -> DataFrame:
    """One travel-time prediction for a segment (``trips.segment_rows`` input)."""
    keys = ["segment_id_short"] + (["gtfs_direction_id"] if direction is not None else [])
    row = (segment_id,) + ((int(direction),) if direction is not None else ())
    schema = "segment_id_short string" + (", gtfs_direction_id int" if direction is not None else "")
    targets = segment_rows.sparkSession.createDataFrame([row + (_ts(target_datetime),)],
                                                        schema + ", target_ts timestamp_ntz")
    return PR.predict_segments(segment_rows, targets, keys, calendar=calendar, recent_mode=recent_mode,
                               materialize=False)


def get_next_stop(merged: DataFrame, stops: DataFrame, base_stop_id: str, direction: int) -> DataFrame:
    """Next stop (name) of one station and direction."""
    return (T.next_stop(merged, stops)  # the lead runs over whole trips, rows of both directions
            .where((F.col("gtfs_direction_id") == direction) & (F.col("base_stop_id") == base_stop_id)))


def get_comparison_data(data: DataFrame, calendar: DataFrame, match_date) -> DataFrame:
    """Rows of the five comparison days of one match, tagged by label."""
    return EV.comparison_days(data, calendar.where(F.col("match_date") == F.lit(match_date).cast("date")))


def get_delay_statistics(prepared: DataFrame, date) -> DataFrame:
    """Daily statistics of one date (the filter is pushed below the aggregate)."""
    return S.daily_stats(prepared).where(F.col("date") == F.lit(date).cast("date"))
