"""Set-based delay and travel-time prediction.

A prediction for target time t (optionally per stop / segment and
direction) uses

* the history cell of t's hour and weekday: n (all rows), mean, sample std,
  exact median; fewer than 5 rows -> no prediction;
* a 95 % t-interval: margin = t(0.975, n-1) * std / sqrt(n);
* a recent-error correction: mean of the rows of the same keys in the hour
  before t minus the cell mean, when there are at least 3 such rows;
* a reliability score from sample size, interval width, peak hour and
  match day.

Targets are rows of a DataFrame, so a whole grid (or every stop and
direction) is answered at once instead of with two scans of the history per
target. Cells, observed target slots and recent sums can all be read from the
history counted by (keys, minute, value), ``minute_counts``: one scan and one
map-side-combined aggregation, written once, whose size is bounded by the keys,
the minutes covered and the range of values. That is exact for targets on whole
minutes; for others pass the raw rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens import constants as K
from delaylens.functions import columns as C
from delaylens.functions.joins import dimension
from delaylens.session import materialise
from delaylens.functions.tdist import t975
from delaylens.operators.medians import VALUE, WEIGHT, brackets, exact_medians
from delaylens.operators.windows import KNOWN, LEAST, MOST, ROWS, SQUARES, SUM, recent_window_sums

TARGET = "target_ts"


def minute_counts(history: DataFrame, keys: Sequence[str] = (), value_col: str = "current_stop_dep_delay",
                  ts_col: str = "current_stop_departure") -> DataFrame:
    """History as (keys, minute, value) with the number of rows, in the checkpoint folder.

    Rows without a departure go; null values stay counted. Usable wherever
    this module takes a history, for targets on whole minutes.
    """
    minute = F.date_trunc("minute", ts_col).cast("timestamp_ntz")
    return materialise(history.where(F.col(ts_col).isNotNull())
                       .groupBy(*keys, minute.alias(ts_col), value_col)
                       .agg(F.count(F.lit(1)).alias(ROWS)), "minute-counts")


def _reduced(history: DataFrame, keys: Sequence[str], value_col: str, start) -> DataFrame:
    """``minute_counts`` of raw rows if the grid starts on a whole minute, else the history as it is."""
    s = _ts(start)
    if ROWS in history.columns or s.second or s.microsecond:
        return history
    return minute_counts(history, keys, value_col)


def cell_stats(history: DataFrame, keys: Sequence[str] = (), value_col: str = "current_stop_dep_delay",
               ts_col: str = "current_stop_departure", min_sample: int = K.MIN_SAMPLE,
               approx_median: bool = False, median: str = "exact", values: DataFrame | None = None) -> DataFrame:
    """M1: per (hour, weekday, *keys): n (all rows), mean, std, median; n >= min_sample.

    ``median`` is ``exact`` (a value->count map per cell, for values of few
    kinds such as whole seconds), ``bounded`` (exact too, by distributed
    selection with bounded state, for whole-number values of many kinds such as
    microseconds), ``approx`` (``percentile_approx``, raw rows only; the same
    as ``approx_median``) or ``none`` (the column is NULL). A history of moments
    takes its medians from ``values``: keys, hour, weekday, ``_value``, ``_weight``.
    """
    median = "approx" if approx_median else median
    if median not in ("exact", "bounded", "approx", "none"):
        raise ValueError(f"unknown median {median!r}")
    v = F.col(value_col)
    groups = ["hour", "weekday", *keys]
    dated = history.where(F.col(ts_col).isNotNull())
    g = dated.groupBy(F.hour(ts_col).alias("hour"), C.weekday(ts_col).alias("weekday"), *keys)
    enough = F.col("sample_size") >= min_sample
    moments = SUM in history.columns
    if ROWS in history.columns and not moments:
        if median == "approx":
            raise ValueError("approx_median needs raw rows, not minute_counts")
        return _counted_stats(g, v).where(enough)
    if not moments and median in ("exact", "approx"):
        med = F.percentile_approx(v, 0.5, 10000) if median == "approx" else F.median(v)
        return g.agg(F.count(F.lit(1)).alias("sample_size"), F.avg(v).alias("base_mean"),
                     F.stddev_samp(v).alias("std"), med.cast("double").alias("median")).where(enough)
    if moments:
        cells = _moment_stats(g)
    else:
        cells = g.agg(F.count(F.lit(1)).alias("sample_size"), F.avg(v).alias("base_mean"), F.stddev_samp(v).alias("std"),
                      F.count(v).alias(KNOWN), F.min(v).alias(LEAST), F.max(v).alias(MOST))
        values = dated.select(*keys, F.hour(ts_col).alias("hour"), C.weekday(ts_col).alias("weekday"),
                              v.alias(VALUE), F.lit(1).alias(WEIGHT))
    cells = cells.where(enough)
    kept = [*groups, "sample_size", "base_mean", "std"]
    if median == "none" or values is None:
        return cells.select(*kept, F.lit(None).cast("double").alias("median"))
    cells = materialise(cells, "cells")
    found = exact_medians(values, brackets(cells, groups, KNOWN, LEAST, MOST, "base_mean", "std"), groups)
    return cells.join(found, groups, "left").select(*kept, "median")


def _moment_stats(grouped) -> DataFrame:
    """Cells of a history of moments; squares about a whole number near the mean are exact."""
    sums = grouped.agg(F.sum(ROWS).alias("sample_size"), F.sum(KNOWN).alias(KNOWN), F.sum(SUM).alias(SUM),
                       F.sum(SQUARES).alias(SQUARES), F.min(LEAST).alias(LEAST), F.max(MOST).alias(MOST))
    k, total = F.col(KNOWN), F.col(SUM)
    mean = F.try_divide(total.cast("double"), k)
    near = F.round(mean).cast("decimal(19,0)")

    def whole(c):
        return c.cast("decimal(38,0)")

    about = whole(F.col(SQUARES) - whole(near * total) * 2 + whole(whole(near * near) * k.cast("decimal(18,0)")))
    rest = (total - whole(near * k.cast("decimal(18,0)"))).cast("double")
    var = F.when(k > 1, (about.cast("double") - rest * rest / k) / (k - 1))
    return sums.withColumns({"base_mean": mean, "std": F.sqrt(F.greatest(var, F.lit(0.0)))}).withColumn(
        "std", F.when(k > 1, F.col("std")))


def _counted_stats(grouped, v) -> DataFrame:
    """The same four statistics from counted values; sums of whole numbers are exact."""
    n = F.col(ROWS)
    known = F.sum(F.when(v.isNotNull(), n))
    total, squares = F.sum(v * n), F.sum(v.cast("double") * v * n)
    mean = total / known
    var = F.when(known > 1, F.greatest(squares - total * mean, F.lit(0.0)) / (known - 1))
    return grouped.agg(F.sum(n).alias("sample_size"), mean.alias("base_mean"), F.sqrt(var).alias("std"),
                       F.percentile(v, 0.5, n).cast("double").alias("median"))


def confidence_interval(cells: DataFrame) -> DataFrame:
    """M2: t quantile, margin and the interval around the cell mean."""
    t = t975(F.col("sample_size") - 1)
    return cells.withColumns({"t_value": t}).withColumns({
        "margin_error": F.col("t_value") * F.col("std") / F.sqrt(F.col("sample_size").cast("double")),
    }).withColumns({
        "confidence_lower": F.col("base_mean") - F.col("margin_error"),
        "confidence_upper": F.col("base_mean") + F.col("margin_error"),
    })


def match_dates(calendar: DataFrame | None) -> DataFrame | None:
    if calendar is None:
        return None
    return calendar.select(F.col("match_date").alias("_mdate")).distinct().withColumn("_hit", F.lit(True))


def predict(history: DataFrame, targets: DataFrame, keys: Sequence[str] = (),
            value_col: str = "current_stop_dep_delay", ts_col: str = "current_stop_departure",
            calendar: DataFrame | None = None, recent_mode: str = "bounded",
            label: str = "delay", approx_median: bool = False, unit_divisor: float | None = None,
            median: str = "exact", values: DataFrame | None = None) -> DataFrame:
    """M5 (and M8 with travel times): one row per predictable target.

    ``targets`` has ``target_ts`` plus the ``keys`` columns. ``recent_mode``
    ``bounded`` uses [t-60min, t); ``open`` keeps the original filter
    (departure >= t-60min, no upper bound), which lets past targets see later
    rows. ``history`` holds raw rows, their ``minute_counts`` or moments;
    ``median`` and ``values`` as in ``cell_stats``.
    """
    keys = list(keys)
    used = [c for c in (value_col, ROWS, KNOWN, SUM, SQUARES, LEAST, MOST) if c in history.columns]
    hist = history.select(*keys, ts_col, *used).where(F.col(ts_col).isNotNull())
    cells = cell_stats(hist, keys, value_col, ts_col, approx_median=approx_median, median=median, values=values)
    if unit_divisor is not None:
        cells = cells.withColumns({c: F.col(c) / F.lit(float(unit_divisor))
                                   for c in ("base_mean", "std", "median")})
    cells = confidence_interval(cells)
    tg = targets.select(*keys, TARGET).distinct()
    tg = tg.withColumns({"hour": F.hour(TARGET), "weekday": C.weekday(TARGET)})
    base = tg.join(cells, ["hour", "weekday", *keys], "inner")
    recent = recent_window_sums(hist, tg.select(*keys, TARGET), keys, value_col, ts_col=ts_col,
                                target_col=TARGET, minutes=K.RECENT_WINDOW_MINUTES, mode=recent_mode)
    out = base.join(recent, [*keys, TARGET], "inner")
    md = match_dates(calendar)
    if md is not None:
        out = (out.join(dimension(md), F.to_date(TARGET) == F.col("_mdate"), "left")
               .withColumn("is_match_day", F.coalesce(F.col("_hit"), F.lit(False)))
               .drop("_mdate", "_hit"))
    else:
        out = out.withColumn("is_match_day", F.lit(False))
    recent_sum = F.col("recent_sum")
    if unit_divisor is not None:
        recent_sum = recent_sum / F.lit(float(unit_divisor))
    recent_mean = F.try_divide(recent_sum, F.col("recent_cnt"))
    corr = F.when(F.col("recent_n") >= K.MIN_RECENT, recent_mean - F.col("base_mean")) \
        .otherwise(F.lit(0.0))
    # two projections instead of a chain of withColumn calls: the derived
    # columns first, then the score that reads them
    out = out.select("*", corr.alias("error_correction"),
                     (F.col("base_mean") + corr).alias("adjusted"),
                     C.is_peak_hour("hour").alias("is_peak_hour"),
                     C.is_weekend("weekday").alias("is_weekend"))
    out = out.select("*", C.reliability("adjusted", "margin_error", "sample_size",
                                        "is_peak_hour", "is_match_day").alias("reliability"))
    return out.select(
        *keys,
        F.col(TARGET).alias("datetime"),
        F.col("adjusted").alias(f"mean_{label}"),
        F.col("base_mean").alias(f"base_mean_{label}"),
        "error_correction",
        F.col("median").alias(f"median_{label}"),
        F.col("std").alias(f"std_{label}"),
        (F.col("adjusted") - F.col("margin_error")).alias("confidence_lower"),
        (F.col("adjusted") + F.col("margin_error")).alias("confidence_upper"),
        "margin_error", "sample_size", "reliability", "is_match_day", "is_weekend", "is_peak_hour",
        "recent_n",
    )


# ------------------------------------------------------------------ grids
def _ts(value) -> dt.datetime:
    return dt.datetime.fromisoformat(value) if isinstance(value, str) else value


def grid_times(start, hours: float, step_minutes: int = 15, floor_to_hour: bool = False):
    """Target times: from ``start`` (optionally floored to the hour) every
    ``step`` minutes while before ``start + hours`` (end exclusive)."""
    s = _ts(start)
    first = s.replace(minute=0, second=0, microsecond=0) if floor_to_hour else s
    end = s + dt.timedelta(hours=hours)
    return first, end


def with_grid(keys_df: DataFrame, start, hours: float, step_minutes: int = 15,
              floor_to_hour: bool = False) -> DataFrame:
    """Attach the grid to every key row by generating it (no join)."""
    first, end = grid_times(start, hours, step_minutes, floor_to_hour)
    seq = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"),
                     F.expr(f"INTERVAL {int(step_minutes)} MINUTES"))
    out = keys_df.withColumn(TARGET, F.explode(seq))
    return out.where(F.col(TARGET) < F.lit(end).cast("timestamp_ntz"))


def _key_rows(history: DataFrame, keys_df: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Distinct key rows to expand into a grid; one empty row without keys."""
    if keys:
        return keys_df.select(*keys).distinct()
    return history.sparkSession.range(1).select()


def hour_slot_targets(history: DataFrame, keys: Sequence[str] = (), offset_minutes: int = 30,
                      ts_col: str = "current_stop_departure") -> DataFrame:
    """Targets derived from the data: every observed (keys, hour) at
    ``offset`` minutes past the hour."""
    slot = F.date_trunc("hour", F.col(ts_col)).cast("timestamp_ntz")
    return (history.where(F.col(ts_col).isNotNull())
            .select(*keys, (slot + F.expr(f"INTERVAL {int(offset_minutes)} MINUTES")).alias(TARGET))
            .distinct())


def narrow_history(rows: DataFrame, keys: Sequence[str], value_col: str,
                   ts_col: str = "current_stop_departure") -> DataFrame:
    """Materialise the (keys, time, value) projection of a derived history
    once in the shared checkpoint folder. Segment rows come out of trip
    windows (and, in ``trip`` mode, a fan-out join); the prediction reads its
    history in several branches, which would otherwise recompute them."""
    return materialise(rows.select(*keys, ts_col, value_col), "history")


def predict_segments(rows: DataFrame, targets: DataFrame, keys: Sequence[str] = ("segment_id_short",),
                     calendar: DataFrame | None = None, recent_mode: str = "bounded",
                     materialize: bool = True, approx_median: bool = False) -> DataFrame:
    """M8: travel-time prediction per segment (and optional direction) from
    ``trips.segment_rows`` output, in seconds. Medians are exact with bounded
    state (``medians.exact_medians``) unless ``approx_median``."""
    hist = narrow_history(rows, keys, "real_travel_time_us") if materialize else rows
    return predict(hist, targets, keys, value_col="real_travel_time_us", calendar=calendar,
                   recent_mode=recent_mode, label="travel_time", unit_divisor=1e6,
                   median="approx" if approx_median else "bounded")


def predict_trip_mode(trips: DataFrame, targets: DataFrame | None = None, keys: Sequence[str] = ("segment_id_short",),
                      calendar: DataFrame | None = None, recent_mode: str = "open", step_minutes: int = 30,
                      with_median: bool = True) -> DataFrame:
    """M8 in ``trip`` mode (the original trip-level merge) as a product of sparse tables.

    ``trips`` comes from ``trips.stored_trips`` and has the keys besides the
    segment. Counts, means, deviations and recent errors come from moments per
    slot, exact for targets on whole slots of ``step_minutes`` (a divisor of
    60; other targets are an error); medians from weighted per-trip values
    (``with_median=False``: NULL). Without ``targets`` every observed (keys,
    hour) is predicted at 30 minutes past the hour.
    """
    from delaylens.operators.trips import trip_mode_moments, trip_mode_values
    if 60 % step_minutes:
        raise ValueError("slots must divide the hour")
    row_keys = [k for k in keys if k != "segment_id_short"]
    history = trip_mode_moments(trips, row_keys, step_minutes)
    if targets is None:
        targets = hour_slot_targets(history, keys)
    elif not targets.where(C.epoch_us(TARGET) % (step_minutes * 60_000_000) != 0).isEmpty():
        raise ValueError(f"targets must lie on whole slots of {step_minutes} minutes")
    return predict(history, targets, keys, value_col="real_travel_time_us", calendar=calendar, recent_mode=recent_mode,
                   label="travel_time", unit_divisor=1e6, median="bounded" if with_median else "none",
                   values=trip_mode_values(trips, row_keys))


def predict_segments_trip_mode(stop_times: DataFrame, targets: DataFrame | None = None,
                               keys: Sequence[str] = ("segment_id_short",), calendar: DataFrame | None = None,
                               recent_mode: str = "open", step_minutes: int = 30) -> DataFrame:
    """Convenience: from raw stop times."""
    from delaylens.operators.trips import stored_trips
    return predict_trip_mode(stored_trips(stop_times, [k for k in keys if k != "segment_id_short"]), targets, keys,
                             calendar=calendar, recent_mode=recent_mode, step_minutes=step_minutes)


def predict_weekly(history: DataFrame, keys_df: DataFrame, start, keys: Sequence[str] = (),
                   interval_minutes: int = 15, min_reliability: float = 0.0,
                   calendar: DataFrame | None = None, recent_mode: str = "bounded",
                   value_col: str = "current_stop_dep_delay", label: str = "delay",
                   unit_divisor: float | None = None, reduce: bool = True, median: str = "exact") -> DataFrame:
    """M6: a week of targets from ``start`` floored to the hour, with day name
    and time period, keeping predictions at or above ``min_reliability``.

    ``keys_df`` names the keys, best a dimension such as the stops: keys
    without history give no rows. The raw history is read once, into
    ``minute_counts`` (``reduce=False``: used as it is)."""
    if reduce:
        history = _reduced(history, keys, value_col, grid_times(start, 0, floor_to_hour=True)[0])
    tg = with_grid(_key_rows(history, keys_df, keys), start, 24 * 7, interval_minutes,
                   floor_to_hour=True)
    p = predict(history, tg, keys, value_col=value_col, calendar=calendar,
                recent_mode=recent_mode, label=label, unit_divisor=unit_divisor, median=median)
    return (p.where(F.col("reliability") >= min_reliability)
            .withColumns({"day_name": C.day_name("datetime"),
                          "time_period": C.time_period(F.hour("datetime"))}))


def predict_short_term(history: DataFrame, keys_df: DataFrame, start, keys: Sequence[str] = (),
                       interval_minutes: int = 15, duration_hours: int = 3,
                       calendar: DataFrame | None = None, recent_mode: str = "bounded",
                       value_col: str = "current_stop_dep_delay", label: str = "delay",
                       unit_divisor: float | None = None, reduce: bool = True) -> DataFrame:
    """M7/M9: targets every ``interval`` minutes for ``duration`` hours from
    ``start`` (not floored): time, mean and interval bounds; keys and history
    as in ``predict_weekly``."""
    if reduce:
        history = _reduced(history, keys, value_col, start)
    tg = with_grid(_key_rows(history, keys_df, keys), start, duration_hours, interval_minutes)
    # the result has no median; counted histories keep theirs, which is pruned away
    p = predict(history, tg, keys, value_col=value_col, calendar=calendar,
                recent_mode=recent_mode, label=label, unit_divisor=unit_divisor, median="none")
    return p.select(*keys, "datetime", f"mean_{label}", "confidence_lower", "confidence_upper")
