"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from delaylens import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_stop_id(stop_id="gtfs_stop_id") -> Column:
    """Station id: the part of a platform id before its first 'S' or 'Z'.

    Ids without either letter have no station id (NULL), ids starting with
    one of them give the empty string, as the original regex extraction does.
    """
    c = col(stop_id)
    return F.when(c.rlike("[SZ]"), F.regexp_extract(c, r"^([^SZ]*)", 1))


def short_stop_id(stop_id) -> Column:
    """Id part before the first 'Z' (metro ids such as U163S1 stay whole)."""
    return F.split_part(col(stop_id), F.lit("Z"), F.lit(1))


def epoch_us(ts) -> Column:
    """Microseconds since epoch for TIMESTAMP or TIMESTAMP_NTZ (UTC session)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def add_seconds(ts, seconds) -> Column:
    """ts + seconds; NULL seconds give NULL. Fractional seconds are rounded
    half to even first (2.5 gives 2), as the original's integer cast does."""
    return F.timestamp_add("SECOND", F.bround(col(seconds)).cast("bigint"), col(ts))


def seconds_between(end, start) -> Column:
    """(end - start) in seconds, fraction kept (microsecond precision)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1_000_000.0)


def weekday(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts))


def is_weekend(weekday_col) -> Column:
    return col(weekday_col).isin(*K.WEEKEND_DAYS)


def is_peak_hour(hour_col) -> Column:
    return col(hour_col).isin(*K.PEAK_HOURS)


def time_period(hour_col) -> Column:
    h = col(hour_col)
    return (F.when(h.between(*K.MORNING_PEAK), F.lit(K.PERIOD_LABELS[0]))
            .when(h.between(*K.EVENING_PEAK), F.lit(K.PERIOD_LABELS[1]))
            .otherwise(F.lit(K.PERIOD_LABELS[2])))


def day_name(ts) -> Column:
    return F.date_format(col(ts), "EEEE")


def delay_color(delay) -> Column:
    """Traffic-light colour of a delay in seconds; NULL falls to the last colour."""
    d = col(delay)
    expr = None
    for upper, colour in K.DELAY_COLORS:
        expr = (F.when(d <= upper, F.lit(colour)) if expr is None
                else expr.when(d <= upper, F.lit(colour)))
    return expr.otherwise(F.lit(K.DELAY_COLOR_ABOVE))


def to_minutes(seconds) -> Column:
    return col(seconds) / F.lit(60.0)


def pct_increase(event_mean, regular_mean) -> Column:
    """(event/regular - 1) * 100 when the regular mean is positive, else 0."""
    r = col(regular_mean)
    return F.when(r > 0, (col(event_mean) / r - 1.0) * 100.0).otherwise(F.lit(0.0))


def parse_match_datetime(date_text, time_text) -> Column:
    """'dd.MM.yyyy' + 'HH:mm' -> TIMESTAMP_NTZ; NULL when either part is bad."""
    ts = F.try_to_timestamp(F.concat_ws(" ", col(date_text), col(time_text)),
                            F.lit("dd.MM.yyyy HH:mm"))
    return ts.cast("timestamp_ntz")


def reliability(mean: str, margin: str, n: str, is_peak: str, is_match_day: str) -> Column:
    """0..100 score, one decimal, half-to-even rounding (column names in).

    Built as one SQL expression: sample-size, interval-width and condition
    scores weighted as fixed in ``constants``."""
    w_n, w_ci, w_cond = K.RELIABILITY_WEIGHTS
    sat = float(K.RELIABILITY_SAMPLE_SATURATION)
    sql = (f"bround(({w_n}D * least(1.0D, `{n}` / {sat}D)"
           f" + {w_ci}D * (1.0D - least(1.0D, (2.0D * `{margin}`) / (abs(`{mean}`) + 1.0D)))"
           f" + {w_cond}D * (CASE WHEN `{is_peak}` THEN {K.PEAK_FACTOR}D ELSE 1.0D END)"
           f" * (CASE WHEN coalesce(`{is_match_day}`, false) THEN {K.MATCH_DAY_FACTOR}D ELSE 1.0D END))"
           f" * 100.0D, 1)")
    return F.expr(sql)
