"""Match-day impact.

Every analysis runs for all matches at once. Statistics aggregate the history
to cells first, (date, hour) sums and counts or (date, hour, delay) counts where
a median is asked for, with map-side combining, and only those cells meet the
match calendar, so no join moves the raw history. Operators that return tagged
history rows (``event_flag``, ``comparison_days``) broadcast the calendar after
a bounded count proves its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylens import constants as K
from delaylens.functions import columns as C
from delaylens.functions.joins import dimension
from delaylens.functions.tdist import two_sided_p

DELAY = "current_stop_dep_delay"
MATCH_KEY = "kickoff"


# ----------------------------------------------------------------- calendar
def match_calendar(raw: DataFrame, keep_invalid: bool = False, event_tz: str | None = None) -> DataFrame:
    """Kickoff from 'dd.MM.yyyy' + 'HH:mm' (bad or missing -> NULL and
    dropped), home flag from Location 'D' unless present, opponent default.

    Kickoff times are local wall-clock text while stop times are UTC. By
    default they are compared as they are (the original behaviour); with
    ``event_tz`` (e.g. 'Europe/Prague') kickoffs are converted to UTC first.
    """
    kickoff = C.parse_match_datetime("Date", "Time")
    if event_tz:
        kickoff = F.to_utc_timestamp(kickoff.cast("timestamp"), event_tz).cast("timestamp_ntz")
    df = raw.withColumn(MATCH_KEY, kickoff)
    if "is_home" not in df.columns:
        df = df.withColumn("is_home", F.lower(F.trim("Location")) == "d")
    elif dict(df.dtypes)["is_home"] == "string":
        df = df.withColumn("is_home", F.expr("try_cast(nullif(trim(is_home), '') AS BOOLEAN)"))
    df = df.withColumn("Opponent", F.coalesce(F.col("Opponent"), F.lit(K.DEFAULT_OPPONENT)))
    df = df.withColumns({"match_date": F.to_date(MATCH_KEY), "kickoff_hour": F.hour(MATCH_KEY)})
    return df if keep_invalid else df.where(F.col(MATCH_KEY).isNotNull())


def side_from_teams(df: DataFrame, home_col: str = "Home Team", away_col: str = "Away Team",
                    team: str = K.HOME_TEAM) -> DataFrame:
    """is_home / Opponent / Location from the two team names."""
    h, a = F.col(f"`{home_col}`"), F.col(f"`{away_col}`")
    return df.withColumns({
        "is_home": F.when(h == team, F.lit(True)).when(a == team, F.lit(False)),
        "Opponent": F.when(h == team, a).when(a == team, h).otherwise(F.lit("Unknown")),
        "Location": F.when(h == team, F.lit("D")).when(a == team, F.lit("V"))
                     .otherwise(F.lit("Neutral")),
    })


def past_matches(calendar: DataFrame, as_of) -> DataFrame:
    """Matches on or before ``as_of`` with their selection label."""
    side = F.when(F.col("is_home"), F.lit("Home")).otherwise(F.lit("Away"))
    label = F.concat(F.date_format(MATCH_KEY, "dd.MM.yyyy"), F.lit(" - "), F.col("Opponent"),
                     F.lit(" ("), side, F.lit(")"))
    return (calendar.where(F.col("match_date") <= F.lit(as_of).cast("date"))
            .withColumn("label", label).orderBy(MATCH_KEY))


def match_value_counts(calendar: DataFrame, column: str) -> DataFrame:
    """Number of matches per value of one column (competition, side)."""
    return calendar.groupBy(column).agg(F.count(F.lit(1)).alias("matches"))


# ------------------------------------------------------------- event flag
def event_flag(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """``is_event`` = the departure date is a match date."""
    dates = (calendar.select(F.col("match_date").alias("_mdate")).distinct()
             .withColumn("_hit", F.lit(True)))
    joined = data.join(dimension(dates), F.to_date("current_stop_departure") == F.col("_mdate"),
                       "left")
    return joined.withColumn("is_event", F.coalesce(F.col("_hit"), F.lit(False))).drop("_mdate", "_hit")


def hour_cells(data: DataFrame) -> DataFrame:
    """Per (date, hour): sum and count of known delays and the row count."""
    return (data.groupBy(F.to_date("current_stop_departure").alias("day"), F.hour("current_stop_departure").alias("hour"))
            .agg(F.sum(DELAY).alias("s"), F.count(DELAY).alias("c"), F.count(F.lit(1)).alias("n")))


def delay_cells(data: DataFrame, by_hour: bool) -> DataFrame:
    """Per (date[, hour], delay): the row count. Delays are whole seconds, so the cells are
    bounded by the days and the range of delays, not by the rows."""
    keys = [F.to_date("current_stop_departure").alias("day")]
    keys += [F.hour("current_stop_departure").alias("hour")] if by_hour else []
    return data.groupBy(*keys, DELAY).agg(F.count(F.lit(1)).alias("n"))


def flagged_cells(cells: DataFrame, calendar: DataFrame) -> DataFrame:
    """Cells with ``is_event``: their day is a match date."""
    dates = calendar.select(F.col("match_date").alias("day")).distinct().withColumn("_hit", F.lit(True))
    return (cells.join(dimension(dates), "day", "left")
            .withColumn("is_event", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def moments():
    """mean, median_delay, var (sample) and known, from counted delays; exact sums for whole delays."""
    n = F.when(F.col(DELAY).isNotNull(), F.col("n")).otherwise(0)
    known, total = F.sum(n), F.sum(F.col(DELAY) * n)
    mean = F.try_divide(total, known)
    squares = F.sum(F.col(DELAY).cast("double") * F.col(DELAY) * n)
    var = F.when(known > 1, F.greatest(squares - total * mean, F.lit(0.0)) / (known - 1))
    median = F.percentile(F.when(F.col(DELAY).isNotNull(), F.col(DELAY)), 0.5, F.greatest(n, F.lit(1)))
    return (mean.alias("mean"), median.cast("double").alias("median_delay"), var.alias("var"), known.alias("known"))


def event_stats(data: DataFrame, calendar: DataFrame, with_p_value: bool = False) -> DataFrame:
    """Per is_event the delay mean, median, max, min, std and count of
    known delays; each row also carries Welch's t (event minus regular), its
    Welch-Satterthwaite dof, Cohen's d with the unweighted mean of the two
    variances and, optionally, the two-sided p-value.

    NULL delays are dropped before the test (the original propagated NaN).
    """
    cells = flagged_cells(delay_cells(data, by_hour=False), calendar)
    g = cells.groupBy("is_event").agg(*moments(), F.max(DELAY).alias("max_delay"), F.min(DELAY).alias("min_delay"))
    g = (g.withColumns({"avg_delay": F.col("mean"), "std_delay": F.sqrt("var"), "_var": F.col("var")})
         .select("is_event", "avg_delay", "median_delay", "max_delay", "min_delay", "std_delay",
                 F.col("known").alias("total_records"), "_var"))
    both = Window.partitionBy(F.lit(0))  # the two aggregated rows only

    def pick(c, flag):
        return F.max(F.when(F.col("is_event") == flag, F.col(c))).over(both)

    m1, m2 = pick("avg_delay", True), pick("avg_delay", False)
    v1, v2 = pick("_var", True), pick("_var", False)
    n1, n2 = pick("total_records", True), pick("total_records", False)
    se2 = F.try_divide(v1, n1) + F.try_divide(v2, n2)
    ok_t = (n1 > 1) & (n2 > 1)
    # constant delays have no variance: t, dof and effect size are then undefined (NULL)
    t = F.when(ok_t, F.try_divide(m1 - m2, F.sqrt(se2)))
    dof = F.when(ok_t, F.try_divide(se2 * se2, (v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)))
    d = F.when((n1 > 0) & (n2 > 0), F.try_divide(m1 - m2, F.sqrt((v1 + v2) / 2.0)))
    out = g.withColumns({"t_statistic": t, "welch_dof": dof, "effect_size": d}).drop("_var")
    if with_p_value:
        out = out.withColumn("p_value", two_sided_p(F.col("t_statistic"), F.col("welch_dof")))
    return out


def event_hourly_stats(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per (is_event, hour): mean, median, std and count of known delays."""
    cells = flagged_cells(delay_cells(data, by_hour=True), calendar)
    g = (cells.groupBy("is_event", "hour").agg(*moments())
         .select("is_event", "hour", F.col("mean").alias("mean_delay"), "median_delay",
                 F.sqrt("var").alias("std_delay"), F.col("known").alias("count")))
    return g.withColumn("day_type", F.when(F.col("is_event"), F.lit(K.DAY_TYPE_EVENT[0]))
                        .otherwise(F.lit(K.DAY_TYPE_EVENT[1])))


def overall_impact(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row - mean delay on match vs other days, % increase and
    difference, number of matches and home matches, and the worst match-day
    hour (lowest hour among equal means) with its mean.

    Hour cells are pre-aggregated, the calendar counted, and both are
    combined by one global aggregation over their union (no join).
    """
    cells = (flagged_cells(hour_cells(data), calendar).groupBy("is_event", "hour")
             .agg(F.sum("s").alias("s"), F.sum("c").alias("c")))
    cal = calendar.select(F.lit(True).alias("is_match"), F.col("is_home"))
    u = cells.withColumn("is_match", F.lit(False)).unionByName(cal, allowMissingColumns=True)
    ev, reg = F.col("is_event") == True, F.col("is_event") == False  # noqa: E712
    cell_mean = F.when(ev & (F.col("c") > 0), F.col("s") / F.col("c"))
    agg = u.agg(
        (F.sum(F.when(ev, F.col("s"))) / F.sum(F.when(ev, F.col("c")))).alias("match_avg_delay"),
        (F.sum(F.when(reg, F.col("s"))) / F.sum(F.when(reg, F.col("c")))).alias("normal_avg_delay"),
        F.count_if(F.col("is_match")).alias("matches_analyzed"),
        F.count_if(F.col("is_match") & F.coalesce(F.col("is_home"), F.lit(False))).alias("home_matches"),
        F.max_by(F.col("hour"), F.when(cell_mean.isNotNull(), F.struct(cell_mean, -F.col("hour"))))
        .alias("worst_hour"),
        F.max(cell_mean).alias("worst_hour_mean_delay"),
    )
    return agg.withColumns({
        "delay_increase_pct": (F.try_divide(F.col("match_avg_delay"), F.col("normal_avg_delay")) - 1.0)
        * 100.0,
        "delay_difference": F.col("match_avg_delay") - F.col("normal_avg_delay"),
    })


# --------------------------------------------------------- per-match views
def comparison_calendar(calendar: DataFrame, labels=None) -> DataFrame:
    """The calendar once per comparison day (``_day``)."""
    offs = [o for o in K.COMPARISON_OFFSETS if labels is None or o[0] in labels]
    off_arr = F.array(*[F.struct(F.lit(lbl).alias("comparison"), F.lit(d).alias("offset"))
                        for lbl, d in offs])
    return (calendar.select(MATCH_KEY, "match_date", "kickoff_hour", "is_home", "Opponent")
            .withColumn("_o", F.explode(off_arr))
            .select("*", F.col("_o.comparison").alias("comparison"),
                    F.date_add("match_date", F.col("_o.offset")).alias("_day"))
            .drop("_o"))


def comparison_days(data: DataFrame, calendar: DataFrame, labels=None) -> DataFrame:
    """Stop-time rows tagged with (match, comparison day) for the match
    day, the days before/after and the weeks before/after - all matches."""
    return (data.join(dimension(comparison_calendar(calendar, labels)),
                      F.to_date("current_stop_departure") == F.col("_day"))
            .drop("_day"))


def match_day_cells(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per (match, comparison day, hour) for match day and week before:
    sum and count of known delays and the row count."""
    days = comparison_calendar(calendar, ("Match Day", "Week Before"))
    return (hour_cells(data).join(dimension(days), F.col("day") == F.col("_day"))
            .groupBy(MATCH_KEY, "kickoff_hour", "is_home", "comparison", "hour")
            .agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("n").alias("n")))


def _is(label):
    return F.col("comparison") == label


def _mean_of(label, extra=None):
    cond = _is(label) if extra is None else (_is(label) & extra)
    return F.try_divide(F.sum(F.when(cond, F.col("s"))), F.sum(F.when(cond, F.col("c"))))


def match_windows(calendar: DataFrame) -> DataFrame:
    """J5 windows: the six hour ranges around each kickoff hour."""
    arr = F.array(*[F.struct(F.lit(i).alias("window_index"), F.lit(n).alias("window"),
                             F.lit(s).alias("s_off"), F.lit(e).alias("e_off"))
                    for i, (n, s, e) in enumerate(K.MATCH_WINDOWS)])
    return (calendar.select(MATCH_KEY, "kickoff_hour", F.explode(arr).alias("w"))
            .select(MATCH_KEY, "w.window_index", "w.window",
                    (F.col("kickoff_hour") + F.col("w.s_off")).alias("start_hour"),
                    (F.col("kickoff_hour") + F.col("w.e_off")).alias("end_hour"))
            .withColumn("is_before", F.when(F.col("window").contains("before"), F.lit("Before"))
                        .otherwise(F.lit("After"))))


def match_hour_windows(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """Hour cells of match day / week before inside each window
    (start <= hour < end, no wrap past midnight)."""
    # both sides come from the calendar: the cells' key gets a name of its own
    cells = match_day_cells(data, calendar).drop("kickoff_hour", "is_home").withColumnRenamed(MATCH_KEY, "_match")
    cond = ((F.col(MATCH_KEY) == F.col("_match")) & (F.col("hour") >= F.col("start_hour"))
            & (F.col("hour") < F.col("end_hour")))
    return match_windows(calendar).join(cells, cond, "left").drop("_match")


def match_window_stats(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per match and window: match-day and week-before mean delay, %
    increase (0 unless the regular mean is positive), match-day row count."""
    j = match_hour_windows(data, calendar)
    g = (j.groupBy(MATCH_KEY, "window_index", "window", "is_before", "start_hour", "end_hour")
         .agg(_mean_of("Match Day").alias("match_avg"),
              _mean_of("Week Before").alias("regular_avg"),
              F.coalesce(F.sum(F.when(_is("Match Day"), F.col("n"))), F.lit(0)).alias("sample_size")))
    return g.withColumn("increase", C.pct_increase("match_avg", "regular_avg"))


def match_impact(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """D15+D16+D17: per match: match-day vs week-before mean, % increase,
    difference and status, mean within kickoff +-2 h, worst hour and mean."""
    cells = match_day_cells(data, calendar)
    r = K.MATCH_TIME_RADIUS_HOURS
    near = F.col("hour").between(F.col("kickoff_hour") - r, F.col("kickoff_hour") + r)
    hour_mean = F.when(_is("Match Day") & (F.col("c") > 0), F.col("s") / F.col("c"))
    g = (cells.groupBy(MATCH_KEY, "kickoff_hour", "is_home")
         .agg(_mean_of("Match Day").alias("match_avg"),
              _mean_of("Week Before").alias("regular_avg"),
              _mean_of("Match Day", near).alias("match_time_avg"),
              F.max_by("hour", F.when(hour_mean.isNotNull(), F.struct(hour_mean, -F.col("hour"))))
              .alias("peak_hour"),
              F.max(hour_mean).alias("peak_hour_avg")))
    inc = C.pct_increase("match_avg", "regular_avg")
    return g.withColumns({
        "delay_increase": inc,
        "delay_difference": F.col("match_avg") - F.col("regular_avg"),
        "impact": F.when(inc > 0, F.lit(K.IMPACT_ABOVE)).otherwise(F.lit(K.IMPACT_NORMAL)),
    })


def match_hourly_compare(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per match, hour and day type (match day / week before) mean delay."""
    cells = match_day_cells(data, calendar)
    return cells.select(
        MATCH_KEY, "hour",
        F.when(_is("Match Day"), F.lit(K.DAY_TYPE_MATCH[0])).otherwise(F.lit(K.DAY_TYPE_MATCH[1]))
        .alias("day_type"),
        F.try_divide(F.col("s"), F.col("c")).alias("mean_delay"))


def recommendations(data: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per match, numbered measures when the match-day mean exceeds 1.2x
    the week-before mean (one more for home matches), else 'adequate'."""
    imp = match_impact(data, calendar)
    h = F.col("kickoff_hour")
    cap = F.format_string(K.RECOMMEND_CAPACITY.replace("{start}", "%02d").replace("{end}", "%02d"),
                          h - 1, h + 1)
    base = F.array(cap, F.lit(K.RECOMMEND_SIGNALS), F.lit(K.RECOMMEND_OFFICERS))
    recs = (F.when(F.col("match_avg") > F.col("regular_avg") * K.RECOMMEND_RATIO,
                   F.when(F.coalesce(F.col("is_home"), F.lit(False)),
                          F.concat(base, F.array(F.lit(K.RECOMMEND_PARKING)))).otherwise(base))
            .otherwise(F.array(F.lit(K.RECOMMEND_ADEQUATE))))
    return imp.select(MATCH_KEY, F.posexplode(recs).alias("rec_no", "recommendation"))
