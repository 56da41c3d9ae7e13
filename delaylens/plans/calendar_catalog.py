"""Registered queries of the match-calendar readers and helpers, with their SQL twins.

The calendar is derived from ``orders``, one match an order, so that it grows
with the tables: dates and times as text (some empty or undecided), opponents
and home flags partly missing, and a third of the matches without the home
team. Readers get it written as CSV, the page parser as rendered match lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens import constants as K
from delaylens.operators import cluster as CL
from delaylens.operators import events as EV
from delaylens.operators import prepare as P
from delaylens.operators import trips as T
from delaylens.plans.catalog import _EVENT_STATS_SQL, merged, register, views
from delaylens.plans.oracle import D, R, TS
from delaylens.session import scratch_path
from delaylens.sources import files as IO
from delaylens.sources import fixtures
from delaylens.sources import parsing as PX

AS_OF = "1997-06-30"
PAGE_KEYS, PAGE_STEP = 512, 10 ** 10  # order keys of a match list; distance of two customers' page ids

_MATCHES = f"""
om AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS competition, o_orderstatus || '.' AS round,
              CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day,
              CASE WHEN o_orderkey % 7 = 0 THEN '?'
                   ELSE lpad(cast(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
                        || lpad(cast(o_orderkey * 7 % 60 AS VARCHAR), 2, '0') END AS clock,
              CASE o_orderkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'V' ELSE ' d ' END AS place,
              CASE WHEN o_orderkey % 5 <> 0 THEN 'Club ' || cast(o_custkey % 20 AS VARCHAR) END AS opponent,
              CASE WHEN o_orderkey % 3 = 0 THEN '{K.HOME_TEAM}' ELSE 'Club ' || cast(o_custkey % 20 AS VARCHAR) END AS home,
              CASE WHEN o_orderkey % 3 = 1 THEN '{K.HOME_TEAM}' ELSE 'Team ' || cast(o_orderkey % 9 AS VARCHAR) END AS away,
              CASE o_orderkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS flag,
              cast(o_orderkey AS VARCHAR) || ':0' AS score
       FROM orders),
oc AS (SELECT *, coalesce(opponent, '{K.DEFAULT_OPPONENT}') AS rival, lower(trim(place)) = 'd' AS at_home,
              strptime(day || ' ' || clock, '%d.%m.%Y %H:%M') AS kickoff
       FROM om WHERE day <> '' AND clock <> '?')"""


def order_matches(spark, sf_dir) -> DataFrame:
    """One raw match an order (the rules of ``_MATCHES``), with ``page`` and ``k`` for the rendered lists."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    club = F.concat(F.lit("Club "), (c % 20).cast("string"))
    return fixtures.read_table(spark, sf_dir, "orders").select(
        c.alias("page"), k.alias("k"),
        F.when(k % 3 == 0, F.lit(K.HOME_TEAM)).otherwise(club).alias("Home Team"),
        F.when(k % 3 == 1, F.lit(K.HOME_TEAM))
        .otherwise(F.concat(F.lit("Team "), (k % 9).cast("string"))).alias("Away Team"),
        F.when(k % 5 != 0, club).alias("Opponent"),
        F.when(k % 4 == 0, F.lit("True")).when(k % 4 == 1, F.lit("False")).alias("is_home"),
        F.col("o_orderpriority").alias("Competition"),
        F.concat("o_orderstatus", F.lit(".")).alias("Round"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("Date"),
        F.when(k % 7 == 0, F.lit("?")).otherwise(F.concat(two(k % 24), F.lit(":"), two(k * 7 % 60))).alias("Time"),
        F.concat(k.cast("string"), F.lit(":0")).alias("Score"),
        F.when(k % 3 == 0, F.lit("D")).when(k % 3 == 1, F.lit("V")).otherwise(F.lit(" d ")).alias("Location"))


_CALENDAR = ("Date", "Time", "Location", "Opponent")


def order_calendar(spark, sf_dir) -> DataFrame:
    return EV.match_calendar(order_matches(spark, sf_dir).select(*_CALENDAR, "Competition", "Score"))


@register("match_calendar", f"""
WITH {_MATCHES}
SELECT day AS "Date", clock AS "Time", place AS "Location", rival AS "Opponent", competition AS "Competition",
       score AS "Score", {TS('kickoff')} AS kickoff, at_home AS is_home,
       {D('kickoff')} AS match_date, cast(hour(kickoff) AS INTEGER) AS kickoff_hour
FROM oc
""")
def q_match_calendar(spark, sf_dir):
    return order_calendar(spark, sf_dir)


@register("past_matches", f"""
WITH {_MATCHES}
SELECT score AS "Score", {TS('kickoff')} AS kickoff,
       strftime(kickoff, '%d.%m.%Y') || ' - ' || rival || CASE WHEN at_home THEN ' (Home)' ELSE ' (Away)' END AS label
FROM oc WHERE cast(kickoff AS DATE) <= DATE '{AS_OF}'
""")
def q_past_matches(spark, sf_dir):
    return EV.past_matches(order_calendar(spark, sf_dir), AS_OF).select("Score", "kickoff", "label")


@register("match_value_counts", f"""
WITH {_MATCHES}
SELECT competition AS "Competition", count(*) AS matches FROM oc GROUP BY competition
""")
def q_match_value_counts(spark, sf_dir):
    return EV.match_value_counts(order_calendar(spark, sf_dir), "Competition")


@register("side_from_teams", f"""
WITH {_MATCHES}
SELECT score AS "Score", home AS "Home Team", away AS "Away Team",
       CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_home,
       CASE k % 3 WHEN 0 THEN away WHEN 1 THEN home ELSE 'Unknown' END AS "Opponent",
       CASE k % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'V' ELSE 'Neutral' END AS "Location"
FROM om
""")
def q_side_from_teams(spark, sf_dir):
    return EV.side_from_teams(order_matches(spark, sf_dir).select("Score", "Home Team", "Away Team"))


def _csv(df: DataFrame, name: str, sep: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    return path


@register("read_matches", f"""
WITH {_MATCHES}
SELECT home AS "Home Team", away AS "Away Team", rival AS "Opponent",
       CASE flag WHEN 'True' THEN true WHEN 'False' THEN false END AS is_home,
       competition AS "Competition", round AS "Round", day AS "Date", clock AS "Time", score AS "Score",
       trim(place) AS "Location", day || ' ' || clock AS datetime, {TS('kickoff')} AS kickoff,
       {D('kickoff')} AS match_date, cast(hour(kickoff) AS INTEGER) AS kickoff_hour
FROM oc
""")
def q_read_matches(spark, sf_dir):
    m = order_matches(spark, sf_dir).withColumns({"datetime": F.concat_ws(" ", "Date", "Time"),
                                                  "Location": F.trim("Location")})
    return IO.read_matches(spark, _csv(m.select(*IO.MATCH_CSV_COLUMNS), "matches", ","))


@register("read_matches_semicolon", f"""
WITH {_MATCHES}
SELECT trim(place) AS "Location", day AS "Date", clock AS "Time", rival AS "Opponent", {TS('kickoff')} AS kickoff,
       at_home AS is_home, {D('kickoff')} AS match_date, cast(hour(kickoff) AS INTEGER) AS kickoff_hour
FROM oc
""")
def q_read_matches_semicolon(spark, sf_dir):
    m = order_matches(spark, sf_dir).select(F.col("Score").alias("Skip"), F.trim("Location").alias("Location"),
                                            "Date", "Time", "Opponent")
    return IO.read_matches_semicolon(spark, _csv(m, "matches-semicolon", ";"))


def _cell(css: str, text, tag: str = "div"):
    return F.concat(F.lit(f'<{tag} class="cell {css}"> '), text, F.lit(f"\n</{tag}>"))


def match_pages(spark, sf_dir) -> DataFrame:
    """Stored match lists per customer and range of order keys, so that no customer's list grows without bound:
    one row block a match, by order key; every 13th match lacks its date cells."""
    m = order_matches(spark, sf_dir)
    when = F.when(F.col("k") % 13 == 0, F.lit("")).otherwise(
        F.concat(_cell(PX.CELL_GRAY, F.col("Date")), _cell(PX.CELL_GRAY, F.col("Time"))))
    block = F.concat(
        F.lit(f'<div class="list {PX.ROW_CLASS} odd">'), _cell(PX.CELL_LEAGUE, F.col("Competition")),
        _cell(PX.CELL_ROUND, F.col("Round")), _cell(PX.CELL_GRAY, F.lit("a")), _cell(PX.CELL_GRAY, F.lit("b")), when,
        _cell(PX.TEAM_LABEL, F.col("Home Team")), _cell(PX.TEAM_LABEL, F.col("Away Team")),
        F.when(F.col("k") % 2 == 0, _cell(PX.SCORE_INNER, F.col("Score"), "span")).otherwise(F.lit("")),
        F.lit("</div>"))
    blocks = F.sort_array(F.collect_list(F.struct("k", block.alias("b"))))["b"]
    part = F.floor(F.col("k") / PAGE_KEYS).cast("long")
    return (m.groupBy("page", part.alias("part")).agg(F.array_join(blocks, "\n").alias("body"))
            .select((-1 - F.col("page") * PAGE_STEP - F.col("part")).alias("page_id"),
                    F.concat(F.lit("<html><body>"), "body", F.lit("</body></html>")).alias("html")))


@register("matches_from_html", f"""
WITH {_MATCHES},
shown AS (SELECT *, CASE WHEN k % 13 = 0 THEN '' ELSE day END AS d, CASE WHEN k % 13 = 0 THEN '' ELSE clock END AS t
          FROM om)
SELECT -1 - c * {PAGE_STEP} - k // {PAGE_KEYS} AS page_id,
       cast(row_number() OVER (PARTITION BY c, k // {PAGE_KEYS} ORDER BY k) AS INTEGER) AS block_no,
       home AS "Home Team", away AS "Away Team", competition AS "Competition", round AS "Round",
       d AS "Date", t AS "Time", CASE WHEN k % 2 = 0 THEN score ELSE '{PX.NO_SCORE}' END AS "Score",
       CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_home,
       CASE k % 3 WHEN 0 THEN away WHEN 1 THEN home ELSE 'Unknown' END AS "Opponent",
       CASE k % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'V' ELSE 'Neutral' END AS "Location",
       d || ' ' || t AS datetime
FROM shown
""")
def q_matches_from_html(spark, sf_dir):
    # the stored pages, which hold no match rows, and the match lists rendered from the calendar
    pages = fixtures.read_table(spark, sf_dir, "pages").select("page_id", "html")
    return PX.matches_from_html(pages.unionByName(match_pages(spark, sf_dir)))


@register("coerce_times", f"""
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL
                      ELSE {TS("date_trunc('second', ts)")} END AS current_stop_departure,
       {TS('ts')} AS updated_at
FROM events
""")
def q_coerce_times(spark, sf_dir):
    e = fixtures.read_table(spark, sf_dir, "events")
    i, second = F.col("event_id"), F.date_trunc("second", "ts").cast("timestamp_ntz")

    def text(t, fmt):
        return F.date_format(t, fmt)

    shifted = F.concat(text(second + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd HH:mm:ss"), F.lit("+01:30"))
    stamp = (F.when(i % 5 == 0, text(second, "yyyy-MM-dd HH:mm:ss"))
             .when(i % 5 == 1, text(second, "yyyy-MM-dd'T'HH:mm:ss"))
             .when(i % 5 == 2, F.concat(text(second, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
             .when(i % 5 == 3, shifted)
             .otherwise(text(second, "yyyy-MM-dd 'at' HH:mm")))
    return P.coerce_times(e.select("event_id", stamp.alias("current_stop_departure"), F.col("ts").alias("updated_at")))


@register("cluster_points", """
SELECT cast(hour(current_stop_departure) AS DOUBLE) AS hour, cast(current_stop_dep_delay AS DOUBLE) AS delay,
       cast(isodow(current_stop_departure) - 1 AS DOUBLE) AS weekday, cast(count(*) AS DOUBLE) AS w
FROM merged WHERE current_stop_departure IS NOT NULL AND current_stop_dep_delay IS NOT NULL
GROUP BY ALL
""")
def q_cluster_points(spark, sf_dir):
    return CL.feature_points(merged(spark, sf_dir))


# the p-value by Simpson's rule over the t density between 0 and |t|
_STEPS = 4_000


@register("welch_test", f"""
WITH q AS ({_EVENT_STATS_SQL.strip()}),
w AS (SELECT DISTINCT abs(t_statistic) AS t, welch_dof AS v FROM q),
node AS (SELECT t, v, i, i * t / {_STEPS} AS x FROM w, generate_series(0, {_STEPS}) g(i)),
area AS (SELECT t, v, sum((CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                          * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi())
                                - (v + 1) / 2 * ln(1 + x * x / v))) * t / {_STEPS} / 3 AS a
         FROM node GROUP BY t, v)
SELECT is_event, t_statistic, welch_dof, {R('1 - 2 * a')} AS p_value
FROM q LEFT JOIN area ON area.t = abs(t_statistic) AND area.v = welch_dof
""")
def q_welch_test(spark, sf_dir):
    return EV.event_stats(*_history(spark, sf_dir), with_p_value=True).select(
        "is_event", "t_statistic", "welch_dof", "p_value")


def _history(spark, sf_dir):
    return merged(spark, sf_dir), EV.match_calendar(views(spark, sf_dir)["matches_raw"])
