"""The event-impact queries over a calendar that grows with the tables.

One match an order, on ten days of the stop times' month (every third, so that
other days and most weeks before a match have none), at any hour and minute;
some kickoffs are undecided, some opponents missing. SQL twins are those of the
six-match keys with this calendar in place of the literal one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.operators import events as EV
from delaylens.plans.catalog import ORACLE, QUERIES, merged, presentable
from delaylens.plans.oracle import LITERAL_MATCHES
from delaylens.sources import fixtures

ORDER_MATCHES = """
  SELECT strftime(DATE '2024-01-02' + cast(3 * (o_custkey % 10) AS INTEGER), '%d.%m.%Y') AS "Date",
         CASE WHEN o_orderkey % 17 = 0 THEN '?'
              ELSE lpad(cast(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
                   || lpad(cast(o_orderkey // 24 % 60 AS VARCHAR), 2, '0') END AS "Time",
         CASE o_orderkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'V' ELSE ' d ' END AS "Location",
         CASE WHEN o_orderkey % 5 <> 0 THEN 'Club ' || cast(o_custkey % 20 AS VARCHAR) END AS "Opponent"
  FROM orders
"""


def month_matches(spark, sf_dir) -> DataFrame:
    """The rules of ``ORDER_MATCHES``."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    day = F.date_add(F.lit("2024-01-02").cast("date"), (3 * (c % 10)).cast("int"))
    clock = F.concat(two(k % 24), F.lit(":"), two(F.floor(k / 24).cast("long") % 60))
    return fixtures.read_table(spark, sf_dir, "orders").select(
        F.date_format(day, "dd.MM.yyyy").alias("Date"), F.when(k % 17 == 0, F.lit("?")).otherwise(clock).alias("Time"),
        F.when(k % 3 == 0, F.lit("D")).when(k % 3 == 1, F.lit("V")).otherwise(F.lit(" d ")).alias("Location"),
        F.when(k % 5 != 0, F.concat(F.lit("Club "), (c % 20).cast("string"))).alias("Opponent"))


def _hour_windows(data, calendar):
    return (EV.match_hour_windows(data, calendar).groupBy("kickoff", "window_index", "comparison")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum("s").alias("delay_sum"),
                 F.coalesce(F.sum("c"), F.lit(0)).alias("delays")))


IMPACT = {
    "event_stats": EV.event_stats,
    "event_hourly_stats": EV.event_hourly_stats,
    "overall_impact": EV.overall_impact,
    "match_hour_windows": _hour_windows,
    "match_window_stats": EV.match_window_stats,
    "match_impact": EV.match_impact,
    "match_hourly_compare": EV.match_hourly_compare,
    "recommendations": EV.recommendations,
}


def _register(key, fn):
    def run(spark, sf_dir):
        return presentable(fn(merged(spark, sf_dir), EV.match_calendar(month_matches(spark, sf_dir))))

    QUERIES[f"{key}_orders"] = run
    ORACLE[f"{key}_orders"] = ORACLE[key].replace(LITERAL_MATCHES, ORDER_MATCHES)


for _key, _fn in IMPACT.items():
    _register(_key, _fn)
