"""Exact time-range sums for many targets at once.

For each target (keys, t) we need count / sum / non-null count of history
rows with the same keys and a timestamp in

* ``bounded`` mode: [t - W, t)
* ``open`` mode:    [t - W, +inf)   (the original lower-bound-only filter)

A theta join of targets with history grows with |targets| x |history| and
a window over the union of both, partitioned by the keys, puts a whole key
(or, without keys, everything) into one task. Instead history is bucketed
by W:

* bounded - the range [t-W, t) touches at most two buckets, so targets are
  expanded to those two bucket ids and equi-joined with history on
  (keys, bucket), then filtered on the exact bounds;
* open - rows in buckets after t-W's bucket come from a running sum over
  per-bucket aggregates (one row per key and bucket, i.e. bounded by the
  time span, not by the row count), and only the single bucket holding
  t-W is joined row by row.

The history may hold raw rows, counted ones (a column ``_rows``) or moments (a
column ``_sum``, one row per keys and time slot; exact for targets on whole slots,
if slots divide the window). Counted by minute and value it is bounded by the time span, so that one hour of a hot key,
or of all rows where there are no keys, is no larger than 60 minutes times the
range of values. The planner picks the join by the sizes it measures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylens.functions.columns import epoch_us

ROWS = "_rows"  # rows that a counted history row stands for
# a history of moments has these too: rows with a value, their sum, sum of squares and extremes
KNOWN, SUM, SQUARES, LEAST, MOST = "_known", "_sum", "_squares", "_least", "_most"


def _bucket(us_col, width_us: int):
    return F.floor(us_col / F.lit(float(width_us))).cast("bigint")


def recent_window_sums(history: DataFrame, targets: DataFrame, keys: Sequence[str],
                       value_col: str, ts_col: str = "current_stop_departure",
                       target_col: str = "target_ts", minutes: int = 60,
                       mode: str = "bounded") -> DataFrame:
    """Return ``targets`` (keys + target_col, expected distinct) with
    ``recent_n`` (rows), ``recent_sum`` and ``recent_cnt`` (non-null values)
    of the window."""
    if mode not in ("bounded", "open"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = list(keys)
    width = minutes * 60 * 1_000_000
    n = (F.col(ROWS) if ROWS in history.columns else F.lit(1)).cast("bigint")
    if SUM in history.columns:
        total, known = F.col(SUM).cast("double"), F.col(KNOWN)
    else:
        v = F.col(value_col).cast("double")
        total, known = v * n, F.when(v.isNotNull(), n).otherwise(0)
    hist = (history.select(*keys, epoch_us(ts_col).alias("_us"), n.alias("_n"), total.alias("_s"), known.alias("_c"))
            .where(F.col("_us").isNotNull())
            .withColumn("_b", _bucket(F.col("_us"), width)))
    tgt = (targets.select(*keys, target_col)
           .withColumn("_t", epoch_us(target_col))
           .withColumn("_x", F.col("_t") - F.lit(width))
           .withColumn("_bx", _bucket(F.col("_x"), width)))
    ident = keys + [target_col]

    def sums(prefix=""):
        return [F.sum("_n").alias(f"{prefix}n"), F.sum("_s").alias(f"{prefix}s"), F.sum("_c").alias(f"{prefix}c")]

    if mode == "bounded":
        tb = tgt.withColumn("_b", F.explode(F.array(F.col("_bx"), F.col("_bx") + 1)))
        j = (hist.join(tb.select(*ident, "_b", "_x", "_t"), keys + ["_b"])
             .where((F.col("_us") >= F.col("_x")) & (F.col("_us") < F.col("_t"))))
        part = j.groupBy(*ident).agg(*sums())
        out = tgt.select(*ident).join(part, ident, "left")
        return out.select(*ident,
                          F.coalesce("n", F.lit(0)).alias("recent_n"),
                          F.col("s").alias("recent_sum"),
                          F.coalesce("c", F.lit(0)).alias("recent_cnt"))

    # open: [x, inf) = rows of bucket(x) with ts >= x  +  all later buckets
    tb = tgt.select(*ident, F.col("_bx").alias("_b"), "_x")
    j = (hist.join(tb, keys + ["_b"]).where(F.col("_us") >= F.col("_x")))
    part = j.groupBy(*ident).agg(*sums("p_"))

    per_bucket = hist.groupBy(*keys, "_b").agg(*sums(), F.lit(0).alias("_marker"))
    markers = (tgt.select(*keys, F.col("_bx").alias("_b")).distinct()
               .withColumns({"n": F.lit(0).cast("bigint"), "s": F.lit(None).cast("double"),
                             "c": F.lit(0).cast("bigint"), "_marker": F.lit(1)}))
    # descending buckets, marker before its own bucket: the running sum at a
    # marker covers exactly the buckets after it
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))) \
        .orderBy(F.col("_b").desc(), F.col("_marker").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = (per_bucket.unionByName(markers)
             .withColumns({"l_n": F.sum("n").over(w), "l_s": F.sum("s").over(w),
                           "l_c": F.sum("c").over(w)})
             .where(F.col("_marker") == 1)
             .select(*keys, F.col("_b").alias("_bx"), "l_n", "l_s", "l_c"))
    out = (tgt.select(*ident, "_bx")
           .join(later, keys + ["_bx"], "left")
           .join(part, ident, "left"))
    total_s = F.when(F.col("l_s").isNull() & F.col("p_s").isNull(), F.lit(None).cast("double")) \
        .otherwise(F.coalesce("l_s", F.lit(0.0)) + F.coalesce("p_s", F.lit(0.0)))
    return out.select(*ident,
                      (F.coalesce("l_n", F.lit(0)) + F.coalesce("p_n", F.lit(0))).alias("recent_n"),
                      total_s.alias("recent_sum"),
                      (F.coalesce("l_c", F.lit(0)) + F.coalesce("p_c", F.lit(0))).alias("recent_cnt"))
