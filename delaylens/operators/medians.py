"""Exact medians of many groups with bounded state: distributed selection.

``median`` keeps a map of a group's distinct values, which for travel times in
microseconds is nearly as large as the group. Here a group's median is located
by histograms: its range is cut into ``buckets`` equal parts, one partly
aggregated count per part tells which part holds the middle row, and only that
part is cut again. A part of at most ``buckets`` rows is sorted and read
directly. No group ever holds more than ``buckets`` counts or values, on any
side of a shuffle; a round is one scan and one aggregation. A round leaves a
``buckets``-th of a group's range, so 2^40 microseconds take four rounds at
most, and groups of up to ``buckets`` rows none.

The first range is the group's mean plus and minus its standard deviation, which
always holds the median, cut to its extremes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylens.session import materialise

VALUE, WEIGHT = "_value", "_weight"


def brackets(cells: DataFrame, keys: Sequence[str], known: str, low: str, high: str, mean: str, std: str) -> DataFrame:
    """Where each group's median lies: keys, known rows, _lo, _hi."""
    return cells.where(F.col(known) > 0).select(
        *keys, F.col(known).alias("_known"), F.col(low).alias("_min"), F.col(high).alias("_max"),
        F.col(mean).alias("_mean"), F.coalesce(F.col(std), F.lit(0.0)).alias("_std"))


def exact_medians(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], name: str = "median", buckets: int = 1024) -> DataFrame:
    """keys and the median of each group of ``ranges`` (see ``brackets``).

    ``rows`` holds keys (never NULL-safe: rows with a NULL key have no group),
    ``_value`` and ``_weight``, the number of rows that one stands for; NULL
    values are skipped. Both are read once a round and should be cheap to scan.
    """
    keys = list(keys)
    rows = rows.select(*keys, VALUE, WEIGHT).where(F.col(VALUE).isNotNull())
    value, lo, hi = F.col(VALUE), F.col("_lo"), F.col("_hi")
    # the middle row is number _rank; of an even number the next one counts too
    kind = rows.schema[VALUE].dataType
    small = F.col("_known") <= buckets
    near = F.col("_std") * (1 + 1e-9) + 1  # the median is within a standard deviation of the mean
    low, high = (F.when(small, F.col(end)).otherwise(inner.cast(kind)) for end, inner in (
        ("_min", F.greatest(F.col("_min").cast("double"), F.floor(F.col("_mean") - near))),
        ("_max", F.least(F.col("_max").cast("double"), F.ceil(F.col("_mean") + near)))))
    state = ranges.select(*keys, low.cast(kind).alias("_lo"), high.cast(kind).alias("_hi"),
                          ((F.col("_known") + 1) / 2).cast("long").alias("_rank"), (F.col("_known") % 2 == 0).alias("_even"),
                          F.lit(0).cast("long").alias("_below"), F.col("_known").alias("_size"), F.lit(None).cast(kind).alias("_next"))
    carried = ["_rank", "_even"]
    wide = (F.col("_size") > buckets) & (lo < hi)
    while not state.where(wide).isEmpty():
        cut = F.least(F.floor((value - lo).cast("double") * buckets / (hi - lo)), F.lit(buckets - 1))
        part = F.when(value < lo, -1).when(value > hi, buckets).otherwise(cut).cast("int")
        counts = (rows.join(state.where(wide).select(*keys, "_lo", "_hi", *carried), keys)
                  .groupBy(*keys, *carried, part.alias("_part"))
                  .agg(F.sum(WEIGHT).alias("_n"), F.min(VALUE).alias("_least"), F.max(VALUE).alias("_most")))
        order = Window.partitionBy(*keys).orderBy("_part")
        found = (counts.withColumns({"_upto": F.sum("_n").over(order), "_next": F.lead("_least").over(order)})
                 .where((F.col("_upto") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
                 .select(*keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), *carried,
                         (F.col("_upto") - F.col("_n")).alias("_below"), F.col("_n").alias("_size"), "_next"))
        state = materialise(state.where(~wide).unionByName(found), "median-ranges")

    first = F.col("_rank") - F.col("_below")
    second = first + F.col("_even").cast("long")
    one = state.where(lo == hi).select(*keys, "_even", lo.alias("_a"), F.when(second <= F.col("_size"), lo).otherwise(F.col("_next")).alias("_b"))
    kept = ["_below", "_size", "_next"]
    lists = (rows.join(state.where(lo < hi), keys).where(value.between(lo, hi))
             .groupBy(*keys, *carried, *kept).agg(F.sort_array(F.collect_list(F.struct(VALUE, WEIGHT))).alias("_all")))
    none = F.lit(None).cast(kind)
    start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("a"), none.alias("b"))

    def take(s, x):
        n = s["n"] + x[WEIGHT].cast("long")
        return F.struct(n.alias("n"), F.when(s["a"].isNull() & (n >= first), x[VALUE]).otherwise(s["a"]).alias("a"),
                        F.when(s["b"].isNull() & (n >= second), x[VALUE]).otherwise(s["b"]).alias("b"))

    more = (lists.withColumn("_two", F.aggregate("_all", start, take))
            .select(*keys, "_even", F.col("_two.a").alias("_a"), F.coalesce("_two.b", "_next").alias("_b")))
    a, b = F.col("_a").cast("double"), F.col("_b").cast("double")
    return one.unionByName(more).select(*keys, F.when(F.col("_even"), a + (b - a) / 2).otherwise(a).alias(name))
