"""Exact medians by histogram refinement, and travel-time predictions that use them."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from delaylens.operators import predict as PR
from delaylens.operators import trips as T
from delaylens.operators.medians import VALUE, WEIGHT, brackets, exact_medians


def ranges_of(rows, key="k"):
    n = F.col(WEIGHT)
    mean = F.sum(F.col(VALUE) * n) / F.sum(n)
    cells = rows.where(F.col(VALUE).isNotNull()).groupBy(key).agg(
        F.sum(n).alias("n"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"), mean.alias("mean"),
        F.sqrt(F.sum(F.col(VALUE).cast("double") * F.col(VALUE) * n) / F.sum(n) - mean * mean).alias("std"))
    return brackets(cells, [key], "n", "lo", "hi", "mean", "std")


@pytest.mark.parametrize("buckets", [2, 7, 64, 1024])
def test_equal_to_sorted_rows(spark, buckets):
    """Odd and even counts, ties, weights, tails, one value, NULL values; buckets down to two."""
    rng = random.Random(buckets)
    data = []
    for k in range(40):
        for _ in range(rng.choice([1, 2, 3, 9, 50, 301])):
            v = rng.choice([rng.randrange(-10, 10), rng.randrange(10 ** 11), int(10 ** rng.uniform(0, 15)), -3])
            data.append((k, v, rng.choice([1, 1, 1, 4, 60])))
    data += [(100, 5, 7), (101, None, 3), (102, None, 1), (102, 8, 2), (103, -2 ** 40, 1), (103, 2 ** 40, 1)]
    rows = spark.createDataFrame(data, f"k int, {VALUE} long, {WEIGHT} long")
    got = {r.k: r.median for r in exact_medians(rows, ranges_of(rows), ["k"], buckets=buckets).collect()}
    want = {k: statistics.median([v for kk, v, w in data if kk == k and v is not None for _ in range(w)])
            for k in {k for k, v, _ in data if v is not None}}
    assert got == want


def test_a_million_distinct_values_in_a_cell(spark):
    """No row of the plan's aggregations holds more than ``buckets`` values."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 1_000_003 * 1_000 + 17).alias(VALUE),
                                         F.lit(1).alias(WEIGHT))
    rows = rows.unionByName(spark.range(10).select(F.lit(2).alias("k"), F.col("id").alias(VALUE), F.lit(1).alias(WEIGHT)))
    got = {r.k: r.median for r in exact_medians(rows, ranges_of(rows), ["k"], buckets=256).collect()}
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.median(VALUE).alias("m")).collect()}
    assert got == want


def test_empty(spark):
    rows = spark.createDataFrame([], f"k int, {VALUE} long, {WEIGHT} long")
    assert exact_medians(rows, ranges_of(rows), ["k"]).collect() == []


def test_bounded_cells_equal_exact_ones(spark):
    from delaylens.plans import catalog as CT
    rows, _ = CT._seg_history(spark, SF_CHECK, "edge")
    hist = PR.narrow_history(rows, ["segment_id_short"], "real_travel_time_us")
    keys, value = ["segment_id_short"], "real_travel_time_us"
    cells = {m: {(r.hour, r.weekday, r.segment_id_short): r for r in PR.cell_stats(hist, keys, value, median=m).collect()}
             for m in ("exact", "bounded", "approx", "none")}
    assert cells["exact"] and set(cells["exact"]) == set(cells["bounded"])
    for k, e in cells["exact"].items():
        b = cells["bounded"][k]
        assert (b.sample_size, b.base_mean, b.median) == (e.sample_size, e.base_mean, e.median)
        assert b.std == pytest.approx(e.std, rel=1e-12)
    assert set(cells["approx"]) == set(cells["exact"])
    assert all(r.median is None for r in cells["none"].values())
    with pytest.raises(ValueError):
        PR.cell_stats(hist, keys, value, median="mode")


def test_approx_median_reaches_segments(spark):
    from delaylens.plans import catalog as CT
    rows, cal = CT._seg_history(spark, SF_CHECK, "edge")
    hist = PR.narrow_history(rows, ["segment_id_short"], "real_travel_time_us")
    targets = PR.hour_slot_targets(hist, ["segment_id_short"])
    plan = PR.predict_segments(hist, targets, calendar=cal, materialize=False, approx_median=True)._jdf.queryExecution().optimizedPlan()
    assert "percentile_approx" in plan.toString() or "approx_percentile" in plan.toString()


def test_trip_product_reads_no_pairs(spark):
    """Factors and join stay in the trips' buckets; the sums equal those of the explicit fan-out."""
    from delaylens.plans import catalog as CT
    m, _ = CT._dense_history(spark, SF_CHECK)
    trips = T.stored_trips(m)
    plan = T.trip_mode_values(trips)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SelectedBucketsCount" in plan
    moments = T.trip_mode_moments(trips)
    fan = T.segment_rows(m, "trip")
    assert moments.agg(F.sum("_rows")).first()[0] == fan.where("current_stop_departure IS NOT NULL").count()
    s = fan.where("current_stop_departure IS NOT NULL").agg(F.sum("real_travel_time_us"), F.count("real_travel_time_us")).first()
    assert tuple(int(x) for x in moments.agg(F.sum("_sum"), F.sum("_known")).first()) == tuple(s)


def test_targets_off_the_slots_are_refused(spark):
    import datetime as dt

    from delaylens.plans import catalog as CT
    m, _ = CT._dense_history(spark, SF_CHECK)
    targets = spark.createDataFrame([("U100_U101", dt.datetime(2024, 1, 10, 8, 17))], "segment_id_short string, target_ts timestamp_ntz")
    with pytest.raises(ValueError):
        PR.predict_segments_trip_mode(m, targets)
    assert PR.predict_segments_trip_mode(m, targets, step_minutes=1).count() <= 1
