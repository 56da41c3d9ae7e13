"""Invariants over the fixture data (sf0.001)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from delaylens.operators import prepare as P
from delaylens.operators import stats as S
from delaylens.operators import trips as T
from delaylens.sources import fixtures


def _views(spark):
    return fixtures.load_views(spark, SF_SMALL)


def test_histogram_sums_to_rows(spark):
    v = _views(spark)
    m = P.stop_times_with_stops(P.with_stop_keys(v["st"]), v["stops"])
    hist = S.delay_distribution(m).groupBy("date").agg(F.sum("count").alias("n"))
    rows = m.groupBy("date").count()
    assert hist.join(rows, "date").where(F.col("n") != F.col("count")).count() == 0


def test_segments_equal_rows_minus_trips(spark):
    st = _views(spark)["st"]
    trips = st.select("rt_trip_id").distinct().count()
    assert T.segments(st).count() == st.count() - trips


def test_trip_fan_out_is_sum_k_k_minus_1(spark):
    st = _views(spark)["st"]
    k = st.groupBy("rt_trip_id").count()
    expected = k.select(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
    assert T.segment_rows(st, "trip").count() == expected


def test_permuting_rows_changes_nothing(spark):
    st = _views(spark)["st"]
    a = S.hourly_stats(P.prepare_stop_times(st))
    b = S.hourly_stats(P.prepare_stop_times(st.orderBy(F.rand(3)).repartition(7)))
    cols = ["date", "hour", "gtfs_stop_id", "count", F.round("avg_delay", 9).alias("a")]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_newest_sample_is_exact_top_n(spark):
    st = _views(spark)["st"].select("rt_trip_id", "gtfs_stop_sequence", "current_stop_departure")
    times = sorted((r[0] for r in st.select("current_stop_departure").collect()), reverse=True)
    for n in (1, 13, len(times) // 2, len(times) - 1, len(times) + 10):
        got = sorted((r[0] for r in S.newest_sample(st, n).select("current_stop_departure").collect()),
                     reverse=True)
        assert got == times[:n]


def test_approximate_options_stay_close(spark):
    from delaylens.operators import predict as PR
    st = _views(spark)["st"]
    prep = P.prepare_stop_times(st)
    exact = {r["date"]: r["unique_stops"] for r in S.daily_stats(prep).collect()}
    approx = {r["date"]: r["unique_stops"] for r in S.daily_stats(prep, approx_distinct=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(exact[d] - approx[d]) <= max(1, 0.1 * exact[d]) for d in exact)
    e = {(r["hour"], r["weekday"]): r["median"] for r in PR.cell_stats(st, min_sample=1).collect()}
    a = {(r["hour"], r["weekday"]): r["median"] for r in PR.cell_stats(st, min_sample=1, approx_median=True).collect()}
    assert e.keys() == a.keys()
    spread = max(abs(e[k] - a[k]) for k in e if e[k] is not None)
    assert spread <= 60      # delays in seconds; the sketch returns an observed value near the middle
