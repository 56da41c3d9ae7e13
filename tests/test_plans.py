"""Plan shape: pruned scans, broadcast dimensions, no cartesian products."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

STREAMING_OR_WRITES = {"incremental_stream", "hourly_stats_stream", "scan_history", "incremental_load",
                       "persist_stop_times", "export_csv", "read_stops", "load_stop_times",
                       "hourly_stats_table", "ad_hoc_parquet", "delay_clusters", "append_batches", "upsert_stored",
                       "hourly_summary", "daily_summary", "late_rows", "error_correction_stream"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(E.queries()) - STREAMING_OR_WRITES))
def test_no_cartesian_product(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    plan = _plan(E.queries()["hourly_stats"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan \
        or "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_stop_dimension_is_broadcast(spark):
    plan = _plan(E.queries()["stop_times_with_stops"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan


def _exchanges(df):
    plan = _plan(df)
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") \
        + plan.count("Exchange SinglePartition")


def test_expected_exchange_counts(spark):
    from delaylens.operators import prepare as P
    from delaylens.operators import stats as S
    from delaylens.operators import trips as T
    from delaylens.sources import fixtures
    st = fixtures.load_views(spark, SF_SMALL)["st"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # one aggregation: one exchange (the fixture window is pruned away)
        assert _exchanges(S.hourly_stats(P.prepare_stop_times(st))) == 1
        # four lags on one window spec: one exchange on top of the fixture's own window
        assert _exchanges(T.trip_travel_times(st)) == 2
        # lag + lead share the exchange too
        both = T.with_next_stop(T.trip_travel_times(st, keep_trip_key=True))
        assert _exchanges(both) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
