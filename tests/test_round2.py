"""Micro-cases of faults found in review: each failed before its fix."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from delaylens import api
from delaylens.functions import columns as C
from delaylens.operators import events as EV
from delaylens.operators import trips as T
from delaylens.plans import catalog as CT
from delaylens.session import scratch_path
from delaylens.sources import files as IO
from delaylens.sources.fixtures import match_rows

SF = "/root/testdata/sf0.001"


def test_incremental_load_does_not_start_anew_on_an_unreadable_table(spark):
    path = scratch_path(spark, "broken").replace("file:", "")
    os.makedirs(path)
    with open(f"{path}/part-0.parquet", "wb") as f:
        f.write(b"no footer here")
    source = CT.prepared(spark, SF)
    with pytest.raises(Exception):
        IO.incremental_load(spark, path, source)
    assert os.listdir(path) == ["part-0.parquet"]


def test_constant_delays_have_no_test_statistic(spark):
    rows = [(dt.datetime(2024, 1, d, 8), 30) for d in range(1, 29)]
    data = spark.createDataFrame(rows, "current_stop_departure timestamp_ntz, current_stop_dep_delay int")
    got = EV.event_stats(data, EV.match_calendar(match_rows(spark))).collect()
    assert len(got) == 2
    for r in got:
        assert (r.avg_delay, r.median_delay, r.std_delay) == (30.0, 30.0, 0.0)
        assert r.t_statistic is None and r.welch_dof is None and r.effect_size is None


def test_delay_seconds_round_half_to_even(spark):
    rows = [(dt.datetime(2024, 1, 1), x) for x in (2.5, 3.5, -2.5, 2.4, None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, s double")
    got = [r[0] and (r[0] - dt.datetime(2024, 1, 1)).total_seconds() for r in df.select(C.add_seconds("t", "s")).collect()]
    assert got == [2, 4, -2, 2, None]


def test_next_stop_of_one_direction_is_the_whole_trips_next(spark):
    merged, stops = CT.merged(spark, SF), CT.views(spark, SF)["stops"]
    all_rows = {tuple(r) for r in T.next_stop(merged, stops).where("gtfs_direction_id = 0").collect()}
    ids = sorted({r[0] for r in stops.select("base_stop_id").collect()})[:8]
    one = {tuple(r) for i in ids for r in api.get_next_stop(merged, stops, i, 0).collect()}
    assert one and one <= all_rows


def test_upsert_needs_an_order_for_repeated_keys(spark):
    old = spark.createDataFrame([("U1", "a", 0)], "base_stop_id string, stop_name string, at int")
    new = spark.createDataFrame([("U1", "b", 1), ("U1", "c", 2)], "base_stop_id string, stop_name string, at int")
    with pytest.raises(ValueError):
        IO.upsert_stops(old, new)
    assert [r.stop_name for r in IO.upsert_stops(old, new, order_col="at").collect()] == ["c"]


@pytest.mark.parametrize("key", ["event_stats", "event_hourly_stats", "overall_impact", "match_window_stats", "match_impact",
                                 "match_hourly_compare", "recommendations", "event_flag", "comparison_days"])
def test_calendar_joins_do_not_shuffle_raw_history(spark, key):
    """Below the first exchange over the history there is a partial aggregate, or no exchange at all."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = CT.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    lines = plan.splitlines()
    scans = [k for k, line in enumerate(lines) if "FileScan parquet" in line and "events" in line]
    assert scans
    for scan in scans:
        above = [line for line in lines[:scan][::-1]]
        for line in above:
            if "partial_" in line:
                break
            # the fixture numbers a user's events of a day itself; that window is no part of the operator
            assert not re.search(r"\bExchange hashpartitioning(?!\(user_id)", line), line
            if re.match(r"^[*( )0-9]*[A-Z]", line):  # the root
                break


def test_writes_read_their_input_once(spark):
    plan = IO.balanced_for_write(CT.prepared(spark, SF), ["date"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan


def test_all_nations_are_stations(spark):
    assert CT.views(spark, SF)["stops"].count() == 25
    unmatched = CT.prepared(spark, SF).join(CT.views(spark, SF)["stops"], "base_stop_id", "left_anti")
    assert unmatched.where(F.col("base_stop_id").isNotNull()).count() > 0
