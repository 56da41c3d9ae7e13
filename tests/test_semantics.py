"""Hand-worked micro-cases for the behaviour rules."""

import datetime as dt

from pyspark.sql import functions as F

from delaylens.functions import columns as C
from delaylens.operators import events as EV
from delaylens.operators import predict as PR
from delaylens.operators import stats as S
from delaylens.operators import trips as T

TS = dt.datetime


def test_s1_base_stop_id(spark):
    df = spark.createDataFrame([("U100Z1P",), ("U163S1",), ("X999",), ("Z1",), (None,)], "id string")
    got = [r[0] for r in df.select(C.base_stop_id("id")).collect()]
    assert got == ["U100", "U163", None, "", None]


def test_s2_short_id_keeps_metro_ids(spark):
    df = spark.createDataFrame([("U163S1",), ("U100Z101P",)], "id string")
    assert [r[0] for r in df.select(C.short_stop_id("id")).collect()] == ["U163S1", "U100"]


def _trip(spark, rows):
    schema = ("rt_trip_id string, gtfs_stop_id string, gtfs_stop_sequence int, "
              "current_stop_departure timestamp_ntz, current_stop_dep_delay int, "
              "current_stop_arrival timestamp_ntz, current_stop_arr_delay int, gtfs_direction_id int")
    return spark.createDataFrame(rows, schema)


def test_s9_real_arrival_falls_back_to_departure(spark):
    df = _trip(spark, [
        ("t", "A", 1, TS(2024, 1, 1, 10, 0, 0), 30, TS(2024, 1, 1, 9, 59, 50), None, 0),
        ("t", "B", 2, TS(2024, 1, 1, 10, 5, 0), None, TS(2024, 1, 1, 10, 4, 30), None, 0),
        ("t", "C", 3, TS(2024, 1, 1, 10, 9, 0), 10, TS(2024, 1, 1, 10, 8, 0), 20, 0),
    ])
    r = {x["gtfs_stop_id"]: x for x in T.trip_travel_times(df).collect()}
    assert r["A"]["real_arrival"] == TS(2024, 1, 1, 10, 0, 30)        # dep + dep delay
    assert r["B"]["real_departure"] is None and r["B"]["real_arrival"] is None
    assert r["B"]["real_travel_time_seconds"] is None
    assert r["C"]["real_arrival"] == TS(2024, 1, 1, 10, 8, 20)
    assert r["C"]["real_travel_time_seconds"] is None                 # previous real dep unknown
    assert r["C"]["planned_travel_time_seconds"] == 180.0              # 10:08 - 10:05
    assert r["A"]["section_id"] is None and r["C"]["section_id"] == "B_C"


def test_p13_fraction_of_seconds_kept(spark):
    df = _trip(spark, [
        ("t", "A", 1, TS(2024, 1, 1, 10, 0, 0, 100000), 0, TS(2024, 1, 1, 10, 0, 0), 0, 0),
        ("t", "B", 2, TS(2024, 1, 1, 10, 0, 5), 0, TS(2024, 1, 1, 10, 0, 2), 0, 0),
    ])
    r = T.trip_travel_times(df).where("gtfs_stop_id = 'B'").first()
    assert abs(r["planned_travel_time_seconds"] - 1.9) < 1e-9


def test_s12_histogram_bins_and_empty_bins(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), TS(2024, 1, 1, 8), d, "U1")
                                for d in (-20, 0, 60, 61, 500, None)],
                               "date date, current_stop_departure timestamp_ntz, "
                               "current_stop_dep_delay int, base_stop_id string")
    got = {r["delay_range"]: r["count"] for r in S.delay_distribution(df).collect()}
    assert got == {"0-60s": 4, "60-120s": 1, "120-180s": 0, "180-300s": 0, ">300s": 1}


def test_s13_colour_of_null_is_darkred(spark):
    df = spark.createDataFrame([(60.0,), (60.5,), (300.0,), (301.0,), (None,)], "d double")
    assert [r[0] for r in df.select(C.delay_color("d")).collect()] == \
        ["green", "yellow", "red", "darkred", "darkred"]


def test_s14_weekday_monday_zero(spark):
    df = spark.createDataFrame([(TS(2024, 1, 1),), (TS(2024, 1, 7),)], "t timestamp_ntz")  # Mon, Sun
    assert [r[0] for r in df.select(C.weekday("t")).collect()] == [0, 6]


def test_s19_worst_hour_takes_lowest_of_ties(spark):
    from delaylens.sources.fixtures import MATCH_SCHEMA
    cal = EV.match_calendar(spark.createDataFrame([("01.01.2024", "19:00", "D", "X")], MATCH_SCHEMA))
    data = spark.createDataFrame([(TS(2024, 1, 1, 9, 5), 50), (TS(2024, 1, 1, 8, 5), 50),
                                  (TS(2024, 1, 1, 7, 5), 10)],
                                 "current_stop_departure timestamp_ntz, current_stop_dep_delay int")
    r = EV.match_impact(data, cal).first()
    assert r["peak_hour"] == 8 and r["peak_hour_avg"] == 50.0
    o = EV.overall_impact(data, cal).first()
    assert o["worst_hour"] == 8


def test_s20_reliability_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 1)).collect()] == [0.2, 0.4]


def test_s25_bad_kickoffs_dropped(spark):
    from delaylens.sources.fixtures import match_rows
    cal = EV.match_calendar(match_rows(spark)).orderBy("kickoff").collect()
    assert [r["kickoff"] for r in cal] == [TS(2024, 1, 6, 19), TS(2024, 1, 10, 21),
                                           TS(2024, 1, 14, 15), TS(2024, 1, 27, 17)]
    assert [r["Opponent"] for r in cal][2] == "TBD"
    assert [r["is_home"] for r in cal] == [True, False, True, False]


def test_s27_grid_end_exclusive(spark):
    keys = spark.range(1).select()
    g = PR.with_grid(keys, "2024-01-01 10:07:00", 3, 15).collect()
    assert len(g) == 12 and g[0][0] == TS(2024, 1, 1, 10, 7)
    w = PR.with_grid(keys, "2024-01-01 10:07:00", 24 * 7, 15, floor_to_hour=True).collect()
    assert w[0][0] == TS(2024, 1, 1, 10, 0) and len(w) == 7 * 96 + 1


def test_s29_increase_zero_unless_regular_positive(spark):
    df = spark.createDataFrame([(10.0, 5.0), (10.0, 0.0), (10.0, None), (None, 5.0)], "m double, r double")
    assert [r[0] for r in df.select(C.pct_increase("m", "r")).collect()] == [100.0, 0.0, 0.0, None]


def test_s18_next_stop_mode_ties_take_smallest(spark):
    rows = []
    for i, nxt in enumerate(["U2Z1P", "U3Z1P", "U3Z2P", "U2Z2P"]):
        rows.append((f"t{i}", "U1Z1P", 1, TS(2024, 1, 1, 8, i), 0, TS(2024, 1, 1, 8, i), 0, 0))
        rows.append((f"t{i}", nxt, 2, TS(2024, 1, 1, 8, i, 30), 0, TS(2024, 1, 1, 8, i, 30), 0, 0))
    df = _trip(spark, rows).withColumn("base_stop_id", C.base_stop_id("gtfs_stop_id"))
    stops = spark.createDataFrame([("U2", "Two"), ("U3", "Three")], "base_stop_id string, stop_name string")
    r = T.next_stop(df, stops).where("base_stop_id = 'U1'").first()
    assert r["next_stop_id"] == "U2Z1P" and r["next_stop_name"] == "Two"


def test_s7_trip_mode_fan_out(spark):
    rows = [("a", f"S{i}Z1P", i, TS(2024, 1, 1, 8, i), 0, TS(2024, 1, 1, 8, i), 0, 0) for i in range(4)]
    rows += [("b", f"S{i}Z1P", i, TS(2024, 1, 1, 9, i), 0, TS(2024, 1, 1, 9, i), 0, 0) for i in range(2)]
    df = _trip(spark, rows)
    assert T.segment_rows(df, "trip").count() == 4 * 3 + 2 * 1
    assert T.segment_rows(df, "edge").count() == 3 + 1


def test_rows_without_trip_form_no_trip(spark):
    rows = [(None, "A", 1, TS(2024, 1, 1, 8), 0, TS(2024, 1, 1, 8), 0, 0),
            (None, "B", 2, TS(2024, 1, 1, 9), 0, TS(2024, 1, 1, 9), 0, 0),
            ("t", "C", 1, TS(2024, 1, 1, 8), 0, TS(2024, 1, 1, 8), 0, 0),
            ("t", "D", 2, TS(2024, 1, 1, 9), 0, TS(2024, 1, 1, 9), 0, 0)]
    got = {r["gtfs_stop_id"]: r["previous_stop_id"] for r in T.trip_travel_times(_trip(spark, rows)).collect()}
    assert got == {"A": None, "B": None, "C": None, "D": "C"}


def test_s24_event_timezone_option(spark):
    from delaylens.sources.fixtures import MATCH_SCHEMA
    raw = spark.createDataFrame([("06.01.2024", "19:00", "D", "X"), ("06.07.2024", "19:00", "D", "Y")],
                                MATCH_SCHEMA)
    plain = [r["kickoff"] for r in EV.match_calendar(raw).orderBy("kickoff").collect()]
    utc = [r["kickoff"] for r in EV.match_calendar(raw, event_tz="Europe/Prague").orderBy("kickoff").collect()]
    assert plain == [TS(2024, 1, 6, 19), TS(2024, 7, 6, 19)]
    assert utc == [TS(2024, 1, 6, 18), TS(2024, 7, 6, 17)]      # CET +1, CEST +2


def test_api_single_target_matches_set_based(spark):
    from conftest import SF_CHECK
    from delaylens import api
    from delaylens.plans import catalog as CT
    m, cal = CT._merged_cal(spark, SF_CHECK)
    one = api.compute_prediction(m, "2024-01-15 08:30:00", calendar=cal).collect()
    assert len(one) == 1 and one[0]["sample_size"] >= 5
    nxt = api.get_next_stop(m, CT.views(spark, SF_CHECK)["stops"], "U100", 0).collect()
    assert len(nxt) == 1 and nxt[0]["next_stop_id"]


def test_trip_mode_product_equals_fan_out(spark):
    """The product of incidence and moments gives the same predictions as the explicit fan-out."""
    from delaylens.operators import predict as PR
    rows = []
    # two trips on one route (same segments) and one trip on a branch
    for t, stops, h in (("r1", ["A", "B", "C", "D"], 8), ("r2", ["A", "B", "C", "D"], 8),
                        ("r3", ["A", "B", "E"], 8), ("r4", ["A", "B", "C", "D"], 8)):
        for i, sid in enumerate(stops):
            rows.append((t, f"U{sid}Z1P", i + 1, TS(2024, 1, 1, h, 5 * i + int(t[1])), 10 * i + int(t[1]),
                         TS(2024, 1, 1, h, 5 * i + int(t[1])), 7 * i, 0))
    df = _trip(spark, rows)
    fan = T.segment_rows(df, "trip")
    tg = spark.createDataFrame([("UA_UB", TS(2024, 1, 1, 8, 30)), ("UB_UC", TS(2024, 1, 1, 8, 30)),
                                ("UB_UE", TS(2024, 1, 1, 8, 30))], "segment_id_short string, target_ts timestamp_ntz")
    want = {r["segment_id_short"]: r for r in
            PR.predict(fan, tg, ["segment_id_short"], value_col="real_travel_time_us", recent_mode="open",
                       label="travel_time", unit_divisor=1e6).collect()}
    trips = T.stored_trips(df)
    got = {r["segment_id_short"]: r for r in
           PR.predict_trip_mode(trips, tg, ["segment_id_short"], recent_mode="open").collect()}
    assert set(got) == set(want) and want
    for k in want:
        for c in ("sample_size", "mean_travel_time", "median_travel_time", "std_travel_time", "recent_n"):
            assert got[k][c] == want[k][c] or abs(got[k][c] - want[k][c]) < 1e-9


def test_api_match_day_and_daily_helpers(spark):
    from conftest import SF_CHECK
    from delaylens import api
    from delaylens.plans import catalog as CT
    m, cal = CT._merged_cal(spark, SF_CHECK)
    days = {r["comparison"] for r in api.get_comparison_data(m, cal, "2024-01-14").select("comparison")
            .distinct().collect()}
    assert days == {"Match Day", "Day Before", "Day After", "Week Before", "Week After"}
    d = api.get_delay_statistics(CT.prepared(spark, SF_CHECK), "2024-01-14").collect()
    assert len(d) == 1 and d[0]["total_records"] > 0
    rows = T.segment_rows(m, "edge")
    one = api.compute_segment_prediction(rows, "2024-01-15 08:30:00", "U100_U101").collect()
    assert len(one) <= 1
