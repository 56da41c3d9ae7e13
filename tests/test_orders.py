"""Output orders: newest first, trips by stop sequence, matches by kickoff."""

from delaylens.operators import events as EV
from delaylens.operators import stats as S
from delaylens.operators import trips as T
from delaylens.plans import calendar_catalog as CC
from delaylens.plans import catalog as CT

SF = "/root/testdata/sf0.001"


def test_newest_sample_is_newest_first_when_asked(spark):
    st = CT.views(spark, SF)["st"].select("rt_trip_id", "gtfs_stop_sequence", "current_stop_departure")
    rows = [tuple(r) for r in S.newest_sample(st, 50, ordered=True).collect()]
    best = sorted(map(tuple, st.collect()), key=lambda r: (-r[2].timestamp(), r[0], r[1]))[:50]
    assert rows == best


def test_trip_order(spark):
    rows = [(r.rt_trip_id, r.gtfs_stop_sequence)
            for r in T.in_trip_order(T.segments(CT.views(spark, SF)["st"])).collect()]
    assert rows and rows == sorted(rows)


def test_past_matches_by_kickoff(spark):
    rows = [r.kickoff for r in EV.past_matches(CC.order_calendar(spark, SF), CC.AS_OF).collect()]
    assert rows and rows == sorted(rows)
