"""UTC-aware TIMESTAMP history (production) behaves like TIMESTAMP_NTZ (fixtures)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from delaylens.operators import prepare as P
from delaylens.operators import predict as PR
from delaylens.operators import stats as S
from delaylens.operators import trips as T
from delaylens.plans.catalog import presentable
from delaylens.sources import fixtures

TIME_COLS = ("current_stop_departure", "current_stop_arrival", "created_at", "updated_at")


def _both(spark):
    v = fixtures.load_views(spark, SF_SMALL)
    ltz = v["st"].withColumns({c: F.col(c).cast("timestamp") for c in TIME_COLS})
    return v, v["st"], ltz


def _same(a, b):
    a, b = presentable(a), presentable(b)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stats_and_trips_agree(spark):
    v, ntz, ltz = _both(spark)
    _same(S.hourly_stats(P.prepare_stop_times(ntz)), S.hourly_stats(P.prepare_stop_times(ltz)))
    _same(T.trip_travel_times(ntz), T.trip_travel_times(ltz))
    _same(T.trip_segment_summary(T.trip_travel_times(ntz)), T.trip_segment_summary(T.trip_travel_times(ltz)))


def test_predictions_agree(spark):
    v, ntz, ltz = _both(spark)
    for mode in ("bounded", "open"):
        a = PR.predict(ntz, PR.hour_slot_targets(ntz), [], recent_mode=mode)
        b = PR.predict(ltz, PR.hour_slot_targets(ntz), [], recent_mode=mode)
        _same(a.drop("datetime"), b.drop("datetime"))
