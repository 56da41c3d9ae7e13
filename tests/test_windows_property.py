"""Property: bucketed recent-window sums equal a brute-force range scan."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from delaylens.operators import windows as WN

BASE = dt.datetime(2024, 1, 1)

offsets = st.integers(min_value=0, max_value=6 * 3600 * 10**6)          # microseconds in 6 h
rows_s = st.lists(st.tuples(st.sampled_from(["a", "b"]), offsets,
                            st.one_of(st.none(), st.integers(-50, 500))), min_size=0, max_size=40)
targets_s = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), offsets), min_size=1, max_size=8,
                     unique=True)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_s, targets=targets_s, mode=st.sampled_from(["bounded", "open"]))
def test_recent_window_matches_brute_force(spark, rows, targets, mode):
    hist = spark.createDataFrame(
        [(k, BASE + dt.timedelta(microseconds=o), None if v is None else float(v)) for k, o, v in rows],
        "k string, current_stop_departure timestamp_ntz, v double")
    tg = spark.createDataFrame([(k, BASE + dt.timedelta(microseconds=o)) for k, o in targets],
                               "k string, target_ts timestamp_ntz")
    got = {(r["k"], r["target_ts"]): (r["recent_n"], r["recent_sum"], r["recent_cnt"])
           for r in WN.recent_window_sums(hist, tg, ["k"], "v", mode=mode).collect()}
    w = 3600 * 10**6
    for k, o in targets:
        sel = [v for kk, oo, v in rows if kk == k and oo >= o - w and (mode == "open" or oo < o)]
        vals = [v for v in sel if v is not None]
        want = (len(sel), float(sum(vals)) if vals else None, len(vals))
        assert got[(k, BASE + dt.timedelta(microseconds=o))] == want
