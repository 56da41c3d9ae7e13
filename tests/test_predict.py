"""Set-based predictions against a per-target brute force on small inputs.

The brute force follows the rules literally for one target at a time: cell
of the target's hour and weekday (and keys), n >= 5, t-interval, recent
window [t-60min, t) (bounded) or [t-60min, inf) (open), correction when at
least 3 recent rows, reliability.
"""

import datetime as dt
import math
import random

import pytest

from delaylens.functions.tdist import t_ppf
from delaylens.operators import predict as PR
from delaylens.operators import windows as WN

PEAK = {7, 8, 9, 16, 17, 18}


def _history(seed, n=400):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        t = base + dt.timedelta(minutes=rnd.randrange(0, 14 * 24 * 60), microseconds=rnd.randrange(10**6))
        d = None if rnd.random() < 0.1 else rnd.randrange(-30, 300)
        rows.append((f"U{rnd.randrange(3)}", rnd.randrange(2), t, d))
    # a burst so that some recent windows are full
    for i in range(30):
        rows.append(("U0", 0, dt.datetime(2024, 1, 8, 8, 0) + dt.timedelta(minutes=i), 40 + i))
    return rows


def _brute(rows, targets, keys, mode, match_days=()):
    out = {}
    kidx = {"base_stop_id": 0, "gtfs_direction_id": 1}
    for tgt in targets:
        t = tgt[-1]
        kv = tgt[:-1]

        def same(r):
            return all(r[kidx[k]] == v for k, v in zip(keys, kv))
        sim = [r for r in rows if r[2].hour == t.hour and r[2].weekday() == t.weekday() and same(r)]
        if len(sim) < 5:
            continue
        vals = [r[3] for r in sim if r[3] is not None]
        n = len(sim)
        mean = sum(vals) / len(vals)
        std = math.sqrt(sum((v - mean) ** 2 for v in vals) / (len(vals) - 1))
        margin = t_ppf(0.975, n - 1) * std / math.sqrt(n)
        lo = t - dt.timedelta(minutes=60)
        rec = [r for r in rows if same(r) and r[2] >= lo and (mode == "open" or r[2] < t)]
        if len(rec) >= 3:
            rv = [r[3] for r in rec if r[3] is not None]
            corr = sum(rv) / len(rv) - mean
        else:
            corr = 0.0
        adj = mean + corr
        cond = (0.8 if t.hour in PEAK else 1.0) * (0.9 if t.date() in match_days else 1.0)
        rel = (0.4 * min(1.0, n / 30) + 0.4 * (1 - min(1.0, 2 * margin / (abs(adj) + 1))) + 0.2 * cond) * 100
        out[tuple(kv) + (t,)] = (adj, mean, corr, margin, n, round(rel, 1), len(rec))
    return out


@pytest.mark.parametrize("keys", [(), ("base_stop_id",), ("base_stop_id", "gtfs_direction_id")])
@pytest.mark.parametrize("mode", ["bounded", "open"])
@pytest.mark.parametrize("counted", [False, True])
def test_predict_matches_brute_force(spark, keys, mode, counted):
    rows = _history(7)
    hist = spark.createDataFrame(rows, "base_stop_id string, gtfs_direction_id int, "
                                       "current_stop_departure timestamp_ntz, current_stop_dep_delay int")
    if counted:  # exact for targets on whole minutes
        hist = PR.minute_counts(hist, list(keys))
    times = [dt.datetime(2024, 1, 8, 8, 20), dt.datetime(2024, 1, 8, 8, 0),
             dt.datetime(2024, 1, 9, 13, 45, 0 if counted else 12),
             dt.datetime(2024, 1, 3, 0, 0), dt.datetime(2024, 1, 15, 8, 30)]
    key_vals = {(): [()], ("base_stop_id",): [("U0",), ("U1",), ("U2",)],
                ("base_stop_id", "gtfs_direction_id"): [("U0", 0), ("U1", 1), ("U2", 0)]}[keys]
    targets = [kv + (t,) for kv in key_vals for t in times]
    schema = ", ".join([f"{k} {'string' if k == 'base_stop_id' else 'int'}" for k in keys]
                       + ["target_ts timestamp_ntz"])
    tdf = spark.createDataFrame(targets, schema)
    got = {tuple(r[k] for k in keys) + (r["datetime"],): r
           for r in PR.predict(hist, tdf, list(keys), recent_mode=mode).collect()}
    want = _brute(rows, targets, keys, mode)
    assert set(got) == set(want)
    assert want, "fixture should give predictions"
    for k, (adj, mean, corr, margin, n, rel, nrec) in want.items():
        g = got[k]
        assert g["sample_size"] == n and g["recent_n"] == nrec
        assert math.isclose(g["mean_delay"], adj, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g["base_mean_delay"], mean, rel_tol=1e-9)
        assert math.isclose(g["margin_error"], margin, rel_tol=1e-9)
        assert abs(g["reliability"] - rel) <= 0.1 + 1e-9
        assert g["confidence_lower"] <= g["mean_delay"] <= g["confidence_upper"]
        assert 0.0 <= g["reliability"] <= 100.0


def test_recent_window_bucket_edges(spark):
    """Rows exactly at t-60min, just before it and exactly at t."""
    t = dt.datetime(2024, 1, 1, 10, 0)
    rows = [("k", t - dt.timedelta(minutes=60), 1.0), ("k", t - dt.timedelta(minutes=60, microseconds=1), 2.0),
            ("k", t, 4.0), ("k", t + dt.timedelta(hours=5), 8.0), ("k", t - dt.timedelta(minutes=1), None)]
    hist = spark.createDataFrame(rows, "k string, current_stop_departure timestamp_ntz, v double")
    tg = spark.createDataFrame([("k", t)], "k string, target_ts timestamp_ntz")
    b = WN.recent_window_sums(hist, tg, ["k"], "v", mode="bounded").first()
    o = WN.recent_window_sums(hist, tg, ["k"], "v", mode="open").first()
    assert (b["recent_n"], b["recent_sum"], b["recent_cnt"]) == (2, 1.0, 1)
    assert (o["recent_n"], o["recent_sum"], o["recent_cnt"]) == (4, 13.0, 3)
