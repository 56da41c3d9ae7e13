"""The accounted stream: every input row is in the sink, a counted duplicate, or the late table; M3 on a stream."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from delaylens.operators import predict as PR
from delaylens.session import scratch_path
from delaylens.sources import stored
from delaylens.streaming import accounted
from delaylens.streaming import streams as STR

SCHEMA = "rt_trip_id string, gtfs_stop_sequence int, current_stop_departure timestamp_ntz, note string"
BASE = dt.datetime(2024, 1, 1)


def row(trip, seq, hours, note="x"):
    return trip, seq, BASE + dt.timedelta(hours=hours) if hours is not None else None, note


ARRIVALS = [
    [row("a", 1, 0), row("a", 2, 1), row("a", 1, 0), row("b", 1, 30), row(None, None, 2), row("n", 1, None)],
    # the watermark is at hour 6: one replay in time, one late, one late and new, one new
    [row("b", 1, 30), row("a", 1, 0), row("c", 1, 5), row("c", 2, 6), row("d", 1, 60), row("n", 1, None), row("d", 1, 61, "y")],
    [],
    [row("e", 1, 35), row("e", 2, 36), row("d", 1, 60), row("f", 1, 36), row("f", 1, 36)],
]


def plain(arrivals, delay=24):
    sink, late, counts, mark, seen = [], [], [], None, set()
    for rows in arrivals:
        if not rows:
            continue
        n = Counter()
        for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or BASE, r[3])):
            if mark is not None and r[2] is not None and r[2] < mark:
                late.append(r)
                n["late"] += 1
            elif r[:2] in seen:
                n["duplicate"] += 1
            else:
                seen.add(r[:2])
                sink.append(r)
                n["new"] += 1
        counts.append((len(rows), n["new"], n["duplicate"], n["late"]))
        mark = max([m for m in [mark, *(r[2] - dt.timedelta(hours=delay) for r in rows if r[2])] if m])
    return sink, late, counts


def run(spark, src, path, ckpt, arrivals, start=0):
    for k, rows in enumerate(arrivals[start:], start):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/{k}")
        accounted.accounted_stream(spark, f"{src}/*", spark.createDataFrame([], SCHEMA).schema, path, ckpt,
                                   delay="24 HOURS").awaitTermination()


def check(spark, path, arrivals):
    tables = accounted.Tables.at(spark, path)
    sink, late, counts = plain(arrivals)
    names = ["rt_trip_id", "gtfs_stop_sequence", "current_stop_departure", "note"]
    assert Counter(tuple(r) for r in tables.sink.read().select(*names).collect()) == Counter(sink)
    assert Counter(tuple(r) for r in tables.late.read().select(*names).collect()) == Counter(late)
    got = [tuple(r) for r in tables.counts.read().orderBy(F.col("batch").cast("int"))
           .where("rows_in > 0").select("rows_in", "new", "duplicate", "late").collect()]
    assert got == counts and all(n == sum(parts) for n, *parts in got)


def test_every_row_is_accounted_for(spark):
    src, path, ckpt = (scratch_path(spark, x) for x in ("acc-src", "acc", "acc-ckpt"))
    run(spark, src, path, ckpt, ARRIVALS)
    check(spark, path, ARRIVALS)


@pytest.mark.parametrize("fails_at", ["late", "counts"])
def test_an_interrupted_batch_adds_nothing_twice(spark, monkeypatch, fails_at):
    src, path, ckpt = (scratch_path(spark, x) for x in ("acc-src", "acc", "acc-ckpt"))
    run(spark, src, path, ckpt, ARRIVALS[:1])
    append = stored.StoredTable.append

    def killed(self, rows, batch):
        if self.path.endswith(fails_at):
            raise RuntimeError("killed")
        return append(self, rows, batch)

    with monkeypatch.context() as m:
        m.setattr(stored.StoredTable, "append", killed)
        with pytest.raises(Exception, match="killed"):
            run(spark, src, path, ckpt, ARRIVALS[:2], start=1)
    run(spark, src, path, ckpt, [*ARRIVALS[:2], *ARRIVALS[2:]], start=2)   # the batch of the second arrival is run again first
    check(spark, path, ARRIVALS)


def test_stream_corrections_equal_batch_predictions(spark):
    from conftest import SF_CHECK
    from delaylens.plans import catalog as CT
    rows, _ = CT._merged_cal(spark, SF_CHECK)
    keys = ["gtfs_direction_id"]
    src, sink = scratch_path(spark, "m3-src"), scratch_path(spark, "m3-sink")
    part = rows.select("current_stop_departure", "current_stop_dep_delay", *keys)
    for day in (10, 20, 31):   # three arrivals in time order
        part.where((F.dayofmonth("current_stop_departure") <= day) & (F.dayofmonth("current_stop_departure") > day - 11)
                   & (F.dayofmonth("current_stop_departure") > {10: 0, 20: 10, 31: 20}[day])).coalesce(1).write.parquet(f"{src}/{day}")
    cells = PR.cell_stats(rows, keys)
    STR.error_correction_stream(spark, f"{src}/*", part.schema, sink, cells, keys, max_files_per_trigger=1).awaitTermination()
    got = {(r.gtfs_direction_id, r.target_ts.replace(tzinfo=None)): (r.recent_n, r.error_correction) for r in spark.read.parquet(sink).collect()}
    targets = spark.createDataFrame(list(got), "gtfs_direction_id int, target_ts timestamp_ntz")
    want = {(r.gtfs_direction_id, r.datetime): (r.recent_n, r.error_correction) for r in PR.predict(rows, targets, keys).collect()}
    assert set(got) == set(want) and len(got) > 1_000
    for k, (n, c) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(c, abs=1e-9)
