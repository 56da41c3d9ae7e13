"""Stored tables: batches that can be repeated, atomic versions, the kept summary; the newest-rows sample."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from delaylens.operators import prepare as P
from delaylens.operators import stats as S
from delaylens.session import scratch_path
from delaylens.sources import stored, summary
from delaylens.sources.fixtures import load_views

STOPS = "base_stop_id string, stop_name string"


def table(spark, **kw):
    return stored.StoredTable(spark, scratch_path(spark, "t"), **kw)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def breaks(df):
    """The same rows, but writing them fails in some task, after others have written theirs."""
    bad = F.when(F.col("stop_name") == "bad", F.raise_error(F.lit("lost"))).otherwise(F.col("stop_name"))
    return df.withColumn("stop_name", bad.cast("string"))


def test_a_table_that_does_not_exist(spark):
    t = table(spark)
    assert t.read() is None and t.commits() == [] and t.batch("a") is None and stored.high_water_mark(t) is None


def test_a_batch_that_fails_between_write_and_commit(spark, monkeypatch):
    t = table(spark)
    t.append(spark.createDataFrame([("a", "A")], STOPS), "one")
    two = spark.createDataFrame([("b", "B"), ("c", "C")], STOPS)

    def killed(self, commit):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(stored.StoredTable, "_commit", killed)
        with pytest.raises(RuntimeError):
            t.append(two, "two")
    assert rows_of(t.read()) == [("a", "A")]          # its rows are written, but nobody reads them
    assert t.append(two, "two") and not t.append(two, "two")
    assert rows_of(t.read()) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert rows_of(t.batch("two")) == [("b", "B"), ("c", "C")]


def test_mark_does_not_see_half_written_batches(spark, monkeypatch):
    st = load_views(spark, SF_CHECK)["st"]
    days = [F.lit(f"2024-01-{d:02d}").cast("timestamp_ntz") for d in (10, 20)]
    t = table(spark, partition_by=["date"])
    source = st.withColumn("date", F.to_date("current_stop_departure"))
    t.append(source.where(F.col("current_stop_departure") < days[0]), "a")
    seen = source.where(F.col("current_stop_departure") < days[1])
    with monkeypatch.context() as m:
        m.setattr(stored.StoredTable, "_commit", lambda self, c: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            stored.append_incremental(t, seen, "b", exact=True)
    b = stored.append_incremental(t, seen, "b", exact=True)
    again = stored.append_incremental(t, source, "b", exact=True)   # a retry that meets a grown source
    assert b.count() == again.count() == seen.where(F.col("current_stop_departure") >= days[0]).count()
    stored.append_incremental(t, source, "c", exact=True)
    assert t.read().count() == source.count() == t.read().select("rt_trip_id", "gtfs_stop_sequence").distinct().count()
    assert stored.high_water_mark(t) == source.agg(F.max("current_stop_departure")).first()[0]


def test_a_killed_upsert_leaves_the_old_version(spark):
    t = table(spark)
    t.replace(spark.createDataFrame([("a", "A"), ("b", "B")], STOPS))
    before = t.read()
    with pytest.raises(Exception, match="lost"):
        stored.upsert_table(t, breaks(spark.createDataFrame([("b", "B2"), ("c", "bad")], STOPS).repartition(2)))
    assert rows_of(t.read()) == [("a", "A"), ("b", "B")]
    stored.upsert_table(t, spark.createDataFrame([("b", "B2"), ("c", "C")], STOPS), batch="u")
    assert not t.replace(before, batch="u")
    assert rows_of(t.read()) == [("a", "A"), ("b", "B2"), ("c", "C")]
    assert rows_of(before) == [("a", "A"), ("b", "B")]             # a reader that had begun
    assert rows_of(t.read(number=0)) == [("a", "A"), ("b", "B")]


def test_versions_and_batches_mix_and_columns_may_grow(spark):
    t = table(spark)
    t.append(spark.createDataFrame([("a", "A")], STOPS), "1")
    t.replace(t.read().unionByName(spark.createDataFrame([("b", "B")], STOPS)))
    t.append(spark.createDataFrame([("c", "C", 3)], STOPS + ", n int"), "2")
    t.append(spark.createDataFrame([], STOPS), "empty")
    assert rows_of(t.read().fillna(0)) == [("a", "A", 0), ("b", "B", 0), ("c", "C", 3)]
    assert t.batch("empty").count() == 0


def test_two_writers_are_an_error(spark):
    t = table(spark)
    t.append(spark.createDataFrame([("a", "A")], STOPS), "1")
    commit = t.commits()[0]
    t._commit(stored.Commit(0, "x", commit.folder, False, commit.schema))
    with pytest.raises(ValueError, match="two writers"):
        t.read()


def test_summary_of_increments_equals_full_recomputation(spark):
    rows = P.prepare_stop_times(load_views(spark, SF_CHECK)["st"])
    t = table(spark, partition_by=["date"])
    parts = [rows.where((F.xxhash64("rt_trip_id") % 3) == k) for k in (-2, -1, 0, 1, 2)]
    for k, p in enumerate(parts):
        assert summary.update(t, p, str(k)) and not summary.update(t, p, str(k))

    def key(r):
        return r["date"], r["hour"], r["gtfs_stop_id"]

    want = {key(r): r for r in S.hourly_stats(rows).collect()}
    for _ in range(2):
        got = {key(r): r for r in summary.hourly(t).collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            g = got[k]
            assert (g["count"], g.avg_delay) == (w["count"], w.avg_delay)
            assert g.std_delay == pytest.approx(w.std_delay, rel=1e-12) if w.std_delay is not None else g.std_delay is None
        summary.compact(t)


def test_distinct_counts_from_sketches(spark):
    """Daily distinct platforms and trips within four standard errors (6.5 %) of the exact ones."""
    rows = P.prepare_stop_times(load_views(spark, "/root/testdata/sf0.1")["st"])
    t = table(spark, partition_by=["date"])
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    summary.update(t, rows.where(F.col("current_stop_departure") < half), "a")
    summary.update(t, rows.where(F.col("current_stop_departure") >= half), "b")
    exact = {r.date: r for r in rows.groupBy("date").agg(F.count_distinct("gtfs_stop_id").alias("s"),
                                                         F.count_distinct("rt_trip_id").alias("t")).collect()}
    got = summary.daily(t).collect()
    assert {r.date for r in got} == set(exact)
    for r in got:
        assert abs(r.unique_stops - exact[r.date].s) <= 0.065 * exact[r.date].s
        assert abs(r.unique_trips - exact[r.date].t) <= 0.065 * exact[r.date].t


def test_an_update_reads_its_increment_only(spark):
    rows = P.prepare_stop_times(load_views(spark, SF_CHECK)["st"])
    t = table(spark, partition_by=["date"])
    summary.update(t, rows, "a")
    plan = summary.partials(rows.where("hour = 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert t.path not in plan and "events" not in t.path


def test_newest_sample_with_missing_departures_and_hot_seconds(spark):
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(str(i), rng.randrange(5), base + dt.timedelta(seconds=rng.randrange(40) * 1800, microseconds=rng.randrange(3) * 7))
            for i in range(300)]
    rows += [(f"h{i}", i % 7, base + dt.timedelta(days=1)) for i in range(120)]       # a third in one second
    rows += [(f"n{i}", i % 3, None) for i in range(25)]
    st = spark.createDataFrame(rows, "rt_trip_id string, gtfs_stop_sequence int, current_stop_departure timestamp_ntz").repartition(5)
    newest = sorted(rows, key=lambda r: (r[2] is None, -(r[2] - base).total_seconds() if r[2] else 0, r[0], r[1]))
    for n in (0, 1, 60, 120, 121, 300, 419, 420, 421, 430, 444, 445, 500):
        got = [tuple(r) for r in S.newest_sample(st, n, ordered=True).collect()]
        assert got == newest[:n], n


def test_second_read_of_the_newest_sample_is_one_scan(spark, tmp_path):
    load_views(spark, SF_CHECK)["st"].select("rt_trip_id", "gtfs_stop_sequence", "current_stop_departure").write.parquet(str(tmp_path / "st"))
    plan = S.newest_sample(spark.read.parquet(str(tmp_path / "st")), 600)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "WindowGroupLimit" in plan
