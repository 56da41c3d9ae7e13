"""Lookups by platform read the row groups that hold it, and give the same rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from delaylens.session import scratch_path
from delaylens.sources import files as IO
from delaylens.sources.fixtures import load_views


def rows_read(spark, df):
    """Rows that the scan handed on, i.e. those of the row groups and pages it could not skip."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return n, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())
                      if "Scan" in leaves.apply(i).nodeName())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def history(spark):
    st = load_views(spark, SF_CHECK)["st"]
    # ten copies of four days, so that a day has more than one row group
    many = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("c")).withColumn("rt_trip_id", F.concat("rt_trip_id", F.lit("/"), "c")).drop("c")
    path = scratch_path(spark, "lookup")
    IO.write_history(many.where(F.dayofmonth("current_stop_departure") <= 4), path, mode="overwrite", row_group_bytes=16 << 10)
    return many.where(F.dayofmonth("current_stop_departure") <= 4).cache(), path


@pytest.mark.parametrize("ids", [["U105Z1P"], ["U105Z1P", "U117Z2P"], ["U100Z4P", "absent"], ["absent"], []])
def test_a_lookup_reads_a_fraction(spark, history, ids):
    rows, path = history
    want = rows.where(F.col("gtfs_stop_id").isin(ids)).count()
    n, read = rows_read(spark, IO.scan_history(spark, path, ids))
    assert n == want
    assert read <= 0.35 * rows.count()
    frame = spark.createDataFrame([(i,) for i in ids], "id string")
    n, read = rows_read(spark, IO.scan_history(spark, path, frame))
    assert n == want and read <= 0.35 * rows.count()


def test_many_ids_fall_back_to_a_join(spark, history, monkeypatch):
    rows, path = history
    ids = [r[0] for r in rows.select("gtfs_stop_id").distinct().collect()]
    assert IO.scan_history(spark, path, ids).count() == rows.count()
    frame = spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    monkeypatch.setattr(IO, "PUSHED_IDS", 5)
    out = IO.scan_history(spark, path, frame)
    assert "left_semi" in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")
    assert out.count() == rows.count()
    monkeypatch.setattr(IO, "PUSHED_LISTS", 0)
    assert IO.scan_history(spark, path, ids[:7]).count() == rows.where(F.col("gtfs_stop_id").isin(ids[:7])).count()
