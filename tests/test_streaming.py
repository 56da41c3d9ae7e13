"""Streaming: shuffled, overlapping and replayed files equal the batch result."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from delaylens.session import scratch_path
from delaylens.sources import fixtures
from delaylens.streaming import streams as STR


def test_multi_batch_dedup_and_replay(spark):
    st = fixtures.load_views(spark, SF_SMALL)["st"]
    day = F.to_date("current_stop_departure")
    src = scratch_path(spark, "t-src")
    days = sorted(r[0] for r in st.select(day).distinct().collect())
    # one file batch per day, each overlapping the previous day, in day order
    for i, d in enumerate(days):
        lo = F.lit(d).cast("date")
        st.where((day == lo) | (day == F.date_sub(lo, 1))).coalesce(1).write.parquet(f"{src}/{i:03d}")
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    STR.incremental_stream(spark, f"{src}/*", st.schema, sink, checkpoint_dir=ckpt, delay="2 days",
                           max_files_per_trigger=1).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == st.count()
    assert out.select(*STR.KEY).distinct().count() == st.count()
    # replay the newest day (inside the watermark: removed by the dedup state)
    # and the oldest day (behind the watermark: dropped as late) - nothing is added
    st.where(day == F.lit(days[-1]).cast("date")).coalesce(1).write.parquet(f"{src}/900")
    st.where(day == F.lit(days[0]).cast("date")).coalesce(1).write.parquet(f"{src}/901")
    STR.incremental_stream(spark, f"{src}/*", st.schema, sink, checkpoint_dir=ckpt, delay="2 days",
                           max_files_per_trigger=1).awaitTermination()
    assert spark.read.parquet(sink).count() == st.count()


def test_day_split_covers_every_row(spark):
    st = fixtures.load_views(spark, SF_SMALL)["st"]
    src = scratch_path(spark, "t-split")
    STR.split_into_day_files(st, src)
    files = spark.read.parquet(src)
    assert files.drop("batch").distinct().count() == st.count()
    assert files.count() > st.count()


def test_hourly_stream_matches_batch_windows(spark):
    st = fixtures.load_views(spark, SF_SMALL)["st"]
    src = scratch_path(spark, "t-src2")
    st.coalesce(2).write.parquet(src)
    sink, sink2 = scratch_path(spark, "t-s1"), scratch_path(spark, "t-s2")
    STR.incremental_stream(spark, src, st.schema, sink).awaitTermination()
    STR.hourly_stats_stream(spark, sink, None, sink2, delay="2 hours").awaitTermination()
    got = spark.read.parquet(sink2)
    cutoff = st.agg(F.max("current_stop_departure")).first()[0]
    batch = (st.groupBy(F.date_trunc("hour", "current_stop_departure").alias("h"), "gtfs_stop_id").count()
             .where(F.col("h") + F.expr("INTERVAL 1 HOUR") <= F.lit(cutoff) - F.expr("INTERVAL 2 HOURS")))
    assert got.count() == batch.count()
    assert got.agg(F.sum("count")).first()[0] == batch.agg(F.sum("count")).first()[0]
