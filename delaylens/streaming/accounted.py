"""ST1 with every row accounted for: sink, counted duplicate, or late table.

``incremental_stream`` lets Spark drop what is older than the watermark, and
such rows vanish unseen. Here each micro-batch is split by rules on the rows
themselves and written as batches of stored tables (``sources.stored``):

* late: departure before the watermark, the newest departure of the batches
  before this one minus ``delay``; goes to the ``late`` table;
* duplicate: same (trip, stop sequence) as a row of the sink or as an earlier row
  of the batch; counted. The sink itself is the memory of what was seen, and as
  no row on time is older than the watermark, only its dates from there on are
  read, so the work of a batch is bounded by ``delay``, not by the history;
* new: goes to the sink.

A fourth table holds one row per batch: rows in, new, duplicate and late, and the
watermark after it. A batch that is interrupted and run again finds what it has
committed and adds nothing twice. Rows without a departure are never late and
meet all sink rows without one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from delaylens.session import materialise, scratch_path
from delaylens.sources.stored import StoredTable
from delaylens.streaming.streams import KEY, read_stop_time_files

TIME = "current_stop_departure"


@dataclass(frozen=True)
class Tables:
    """The tables of one stream, below one folder."""

    sink: StoredTable
    late: StoredTable
    counts: StoredTable

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Tables:
        return cls(StoredTable(spark, f"{path}/sink", ["date"]), StoredTable(spark, f"{path}/late", ["date"]),
                   StoredTable(spark, f"{path}/counts"))


def watermark(tables: Tables):
    """The watermark after the committed batches (None before any)."""
    counts = tables.counts.read()
    return None if counts is None else counts.agg(F.max("watermark")).first()[0]


def take_batch(tables: Tables, rows: DataFrame, batch: str, delay: str) -> None:
    """Split one micro-batch and commit its parts; a batch that is committed whole changes nothing."""
    if tables.counts.batch(batch) is not None:
        return
    time = F.col(TIME)
    mark = watermark(tables)
    rows = materialise(rows.withColumn("date", F.to_date(time)), "stream-batch")
    limit = F.lit(mark).cast("timestamp_ntz")
    is_late = F.coalesce(time.cast("timestamp_ntz") < limit, F.lit(False))
    on_time = rows.where(~is_late)
    others = [c for c in rows.columns if c not in (*KEY, TIME)]
    first = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last(TIME), *others)
    distinct = on_time.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
    # a run that was interrupted has committed its new rows already: they are not "seen" by themselves
    if tables.sink.batch(batch) is None:
        seen = tables.sink.read()
        if seen is not None and mark is not None:
            seen = seen.where((F.col("date") >= limit.cast("date")) | F.col("date").isNull())
        new = distinct
        if seen is not None:
            seen = seen.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
            same = distinct[KEY[0]].eqNullSafe(seen[f"_{KEY[0]}"]) & distinct[KEY[1]].eqNullSafe(seen[f"_{KEY[1]}"])
            new = distinct.join(seen, same, "left_anti")
        tables.sink.append(new, batch)
    tables.late.append(rows.where(is_late), batch)
    taken, late = tables.sink.batch(batch).count(), tables.late.batch(batch).count()
    total = rows.agg(F.count(F.lit(1)).alias("n"),
                     F.max(time.cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()
    marks = [m for m in (mark, total["mark"]) if m is not None]
    spark = rows.sparkSession
    tables.counts.append(spark.createDataFrame(
        [(batch, total["n"], taken, total["n"] - taken - late, late, max(marks, default=None))],
        "batch string, rows_in long, new long, duplicate long, late long, watermark timestamp_ntz"), batch)


def accounted_stream(spark: SparkSession, source_dir: str, schema: StructType, path: str,
                     checkpoint_dir: str | None = None, delay: str = "1 DAY",
                     max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Take the files of ``source_dir`` into the tables below ``path`` (``Tables.at``)."""
    tables = Tables.at(spark, path)
    stream = read_stop_time_files(spark, source_dir, schema, max_files_per_trigger)
    w = (stream.writeStream.option("checkpointLocation", checkpoint_dir or scratch_path(spark, "accounted-checkpoint"))
         .foreachBatch(lambda rows, n: take_batch(tables, rows, str(n), delay)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
