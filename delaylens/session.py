"""Session construction and shared scratch locations."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (all time bucketing is done in
# UTC), adaptive execution for runtime re-planning (partition coalescing,
# broadcast conversion from measured sizes, skew-join splitting).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # id lists reach the Parquet reader whole (beyond this length only as a range)
    "spark.sql.parquet.pushdown.inFilterThreshold": "100",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "delaylens",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    On a cluster leave ``master`` unset and let spark-submit decide; the
    shuffle partition count should then be sized to the data (roughly
    input bytes / 128 MB), which is why it is a parameter here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cluster_conf(input_bytes: int, partition_bytes: int = 256 << 20,
                 max_shuffle_partitions: int = 50_000) -> dict:
    """Settings sized to the input so tasks fit executor memory.

    Shuffle partitions start at roughly input / partition size (AQE then
    coalesces small ones and splits skewed join partitions above four times
    the advisory size); file splits and the advisory size use the same
    target; broadcasts stay below 64 MB.
    """
    parts = int(min(max_shuffle_partitions, max(200, input_bytes // partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def _checkpoint_base(spark: SparkSession) -> str | None:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    try:  # classic sessions only; Spark Connect has no SparkContext
        return spark.sparkContext.getCheckpointDir()
    except Exception:
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    The base is read from ``spark.checkpoint.dir`` with its URI scheme. Where
    the session has none, a temporary folder is made and registered, but only
    in local mode (tests, bench), where driver and executors are one process;
    on a cluster a missing setting is an error.
    """
    base = _checkpoint_base(spark)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it must name a folder "
                             "that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="delaylens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df, name: str):
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it
    back: later reads are columnar, prune columns and carry sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df, key: str, name: str):
    """Write ``df`` once as Parquet in buckets of ``key`` to the shared checkpoint
    folder and read it back: groupings and joins on ``key`` need no exchange.

    The catalog knows the table only while this call reads it.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name))
     .saveAsTable(table))
    out = spark.table(table)  # resolved here; the files outlive the name
    spark.sql(f"DROP TABLE {table}")
    return out


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    spark = df.sparkSession
    if not _checkpoint_base(spark):
        scratch_path(spark, "init")
    return df.checkpoint(eager=True)


__all__ = ["build_session", "scratch_path", "materialise", "bucketed", "cut_lineage", "cluster_conf", "DEFAULT_CONF"]
