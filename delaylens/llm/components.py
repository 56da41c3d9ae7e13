"""Connected components of a link table, in Spark (large-star / small-star).

Every round links each node to the smallest node it knows, first among its
larger neighbours, then among its smaller ones, until all links form stars
around smallest nodes. One count by node tells that, so no round is spent on
seeing that nothing changes. The links never leave the cluster; a round is one
partly aggregated minimum and one join each, written to the shared checkpoint
folder so that lost executors do not repeat earlier rounds. Joins on a node that very many others point to are
split by adaptive execution (skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.llm.common import drop_path, materialise


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (a, b), a > b, after one star step; ``larger``: larger neighbours take the node's minimum."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    # dealt anew, so that both sides of the join come from shuffles of their own: only then can adaptive
    # execution split the links of a node that very many others point to
    low = low.repartition(F.xxhash64("a", F.lit(1)))
    # large star: every larger neighbour of a goes to a's minimum; small star: a and its smaller neighbours do
    moved = both.join(low, "a").where(F.col("b") > F.col("a") if larger else F.col("b") != F.col("low"))
    out = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not larger:
        out = out.unionByName(low.select("a", F.col("low").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has larger neighbours only, or a single smaller one: a star step would change nothing."""
    ends = (links.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
            .unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))))
    count = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return not count.where(F.col("smaller") + F.col("larger") > 1).agg(F.count("*")).first()[0]


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b: bigint, any order, repeats allowed)."""
    spark = links.sparkSession
    links = (links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
             .where(F.col("a") != F.col("b")))
    links, path = materialise(links.distinct(), "links")
    while not _settled(links):
        links, new = materialise(_star(_star(links, True), False), "links")
        drop_path(spark, path)
        path = new
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
