"""Corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept; all but the last return the columns of ``documents``. Stages
are written as Parquet and read again, so none recomputes another.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm import ngram_join, packing, quality, toxicity
from delaylens.llm.catalog import HELD_OUT
from delaylens.llm.common import fold, materialise, read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != HELD_OUT)
    return toxicity.keep_below(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != HELD_OUT)
    return quality.keep_above(docs, model)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    return ngram_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("ngram_join", ngram_join_stage),
          ("packing", packing_stage)]

#: Two stages are learned models and one packs by arrival: no SQL twin; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
