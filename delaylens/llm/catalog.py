"""Registered queries of the operators, and their SQL twins where SQL can express them.

Every query applies its operator to the whole table with production parameters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm import (chat, embed_dedup, filter_audit, licenses, ngram_join, packing, pieces, quality, toxicity,
                           trie_dedup, urls, vafile, vector_codes)
from delaylens.llm.common import fold, read_table

HELD_OUT = 2  # of four folds


def _scored(spark: SparkSession, sf_dir: str, module) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    params = module.Params()
    model = module.fit(documents, labels, fold(F.col("doc_id")) != HELD_OUT, params=params)
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return module.score(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= params.threshold, 1).otherwise(0).alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(read_table(spark, sf_dir, "documents"))


CONTROL = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], conversations.schema)
    return chat.digests(chat.format_conversations(conversations.unionByName(control)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS goes_on,
         len(text) + len(regexp_replace(text, '[^<\\[\\\\]', '', 'g')) AS chars,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
              ELSE 8 + len(role) + len(regexp_replace(role, '[^<\\[\\\\|]', '', 'g')) END AS marks
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN goes_on THEN 3 ELSE marks END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

QUERIES = {q.__name__: q for q in (op1_toxicity, op2_quality, op3_topk, op4_licenses, op5_embedding_dedup,
                                   op6_url_filter, op7_packing, op8_ngram_join, op9_chat, op10_sentencepiece,
                                   op11_exact_dedup, op12_filter_audit, op13_vector_codes)}
ORACLE = {"op3_topk": vafile.oracle_sql(), "op5_embedding_dedup": embed_dedup.oracle_sql(),
          "op8_ngram_join": ngram_join.oracle_sql(), "op4_licenses": licenses.oracle_sql(), "op9_chat": OP9_SQL,
          "op11_exact_dedup": trie_dedup.oracle_sql(), "op12_filter_audit": filter_audit.oracle_sql(),
          "op13_vector_codes": vector_codes.oracle_sql()}
