"""The registered queries of the training-data operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, lm_scoring, ngram_join, packing, pii, quality, secret_scan, suffix_dedup, toxicity
from .runtime import Scratch, read_table

#: Paths of the public vocabularies; parameters of the operators.
PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCORING_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

#: For the registered queries, whose results must be the same each time; a run on real data passes its own secret.
PSEUDONYM_KEY = "a key for synthetic tables only"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(read_table(spark, sf_dir, "conversations"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "op4"), SCORING_VOCABULARY)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), Scratch(spark, "op5"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "op7"), PACKING_TOKENIZER)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_join, op3_chat_format, op4_lm_scoring, op5_quality_rules, op6_toxicity, op7_packing, op8_decontamination, op9_secret_scan, op10_pii)}


#: Lengths follow from the template: "### ", the shown role, ": ", the text with three characters doubled, "</turn>" and a newline.
OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
    ELSE 1 + 2 * length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) END
    + 14 + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS chars
  FROM turns
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL}
