"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage is written as Parquet and read again as the next one's documents. run() does that in the
shared folder of spark.checkpoint.dir and returns the last stage's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate, ngram_join, packing, pii, toxicity
from tarn.llm.queries import PACKING_TOKENIZER, PSEUDONYM_KEY
from tarn.llm.runtime import Scratch, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; fitted on the labelled ones among them."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return ngram_join.keep_one(docs, Scratch(spark, "near-copies"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text replaced by pseudonyms."""
    return pii.pseudonymize(docs, PSEUDONYM_KEY, kinds=None).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 tokens."""
    return packing.pack_documents(docs, Scratch(spark, "packing"), PACKING_TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_near_copies),
    ("benchmark leaks", drop_benchmark_leaks),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Fitted models and tokenizers are beyond SQL; tests/test_pipeline.py holds run() and the stages against brute force on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
