"""A training-data pipeline over ``documents``: five operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import saved
from quantloom.llm.decontaminate import drop_leaks
from quantloom.llm.mixing import mixed_documents
from quantloom.llm.near_dedup import drop_near_duplicates
from quantloom.llm.quality_mil import keep_quality
from quantloom.llm.queries import table, tokenizer_path
from quantloom.llm.token_output import token_output

#: Stages use five-word shingles and this similarity in percent.
SIMILARITY = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers share their executor with those of the other stages: less cache and smaller batches, same result
    return token_output(docs, tokenizer_path(), cache_words=60_000, encode_bytes=1 << 19, batch_rows=1000)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", output_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
