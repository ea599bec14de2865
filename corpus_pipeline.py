"""The corpus pipeline: documents lose toxic texts, near copies and benchmark leaks, personal data get surrogates, and
what is left is mixed to target weights. Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the
columns of documents. The last returns doc_id, size, source_size, target and taken, the words the mix takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import decontaminate, mixing, near, pii, toxicity
from readloom.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.without_copies(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.without_pii(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", replace_private),
    ("mixing", mix_sources),
]

#: Compression distances and MinHash links are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
