"""A training corpus from raw documents in five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docsense.llm import decontaminate, mixing, simhash, toxicity, training_order
from docsense.llm.common import shared_dir, table
from docsense.llm.queries import MIX_TARGET


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity operator rejects."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat the documents of small sources until the mixture meets its target; every document stays."""
    return mixing.mix(docs, MIX_TARGET)


def training_order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in global slots."""
    return training_order.training_order(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("training order", training_order_stage),
]

#: Learned scores, XXH64 fingerprints and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/docsense/stage-{number}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
