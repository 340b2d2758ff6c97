"""The corpus pipeline: raw documents to packed training sequences.

Each stage works on all rows that the one before it kept and its decisions take effect; all but the last
return the columns of `documents`. Stages are plain functions of the operators, so a driver can write each
result as a table and start the next stage from it.

Defined results follow from the operators: documents with null, empty or very short texts go in the first
stage; repeated rows pass the stages together, until near-duplicate removal keeps the rows with the least id
of a class; empty tables stay empty; further columns are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import line_dedup, mixing, near_dup, packing, quality_rules
from spanwright.llm.common import checkpointed


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mix_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", remove_boilerplate_lines),
    ("near dedup", keep_one_of_near_duplicates),
    ("mixing", mix_to_target_weights),
    ("packing", pack_sequences),
]

#: SQL cannot express near-duplicate removal; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage starts from a checkpoint of the one before it, so that its actions don't compute the earlier stages again, and
    neither does the loss of an executor."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if place else docs, sf_dir)
    return docs
