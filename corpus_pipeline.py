"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a table;
all but the last return the columns of ``documents``. ``run`` writes each stage's rows to the shared
folder as Parquet and reads them again as the next one's ``docs``; the tables that a stage has made on
the way are deleted when its rows are written.

Defined cases, the operators' own (each module states them): a null or empty text goes in the first stage, as it has no
language; a null doc_id passes near-duplicates, a null source is mixed as one source, a null language is one
stratum; repeated rows are judged alike, those of one doc_id are one document in the near-duplicates stage, and copies
that the mix asks for are rows of their own; an empty table passes every stage as one. Texts of any length are taken
whole. Extra columns, whatever their names, stay as they are up to the last stage, which returns its own columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from outlyr.llm import bpe, language_id, mixing, near_dup, quality
from outlyr.llm.common import scratch, shared_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return language_id.accepted(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.survivors(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the ids of every document (copies are rows of their own), proved by decoding."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Language models and encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/outlyr/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
