"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from outlyr.llm import bpe, chat, filter_audit, fingerprint, language_id, license_scan, mixing, near_dup, oracles, quality, sharding, token_count, token_store, word_runs
from outlyr.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


@_query
def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.limits(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@_query
def op8_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_back(table(spark, sf_dir, "conversations"))


ORACLE |= {"op1_quality_rules": oracles.QUALITY, "op3_near_dup": oracles.NEAR_DUP, "op8_chat_examples": chat.SQL}


@_query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@_query
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.repetitions(table(spark, sf_dir, "documents"))


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE |= {"op11_license_scan": oracles.LICENSE_SCAN, "op12_word_runs": oracles.WORD_RUNS, "op13_filter_audit": oracles.FILTER_AUDIT}
