"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palaver.llm.common import documents, read_table
from palaver.llm.decontaminate import leak_table
from palaver.llm.language_id import identify
from palaver.llm.licence_scan import licence_table
from palaver.llm.lm_score import lm_scores
from palaver.llm.mixing import mixing_table
from palaver.llm.private_spans import private_table
from palaver.llm.quality import quality_table
from palaver.llm.sharding import shard_table
from palaver.llm.simhash_dedup import near_duplicates
from palaver.llm.token_alignment import alignment_table
from palaver.llm.token_counts import token_budget
from palaver.llm.url_filter import Rule, filter_urls
from palaver.llm.word_runs import find_runs, planted, run_table

VOCABULARY = "byte_bpe_50k.json"
OTHER_VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 512

SHARDS = 24
MIX_SEED = 7


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(documents(spark, sf_dir))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return licence_table(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it."""
    return shard_table(documents(spark, sf_dir), SHARDS)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing_table(documents(spark, sf_dir), MIX_SEED)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents."""
    return leak_table(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document."""
    return lm_scores(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality_table(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(documents(spark, sf_dir))


URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, and how much of each text fits the limit."""
    return token_budget(documents(spark, sf_dir), VOCABULARY, TOKEN_LIMIT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens in two vocabularies."""
    return alignment_table(documents(spark, sf_dir), VOCABULARY, OTHER_VOCABULARY)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, one in ten with a repetition planted."""
    return run_table(find_runs(documents(spark, sf_dir), planted))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return private_table(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_licence_scan": op2_licence_scan,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_decontaminate": op5_decontaminate,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_word_runs": op12_word_runs,
    "op13_private_data": op13_private_data,
}
