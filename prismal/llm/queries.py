"""The ``opN_<name>`` queries, their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_langid, bpe, grouped_prefix_join, huffman_store, kn_quality, masked_lm, pii_disclosure, redirect_filter, template_decontam, tier_packing, token_counts
from .redirect_filter import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kn_quality.judge(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.report(spark, table(spark, sf_dir, "documents"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(spark, table(spark, sf_dir, "documents"))


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(table(spark, sf_dir, "documents"), bpe.tokenizer_path())


def op5_huffman_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_store.round_trip(spark, table(spark, sf_dir, "documents"), bpe.tokenizer_path())


def op6_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_prefix_join.components_of(spark, table(spark, sf_dir, "documents"))


def op7_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = template_decontam.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_windows", F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("item_ids"))


def op8_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_langid.identify(spark, table(spark, sf_dir, "documents"))


def op9_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), bpe.tokenizer_path())


URL_RULES = [Rule.of("allow", "org/"), Rule.of("block", "example.org/es/"), Rule.of("block", "example.org/en/1"), Rule.of("allow", "com/fr/"), Rule.of("block", "com/de/")]


def op10_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirect_filter.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kn_quality": op1_kn_quality,
    "op2_pii_disclosure": op2_pii_disclosure,
    "op3_masked_lm": op3_masked_lm,
    "op4_tier_packing": op4_tier_packing,
    "op5_huffman_store": op5_huffman_store,
    "op6_grouped_prefix_join": op6_grouped_prefix_join,
    "op7_template_decontam": op7_template_decontam,
    "op8_backoff_langid": op8_backoff_langid,
    "op9_heap_token_counts": op9_heap_token_counts,
    "op10_redirect_filter": op10_redirect_filter,
}

#: SQL for what SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op10_redirect_filter": redirect_filter.judge_sql(URL_RULES), "op7_template_decontam": template_decontam.contamination_sql()}
