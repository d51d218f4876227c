"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes all that the one before kept, as Parquet, and all but the last
return the columns of ``documents``.  In every stage very long texts are taken whole,
other columns are carried along, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismal.llm import bpe, grouped_prefix_join, kn_quality, pii_disclosure, template_decontam, tier_packing
from prismal.llm.shared import ensure_importable, remove_scratch, scratch_path, written

#: Pieces that a packing worker remembers (some 30 MB): it shares its memory with what
#: the stages before it have left in the executor.
MEMO = 100_000
#: Texts that are handed to a worker at once.
BATCH_ROWS = 1000


def _prepare(spark: SparkSession) -> None:
    ensure_importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null, empty and short texts among them; repeated rows share a verdict."""
    _prepare(spark)
    return kn_quality.keep(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the least doc_id; rows without an id or a word stay, repeated rows become one."""
    _prepare(spark)
    return grouped_prefix_join.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, perhaps with other numbers or names, go; null and empty texts stay, repeated rows go together."""
    _prepare(spark)
    return template_decontam.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the text; null and empty texts stay as they are, repeated rows change alike."""
    _prepare(spark)
    return pii_disclosure.sanitise(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its sequence; a null or empty text is its end alone, repeated rows are packed each."""
    _prepare(spark)
    return tier_packing.pack(docs, bpe.tokenizer_path(), memo=MEMO)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can express neither the perplexity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next; a stage's scratch tables go with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = written()
        out, path = stage(spark, docs, sf_dir), scratch_path(spark, name)
        out.write.parquet(path)
        remove_scratch(spark, since)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
