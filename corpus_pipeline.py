"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

``run`` applies STAGES to ``documents``; each stage's rows are written as Parquet to the folder that driver and executors
share and read again as the next one's input. All stages but the last return the columns of ``documents``; n_chars
follows the text where a stage changes it.

Rows of null or repeated doc_id are documents like any other in every stage. Null texts count as empty: they fail the quality rules' base
limits, hold no benchmark item and no personal data, are copies of each other, and have no tokens. Empty tables give empty tables. Other
columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontam, near_copies, pii, quality
from sluice.llm.common import durable, table
from sluice.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps; the posterior is estimated from all rows of this stage's input."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more): that of the smallest doc_id, nulls last, then of the least hash of its text."""
    return near_copies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by its kind in brackets; null texts stay null."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; other columns are dropped."""
    return bpe.round_trip(docs, BYTE_BPE)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: Expectation-maximisation and BPE merges are not SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
