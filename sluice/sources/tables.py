"""Schemas of the stored tables, labelled data and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label, mapped, truth
from ..vocabulary import TARGET_ALIASES

RAW_RESULTS = "query string, title string, snippet string, url string, source string, page_type string, source_platform string, seq long"
RAW_PAGES = "url string, title string, text_content string, html_content string, status_code int, page_type string, source_platform string, seq long"
API_RESPONSES = "listing_url string, response_url string, source_platform string, status_code int, content_type string, body string, seq long"
CANDIDATES = "url string, listing_url string, title string, company string, source_platform string, discovery_method string, target_score int, target_category string, status string, rejection_reason string, seq long"
REJECTED = "url string, title string, source_platform string, page_type string, rejection_reason string, internship_confidence int, role_confidence int, score int, text_snippet string, seq long"
APPLICATIONS = "id long, user_id string, opportunity_id long, status string, notes string, applied_at timestamp, created_at timestamp, updated_at timestamp"
#: Keys by table and how a batch meets them.
KEYS = {"raw_results": (["url"], "ignore"), "raw_pages": (["url"], "ignore"), "candidates": (["url", "listing_url", "target_category"], "replace"), "api_responses": (["listing_url", "response_url"], "replace"), "rejected": (["url", "rejection_reason"], "replace"), "opportunities": (["canonical_key"], "max_score"), "applications": (["user_id", "opportunity_id"], "replace")}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Golden labels from CSV with a header; texts may hold line ends and quotes."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "url", "title", "company", "description", truth("should_save").alias("true_should_save"), truth("true_is_internship").alias("true_is_internship"), normalized_role(col("true_role")).alias("true_role"),
        label(col("true_category")).alias("true_category"), col("true_location").alias("true_location"), col("raw_text").alias("raw_text"), col("target_category").alias("target_category"),
    )


def normalized_role(c):
    """A role's key, whatever spelling it has."""
    l = label(c)  # noqa: E741
    return mapped(l, {k: v for k, v in TARGET_ALIASES.items() if k.endswith(("_developer", "_engineer", "_designer", "_manager", "assurance")) or "/" in k}, l)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the export below a folder that was written last, all its files; none where there is none."""
    try:
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(root).select("*", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("file_path"), "_metadata.file_modification_time")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return spark.createDataFrame([], "id string")
        raise
    newest = rows.agg(F.max_by("file_path", "file_modification_time").alias("p"))
    return rows.join(F.broadcast(newest), rows.file_path == F.col("p")).drop("p", "file_path", "file_modification_time")  # one row


def has_columns(df: DataFrame, names) -> bool:
    return set(names) <= set(df.columns)
