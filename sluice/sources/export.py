"""Exports: CSV, JSON, dashboard rows, run metadata and an HTML report."""

from __future__ import annotations

import html as entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import blank_to_null, short_summary
from ..operators import metrics


def shaped(df: DataFrame, columns) -> DataFrame:
    """Just these columns, in this order; those that are missing are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns=V.EXPORT_COLUMNS) -> None:
    """Files with a header each, also where there are no rows. Structs become JSON."""
    rows = shaped(df, columns)
    flat = rows.select(*(F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in rows.dtypes))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, columns=None) -> None:
    """One object a line, nulls kept."""
    (shaped(df, columns) if columns else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def dashboard_rows(df: DataFrame) -> DataFrame:
    """The columns that a dashboard may show, with defaults; no raw texts."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    some = lambda c, v: F.coalesce(blank_to_null(have(c)), F.lit(v))
    partial = lambda c: F.when(have(c) == "unknown_due_to_partial_extraction", V.NOT_KNOWN).otherwise(V.NOT_LISTED)
    given = {
        "id": have("id").cast("string"), "location_status": some("location_status", "not_provided"), "salary_status": some("salary_status", "not_provided"), "duration_status": some("duration_status", "not_provided"),
        "deadline_status": some("deadline_status", "not_provided"), "source_platform_label": F.coalesce(blank_to_null(have("source_platform_label")), F.initcap(F.coalesce(have("source_platform"), F.lit("")))),
        "apply_url": F.coalesce(blank_to_null(have("apply_url")), have("source_url")), "score": F.coalesce(have("score").cast("int"), F.lit(0)), "dashboard_quality": some("dashboard_quality", "medium"),
        "extraction_depth": some("extraction_depth", "full_detail"), "verification_level": some("verification_level", "verified_detail"), "active_status": some("active_status", "unknown"),
        "mixed_employment_signal": F.coalesce(have("mixed_employment_signal").cast("boolean"), F.lit(False)), "display_location": F.coalesce(blank_to_null(have("display_location")), partial("location_status")),
        "display_salary": F.coalesce(blank_to_null(have("display_salary")), partial("salary_status")), "summary_short": short_summary(F.coalesce(blank_to_null(have("summary_short")), have("summary"))), "last_verified_at": have("last_seen"),
    }
    return df.select(*(given.get(c, have(c)).alias(c) for c in V.DASHBOARD_COLUMNS))


def read_model(rows: DataFrame) -> DataFrame:
    """Rows as a list view reads them: a text for each missing name, known values only."""
    some = lambda c, v: F.coalesce(F.col(c).cast("string"), F.lit(v)).alias(c)
    known = lambda c, v, *ok: F.when(F.col(c).isin(*ok), F.col(c)).otherwise(F.lit(v)).alias(c)
    return rows.select(
        some("id", ""), some("title", "Lowongan tanpa judul"), some("company", "Perusahaan belum tersedia"), some("role", "Role belum tersedia"), some("category", "unknown"), "location",
        known("work_mode", None, "remote", "hybrid", "onsite"), some("source_platform", "generic"), F.coalesce("apply_url", "source_url", F.lit("#")).alias("source_url"), F.coalesce(F.col("score"), F.lit(0)).alias("score"),
        known("dashboard_quality", "medium", "high", "low"), known("extraction_depth", "full_detail", "listing_card", "search_snippet"), known("verification_level", "unknown", "verified_detail", "listed_only", "search_index_only"),
        known("active_status", "unknown", "active", "listed", "closed"), some("summary_short", "Ringkasan belum tersedia. Cek detail di platform asli."),
    )


def metadata(rows: DataFrame, as_of) -> DataFrame:
    """One row: counts by platform, quality and depth, and the warnings on diversity."""
    full = F.coalesce(F.col("extraction_depth") == "full_detail", F.lit(False))
    of = lambda c, name, where=None: metrics.counts_map(rows, c, name, where=where)
    maps = [of("source_platform", "accepted_by_platform"), of("dashboard_quality", "accepted_by_dashboard_quality"), of("extraction_depth", "accepted_by_extraction_depth"), of("source_platform", "accepted_full_detail_by_platform", full), of("source_platform", "accepted_partial_by_platform", ~full)]
    one = rows.agg(F.count("*").alias("result_count")).withColumn("generated_at", F.lit(as_of).cast("string"))
    for m in maps:
        one = one.crossJoin(m)  # single rows
    few = lambda c: (F.size(c) <= 1) & (F.col("result_count") > 1)
    return one.withColumn("source_diversity_warning", few("accepted_by_platform")).withColumn("full_detail_source_diversity_warning", few("accepted_full_detail_by_platform"))


def export_dashboard(rows: DataFrame, path: str, as_of) -> None:
    shown = dashboard_rows(rows)
    write_json(shown, f"{path}/opportunities")
    metadata(shown, as_of).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/metadata")


def report(rows: DataFrame, as_of: str, n: int = 20) -> str:
    """An HTML page of totals, distributions and the best rows; only aggregates and n rows come to the driver."""
    total = metrics.global_stats(rows, "score", "source_platform").crossJoin(metrics.seen_on(rows, as_of)).first()
    cell = lambda x: f"<td>{entities.escape(str(x if x is not None else '-'))}</td>"
    line = lambda r: "<tr>" + "".join(map(cell, r)) + "</tr>"
    part = lambda name, found: f"<h2>{name}</h2><table>{''.join(line(r) for r in found)}</table>"
    body = part("Totals", [(k, v) for k, v in total.asDict().items()])
    for c in ("role", "source_platform", "location_area"):
        body += part(c, metrics.distribution(rows, c).collect())
    body += part("Best", rows.orderBy(F.desc("score"), "title").limit(n).select("score", "title", "company", "role", "location", "source_url").collect())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Report {entities.escape(as_of)}</title></head><body>{body}</body></html>'


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
