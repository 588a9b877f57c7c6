"""From pages to accepted rows and rejections, in one pass of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Lexicon
from ..functions import classify, fields, urls
from ..functions.text import blank_to_null, plain_lower, short_summary, summary

REJECTED = ("url", "title", "source_platform", "page_type", "rejection_reason", "internship_confidence", "role_confidence", "score", "text_snippet")


def with_defaults(pages: DataFrame) -> DataFrame:
    """Pages as they were stored: missing texts empty, status 200, fetched from the cache."""
    of = lambda c, v: F.coalesce(F.col(c), v) if c in pages.columns else v
    return pages.select(
        "url", of("title", F.lit("")).alias("title"), of("text_content", F.lit("")).alias("text_content"), of("html_content", F.lit("")).alias("html_content"), of("status_code", F.lit(200)).alias("status_code"),
        of("page_type", F.lit("unknown")).alias("page_type"), of("source_platform", urls.platform("url")).alias("source_platform"), of("fetch_method", F.lit("cached")).alias("fetch_method"),
        *([F.col("ord")] if "ord" in pages.columns else []),
    )


def extract(pages: DataFrame, lexicon: Lexicon, target: str | None = None, target_location: str | None = None) -> DataFrame:
    """Each page with its fields and its ``rejection_reason``, which is null where it is accepted.

    The gates, in order: listings, not an internship, a role that only looks like one, listing titles, foreign places, and
    for a target its titles and its roles.
    """
    wanted = classify.target_name(target)
    p = with_defaults(pages)
    title, text = F.col("title"), F.col("text_content")
    both = F.concat(title, F.lit("\n"), text)
    p = p.withColumn("_type", F.when(F.col("page_type") == "unknown", urls.page_type("url", "title")).otherwise(F.col("page_type")))
    plain = F.col("_plain_title")
    p = p.withColumn("_plain_title", plain_lower(title)).withColumn("_intern", classify.internship(text, title, lexicon, plain)).withColumn("_role", classify.role(title, text, lexicon, plain)).withColumn("_suspicious", classify.suspicious_role(title, lexicon))
    conf = F.when(F.col("_suspicious").isNotNull(), F.greatest(F.col("_role.confidence") - 50, F.lit(0))).otherwise(F.col("_role.confidence"))
    p = p.withColumn("role_confidence", conf).withColumn("role", F.when(F.col("_suspicious").isNull() | (conf >= 60), F.col("_role.name")))
    p = p.withColumn("category", F.when(F.col("role_confidence") >= 60, classify.category("role")))
    p = p.withColumn("_place", fields.place(both, lexicon)).withColumn("extraction_depth", fields.extraction_depth("fetch_method", "source_platform"))
    p = p.withColumns({"salary_raw": fields.salary(both), "deadline": fields.deadline(both), "duration": fields.duration(both), "company": fields.company(text, title), "summary": summary(text), "source_url": urls.canonical("url")})
    p = p.withColumn("salary_confidence", fields.salary_confidence(both, "salary_raw")).withColumn("company_confidence", fields.company_confidence("company", "title"))
    p = p.withColumn("_pay", fields.salary_struct("salary_raw", F.col("salary_confidence"))).withColumn("_kind", fields.taxonomy("role", title, text, "category"))
    shown = F.substring(F.coalesce(blank_to_null(title), F.lit("Untitled")), 1, 200)
    place, pay = F.col("_place.city"), F.col("_pay.display")
    rejected = (
        F.when(F.col("_type") == "listing", "listing_page")
        .when(urls.is_listing_title(title, plain=plain), "listing_title")
        .when(~F.col("_intern.ok"), F.concat(F.lit("not_internship:"), F.col("_intern.source")))
        .when(F.col("_suspicious").isNotNull() & F.col("role").isNull(), F.concat(F.lit("suspicious_role:"), F.col("_suspicious")))
        .when(urls.is_listing_title(shown), "listing_or_category_title")
        .when(fields.is_foreign(target_location, title, "company", "source_url", "source_url"), F.lit(f"out_of_location:{target_location}"))
    )
    if wanted:
        rejected = rejected.when(~classify.is_target_intern_title(shown), "not_internship:target_title_missing_internship").when(~classify.matches_target("role", "category", wanted), f"out_of_scope_target:{wanted}")
    status = lambda v, n: fields.field_status(v, both, "extraction_depth", n)
    confidence = F.when(F.col("role_confidence") >= 60, F.least(F.col("_intern.confidence") + 10, F.lit(100))).otherwise(F.col("_intern.confidence"))
    columns: dict[str, Column] = {
        "url": F.col("url"), "title": shown, "company": F.col("company"), "company_confidence": F.col("company_confidence"), "role": F.col("role"), "category": F.col("category"), "location": place,
        "location_area": F.col("_place.area"), "work_mode": fields.work_mode(both, lexicon), "duration": F.col("duration"), "salary": pay, "salary_raw": F.col("salary_raw"), "salary_display": pay,
        "salary_min": F.col("_pay.low"), "salary_max": F.col("_pay.high"), "salary_confidence": F.col("salary_confidence"), "salary_status": status(pay, "salary"), "location_status": status(place, "location"),
        "duration_status": status("duration", "duration"), "deadline_status": status("deadline", "deadline"), "location_confidence": F.when(place.isNotNull(), 80).otherwise(0), "deadline": F.col("deadline"),
        "source_url": F.col("source_url"), "detail_url": F.col("source_url"), "original_url": F.when(F.col("url") != F.col("source_url"), F.col("url")), "source_name": urls.domain("source_url"),
        "source_platform": F.col("source_platform"), "raw_text": F.substring(text, 1, 5000), "summary": F.col("summary"), "summary_short": short_summary("summary"),
        "source_platform_label": fields.platform_label("source_platform"), "apply_url": F.col("source_url"), "display_location": fields.display(place, "extraction_depth"), "display_salary": fields.display(pay, "extraction_depth"),
        "extraction_depth": F.col("extraction_depth"), "verification_level": fields.verification_level("extraction_depth"),
        "dashboard_quality": fields.quality_tier("extraction_depth", F.col("company_confidence"), F.col("role_confidence"), "summary", "source_url"), "active_status": fields.active_status("extraction_depth", both),
        "role_family": F.col("_kind.family"), "role_group": F.col("_kind.grp"), "role_specialization": F.col("_kind.specialization"), "mixed_employment_signal": fields.is_mixed_employment(title, text),
        "confidence": confidence, "is_internship": F.col("_intern.ok"), "internship_confidence": F.col("_intern.confidence"), "role_confidence": F.col("role_confidence"),
        "page_type": F.lit("detail"), "extraction_status": F.lit("extracted"), "rejection_reason": rejected, "_page_type": F.col("page_type"), "_page_title": title,
    }
    return p.select(*(c.alias(n) for n, c in columns.items()), *([F.col("ord")] if "ord" in p.columns else []))


def accepted(extracted: DataFrame) -> DataFrame:
    return extracted.filter("rejection_reason IS NULL").drop("rejection_reason", "_page_type", "_page_title")


def rejected(extracted: DataFrame) -> DataFrame:
    """The audit rows of rejected pages."""
    return extracted.filter("rejection_reason IS NOT NULL").select(
        "url", F.col("_page_title").alias("title"), "source_platform", F.col("_page_type").alias("page_type"), "rejection_reason",
        "internship_confidence", "role_confidence", F.lit(0).alias("score"), F.substring("raw_text", 1, 1000).alias("text_snippet"),
    )


def below_minimum(scored: DataFrame, least: int) -> DataFrame:
    """Audit rows of accepted pages of too low a score."""
    return scored.filter(F.col("score") < least).select(
        "url", "title", "source_platform", "page_type", F.lit("score_below_minimum").alias("rejection_reason"), "internship_confidence", "role_confidence", "score", F.substring("raw_text", 1, 1000).alias("text_snippet")
    )


def verified(pages: DataFrame) -> DataFrame:
    """Pages with the reason why a search hit's page is not extracted, null where it is."""
    listing = (F.col("page_type") == "listing") | urls.is_listing("url") | urls.is_listing_title("title") | urls.is_bad("url") | ~urls.is_detail("url")
    return pages.withColumn("rejection_reason", F.when(fields.is_closed_page("title", "text_content"), "closed").when(listing, "listing_or_category_url"))


def card_pages(hits: DataFrame) -> DataFrame:
    """Pages made from listing cards of one platform whose titles name an internship, where the detail could not be fetched."""
    site = F.coalesce(blank_to_null("source_platform"), urls.platform("url"))
    name = F.trim(F.coalesce("title", F.lit("")))
    from ..vocabulary import EARLY_INTERN

    named = hits.filter((site == "jobstreet") & (name != "") & F.lower(name).rlike("|".join(EARLY_INTERN[:5])))
    text = F.concat_ws("\n", name, blank_to_null("snippet"), F.lit("Source: Jobstreet listing card"), F.lit("Status: active or listed in current search results"))
    return named.select("url", name.alias("title"), text.alias("text_content"), F.lit("").alias("html_content"), F.lit(200).alias("status_code"), F.lit("detail").alias("page_type"), F.lit("jobstreet").alias("source_platform"), F.lit("jobstreet-card-fallback").alias("fetch_method"))
