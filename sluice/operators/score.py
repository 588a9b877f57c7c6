"""Additive scores with their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..config import Lexicon, Scoring
from ..functions import classify, fields, urls
from ..functions.text import added, blank_to_null, col, contains_any, lowered

PARTS = ("internship", "role_match", "source_quality", "metadata_completeness", "active_status", "field_confidence", "penalty")


def points(*rules: tuple[Column, int | Column]) -> Column:
    """The sum of the points of the rules that hold."""
    return added([F.when(condition, n).otherwise(0) for condition, n in rules])


def first_points(text: Column, rules: list[tuple[str, int]]) -> Column:
    """The points of the first term that the text holds."""
    found = [F.when(F.contains(text, F.lit(t)), F.lit(n)) for t, n in rules]
    return F.coalesce(*found, F.lit(0)) if found else F.lit(0)


def clamp(total: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def with_total(df: DataFrame, parts: dict[str, Column], score: str = "score", breakdown: str = "score_breakdown") -> DataFrame:
    """The clamped sum of the parts, and the parts with it as a struct."""
    each = [c.cast("int").alias(f"{n}_score") for n, c in parts.items()]
    df = df.withColumn("_parts", F.struct(*each))
    total = sum((F.col(f"_parts.{n}_score") for n in parts), F.lit(0))
    return df.withColumn(score, clamp(total).cast("int")).withColumn(breakdown, F.struct("_parts.*", F.col(score).alias("final_score"))).drop("_parts")


def score_pages(df: DataFrame, lexicon: Lexicon, as_of, scoring: Scoring | None = None) -> DataFrame:
    """score and score_breakdown of extracted pages. as_of: the time by which deadlines are judged."""
    s, p = (scoring or Scoring()).score, (scoring or Scoring()).penalty
    text = F.concat(lowered("title"), F.lit(" "), lowered("raw_text"))
    apply = contains_any(text, V.APPLY_SIGNALS)
    listed = F.coalesce(F.col("active_status") == "listed", F.lit(False))
    active = F.coalesce(F.col("active_status") == "active", F.lit(False))
    pay = F.coalesce(blank_to_null("salary_display"), blank_to_null("salary"))
    cost = [(t, p["bootcamp"] if "bootcamp" in t else p["course"] if "course" in t or "kelas" in t else 0) for t in lexicon.hard_reject]
    parts = {
        "internship": points((contains_any(text, (*lexicon.strong, *lexicon.weak)), s["internship_detected"])),
        "role_match": points((blank_to_null("role").isNotNull(), s["role_detected"])),
        "source_quality": points((contains_any(lowered("source_url"), V.OFFICIAL_SOURCES), s["official_career_source"])),
        "metadata_completeness": points((blank_to_null("location").isNotNull(), s["location_detected"])),
        "active_status": points((apply, s["apply_signal"]), (listed, 5), (active & ~apply, 8), (blank_to_null("deadline").isNotNull(), s["deadline_detected"])),
        "field_confidence": points((F.coalesce(F.col("work_mode") == "remote", F.lit(False)), s["remote_bonus"]), (pay.isNotNull() & ~F.contains(F.lower(pay), F.lit("unpaid")), s["paid_signal"]), (F.col("extraction_depth") == "full_detail", 5)),
        "penalty": first_points(text, cost) + points((F.col("extraction_depth") == "search_snippet", -10), (fields.is_expired("deadline", as_of), p["expired"]), (F.coalesce(F.col("mixed_employment_signal"), F.lit(False)), -5)),
    }
    return with_total(df, parts)


TARGET_SIGNALS = {
    "tech": ("frontend", "front-end", "backend", "back-end", "fullstack", "software engineer", "software developer", "web developer", "mobile developer"),
    "actuarial": ("actuarial", "actuary", "aktuaria", "valuation", "reserving", "reinsurance"),
}


def url_score(url, title, snippet, page_type, platform, target: str | None = None) -> Column:
    """What a search hit promises before its page is fetched; -100 for urls that are no pages."""
    wanted = classify.target_name(target)
    site = F.coalesce(blank_to_null(platform), urls.platform(url))
    text = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(snippet), F.lit("None")), F.coalesce(col(url), F.lit(""))))
    quality = F.create_map(*(F.lit(x) for kv in V.SOURCE_QUALITY.items() for x in kv))
    total = F.coalesce(quality[site], F.lit(4)) + points(
        (urls.is_detail(url), 40),
        (F.coalesce(col(page_type) == "detail", F.lit(False)), 10),
        (contains_any(text, ("intern", "internship", "magang", "trainee", "apprentice")), 25),
        (F.contains(text, F.lit(wanted)) if wanted else F.lit(False), 20),
        (contains_any(text, TARGET_SIGNALS.get(wanted or "", ())), 25),
        (contains_any(text, ("closed", "ditutup", "expired")), -60),
        (urls.is_listing(url), -20),
    )
    return F.when(urls.is_bad(url), -100).otherwise(total).cast("int")


def link_score(df: DataFrame, lexicon: Lexicon, target: str | None) -> Column:
    """How well a link's title and url fit the target: 100 for each title term, 15 for each skill, 25 for the target's name."""
    wanted = classify.target_name(target)
    text = F.lower(F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), F.coalesce(F.col("url"), F.lit(""))))
    if not wanted:
        return F.lit(0)
    chosen = [r for r in lexicon.roles if r.key == wanted or wanted in V.TOP_CATEGORIES and V.ROLE_CATEGORIES.get(r.name) == wanted]
    rules = [(F.contains(text, F.lit(t)), n) for r in chosen for ts, n in ((r.strong, 100), (r.skills, 15)) for t in ts if t]
    return points(*rules, (F.contains(text, F.lit(wanted)), 25)).cast("int")


def tiers(df: DataFrame, score: str = "score") -> DataFrame:
    """high, mid, low: rows of 75 points or more, of 40 or more, of less."""
    c = F.col(score)
    return df.agg(F.count_if(c >= 75).alias("high"), F.count_if((c >= 40) & (c < 75)).alias("mid"), F.count_if(c < 40).alias("low"))
