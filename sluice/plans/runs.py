"""Whole runs: hits and pages in, accepted rows and audit rows out. Pages are fetched elsewhere and come as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..config import Lexicon, Scoring
from ..functions import classify, html, urls
from ..functions.text import label
from ..operators import dedupe, extract, lookup, metrics, rank, score
from ..sources.tables import normalized_role


@dataclass(frozen=True)
class Settings:
    lexicon: Lexicon
    as_of: object
    scoring: Scoring = Scoring()
    target: str | None = None
    location: str | None = None
    min_score: int = 40


def accept(pages: DataFrame, s: Settings, audit_scores: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, scored and without duplicates, and the rejections. What is extracted is written once, since it is read several times."""
    spark = pages.sparkSession
    extracted = dedupe.kept_table(spark, extract.extract(pages, s.lexicon, s.target, s.location))
    scored = dedupe.kept_table(spark, score.score_pages(extract.accepted(extracted), s.lexicon, s.as_of, s.scoring))
    rejected = extract.rejected(extracted)
    if audit_scores:
        rejected = rejected.unionByName(extract.below_minimum(scored, s.min_score))
    good = scored.filter(F.col("score") >= s.min_score)
    if "ord" not in good.columns:
        good = good.withColumn("ord", F.xxhash64("url"))
    good = dedupe.kept_table(spark, dedupe.exact(good))
    pairs = dedupe.similar_pairs(good, "canonical_key", "title", "role", "location")
    return dedupe.greedy(good, pairs, "canonical_key", [(-F.col("score")).alias("s"), F.col("ord"), F.col("canonical_key").alias("c")]), rejected


def crawl(listings: DataFrame, details: DataFrame, s: Settings, per_source: int, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings to links: by target, capped per platform, senior titles out, capped in all; then their details are accepted."""
    links = html.detail_links(listings)
    links = dedupe.kept_table(listings.sparkSession, links.withColumn("target_score", score.link_score(links, s.lexicon, s.target)))
    order = [F.desc("target_score"), F.asc("listing_url"), F.asc("ord")]
    kept = rank.cap(links, "source_platform", order, per_source).filter(classify.passes_early("title")).orderBy(*order).limit(total)
    pages = details.join(kept.select("url").distinct(), "url", "left_semi")
    good, bad = accept(pages, s)
    return lookup.attribute(good, kept), bad, links


def research(hits: DataFrame, pages: DataFrame, s: Settings, most: int, listing_pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits are ranked under the platforms' caps; their pages, and those that their listings lead to, are verified and accepted.
    Gives accepted rows, rejections and the ranked hits."""
    scored = hits.withColumn("source_platform", F.coalesce("source_platform", urls.platform("url"))).withColumn("url_score", score.url_score("url", "title", "snippet", "page_type", "source_platform", s.target))
    ranked = rank.diversified(dedupe.kept_table(hits.sparkSession, scored), "source_platform", "url_score", "ord", most, V.PLATFORM_CAPS)
    fetched = pages.join(ranked.select("url"), "url", "left_semi")
    checked = extract.verified(fetched)
    listings = checked.filter("rejection_reason = 'listing_or_category_url'").select("url", F.col("html_content").alias("html"))
    links = dedupe.kept_table(hits.sparkSession, dedupe.richest_links(html.detail_links(listings)))
    follow = links.select("url", "title", F.lit("").alias("snippet"), F.lit("detail").alias("page_type"), "source_platform", "ord", "company")
    follow = follow.withColumn("url_score", score.url_score("url", "title", "snippet", "page_type", "source_platform", s.target))
    chosen = rank.round_robin(follow, "source_platform", "url_score", "ord", rank.budget(most, fetched.count()))
    more = extract.verified(pages.join(chosen.select("url"), "url", "left_semi"))
    cards = extract.card_pages(lookup.new_rows(chosen, pages))
    good = checked.filter("rejection_reason IS NULL").drop("rejection_reason").unionByName(more.filter("rejection_reason IS NULL").drop("rejection_reason"), allowMissingColumns=True).unionByName(cards, allowMissingColumns=True)
    rows, bad = accept(good, s, audit_scores=False)
    rows = lookup.with_hit(rows, hits.unionByName(chosen, allowMissingColumns=True))
    audit = checked.unionByName(more).filter("rejection_reason IS NOT NULL")
    audit = audit.select("url", "title", F.coalesce("source_platform", urls.platform("url")).alias("source_platform"), "page_type", "rejection_reason", F.lit(0).alias("internship_confidence"), F.lit(0).alias("role_confidence"), F.lit(0).alias("score"), F.substring("text_content", 1, 1000).alias("text_snippet"))
    return rows, audit.unionByName(bad), ranked


def candidates(links: DataFrame, accepted: DataFrame, rejected: DataFrame, target: str | None = None) -> DataFrame:
    """The audit rows of discovered links: accepted, rejected with the reason, or only discovered."""
    good = accepted.select(urls.canonical("url").alias("_u")).distinct().withColumn("_good", F.lit(True))
    bad = rejected.groupBy(urls.canonical("url").alias("_b")).agg(F.min("rejection_reason").alias("rejection_reason"))
    rows = links.withColumn("_c", urls.canonical("url")).join(good, F.col("_c") == F.col("_u"), "left").join(bad, F.col("_c") == F.col("_b"), "left")
    status = F.when(F.col("_good"), "accepted").when(F.col("rejection_reason").isNotNull(), "rejected").otherwise("discovered")
    score_ = F.col("target_score").cast("int") if "target_score" in links.columns else F.lit(0)
    return rows.select("url", "listing_url", "title", "company", "source_platform", "discovery_method", score_.alias("target_score"), F.lit(target or "").alias("target_category"), status.alias("status"), F.when(~F.coalesce("_good", F.lit(False)), F.col("rejection_reason")).alias("rejection_reason"))


def evaluate(labels: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Predictions for labelled rows, and their confusion matrix. A row's own target comes before the run's."""
    own = F.coalesce("target_category", F.lit(s.target)) if "target_category" in labels.columns else F.lit(s.target).cast("string")
    numbered = labels.withColumn("_row", F.monotonically_increasing_id()).withColumn("_target", classify.target(own))
    labels = dedupe.kept_table(labels.sparkSession, numbered)  # so that the numbers stay
    text = F.concat_ws("\n", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "company", "description", "raw_text", "true_location") if c in labels.columns))
    pages = labels.withColumn("text_content", text).withColumn("page_type", F.lit("detail")).withColumn("ord", F.col("_row"))
    found = dedupe.kept_table(pages.sparkSession, extract.extract(pages, s.lexicon, None, s.location)).withColumnRenamed("ord", "_row")
    both = found.join(labels.select("_row", "_target", *(c for c in labels.columns if c.startswith("true_"))), "_row")
    off_title = F.col("_target").isNotNull() & ~classify.is_target_intern_title("title")
    off_target = F.col("_target").isNotNull() & ~F.coalesce(F.when(F.col("_target").isin(*V.TOP_CATEGORIES), F.col("category") == F.col("_target")).otherwise(classify.role_key("role") == F.col("_target")), F.lit(False))
    reason = F.coalesce("rejection_reason", F.when(off_title, "not_internship:target_title_missing_internship").when(off_target, F.concat(F.lit("out_of_scope_target:"), F.col("_target"))))
    both = score.score_pages(both.withColumn("rejection_reason", reason), s.lexicon, s.as_of, s.scoring)
    saved = F.col("rejection_reason").isNull() & (F.col("score") >= s.min_score)
    rows = both.withColumn("pred_should_save", saved).withColumn("pred_is_internship", F.col("is_internship")).withColumn("pred_role", F.when(F.col("rejection_reason").isNull(), normalized_role(F.col("role")))).withColumn("pred_category", F.when(F.col("rejection_reason").isNull(), label("category")))
    return rows, metrics.confusion(rows, "true_should_save", "pred_should_save", "true_role", "pred_role", "true_is_internship", "pred_is_internship")


def run_metadata(hits: DataFrame, ranked: DataFrame, pages: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of a run's counters by platform."""
    one = hits.agg(F.count("*").alias("searched_urls"), F.sort_array(F.collect_set(F.coalesce("source_platform", F.lit("unknown")))).alias("platforms_with_hits"))
    for df, name in ((hits, "raw_results"), (ranked, "selected_urls"), (pages, "fetched_pages"), (accepted, "accepted"), (rejected, "rejected")):
        one = one.crossJoin(metrics.counts_map(df, "source_platform", f"{name}_by_platform"))  # single rows
    reasons = metrics.nested_counts(rejected, "source_platform", "rejection_reason").groupBy("source_platform").agg(F.map_from_entries(F.collect_list(F.struct("rejection_reason", "n"))).alias("r"))
    return one.crossJoin(reasons.agg(F.map_from_entries(F.collect_list(F.struct("source_platform", "r"))).alias("rejection_reasons_by_platform")))
