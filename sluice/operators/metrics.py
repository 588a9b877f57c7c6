"""Counters, distributions, gates and the confusion matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..config import Lexicon
from ..functions import classify, fields, urls
from ..functions.text import blank_to_null, contains_any, lowered, matches_any, safe_ratio


def counts(df: DataFrame, group: str, missing: str = "unknown", where: Column | None = None) -> DataFrame:
    """group, n; missing groups by name."""
    return (df if where is None else df.filter(where)).groupBy(F.coalesce(blank_to_null(F.col(group).cast("string")), F.lit(missing)).alias(group)).agg(F.count("*").alias("n"))


def counts_map(df: DataFrame, group: str, name: str, **options) -> DataFrame:
    """One row: a map from group to count."""
    return counts(df, group, **options).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(group, "n")))).alias(name))  # groups are few names


def failures(wanted: DataFrame, got: DataFrame, group: str) -> DataFrame:
    """group, failed: how many more were wanted than were got, where any."""
    have = counts(got, group).withColumnRenamed("n", "_got")
    rows = counts(wanted, group).join(have, group, "left").select(group, (F.col("n") - F.coalesce("_got", F.lit(0))).alias("failed"))
    return rows.filter("failed > 0")


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, inner, n."""
    return df.groupBy(F.coalesce(outer, F.lit("unknown")).alias(outer), F.coalesce(inner, F.lit("unknown")).alias(inner)).agg(F.count("*").alias("n"))


def stage_matrix(df: DataFrame, group: str, stage: str, stages: list[str]) -> DataFrame:
    """A row for each group, a counter column for each stage."""
    rows = df.groupBy(group).pivot(stage, stages).agg(F.count(F.lit(1)))
    return rows.select(group, *(F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("long").alias(s) for s in stages))


def link_diagnostics(links: DataFrame, source: str = "listing_url", method: str = "discovery_method", score: str = "target_score") -> DataFrame:
    is_ = lambda m: F.count_if(F.coalesce(F.col(method) == m, F.lit(False)))
    return links.groupBy(source).agg(F.count("*").alias("links"), is_("dom").alias("dom_links"), is_("script").alias("script_links"), is_("api").alias("api_links"), F.count_if(F.coalesce(F.col(score) > 0, F.lit(False))).alias("target_links"))


def distribution(df: DataFrame, column: str, n: int = 15, missing: str = "unknown") -> DataFrame:
    """The n most frequent values, with their share of all rows in per cent."""
    each = counts(df, column, missing)
    shared = each.withColumn("pct", F.bround(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))
    return shared.orderBy(F.desc("n"), F.asc(column)).limit(n)


def seen_on(df: DataFrame, day: str, seen: str = "first_seen") -> DataFrame:
    return df.agg(F.count_if(F.coalesce(F.to_date(seen) == F.to_date(F.lit(day)), F.lit(False))).alias("new_today"))


def diversity(df: DataFrame, platform: str = "source_platform") -> DataFrame:
    """The flags of the three places that warn of a single source."""
    rows = df.agg(F.count_distinct(F.coalesce(platform, F.lit("unknown"))).alias("platforms"), F.count("*").alias("total"))
    return rows.select("platforms", "total", (F.col("platforms") == 1).alias("single_source"), ((F.col("platforms") <= 1) & (F.col("total") > 1)).alias("dashboard_warning"), ((F.col("platforms") == 1) & (F.col("total") > 1)).alias("gate_warning"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.filter(blank_to_null(F.col(column).cast("string")).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def global_stats(df: DataFrame, score: str, source: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.max(score).alias("max_score"), F.count_distinct(source).alias("sources"))


def confusion(df: DataFrame, true: str, predicted: str, true_role: str | None = None, predicted_role: str | None = None, true_intern: str | None = None, predicted_intern: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall; with roles and internships their accuracies."""
    t, p = F.col(true), F.col(predicted)
    given = [F.count("*").alias("total"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]
    if true_intern:
        given.append(F.count_if(F.col(true_intern) == F.col(predicted_intern)).alias("_intern"))
    if true_role:
        both = t & p & F.col(true_role).isNotNull()
        given += [F.count_if(both).alias("_labelled"), F.count_if(both & (F.col(true_role) == F.col(predicted_role))).alias("_right")]
    rows = df.agg(*given)
    rows = rows.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    if true_intern:
        rows = rows.withColumn("internship_accuracy", safe_ratio(F.col("_intern"), F.col("total"))).drop("_intern")
    if true_role:
        rows = rows.withColumn("role_accuracy", safe_ratio(F.col("_right"), F.col("_labelled"))).drop("_right", "_labelled")
    return rows


@dataclass(frozen=True)
class Rule:
    """An issue where the condition holds; hard ones fail the gate."""

    name: str
    condition: Column
    hard: bool = True
    message: Column | None = None


def issues(df: DataFrame, rules: list[Rule], subject: str) -> DataFrame:
    """rule, hard, subject, message: a row for each rule that a row breaks."""
    found = [F.when(F.coalesce(r.condition, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.hard).alias("hard"), F.coalesce(F.col(subject).cast("string"), F.lit("")).alias("subject"), (r.message if r.message is not None else F.lit(None)).cast("string").alias("message"))) for r in rules]
    return df.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("i.*")


def verdict(found: DataFrame) -> DataFrame:
    rows = found.agg(F.count_if("hard").alias("issues"), F.count_if(~F.col("hard")).alias("warnings"))
    return rows.withColumn("verdict", F.when(F.col("issues") > 0, "FAIL").when(F.col("warnings") > 0, "PASS WITH WARNINGS").otherwise("PASS"))


def result_rules(lexicon: Lexicon, target: str | None = None) -> list[Rule]:
    """The gate over stored results."""
    c = F.col
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("raw_text", F.lit(""))))
    short = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    pay, digits = F.coalesce("salary", F.lit("")), F.regexp_replace(F.coalesce("salary", F.lit("")), r"\D", "")
    missing = sum((blank_to_null(x).isNull().cast("int") for x in ("company", "location", "role", "category")), F.lit(0))
    company = blank_to_null("company")
    raw_pay = F.coalesce(blank_to_null("salary_raw"), pay)
    rules = [
        Rule("LISTING URL", urls.is_listing("source_url") | urls.is_listing("detail_url")),
        Rule("TRACKING URL", urls.has_tracking("source_url") | urls.has_tracking("detail_url")),
        Rule("BAD TITLE", matches_any(lowered("title"), V.BAD_TITLES)),
        Rule("NOT INTERN", ~F.coalesce("is_internship", F.lit(False)) & ~contains_any(F.concat(lowered("title"), F.lit("\n"), lowered("raw_text", 2000)), ("intern", "internship", "magang", "trainee", "apprentice"))),
        Rule("BAD SALARY", (pay != "") & ((F.length(pay) < 4) | pay.rlike("(?i)^[A-Z]+,?$") | (F.length(digits) > 15))),
        Rule("SALARY CONTRADICTION", (pay != "") & contains_any(text, ("perusahaan tidak menampilkan gaji", "salary not displayed")), False),
        Rule("LOW SALARY CONF", (pay != "") & (F.coalesce("salary_confidence", F.lit(0)) < 60), False),
        Rule("SALARY DISPLAY MISSING", raw_pay.rlike(r"\d") & blank_to_null("salary_display").isNull(), False),
        Rule("BAD DURATION", F.regexp_extract(F.coalesce("duration", F.lit("")), r"(\d+)", 1).try_cast("int") > 24),
        Rule("NON-DETAIL", F.coalesce(c("page_type") != "detail", F.lit(True))),
        Rule("CLOSED ACCEPTED", matches_any(text, (r"\bclosed\b", r"\bexpired\b", r"\bno longer accepting\b", r"\blowongan ditutup\b", r"\bditutup\b", r"\bkadaluarsa\b"))),
        Rule("LOW ROLE CONF", blank_to_null("role").isNotNull() & (F.coalesce("role_confidence", F.lit(0)) < 60)),
        Rule("SUS ROLE", classify.suspicious_role("title", lexicon).isNotNull() & c("category").isin("tech", "data", "actuarial")),
        Rule("HARD NEGATIVE", contains_any(short, lexicon.hard_reject)),
        Rule("BAD COMPANY", company.isNotNull() & ~fields.is_valid_company("company")),
        Rule("LOW COMPANY CONF", company.isNull() | (F.coalesce("company_confidence", F.lit(0)) < 60), False),
        Rule("WFH WORK MODE", matches_any(short, V.REMOTE) & F.coalesce(c("work_mode") != "remote", F.lit(True)), False),
        Rule("LOW METADATA", missing >= 2, False),
        Rule("HIGH SCORE LOW METADATA", (F.coalesce("score", F.lit(0)) >= 85) & (missing > 0), False),
    ]
    if wanted := classify.target_name(target):
        none = blank_to_null("role").isNull() | blank_to_null("category").isNull()
        rules += [Rule("TARGET NULL ROLE", none), Rule(f"OUT OF TARGET:{wanted}", ~none & ~classify.matches_target("role", "category", wanted)), Rule("TARGET SENIORITY", ~none & classify.is_senior_title("title"))]
    return rules


def dashboard_rules() -> list[Rule]:
    """The gate over dashboard rows."""
    url = F.coalesce("source_url", F.lit(""))
    domain = lambda c, *ok: ~F.coalesce(F.col(c).isin(*ok), F.lit(False))
    return [
        Rule("MISSING SOURCE URL", url == ""),
        Rule("LISTING URL", (url != "") & urls.is_listing(url)),
        Rule("TRACKING URL", (url != "") & ~urls.is_listing(url) & urls.has_tracking(url)),
        *(Rule(f"MISSING DASHBOARD FIELD:{f}", blank_to_null(F.col(f).cast("string")).isNull()) for f in V.DASHBOARD_REQUIRED),
        Rule("BAD COMPANY", blank_to_null("company").isNotNull() & ~fields.is_valid_company("company")),
        Rule("BAD WORK MODE", blank_to_null("work_mode").isNotNull() & domain("work_mode", "remote", "hybrid", "onsite")),
        Rule("BAD QUALITY", domain("dashboard_quality", "high", "medium", "low")),
        Rule("BAD EXTRACTION DEPTH", domain("extraction_depth", "full_detail", "listing_card", "search_snippet")),
        Rule("BAD ACTIVE STATUS", domain("active_status", "active", "listed", "unknown", "closed")),
        Rule("CLOSED ACCEPTED", F.col("active_status") == "closed"),
    ]


def dashboard_gate(rows: DataFrame, min_results: int = 30, applications: DataFrame | None = None) -> DataFrame:
    """rule, hard, subject, message: issues of rows, duplicate urls, and warnings on the whole."""
    spark = rows.sparkSession
    found = issues(rows, dashboard_rules(), "title")
    repeated = duplicates(rows, "source_url").select(F.lit("DUPLICATE SOURCE URL").alias("rule"), F.lit(True).alias("hard"), F.col("source_url").alias("subject"), F.lit(None).cast("string").alias("message"))
    full = F.col("extraction_depth") == "full_detail"
    whole = rows.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("source_platform", F.lit("unknown"))).alias("p"), F.count_if(F.coalesce(full & (F.col("source_platform") != "glints"), F.lit(False))).alias("other"))
    warn = [Rule("LOW RESULT COUNT", F.col("n") < min_results, False), Rule("LOW SOURCE DIVERSITY", (F.col("p") < 2) & (F.col("n") > 1), False), Rule("NON-GLINTS FULL DETAIL", F.col("other") == 0, False)]
    gate = found.unionByName(repeated).unionByName(issues(whole, warn, "n"))
    if applications is None or not set(V.APPLICATION_COLUMNS) <= set(applications.columns):
        gate = gate.unionByName(spark.createDataFrame([("MISSING SCHEMA", True, "user_applications", None)], gate.schema))
    return gate
