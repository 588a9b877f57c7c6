"""Fields read from a page's text, and the labels derived from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..config import Lexicon
from .text import blank_to_null, col, contains_any, first_group, lowered, mapped, matches_any, squeeze


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match or null."""
    return blank_to_null(F.regexp_extract(c, "(?iU)" + pattern, group))


def text_of(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


# Pages

def page_guard(title, text, status) -> Column:
    """Why a fetched page is of no use, or null."""
    low_title, body = lowered(title), text_of(text)
    head = F.concat(low_title, F.lit("\n"), lowered(body, 1200))
    rules = F.when(col(status).isin(401, 403, 429), F.concat(F.lit("HTTP "), col(status).cast("string")))
    for s in V.SKIP_SIGNALS:
        rules = rules.when(F.contains(head, F.lit(s)), F.lit(f"Skip signal: {s}"))
    for s in V.LOGIN_SIGNALS:
        rules = rules.when(F.contains(low_title, F.lit(s)) & (F.length(body) < 1000), F.lit(f"Login page: {s}"))
    return rules.when(F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) < 200, F.lit("Content too short"))


def is_blocked(text) -> Column:
    return contains_any(lowered(text), V.SKIP_SIGNALS)


def short_listing_is_fine(platform, page_type, html, reason) -> Column:
    """Listings that scripts fill have little text; long html makes up for it."""
    return (col(reason) == "Content too short") & col(platform).isin("jobstreet") & (col(page_type) == "listing") & (F.length(text_of(html)) > 1000)


def is_closed_page(title, text) -> Column:
    return matches_any(F.concat(text_of(title), F.lit("\n"), F.substring(text_of(text), 1, 4000)), V.CLOSED_PAGE)


# Dates, durations, money

def deadline(text) -> Column:
    body = text_of(text)
    near = []
    for w in V.DEADLINE_WORDS:
        at = F.instr(F.lower(body), w)
        near.append(F.when(at > 0, F.concat(F.substring(body, at, F.lit(100)), F.lit(" "))).otherwise(""))
    near = F.concat(*near)
    where = F.when(near != "", near).otherwise(F.substring(body, 1, 3000))
    return F.coalesce(*(_found(where, p) for p in V.DATES))


def deadline_time(value) -> Column:
    """Day-first dates, ISO dates and dates in words, in two languages."""
    c = F.trim(col(value))
    for local, english in V.MONTHS:
        c = F.regexp_replace(c, f"(?i){local}", english)
    c = F.initcap(F.lower(c))
    formats = ("d MMMM yyyy", "yyyy-M-d", "d/M/yyyy", "d-M-yyyy")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def is_expired(value, as_of: datetime | Column) -> Column:
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.coalesce(deadline_time(value) < now, F.lit(False))


def duration(text) -> Column:
    head = F.substring(text_of(text), 1, 5000)
    found = []
    for pattern, most in ((V.MONTH_DURATION, 24), (V.WEEK_DURATION, 52)):
        n = _found(head, pattern, 1).cast("int")
        found.append(F.when((n >= 1) & (n <= most), _found(head, pattern)))
    return F.coalesce(*found)


def salary_hidden(text) -> Column:
    return contains_any(lowered(text, 3000), V.SALARY_HIDDEN)


def salary(text) -> Column:
    head = F.substring(text_of(text), 1, 5000)
    found = (_found(head, p) for p in V.SALARIES)
    return F.when(~salary_hidden(text), F.coalesce(*(F.when((F.length(s) >= 4) & (F.length(s) <= 50), F.trim(s)) for s in found)))


def salary_confidence(text, value) -> Column:
    v = blank_to_null(value)
    return F.when(v.isNull() | salary_hidden(text), 0).when(contains_any(lowered(text, 5000), V.SALARY_WORDS), 80).when(matches_any(v, [V.SALARIES[-1]]), 70).otherwise(50)


def _rupiah(n: Column) -> Column:
    return F.concat(F.lit("Rp"), F.translate(F.format_number(n, 0), ",", "."))


def salary_struct(value, confidence) -> Column:
    """display, low, high."""
    v = blank_to_null(value)
    low = F.regexp_extract(v, r"(?i)(\d+)\s*[-–]\s*(\d+)\s*juta", 1).try_cast("long") * 1_000_000
    high = F.regexp_extract(v, r"(?i)(\d+)\s*[-–]\s*(\d+)\s*juta", 2).try_cast("long") * 1_000_000
    one = F.regexp_extract(v, r"(?i)(\d+)\s*juta", 1).try_cast("long") * 1_000_000
    digits = F.regexp_replace(v, r"\D", "").try_cast("long")
    of = lambda d, a, b: F.struct(d.alias("display"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    none = F.lit(None).cast("long")
    return (
        F.when(v.isNull() | (confidence == 0), of(F.lit(None).cast("string"), none, none))
        .when(matches_any(F.regexp_replace(v, r"\s+", ""), [r"\b(?:paidinternship|unpaidinternship|unpaid)\b"]), of(squeeze(v), none, none))
        .when(low.isNotNull(), of(F.concat(_rupiah(low), F.lit(" - "), _rupiah(high)), low, high))
        .when(one.isNotNull(), of(_rupiah(one), one, one))
        .when(digits.isNotNull(), of(_rupiah(digits), digits, digits))
        .otherwise(of(F.trim(v), none, none))
    )


# Companies and places

def is_valid_company(company) -> Column:
    v = squeeze(text_of(company))
    low = F.lower(v)
    return (
        F.length(v).between(2, 80) & ~low.isin(*V.NO_COMPANY) & ~low.rlike(V.PLACE_COMPANY) & (F.size(F.split(v, " ")) <= 10) & ~F.contains(v, F.lit("|"))
        & ~contains_any(low, V.SENTENCE_COMPANY) & ~v.rlike("[!?;:]")
    )


def company(text, title) -> Column:
    """From the title's patterns, then a line that names it, then the text's patterns; each candidate must be valid."""
    title, head = text_of(title), F.substring(text_of(text), 1, 2000)
    both = F.concat(title, F.lit("\n"), head)
    valid = lambda c: F.when(is_valid_company(c), c)
    from_title = [valid(F.trim(_found(title, p, 1), F.lit(" ,-|\n\t"))) for p in V.TITLE_COMPANY]
    lines = F.transform(F.filter(F.split(both, "\n"), lambda x: x.rlike(r"(?i)^\s*(?:company|perusahaan)\s*:")), lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    named = F.try_element_at(F.filter(lines, is_valid_company), F.lit(1))
    return F.coalesce(*from_title, named, *(valid(F.trim(_found(both, p, 1))) for p in V.TEXT_COMPANY))


def company_confidence(company, title) -> Column:
    return F.when(~is_valid_company(company), 0).when(F.contains(lowered(title), lowered(company)), 90).otherwise(70)


def place(text, lexicon: Lexicon) -> Column:
    """city, area: the first city of the first area; the country's own terms come last."""
    low = lowered(text, 3000)
    of = lambda c, a: F.struct(F.lit(c).alias("city"), F.lit(a).alias("area"))
    found = F.lit(None).cast("struct<city:string,area:string>")
    rules = [(c.title(), a, c.lower()) for a, cs in lexicon.places if a != "indonesia" for c in cs] + [("Indonesia", "indonesia", t.lower()) for a, cs in lexicon.places if a == "indonesia" for t in cs]
    return F.coalesce(*(F.when(F.contains(low, F.lit(t)), of(c, a)) for c, a, t in rules), found) if rules else found


def is_foreign(target_location: str | None, *parts) -> Column:
    """A clearly foreign place where the target names the country."""
    if not target_location or "indonesia" not in target_location.lower():
        return F.lit(False)
    text = F.lower(F.concat_ws(" ", *(text_of(p) for p in parts)))
    return matches_any(text, V.FOREIGN_PLACES) & ~F.contains(text, F.lit("indonesia"))


def work_mode(text, lexicon: Lexicon) -> Column:
    low = lowered(text, 3000)
    return F.when(matches_any(low, V.ONSITE), "onsite").when(matches_any(low, V.REMOTE), "remote").when(F.contains(low, F.lit("hybrid")), "hybrid").otherwise(first_group(low, lexicon.work_modes, None))


# Labels

def extraction_depth(fetch_method, platform) -> Column:
    return F.when(col(fetch_method) == "jobstreet-card-fallback", "listing_card").when(col(platform) == "linkedin", "search_snippet").otherwise("full_detail")


def verification_level(depth) -> Column:
    return mapped(depth, {"full_detail": "verified_detail", "listing_card": "listed_only", "search_snippet": "search_index_only"}, F.lit("unknown"))


def active_status(depth, text) -> Column:
    low = lowered(text, 5000)
    return (
        F.when(matches_any(low, V.CLOSED_STATUS), "closed").when(col(depth) == "listing_card", "listed").when(col(depth) == "search_snippet", "unknown")
        .when(contains_any(low, V.ACTIVE_SIGNALS), "active").otherwise("unknown")
    )


def field_status(value, text, depth, name: str) -> Column:
    rules = F.when(blank_to_null(value).isNotNull(), "provided").when(col(depth).isin("listing_card", "search_snippet"), "unknown_due_to_partial_extraction")
    if name == "deadline":
        rules = rules.when(contains_any(lowered(text, 5000), ("closed", "ditutup", "expired")), "invalid")
    return rules.otherwise("not_provided")


def display(value, depth) -> Column:
    return F.coalesce(blank_to_null(value), F.when(col(depth).isin("listing_card", "search_snippet"), V.NOT_KNOWN).otherwise(V.NOT_LISTED))


def taxonomy(role, title, text, category) -> Column:
    """family, grp, specialization."""
    role, category = blank_to_null(role), blank_to_null(category)
    low = F.lower(F.concat(text_of(title), F.lit("\n"), text_of(role), F.lit("\n"), F.substring(text_of(text), 1, 1200)))
    special = first_group(low, V.SPECIALIZATIONS, "general", patterns=True)
    group = F.when(category == "tech", F.when(special.isin("data", "qa"), special).otherwise("software_engineering")).otherwise(category)
    of = F.struct(F.coalesce(category, F.lit("general")).alias("family"), group.alias("grp"), special.alias("specialization"))
    return F.when(role.isNotNull() | category.isNotNull(), of)


def is_mixed_employment(title, text) -> Column:
    low = F.lower(F.concat(text_of(title), F.lit("\n"), F.substring(text_of(text), 1, 800)))
    return contains_any(low, ("intern", "internship", "magang")) & matches_any(low, V.MIXED_EMPLOYMENT)


def platform_label(platform) -> Column:
    p = blank_to_null(platform)
    return mapped(p, V.PLATFORM_LABELS, F.initcap(p))


def quality_tier(depth, company_conf, role_conf, summary, url) -> Column:
    core = blank_to_null(url).isNotNull() & (company_conf >= 60) & (role_conf >= 60)
    long = F.length(text_of(summary)) >= 80
    return F.when((col(depth) == "full_detail") & core & long, "high").when((col(depth) == "listing_card") & core, "medium").when((col(depth) == "search_snippet") & core & long, "medium").otherwise("low")


def outcome(true, predicted) -> Column:
    return F.when(col(true) & col(predicted), "TP").when(col(predicted), "FP").when(col(true), "FN").otherwise("TN")
