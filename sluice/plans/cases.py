"""Queries over rows made from the driver's tables, a case by key, whose outcome SQL states.

The tables hold no job pages, so each row of a table becomes one: listings of every platform, API bodies, titles, results with one fault
each. The operators are the engine's; the SQL says what must come out for each kind of row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import Lexicon, Role
from ..functions import classify, fields, html, text, urls
from ..operators import dedupe, extract, lookup, metrics, queries, rank, score
from ..sources import export, search, tables
from . import runs
from .catalogue import query, t

AS_OF = datetime(2026, 1, 1)
LEXICON = Lexicon(
    strong=("internship", "magang"), weak=("mahasiswa",), non_internship=("full time",), hard_reject=("bootcamp",), likely_not_job=("artikel",), suspicious_roles=("content creator", "sales"),
    roles=(Role("frontend", ("frontend",), ("react", "css"), ("backend",)), Role("actuarial", ("actuarial", "actuary"), ("pricing",), ())), places=(("jakarta_area", ("jakarta selatan", "jakarta")), ("other", ("bali",)), ("indonesia", ("indonesia",))),
    work_modes=(("remote", ("remote",)),),
)


def key(name: str = "p_partkey"):
    return F.col(name).cast("string")


def parts(spark, d) -> DataFrame:
    """Part, dealt out by number: a task's share of a table goes by its bytes, and a row of few bytes becomes a whole page here."""
    return t(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def by_case(n: int, *values, of="p_partkey"):
    """The value of case number key % n; the last one counts for the cases beyond."""
    k, out = F.col(of) % n, None
    for i, v in enumerate(values):
        v = v if not isinstance(v, str) and v is not None else F.lit(v)
        out = F.when(k == i, v) if out is None else out.when(k == i, v)
    return out


def filled(template: str, of: str = "p_partkey"):
    """A text with the key in place of #."""
    return F.replace(F.lit(template), F.lit("#"), key(of))


# Listings and API bodies

_LISTINGS = (
    ("https://dealls.com/loker?p=#", '<a href="/loker/intern-#~acme">Intern #</a><a href="/loker/industri/x~y">no</a><a href="/about">About</a>'),
    ("https://www.kalibrr.id/job-board?p=#", '<a href="/c/acme/jobs/#/dev"> Dev </a><a href="/c/acme">no</a>'),
    ("https://glints.com/id/opportunities?p=#", '<a href="/id/opportunities/jobs/x/#">X</a><a href="/id/companies/#">no</a><script>var u = "\\/id\\/opportunities\\/jobs\\/s\\/#";</script>'),
    ("https://www.jobstreet.co.id/jobs?p=#", '<article data-job-id="#"><a data-automation="jobTitle" href="/id/job/#?a=1">Intern #</a><span data-automation="jobCompany">Acme</span></article><a href="/id/job/#?a=1">again</a><a href="/id/intern-jobs">no</a>'),
    ("https://www.loker.id/cari?p=#", '<a href="https://www.loker.id/lowongan-kerja/x-#.html">L</a><a href="/tentang">no</a>'),
    ("https://id.prosple.com/all?p=#", '<a href="/graduate-employers/acme/jobs-internships/intern-#">P</a><a href="/search-jobs">no</a>'),
    ("https://id.indeed.com/all?p=#", '<a href="/viewjob?jk=#">I</a><a href="/q-x-lowongan.html">no</a>'),
    ("https://work.example/all?p=#", '<a href="/job/#">J</a><a href="https://other.example/job/#">no</a><a href="/news">no</a>'),
)
#: Case, url, title, company, platform, method.
_LINKS = (
    (0, "https://dealls.com/loker/intern-#~acme", "Intern #", None, "dealls", "dom"), (1, "https://www.kalibrr.id/c/acme/jobs/#/dev", "Dev", None, "kalibrr", "dom"), (2, "https://glints.com/id/opportunities/jobs/x/#", "X", None, "glints", "dom"),
    (2, "https://glints.com/id/opportunities/jobs/s/#", None, None, "glints", "script"), (3, "https://www.jobstreet.co.id/id/job/#?a=1", "Intern #", "Acme", "jobstreet", "card"), (4, "https://www.loker.id/lowongan-kerja/x-#.html", "L", None, "lokerid", "dom"),
    (5, "https://id.prosple.com/graduate-employers/acme/jobs-internships/intern-#", "P", None, "prosple", "dom"), (6, "https://id.indeed.com/viewjob?jk=#", "I", None, "indeed", "dom"), (7, "https://work.example/job/#", "J", None, "generic", "dom"),
)
_BODIES = (
    ("https://www.jobstreet.co.id/api?p=#", '{"data": [{"jobTitle": "Dev Intern", "jobId": #, "companyName": "Acme"}]}'), ("https://glints.com/api?p=#", '{"jobs": [{"slug": "dev-#", "id": "u#", "title": "Dev"}]}'),
    ("https://www.kalibrr.id/api?p=#", '{"id": #, "name": "Dev", "company": "Acme Co"}'), ("https://dealls.com/api?p=#", '{"title": "Dev", "url": "https://dealls.com/loker/dev-#~acme"}'), ("https://dealls.com/api?p=#", '{"broken": '),
    ("https://work.example/api?p=#", '{"a": [{"href": "https://work.example/job/#", "headline": "J", "employer": "E"}, {"href": "https://work.example/loker"}]}'),
)
_FOUND = (
    (0, "https://www.jobstreet.co.id/id/job/dev-intern-#", "Dev Intern", "Acme"), (1, "https://glints.com/id/opportunities/jobs/dev-#/u#", "Dev", None), (2, "https://www.kalibrr.id/id-ID/c/acme-co/jobs/#/dev", "Dev", "Acme Co"),
    (3, "https://dealls.com/loker/dev-#~acme", "Dev", None), (5, "https://work.example/job/#", "J", "E"),
)


def values(rows) -> str:
    """SQL of a list of rows."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


@query(f"SELECT p_partkey, replace(url, '#', CAST(p_partkey AS VARCHAR)) AS url, replace(title, '#', CAST(p_partkey AS VARCHAR)) AS title, company, source_platform, discovery_method FROM part JOIN (VALUES {values(_LINKS)}) v(k, url, title, company, source_platform, discovery_method) ON p_partkey % 8 = k")
def platform_listings(spark, d):
    """Links of the listings of each platform: anchors, cards and scripts, and what is not a detail left out."""
    pages = parts(spark, d).select("p_partkey", by_case(8, *(filled(u) for u, _ in _LISTINGS)).alias("url"), by_case(8, *(filled(h) for _, h in _LISTINGS)).alias("html"))
    return html.detail_links(pages).select(F.regexp_extract("listing_url", r"p=(\d+)", 1).cast("long").alias("p_partkey"), "url", "title", "company", "source_platform", "discovery_method")


@query(f"SELECT p_partkey, replace(url, '#', CAST(p_partkey AS VARCHAR)) AS url, title, company FROM part JOIN (VALUES {values(_FOUND)}) v(k, url, title, company) ON p_partkey % 6 = k")
def api_bodies(spark, d):
    """Links that API bodies name, or that their ids and names make up."""
    bodies = parts(spark, d).select(by_case(6, *(filled(u) for u, _ in _BODIES)).alias("listing_url"), by_case(6, *(filled(b) for _, b in _BODIES)).alias("body"), F.lit(None).cast("string").alias("source_platform"))
    return html.api_links(bodies).select(F.regexp_extract("listing_url", r"p=(\d+)", 1).cast("long").alias("p_partkey"), "url", "title", "company")


@query(f"SELECT p_partkey, replace(url, '#', CAST(p_partkey AS VARCHAR)) AS url, title, company FROM part JOIN (VALUES {values(_FOUND)}) v(k, url, title, company) ON p_partkey % 6 = k")
def api_bodies_in_pages(spark, d):
    """The same bodies found in a page's scripts."""
    pages = parts(spark, d).select(by_case(6, *(filled(u) for u, _ in _BODIES)).alias("url"), F.concat(F.lit("<p>x</p><script data-api-response>"), by_case(6, *(filled(b) for _, b in _BODIES)), F.lit("</script>")).alias("html"))
    return html.detail_links(pages).filter("discovery_method = 'api'").select(F.regexp_extract("listing_url", r"p=(\d+)", 1).cast("long").alias("p_partkey"), "url", "title", "company")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Dev ' || p_partkey || chr(10) || 'Work here' WHEN 1 THEN 'State ' || p_partkey ELSE '' END AS text FROM part")
def structured_texts(spark, d):
    body = by_case(
        3, filled('<script type="application/ld+json">{"title": "Dev #", "description": "<b>Work</b>  here", "n": 5, "x": ["dev #", "ab"]}</script>'), filled('<script id="__NEXT_DATA__">{"a": {"b": ["State #"]}}</script><script>{"c": "not this"}</script>'),
        filled('<script type="application/ld+json">{"title": </script>'),
    )
    return html.structured_text(parts(spark, d).select("p_partkey", body.alias("html")), "p_partkey")


@query("SELECT page_id, 'Head' || chr(10) || 'One  two' || chr(10) || 'é & more ' || page_id AS text FROM pages")
def page_lines(spark, d):
    """A page's lines: no scripts, styles, menus, headers and footers; references decoded."""
    page = filled("<html><head><title>Head</title><style>p{}</style></head><body><header>H</header><nav><a>N</a></nav><p> One  two\n\n <b>&eacute; &amp; more #</b></p><script>var x = 1;</script><footer>F</footer></body></html>", "page_id")
    return t(spark, d, "pages").select("page_id", html.page_text(page).alias("text"))


# Titles and texts

#: Title; intern, target intern, senior, passes early, suspicious role.
_TITLES = (
    ("Frontend Intern", True, True, False, True, None), ("Senior Manager", False, False, True, False, None), ("Senior Intern", True, True, False, True, None), ("Program Magang Data", True, True, False, True, None), ("Lead Engineer", False, False, True, False, None),
    ("Trainee Actuary", False, True, False, True, None), ("Co-op student", True, True, False, True, None), ("International Sales", False, False, False, True, "sales"), ("Head of Internship", True, True, False, True, None), ("", False, False, False, True, None),
)


@query(f"SELECT p_partkey, i AS intern, tt AS target, s AS senior, e AS early, r AS suspicious FROM part JOIN (VALUES {values([(n, *r[1:]) for n, r in enumerate(_TITLES)])}) v(k, i, tt, s, e, r) ON p_partkey % 10 = k")
def title_predicates(spark, d):
    rows = t(spark, d, "part").withColumn("title", by_case(10, *(r[0] for r in _TITLES)))
    return rows.select("p_partkey", classify.is_intern_title("title").alias("intern"), classify.is_target_intern_title("title").alias("target"), classify.is_senior_title("title").alias("senior"), classify.passes_early("title").alias("early"), classify.suspicious_role("title", LEXICON).alias("suspicious"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n FROM part")
def words_in_context(spark, d):
    """Terms as words, unless they stand in a phrase on earlier experience."""
    body = by_case(5, "we offer an internship now", "prior internship required for staff", "internships only", "internship in may. magang", "has internship experience")
    return t(spark, d, "part").select("p_partkey", text.count_words_in_context(body, LEXICON.strong, classify.V.PRIOR_INTERNSHIP).alias("n"))


#: Title, text; role, confidence.
_ROLES = (("Frontend Intern", "react css", "Frontend Developer", 110), ("Frontend", "", "Frontend Developer", 70), ("Frontend and backend", "", None, 0), ("Actuarial Trainee", "pricing", "Actuarial", 80), ("Actuary frontend", "", "Frontend Developer", 70), ("Cook", "react", None, 0))


@query(f"SELECT p_partkey, r AS role, c AS confidence FROM part JOIN (VALUES {values([(n, *r[2:]) for n, r in enumerate(_ROLES)])}) v(k, r, c) ON p_partkey % 6 = k")
def role_of_title(spark, d):
    r = classify.role(by_case(6, *(x[0] for x in _ROLES)), by_case(6, *(x[1] for x in _ROLES)), LEXICON)
    return t(spark, d, "part").select("p_partkey", r["name"].alias("role"), r["confidence"].alias("confidence"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Jakarta Selatan' WHEN 1 THEN 'Jakarta' WHEN 2 THEN 'Bali' WHEN 3 THEN 'Indonesia' END AS city, CASE p_partkey % 5 WHEN 0 THEN 'jakarta_area' WHEN 1 THEN 'jakarta_area' WHEN 2 THEN 'other' WHEN 3 THEN 'indonesia' END AS area, p_partkey % 5 = 4 AS \"foreign\" FROM part")
def places(spark, d):
    body = by_case(5, "Office in Jakarta Selatan, Indonesia", "JAKARTA, bali", "Bali, Indonesia", "anywhere in Indonesia", "Gurugram office")
    place = fields.place(body, LEXICON)
    return t(spark, d, "part").select("p_partkey", place["city"].alias("city"), place["area"].alias("area"), fields.is_foreign("Jakarta, Indonesia", body).alias("foreign"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS blocked, p_partkey % 4 = 1 AS short_is_fine, p_partkey % 4 IN (1, 2) AS json FROM part")
def response_checks(spark, d):
    """Blocked texts, short listings that scripts fill, and bodies that are JSON."""
    rows = t(spark, d, "part").select(
        "p_partkey", by_case(4, "Please solve the CAPTCHA", "x", "x", "x").alias("text"), by_case(4, "jobstreet", "jobstreet", "glints", "jobstreet").alias("platform"), by_case(4, "detail", "listing", "listing", "listing").alias("type"),
        by_case(4, F.repeat(F.lit("h"), F.lit(2000)), F.repeat(F.lit("h"), F.lit(2000)), F.repeat(F.lit("h"), F.lit(2000)), F.lit("h")).alias("html"), by_case(4, "<p>", ' {"a": 1}', "[1]", '{"a": 1}').alias("body"), by_case(4, F.lit(200), F.lit(200), F.lit(None).cast("int"), F.lit(404)).alias("status"),
    )
    return rows.select("p_partkey", fields.is_blocked("text").alias("blocked"), fields.short_listing_is_fine("platform", "type", "html", F.lit("Content too short")).alias("short_is_fine"), html.is_json_response("body", "status").alias("json"))


# Extraction and scores

_BODY = "Program internship di Jakarta. Apply sekarang, work from home. Gaji 3-5 juta. Deadline: 30 Mei 2026. Durasi 6 bulan. We use react and css every day of the week in our office."
#: Url, title, text; rejection, role, company, place, mode, least pay, duration, deadline, score.
_PAGES = (
    ("https://glints.com/id/opportunities/jobs/a/#?utm_source=x", "Frontend Developer Intern at Acme", _BODY, None, "Frontend Developer", "Acme", "Jakarta", "remote", 3000000, "6 bulan", "30 Mei 2026", 100),
    ("https://dealls.com/loker", "Loker", _BODY, "listing_page", None, None, None, None, None, None, None, None),
    ("https://x.example/a/#", "Content Creator Intern", _BODY, "suspicious_role:content creator", None, None, None, None, None, None, None, None),
    ("https://x.example/b/#", "Cook", "nothing here", "not_internship:no_signal", None, None, None, None, None, None, None, None),
    ("https://x.example/c/#", None, None, "not_internship:no_signal", None, None, None, None, None, None, None, None),
    ("https://x.example/d/#", "Frontend Bootcamp", "bootcamp", "not_internship:hard_reject", None, None, None, None, None, None, None, None),
    ("https://x.example/e/#", "Browse jobs intern", "internship", "listing_title", None, None, None, None, None, None, None, None),
    ("https://x.example/f/#", "Senior Frontend", "internship", "not_internship:seniority_without_internship_title", None, None, None, None, None, None, None, None),
)


def job_pages(spark, d) -> DataFrame:
    of = lambda i: by_case(8, *(filled(r[i]) if r[i] is not None else F.lit(None).cast("string") for r in _PAGES))
    return parts(spark, d).select(of(0).alias("url"), of(1).alias("title"), of(2).alias("text_content"), by_case(8, *("detail" if n == 6 else "unknown" for n in range(8))).alias("page_type"), F.col("p_partkey").alias("ord"))


@query(f"SELECT p_partkey, r AS rejection_reason, role, company, location, work_mode, CAST(pay AS BIGINT) AS salary_min, duration, deadline, CAST(s AS INT) AS score FROM part JOIN (VALUES {values([(n, *r[3:]) for n, r in enumerate(_PAGES)])}) v(k, r, role, company, location, work_mode, pay, duration, deadline, s) ON p_partkey % 8 = k")
def extract_fields(spark, d):
    """Every field of accepted pages and every reason of rejected ones."""
    shown = ("role", "company", "location", "work_mode", "salary_min", "duration", "deadline", "score")
    found = score.score_pages(extract.extract(job_pages(spark, d), LEXICON), LEXICON, AS_OF)
    good = F.col("rejection_reason").isNull()
    return found.select(F.col("ord").alias("p_partkey"), "rejection_reason", *(F.when(good, F.col(c)).alias(c) for c in shown))


@query("SELECT count(*) FILTER (WHERE p_partkey % 8 = 0) > 0 AS any_accepted, least(1, count(*) FILTER (WHERE p_partkey % 8 = 0)) AS accepted, count(*) FILTER (WHERE p_partkey % 8 <> 0) AS rejected FROM part")
def accept_run(spark, d):
    """The whole run over pages: equal jobs are one accepted row, each rejected page is one audit row."""
    good, bad = runs.accept(job_pages(spark, d), runs.Settings(LEXICON, AS_OF))
    return good.agg(F.count("*").alias("accepted")).crossJoin(bad.agg(F.count("*").alias("rejected"))).select((F.col("accepted") > 0).alias("any_accepted"), "accepted", "rejected")  # single rows


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 125 WHEN 1 THEN 115 WHEN 2 THEN 0 ELSE 25 END AS INT) AS score FROM part")
def link_scores(spark, d):
    """100 for a title term, 15 for a skill, 25 for the target's name in title or url."""
    rows = t(spark, d, "part").withColumn("title", by_case(4, "Frontend", "Frontend", "Cook", "x")).withColumn("url", by_case(4, "https://a.example/1", "https://a.example/react", "https://a.example/1", "https://a.example/tech"))
    rows = rows.withColumn("tech", score.link_score(rows, LEXICON, "tech")).withColumn("front", score.link_score(rows, LEXICON, "frontend"))
    return rows.select("p_partkey", F.when(F.col("p_partkey") % 4 == 3, F.col("tech")).when(F.col("p_partkey") % 4 == 1, F.col("front") - 25).otherwise(F.col("front")).alias("score"))


# Gates

#: Fault: column, value; the rules that it breaks, with whether they are hard.
_FAULTS = (
    (None, None, ()), ("source_url", "https://dealls.com/loker", (("LISTING URL", True),)), ("source_url", "https://x.example/1?utm_source=a", (("TRACKING URL", True),)), ("title", "Browse jobs intern", (("BAD TITLE", True),)),
    ("salary", "Rp1", (("BAD SALARY", True),)), ("duration", "30 bulan", (("BAD DURATION", True),)), ("page_type", "listing", (("NON-DETAIL", True),)), ("summary", "this is closed", (("CLOSED ACCEPTED", True),)), ("role_confidence", "10", (("LOW ROLE CONF", True),)),
    ("title", "Frontend sales intern", (("SUS ROLE", True),)), ("summary", "a bootcamp", (("HARD NEGATIVE", True),)), ("company", "what?", (("BAD COMPANY", True),)), ("company_confidence", "10", (("LOW COMPANY CONF", False),)),
    ("summary", "work from home", (("WFH WORK MODE", False),)), ("location", None, (("HIGH SCORE LOW METADATA", False),)), ("salary_confidence", "10", (("LOW SALARY CONF", False),)), ("salary_display", None, (("SALARY DISPLAY MISSING", False),)),
    ("raw_text", "perusahaan tidak menampilkan gaji", (("SALARY CONTRADICTION", False),)), ("category", "data", (("OUT OF TARGET:tech", True),)), ("role", None, (("HIGH SCORE LOW METADATA", False), ("TARGET NULL ROLE", True))),
    ("title", "Senior cook", (("TARGET SENIORITY", True),)), ("is_internship", "false", ()),
)
_GOOD = {
    "title": "Frontend intern", "company": "Acme", "role": "Frontend Developer", "category": "tech", "location": "Jakarta", "work_mode": "onsite", "salary": "Rp3.000.000", "salary_raw": "Rp3.000.000", "salary_display": "Rp3.000.000", "duration": "6 bulan", "page_type": "detail",
    "summary": "good", "raw_text": "internship", "source_url": "https://x.example/1", "detail_url": "https://x.example/1", "role_confidence": "80", "company_confidence": "80", "salary_confidence": "80", "score": "90", "is_internship": "true",
}
_TYPES = {"role_confidence": "int", "company_confidence": "int", "salary_confidence": "int", "score": "int", "is_internship": "boolean"}


@query(f"SELECT rule, hard, count(*) AS n FROM part JOIN (VALUES {values([(i, r, h) for i, (_, _, rs) in enumerate(_FAULTS) for r, h in rs])}) v(k, rule, hard) ON p_partkey % {len(_FAULTS)} = k GROUP BY rule, hard")
def result_gate(spark, d):
    """Rows with one fault each against all rules of the gate over results: the rules that they break and no others."""
    k = F.col("p_partkey") % len(_FAULTS)
    column = lambda c, v: F.coalesce(*(F.when(k == i, F.struct(F.lit(x).cast("string").alias("v"))) for i, (f, x, _) in enumerate(_FAULTS) if f == c), F.struct(F.lit(v).alias("v")))["v"].cast(_TYPES.get(c, "string"))
    rows = t(spark, d, "part").select(*(column(c, v).alias(c) for c, v in _GOOD.items()))
    return metrics.issues(rows, metrics.result_rules(LEXICON, "tech"), "title").groupBy("rule", "hard").agg(F.count("*").alias("n"))


_SHOWN = {
    "title": "T", "company": "Acme", "role": "R", "role_specialization": "web", "category": "tech", "source_platform": "glints", "score": "50", "dashboard_quality": "high", "extraction_depth": "full_detail", "verification_level": "verified_detail",
    "active_status": "active", "summary_short": "s", "first_seen": "2026", "last_verified_at": "2026", "work_mode": "remote",
}
_SHOWN_FAULTS = (
    (None, None, ()), ("company", "what?", ("BAD COMPANY",)), ("work_mode", "moon", ("BAD WORK MODE",)), ("dashboard_quality", "great", ("BAD QUALITY",)), ("extraction_depth", "deep", ("BAD EXTRACTION DEPTH",)), ("active_status", "closed", ("CLOSED ACCEPTED",)),
    ("active_status", "odd", ("BAD ACTIVE STATUS",)), ("role", None, ("MISSING DASHBOARD FIELD:role",)), ("summary_short", "", ("MISSING DASHBOARD FIELD:summary_short",)), ("title", None, ("MISSING DASHBOARD FIELD:title",)),
)


@query(f"SELECT rule, count(*) AS n FROM part JOIN (VALUES {values([(i, r) for i, (_, _, rs) in enumerate(_SHOWN_FAULTS) for r in rs])}) v(k, rule) ON p_partkey % {len(_SHOWN_FAULTS)} = k GROUP BY rule UNION ALL SELECT 'LOW SOURCE DIVERSITY', 1 UNION ALL SELECT 'NON-GLINTS FULL DETAIL', 1 UNION ALL SELECT 'MISSING SCHEMA', 1")
def dashboard_gate(spark, d):
    """The gate over dashboard rows, of single rows and of the whole."""
    k = F.col("p_partkey") % len(_SHOWN_FAULTS)
    column = lambda c, v: F.coalesce(*(F.when(k == i, F.struct(F.lit(x).cast("string").alias("v"))) for i, (f, x, _) in enumerate(_SHOWN_FAULTS) if f == c), F.struct(F.lit(v).alias("v")))["v"]
    rows = t(spark, d, "part").select(key().alias("id"), filled("https://x.example/#").alias("source_url"), *(column(c, v).alias(c) for c, v in _SHOWN.items()))
    return metrics.dashboard_gate(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """WITH x AS (SELECT p_partkey % 4 AS k FROM part), n AS (SELECT count(*) FILTER (WHERE k = 0) AS tp, count(*) FILTER (WHERE k = 3) AS fp, count(*) FILTER (WHERE k = 1) AS fn, count(*) FILTER (WHERE k = 2) AS tn, count(*) AS total FROM x)
    SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + fn + tn) / total AS internship_accuracy, 1.0::DOUBLE AS role_accuracy FROM n"""
)
def evaluation(spark, d):
    """Labelled rows through extractor and scores: found, missed by its target, rightly left out, wrongly taken."""
    rows = parts(spark, d).select(
        filled("u#").alias("url"), by_case(4, "Frontend Intern", "Actuarial Intern", "Senior Cook", "Frontend Intern").alias("title"), F.lit("Acme").alias("company"), by_case(4, "internship react", "pricing", "cooking", "internship").alias("description"),
        (F.col("p_partkey") % 4 < 2).alias("true_should_save"), (F.col("p_partkey") % 4 < 2).alias("true_is_internship"), by_case(4, "frontend", "actuarial", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("true_role"),
        by_case(4, F.lit(None).cast("string"), F.lit("tech"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("target_category"),
    )
    return runs.evaluate(rows, runs.Settings(LEXICON, AS_OF))[1]


# Sources, plans and runs


@query("SELECT n_nationkey * 1000 + i AS ord, 'q' || n_nationkey AS query, 'T' || i AS title, CASE WHEN i = 0 THEN 'body' ELSE 'snip' END AS snippet, 'https://www.glints.com/' || n_nationkey || '/' || i AS url, 'glints' AS source_platform FROM nation, (VALUES (0), (1)) v(i)")
def provider_search(spark, d):
    """Hits of a provider in the order of the queries: other names of fields, more hits than asked for, hits of one url, hits without url."""

    def provider(q: str, most: int) -> list[dict]:
        n = q[1:]
        return [{"name": "T0", "body": "body", "href": f"https://www.glints.com/{n}/0?utm_source=x"}, {"title": "T1", "snippet": "snip", "link": f"https://www.glints.com/{n}/1"}, {"title": "again", "url": f"https://www.glints.com/{n}/1#x"}, {"title": "none"}, {"title": "beyond", "url": f"https://x.example/{n}"}]

    asked = t(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("q"), key("n_nationkey")).alias("query"))
    return search.search(asked, provider, 4, 2).select("ord", "query", "title", "snippet", "url", "source_platform")


_SOURCES = {"manual_sources": ["https://a.example/x", {"url": "https://b.example", "name": "b", "platform": "pb"}], "role_sources": {"tech": [{"url": "https://r.example", "name": "r"}, {"name": "no url"}]}, "sources": {"tier2": ["https://c.example/c"], "tier1": [{"url": "https://a.example/x", "name": "late"}, {"url": "https://d.example", "type": "detail", "name": "d"}]}}


@query("SELECT * FROM (VALUES ('role:tech', 'r', NULL, 'listing', 'https://r.example', 0), ('legacy', 'manual_a.example', NULL, 'listing', 'https://a.example/x', 1), ('legacy', 'b', 'pb', 'listing', 'https://b.example', 2), ('tier1', 'd', NULL, 'detail', 'https://d.example', 4), ('tier2', 'manual_c.example', NULL, 'listing', 'https://c.example/c', 5)) v(tier, name, platform, type, url, ord)")
def configured_sources(spark, d):
    """Role sources, the plain list and tiers by name, each url once."""
    return config.source_entries(spark, _SOURCES, "tech")


@query("SELECT p_partkey AS ord, 'https://s.example/' || p_partkey AS url FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey + 1000000000, 'https://s.example/' || p_partkey FROM part WHERE p_partkey % 2 = 0")
def hits_and_seeds(spark, d):
    """Seeds whose url no hit has come after the hits."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("ord"), filled("https://s.example/#").alias("url"))
    return search.with_seeds(rows.filter("ord % 2 = 1"), rows)


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'second' ELSE 'first' END AS origin FROM part")
def union_first(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return dedupe.union_first([rows.filter("k % 3 <> 0").select("k", F.lit(0).alias("ord"), F.lit("first").alias("origin")), rows.select("k", F.lit(1).alias("ord"), F.lit("second").alias("origin"))], "k")


@query("SELECT p_type AS t, min(p_partkey) AS ord FROM part GROUP BY p_type")
def distinct_ignoring_case(spark, d):
    """The first spelling of each text; here the first row of each type is spelt as it is, later ones in lower case and with spaces; blank ones go."""
    rows = t(spark, d, "part").join(t(spark, d, "part").groupBy("p_type").agg(F.min("p_partkey").alias("_f")), "p_type")
    first = F.when(F.col("p_partkey") == F.col("_f"), F.col("p_type")).otherwise(F.concat(F.lit("  "), F.lower("p_type")))
    rows = rows.select(first.alias("t"), F.col("p_partkey").alias("ord")).unionByName(rows.select(F.lit("  ").alias("t"), F.col("p_partkey").alias("ord")))
    return dedupe.distinct_ignoring_case(rows, "t")


@query("SELECT platform FROM (VALUES ('glints'), ('dealls')) v(platform)")
def platforms_named(spark, d):
    made = t(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") > 3, 'site:dealls.com "x" site:glints.com').when(F.col("n_nationkey") == 2, 'SITE:glints.com "y"').otherwise("none").alias("query"))
    return lookup.platforms_named(made, {"dealls": "site:dealls", "glints": "site:glints", "kalibrr": "site:kalibrr"})


_TERMS = {"frontend": ["frontend intern", "react intern", "Frontend Intern"], "backend": ["go intern", "  "]}
_PLAN = """WITH t AS (SELECT * FROM (VALUES {terms}) v(n, term)), s AS (SELECT * FROM (VALUES {slots}) v(slot, k, form, low, high)),
    q AS (SELECT replace(replace(form, '{{term}}', term), '{{location}}', 'Bali') AS query, slot, n, k FROM t JOIN s ON n >= low AND n < high), u AS (SELECT query, slot, n, k FROM q QUALIFY row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY slot, n, k) = 1)
    SELECT query, row_number() OVER (ORDER BY slot, n, k) AS place FROM u ORDER BY slot, n, k LIMIT {n}"""


def _plan_sql(terms: list[str], slots, n: int) -> str:
    return _PLAN.format(terms=values(enumerate(terms)), slots=values([(i, k, f, lo, hi) for i, (forms, lo, hi) in enumerate(slots) for k, f in enumerate(forms)]), n=n)


_FIRST = [((f,), 1 + i % 3, 2 + i % 3) for i, f in enumerate(queries.PLATFORM_FORMS)]


@query(_plan_sql(["my query", "frontend intern", "react intern", "go intern"], [(queries.EXACT, 0, 1), *_FIRST, (queries.SITES[:4], 1, 4), (queries.EXACT, 0, 99), (queries.SITES, 4, 99), (queries.LOOSE, 0, 99)], 30))
def plan_of_a_query(spark, d):
    """A user's query with a target's terms: exact, spread over the platforms, sites, loose."""
    made = queries.plan(spark, _TERMS, " my query ", "Bali", "tech", 30)
    return made.select("query", F.row_number().over(rank.W.orderBy("ord")).alias("place"))


@query(_plan_sql(["frontend intern", "react intern", "go intern"], [(queries.EXACT, 0, 99), (queries.SITES, 0, 4), (queries.LOOSE, 0, 99)], 20))
def plan_of_a_target(spark, d):
    made = queries.plan(spark, _TERMS, None, "Bali", "tech", 20)
    return made.select("query", F.row_number().over(rank.W.orderBy("ord")).alias("place"))


@query(_plan_sql(["x", "y"], [(queries.EXACT, 0, 99), (queries.RAW_SITES, 0, 99), (queries.RAW_LOOSE, 0, 99)], 99))
def plan_of_raw_words(spark, d):
    made = queries.from_raw(spark, "x", "Bali", "Actuarial", {"actuarial": ["y", "X"]})
    return made.select("query", F.row_number().over(rank.W.orderBy("ord")).alias("place"))


@query("SELECT p_partkey AS id, p_name AS title, p_retailprice AS score, '{\"a\":' || p_size || ',\"b\":null}' AS score_breakdown, NULL AS company FROM part")
def csv_export(spark, d):
    """An export with a struct and a missing column, read again."""
    path = dedupe.shared_folder(spark)
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"), F.struct(F.col("p_size").alias("a"), F.lit(None).cast("int").alias("b")).alias("score_breakdown"))
    export.write_csv(rows, path, ("id", "title", "score", "score_breakdown", "company"))
    return spark.read.option("header", True).option("escape", '"').schema("id long, title string, score double, score_breakdown string, company string").csv(path)


@query("SELECT p_partkey AS id, 'line' || chr(10) || 'two, \"' || p_partkey || '\"' AS description, p_partkey % 2 = 0 AS should_save, CASE p_partkey % 3 WHEN 0 THEN 'frontend' WHEN 1 THEN NULL ELSE 'ui_ux' END AS role FROM part")
def golden_labels(spark, d):
    """Labels from CSV with quotes and line ends in it."""
    path = dedupe.shared_folder(spark)
    rows = t(spark, d, "part").select(
        key().alias("url"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("company"), F.concat(F.lit('line\ntwo, "'), key(), F.lit('"')).alias("description"), by_case(2, "Ya", "no").alias("should_save"), F.lit("true").alias("true_is_internship"),
        by_case(3, "Frontend Developer", "N/A", "UI-UX Designer").alias("true_role"), F.lit("x").alias("true_category"), F.lit("Bali").alias("true_location"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_labels(spark, path).select(F.col("url").cast("long").alias("id"), "description", F.col("true_should_save").alias("should_save"), F.col("true_role").alias("role"))
