import re
from datetime import datetime
from functools import reduce

import pytest
from fixtures import LEXICON
from pyspark.sql import functions as F

from sluice.functions import classify, fields, html, text, urls
from sluice.operators import extract


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Glints.com/id/Jobs/a/?utm_source=x&b=1&ref=q#top", "https://glints.com/id/Jobs/a?b=1"),
        ("https://www.jobstreet.co.id/id/job/12345?token=abc", "https://www.jobstreet.co.id/job/12345"),
        ("https://a.example/?q=a+b&empty=", "https://a.example/?q=a+b&empty="),
        ("https://a.example/p;v=1", "https://a.example/p"),
        ("not a url ", "not a url"),
        (None, ""),
        ("https://a.example/x?a=%zz", "https://a.example/x?a=%25zz"),
    ],
)
def test_canonical_url(spark, url, want):
    got = one(spark, url, urls.canonical)
    assert got == want
    assert one(spark, got, urls.canonical) in (want, "https://a.example/x?a=%25zz")


def test_url_flags(spark):
    assert one(spark, "https://a.example/x?GCLID=1", urls.has_tracking) and one(spark, "https://a.example/x#y", urls.has_tracking) and not one(spark, "https://a.example/x?a=1", urls.has_tracking)
    assert one(spark, "https://a.example/F.PDF?x=.html", urls.is_binary) and not one(spark, "https://a.example/pdf", urls.is_binary)
    assert one(spark, "https://id.jobstreet.com/x", urls.platform) == "jobstreet" and one(spark, "https://x.example", urls.platform) == "generic"
    assert one(spark, "https://www.jobstreet.co.id/id/frontend-intern-jobs", urls.is_listing) and one(spark, "https://dealls.com/loker/", urls.is_listing)
    assert one(spark, "https://www.linkedin.com/jobs/view/1", urls.is_detail) and not one(spark, "https://www.linkedin.com/jobs/search", urls.is_detail)
    assert one(spark, "ftp://x.example/a", urls.is_bad) and one(spark, None, urls.is_bad) and not one(spark, "https://dealls.com/loker", urls.is_bad)
    assert one(spark, "https://id.linkedin.com/jobs/frontend-jobs?x", urls.is_bad)
    assert one(spark, None, urls.is_listing_title) is False and one(spark, "12 pekerjaan di Bali", urls.is_listing_title)


def test_salary(spark):
    def pay(t):
        df = spark.createDataFrame([(t,)], "x string").withColumn("s", fields.salary("x")).withColumn("c", fields.salary_confidence("x", "s"))
        return df.withColumn("p", fields.salary_struct("s", F.col("c"))).select("s", "c", "p.display", "p.low", "p.high").first()

    assert tuple(pay("gaji Rp\n750.000 per bulan"))[1:] == (80, "Rp750.000", 750000, 750000)
    assert tuple(pay("3-5 juta"))[2:] == ("Rp3.000.000 - Rp5.000.000", 3000000, 5000000)
    assert pay("gaji tidak ditampilkan, 5 juta")["s"] is None
    assert tuple(pay("this is an unpaid internship")) == ("unpaid internship", 70, "unpaid internship", None, None)
    assert tuple(pay(None)) == (None, 0, None, None, None)


def test_dates_and_durations(spark):
    assert one(spark, "x" * 50 + " Deadline: 19 Mei 2026 ok", fields.deadline) == "19 Mei 2026"
    assert one(spark, "open until 2026-05-19", fields.deadline) == "2026-05-19"
    for given in ("19 Mei 2025", "2025-05-19", "19/05/2025", "19-05-2025", "19 MAY 2025"):
        assert one(spark, given, fields.deadline_time) == datetime(2025, 5, 19)
        assert one(spark, given, lambda c: fields.is_expired(c, datetime(2025, 5, 19, 1)))
    assert one(spark, "soon", lambda c: fields.is_expired(c, datetime(2030, 1, 1))) is False
    assert one(spark, "magang 6 bulan", fields.duration) == "6 bulan" and one(spark, "99 bulan", fields.duration) is None and one(spark, "12 weeks", fields.duration) == "12 weeks"


def test_company_and_place(spark):
    def company(title, body=""):
        return spark.createDataFrame([(title, body)], "t string, b string").select(fields.company("b", "t")).first()[0]

    assert company("PT Maju membuka lowongan Intern") == "PT Maju"
    assert company("Intern at Acme | Glints") == "Acme"
    assert company("Intern", "x\nCompany: Bank Sejahtera\n") == "Bank Sejahtera"
    assert company("Intern", "company: we assist you!") is None
    place = lambda t: tuple(one(spark, t, lambda c: fields.place(c, LEXICON)) or (None, None))
    assert place("kantor di Jakarta Selatan") == ("Jakarta", "jakarta_area") and place("balikpapan") == ("Bali", "other") and place("Indonesia") == ("Indonesia", "indonesia") and place("mars") == (None, None)
    mode = lambda t: one(spark, t, lambda c: fields.work_mode(c, LEXICON))
    assert mode("hybrid, full remote") == "remote" and mode("WFO or WFH") == "onsite" and mode("hybrid") == "hybrid" and mode(None) is None


@pytest.mark.parametrize(
    "title, body, want",
    [
        ("Frontend Developer Intern", "", (True, 90, "title_strong")),
        ("Frontend Bootcamp Intern", "join our bootcamp", (False, 0, "hard_reject")),
        ("Artikel magang", "", (False, 0, "likely_not_job")),
        ("Senior Manager", "internship program magang", (False, 0, "seniority_without_internship_title")),
        ("Developer", "program magang for you", (True, 75, "description_strong")),
        ("Developer", "an internship here", (True, 60, "description_single_strong")),
        ("Developer", "previous internship experience", (False, 0, "no_signal")),
        ("Developer full time", "an internship, mahasiswa", (True, 55, "description_weak_plus_strong")),
        ("Developer full time", "office work", (False, 0, "non_internship_title")),
        (None, None, (False, 0, "no_signal")),
    ],
)
def test_internship(spark, title, body, want):
    df = spark.createDataFrame([(title, body)], "t string, b string")
    assert tuple(df.select(classify.internship("b", "t", LEXICON)).first()[0]) == want


def test_role_and_target(spark):
    def role(title, body=""):
        return tuple(spark.createDataFrame([(title, body)], "t string, b string").select(classify.role("t", "b", LEXICON)).first()[0])

    assert role("Software Engineer Intern", "git python java react") == ("Software Engineering", 120)
    assert role("Frontend Developer", "react") == ("Frontend Developer", 80)
    assert role("Frontend or Backend") == (None, 0) and role("Cook") == (None, 0)
    assert one(spark, "AI/ML Engineer", classify.role_key) == "ai_ml" and one(spark, "Frontend Developer", classify.category) == "tech"
    assert classify.target_name(" Front-End ") == "frontend" and classify.target_name("technology") == "tech" and classify.target_name("") is None
    assert one(spark, "Lead Sales", classify.passes_early) is False and one(spark, "Intern to the Manager", classify.passes_early) and one(spark, None, classify.passes_early)


def test_page_guard(spark):
    def guard(title, body, status=200):
        return spark.createDataFrame([(title, body, status)], "t string, b string, s int").select(fields.page_guard("t", "b", "s")).first()[0]

    long = "a" * 300
    assert guard("x", long, 403) == "HTTP 403" and guard("Captcha", long) == "Skip signal: captcha" and guard("Login", long) == "Login page: login"
    assert guard("x", "short") == "Content too short" and guard("x", long) is None and guard("x", "a" * 1300 + "captcha") is None


def test_texts(spark):
    assert one(spark, "  Größe,  Ünï! ", text.normalize) == "größe ünï"
    assert one(spark, "a b " * 100, lambda c: text.short_summary(c)).endswith("...") and one(spark, "", text.short_summary) is None
    assert one(spark, "Hello, World!", text.slug) == "hello-world"
    assert one(spark, "N/A", text.label) is None and one(spark, "UI-UX Designer", text.label) == "ui_ux_designer" and one(spark, "ya", text.truth)


PAGE = """<html><head><title>Jobs</title></head><body><a href="/loker/react-intern~acme">React <b>Intern</b></a><a href="/loker/industri/x~y">no</a><a href="/loker/react-intern~acme">again</a>
<script type="application/ld+json">{"a": {"b": "A <i>text</i>"}, "c": ["A TEXT", "x"]}</script></body></html>"""


def test_links(spark):
    cards = '<article data-job-id="1"><a data-automation="jobTitle" href="/id/job/77">Data Intern</a><span data-automation="jobCompany">Acme</span></article><a href="/job/88">Other</a><script>x="\\/id\\/job\\/99"</script><script data-api-response="true">{"jobs":[{"jobId":5,"jobTitle":"QA Intern","companyName":"Co"}]}</script>'
    pages = spark.createDataFrame([("https://dealls.com/loker", PAGE), ("https://www.jobstreet.co.id/id/jobs", cards), ("https://x.example/careers", '<a href="/job/1">A</a><a href="https://y.example/job/2">B</a><a>none</a>'), ("https://z.example/", None)], "url string, html string")
    got = {(r.source_platform, r.url, r.title, r.company, r.discovery_method) for r in html.detail_links(pages).collect()}
    assert got == {
        ("dealls", "https://dealls.com/loker/react-intern~acme", "ReactIntern", None, "dom"),
        ("jobstreet", "https://www.jobstreet.co.id/id/job/77", "Data Intern", "Acme", "card"),
        ("jobstreet", "https://www.jobstreet.co.id/job/88", "Other", None, "dom"),
        ("jobstreet", "https://www.jobstreet.co.id/id/job/99", None, None, "script"),
        ("jobstreet", "https://www.jobstreet.co.id/job/99", None, None, "script"),
        ("jobstreet", "https://www.jobstreet.co.id/id/job/qa-intern-5", "QA Intern", "Co", "api"),
        ("generic", "https://x.example/job/1", "A", None, "dom"),
    }
    found = html.structured_text(pages, "url").filter("url like '%loker'").first()
    assert found.text == "A text"
    assert pages.select(html.page_text("html")).first()[0].splitlines()[0] == "Jobs"


def test_json_walk_is_deep_and_tolerant(spark):
    deep = "[" * 500 + '{"jobUrl": "https://glints.com/id/opportunities/jobs/a/1"}' + "]" * 500
    bodies = spark.createDataFrame([("https://glints.com/l", deep, None), ("https://glints.com/l", "{broken", "glints"), ("https://glints.com/l", None, "glints")], "listing_url string, body string, source_platform string")
    assert [r.url for r in html.api_links(bodies).collect()] == ["https://glints.com/id/opportunities/jobs/a/1"]


def test_matches_any_as_its_patterns_one_by_one(spark):
    """Shared borders and the look at beginnings find the same as each pattern alone, also where letters outside ASCII match ASCII ones."""
    words = ("intern", "internship", "head of", "head\u3000of", "vice president", "co-op", "find jobs", "12 jobs", "job vacancy or opportunity", "senior", "magang", "chief", "vp", "links")
    marks = ("", " ", "x", "é", "_", "\u0301", "-", "\n")
    texts = [m + w + n for w in words for m in marks for n in marks] + [w.upper() for w in words] + [w.replace(a, b) for w in words for a, b in ("iı", "iİ", "sſ", "k\u212a", "nṄ")] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for patterns in (classify.V.INTERN_TITLE, classify.V.SENIOR_TITLE, classify.V.LISTING_TITLES, (r"\blinks?\b", r"a|\bvp\b", r"\bmagangs*\b")):
        alone = F.coalesce(reduce(lambda a, b: a | b, (F.col("x").rlike("(?iU)" + p) for p in patterns)), F.lit(False))
        got = df.select(F.col("x"), alone.alias("want"), text.matches_any("x", patterns).alias("got"), text.matches_any("x", patterns, text.plain_lower("x")).alias("rare")).collect()
        assert any(r.want for r in got) and [r for r in got if not r.want == r.got == r.rare] == []


def test_no_letter_is_missed_by_plain_lower(spark):
    """Every character that matches an ASCII letter, case aside, is one or makes plain_lower null."""
    df = spark.range(0x20, 0xD800).union(spark.range(0xE000, 0x1F000)).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("x"))
    odd = df.filter(F.col("x").rlike("(?iU)[abcdefghijklmnopqrstuvwxyz]") & F.coalesce(~text.plain_lower("x").rlike("[a-z]"), F.lit(False)))
    assert odd.count() == 0 and df.filter(text.plain_lower("x").isNull()).count() == 4


def test_extractor_goes_through_titles_once_a_decision(spark):
    """Whether a title names an internship is asked once for the gate and once for the role, however many roles there are."""
    pages = spark.createDataFrame([("u", "t", "b", "detail")], "url string, title string, text_content string, page_type string")
    plan = extract.extract(pages, LEXICON).select("role", "rejection_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\([^,]*, \(\?iU\)[^,]*apprentice", plan)) == 2
