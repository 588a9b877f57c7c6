"""Queries of the engine's operators over the driver's tables, each with the same in DuckDB's SQL.

The tables hold invented prose, so the queries bind lexicons of their own words; the operators are the engine's.
"""

from __future__ import annotations

from pyspark.sql import functions as F


from .. import vocabulary as V
from ..config import Lexicon, Role
from ..functions import classify, fields, html, text, urls
from ..operators import dedupe, extract, lookup, metrics, queue, rank, score, upsert
from ..sources import export
from ..streaming import ingest
from . import runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


PREFIXES = (("blog.", "blog"), ("www.", "www"), ("m.", "mobile"))
WORDS = ("license", "the", "der", "les")
LEXICON = Lexicon(
    strong=("the", "der", "les"), weak=("and", "und"), non_internship=("table",), hard_reject=("worthless", "disgusting"), likely_not_job=("||",), suspicious_roles=("license",),
    roles=(Role("frontend", ("license",), ("apache",), ("mit ",)), Role("backend", ("the ", "der "), ("and ", "of "), ("les ",)), Role("actuarial", ("les ",), ("des ",), ())),
    places=(("north", ("ould", "heit")), ("south", ("eau", "ción"))), work_modes=(("hybrid", ("ing ",)), ("remote", ("keit",)), ("onsite", ("tion",))),
)

# SQL pieces

_TRACK = "(" + ", ".join(f"'{p}'" for p in V.TRACKING_PARAMS) + ")"
_PAGE = r"""
    parts AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host,
              regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS frag FROM pages),
    canon AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN """ + _TRACK + r"""), '&') AS kept,
              CASE WHEN regexp_replace(path, '/+$', '') = '' THEN path ELSE regexp_replace(path, '/+$', '') END AS place FROM parts),
    c AS (SELECT *, scheme || '://' || lower(host) || place || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM canon)"""
_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_PREFIX = "CASE WHEN contains({h}, 'blog.') THEN 'blog' WHEN contains({h}, 'www.') THEN 'www' WHEN contains({h}, 'm.') THEN 'mobile' ELSE 'generic' END"


def _kind(url="url"):
    """The platform of a fixture url: the prefix of its host, which ``www.`` is part of here."""
    return text.first_group(F.lower(urls.host(url)), [(p, (part,)) for part, p in PREFIXES], "generic")


def _pages(spark, d):
    return t(spark, d, "pages").withColumn("canonical", urls.canonical("url")).withColumn("platform", _kind())


# Urls and pages


@query(
    "WITH " + _PAGE + r""",
    scored AS (SELECT canonical, page_id, """ + _PREFIX.format(h="lower(host)") + r""" AS platform, CAST(40 * CAST(scheme = 'https' AS INT) + 25 * CAST(regexp_matches(path, '^/(en|de)/') AS INT) - 20 * CAST(q <> '' AS INT) AS INT) AS score FROM c),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY score DESC, page_id) = 1),
    capped AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY platform ORDER BY score DESC, page_id) <= 10)
    SELECT page_id, canonical, platform, score FROM capped ORDER BY score DESC, page_id LIMIT 25"""
)
def flagship_page_rank(spark, d):
    """The best page of each canonical url, scored, capped per platform, the top 25."""
    points = score.points((urls.scheme("url") == "https", 40), (urls.path("url").rlike("^/(en|de)/"), 25), (urls.query("url") != "", -20))
    order = [F.desc("score"), F.asc("page_id")]
    best = rank.first_of_each(_pages(spark, d).withColumn("score", points.cast("int")), ["canonical"], order)
    return rank.cap(best, "platform", order, 10, 25).select("page_id", "canonical", "platform", "score")


@query("WITH " + _PAGE + " SELECT page_id, canonical FROM c")
def url_canonicalize(spark, d):
    return _pages(spark, d).select("page_id", "canonical")


@query("WITH " + _PAGE + " SELECT canonical AS url, min(page_id) AS page_id FROM c WHERE canonical <> '' GROUP BY canonical")
def url_dedupe_first(spark, d):
    return dedupe.by_canonical_url(t(spark, d, "pages"), "url", "page_id").select("url", "page_id")


@query("WITH " + _PAGE + " SELECT page_id, (frag <> '' OR len(list_filter(string_split(q, '&'), lambda x: lower(regexp_extract(x, '^([^=]*)', 1)) IN " + _TRACK + ")) > 0) AS tracked FROM c")
def url_tracking_flag(spark, d):
    return t(spark, d, "pages").select("page_id", urls.has_tracking("url").alias("tracked"))


@query("WITH " + _PAGE + " SELECT page_id, replace(host, 'www.', '') AS domain, " + _PREFIX.format(h="lower(host)") + " AS platform FROM c")
def host_platform(spark, d):
    return t(spark, d, "pages").select("page_id", urls.domain("url").alias("domain"), _kind().alias("platform"))


@query("WITH " + _PAGE + r" SELECT page_id, CASE WHEN regexp_matches(regexp_replace(path, '/+$', ''), '(?i)/5\d*$|^/de/1') OR regexp_matches(lower(" + _TITLE + r"), '^the |^der ') THEN 'listing' ELSE 'detail' END AS page_type FROM c")
def page_classify(spark, d):
    listing = urls.is_listing("url", (r"/5\d*$", "^/de/1")) | urls.is_listing_title(html.title("html"), ("^the ", "^der "))
    return t(spark, d, "pages").select("page_id", F.when(listing, "listing").otherwise("detail").alias("page_type"))


@query("SELECT page_id, page_id % 3 <> 2 AS is_binary FROM pages")
def url_binary_filter(spark, d):
    k = F.col("page_id") % 3
    plain = F.regexp_extract("url", "^[^?#]*", 0)
    return t(spark, d, "pages").select("page_id", urls.is_binary(F.when(k == 0, F.concat(plain, F.lit(".pdf"))).when(k == 1, F.concat(plain, F.lit("/a.PNG?x=1#y"))).otherwise(F.concat(plain, F.lit("?file=a.zip")))).alias("is_binary"))


@query("SELECT page_id, regexp_matches(lower(url), '/blog|/article|/tips|/career-advice|/course|/bootcamp|/kelas|/login|/signup') AS bad, regexp_matches(url, '(?i)/careers?/.+|/jobs?/(view/)?\\d+') AS detail FROM pages")
def url_bad_filter(spark, d):
    return t(spark, d, "pages").select("page_id", urls.is_bad("url").alias("bad"), urls.is_detail("url").alias("detail"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'HTTP 403' WHEN doc_id % 50 = 2 THEN 'HTTP 429' WHEN contains(lower(source) || chr(10) || lower(substr(text, 1, 1200)), 'captcha') THEN 'Skip signal: captcha'
       WHEN contains(lower(source) || chr(10) || lower(substr(text, 1, 1200)), 'access denied') THEN 'Skip signal: access denied' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 200 THEN 'Content too short' END AS reason FROM documents"""
)
def page_guard_reason(spark, d):
    status = F.when(F.col("doc_id") % 50 == 1, 403).when(F.col("doc_id") % 50 == 2, 429).otherwise(200)
    return t(spark, d, "documents").withColumn("status", status).select("doc_id", fields.page_guard("source", "text", "status").alias("reason"))


@query("SELECT page_id, nullif(" + _TITLE + ", '') AS title FROM pages")
def html_title(spark, d):
    return t(spark, d, "pages").select("page_id", html.title("html").alias("title"))


@query(
    """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
    SELECT page_id, CAST(pos AS INT) AS pos, href FROM a"""
)
def html_anchor_links(spark, d):
    p = t(spark, d, "pages").withColumn("key", F.col("page_id").cast("string"))
    found = html.page_items(p, "key", "html", F.lit("generic")).filter("discovery_method = 'dom'")
    return found.select(F.col("listing_url").cast("long").alias("page_id"), "pos", "href")


@query()
def html_text_len(spark, d):
    return t(spark, d, "pages").select("page_id", F.length(html.page_text("html")).cast("long").alias("n_chars"))


@query(
    "WITH " + _PAGE + """, l AS (SELECT canonical AS url, page_id AS ord, CASE WHEN page_id % 3 = 0 THEN 'Co' END AS company, CASE WHEN page_id % 2 = 0 THEN 'Title' ELSE '' END AS title, CASE WHEN page_id % 5 = 0 THEN 'card' ELSE 'dom' END AS discovery_method FROM c)
    SELECT url, ord FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY 30 * CAST(company IS NOT NULL AS INT) + 20 * CAST(title <> '' AS INT) + 10 * CAST(discovery_method = 'card' AS INT) DESC, ord) = 1"""
)
def link_merge_dedupe(spark, d):
    links = t(spark, d, "pages").select(F.col("url"), F.col("page_id").alias("ord"), F.when(F.col("page_id") % 3 == 0, "Co").alias("company"), F.when(F.col("page_id") % 2 == 0, "Title").otherwise("").alias("title"), F.when(F.col("page_id") % 5 == 0, "card").otherwise("dom").alias("discovery_method"), F.lit("generic").alias("source_platform"))
    return dedupe.richest_links(links).select(urls.canonical("url").alias("url"), "ord")


@query("WITH " + _PAGE + ", s AS (SELECT page_id, CASE WHEN regexp_matches(lower(url), '/blog|/article|/tips|/career-advice|/course|/bootcamp|/kelas|/login|/signup') THEN -100 ELSE 4 + 10 * CAST(page_id % 2 = 0 AS INT) + 25 * CAST(contains(lower(" + _TITLE + " || ' None ' || url), 'intern') AS INT) - 20 * CAST(regexp_matches(regexp_replace(path, '/+$', ''), '(?i)/search|/category') AS INT) END AS score FROM c) SELECT page_id, CAST(score AS INT) AS score FROM s")
def url_prescore(spark, d):
    p = t(spark, d, "pages").withColumn("title", html.title("html")).withColumn("page_type", F.when(F.col("page_id") % 2 == 0, "detail").otherwise("unknown"))
    return p.select("page_id", score.url_score("url", "title", F.lit(None), "page_type", F.lit(None).cast("string")).alias("score"))


# Texts

_NORM = "regexp_replace(regexp_replace(trim(lower({c})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')"


@query("SELECT doc_id, md5(" + _NORM.format(c="source") + " || '|' || '' || '|' || " + _NORM.format(c="lang") + " || '|' || " + _NORM.format(c="text") + ") AS canonical_key FROM documents")
def text_normalize_key(spark, d):
    return t(spark, d, "documents").select("doc_id", text.canonical_key("text", "source", F.lit(None).cast("string"), "lang", F.lit("")).alias("canonical_key"))


@query(
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 31) AS k FROM documents), s AS (SELECT doc_id, array_to_string(k[1:5], ' ') AS s FROM l),
    b AS (SELECT doc_id, CASE WHEN length(s) > 300 THEN regexp_replace(substr(s, 1, 300), ' [^ ]*$', '') || '...' ELSE s END AS summary FROM s), q AS (SELECT *, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS z FROM b)
    SELECT doc_id, summary, nullif(CASE WHEN length(z) > 180 THEN regexp_replace(substr(z, 1, 180), ' [^ ]*$', '') || '...' ELSE z END, '') AS short FROM q"""
)
def summary_short(spark, d):
    rows = t(spark, d, "documents").select("doc_id", text.summary("text").alias("summary"))
    return rows.withColumn("short", text.short_summary("summary"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in WORDS) + " END AS term FROM documents")
def lexicon_first_match(spark, d):
    return t(spark, d, "documents").select("doc_id", text.first_term(F.lower("text"), WORDS).alias("term"))


@query("SELECT doc_id, CAST(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in WORDS) + " AS INT) AS n FROM documents")
def lexicon_count(spark, d):
    return t(spark, d, "documents").select("doc_id", text.count_terms(F.lower("text"), WORDS).alias("n"))


@query("SELECT doc_id, CAST(100 * CAST(contains(lower(text), 'license') AS INT) + 15 * CAST(contains(lower(text), 'the') AS INT) + 15 * CAST(contains(lower(text), 'der') AS INT) AS INT) AS points FROM documents")
def lexicon_weighted(spark, d):
    return t(spark, d, "documents").select("doc_id", text.weighted_terms(F.lower("text"), [("license", 100), ("the", 15), ("der", 15)]).alias("points"))


@query(
    """WITH x AS (SELECT doc_id, lower(substr(text, 1, 3000)) AS low, lower(source) AS title, source FROM documents),
    n AS (SELECT *, CAST(contains(low, 'alpha') AS INT) + CAST(contains(low, 'program magang') AS INT) + CAST(contains(low, 'mahasiswa magang') AS INT) + CAST(contains(low, 'internship program') AS INT)
          + CAST(regexp_matches(low, '(^|[^\\p{L}\\p{N}_])and([^\\p{L}\\p{N}_]|$)') AS INT) + CAST(regexp_matches(low, '(^|[^\\p{L}\\p{N}_])und([^\\p{L}\\p{N}_]|$)') AS INT) + CAST(regexp_matches(low, '(^|[^\\p{L}\\p{N}_])der([^\\p{L}\\p{N}_]|$)') AS INT) - CAST(contains(low, 'alpha') AS INT) AS strong,
          CAST(contains(title, 'src1') AS INT) AS other, CAST(contains(low, 'que') AS INT) AS weak FROM x)
    SELECT doc_id, CASE WHEN contains(low, 'worthless') OR contains(low, 'disgusting') THEN 'hard_reject' WHEN contains(title, 'src7') THEN 'likely_not_job' WHEN strong >= 2 THEN 'description_strong' WHEN strong >= 1 AND other = 0 THEN 'description_single_strong'
           WHEN strong >= 1 AND weak >= 1 THEN 'description_weak_plus_strong' WHEN other > 0 AND strong = 0 THEN 'non_internship_title' ELSE 'no_signal' END AS source_rule,
           CAST(CASE WHEN contains(low, 'worthless') OR contains(low, 'disgusting') OR contains(title, 'src7') THEN 0 WHEN strong >= 2 THEN least(strong * 15 + 30, 85) WHEN strong >= 1 AND other = 0 THEN 60 WHEN strong >= 1 AND weak >= 1 THEN 55 ELSE 0 END AS INT) AS confidence FROM n"""
)
def decision_list_gate(spark, d):
    lexicon = Lexicon(strong=("and", "und", "der"), weak=("que",), non_internship=("src1",), hard_reject=("worthless", "disgusting"), likely_not_job=("src7",))
    rows = t(spark, d, "documents").withColumn("g", classify.internship("text", "source", lexicon))
    return rows.select("doc_id", F.col("g.source").alias("source_rule"), F.col("g.confidence").alias("confidence"))


@query(
    """WITH x AS (SELECT doc_id, lower(text) AS t, lower(substr(text, 1, 1500)) AS h FROM documents),
    r AS (SELECT doc_id, CASE WHEN contains(t, 'license') AND NOT contains(t, 'mit ') THEN 70 + 10 * CAST(contains(h, 'apache') AS INT) END AS a,
          CASE WHEN (contains(t, 'the ') OR contains(t, 'der ')) AND NOT contains(t, 'les ') THEN 70 + 10 * CAST(contains(h, 'and ') AS INT) + 10 * CAST(contains(h, 'of ') AS INT) END AS b,
          CASE WHEN contains(t, 'les ') THEN 70 + 10 * CAST(contains(h, 'des ') AS INT) END AS c FROM x)
    SELECT doc_id, CAST(coalesce(greatest(a, b, c), 0) AS INT) AS confidence, CASE WHEN greatest(a, b, c) IS NULL THEN NULL WHEN a = greatest(a, b, c) THEN 'Frontend Developer' WHEN b = greatest(a, b, c) THEN 'Backend Developer' ELSE 'Actuarial' END AS role FROM r"""
)
def label_by_best_rule(spark, d):
    rows = t(spark, d, "documents").withColumn("r", classify.role("text", "text", LEXICON))
    return rows.select("doc_id", F.col("r.confidence").alias("confidence"), F.col("r.name").alias("role"))


@query(
    """WITH n AS (SELECT lower(n_name) AS term, n_nationkey AS ord, r_name AS area, n_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey), x AS (SELECT doc_id, lower(substr(text, 1, 3000)) || ' nation_' || (doc_id % 25) AS low FROM documents)
    SELECT doc_id, arg_min(city, ord) AS city, arg_min(area, ord) AS area FROM x JOIN n ON contains(low, term) GROUP BY doc_id"""
)
def area_lookup(spark, d):
    names = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("term"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("city"), F.col("r_name").alias("area"))
    docs = t(spark, d, "documents").select("doc_id", F.concat(text.lowered("text", 3000), F.lit(" nation_"), (F.col("doc_id") % 25).cast("string")).alias("low"))
    found = docs.join(F.broadcast(names), F.contains("low", "term"))  # a lexicon: the names of nations
    return found.groupBy("doc_id").agg(F.min_by("city", "ord").alias("city"), F.min_by("area", "ord").alias("area"))


@query(
    """WITH x AS (SELECT doc_id, lower(substr(text, 1, 3000)) AS low, lower(substr(text, 1, 5000)) AS l5, text, doc_id % 3 AS k FROM documents), y AS (SELECT *, CASE k WHEN 0 THEN 'full_detail' WHEN 1 THEN 'listing_card' ELSE 'search_snippet' END AS depth FROM x)
    SELECT doc_id, CASE WHEN regexp_matches(low, '\\b(wfo|onsite)\\b') THEN 'onsite' WHEN contains(low, 'hybrid') THEN 'hybrid' WHEN contains(low, 'ing ') THEN 'hybrid' WHEN contains(low, 'keit') THEN 'remote' WHEN contains(low, 'tion') THEN 'onsite' END AS work_mode,
           CASE WHEN regexp_matches(l5, '\\bexpired\\b') THEN 'closed' WHEN depth = 'listing_card' THEN 'listed' WHEN depth = 'search_snippet' THEN 'unknown' WHEN contains(l5, 'apply') OR contains(l5, 'lamar') OR contains(l5, 'daftar') OR contains(l5, 'listed') OR contains(l5, 'posted') THEN 'active' ELSE 'unknown' END AS active_status,
           CASE WHEN k = 0 AND doc_id % 2 = 0 THEN 'provided' WHEN depth <> 'full_detail' THEN 'unknown_due_to_partial_extraction' WHEN contains(l5, 'closed') OR contains(l5, 'ditutup') OR contains(l5, 'expired') THEN 'invalid' ELSE 'not_provided' END AS field_status,
           CASE depth WHEN 'full_detail' THEN 'verified_detail' WHEN 'listing_card' THEN 'listed_only' ELSE 'search_index_only' END AS verification FROM y"""
)
def mode_and_status(spark, d):
    k = F.col("doc_id") % 3
    rows = t(spark, d, "documents").withColumn("depth", F.when(k == 0, "full_detail").when(k == 1, "listing_card").otherwise("search_snippet")).withColumn("value", F.when((k == 0) & (F.col("doc_id") % 2 == 0), "x"))
    return rows.select("doc_id", fields.work_mode("text", LEXICON).alias("work_mode"), fields.active_status("depth", "text").alias("active_status"), fields.field_status("value", "text", "depth", "deadline").alias("field_status"), fields.verification_level("depth").alias("verification"))


@query(
    """WITH x AS (SELECT d.doc_id, text, source, quality, CASE WHEN d.doc_id % 3 = 0 THEN 'full_detail' WHEN d.doc_id % 3 = 1 THEN 'listing_card' ELSE 'search_snippet' END AS depth FROM documents d JOIN labels USING (doc_id))
    SELECT doc_id, depth, CASE WHEN depth = 'full_detail' AND quality = 1 AND length(text) >= 80 THEN 'high' WHEN depth = 'listing_card' AND quality = 1 THEN 'medium' WHEN depth = 'search_snippet' AND quality = 1 AND length(text) >= 80 THEN 'medium' ELSE 'low' END AS tier FROM x"""
)
def quality_tier(spark, d):
    method = F.when(F.col("doc_id") % 3 == 1, "jobstreet-card-fallback")
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("method", method).withColumn("platform", F.when(F.col("doc_id") % 3 == 2, "linkedin"))
    rows = rows.withColumn("depth", fields.extraction_depth("method", "platform"))
    return rows.select("doc_id", "depth", fields.quality_tier("depth", F.lit(70), F.col("quality") * 70, "text", "source").alias("tier"))


@query(
    """WITH x AS (SELECT p_partkey, p_size % 3 AS k, CASE p_size % 6 WHEN 0 THEN 'game' WHEN 1 THEN 'mobile' WHEN 2 THEN 'qa' WHEN 3 THEN 'data' WHEN 4 THEN 'backend' ELSE 'general' END AS s FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN 'tech' WHEN 1 THEN 'data' ELSE 'general' END AS family, s AS specialization, CASE k WHEN 0 THEN CASE WHEN s IN ('data', 'qa') THEN s ELSE 'software_engineering' END WHEN 1 THEN 'data' END AS grp FROM x"""
)
def taxonomy(spark, d):
    k, w = F.col("p_size") % 3, F.col("p_size") % 6
    words = F.when(w == 0, " Unity artist").when(w == 1, " Android").when(w == 2, " Tester").when(w == 3, " BI").when(w == 4, " API").otherwise(" cook")
    rows = t(spark, d, "part").withColumn("x", fields.taxonomy("p_brand", F.concat("p_name", words), "p_type", F.when(k == 0, "tech").when(k == 1, "data")))
    return rows.select("p_partkey", F.col("x.family").alias("family"), F.col("x.specialization").alias("specialization"), F.col("x.grp").alias("grp"))


@query(
    """WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Frontend Developer' WHEN 1 THEN 'AI/ML Engineer' WHEN 2 THEN 'UI/UX Designer' WHEN 3 THEN 'Actuarial' ELSE 'Other Role' END AS role, CASE p_size % 5 WHEN 0 THEN 'front-end' WHEN 1 THEN 'Machine Learning' WHEN 2 THEN 'uiux' WHEN 3 THEN 'Aktuaria' ELSE 'some thing' END AS wanted FROM part)
    SELECT p_partkey, role, CASE role WHEN 'Frontend Developer' THEN 'tech' WHEN 'AI/ML Engineer' THEN 'data' WHEN 'UI/UX Designer' THEN 'design' WHEN 'Actuarial' THEN 'actuarial' END AS category,
           CASE role WHEN 'Frontend Developer' THEN 'frontend' WHEN 'AI/ML Engineer' THEN 'ai_ml' WHEN 'UI/UX Designer' THEN 'ui_ux' WHEN 'Actuarial' THEN 'actuarial' ELSE 'other_role' END AS role_key,
           CASE wanted WHEN 'front-end' THEN 'frontend' WHEN 'Machine Learning' THEN 'ai_ml' WHEN 'uiux' THEN 'ui_ux' WHEN 'Aktuaria' THEN 'actuarial' ELSE 'some_thing' END AS target FROM r"""
)
def category_map_join(spark, d):
    k = F.col("p_size") % 5
    of = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).when(k == 3, v[3]).otherwise(v[4])
    rows = t(spark, d, "part").withColumn("role", of("Frontend Developer", "AI/ML Engineer", "UI/UX Designer", "Actuarial", "Other Role")).withColumn("wanted", of("front-end", "Machine Learning", "uiux", "Aktuaria", "some thing"))
    return rows.select("p_partkey", "role", classify.category("role").alias("category"), classify.role_key("role").alias("role_key"), classify.target("wanted").alias("target"))


_SHOWN = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%d %B %Y') END"


def _dated(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "dd-MM-yyyy")).otherwise(F.date_format(day, "dd MMMM yyyy"))
    return t(spark, d, "orders").withColumn("shown", shown)


@query("SELECT o_orderkey, " + _SHOWN + " AS deadline, date_trunc('day', o_orderdate) AS day FROM orders")
def date_multi_format(spark, d):
    rows = _dated(spark, d).withColumn("deadline", fields.deadline(F.concat(F.lit("Apply soon. Deadline: "), "shown", F.lit(" at noon"))))
    return rows.select("o_orderkey", "deadline", fields.deadline_time("deadline").cast("timestamp_ntz").alias("day"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) < TIMESTAMP '1996-01-01' AS expired FROM orders")
def expired_flag(spark, d):
    return _dated(spark, d).select("o_orderkey", fields.is_expired("shown", F.lit("1996-01-01").cast("timestamp")).alias("expired"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 40 BETWEEN 1 AND 24 THEN (o_orderkey % 40) || ' bulan' END AS duration, CASE o_orderkey % 3 WHEN 0 THEN 'Rp' || (o_orderkey % 9 + 1) || '.000.000' WHEN 1 THEN (o_orderkey % 9 + 1) || ' - ' || (o_orderkey % 9 + 3) || ' juta' ELSE (o_orderkey % 9 + 1) || ' juta' END AS salary,
       CASE o_orderkey % 3 WHEN 1 THEN 'Rp' || (o_orderkey % 9 + 1) || '.000.000 - Rp' || replace(CASE WHEN o_orderkey % 9 + 3 > 9 THEN (o_orderkey % 9 + 3)::VARCHAR ELSE (o_orderkey % 9 + 3)::VARCHAR END, ',', '.') || '.000.000' ELSE 'Rp' || (o_orderkey % 9 + 1) || '.000.000' END AS display,
       CAST((o_orderkey % 9 + 1) * 1000000 AS BIGINT) AS low, CAST(CASE o_orderkey % 3 WHEN 1 THEN (o_orderkey % 9 + 3) ELSE (o_orderkey % 9 + 1) END * 1000000 AS BIGINT) AS high, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 80 ELSE 50 END AS INT) AS confidence FROM orders"""
)
def salary_and_duration(spark, d):
    key, n = F.col("o_orderkey"), (F.col("o_orderkey") % 9 + 1).cast("string")
    pay = F.when(key % 3 == 0, F.concat(F.lit("Rp"), n, F.lit(".000.000"))).when(key % 3 == 1, F.concat(n, F.lit(" - "), (key % 9 + 3).cast("string"), F.lit(" juta"))).otherwise(F.concat(n, F.lit(" juta")))
    body = F.concat(F.lit("Magang "), (key % 40).cast("string"), F.lit(" bulan\n"), F.when(key % 2 == 0, "Gaji: ").otherwise("Bayar: "), pay)
    rows = t(spark, d, "orders").withColumn("body", body).withColumn("salary", fields.salary("body")).withColumn("confidence", fields.salary_confidence("body", "salary"))
    rows = rows.withColumn("s", fields.salary_struct("salary", F.col("confidence")))
    return rows.select("o_orderkey", fields.duration("body").alias("duration"), "salary", F.col("s.display").alias("display"), F.col("s.low").alias("low"), F.col("s.high").alias("high"), "confidence")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'PT ' || s_name END AS company, s_suppkey % 3 <> 2 AND length(s_name) BETWEEN 2 AND 80 AS valid FROM supplier")
def company_extract(spark, d):
    k = F.col("s_suppkey") % 3
    title = F.when(k == 0, F.concat("s_name", F.lit(" membuka lowongan magang"))).otherwise("Intern")
    body = F.when(k == 1, F.concat(F.lit("Info\nPerusahaan: PT "), "s_name")).otherwise("assist! us")
    rows = t(spark, d, "supplier").withColumn("company", fields.company(body, title))
    return rows.select("s_suppkey", "company", fields.is_valid_company("company").alias("valid"))


# Scores and ranks

_DOC_SCORE = """WITH x AS (SELECT d.doc_id, lower(text) AS low, quality, toxic, lang FROM documents d JOIN labels USING (doc_id)),
    p AS (SELECT doc_id, 30 * CAST(contains(low, 'the') AS INT) AS internship_score, 25 * quality AS role_match_score, 10 * CAST(lang = 'en' AS INT) AS metadata_completeness_score, CASE WHEN contains(low, 'worthless') THEN -40 WHEN contains(low, 'disgusting') THEN -35 ELSE 0 END - 50 * toxic AS penalty_score FROM x)"""


@query(_DOC_SCORE + " SELECT doc_id, CAST(internship_score AS INT) AS internship_score, CAST(role_match_score AS INT) AS role_match_score, CAST(penalty_score AS INT) AS penalty_score, CAST(metadata_completeness_score AS INT) AS metadata_completeness_score, CAST(greatest(0, least(100, internship_score + role_match_score + metadata_completeness_score + penalty_score)) AS INT) AS final_score FROM p")
def score_breakdown(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("low", F.lower("text"))
    parts = {
        "internship": score.points((text.contains_any("low", ("the",)), 30)), "role_match": F.col("quality") * 25, "metadata_completeness": score.points((F.col("lang") == "en", 10)),
        "penalty": score.first_points(F.col("low"), [("worthless", -40), ("disgusting", -35)]) - F.col("toxic") * 50,
    }
    b = F.col("score_breakdown")
    return score.with_total(rows, parts).select("doc_id", b["internship_score"].alias("internship_score"), b["role_match_score"].alias("role_match_score"), b["penalty_score"].alias("penalty_score"), b["metadata_completeness_score"].alias("metadata_completeness_score"), b["final_score"].alias("final_score"))


@query("SELECT count(*) FILTER (WHERE c_acctbal >= 75) AS high, count(*) FILTER (WHERE c_acctbal >= 40 AND c_acctbal < 75) AS mid, count(*) FILTER (WHERE c_acctbal < 40) AS low FROM customer")
def score_tiers(spark, d):
    return score.tiers(t(spark, d, "customer"), "c_acctbal")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 20) ORDER BY o_orderkey LIMIT 60")
def cap_per_group(spark, d):
    return rank.cap(t(spark, d, "orders"), "o_orderpriority", [F.asc("o_orderkey")], 20, 60).select("o_orderkey", "o_orderpriority")


@query(
    """WITH r AS (SELECT s_suppkey, n_name AS grp, CAST(floor(s_acctbal) AS BIGINT) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, s_suppkey) AS rn FROM r WHERE score >= 0),
    l AS (SELECT *, CASE WHEN rn = 1 THEN row_number() OVER (PARTITION BY rn ORDER BY score DESC, s_suppkey) END AS lead FROM k), f AS (SELECT *, CASE WHEN rn = 1 AND lead <= 6 THEN 1 ELSE 2 END AS phase FROM l WHERE rn <= CASE grp WHEN 'NATION_3' THEN 1 WHEN 'NATION_5' THEN 2 ELSE 40 END)
    SELECT s_suppkey, grp, CAST(phase AS INT) AS phase, CAST(row_number() OVER (ORDER BY phase, score DESC, s_suppkey) AS INT) AS place FROM f ORDER BY phase, score DESC, s_suppkey LIMIT 40"""
)
def diversified_rank(spark, d):
    rows = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("grp"), F.floor("s_acctbal").alias("score"))
    return rank.diversified(rows, "grp", "score", "s_suppkey", 40, {"NATION_3": 1, "NATION_5": 2}).select("s_suppkey", "grp", "phase", "place")


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS grp, CAST(floor(o_totalprice) AS BIGINT) AS score FROM orders), g AS (SELECT grp, count(*) AS n, min(o_orderkey) AS f FROM r GROUP BY grp),
    i AS (SELECT grp, row_number() OVER (ORDER BY n DESC, f) AS p, greatest(3, ceil(50.0 / count(*) OVER ())) AS quota FROM g), k AS (SELECT r.*, p, quota, row_number() OVER (PARTITION BY r.grp ORDER BY score DESC, o_orderkey) AS rn FROM r JOIN i USING (grp)),
    o AS (SELECT *, row_number() OVER (ORDER BY rn > quota, CASE WHEN rn <= quota THEN rn ELSE p END, CASE WHEN rn <= quota THEN p ELSE rn END) AS place FROM k) SELECT o_orderkey, grp, CAST(place AS INT) AS place FROM o WHERE place <= 50"""
)
def quota_round_robin(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"), F.floor("o_totalprice").alias("score"))
    return rank.round_robin(rows, "grp", "score", "o_orderkey", 50).select("o_orderkey", "grp", "place")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey")
def stable_priority(spark, d):
    return rank.prioritized(t(spark, d, "part"), "p_size", "p_partkey").select("p_partkey", "p_size")


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def argmax_by_key(spark, d):
    return rank.first_of_each(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(
    """WITH x AS (SELECT doc_id, 'http://h.example/' || (doc_id // 2) AS url, n_chars AS score, """ + _NORM.format(c="source") + """ || '|' || '' || '|' || """ + _NORM.format(c="lang") + """ || '|' || """ + _NORM.format(c="text") + """ AS k FROM documents),
    u AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, doc_id) = 1) SELECT doc_id, md5(k) AS canonical_key FROM u QUALIFY row_number() OVER (PARTITION BY md5(k) ORDER BY score DESC, doc_id) = 1"""
)
def exact_dedupe_two_stage(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.concat(F.lit("http://h.example/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("source_url"), F.col("n_chars").alias("score"), F.col("doc_id").alias("ord"), F.col("text").alias("title"), F.col("source").alias("company"), F.lit(None).cast("string").alias("role"), F.col("lang").alias("location"))
    return dedupe.exact(rows).select("doc_id", "canonical_key")


def _names(spark, d):
    """The whole titles of pages, by language of their url's path."""
    return t(spark, d, "pages").select("page_id", html.title("html").alias("title"), F.regexp_extract(urls.path("url"), "^/([^/]*)", 1).alias("role"))


@query()
def fuzzy_dup_pairs(spark, d):
    return dedupe.similar_pairs(_names(spark, d), "page_id", "title", "role").select("a", "b")


@query()
def greedy_fuzzy_dedupe(spark, d):
    rows = _names(spark, d)
    return dedupe.greedy(rows, dedupe.similar_pairs(rows, "page_id", "title", "role"), "page_id", [F.col("page_id")]).select("page_id", "title")


# Joins


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_new_rows(spark, d):
    return lookup.new_rows(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_known_rows(spark, d):
    return lookup.known_rows(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT o_orderkey AS ord, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'fetched' ELSE 'cached' END AS origin FROM orders JOIN customer ON o_custkey = c_custkey")
def ordered_lookup(spark, d):
    cached = t(spark, d, "customer").select("c_custkey").withColumn("origin", F.lit("cached"))
    fetched = cached.filter("c_custkey % 2 = 0").withColumn("origin", F.lit("fetched"))
    wanted = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("ord"))
    return lookup.in_order(wanted, cached, fetched, key="c_custkey").select("ord", "c_custkey", "origin")


@query("SELECT o_orderkey, CAST(arg_max(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS VARCHAR) AS listing_url FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def source_attribution(spark, d):
    key = lambda c: F.col(c).cast("string")
    details = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("https://h.example/o/"), key("o_orderkey"), F.lit("?utm_source=x")).alias("url"))
    links = t(spark, d, "lineitem").select(F.concat(F.lit("https://H.example/o/"), key("l_orderkey"), F.lit("/#a")).alias("url"), key("l_suppkey").alias("listing_url"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("ord"))
    return lookup.attribute(details, links).select("o_orderkey", "listing_url")


@query("SELECT o_orderkey AS id, c_custkey AS opportunity_id, o_orderstatus AS status, c_name AS title, c_mktsegment AS company, CAST(floor(c_acctbal) AS BIGINT) AS score FROM orders JOIN customer ON o_custkey = c_custkey")
def applications_join(spark, d):
    applications = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("opportunity_id"), F.col("o_orderstatus").alias("status"))
    return lookup.board(applications, t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("company"), F.floor("c_acctbal").alias("score")))


@query("SELECT '\"' || n_name || '\" \"' || r_name || '\"' AS query, CAST(n_nationkey * 1000 + r_regionkey AS BIGINT) AS ord FROM nation, region")
def cross_expand_plan(spark, d):
    terms = t(spark, d, "nation").select(F.col("n_name").alias("term"), F.col("n_nationkey").cast("long").alias("term_ord"))
    forms = t(spark, d, "region").select(F.concat(F.lit('"{term}" "'), "r_name", F.lit('"')).alias("template"), F.col("r_regionkey").alias("template_ord"), F.lit("").alias("location"))
    return lookup.expand(terms, forms)


# Changes

_EVENTS = "SELECT CAST(user_id AS BIGINT) AS user_id, event_type, value, event_id FROM events"


def _events(spark, d):
    return t(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_type", "value", "event_id")


@query("WITH e AS (" + _EVENTS + "), o AS (SELECT * FROM e WHERE event_id < 5000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1), b AS (SELECT * FROM e WHERE event_id >= 5000 AND user_id NOT IN (SELECT user_id FROM o) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) SELECT * FROM o UNION ALL SELECT * FROM b")
def upsert_ignore(spark, d):
    e = _events(spark, d)
    return upsert.upsert(rank.first_of_each(e.filter("event_id < 5000"), ["user_id"], ["event_id"]), e.filter("event_id >= 5000"), ["user_id"], "ignore", "event_id")


@query("WITH e AS (" + _EVENTS + ") SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_replace(spark, d):
    e = _events(spark, d)
    return upsert.upsert(rank.first_of_each(e.filter("event_id < 5000"), ["user_id", "event_type"], [F.desc("event_id")]), e.filter("event_id >= 5000"), ["user_id", "event_type"], "replace", "event_id")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, arg_min(event_type, event_id) AS event_type, max(value) AS score, max(event_id) AS last_seen, min(event_id) AS ord FROM events GROUP BY user_id")
def upsert_max_score(spark, d):
    e = _events(spark, d).select("user_id", "event_type", F.col("value").alias("score"), F.col("event_id").alias("last_seen"), F.col("event_id").alias("ord"))
    empty = e.limit(0)
    first = upsert.upsert(empty, e.filter("ord < 5000"), ["user_id"], "max_score", "ord")
    return upsert.upsert(first, e.filter("ord >= 5000"), ["user_id"], "max_score", "ord")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'done' ELSE 'pending' END AS status FROM orders")
def status_update(spark, d):
    queue = t(spark, d, "orders").select("o_orderkey", F.lit("pending").alias("status"))
    return upsert.set_status(queue, t(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


# Counters and gates


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_platform(spark, d):
    return metrics.counts(t(spark, d, "events"), "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY event_type")
def filtered_counters(spark, d):
    return metrics.counts(t(spark, d, "events"), "event_type", where=F.col("value") >= 50)


@query("WITH a AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS g FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_orderpriority, n - coalesce(g, 0) AS failed FROM a LEFT JOIN b USING (o_orderpriority) WHERE n - coalesce(g, 0) > 0")
def failures_by_group(spark, d):
    o = t(spark, d, "orders")
    return metrics.failures(o, o.filter("o_orderstatus = 'F'"), "o_orderpriority")


@query("SELECT event_type, CAST(user_id % 7 AS VARCHAR) AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def nested_reason_counts(spark, d):
    return metrics.nested_counts(t(spark, d, "events").withColumn("reason", (F.col("user_id") % 7).cast("string")), "event_type", "reason")


@query("SELECT CAST(user_id % 10 AS BIGINT) AS grp, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def stage_pivot(spark, d):
    return metrics.stage_matrix(t(spark, d, "events").withColumn("grp", (F.col("user_id") % 10).cast("long")), "grp", "event_type", ["view", "click", "purchase"])


@query("SELECT CAST(user_id % 50 AS BIGINT) AS listing_url, count(*) AS links, count(*) FILTER (WHERE event_type = 'view') AS dom_links, count(*) FILTER (WHERE event_type = 'click') AS script_links, count(*) FILTER (WHERE event_type = 'error') AS api_links, count(*) FILTER (WHERE value > 50) AS target_links FROM events GROUP BY 1")
def link_diagnostics(spark, d):
    method = text.mapped("event_type", {"view": "dom", "click": "script", "error": "api"}, F.lit("other"))
    links = t(spark, d, "events").select((F.col("user_id") % 50).cast("long").alias("listing_url"), method.alias("discovery_method"), (F.col("value") - 50).alias("target_score"))
    return metrics.link_diagnostics(links)


@query("SELECT source, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def distribution_top15_pct(spark, d):
    return metrics.distribution(t(spark, d, "documents"), "source")


@query("SELECT count(*) FILTER (WHERE CAST(o_orderdate AS DATE) = DATE '1996-03-05') AS new_today FROM orders")
def new_today(spark, d):
    return metrics.seen_on(t(spark, d, "orders"), "1996-03-05", "o_orderdate")


_FLAGS = "count(DISTINCT event_type) AS platforms, count(*) AS total, count(DISTINCT event_type) = 1 AS single_source, count(DISTINCT event_type) <= 1 AND count(*) > 1 AS dashboard_warning, count(DISTINCT event_type) = 1 AND count(*) > 1 AS gate_warning"


@query(f"SELECT {_FLAGS} FROM events UNION ALL SELECT {_FLAGS} FROM events WHERE event_type = 'view' UNION ALL SELECT {_FLAGS} FROM events WHERE value < 0")
def diversity_flags(spark, d):
    e = t(spark, d, "events")
    return metrics.diversity(e, "event_type").union(metrics.diversity(e.filter("event_type = 'view'"), "event_type")).union(metrics.diversity(e.filter("value < 0"), "event_type"))


@query("SELECT text, count(*) AS n FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return metrics.duplicates(t(spark, d, "documents"), "text")


@query(
    """WITH x AS (SELECT quality = 1 AS a, length(text) > 400 AS b FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn, count(*) FILTER (WHERE NOT a AND NOT b) AS tn FROM x)
    SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM n"""
)
def confusion_matrix(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("a"), (F.length("text") > 400).alias("b"))
    return metrics.confusion(rows, "a", "b")


@query(
    """SELECT doc_id, 'SHORT' AS rule, true AS hard FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'LICENSE', false FROM documents WHERE contains(text, 'icense') UNION ALL SELECT doc_id, 'SHOUT', true FROM documents WHERE contains(text, '!!')"""
)
def gate_issues(spark, d):
    rules = [metrics.Rule("SHORT", F.col("n_chars") < 200), metrics.Rule("LICENSE", F.contains("text", F.lit("icense")), False), metrics.Rule("SHOUT", F.contains("text", F.lit("!!")))]
    found = metrics.issues(t(spark, d, "documents"), rules, "doc_id")
    return found.select(F.col("subject").cast("long").alias("doc_id"), "rule", "hard")


@query(
    """SELECT count(*) FILTER (WHERE n_chars < 200) AS issues, count(*) FILTER (WHERE contains(text, 'icense')) AS warnings, CASE WHEN count(*) FILTER (WHERE n_chars < 200) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE contains(text, 'icense')) > 0 THEN 'PASS WITH WARNINGS' ELSE 'PASS' END AS verdict FROM documents
    UNION ALL SELECT 0, count(*), 'PASS WITH WARNINGS' FROM documents UNION ALL SELECT 0, 0, 'PASS'"""
)
def gate_verdict(spark, d):
    of = lambda *rules: metrics.verdict(metrics.issues(t(spark, d, "documents"), list(rules), "doc_id"))
    return of(metrics.Rule("SHORT", F.col("n_chars") < 200), metrics.Rule("LICENSE", F.contains("text", F.lit("icense")), False)).union(of(metrics.Rule("ANY", F.col("n_chars") >= 0, False))).union(of(metrics.Rule("NONE", F.col("n_chars") < 0)))


@query("SELECT count(*) AS total, max(o_totalprice) AS max_score, count(DISTINCT o_orderpriority) AS sources FROM orders")
def global_stats(spark, d):
    return metrics.global_stats(t(spark, d, "orders"), "o_totalprice", "o_orderpriority")


@query("SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS ratio FROM orders GROUP BY o_custkey")
def safe_ratio(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(text.safe_ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("ratio"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'TP' WHEN quality = 0 AND toxic = 0 THEN 'FP' WHEN quality = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM labels")
def outcome_labels(spark, d):
    return t(spark, d, "labels").select("doc_id", fields.outcome(F.col("quality") == 1, F.col("toxic") == 0).alias("outcome"))


# JSON


@query(
    """SELECT event_id, 0 AS pos, 'object' AS kind, NULL AS value, 'T' || event_id AS title, NULL AS k FROM events UNION ALL SELECT event_id, 1, 'string', 'T' || event_id, NULL, NULL FROM events UNION ALL
    SELECT event_id, 2, 'object', NULL, 'n', json_extract_string(props, '$.k') FROM events UNION ALL SELECT event_id, 3, 'string', 'n', NULL, NULL FROM events UNION ALL SELECT event_id, 4, 'scalar', json_extract_string(props, '$.k'), NULL, NULL FROM events UNION ALL
    SELECT event_id, 5, 'scalar', NULL, NULL, NULL FROM events"""
)
def json_scalar_walk(spark, d):
    body = F.concat(F.lit('{"Job-Title": "T'), F.col("event_id").cast("string"), F.lit('", "x": [{"name": "n", "k": '), F.get_json_object("props", "$.k"), F.lit("}, null]}"))
    nodes = html.json_nodes(t(spark, d, "events").select("event_id", body.alias("body")), "event_id", "body")
    return nodes.select("event_id", "pos", "kind", "value", html.field_of(F.col("fields"), html.TITLE_KEYS).alias("title"), html.field_of(F.col("fields"), ("k",)).alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_roundtrip(spark, d):
    back = F.from_json(F.to_json(F.from_json("props", "k long"), {"ignoreNullFields": "false"}), "k long")
    return t(spark, d, "events").select("event_id", back["k"].alias("k"))


# Reading


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'standard') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')")
def role_text_filter(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("role"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("location"))
    return lookup.filter_list(rows, "Standard", "brand#1").select("p_partkey")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def saved_kanban(spark, d):
    saved = lookup.known_rows(t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey")
    return metrics.counts(saved.withColumnRenamed("o_orderstatus", "status"), "status")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS q, CASE s_suppkey % 2 WHEN 0 THEN 0 ELSE 3 END AS a, s_acctbal FROM supplier) ORDER BY q, a, s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 20")
def default_sort_page(spark, d):
    rows = t(spark, d, "supplier").withColumn("q", F.when(F.col("s_suppkey") % 3 == 0, "high").when(F.col("s_suppkey") % 3 == 1, "medium").otherwise("low")).withColumn("a", F.when(F.col("s_suppkey") % 2 == 0, "active").otherwise("closed"))
    return rank.page_of(rows, rank.default_order("q", "a", "s_acctbal", "s_suppkey"), 2, 20).select("s_suppkey")


@query("SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text || ' ' || source), '[^\\p{L}\\p{N}_]+'), ['the', 'src1'])")
def token_search(spark, d):
    return lookup.search(t(spark, d, "documents"), "the src1", ["text", "source"]).select("doc_id")


@query("SELECT w AS token, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def token_index(spark, d):
    return lookup.token_index(t(spark, d, "documents"), "doc_id", ["text"]).groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS title, 'medium' AS dashboard_quality, 'unknown' AS active_status, CAST(floor(o_totalprice) AS INT) AS score, 'Tidak dicantumkan' AS display_location FROM orders")
def read_model(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.floor("o_totalprice").alias("score"), F.lit("src").alias("source_platform"))
    return export.dashboard_rows(rows).select("id", "title", "dashboard_quality", "active_status", "score", "display_location")


@query("SELECT platform, CASE platform WHEN 'lokerid' THEN 'Loker.id' WHEN 'linkedin' THEN 'LinkedIn' ELSE upper(platform[1]) || lower(platform[2:]) END AS label, count(*) AS n FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'lokerid' WHEN 1 THEN 'linkedin' ELSE event_type END AS platform FROM events) GROUP BY platform")
def label_maps(spark, d):
    k = F.col("user_id") % 3
    rows = t(spark, d, "events").withColumn("platform", F.when(k == 0, "lokerid").when(k == 1, "linkedin").otherwise(F.col("event_type")))
    return rows.groupBy("platform").agg(F.count("*").alias("n")).withColumn("label", fields.platform_label("platform"))


# Streams

_DAILY = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query(_DAILY)
def windowed_counts(spark, d):
    return ingest.windowed_counts(t(spark, d, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, arg_min(event_type, event_id) AS event_type, max(value) AS score, max(event_id) AS last_seen, min(event_id) AS ord FROM events GROUP BY user_id")
def stream_equals_batch(spark, d):
    """The stored table after a stream of the events has been read to its end."""
    base = dedupe.shared_folder(spark)
    source = _events(spark, d).select("user_id", "event_type", F.col("value").alias("score"), F.col("event_id").alias("last_seen"), F.col("event_id").alias("ord"))
    source.repartitionByRange(2, "ord").write.parquet(f"{base}/in")
    store = upsert.Store(spark, f"{base}/table", source.schema)
    ingest.ingest(spark, f"{base}/in", source.schema, store, ["user_id"], "max_score", "ord", f"{base}/checkpoint")
    return store.read()




_QUEUE = """
    WITH e AS (SELECT event_id AS seq, 'https://jobs.example/' || user_id || '/' || CAST(floor(value / 10) AS BIGINT) AS url, props AS title, CAST(floor(value) AS INT) AS target_score, ts,
                      CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'claim' WHEN 'error' THEN 'release' ELSE 'found' END AS event FROM events),
    q AS (SELECT url, min(seq) FILTER (WHERE event = 'found') AS found_seq, arg_min(title, seq) FILTER (WHERE event = 'found') AS title, arg_min(target_score, seq) FILTER (WHERE event = 'found') AS target_score,
                 max(seq) FILTER (WHERE event = 'done') AS done_seq, max(seq) FILTER (WHERE event IN ('claim', 'release')) AS lease_seq,
                 arg_max(CASE event WHEN 'claim' THEN ts + INTERVAL 10 DAY ELSE TIMESTAMP '1970-01-01' END, seq) FILTER (WHERE event IN ('claim', 'release')) AS leased_until FROM e GROUP BY url)
    SELECT url, title, target_score, CASE WHEN done_seq > found_seq THEN 'done' WHEN lease_seq > found_seq AND leased_until > TIMESTAMP '2024-01-30' THEN 'leased' ELSE 'pending' END AS status
    FROM q WHERE found_seq IS NOT NULL"""


def _queue_events(spark, d):
    kind = F.col("event_type")
    return t(spark, d, "events").select(
        F.concat(F.lit("https://jobs.example/"), F.col("user_id").cast("string"), F.lit("/"), F.floor(F.col("value") / 10).cast("string")).alias("url"), F.when(kind == "purchase", "done").when(kind == "click", "claim").when(kind == "error", "release").otherwise("found").alias("event"),
        F.col("event_id").alias("seq"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("until"), F.col("props").alias("title"), F.lit(None).cast("string").alias("company"), kind.alias("source_platform"), F.lit(None).cast("string").alias("listing_url"),
        F.lit("dom").alias("discovery_method"), F.floor("value").cast("int").alias("target_score"),
    )


def _queue_shown(table):
    return queue.with_status(table, F.lit("2024-01-30").cast("timestamp")).select("url", "title", "target_score", "status")


@query(_QUEUE)
def crawl_queue(spark, d):
    """The queue after two batches of events, the later one first."""
    happened = _queue_events(spark, d)
    later = queue.apply(spark.createDataFrame([], queue.SCHEMA), happened.filter("seq % 2 = 1"))
    return _queue_shown(queue.apply(later, happened.filter("seq % 2 = 0")))


@query(_QUEUE)
def crawl_queue_stream(spark, d):
    """The stored queue after a stream of the events has been read to its end."""
    base = dedupe.shared_folder(spark)
    _queue_events(spark, d).repartition(2, "url").write.parquet(f"{base}/in")
    store = upsert.Store(spark, f"{base}/queue", spark.createDataFrame([], queue.SCHEMA).schema)
    ingest.keep_queue(spark, f"{base}/in", store, f"{base}/checkpoint")
    return _queue_shown(store.read())


# Further predicates, labels and runs


@query("SELECT doc_id, NOT (source <> '' AND NOT contains(lower(source), 'intern') AND (contains(lower(source), 'lead ') OR contains(lower(source), 'senior'))) AS passes, (contains(lower(substr(source || chr(10) || substr(text, 1, 800), 1, 100000)), 'intern') AND regexp_matches(lower(source || chr(10) || substr(text, 1, 800)), '\\bintern\\s*/\\s*staff\\b')) AS mixed FROM documents")
def early_filter_and_mixed(spark, d):
    return t(spark, d, "documents").select("doc_id", classify.passes_early("source").alias("passes"), fields.is_mixed_employment("source", "text").alias("mixed"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'closed' ELSE 'listing_or_category_url' END AS reason FROM pages")
def page_verification(spark, d):
    """Details, closed details, listings by type, by title and by url."""
    k = F.col("page_id") % 5
    url = F.concat(F.lit("https://work.example/jobs/"), F.when(k == 4, "search/").otherwise(""), F.col("page_id").cast("string"))
    pages = t(spark, d, "pages").select("page_id", url.alias("url"), F.when(k == 3, "Browse jobs here").otherwise("Intern").alias("title"), F.when(k == 1, "Lowongan ditutup kemarin").otherwise("Apply").alias("text_content"), F.when(k == 2, "listing").otherwise("detail").alias("page_type"))
    return extract.verified(pages).select("page_id", F.col("rejection_reason").alias("reason"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN 90 ELSE 70 END AS confidence FROM supplier")
def company_confidence(spark, d):
    k = F.col("s_suppkey") % 4
    return t(spark, d, "supplier").select("s_suppkey", fields.company_confidence(F.when(k != 0, F.col("s_name")), F.when(k == 1, F.concat(F.lit("Intern, "), "s_name")).otherwise("Intern")).alias("confidence"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ui_ux_designer' WHEN 2 THEN NULL ELSE lower(n_name) END AS label, n_nationkey % 3 = 0 AS truth FROM nation")
def label_normalize(spark, d):
    k = F.col("n_nationkey")
    shown = F.when(k % 4 == 0, "N/A").when(k % 4 == 1, " UI-UX Designer").when(k % 4 == 2, "").otherwise(F.col("n_name"))
    return t(spark, d, "nation").select("n_nationkey", text.label(shown).alias("label"), text.truth(F.when(k % 3 == 0, " Ya ").otherwise("no")).alias("truth"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'body' ELSE 'snip' END AS snippet, CASE WHEN page_id % 2 = 0 THEN url ELSE 'x' || url END AS url FROM pages WHERE page_id % 5 <> 0")
def hit_normalize(spark, d):
    k = F.col("page_id")
    hits = t(spark, d, "pages").select(k.alias("ord"), F.when(k % 3 != 0, "snip").otherwise("").alias("snippet"), F.lit("body").alias("body"), F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, F.col("url")).alias("url"), F.when((k % 2 == 1) & (k % 5 != 0), F.concat(F.lit("x"), "url")).alias("href"))
    return lookup.normalize_hits(hits).select(F.col("ord").alias("page_id"), "snippet", "url")


@query("SELECT c_mktsegment AS rejection_reason, count(*) AS n FROM customer WHERE c_acctbal < 40 GROUP BY 1")
def min_score_audit(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_name").alias("url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("source_platform"), F.lit("detail").alias("page_type"), F.lit(0).alias("internship_confidence"), F.lit(0).alias("role_confidence"), F.col("c_acctbal").alias("score"), F.lit("").alias("raw_text"))
    return extract.below_minimum(rows, 40).groupBy(F.col("source_platform").alias("rejection_reason")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size >= 10 AND list_has_all(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\\p{L}\\p{N}_]+'), ['ring'])")
def field_filters(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("role"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("location"), F.col("p_size").alias("score"))
    return lookup.filter_fields(rows, "ring", 10, company=["Brand#1", "Brand#2"]).select("p_partkey")


@query("SELECT 'q' || n AS name, p_partkey AS id FROM part JOIN (VALUES (1, 'ring', 30), (2, 'red', 40)) w(n, k, s) ON list_contains(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\\p{L}\\p{N}_]+'), k) AND p_size >= s")
def watch_lists(spark, d):
    lists = spark.createDataFrame([("q1", "Ring", 30), ("q2", "red", 40)], "name string, keyword string, min_score int")
    return lookup.watch(lists, t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("role"), F.col("p_size").alias("score")))


@query()
def extract_documents(spark, d):
    """The whole extractor over documents as pages, with the fixture lexicon: accepted rows and rejections by reason."""
    pages = t(spark, d, "documents").select(F.concat(F.lit("https://x.example/job/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("title"), F.col("text").alias("text_content"), F.lit("detail").alias("page_type"))
    found = extract.extract(pages, LEXICON)
    return found.groupBy(F.coalesce(F.split("rejection_reason", ":")[0], F.lit("accepted")).alias("outcome"), "role").agg(F.count("*").alias("n"))


@query()
def listing_links(spark, d):
    """Links to details on pages, by the generic rule with the pages' own anchors."""
    pages = t(spark, d, "pages").select(F.col("url"), F.replace("html", F.lit('href="/'), F.lit('href="/job/')).alias("html"))
    return html.detail_links(pages).select("listing_url", "url", "discovery_method")


@query(
    """SELECT event_type AS platform, (SELECT count(*) FROM events) AS searched_urls, (SELECT count(DISTINCT event_type) FROM events) AS platforms, count(*) AS hits, count(*) FILTER (WHERE value >= 50) AS accepted, count(*) FILTER (WHERE value < 50) AS rejected,
       count(*) FILTER (WHERE value < 50 AND user_id % 2 = 0) AS even FROM events GROUP BY event_type"""
)
def run_metadata(spark, d):
    hits = t(spark, d, "events").select(F.col("event_type").alias("source_platform"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("rejection_reason"), "value")
    good = hits.filter("value >= 50")
    one = runs.run_metadata(hits, good, good, good, hits.filter("value < 50"))
    of = lambda c: F.coalesce(F.try_element_at(F.col(c), F.col("platform")), F.lit(0))
    rows = one.withColumn("platform", F.explode("platforms_with_hits"))
    even = F.coalesce(F.try_element_at(F.try_element_at("rejection_reasons_by_platform", F.col("platform")), F.lit("even")), F.lit(0))
    return rows.select("platform", "searched_urls", F.size("platforms_with_hits").cast("long").alias("platforms"), of("raw_results_by_platform").alias("hits"), of("accepted_by_platform").alias("accepted"), of("rejected_by_platform").alias("rejected"), even.alias("even"))
