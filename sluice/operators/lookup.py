"""Joins between hits, pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import blank_to_null, contains_any
from .rank import first_of_each


def new_rows(rows: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def known_rows(rows: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_semi")


def in_order(wanted: DataFrame, *sources: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """The rows of the sources for the wanted keys, in their order; later sources override earlier ones."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, (s.withColumn("_from", F.lit(i)) for i, s in enumerate(sources)))
    latest = first_of_each(both, [key], [F.desc("_from")]).drop("_from")
    return wanted.select(key, order).join(latest, key).orderBy(order)


def attribute(details: DataFrame, links: DataFrame, url: str = "url", listing: str = "listing_url", order: str = "ord") -> DataFrame:
    """Each detail with the listing that last named it, by canonical url on both sides. Links of one spelling are one row before it is made canonical."""
    spelt = links.groupBy(F.col(url).alias("_s")).agg(F.max_by(listing, order).alias(listing), F.max(order).alias("_o"))
    last = spelt.groupBy(urls.canonical("_s").alias("_u")).agg(F.max_by(listing, "_o").alias(listing))
    return details.join(last, urls.canonical(details[url]) == F.col("_u"), "left").drop("_u")


def with_hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with the company that the first search hit or card of their canonical url names, where the page names none."""
    if "company" not in hits.columns:
        return rows
    named = hits.filter(blank_to_null("company").isNotNull()).groupBy(urls.canonical("url").alias("_u")).agg(F.min_by("company", "ord").alias("_company"))
    joined = rows.join(named, urls.canonical(rows["url"]) == F.col("_u"), "left").withColumn("company", F.coalesce(blank_to_null("company"), F.col("_company")))
    return joined.select(rows.columns)


def expand(terms: DataFrame, templates: DataFrame, out: str = "query") -> DataFrame:
    """Every term in every template, term by term. Both are lists of settings, not data."""
    made = F.replace(F.replace("template", F.lit("{term}"), F.col("term")), F.lit("{location}"), F.col("location"))
    return terms.crossJoin(F.broadcast(templates)).select(made.alias(out), (F.col("term_ord") * 1000 + F.col("template_ord")).alias("ord"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that hold the words of the query; a query without words is looked for as it is."""
    every = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    wanted = [w for w in text.lower().split() if w]
    tokens = F.split(every, r"[^\p{L}\p{N}_]+")
    plain = [w for w in wanted if w.replace("_", "").isalnum()]
    if not wanted:
        return rows
    if len(plain) < len(wanted):
        return rows.filter(F.contains(every, F.lit(text.lower())))
    return rows.filter(F.array_size(F.array_except(F.array(*(F.lit(w) for w in plain)), tokens)) == 0)


def token_index(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """token, key: an inverted index."""
    every = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    return rows.select(F.explode(F.array_distinct(F.filter(F.split(every, r"[^\p{L}\p{N}_]+"), lambda t: t != ""))).alias("token"), key)


def filter_list(rows: DataFrame, role: str = "Semua", query: str = "") -> DataFrame:
    """The list's filters: a chip for the role ("Semua" is all) and a free text."""
    low = F.lower(F.coalesce("role", F.lit("")))
    fits = F.lit(True) if role == "Semua" else F.contains(low, F.lit(role.lower()))
    if role == "Aktuaria":
        fits = fits | F.coalesce(F.col("category") == "actuarial", F.lit(False))
    if role == "AI/ML":
        fits = fits | F.contains(low, F.lit("ai"))
    wanted = query.strip().lower()
    if wanted:
        fits = fits & F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "company", "role", "category", "location")))), F.lit(wanted))
    return rows.filter(fits)


def filter_fields(rows: DataFrame, q: str | None = None, least: int | None = None, **equal) -> DataFrame:
    """Any of the named columns equal to a value or one of a list, a least score and a free text."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.filter(F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == v)
    if least is not None:
        rows = rows.filter(F.col("score") >= least)
    return search(rows, q, ["title", "company", "role", "category", "location"]) if q else rows


def board(applications: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Applications with what they are for."""
    return applications.join(opportunities.select(F.col("id").alias("opportunity_id"), "title", "company", "score"), "opportunity_id")


def watch(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """name, id: rows that fit a watch list's keyword and least score. Lists are settings of users; rows are never paired with each other."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "company", "role"))))
    tokens = rows.select("id", "score", F.explode(F.array_distinct(F.split(text, r"[^\p{L}\p{N}_]+"))).alias("keyword"))
    return lists.withColumn("keyword", F.lower("keyword")).join(tokens, "keyword").filter(F.col("score") >= F.col("min_score")).select("name", "id")


def normalize_hits(hits: DataFrame) -> DataFrame:
    """Search hits of any provider: url or href or link, snippet or body or description; those without url go."""
    first = lambda *names: F.coalesce(*(blank_to_null(n) for n in names if n in hits.columns), F.lit(None))
    rows = hits.select(*(c for c in ("query", "ord", "source") if c in hits.columns), first("title").alias("title"), first("snippet", "body", "description", "content").alias("snippet"), first("url", "href", "link").alias("url"))
    return rows.filter("url IS NOT NULL").withColumn("source_platform", urls.platform("url"))


def platforms_named(queries: DataFrame, markers: dict[str, str], query: str = "query", order: str = "ord") -> DataFrame:
    """platform: those whose marker a query holds, in the order of the first."""
    found = [F.when(contains_any(F.lower(query), (m,)), F.lit(p)) for p, m in markers.items()]
    return queries.select(order, F.posexplode(F.array(*found)).alias("pos", "platform")).filter("platform IS NOT NULL").groupBy("platform").agg(F.min(F.struct(order, "pos")).alias("_o")).orderBy("_o").select("platform")
