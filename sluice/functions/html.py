"""Documents: titles, texts, anchors, scripts, cards and JSON bodies. Parsing runs in Arrow batches; all rules on what was
found are Spark expressions over the rows."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ..operators.rank import first_of_each
from . import urls
from .text import blank_to_null, key_name, matches_any, slug

#: Where a platform's relative links lead.
BASES = {"glints": "https://glints.com", "jobstreet": "https://www.jobstreet.co.id", "kalibrr": "https://www.kalibrr.id", "dealls": "https://dealls.com", "prosple": "https://id.prosple.com", "indeed": "https://id.indeed.com", "lokerid": "https://www.loker.id"}
#: Platform: what an anchor's link must match, what it must not, and the patterns of links in scripts.
LINK_RULES = {
    "dealls": (r"^/loker/[a-z0-9].*~", r"^/loker/(?:industri|lokasi|kategori|posisi|tipe|populer)", ()),
    "kalibrr": (r"/c/[^/]+/jobs/\d+/", None, ()),
    "glints": (r"/opportunities/jobs/", None, (r"https?://(?:www\.)?glints\.com/[^\s\"'<>]*?/opportunities/jobs/[^\s\"'<>]+", r"/(?:id/)?(?:en/)?opportunities/jobs/[^\s\"'<>]+")),
    "jobstreet": (r"/job/\d+|/id/job/", None, (r"https?://(?:www\.)?jobstreet\.co\.id/[^\s\"'<>]*?/job/[^\s\"'<>]+", r"/id/job/[^\s\"'<>]+", r"/job/[0-9][^\s\"'<>]*")),
    "lokerid": (r"/lowongan-kerja/|/jobs?/", None, ()),
    "prosple": (r"/jobs-internships/|/job/|/graduate-employers/.+/(?:jobs|jobs-internships|graduate-jobs-internships)/", None, (r"https?://(?:id\.)?prosple\.com/[^\s\"'<>]*?(?:jobs-internships|graduate-jobs-internships|/job/)[^\s\"'<>]+", r"/[^\s\"'<>]*?(?:jobs-internships|graduate-jobs-internships|job)/[^\s\"'<>]+")),
    "indeed": (r"/viewjob\?|/rc/clk\?|[?&]jk=", None, ()),
    "generic": (r"/job/|/jobs/\d+|/vacancy/|/career/|/position/|/opening/|/loker/[a-z0-9]|/lowongan-kerja/|/jobs-internships/|/viewjob\?", None, ()),
}
#: Patterns of detail links in API bodies.
API_LINKS = (
    *LINK_RULES["glints"][2], *LINK_RULES["jobstreet"][2], r"https?://(?:www\.)?kalibrr\.id/[^\s\"'<>]*?/c/[^/]+/jobs/\d+/[^\s\"'<>]+", r"/id-ID/c/[^/]+/jobs/\d+/[^\s\"'<>]+",
    r"https?://dealls\.com/loker/[a-z0-9][^\s\"'<>]*~[^\s\"'<>]+", r"/loker/[a-z0-9][^\s\"'<>]*~[^\s\"'<>]+", *LINK_RULES["prosple"][2],
)
#: Pages whose rows a Python task holds at once.
SLICE = 200
_SKIPPED = frozenset(("script", "style", "nav", "footer", "header"))


def title(html) -> Column:
    """The text of ``<title>``, else of the first ``<h1>``, else null."""
    of = lambda tag: blank_to_null(F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")))
    return F.coalesce(of("title"), of("h1"))


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.off = [], []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.off.append(tag)

    def handle_endtag(self, tag):
        if self.off and tag == self.off[-1]:
            self.off.pop()

    def handle_data(self, data):
        if not self.off:
            self.lines += [x for line in data.splitlines() if (x := line.strip())]


def _lines(html: str | None) -> str | None:
    if not html:
        return None
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.lines)


@arrow_udf(StringType())
def page_text(html: pa.Array) -> pa.Array:
    """The lines of a page without scripts, styles, menus, headers and footers. Few pages at a time are Python strings."""
    return pa.concat_arrays([pa.array([_lines(t) for t in html.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, max(1, len(html)), SLICE)])


class _Items(HTMLParser):
    """Anchors with their texts, scripts with their attributes, cards with title, company and link, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.anchors, self.scripts, self.cards, self.script, self.anchor, self.card, self.part = [], [], [], None, None, None, None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script":
            self.script = [a.get("type") or "", a.get("id") or "", "data-api-response" in a, ""]
        self.depth += tag not in ("br", "img", "input", "meta", "link", "hr")
        if self.card is None and (a.get("data-testid") == "job-card" or tag == "article" and "data-job-id" in a):
            self.card = {"depth": self.depth, "href": None, "any": None, "title": None, "company": None}
        if self.card is not None:
            if a.get("data-automation") == "jobTitle" or a.get("data-testid") == "job-card-title":
                self.card["href"], self.part = a.get("href"), ["title", self.depth, []]
            elif a.get("data-automation") == "jobCompany":
                self.part = ["company", self.depth, []]
            if tag == "a" and self.card["any"] is None and re.search(r"/(?:id/)?job/\d+", a.get("href") or ""):
                self.card["any"] = a["href"]
        if tag == "a" and a.get("href") is not None:
            self.anchor = [a["href"], []]

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.scripts.append(self.script)
            self.script = None
        if tag == "a" and self.anchor is not None:
            self.anchors.append((self.anchor[0], "".join(x.strip() for x in self.anchor[1]) or None))
            self.anchor = None
        if self.part is not None and self.depth <= self.part[1]:
            self.card[self.part[0]] = " ".join(x.strip() for x in self.part[2] if x.strip()) or None
            self.part = None
        if self.card is not None and self.depth <= self.card["depth"]:
            self.cards.append(self.card)
            self.card = None
        self.depth -= 1

    def handle_data(self, data):
        if self.script is not None:
            self.script[3] += data
            return
        if self.anchor is not None:
            self.anchor[1].append(data)
        if self.part is not None:
            self.part[2].append(data)


def items(html: str | None) -> _Items:
    found = _Items()
    if html:
        found.feed(html)
        found.close()
    return found


def script_text(scripts: list[str]) -> str:
    """Script source with its escapes undone, so that links in it can be found."""
    text = "\n".join(scripts).replace("\\/", "/")
    return entities.unescape(text.encode("utf-8", "ignore").decode("unicode_escape", "ignore"))


def _page_rows(platform: str, listing: str, html: str, rules: dict, bases: dict[str, str]) -> Iterator[tuple]:
    """(kind, href, url, title, company, body) of what may be a link."""
    base, found = bases.get(platform, listing), items(html)
    for c in found.cards if platform == "jobstreet" else ():
        if href := c["href"] or c["any"]:
            yield "card", href, urljoin(base, href), c["title"], c["company"], None
    for href, text in found.anchors:
        yield "dom", href, urljoin(base, href), text, None, None
    source = script_text([s[3] for s in found.scripts]) if found.scripts else ""
    for pattern in rules.get(platform, rules["generic"])[2]:
        for m in re.finditer(pattern, source, re.IGNORECASE):
            href = m.group().strip().rstrip("\\\"'<>),;]")
            yield "script", href, urljoin(base, href), None, None, None
    for _, _, api, body in found.scripts:
        if api:
            yield "api", None, None, None, None, body


_ROWS = "listing_url string, source_platform string, pos int, discovery_method string, href string, url string, title string, company string, body string"


def page_items(pages: DataFrame, url: str = "url", html: str = "html", platform: Column | None = None, more: dict | None = None, more_bases: dict[str, str] | None = None) -> DataFrame:
    """A row for each anchor, card, script link and API body of a page."""
    rules, bases = LINK_RULES | (more or {}), BASES | (more_bases or {})
    rows = pages.select(F.col(url).alias("listing_url"), (platform if platform is not None else urls.platform(url)).alias("source_platform"), F.col(html).alias("html")).filter("listing_url IS NOT NULL")

    def run(frames):
        for whole in frames:
            for at in range(0, len(whole), SLICE):
                f = whole.iloc[at : at + SLICE]
                out = [(u, p, i, *row) for u, p, h in zip(f["listing_url"], f["source_platform"], f["html"]) for i, row in enumerate(_page_rows(p, u, h, rules, bases))]
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _ROWS.split(", ")])

    return rows.mapInPandas(run, _ROWS)


def detail_links(pages: DataFrame, url: str = "url", html: str = "html", platform: Column | None = None, more: dict | None = None, more_bases: dict[str, str] | None = None) -> DataFrame:
    """listing_url, url, title, company, source_platform, discovery_method, ord: a listing's links to details, each once.

    Platforms have their rules on anchors; others take anchors of the same host that look like details. Cards come
    first, then anchors, links in scripts and in API bodies. Pages are parsed once, and once more those that name API bodies. ``more`` and ``more_bases`` add platforms, or replace their rules: name to what
    an anchor must match, what it must not, and the patterns of links in scripts; name to where relative links lead. ``platform`` names them.
    """
    rules = LINK_RULES | (more or {})
    found = page_items(pages, url, html, platform, more, more_bases).withColumn("ord", F.col("pos").cast("long"))
    known, place = F.col("source_platform").isin(*(p for p in rules if p != "generic")), F.concat(urls.path("url"), F.when(urls.query("url") != "", F.concat(F.lit("?"), urls.query("url"))).otherwise(""))
    fits = F.lit(False)
    for name, (must, never, _) in rules.items():
        c = F.col("href") if name in ("dealls", "kalibrr", "glints", "jobstreet") else place if name != "generic" else F.col("url")
        ok = matches_any(c, [must]) & (~matches_any(c, [never]) if never else F.lit(True))
        if name in ("lokerid", "prosple", "indeed", "generic"):
            ok = ok & ~urls.is_listing("url")
        if name == "generic":
            ok = ok & ~known & (urls.host("url") == urls.host("listing_url"))
        fits = fits | ok & ((F.col("source_platform") == name) if name != "generic" else ~known)
    of = lambda kind: F.col("discovery_method") == kind
    card = F.col("href").rlike(r"/(?:id/)?job/\d+") & ~urls.is_listing("url")
    script = ~urls.is_listing("url") & ((F.col("source_platform") != "prosple") | matches_any(urls.path("url"), [LINK_RULES["prosple"][0]]))
    links = found.filter(F.when(of("dom"), fits).when(of("card"), card).when(of("script"), script))
    bodies = page_items(pages.filter(F.contains(F.lower(F.col(html)), F.lit("data-api-response"))), url, html, platform, more, more_bases).filter(of("api"))
    api = api_links(bodies, "listing_url", "body", "source_platform").withColumn("discovery_method", F.lit("api"))
    columns = ["listing_url", "url", "title", "company", "source_platform", "discovery_method", "ord"]
    rank = F.create_map(*(F.lit(x) for kv in {"card": 0, "dom": 1, "script": 2, "api": 3}.items() for x in kv))[F.col("discovery_method")]
    every = links.select(columns).unionByName(api.select(columns))
    every = every.withColumn("source_platform", F.when(known, F.col("source_platform")).otherwise(urls.platform("url")))
    return first_of_each(every.withColumn("_r", rank), ["listing_url", "url"], ["_r", "ord"]).drop("_r")


# JSON bodies

#: Names of fields, without signs.
TITLE_KEYS = ("title", "jobtitle", "name", "position", "positiontitle", "role", "headline")
COMPANY_KEYS = ("company", "companyname", "employer", "employername", "organization", "hiringorganization")
URL_KEYS = ("url", "href", "joburl", "absoluteurl", "weburl")
ID_KEYS = ("id", "jobid", "jobadid", "uuid")
SLUG_KEYS = ("slug", "jobslug")
COMPANY_SLUG_KEYS = ("companyslug", "company", "companyname")


def walk(value) -> Iterator:
    """Objects and scalars of a JSON value, parents first. A stack of iterators, so depth does not matter."""
    stack = [iter((value,))]
    while stack:
        for v in stack[-1]:
            if isinstance(v, dict):
                yield v
                stack.append(iter(v.values()))
                break
            if isinstance(v, list):
                stack.append(iter(v))
                break
            yield v
        else:
            stack.pop()


def _scalar(v) -> str | None:
    return (str(v).strip() or None) if isinstance(v, (str, int, float)) else None


def json_nodes(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, kind (object, string, scalar), value, fields: the nodes of JSON bodies, parents first. Broken JSON gives none."""

    def run(frames):
        for f in frames:
            out = []
            for k, text in zip(f["key"], f["body"]):
                try:
                    data = json.loads(text) if text else []
                except (ValueError, RecursionError):
                    continue
                for i, v in enumerate(walk(data)):
                    if isinstance(v, dict):
                        out.append((k, i, "object", None, [{"name": str(n), "text": t} for n, x in v.items() if (t := _scalar(x))]))
                    else:
                        out.append((k, i, "string" if isinstance(v, str) else "scalar", None if v is None else str(v), []))
            yield pd.DataFrame(out, columns=["key", "pos", "kind", "value", "fields"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInPandas(run, f"key {kind}, pos int, kind string, value string, fields array<struct<name:string,text:string>>").withColumnRenamed("key", key)


def field_of(fields, names) -> Column:
    """The first field, in the object's order, that has one of the names."""
    return F.try_element_at(F.filter(fields, lambda x: key_name(x["name"]).isin(*names)), F.lit(1))["text"]


def _first_named(names) -> Column:
    """The same where the fields' names have been made comparable."""
    return F.try_element_at(F.filter("fields", lambda x: x["name"].isin(*names)), F.lit(1))["text"]


def _absolute(link: Column, base: Column) -> Column:
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]+:", 0), link)).otherwise(F.concat(base, link))


def api_links(bodies: DataFrame, listing: str = "listing_url", body: str = "body", platform: str = "source_platform") -> DataFrame:
    """listing_url, url, title, company, source_platform, ord: detail links that API bodies name or that can be inferred from their objects."""
    rows = bodies.select(F.struct(F.col(listing).alias("listing_url"), F.coalesce(F.col(platform), urls.platform(listing)).alias("source_platform")).alias("page"), F.col(body).alias("body"))
    nodes = json_nodes(rows.withColumn("page", F.to_json("page")), "page", "body")
    page = F.from_json("page", "listing_url string, source_platform string")
    nodes = nodes.select(page["listing_url"].alias("listing_url"), page["source_platform"].alias("source_platform"), "pos", "kind", "value", "fields")
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in BASES.items() if kv[0] != "lokerid" for x in kv))[F.col("source_platform")], F.regexp_extract("listing_url", "^([^:]+://[^/?#]*)", 1))
    direct = lambda c: F.flatten(F.array(*(F.regexp_extract_all(F.replace(c, F.lit("\\/"), F.lit("/")), F.lit("(?i)" + p), F.lit(0)) for p in API_LINKS)))
    clean = lambda u: F.trim(u, F.lit("\\\"'<>),;] "))
    # Each field is looked up once, in a projection of its own, however often the rules name it.
    wanted = {"name": TITLE_KEYS, "company": COMPANY_KEYS, "given": URL_KEYS, "ident": ID_KEYS, "short": SLUG_KEYS, "firm": COMPANY_SLUG_KEYS}
    keyed = nodes.withColumn("fields", F.transform("fields", lambda x: F.struct(key_name(x["name"]).alias("name"), x["text"].alias("text"))))
    keyed = keyed.withColumns({c: _first_named(names) for c, names in wanted.items()})
    name, company, given, ident, short, firm = (F.col(c) for c in wanted)
    named = F.try_element_at(F.filter(F.transform(direct(given), lambda u: _absolute(clean(u), base)), lambda u: ~urls.is_listing(u)), F.lit(1))
    inferred = (
        F.when((F.col("source_platform") == "glints") & short.isNotNull() & ident.isNotNull(), F.concat(base, F.lit("/id/opportunities/jobs/"), short, F.lit("/"), ident))
        .when((F.col("source_platform") == "jobstreet") & ident.isNotNull(), F.concat(base, F.lit("/id/job/"), F.when(name.isNotNull(), F.concat(slug(name), F.lit("-"))).otherwise(""), ident))
        .when((F.col("source_platform") == "kalibrr") & ident.isNotNull() & firm.isNotNull() & F.coalesce(short, name).isNotNull(), F.concat(base, F.lit("/id-ID/c/"), slug(firm), F.lit("/jobs/"), ident, F.lit("/"), F.coalesce(short, slug(name))))
    )
    whole = F.when((urls.scheme(given) != "") & (urls.host(given) != "") & ~urls.is_listing(given), given)
    none = F.lit(None).cast("string")
    text = F.transform(direct(F.col("value")), lambda u: F.struct(_absolute(clean(u), base).alias("url"), none.alias("title"), none.alias("company")))
    one = F.array(F.struct(F.coalesce(named, whole, inferred).alias("url"), name.alias("title"), company.alias("company")))
    every = keyed.select("listing_url", "source_platform", "pos", F.explode(F.when(F.col("kind") == "string", text).when(F.col("kind") == "object", one)).alias("link")).select("listing_url", "source_platform", "pos", "link.*")
    every = every.filter(blank_to_null("url").isNotNull() & ~urls.is_listing("url"))
    return first_of_each(every, ["listing_url", "url"], ["pos"]).withColumn("ord", F.col("pos").cast("long") + 1_000_000).drop("pos")


def structured_text(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, text: the readable strings of JSON-LD and app-state scripts, each once, whatever its case."""

    def run(frames):
        for f in frames:
            out = []
            for k, h in zip(f["key"], f["html"]):
                seen: dict[str, str] = {}
                for kind, ident, _, body in items(h).scripts:
                    if kind == "application/ld+json" or ident == "__NEXT_DATA__":
                        try:
                            values = list(walk(json.loads(body)))
                        except (ValueError, RecursionError):
                            continue
                        for v in values:
                            if isinstance(v, str) and 3 <= len(t := " ".join(re.sub("<[^>]+>", " ", v).split())) <= 2000:
                                seen.setdefault(t.lower(), t)
                out.append((k, "\n".join(seen.values())))
            yield pd.DataFrame(out, columns=["key", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)


def is_json_response(body, status, most: int = 2_000_000) -> Column:
    return (F.coalesce(F.col(status), F.lit(0)) < 400) & (F.length(body) <= most) & F.trim(F.col(body)).rlike(r"^[{\[]")


