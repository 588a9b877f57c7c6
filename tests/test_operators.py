import itertools
import random

import pytest
from fixtures import LEXICON
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import vocabulary as V
from sluice.functions import html
from sluice.operators import dedupe, extract, lookup, metrics, queries, rank, score, upsert
from sluice.plans import runs


def test_diversified(spark):
    rows = [(i, "generic", 50) for i in range(30)] + [(100, "dealls", 10), (101, "bad", -5)]
    got = rank.diversified(spark.createDataFrame(rows, "ord int, p string, s int"), "p", "s", "ord", 40, V.PLATFORM_CAPS).collect()
    assert sum(r.p == "generic" for r in got) == 12 and sum(r.p == "dealls" for r in got) == 1 and len(got) == 13
    assert [r.p for r in sorted(got, key=lambda r: r.place)][:2] == ["generic", "dealls"]
    assert rank.diversified(spark.createDataFrame(rows, "ord int, p string, s int"), "p", "s", "ord", 0, {}).count() == 0


def test_round_robin(spark):
    rows = [(i, "a", 9) for i in range(12)] + [(50 + i, "b", 1) for i in range(6)]
    got = rank.round_robin(spark.createDataFrame(rows, "ord int, p string, s int"), "p", "s", "ord", 8).collect()
    assert len(got) == 8 and sum(r.p == "b" for r in got) == 4 and [r.p for r in sorted(got, key=lambda r: r.place)] == list("abababab")


@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5)), max_size=20), st.integers(1, 4))
@settings(max_examples=5, deadline=None)
def test_cap_never_exceeds(spark, rows, n):
    df = spark.createDataFrame([(i, g, s) for i, (g, s) in enumerate(rows)], "ord int, g string, s int")
    counts = {r.g: r["count"] for r in rank.cap(df, "g", ["ord"], n).groupBy("g").count().collect()}
    assert all(v == min(n, sum(g == k for g, _ in rows)) for k, v in counts.items())


def test_url_score_order(spark):
    rows = [(0, "https://www.linkedin.com/jobs/view/1", "Frontend Intern", "detail"), (1, "https://www.jobstreet.co.id/id/frontend-intern-jobs", "Frontend Intern", "listing"), (2, "https://id.linkedin.com/jobs/intern-jobs", "x", "listing")]
    df = spark.createDataFrame(rows, "ord int, url string, title string, page_type string").withColumn("s", score.url_score("url", "title", F.lit(""), "page_type", F.lit(None).cast("string"), "frontend"))
    got = [r.s for r in df.orderBy("ord").collect()]
    assert got == [4 + 40 + 10 + 25 + 20, 10 + 25 + 20 - 20, -100]


def test_extract_score_and_gate(spark, as_of):
    body = "Program internship di Jakarta. Apply sekarang, work from home. Gaji 3-5 juta. Deadline: 30 Mei 2026. Durasi 6 bulan. We use react and css every day of the week in our office."
    rows = [
        ("https://glints.com/id/opportunities/jobs/a/1?utm_source=x", "Frontend Developer Intern at Acme", body, "detail"),
        ("https://dealls.com/loker", "Loker", body, "unknown"),
        ("https://x.example/2", "Content Creator Intern", body, "detail"),
        ("https://x.example/3", "Cook", "nothing here", "detail"),
        ("https://x.example/4", None, None, "detail"),
    ]
    pages = spark.createDataFrame(rows, "url string, title string, text_content string, page_type string")
    got = {r.url: r for r in extract.extract(pages, LEXICON).collect()}
    assert [got[r[0]].rejection_reason for r in rows] == [None, "listing_page", "suspicious_role:content creator", "not_internship:no_signal", "not_internship:no_signal"]
    r = got[rows[0][0]]
    assert (r.role, r.category, r.company, r.location, r.work_mode, r.salary_min, r.duration, r.deadline, r.source_url) == ("Frontend Developer", "tech", "Acme", "Jakarta", "remote", 3000000, "6 bulan", "30 Mei 2026", "https://glints.com/id/opportunities/jobs/a/1")
    scored = score.score_pages(extract.accepted(extract.extract(pages, LEXICON)), LEXICON, as_of).first()
    assert scored.score == 100 and scored.score_breakdown.penalty_score == 0 and scored.score_breakdown.final_score == 100
    good, bad = runs.accept(pages, runs.Settings(LEXICON, as_of))
    assert good.count() == 1 and bad.count() == 4
    issues = metrics.issues(good, metrics.result_rules(LEXICON, "tech"), "title").collect()
    assert [i.rule for i in issues if i.hard] == []
    off = extract.extract(pages, LEXICON, "actuarial").filter("url like '%glints%'").first()
    assert off.rejection_reason == "out_of_scope_target:actuarial"


def test_evaluate(spark, as_of):
    labels = spark.createDataFrame(
        [("u1", "Frontend Intern", "Acme", "internship react", True, True, "frontend", None), ("u2", "Senior Cook", "", "cooking", False, False, None, None), ("u3", "Actuarial Intern", "", "pricing", True, True, "actuarial", "tech")],
        "url string, title string, company string, description string, true_should_save boolean, true_is_internship boolean, true_role string, target_category string",
    )
    rows, matrix = runs.evaluate(labels, runs.Settings(LEXICON, as_of))
    m = matrix.first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall, m.internship_accuracy, m.role_accuracy) == (1, 0, 1, 1, 1.0, 0.5, 1.0, 1.0)


def test_crawl_and_research(spark, as_of):
    listing = spark.createDataFrame([("https://dealls.com/loker", '<a href="/loker/frontend-intern~acme">Frontend Intern</a><a href="/loker/senior-x~acme">Senior X</a>')], "url string, html string")
    detail = spark.createDataFrame([("https://dealls.com/loker/frontend-intern~acme", "Frontend Intern", "internship react apply di jakarta", "detail", "dealls")], "url string, title string, text_content string, page_type string, source_platform string")
    good, bad, links = runs.crawl(listing, detail, runs.Settings(LEXICON, as_of, target="frontend"), 5, 10)
    assert [(r.title, r.listing_url) for r in good.collect()] == [("Frontend Intern", "https://dealls.com/loker")] and links.count() == 2
    hits = spark.createDataFrame([("https://dealls.com/loker/frontend-intern~acme", "Frontend Intern", "", "detail", None, 0), ("https://dealls.com/loker", "Internship Loker", "", "listing", "dealls", 1)], "url string, title string, snippet string, page_type string, source_platform string, ord long")
    pages = detail.withColumn("html_content", F.lit("")).unionByName(listing.select("url", F.lit("Loker").alias("title"), F.lit("x").alias("text_content"), F.lit("listing").alias("page_type"), F.lit("dealls").alias("source_platform"), F.col("html").alias("html_content")))
    good, audit, ranked = runs.research(hits, pages, runs.Settings(LEXICON, as_of), 10)
    assert good.count() == 1 and ranked.count() == 2 and {r.rejection_reason for r in audit.collect()} == {"listing_or_category_url"}
    assert runs.run_metadata(hits, ranked, pages, good, audit).first().searched_urls == 2


def indel(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return 200.0 * m[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_fuzzy_against_brute_force(spark):
    r = random.Random(5)
    titles = []
    for _ in range(60):
        t = " ".join(r.choice(["frontend", "developer", "intern", "data", "analyst", "jakarta"]) for _ in range(r.randint(1, 5)))
        titles.append(t)
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(t))
            titles.append(t[:k] + r.choice(["", "x", "s"]) + t[k + 1 :])
    rows = [(i, t, r.choice("ab"), r.choice("cd")) for i, t in enumerate([*titles, None, "", ""])]
    df = spark.createDataFrame(rows, "id long, title string, role string, place string")
    norm = {i: " ".join((t or "").split()) for i, t, _, _ in rows}
    similar = lambda x, y: (k := indel(norm[x[0]], norm[y[0]])) > 90 and (x[2] == y[2] or x[3] == y[3] or k > 95)
    kept = []
    for x in rows:
        if not any(similar(x, y) for y in kept):
            kept.append(x)
    pairs = dedupe.similar_pairs(df, "id", "title", "role", "place")
    classes = {}
    for i, _, p, q in rows:
        classes.setdefault((norm[i], p, q), i)
    first = {v: k for k, v in classes.items()}
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[0] in first and y[0] in first and similar(x, y)}
    got = {(p.a, p.b) for p in pairs.collect()}
    assert {p for p in got if p[0] in first and p[1] in first} == want
    assert {p.id for p in dedupe.greedy(df, pairs, "id", [F.col("id")]).collect()} == {x[0] for x in kept}
    assert dedupe.indel_ratio("kitten", "sitting") == pytest.approx(indel("kitten", "sitting"))


def test_pieces_of_titles_are_not_broadcast(spark):
    """Hundreds of pieces a title, of which Spark knows nothing before it runs, pass neither the driver nor a single task."""
    df = spark.range(50).select(F.col("id"), F.concat(F.lit("frontend developer intern "), F.md5(F.col("id").cast("string"))).alias("title"))
    pairs = dedupe.similar_pairs(df, "id", "title")
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan and "Exchange hashpartitioning(t#" in pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 0


def test_greedy_drops_copies_of_a_dropped_row(spark):
    x, r = "frontend developer intern jakarta", "frontend developer intern jakartas"
    rows = [(1, x, 5), (2, r, 4), (3, r, 3), (4, r, 9), (5, "cook", 1), (6, "cook", 2), (7, "cook", 1)]
    df = spark.createDataFrame(rows, "id long, title string, score int")
    pairs = dedupe.similar_pairs(df, "id", "title")
    for order, by in (([F.col("id")], lambda v: v[0]), ([(-F.col("score")).alias("s"), F.col("id")], lambda v: (-v[2], v[0])), ([(-F.col("id")).alias("i")], lambda v: -v[0])):
        kept = []
        for v in sorted(rows, key=by):
            if not any(dedupe.indel_ratio(v[1], k[1]) > 90 for k in kept):
                kept.append(v)
        assert {v.id for v in dedupe.greedy(df, pairs, "id", order).collect()} == {v[0] for v in kept}


def test_pages_are_parsed_once_and_bodies_once_more(spark):
    pages = spark.createDataFrame([("https://work.example/all", '<a href="/job/1">J</a><SCRIPT DATA-API-RESPONSE>{"x": [{"href": "https://work.example/job/2", "headline": "K"}]}</SCRIPT>')] + [(f"https://work.example/all?p={i}", f'<a href="/job/{i}">J</a>') for i in range(450)], "url string, html string").coalesce(1)
    links = html.detail_links(pages)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 3
    got = [(r.listing_url, r.url, r.discovery_method) for r in links.collect()]
    assert len(got) == 452 and ("https://work.example/all", "https://work.example/job/2", "api") in got


@pytest.mark.parametrize("name", ["platform_listings", "api_bodies", "api_bodies_in_pages", "structured_texts", "extract_fields", "evaluation"])
def test_rows_that_become_pages_are_dealt_out_by_number(spark, sf_dir, name):
    from sluice.plans import cases

    made = cases.job_pages(spark, sf_dir) if name in ("extract_fields", "evaluation") else getattr(cases, name)(spark, sf_dir)
    assert "RepartitionByExpression [p_partkey" in made._jdf.queryExecution().optimizedPlan().toString()


def test_page_text_holds_few_pages_as_strings(spark):
    from pyspark.util import PythonEvalType

    assert html.page_text.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    rows = spark.range(2 * html.SLICE + 1).coalesce(1).select("id", F.when(F.col("id") != 3, F.concat(F.lit("<nav>N</nav><p>p"), F.col("id").cast("string"), F.lit("</p>"))).alias("h"))
    got = {r.id: r.t for r in rows.select("id", html.page_text("h").alias("t")).collect()}
    assert got == {i: None if i == 3 else f"p{i}" for i in range(2 * html.SLICE + 1)}
    assert rows.limit(0).select(html.page_text("h")).count() == 0


def test_links_of_one_spelling_are_made_canonical_once(spark):
    links = spark.createDataFrame([("https://A.example/1", "l1", 1), ("https://A.example/1", "l2", 5), ("https://a.example/1/", "l3", 3), ("https://a.example/2", "l4", None)], "url string, listing_url string, ord long")
    details = spark.createDataFrame([("https://a.example/1#x",), ("https://a.example/2",)], "url string")
    found = lookup.attribute(details, links)
    assert {(r.url, r.listing_url) for r in found.collect()} == {("https://a.example/1#x", "l2"), ("https://a.example/2", None)}
    assert "Aggregate [url#" in found._jdf.queryExecution().optimizedPlan().toString()


def test_exact_dedupe_keeps_best(spark):
    df = spark.createDataFrame([("https://a.example/1?ref=x", "T", "C", None, None, 80, 0), ("https://a.example/1", "T", "C", None, None, 90, 1), (None, "T", "C", None, None, 85, 2), ("", "Z", None, None, None, 1, 3)], "source_url string, title string, company string, role string, location string, score int, ord int")
    assert {r.score for r in dedupe.exact(df).collect()} == {90, 1}
    assert dedupe.exact(dedupe.exact(df).drop("canonical_key")).count() == 2


def test_upserts_and_store(spark, tmp_path):
    schema = "k string, score int, last_seen int, seq int"
    base = spark.createDataFrame([("a", 10, 1, 1), (None, 1, 1, 2)], schema)
    batch = spark.createDataFrame([("a", 5, 2, 3), ("b", 7, 2, 4), ("b", 8, 2, 5), (None, 2, 2, 6)], schema)
    of = lambda p: {tuple(r)[:2] for r in upsert.upsert(base, batch, ["k"], p, "seq").collect()}
    assert of("ignore") == {("a", 10), ("b", 7), (None, 1), (None, 2)}
    assert of("replace") == {("a", 5), ("b", 8), (None, 1), (None, 2)}
    got = {r.k: r for r in upsert.upsert(base, batch, ["k"], "max_score", "seq").filter("k is not null").collect()}
    assert (got["a"].score, got["a"].last_seen, got["b"].score) == (10, 2, 8)
    with pytest.raises(ValueError):
        upsert.upsert(base, batch, ["k"], "other", "seq")
    store = upsert.Store(spark, str(tmp_path / "t"), base.schema)
    assert store.read().count() == 0 and store.merge(base, ["k"], "ignore", "seq") == 2 and store.merge(batch, ["k"], "ignore", "seq") == 2
    assert store.merge(batch.filter("k = 'b'"), ["k"], "ignore", "seq") == 0 and store.has_columns(["k"]) and not store.has_columns(["z"])
    assert store.merge_once(batch, "ab", 0, ["k"], "ignore", "seq") and store.read().count() == 5
    assert not store.merge_once(batch, "ab", 0, ["k"], "ignore", "seq") and store.merge(base.limit(0), ["k"], "ignore", "seq") == 0
    assert not store.merge_once(batch, "ab", 0, ["k"], "ignore", "seq") and store.merge_once(batch, "cd", 0, ["k"], "ignore", "seq") and store.read().count() == 6
    store.reset()
    assert store.read().count() == 0


def test_queries(spark):
    terms = {"frontend": ["frontend intern", "react intern", "Frontend Intern"], "backend": ["go intern"]}
    assert [r.term for r in queries.terms_for(spark, "frontend", terms, " My Query ").orderBy("n").collect()] == ["My Query", "frontend intern", "react intern"]
    made = queries.listed(queries.plan(spark, terms, "my query", "Bali", "frontend", 12))
    assert made[0] == '"my query" "Bali"' and made[1].startswith("site:dealls.com") and len(made) == 12 and len(set(made)) == 12
    assert queries.listed(queries.plan(spark, terms, None, "Bali", "tech", 3)) == ['"frontend intern" "Bali"', '"react intern" "Bali"', '"go intern" "Bali"']
    assert queries.listed(queries.from_raw(spark, "x", "Bali"))[0] == '"x" "Bali"' and len(queries.listed(queries.from_raw(spark, "x", "Bali", "actuarial", {"actuarial": ["y"]}))) == 2 * 8
    assert queries.listed(queries.plan(spark, {}, "alone", "Bali"))[:2] == ['"alone" "Bali"', 'site:dealls.com/loker "alone" "Lamar Cepat"'] and queries.plan(spark, {}, None, "Bali").count() == 0


def test_more_platforms(spark):
    page = [("https://jobs.new.example/all", '<a href="/offer/7">Seven</a><a href="/news">no</a>')]
    df = spark.createDataFrame(page, "url string, html string")
    got = html.detail_links(df, platform=F.lit("new"), more={"new": (r"^/offer/\d+", None, ())}, more_bases={"new": "https://www.new.example"}).collect()
    assert [(r.url, r.title, r.source_platform) for r in got] == [("https://www.new.example/offer/7", "Seven", "new")]
    assert html.detail_links(df).count() == 0


def test_hits_name_companies(spark):
    rows = spark.createDataFrame([("https://a.example/1", None, 1), ("https://a.example/2", "Own", 2), ("https://a.example/3", "", 3)], "url string, company string, n int")
    hits = spark.createDataFrame([("https://A.example/1?utm_source=x", "Late", 5), ("https://a.example/1/", "First", 1), ("https://a.example/2", "Other", 1)], "url string, company string, ord long")
    assert {(r.n, r.company) for r in lookup.with_hit(rows, hits).collect()} == {(1, "First"), (2, "Own"), (3, None)}
    assert [rank.budget(10, n) for n in (0, 3, 9, 20)] == [10, 7, 5, 5]


def test_lookups(spark):
    rows = spark.createDataFrame([("1", "React Intern", "Acme", "Frontend Developer", "tech", "Bali", 90), ("2", "Actuary", None, "Actuarial", "actuarial", None, 50)], "id string, title string, company string, role string, category string, location string, score int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(lookup.filter_list(rows, "Frontend", "bali")) == ["1"] and ids(lookup.filter_list(rows, "Aktuaria")) == ["2"] and ids(lookup.filter_list(rows)) == ["1", "2"]
    assert ids(lookup.filter_fields(rows, "react acme", 80, category=["tech"])) == ["1"]
    lists = spark.createDataFrame([("mine", "react", 80)], "name string, keyword string, min_score int")
    assert [tuple(r) for r in lookup.watch(lists, rows).collect()] == [("mine", "1")]
    hits = spark.createDataFrame([("q", "T", None, "b", "", "https://dealls.com/x")], "query string, title string, snippet string, body string, url string, href string")
    assert tuple(lookup.normalize_hits(hits).first())[1:] == ("T", "b", "https://dealls.com/x", "dealls")
    named = lookup.platforms_named(spark.createDataFrame([(0, 'site:glints.com "x"'), (1, "site:dealls.com")], "ord int, query string"), {"dealls": "site:dealls", "glints": "site:glints"})
    assert [r[0] for r in named.collect()] == ["glints", "dealls"]


def test_queue(spark):
    from datetime import datetime as dt

    from sluice.operators import queue, upsert

    at, rows = dt(2026, 1, 1, 12), []
    for url, event, seq, until, title in [
        ("a", "found", 5, None, "late"), ("a", "found", 1, None, "first"), ("b", "done", 1, None, None), ("b", "found", 2, None, "t"), ("c", "found", 1, None, "t"), ("c", "claim", 2, dt(2026, 1, 1, 13), None), ("d", "found", 1, None, "t"),
        ("d", "claim", 2, dt(2026, 1, 1, 11), None), ("e", "found", 1, None, "t"), ("e", "claim", 2, dt(2026, 1, 1, 13), None), ("e", "release", 3, None, None), ("f", "found", 1, None, "t"), ("f", "done", 3, None, None), ("f", "found", 9, None, "again"),
        ("g", "done", 3, None, None), (None, "found", 1, None, "t"), ("h", "found", 1, None, None), ("h", "found", 1, None, "tie"), ("i", "other", 1, None, None),
    ]:
        rows.append((url, event, seq, until, title, None, "p", None, "dom", seq))
    happened, none = spark.createDataFrame(rows, queue.EVENTS), spark.createDataFrame([], queue.SCHEMA)
    want = {"a": ("first", "pending"), "b": ("t", "pending"), "c": ("t", "leased"), "d": ("t", "pending"), "e": ("t", "pending"), "f": ("t", "done"), "h": (None, "pending")}
    from pyspark.sql import functions as F

    for parts in (["true"], ["seq > 2", "seq <= 2", "seq = 3"]):  # any order, and a batch twice
        table = none
        for p in parts:
            table = queue.apply(table, happened.filter(p))
        assert {r.url: (r.title, r.status) for r in queue.with_status(table, F.lit(at)).collect()} == want
    assert [r.url for r in queue.next_links(table, F.lit(at), 3).collect()] == ["b", "a", "d"]
    assert queue.with_status(queue.apply(none, happened.limit(0)), F.lit(at)).count() == 0
    batch = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", None, "z"), (None, 1, "x"), (None, 1, "x")], "url string, ord long, v string")
    got = lambda policy: sorted((r.url or "", r.v) for r in upsert.settled(batch, ["url"], policy).collect())
    assert got("ignore") == [("", "x"), ("", "x"), ("k", "a")] and got("replace") == [("", "x"), ("", "x"), ("k", "b")]


def test_diversified_cuts_groups_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("id AS ord", "IF(id % 10 = 0, 'rare', 'hot') AS site", "id % 97 AS score")
    out = rank.diversified(df, "site", "score", "ord", 5, {"hot": 2})
    rows = [(r.site, r.score, r.place) for r in out.orderBy("place").collect()]
    assert rows == [("hot", 96, 1), ("rare", 96, 2), ("hot", 96, 3), ("rare", 96, 4), ("rare", 96, 5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
