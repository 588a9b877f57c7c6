"""Commands over a folder of stored tables: ``python -m sluice --root FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import CRAWL_PROFILES, RESEARCH_PROFILES, Lexicon, load, profile
from .operators import extract, lookup, metrics, queries, queue, rank, score
from .operators.dedupe import kept_table
from .operators.upsert import Store, settled
from .plans import runs
from .sources import export, tables

SCHEMAS = {"raw_results": tables.RAW_RESULTS, "raw_pages": tables.RAW_PAGES, "api_responses": tables.API_RESPONSES, "crawl_queue": queue.SCHEMA, "candidates": tables.CANDIDATES, "rejected": tables.REJECTED, "applications": tables.APPLICATIONS}


def opportunity_schema(spark: SparkSession, lexicon: Lexicon, now: datetime):
    """The columns of accepted rows, and what a store adds."""
    none = spark.createDataFrame([], tables.RAW_PAGES)
    scored = score.score_pages(extract.accepted(extract.extract(none, lexicon)), lexicon, now)
    return scored.withColumns({"canonical_key": F.lit(""), "first_seen": F.lit(now), "last_seen": F.lit(now), "seq": F.lit(0).cast("long")}).schema


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("--root", required=True)
    p.add_argument("--lexicon")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("init", "reset", "validate-results", "validate-dashboard-ready", "export", "export-dashboard", "report"):
        s = c.add_parser(name)
        s.add_argument("--out")
        s.add_argument("--target")
        s.add_argument("--yes", action="store_true")
        s.add_argument("--min-results", type=int, default=30)
    for name in ("list", "list-rejections", "list-discovery", "pending", "claim"):
        s = c.add_parser(name)
        s.add_argument("--limit", type=int, default=20)
        s.add_argument("--minutes", type=int, default=60, help="how long a claim holds")
    for name in ("ingest", "eval"):
        s = c.add_parser(name)
        s.add_argument("path")
        s.add_argument("--target")
        s.add_argument("--location")
        s.add_argument("--min-score", type=int, default=40)
    c.add_parser("search").add_argument("hits", help="a folder of search hits")
    for name, first, known in (("crawl-sources", "listings", CRAWL_PROFILES), ("research", "hits", RESEARCH_PROFILES)):
        s = c.add_parser(name)
        s.add_argument(first)
        s.add_argument("pages", help="a folder of fetched pages")
        s.add_argument("--target")
        s.add_argument("--location")
        s.add_argument("--min-score", type=int, default=40)
        s.add_argument("--profile", default="normal", choices=known)
    s = c.add_parser("plan")
    s.add_argument("--query")
    s.add_argument("--target")
    s.add_argument("--location", default="Indonesia")
    s.add_argument("--profile", default="normal", choices=RESEARCH_PROFILES)
    s.add_argument("--terms", help="a file of terms by role")
    a = p.parse_args(argv)
    if a.command == "plan":
        if not (a.query or a.target):
            print("a query or a target is needed", file=sys.stderr)
            return 1
        made = queries.plan(SparkSession.builder.appName("sluice").getOrCreate(), load(a.terms) if a.terms else {}, a.query, a.location, a.target, profile(a.profile).queries)
        print(*queries.listed(made), sep="\n")
        return 0
    if a.command == "reset" and not a.yes:
        print("reset empties all tables but the applications; say --yes", file=sys.stderr)
        return 1
    spark, now = SparkSession.builder.appName("sluice").getOrCreate(), datetime.now(UTC).replace(tzinfo=None)
    lexicon = Lexicon.load(a.lexicon) if a.lexicon else Lexicon()
    stores = {n: Store(spark, f"{a.root}/{n}", spark.createDataFrame([], s).schema) for n, s in SCHEMAS.items()}
    stores["opportunities"] = Store(spark, f"{a.root}/opportunities", opportunity_schema(spark, lexicon, now))
    kept = stores["opportunities"]
    at = int(now.timestamp() * 1000)
    rows, seq, clock = kept.read(), F.lit(at).cast("long"), F.lit(now)

    def save(name: str, batch) -> int:
        """Merge a batch by the table's policy, rows of one key in the order of ``ord``; columns that the batch lacks are null."""
        names, (keys, policy) = stores[name].schema.fields, tables.KEYS[name]
        have = [F.lit(None).cast("string").alias(k) for k in keys if k not in batch.columns]
        batch = settled(batch.select("*", *have), keys, policy) if policy != "max_score" else batch
        batch = batch.withColumn("seq", seq)
        given = dict(batch.dtypes)
        shaped = batch.select(*(F.col(f.name) if given.get(f.name) == f.dataType.simpleString() else (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in names))
        return stores[name].merge(shaped, *tables.KEYS[name], "seq")

    def happened(links, event: str, step: int, until=None) -> None:
        """Tell the queue; ``step`` orders the events of one command."""
        told = kept_table(spark, queue.events(links, event, F.lit(at * 4 + step), until))
        stores["crawl_queue"].write(queue.apply(stores["crawl_queue"].read(), told))

    def fetched(pages) -> None:
        """Keep pages and the bodies that came with them, and tell the queue that they are fetched."""
        save("raw_pages", pages)
        if "api_responses" in pages.columns:
            save("api_responses", pages.select(F.posexplode("api_responses").alias("ord", "r")).select("ord", "r.*"))
        happened(pages.select("url").distinct(), "done", 3)

    if a.command in ("init", "reset"):
        for n, s in stores.items():
            if a.command == "init" and not s.version() or a.command == "reset" and n != "applications":
                s.reset()
    elif a.command == "list":
        rank.top(rows, [F.desc("score"), F.asc("canonical_key")], a.limit).select("score", F.substring("title", 1, 40).alias("title"), "company", "role", "location", "source_platform").show(a.limit, False)
    elif a.command == "list-rejections":
        rank.top(stores["rejected"].read(), [F.desc("seq"), F.asc("url")], a.limit).select("rejection_reason", F.substring("title", 1, 40).alias("title"), "url").show(a.limit, False)
    elif a.command == "list-discovery":
        rank.top(stores["candidates"].read(), [F.desc("seq"), F.asc("url")], a.limit).select("status", F.coalesce("title", "url").alias("title"), "source_platform", "target_score").show(a.limit, False)
    elif a.command in ("pending", "claim"):
        chosen = kept_table(spark, queue.next_links(stores["crawl_queue"].read(), clock, a.limit))
        if a.command == "claim":
            happened(chosen.select("url"), "claim", 1, clock + F.make_interval(mins=F.lit(a.minutes)))
        chosen.orderBy(F.desc_nulls_last("target_score"), "found_seq", "url").select("target_score", "source_platform", "url", "title").show(a.limit, False)
    elif a.command == "search":
        hits = lookup.normalize_hits(spark.read.parquet(a.hits))
        print("added", save("raw_results", hits))
    elif a.command in ("ingest", "crawl-sources", "research"):
        settings = runs.Settings(lexicon, now, target=a.target, location=a.location, min_score=a.min_score)
        links, pages = None, spark.read.parquet(a.path if a.command == "ingest" else a.pages)
        if a.command == "ingest":
            good, bad = runs.accept(pages, settings)
        elif a.command == "crawl-sources":
            limits = profile(a.profile, CRAWL_PROFILES)
            good, bad, links = runs.crawl(spark.read.parquet(a.listings), pages, settings, limits.per_query, limits.fetches)
            save("raw_pages", spark.read.parquet(a.listings).withColumnsRenamed({"html": "html_content"}).withColumn("page_type", F.lit("listing")))
            happened(links, "found", 0)
        else:
            hits, limits = spark.read.parquet(a.hits), profile(a.profile)
            good, bad, ranked = runs.research(hits, pages, settings, limits.fetches)
            links = ranked.withColumns({"listing_url": F.lit(""), "company": F.lit(None).cast("string"), "discovery_method": F.lit("search"), "target_score": F.col("url_score")})
            save("raw_results", hits)
        good, bad = kept_table(spark, good), kept_table(spark, bad)
        fetched(pages)
        if links is not None:
            print("candidates", save("candidates", runs.candidates(links, good, bad, a.target)))
        print("added", save("opportunities", good.withColumns({"first_seen": F.lit(now), "last_seen": F.lit(now)})), "rejected", save("rejected", bad))
    elif a.command == "eval":
        runs.evaluate(tables.read_labels(spark, a.path), runs.Settings(lexicon, now, target=a.target, min_score=a.min_score))[1].show(truncate=False)
    elif a.command == "export":
        shown = rows.withColumn("id", F.col("canonical_key"))
        export.write_csv(shown, f"{a.out}/csv")
        export.write_json(shown, f"{a.out}/json", [x for x in export.V.EXPORT_COLUMNS])
    elif a.command == "export-dashboard":
        export.export_dashboard(rows.withColumn("id", F.col("canonical_key")), f"{a.out}/dashboard", now)
    elif a.command == "report":
        export.write_text(spark, export.report(rows, now.date().isoformat()), f"{a.out}/report")
    else:
        if a.command == "validate-results":
            found = metrics.issues(rows, metrics.result_rules(lexicon, a.target), "title")
        else:
            found = metrics.dashboard_gate(export.dashboard_rows(rows.withColumn("id", F.col("canonical_key"))), a.min_results, stores["applications"].read())
        found.groupBy("hard", "rule").count().orderBy(F.desc("hard"), "rule").show(100, False)
        few = metrics.diversity(rows, "source_platform").first()
        if few.gate_warning:
            print("warning: all results are of one source")
        verdict = metrics.verdict(found).first()
        print(verdict.verdict)
        return int(verdict.issues > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
