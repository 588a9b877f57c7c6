"""A queue of links to fetch: each url once, claimed for a time and finished.

What happens to a link is an event: ``found``, ``claim`` (until a time), ``release`` or ``done``, each with ``seq``, which grows with time. A table of the
queue has one row a url: its first find with what was known of the link, the last ``done`` and the last claim or release. These are least and
greatest values, so events may come in batches of any size and order, more than once, from a table or a stream, and give the same queue; copies of a
url are combined before they are shuffled. A worker that dies gives its links back when their time is over.

Claims and ends of a url count only after it was found. A link that is done stays done, however often it is found again. Finds of equal ``seq`` are settled
by their values, in the order of the columns, nulls first. Events of null url, or of another kind, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = {"title": "string", "company": "string", "source_platform": "string", "listing_url": "string", "discovery_method": "string", "target_score": "int"}
EVENTS = ", ".join(["url string, event string, seq long, until timestamp", *(f"{c} {t}" for c, t in LINK.items())])
SCHEMA = ", ".join(["url string, found_seq long", *(f"{c} {t}" for c, t in LINK.items()), "done_seq long, lease_seq long, leased_until timestamp"])


def events(links: DataFrame, event: str, seq: Column, until: Column | None = None) -> DataFrame:
    """One event for each of the links; columns that they lack are null."""
    given = lambda c, t: (F.col(c) if c in links.columns else F.lit(None)).cast(t).alias(c)
    return links.select("url", F.lit(event).alias("event"), seq.cast("long").alias("seq"), (F.lit(None) if until is None else until).cast("timestamp").alias("until"), *(given(c, t) for c, t in LINK.items()))


def _rows(happened: DataFrame) -> DataFrame:
    """Each event as a queue of its own."""
    found, lease = F.col("event") == "found", F.col("event").isin("claim", "release")
    link = [F.when(found, F.col(c)).alias(c) for c in LINK]
    until = F.when(F.col("event") == "claim", F.col("until"))
    return happened.filter(found | lease | (F.col("event") == "done")).select("url", F.when(found, F.col("seq")).alias("found_seq"), *link, F.when(F.col("event") == "done", F.col("seq")).alias("done_seq"), F.when(lease, F.col("seq")).alias("lease_seq"), until.alias("leased_until"))


def apply(table: DataFrame, happened: DataFrame) -> DataFrame:
    """The table after the events."""
    both = table.unionByName(_rows(happened)).filter("url IS NOT NULL")
    found = F.min(F.when(F.col("found_seq").isNotNull(), F.struct("found_seq", *LINK)))
    lease = F.max(F.when(F.col("lease_seq").isNotNull(), F.struct("lease_seq", "leased_until")))
    one = both.groupBy("url").agg(found.alias("f"), F.max("done_seq").alias("done_seq"), lease.alias("l"))
    return one.select("url", "f.found_seq", *(f"f.{c}" for c in LINK), "done_seq", "l.lease_seq", "l.leased_until")


def with_status(table: DataFrame, now: Column) -> DataFrame:
    """The links that were found, each pending, leased or done."""
    leased = (F.col("lease_seq") > F.col("found_seq")) & (F.col("leased_until") > now)
    return table.filter("found_seq IS NOT NULL").withColumn("status", F.when(F.col("done_seq") > F.col("found_seq"), "done").when(leased, "leased").otherwise("pending"))


def pending(table: DataFrame, now: Column) -> DataFrame:
    return with_status(table, now).filter("status = 'pending'")


def next_links(table: DataFrame, now: Column, n: int) -> DataFrame:
    """The n pending links of the best score, of equal ones those found first."""
    return pending(table, now).orderBy(F.desc_nulls_last("target_score"), "found_seq", "url").limit(n)
