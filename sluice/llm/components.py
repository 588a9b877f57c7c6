"""Connected components of a table of links, by alternating large and small stars.

Every round is a few joins and aggregations over the links that are left; nothing is gathered on the driver but two
numbers a round, which tell whether the links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: of each linked node the smallest node that it reaches. links: two columns of equal type, without nulls."""
    a, b = links.columns
    links = durable(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct())
    before = None
    while True:
        links = durable(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
