"""De-duplication: exact by key, by richness, and greedy by similar titles."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import urls
from ..functions.text import blank_to_null, canonical_key, normalize
from .rank import first_of_each


def union_first(frames: list[DataFrame], key: str, order: str = "ord") -> DataFrame:
    """All rows, earlier frames first, each key once."""
    from functools import reduce

    tagged = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    return first_of_each(reduce(DataFrame.unionByName, tagged), [key], ["_from", order]).drop("_from")


def by_canonical_url(df: DataFrame, url: str = "url", order: str = "ord") -> DataFrame:
    """The url canonical, empty ones gone, the first row of each kept."""
    return first_of_each(df.withColumn(url, urls.canonical(url)).filter(F.col(url) != ""), [url], [order])


def distinct_ignoring_case(df: DataFrame, column: str, order: str = "ord") -> DataFrame:
    """The first spelling of each text, in the order of the input; blank ones go."""
    return first_of_each(df.filter(F.trim(column) != "").withColumn("_k", F.lower(F.trim(column))), ["_k"], [order]).drop("_k")


def link_richness(company: str = "company", title: str = "title", method: str = "discovery_method"):
    yes = lambda c, n: F.when(c, n).otherwise(0)
    return yes(blank_to_null(company).isNotNull(), 30) + yes(blank_to_null(title).isNotNull(), 20) + yes(F.coalesce(F.col(method) == "card", F.lit(False)), 10)


def richest_links(df: DataFrame, order: str = "ord") -> DataFrame:
    """For each detail the link that knows most; the first of equals."""
    job = F.regexp_extract("url", r"/(?:id/)?job/(\d+)", 1)
    site = F.coalesce(blank_to_null("source_platform"), urls.platform("url"))
    key = F.when((site == "jobstreet") & (job != ""), F.concat(F.lit("jobstreet:"), job)).otherwise(urls.canonical("url"))
    return first_of_each(df.withColumn("_k", key).withColumn("_rich", link_richness()), ["_k"], [F.desc("_rich"), F.asc(order)]).drop("_k", "_rich")


def exact(df: DataFrame, url: str = "source_url", score: str = "score", order: str = "ord", title: str = "title", company: str = "company", role: str = "role", place: str = "location") -> DataFrame:
    """Two stages: the best row of each canonical url, then of each canonical key; rows without url skip the first."""
    best = [F.desc(score), F.asc(order)]
    df = df.withColumn(url, urls.canonical(url))
    with_url = first_of_each(df.filter(F.col(url) != ""), [url], best)
    rows = with_url.unionByName(df.filter(F.coalesce(F.col(url), F.lit("")) == ""))
    rows = rows.withColumn("canonical_key", canonical_key(title, company, role, place, urls.domain(url)))
    return first_of_each(rows, ["canonical_key"], best)


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths), by a bit-parallel longest common subsequence."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    s = every
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & every
    return 200.0 * (len(a) - s.bit_count()) / total


@pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)])


def _most_edits(n1: int, n2: int) -> int:
    """The most insertions and deletions that leave a ratio beyond 90."""
    return -(-(n1 + n2) // 10) - 1


def _pieces(n: int, edits: int) -> list[tuple[int, int]]:
    bounds = [i * n // (edits + 1) for i in range(edits + 2)]
    return list(zip(bounds, bounds[1:]))


def index_keys(t: str) -> set[str]:
    """The pieces of a text as the shorter of a pair: one of them is unchanged in any similar longer text."""
    n, keys = len(t), set()
    for edits in {e for m in range(n, n * 11 // 9 + 1) if (e := _most_edits(n, m)) > 0}:
        keys |= {f"{n}:{edits}:{i}:{t[a:b]}" for i, (a, b) in enumerate(_pieces(n, edits))}
    return keys


def probe_keys(t: str) -> set[str]:
    """The parts of a text as the longer of a pair that may be a shorter one's piece, near enough to its place."""
    m, keys = len(t), set()
    for n in range(-(-m * 9 // 11), m + 1):
        edits = _most_edits(n, m)
        if edits <= 0:
            continue
        for i, (a, b) in enumerate(_pieces(n, edits)):
            low = max(0, a - i, a + (m - n) - (edits - i))
            high = min(m - (b - a), a + i, a + (m - n) + (edits - i))
            keys |= {f"{n}:{edits}:{i}:{t[p : p + b - a]}" for p in range(low, high + 1)}
    return keys


def _keyed(df: DataFrame, keys) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = [(t, k) for t in f["t"] for k in keys(t)]
            yield pd.DataFrame(rows, columns=["t", "key"])

    return df.select("t").mapInPandas(run, "t string, key string").select("t", F.xxhash64("key").alias("key"))


def similar_pairs(df: DataFrame, key: str, title: str, role: str | None = None, place: str | None = None) -> DataFrame:
    """a < b: pairs of rows of similar titles: an indel ratio beyond 90 with equal role or place, or beyond 95.

    Rows of equal titles, roles and places are one class, of which each is linked to the first alone (``copy``), so copies make no
    pairs of each other; other classes are linked by their firsts. Distinct titles meet by unchanged pieces: a title that so few edits turn into a longer one has, cut into one more piece
    than edits, a piece that the longer one holds near the same place. So no group of titles is compared all with all. There are hundreds of pieces a title, which Spark can't
    foresee, so they are sorted and merged, never broadcast. Pairs of more edits than a similar pair can have, substitutions counted as one, go as they meet.
    """
    named = df.select(F.col(key).alias("k"), normalize(title).alias("t"), (normalize(role) if role else F.lit("")).alias("r"), (normalize(place) if place else F.lit("")).alias("p"))
    classes = kept_table(df.sparkSession, named.groupBy("t", "r", "p").agg(F.min("k").alias("k")))
    copies = named.join(classes.select("t", "r", "p", F.col("k").alias("a")), ["t", "r", "p"]).filter("k != a").select("a", F.col("k").alias("b"))
    texts = classes.select("t").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t").distinct()  # by number: few bytes make much work
    short, long = _keyed(texts, index_keys).withColumnRenamed("t", "t1"), _keyed(texts, probe_keys).withColumnRenamed("t", "t2")
    met = short.hint("merge").join(long, "key").filter((F.length("t1") < F.length("t2")) | (F.length("t1") == F.length("t2")) & (F.col("t1") < F.col("t2")))
    close = met.filter("levenshtein(t1, t2, CAST(ceil((length(t1) + length(t2)) / 10) AS INT) - 1) >= 0").select("t1", "t2").distinct()
    alike = close.select("t1", "t2", title_similarity("t1", "t2").alias("ratio")).filter("ratio > 90")
    same = texts.select(F.col("t").alias("t1"), F.col("t").alias("t2"), F.lit(100.0).alias("ratio"))
    side = lambda n: classes.select(*(F.col(c).alias(f"{c}{n}") for c in "trpk"))
    both = alike.unionByName(same).join(side(1), "t1").join(side(2), "t2").filter("k1 != k2").filter("r1 = r2 OR p1 = p2 OR ratio > 95")
    return both.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct().select("a", "b", F.lit(False).alias("copy")).union(copies.select("a", "b", F.lit(True)))


def greedy(df: DataFrame, pairs: DataFrame, key: str, order: list) -> DataFrame:
    """Rows in order, each kept unless it is similar to one kept before.

    The same as going through the rows one by one, done in rounds: a row whose earlier neighbours have all been dropped is kept, and what
    a kept row is similar to is dropped. pairs: (a, b) keys; where ``copy`` tells that b is a copy of a, the first of its class, all of the class have
    the neighbours of a. Then only the earliest of each class by ``order`` is gone through, and its copies are dropped: if it is not kept, they are similar to the same row.
    """
    spark = df.sparkSession
    ranked = df.select(F.col(key).alias("k"), F.struct(*order).alias("o"))
    dropped = None
    if "copy" in pairs.columns:
        pairs = kept_table(spark, pairs)
        copies = pairs.filter("copy").select(F.col("a").alias("class"), F.col("b").alias("k"))
        members = kept_table(spark, copies.union(copies.select("class", F.col("class").alias("k")).distinct()).join(ranked, "k"))
        earliest = kept_table(spark, members.groupBy("class").agg(F.min_by("k", "o").alias("head")))
        dropped = kept_table(spark, members.join(earliest, "class").filter("k != head").select("k"))
        head = lambda c: earliest.select(F.col("class").alias(c), F.col("head").alias(f"h{c}"))
        pairs = pairs.filter("NOT copy").join(head("a"), "a", "left").join(head("b"), "b", "left").select(F.coalesce("ha", "a").alias("a"), F.coalesce("hb", "b").alias("b"))
    edges = pairs.join(ranked.withColumnRenamed("k", "a").withColumnRenamed("o", "oa"), "a").join(ranked.withColumnRenamed("k", "b").withColumnRenamed("o", "ob"), "b")
    first = F.col("oa") < F.col("ob")
    open_ = kept_table(spark, edges.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")))
    while not open_.isEmpty():
        kept = open_.select(F.col("early").alias("k")).join(open_.select(F.col("late").alias("k")), "k", "left_anti").distinct()
        lost = kept_table(spark, open_.join(kept, open_.early == kept.k, "left_semi").select(F.col("late").alias("k")).distinct())
        dropped = lost if dropped is None else dropped.union(lost)
        gone = lost.select(F.col("k").alias("g"))
        left = open_.join(gone, F.col("early") == F.col("g"), "left_anti").join(gone, F.col("late") == F.col("g"), "left_anti").join(kept, F.col("early") == kept.k, "left_anti")
        open_ = kept_table(spark, left)
    return df if dropped is None else df.join(dropped, df[key] == dropped.k, "left_anti")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; only where that is unset (tests) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"


def kept_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
