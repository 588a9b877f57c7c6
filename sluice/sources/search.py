"""Search providers as a Spark data source. A provider is any callable from (query, most) to a list of hits; what it
gives is a table like any other. Without a network there is a provider over stored hits."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.dedupe import by_canonical_url
from ..operators.lookup import normalize_hits

HITS = "query string, title string, snippet string, url string, ord long"
#: Fields of a provider's hits that mean title, snippet and url.
FIELDS = {"title": ("title", "name"), "snippet": ("snippet", "body", "description", "content"), "url": ("url", "href", "link")}


def chosen_provider(name: str = "auto", env=os.environ) -> str:
    """A provider that needs a key is taken only if there is one."""
    keys = {"brave": "BRAVE_SEARCH_API_KEY", "serper": "SERPER_API_KEY", "tavily": "TAVILY_API_KEY"}
    if name == "auto":
        return next((p for p, k in keys.items() if env.get(k)), "ddgs")
    return name if name not in keys or env.get(keys[name]) else "ddgs"


def search(queries: DataFrame, provider: Callable[[str, int], list[dict]], most: int = 10, workers: int = 8) -> DataFrame:
    """Hits of all queries, ``workers`` at once, in the order of the queries, each canonical url once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for at, q in zip(f["ord"], f["query"]):
                for i, hit in enumerate(provider(q, most)[:most]):
                    rows.append((q, *(next((hit[n] for n in names if hit.get(n)), None) for names in FIELDS.values()), int(at) * 1000 + i))
            yield pd.DataFrame(rows, columns=["query", "title", "snippet", "url", "ord"])

    hits = queries.select("ord", "query").repartition(workers).mapInPandas(run, HITS)
    return by_canonical_url(normalize_hits(hits))


class StoredHits(DataSource):
    """``spark.read.format("stored_hits").option("path", file)``: hits from a file of JSON lines."""

    @classmethod
    def name(cls) -> str:
        return "stored_hits"

    def schema(self) -> str:
        return HITS

    def reader(self, schema) -> DataSourceReader:
        return _StoredReader(self.options)


class _StoredReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with open(self.path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                d = json.loads(line)
                yield d.get("query"), d.get("title"), d.get("snippet"), d.get("url"), i


def seeds(spark: SparkSession, defined: dict[str, list[tuple[str, str, str]]], target: str = "tech", query: str | None = None, location: str = "") -> DataFrame:
    """Fixed listing pages as hits: (platform, url, title) by target; unknown targets take those of tech."""
    rows = [(f"seed:{p}:{target}", t, " ".join(x for x in (query, target, location, "intern internship magang") if x), u, "seed", "listing", p, i) for i, (p, u, t) in enumerate(defined.get(target, defined.get("tech", [])))]
    return spark.createDataFrame(rows, "query string, title string, snippet string, url string, source string, page_type string, source_platform string, ord long")


def with_seeds(hits: DataFrame, seeded: DataFrame) -> DataFrame:
    """Seeds whose url no hit has, after the hits."""
    new = seeded.join(hits.select("url"), "url", "left_anti").withColumn("ord", F.col("ord") + 1_000_000_000)
    return hits.unionByName(new, allowMissingColumns=True)
