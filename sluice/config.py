"""Lexicons and limits as configuration: a YAML or JSON file, or plain dictionaries.

Groups and terms keep their order, since the first match wins.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import vocabulary as V


@dataclass(frozen=True)
class Role:
    """A role's terms: titles that make it, skills that strengthen it, titles that rule it out."""

    key: str
    strong: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return V.ROLE_NAMES.get(self.key, self.key.replace("_", " ").title())


@dataclass(frozen=True)
class Lexicon:
    """All term lists of the extractor and the scorer."""

    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    non_internship: tuple[str, ...] = ()
    roles: tuple[Role, ...] = ()
    places: tuple[tuple[str, tuple[str, ...]], ...] = ()
    work_modes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    hard_reject: tuple[str, ...] = ()
    likely_not_job: tuple[str, ...] = ()
    suspicious_roles: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Lexicon:
        terms, negative = d.get("internship_terms", {}), d.get("negative_terms", {})
        low = lambda xs: tuple(str(x).lower() for x in xs or ())
        roles = tuple(Role(k, low(r.get("strong_titles")), low(r.get("supporting_skills")), low(r.get("exclude_titles"))) for k, r in d.get("role_keywords", {}).items() if isinstance(r, dict))
        places = tuple((k, tuple(str(x) for x in v)) for k, v in d.get("locations", {}).items() if isinstance(v, list))
        modes = tuple((k, low(d.get("work_modes", {}).get(k))) for k in ("hybrid", "remote", "onsite"))
        return cls(low(terms.get("strong")), low(terms.get("weak")), low(d.get("non_internship_terms")), roles, places, modes, low(negative.get("hard_reject")), low(negative.get("likely_not_job")), tuple(str(x) for x in negative.get("suspicious_roles", ())))

    @classmethod
    def load(cls, path: str | Path) -> Lexicon:
        return cls.from_dict(load(path))

    def frame(self, spark: SparkSession) -> DataFrame:
        """group, group_ord, kind, term, term_ord, weight: a row for each role term."""
        rows = [(r.key, g, kind, t, i, w) for g, r in enumerate(self.roles) for kind, ts, w in (("strong", r.strong, 100), ("skill", r.skills, 15), ("exclude", r.exclude, 0)) for i, t in enumerate(ts)]
        return spark.createDataFrame(rows, "group string, group_ord int, kind string, term string, term_ord int, weight int")


@dataclass(frozen=True)
class Scoring:
    score: dict[str, int] = field(default_factory=lambda: dict(V.SCORES))
    penalty: dict[str, int] = field(default_factory=lambda: dict(V.PENALTIES))

    @classmethod
    def load(cls, path: str | Path) -> Scoring:
        d = load(path)
        return cls(V.SCORES | d.get("score", {}), V.PENALTIES | d.get("penalty", {}))


@dataclass(frozen=True)
class Profile:
    """Limits of a run."""

    queries: int
    fetches: int
    workers: int
    timeout: int
    per_query: int


RESEARCH_PROFILES = {"fast": Profile(12, 20, 8, 8, 8), "normal": Profile(36, 80, 8, 10, 12), "deep": Profile(50, 100, 10, 12, 12)}
#: sources, details per source, details in all, workers, timeout
CRAWL_PROFILES = {"quick": Profile(3, 15, 5, 10, 5), "normal": Profile(8, 60, 6, 10, 10), "deep": Profile(15, 150, 8, 12, 20)}


def profile(name: str, known: dict[str, Profile] = RESEARCH_PROFILES) -> Profile:
    if name not in known:
        raise ValueError(f"no profile {name!r}; there are {', '.join(known)}")
    return known[name]


def load(path: str | Path) -> dict[str, Any]:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def source_entries(spark: SparkSession, config: dict[str, Any], target: str | None = None) -> DataFrame:
    """tier, name, platform, type, url, ord: role sources of the target first, then the plain list, then tiers by name; each url once."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    found: list[tuple] = []

    def add(tier: str, entries) -> None:
        for e in entries or ():
            if isinstance(e, str):
                e = {"url": e, "name": "manual_" + re.sub(r"^[^:]+://|[/?#].*$", "", e)}
            if e.get("url"):
                found.append((tier, e.get("name"), e.get("platform"), e.get("type", "listing"), e["url"], len(found)))

    if target:
        add(f"role:{target}", (config.get("role_sources") or {}).get(target))
    add("legacy", config.get("manual_sources"))
    for tier in sorted(config.get("sources") or {}):
        add(tier, config["sources"][tier])
    rows = spark.createDataFrame(found, "tier string, name string, platform string, type string, url string, ord int")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("url").orderBy("ord"))).filter("n = 1").drop("n")
