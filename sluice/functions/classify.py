"""Decisions on a page: is it an internship, which role and category, does it fit the target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..config import Lexicon
from .text import blank_to_null, col, contains_any, count_terms, count_words_in_context, first_term, lowered, mapped, matches_any, once, plain_lower


def is_intern_title(title, patterns=V.INTERN_TITLE, plain: Column | None = None) -> Column:
    return matches_any(title, patterns, plain)


def is_target_intern_title(title) -> Column:
    return matches_any(title, V.TARGET_INTERN_TITLE)


def is_senior_title(title) -> Column:
    """A senior title that does not itself name an internship."""
    return ~is_intern_title(title) & matches_any(title, V.SENIOR_TITLE)


def passes_early(title) -> Column:
    """Before pages are fetched: titles that are clearly senior go, unless they name an internship."""
    low = lowered(title)
    return (low == "") | contains_any(low, V.EARLY_INTERN) | ~contains_any(low, V.EARLY_SENIOR)


def internship(text, title, lexicon: Lexicon, plain_title: Column | None = None) -> Column:
    """ok, confidence, source: a decision list. ``plain_title``: the title's ``plain_lower``, if at hand."""
    of = lambda ok, n, why: F.struct(F.lit(ok).alias("ok"), (n if isinstance(n, Column) else F.lit(n)).alias("confidence"), F.lit(why).alias("source"))

    def by_counts(n: Column) -> Column:
        return (
            F.when(n["strong"] >= 2, of(True, F.least(n["strong"] * 15 + 30, F.lit(85)), "description_strong"))
            .when((n["strong"] >= 1) & (n["other"] == 0), of(True, 60, "description_single_strong"))
            .when((n["strong"] >= 1) & (n["weak"] >= 1), of(True, 55, "description_weak_plus_strong"))
            .when((n["other"] > 0) & (n["strong"] == 0), of(False, 0, "non_internship_title"))
            .otherwise(of(False, 0, "no_signal"))
        )

    def decided(of_text: Column) -> Column:
        low, low_title, title, plain = (of_text[k] for k in ("low", "low_title", "title", "plain"))
        strong = count_words_in_context(low, lexicon.strong, V.PRIOR_INTERNSHIP) + count_terms(low, V.EXTRA_STRONG)
        weak, other = count_terms(low, lexicon.weak), count_terms(low_title, lexicon.non_internship)
        return (
            F.when(contains_any(low, lexicon.hard_reject), of(False, 0, "hard_reject"))
            .when(contains_any(low_title, lexicon.likely_not_job), of(False, 0, "likely_not_job"))
            .when(is_intern_title(title, plain=plain), of(True, 90, "title_strong"))
            .when(matches_any(title, V.SENIOR_TITLE, plain), of(False, 0, "seniority_without_internship_title"))
            .otherwise(once(F.struct(strong.alias("strong"), weak.alias("weak"), other.alias("other")), by_counts))
        )

    return once(F.struct(lowered(text, 3000).alias("low"), lowered(title).alias("low_title"), col(title).alias("title"), (plain_lower(title) if plain_title is None else plain_title).alias("plain")), decided)


def role(title, text, lexicon: Lexicon, plain_title: Column | None = None) -> Column:
    """name, confidence of the role of the highest confidence; the first of equals."""
    none = F.lit(None).cast("struct<confidence:int,back:int,name:string>")

    def best(of_text: Column) -> Column:
        low, head = of_text["low"], of_text["head"]
        found = [
            F.when(
                contains_any(low, r.strong) & ~contains_any(low, r.exclude),
                F.struct((F.lit(70) + F.least(count_terms(head, r.skills) * 10, F.lit(30))).alias("confidence"), F.lit(-i).alias("back"), F.lit(r.name).alias("name")),
            )
            for i, r in enumerate(lexicon.roles)
        ]
        intern = F.when(is_intern_title(of_text["title"], plain=of_text["plain"]), 20).otherwise(0)  # the same for all roles
        named = lambda b: F.struct(b["name"].alias("name"), F.when(b.isNotNull(), b["confidence"] + intern).otherwise(0).alias("confidence"))
        return once(F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull())) if found else none, named)

    return once(F.struct(lowered(title).alias("low"), lowered(text, 1500).alias("head"), col(title).alias("title"), (plain_lower(title) if plain_title is None else plain_title).alias("plain")), best)


def suspicious_role(title, lexicon: Lexicon) -> Column:
    return first_term(lowered(title), lexicon.suspicious_roles)


def category(role) -> Column:
    return mapped(role, V.ROLE_CATEGORIES)


def _underscored(c) -> Column:
    return F.translate(F.lower(F.trim(col(c))), "- ", "__")


_KEY_OF_NAME = {name.lower().replace("/", "_").replace(" ", "_"): key for key, name in V.ROLE_NAMES.items()}


def role_key(role) -> Column:
    c = F.translate(_underscored(blank_to_null(role)), "/", "_")
    return mapped(c, _KEY_OF_NAME, c)


def target(c) -> Column:
    """The canonical name of a target; unknown names stay."""
    t = blank_to_null(_underscored(c))
    return mapped(t, V.TARGET_ALIASES | {k: k for k in (*V.TOP_CATEGORIES, *V.ROLE_NAMES)} | {k: v for k, v in _KEY_OF_NAME.items() if k not in V.TARGET_ALIASES}, t)


def target_name(value: str | None) -> str | None:
    """The same for a setting."""
    t = (value or "").strip().lower().replace("-", "_").replace(" ", "_")
    if not t:
        return None
    return V.TARGET_ALIASES.get(t) or (t if t in V.TOP_CATEGORIES or t in V.ROLE_NAMES else _KEY_OF_NAME.get(t, t))


def matches_target(role, category, wanted: str | None) -> Column:
    wanted = target_name(wanted)
    if not wanted:
        return F.lit(True)
    return F.coalesce(col(category) == wanted if wanted in V.TOP_CATEGORIES else role_key(role) == wanted, F.lit(False))
