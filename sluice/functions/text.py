"""Text and lexicon functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Empty strings count as missing."""
    return F.nullif(col(c), F.lit(""))


def lowered(c: Column | str, n: int | None = None) -> Column:
    """Lower case of the first n characters; null counts as empty."""
    c = F.coalesce(col(c), F.lit(""))
    return F.lower(F.substring(c, 1, n) if n else c)


def _joined(patterns: Sequence[str]) -> str:
    """A pattern of any of the patterns. Those between borders of words share them: a border is dear to look for at every place."""
    words = [p for p in patterns if re.fullmatch(r"\\b[^|]*\w\\b", p)]
    parts = [r"\b(?:" + "|".join(p[2:-2] for p in words) + r")\b"] if words else []
    return "(?iU)" + "|".join([*parts, *(f"(?:{p})" for p in patterns if p not in words)])


def _begins(pattern: str) -> str:
    """The letters with which every match begins, or none."""
    found = None if "|" in pattern else re.match(r"(?:\\b)?([a-z][a-z -]+)(?![a-z -]|[?*{])", pattern)
    return found[1] if found else ""


def plain_lower(c: Column | str) -> Column:
    """Lower case, or null where a letter outside ASCII matches one in it when case does not count."""
    c = col(c)
    return F.when(~reduce(lambda a, b: a | b, (F.contains(c, F.lit(x)) for x in "ıİſ\u212a")), F.lower(c))


def matches_any(c: Column | str, patterns: Sequence[str], plain: Column | None = None) -> Column:
    """Whether any pattern is found, case aside; null counts as no.

    ``plain``, for long texts of which few match: their ``plain_lower``, computed before. A pattern is looked for only where this is null
    or contains how it begins."""
    c = col(c)
    found = lambda ps: F.coalesce(c.rlike(_joined(ps)), F.lit(False))
    begins = {p: _begins(p) for p in patterns} if plain is not None else {}
    some = [p for p in patterns if begins.get(p)]
    if not some:
        return found(patterns)
    parts = dict.fromkeys(begins[p] for p in some)
    maybe = reduce(lambda a, b: a | b, (F.contains(plain, F.lit(b)) for b in parts if not any(o in b and o != b for o in parts)))
    rare = F.coalesce(maybe, F.lit(True)) & found(some)
    others = [p for p in patterns if p not in some]
    return rare | found(others) if others else rare


def quoted(terms: Sequence[str]) -> str:
    """A pattern of any of the terms as they are."""
    return "|".join("\\Q" + t.replace("\\E", "") + "\\E" for t in terms if t)


def contains_any(c: Column | str, terms: Sequence[str]) -> Column:
    """Whether any term is a part of the text: one pattern, however many terms there are."""
    return F.coalesce(col(c).rlike(quoted(terms)), F.lit(False)) if any(terms) else F.lit(False)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often it is named."""
    return F.transform(F.array(value), use)[0]


def listed(terms: Sequence[str]) -> Column:
    """The terms as one literal array, so that the expression's depth does not grow with the lexicon."""
    return F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")


def first_term(c: Column | str, terms: Sequence[str]) -> Column:
    """The first term in list order that is a part of the text, else null."""
    return F.try_element_at(F.filter(listed(terms), lambda t: F.contains(col(c), F.lower(t))), F.lit(1))


def count_terms(c: Column | str, terms: Sequence[str]) -> Column:
    """How many of the terms are a part of the text, however often."""
    return F.array_size(F.filter(listed(terms), lambda t: F.contains(col(c), t))) if terms else F.lit(0)


def added(numbers: Sequence[Column]) -> Column:
    """The sum, as a tree of little depth."""
    numbers = list(numbers) or [F.lit(0)]
    while len(numbers) > 1:
        numbers = [numbers[i] + numbers[i + 1] if i + 1 < len(numbers) else numbers[i] for i in range(0, len(numbers), 2)]
    return numbers[0]


def weighted_terms(c: Column | str, weights: Sequence[tuple[str, int]]) -> Column:
    return added([F.when(F.contains(col(c), F.lit(t)), n).otherwise(0) for t, n in weights])


def first_group(c: Column | str, groups: Sequence[tuple[str, Sequence[str]]], default: str | None, patterns: bool = False) -> Column:
    """The name of the first group of which a term (or pattern) is found."""
    found = F.coalesce(*(F.when(matches_any(c, ts) if patterns else contains_any(c, ts), F.lit(g)) for g, ts in groups)) if groups else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(default)) if default is not None else found


def count_words_in_context(c: Column | str, terms: Sequence[str], unless: str, around: int = 60) -> Column:
    """How many terms stand as words in the text, unless ``unless`` is found around their first place."""
    c, found = col(c), []

    def stands(t: str) -> Callable[[Column], Column]:
        def at_first_place(at: Column) -> Column:
            begin = F.greatest(at - around, F.lit(1))
            window = F.substring(c, begin, at + len(t) + around - begin)
            return F.when((at > 0) & ~window.rlike("(?iU)" + unless), 1).otherwise(0)

        return at_first_place

    for t in terms:
        word = F.regexp_instr(c, F.lit(r"(?U)(?=\Q" + t + r"\E)\b\Q" + t + r"\E\b"))  # its letters are found sooner than borders
        found.append(F.when(F.contains(c, F.lit(t)), once(word, stands(t))).otherwise(0))  # most texts do not even contain it
    return added(found)


def normalize(c: Column | str) -> Column:
    """For comparison: lower case, no signs, single spaces; null counts as empty."""
    c = F.regexp_replace(F.trim(F.lower(F.coalesce(col(c), F.lit("")))), r"[^\p{L}\p{N}_\s]", "")
    return F.regexp_replace(c, r"\s+", " ")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def cut_at_word(c: Column | str, n: int) -> Column:
    """At most n characters, cut at a space and marked by dots."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), r" [^ ]*$", ""), F.lit("..."))).otherwise(c)


def summary(c: Column | str, n: int = 300, lines: int = 5, least: int = 31) -> Column:
    """The first long lines, joined."""
    kept = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return cut_at_word(F.array_join(F.slice(kept, 1, lines), " "), n)


def short_summary(c: Column | str, n: int = 180) -> Column:
    return blank_to_null(cut_at_word(squeeze(c), n))


def slug(c: Column | str, n: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), 1, n)


def key_name(c: Column | str) -> Column:
    """A name without signs, for comparing names of fields."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def label(c: Column | str) -> Column:
    """A label in lower case with underscores; null for the words that mean none."""
    t = F.trim(col(c).cast("string"))
    return F.when(F.lower(t).isin("", "null", "none", "-", "n/a"), None).otherwise(F.translate(F.lower(t), "- ", "__"))


def truth(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "yes", "y", "ya", "valid", "save"), F.lit(False))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def canonical_key(title, company, role, place, url_domain) -> Column:
    """MD5 of company, role, place and title, or of title and domain where the company is not known."""
    known = F.concat_ws("|", normalize(company), normalize(role), normalize(place), normalize(title))
    return F.md5(F.when(blank_to_null(company).isNotNull(), known).otherwise(F.concat_ws("|", normalize(title), F.coalesce(url_domain, F.lit("")))).cast("binary"))


def mapped(c: Column | str, values: dict[str, str], default: Column | None = None) -> Column:
    """Lookup in a small table of fixed values."""
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(pairs[col(c)], default) if default is not None else pairs[col(c)]
