"""Personal data by weak-supervision aggregation.

The base patterns give spans that always stay. Further candidates come from wider patterns, in text that no base span
covers: phones and cards that stand next to other digits, keys, passwords and tokens. Regex, gazetteer, context,
checksum and shape labelers vote on each candidate or abstain; expectation-maximisation estimates the labelers'
reliabilities on each kind from the counts of vote patterns over all documents. The probabilities are soft labels for the final span
classifier, a logistic regression that sees what the labelers do not: the span's length, its shares of digits and capitals,
the variety of its characters, its separators and what stands right before and behind it. It is trained on at most ``sample`` distinct
candidates (kind, votes and outline), each with its count over all documents as weight, and scores every candidate; those of
probability one half or more become spans, the surest first where two overlap. The gazetteers are tables and may be replaced.

All patterns and the search for overlaps take time in proportion to the text (times its logarithm), however long it is.
Null text counts as empty: no spans; ``mask`` leaves it null. Rows of null or repeated keys each give their own row. ``find`` drops other
columns, ``mask`` keeps them. Empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_text, sha256

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
LABELERS = 6
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits begins and takes runs whole, so this finds what ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`` finds, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: What every candidate's text holds: a digit or a cue of the password pattern.
_CUE = re.compile(r"(?i)[0-9]|password|passwd|pwd|token|secret|api_?key")
_NOT_DIGIT = re.compile("[^0-9]+")
#: Wider patterns: kind, pattern; the span is the last group, if any.
_WIDER = (
    ("phone", re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("card", re.compile(r"(?<![\w.])[0-9]{13,19}(?!\w)")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\b)\s?[=:]\s?[\"']?([^\s\"']{6,})")),
    ("secret", re.compile(r"(?<!\w)(?=[A-Za-z_]*[0-9])([A-Za-z0-9_]{16,})(?!\w)")),
)


@dataclass(frozen=True)
class Gazetteers:
    """Known beginnings: of keys, with the lengths of such keys (none: any), of cards as ranges with lengths, and of phones as country codes."""

    keys: tuple[tuple[str, tuple[int, ...]], ...] = (
        ("AKIA", (20,)), ("ASIA", (20,)), ("AIza", (39,)), ("ghp_", (40,)), ("gho_", (40,)), ("sk_live_", ()), ("sk_test_", ()), ("rk_live_", ()), ("xoxb", ()), ("xoxp", ()), ("glpat_", ()), ("eyJ", ()),
    )
    cards: tuple[tuple[int, int, tuple[int, ...]], ...] = (
        (4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (3528, 3589, (16, 19)),
        (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14,)), (62, 62, (16, 17, 18, 19)), (50, 50, (13, 16, 19)), (56, 58, (13, 16, 19)),
    )
    phones: tuple[str, ...] = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98 212 213 234 254 351 353 358 380 420 852 886 966 971 972".split())

    def key(self, value: str) -> bool:
        return any(value.startswith(k) and (not sizes or len(value) in sizes) for k, sizes in self.keys)

    def card(self, digits: str) -> bool:
        return any(len(digits) in sizes and low <= int(digits[: len(str(low))]) <= high for low, high, sizes in self.cards)

    def phone(self, value: str, digits: str) -> bool:
        """A country code that exists, or a national number of three, three and four digits."""
        return digits.startswith(self.phones) if value[:1] == "+" else len(digits) == 10


GAZETTEERS = Gazetteers()
_GOOD_BEFORE = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|key|phone|tel|call|mobile|card|visa|mastercard)\W{0,4}$")
_BAD_BEFORE = re.compile(r"(?i)(?:version|release|isbn|issn|doi|page|item|part|figure|commit|sha|md5)\W{0,4}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the at sign in linear time."""
    found, end = [], 0
    for m in _HOST.finditer(text):
        at = m.start()
        while at > end and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            found.append((at, m.end()))
            end = m.end()
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """By base kind the spans of the base patterns that hold."""
    found: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        found[1] = [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found[2].append(m.span())
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def labels(kind: str, value: str, before: str, known: Gazetteers = GAZETTEERS) -> list[int]:
    """Votes of the labelers: 1 personal, 2 not, 0 abstains."""
    digits = _NOT_DIGIT.sub("", value)
    letters = len(value) - len(digits)
    secret = kind == "secret"
    strict = {"phone": value[:1] in "+(", "card": len(digits) in (15, 16), "secret": len(value) >= 16 and bool(_HEX.fullmatch(value)) and 0 < len(digits) < len(value)}[kind]
    named = known.key(value) if secret else known.card(digits) if kind == "card" else known.phone(value, digits)
    gazetteer = 1 if named else 2 if kind == "card" else 0
    context = 1 if _GOOD_BEFORE.search(before) else 2 if _BAD_BEFORE.search(before) else 0
    checksum = (1 if luhn(digits) else 2) if kind == "card" else (1 if digits[-10:-9] >= "2" else 2) if kind == "phone" else 0
    mixed = len(digits) >= 3 and letters >= 3
    shape = (1 if mixed else 2) if secret else 1 if len(set(digits)) > 3 else 2
    size = (1 if 12 <= len(value) <= 128 else 2) if secret else 1 if len(digits) in (10, 11, 15, 16) else 0
    return [1 if strict or secret and named else 0, gazetteer, context, checksum, shape, size]


#: Fields of an outline and how many values each has.
OUTLINE = (("size", 8), ("digits", 5), ("capitals", 4), ("variety", 5), ("separators", 4), ("before", 4), ("behind", 3))
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_CAPITALS, _SEPARATORS = re.compile("[^A-Z]+"), re.compile(r"[^\x20().:/-]+")


def outline(value: str, before: str, behind: str) -> int:
    """What the classifier sees of a span, as one number."""
    n, head = max(1, len(value)), value[:64]
    fields = (
        min(7, n.bit_length()), 4 * len(_NOT_DIGIT.sub("", value)) // n, 3 * len(_CAPITALS.sub("", value)) // n, 4 * len(set(head)) // max(1, len(head)), min(3, len(_SEPARATORS.sub("", value))),
        0 if not before or before.isspace() else 1 if before in "=:\"'" else 2 if before in "([<{" else 3, 0 if not behind or behind.isspace() else 2 if behind.isalnum() else 1,
    )
    out = 0
    for f, (_, values) in zip(fields, OUTLINE):
        out = values * out + f
    return out


class Taken:
    """Spans that do not overlap, in order."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):  # base spans of two kinds may overlap; together they count as one
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


#: Numbers of a candidate: kind, start, end, votes, outline.
WIDTH = 5


def candidates(text: str, taken: list[tuple[int, int]], known: Gazetteers = GAZETTEERS) -> list[tuple[int, int, int, int, int]]:
    """Kind, start, end, vote pattern and outline of each wider span that no taken span overlaps."""
    found, base = set(), Taken(taken)
    for kind, pattern in _WIDER:
        for m in pattern.finditer(text):
            start, end = m.span(pattern.groups)
            if not base.overlaps(start, end):
                found.add((KINDS.index(kind), start, end))
    out = []
    for k, start, end in sorted(found):
        value, votes = text[start:end], 0
        for v in labels(KINDS[k], value, text[max(0, start - 24) : start], known):
            votes = 3 * votes + v
        out.append((k, start, end, votes, outline(value, text[start - 1 : start] if start else "", text[end : end + 1])))
    return out


def candidates_of(text: str | None, base: list[list[tuple[int, int]]], known: Gazetteers = GAZETTEERS) -> list[tuple[int, int, int, int, int]]:
    """The candidates beside the base spans; only texts without digit and cue are passed over."""
    return candidates(text, [s for spans in base for s in spans], known) if text and _CUE.search(text) else []


def features(kinds: np.ndarray, patterns: np.ndarray, outlines: np.ndarray) -> np.ndarray:
    """Of each candidate: its kind, each labeler's vote for and against, and its outline, alone and by kind."""
    votes = np.stack([patterns // 3**j % 3 for j in reversed(range(LABELERS))], axis=1)
    kind, parts, left = np.eye(len(KINDS))[kinds], [], outlines
    for _, values in reversed(OUTLINE):
        parts.append(np.eye(values)[left % values])
        left = left // values
    seen = np.concatenate(parts, axis=1)
    by_kind = (kind[:, BASE - 2 :, None] * seen[:, None, :]).reshape(len(kinds), -1)  # cards, phones and secrets
    return np.concatenate([np.ones((len(kinds), 1)), kind, votes == 1, votes == 2, seen, by_kind], axis=1).astype(float)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of being personal data by vote pattern, from expectation-maximisation over how often each labeler votes for, against or abstains on either class."""
    votes = np.stack([patterns // 3**j % 3 for j in reversed(range(LABELERS))], axis=1)
    yes, no = (votes == 1).sum(1), (votes == 2).sum(1)
    belief = np.clip((yes + 0.5) / (yes + 2 * no + 1), 0.05, 0.95)
    one_hot, before = np.eye(3)[votes], ([1.0, 2.0, 0.5], [1.0, 0.5, 2.0])  # as if seen on either class: abstains, for, against
    for _ in range(rounds):
        rates = []
        for weight, seen in zip((belief, 1 - belief), before):
            n = np.einsum("p,pjv->jv", weight * counts, one_hot) + seen
            rates.append(np.log(n / n.sum(1, keepdims=True)))
        prior = np.clip((belief * counts).sum() / counts.sum(), 0.05, 0.95)
        latest = 1 / (1 + np.exp(-np.clip(np.einsum("pjv,jv->p", one_hot, rates[0] - rates[1]) + np.log(prior / (1 - prior)), -40, 40)))
        if np.abs(latest - belief).max() < 1e-9:
            break
        belief = latest
    return belief


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (w * (p - y)) + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


_FOUND = "bases array<int>, added array<int>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", known: Gazetteers = GAZETTEERS) -> DataFrame:
    """``key``, bases: (kind, start, end) of the base spans, flat; added: the WIDTH numbers of each candidate, flat."""

    def rows(part):
        out = {key: part[key], "bases": [], "added": []}
        for t in part[text]:
            base = base_spans(t or "")
            flat = [x for k, spans in enumerate(base) for s, e in spans for x in (k, s, e)]
            more = candidates_of(t, base, known)
            out["bases"].append(flat)
            out["added"].append([x for c in more for x in c])
        return out

    return map_text(df, [key, text], f"{key} long, {_FOUND}", rows, text)


def classifier(scanned: DataFrame, sample: int = 50_000) -> np.ndarray:
    """Weights of the span classifier. Votes are counted over all candidates; at most ``sample`` distinct ones train it, those of the least hashes."""
    each = scanned.filter(F.size("added") > 0).select(F.explode(F.sequence(F.lit(0), F.size("added") - 1, F.lit(WIDTH))).alias("i"), "added")
    each = each.select(F.col("added")[F.col("i")].alias("kind"), F.col("added")[F.col("i") + 3].alias("votes"), F.col("added")[F.col("i") + 4].alias("outline"))
    distinct = durable(each.groupBy("kind", "votes", "outline").count())
    seen = distinct.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect()  # at most kinds times 3 ** LABELERS rows
    if not seen:
        return np.zeros(features(np.zeros(1, int), np.zeros(1, int), np.zeros(1, int)).shape[1])
    believed = {}
    for kind in sorted({r.kind for r in seen}):  # a labeler is as reliable as it is on spans of this kind
        patterns, counts = np.array(sorted((r.votes, r.n) for r in seen if r.kind == kind), np.int64).T
        believed |= {(kind, v): b for v, b in zip(patterns.tolist(), reliabilities(patterns, counts.astype(float)).tolist())}
    taught = np.array([tuple(r) for r in distinct.orderBy(F.xxhash64("kind", "votes", "outline"), "kind", "votes", "outline").limit(sample).collect()], np.int64)
    soft = np.array([believed[k, v] for k, v in taught[:, :2].tolist()])
    return train(features(taught[:, 0], taught[:, 1], taught[:, 2]), soft, taught[:, 3] / taught[:, 3].mean())


def choose(bases: list[int], added: list[int], beta: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans and the candidates that the classifier takes, by kind and start."""
    spans = [tuple(bases[i : i + 3]) for i in range(0, len(bases), 3)]
    if added:
        flat = np.array(added).reshape(-1, WIDTH)
        p, taken = features(flat[:, 0], flat[:, 3], flat[:, 4]) @ beta, Taken([s[1:] for s in spans])
        for i in np.lexsort((flat[:, 2], flat[:, 1], -p)).tolist():
            k, s, e = flat[i, :3].tolist()
            if p[i] >= 0 and not taken.overlaps(s, e):
                spans.append((k, s, e))
                taken.add(s, e)
    return sorted(spans)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 50_000, known: Gazetteers = GAZETTEERS) -> DataFrame:
    """``key``, n_email, n_ip, n_card, n_phone of the base spans, base_sha256, and spans ``kind:start:end`` of all."""
    scanned = durable(scan(df, key, text, known))
    beta = classifier(scanned, sample)

    def rows(part):
        out = {key: part[key], "spans": [], "base_sha256": []} | {f"n_{k}": [] for k in KINDS[:BASE]}
        for bases, added in zip(part["bases"], part["added"]):
            spans = [tuple(bases[i : i + 3]) for i in range(0, len(bases), 3)]
            for k, name in enumerate(KINDS[:BASE]):
                out[f"n_{name}"].append(sum(s[0] == k for s in spans))
            out["base_sha256"].append(sha256(spell(spans).encode()))
            out["spans"].append(spell(choose(bases, added, beta)))
        return out

    counts = "".join(f", n_{k} long" for k in KINDS[:BASE])
    return map_text(scanned, [key, "bases", "added"], f"{key} long{counts}, base_sha256 string, spans string", rows, None)


def mask(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 50_000, known: Gazetteers = GAZETTEERS) -> DataFrame:
    """The table with each span of ``text`` replaced by its kind in capitals and brackets; all columns stay. Texts are read twice, once
    to count the votes of all rows and once to mask, so that no text is stored or shuffled."""
    beta = classifier(scan(df, key, text, known), sample)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = []
            for value in batch.column(at):
                t = value.as_py()
                if t and ("@" in t or _CUE.search(t)):
                    base = base_spans(t)
                    more = candidates_of(t, base, known)
                    t = masked(t, choose([x for k, spans in enumerate(base) for s, e in spans for x in (k, s, e)], [x for c in more for x in c], beta))
                texts.append(t)
            yield batch.set_column(at, text, pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
