"""Fill-in-the-middle by run-length encoded character classes.

A text is stored as its maximal runs of one character class with the number of units that end up to each run's end. A
cut after ``k`` units is looked for in these cumulative counts by binary search, and its place in the run follows by arithmetic: the
unit lines themselves are never built. Three units: ``line`` (``[^\\n]*\\n|[^\\n]+``: each newline ends one), ``word`` (a run of
white space (the six ASCII characters) ends one, so a word has the space after it) and ``char`` (each character is one).

A text of n units is cut twice: h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``seed:key``; prefix ends after
the smaller of h1 % (n + 1) and h2 % (n + 1) units, middle after the larger, suffix is the rest. ``rate`` percent of the texts
(h3) are rearranged, ``spm`` percent of these (h4) as suffix, prefix, middle, the others as prefix, suffix, middle, each part behind its mark.
A text that is empty or holds a mark stays plain. Marks may not begin with what a mark ends with, so the exact text can be had back
from output and form (``restore``).

Null texts count as empty; a null key has no digits. Repeated rows each give their own row, of equal results. Texts stay where they
are, and a task holds a text at a time, at four bytes a character. Other columns are dropped. Keys are whole numbers.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text, sha256

MARKS = ("<P>", "<S>", "<M>")
#: By unit the characters whose runs end units, and whether each of them does or the run's last one.
UNITS = {"line": ("\n", True), "word": (" \t\n\v\f\r", False), "char": (None, True)}
SCHEMA = "n long, form string, prefix_chars long, middle_chars long"


class Runs:
    """Maximal runs of one class: where each ends, and how many units end up to there."""

    def __init__(self, text: str, unit: str = "line"):
        ending, self.each = UNITS[unit]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.ones(len(codes), bool) if ending is None else np.isin(codes, [ord(c) for c in ending])
        self.ends = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(codes)) if len(codes) else np.empty(0, np.int64)
        self.starts = np.append(0, self.ends[:-1])[: len(self.ends)]
        closes = kind[self.starts]
        units = np.where(closes, self.ends - self.starts if self.each else 1, 0)
        if len(units) and not closes[-1]:
            units[-1] = 1  # what is left at the end is a unit
        self.closes, self.units = closes, np.cumsum(units)

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, k: int) -> int:
        """The code points of the first k units."""
        if k <= 0 or not len(self.units):
            return 0
        run = int(np.searchsorted(self.units, k))
        if not (self.closes[run] and self.each):
            return int(self.ends[run])
        before = int(self.units[run - 1]) if run else 0
        return int(self.starts[run]) + k - before


def rearrange(text: str, key: int | None, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> tuple[str, int, str, int | None, int | None]:
    """Output, n, form, prefix_chars, middle_chars."""
    runs = Runs(text, unit)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return text, runs.n, "plain", None, None
    a, b = (runs.cut(k) for k in sorted((h1 % (runs.n + 1), h2 % (runs.n + 1))))
    p, s, m = marks
    if h4 % 100 < spm:
        return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}", runs.n, "spm", a, b - a
    return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}", runs.n, "psm", a, b - a


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that was rearranged."""
    p, s, m = marks
    if form == "plain":
        return output
    body, _, middle = output.partition(m)
    first, second = (s, p) if form == "spm" else (p, s)
    one, _, two = body[len(first) :].partition(second)
    return two + middle + one if form == "spm" else one + middle + two


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told from the text around them wherever they stand."""
    if len(set(marks)) < 3 or not all(marks) or any(a[-i:] == b[:i] for a, b in product(marks, marks) for i in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("no mark may be empty or begin with what a mark ends with")


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, as_text: bool = True) -> DataFrame:
    """``key``, n, form, prefix_chars, middle_chars, output; with ``as_text=False`` output_sha256 and restored_sha256 instead."""
    check_marks(marks)
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    def rows(part):
        out = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", *(("output",) if as_text else ("output_sha256", "restored_sha256")))}
        for k, t in zip(part[key], part[text]):
            output, *rest = rearrange(t or "", k, unit, seed, rate, spm, marks)
            for c, v in zip(out, (*rest, output) if as_text else (*rest, sha256(output.encode()), sha256(restored(output, rest[1], marks).encode()))):
                out[c].append(v)
        return {key: part[key]} | out

    return map_text(df, [key, text], f"{key} long, {SCHEMA}, " + ("output string" if as_text else "output_sha256 string, restored_sha256 string"), rows, text)


def restore(df: DataFrame, key: str = "doc_id", output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``key``, text: the exact texts from what ``transform`` gave."""
    check_marks(marks)
    return map_text(df, [key, output, form], f"{key} long, text string", lambda part: {key: part[key], "text": [restored(o or "", f, marks) for o, f in zip(part[output], part[form])]}, output)
