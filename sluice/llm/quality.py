"""Quality rules by weak supervision.

Each rule votes bad, good or abstains on a text. Expectation-maximisation estimates, for either class, how often each
rule gives each vote (its accuracy), from the counts of vote patterns over all documents; there are at most
3 ** len(RULES) patterns, whatever the size of the corpus. A document is kept if its posterior probability of being
good is at least one half and it passes the base limits. No labels are used.

Null text counts as empty (no words, fails the base). Repeated rows each give their own row. Other columns are dropped.
Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_text, words_of

ABSTAIN, GOOD, BAD = 0, 1, 2
RULES = ("symbols", "repeats", "lines", "capitals", "exclaims", "word_size", "size", "letters", "bare")
_SYMBOLS = b"#*$%&|<>"
_BARE = [bytes([b]) for b in b"#*$%&|<>-=~_/+"]
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)
_CONTINUED = bytes(range(0x80, 0xC0))
_WORD = re.compile(r"[^\x20\t-\r]")

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def vote(value: float, bad: float, good: float) -> int:
    """Bad at or beyond ``bad``, good at or before ``good``, else abstain."""
    return BAD if value >= bad else GOOD if value <= good else ABSTAIN


def judge(text: str | None) -> tuple:
    """The values of COLUMNS."""
    text = text or ""
    data = text.encode()
    words = words_of(text)
    n = len(words)
    chars = len(b"".join(words).translate(None, _CONTINUED))
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    upper, lower = len(data.translate(None, _NOT_UPPER)), len(data.translate(None, _NOT_LOWER))
    letters = upper + lower + sum(map(len, re.findall(r"[^\x00-\xbf]+", text))) if not text.isascii() else upper + lower
    size = chars / max(n, 1)
    votes = (
        vote(symbols / max(n, 1), 0.15, 0.03),
        vote(repeats / max(n, 1), 0.35, 0.12),
        vote(dup_lines / len(lines), 0.4, 0.1) if len(lines) > 1 else ABSTAIN,
        vote(upper / max(upper + lower, 1), 0.4, 0.12),
        vote(text.count("!!") / max(n, 1), 0.1, 0.0),
        vote(abs(size - 5.5), 4.5, 2.0) if n else BAD,
        vote(-n, -12, -100) if n >= 12 else BAD,
        vote(1 - letters / max(chars, 1), 0.3, 0.12),
        vote(sum(map(words.count, _BARE)) / max(n, 1), 0.15, 0.03),
    )
    pattern = 0
    for v in votes:
        pattern = 3 * pattern + v
    return n, chars, symbols, dup_lines, repeats, n < 50 or 100 * repeats > 50 * n, pattern


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**j % 3 for j in reversed(range(len(RULES)))], axis=1)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior probability of good for each vote pattern; counts: documents by pattern."""
    if not len(patterns):
        return np.zeros(0)
    votes = votes_of(patterns)
    bad, good = (votes == BAD).sum(1), (votes == GOOD).sum(1)
    belief = np.clip((good + 1) / (good + 4 * bad + 2), 0.02, 0.98)  # one bad vote counts as several good ones at first
    one_hot = np.eye(3)[votes][:, :, 1:]  # to abstain says nothing of the class
    for _ in range(rounds):
        rates = []
        for weight in (1 - belief, belief):
            seen = np.einsum("p,pjv->jv", weight * counts, one_hot) + 1.0
            rates.append(np.log(seen / seen.sum(1, keepdims=True)))
        prior = np.clip((belief * counts).sum() / counts.sum(), 0.01, 0.99)
        score = np.log(prior / (1 - prior)) + np.einsum("pjv,jv->p", one_hot, rates[1] - rates[0])
        latest = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        done = np.abs(latest - belief).max() < 1e-9
        belief = latest
        if done:
            break
    return belief


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and COLUMNS."""
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]

    def rows(part):
        found = [judge(t) for t in part[text]]
        return {key: part[key]} | {n: [f[i] for f in found] for i, n in enumerate(names)}

    return map_text(df, [key, text], f"{key} long, {COLUMNS}", rows, text)


def grade(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``key``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept."""
    measured = durable(measure(df, key, text))
    return posterior(measured, threshold)


def keep_good(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that ``grade`` keeps, with all their columns. Texts are judged twice, once to count the vote patterns of
    all rows and once to filter, so that no text is stored or shuffled."""
    beliefs = {int(p): float(g) for p, g in zip(*believe(measure(df, key, text)))}
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            found = (judge(t.as_py()) for t in batch.column(at))
            yield batch.filter(pa.array([not f[-2] and beliefs[f[-1]] >= threshold for f in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def believe(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns and the posterior probability of good under each."""
    seen = measured.groupBy("pattern").count().collect()  # at most 3 ** len(RULES) rows
    patterns, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    order = np.argsort(patterns)
    return patterns[order], fit(patterns[order], counts[order])


def posterior(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    spark = measured.sparkSession
    patterns, good = believe(measured)
    by_pattern = spark.createDataFrame([(int(p), float(g)) for p, g in zip(patterns, good)], "pattern int, p_good double")
    return measured.join(F.broadcast(by_pattern), "pattern").drop("pattern").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
