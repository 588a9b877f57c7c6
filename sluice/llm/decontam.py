"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be found with up to k = ``rate`` * n edits. It is split into k + 1 pieces, one of which any
such place must hold unchanged. All pieces go into one Aho-Corasick automaton that reads each text once; around each hit
the whole item is verified with Myers' bit-parallel distance. Items of one character or more with k = 0 are matched exactly.

Texts and items are compared in lower case, with runs of white space as one space. Null or empty items match nothing,
null texts hold nothing. Items are handled in blocks of about ``block_chars`` characters, each block against all texts, so what a task holds
stays bounded however long the benchmark is; a block goes to the executors as a file, not through the driver. A row names key and item once: of
items of equal id, and of texts of equal key, the place of the fewest edits counts. ``clean`` judges each row for itself, whatever its key.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, shipped

RATE = 0.08
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    bounds = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def distance(item: str, text: str, masks: dict[str, int] | None = None) -> int:
    """The fewest edits that turn some part of the text into the item."""
    n = len(item)
    if masks is None:
        masks = character_masks(item)
    every, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = every, 0, n
    best = n
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        zero = ((((x & plus) + plus) & every) ^ plus) | x
        up = minus | (every & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best = score
        up, down = (up << 1) & every, (down << 1) & every
        plus = down | (every & ~(zero | up))
        minus = up & zero
    return best


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """items: (item, normal text, edits allowed)."""

    def __init__(self, items: list[tuple[int, str, int]]):
        self.items = items
        self.masks: dict[int, dict[str, int]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(items):
            for offset, piece in pieces(text, k):
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> dict[int, int]:
        """By number of item the fewest edits, at most those allowed."""
        found: dict[int, int] = {}
        if not self.any:
            return found
        tried = set()
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                if found.get(i) == 0:
                    continue
                _, item, k = self.items[i]
                start = end + 1 - size - offset
                place = i, start // (k + 1)
                if place in tried:
                    continue
                tried.add(place)
                if text.startswith(item, max(start, 0)) and start >= 0:
                    found[i] = 0
                    continue
                window = text[max(0, start - 2 * k) : start + len(item) + 2 * k + 1]
                if len(window) < len(item) - k:
                    continue
                if i not in self.masks:
                    self.masks[i] = character_masks(item)
                edits = distance(item, window, self.masks[i])
                if edits <= k and edits < found.get(i, k + 1):
                    found[i] = edits
        return found


def _blocks(benchmark: DataFrame, item: str, text: str, block_chars: int):
    """Files of items, each of bounded size: blocks of the items' hash."""
    sized = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("text IS NOT NULL")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    for b in range(n):
        yield ship(sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).coalesce(1))


@lru_cache(2)
def _matcher(names: tuple[str, ...], rate: float) -> Matcher:
    """Built once in a worker, for all its tasks."""
    rows = [r for name in names for r in shipped(name).to_pylist()]
    return Matcher(sorted({(r["item"], t, int(rate * len(t))) for r in rows if (t := normal(r["text"]))}, key=str))


def matches(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key``, ``item``, edits, budget: a row for each text and item that it holds within the item's error budget."""
    found = []
    for names in _blocks(benchmark, item, item_text, block_chars):

        def run(batches, names=names):
            matcher = _matcher(names, rate)
            for batch in batches:
                out = [(k, *matcher.items[i], e) for k, t in zip(batch.column(0).to_pylist(), batch.column(1)) for i, e in matcher.find(normal(t.as_py())).items()]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1, 4, 3)], names=["k", "i", "edits", "budget"])

        found.append(df.select(key, text).mapInArrow(run, "k long, i long, edits long, budget long"))
    best = reduce(DataFrame.union, found).groupBy("k", "i").agg(F.min(F.struct("edits", "budget")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("i").alias(item), "b.edits", "b.budget")


def clean(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose text holds no item; all columns stay. Each row is judged where it is, so nothing is shuffled."""
    item, item_text, rate = options.get("item", "item_id"), options.get("item_text", "text"), options.get("rate", RATE)
    for names in _blocks(benchmark, item, item_text, options.get("block_chars", BLOCK_CHARS)):

        def run(batches, names=names, at=df.columns.index(text)):
            matcher = _matcher(names, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
