"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two. Counting the set bits of each segment maps it to a point whose Manhattan
distance to another point is at most the Hamming distance of the fingerprints. The points are joined on a grid: the 32
dimensions form eight groups, and points at Manhattan distance of at most three agree in at least five groups, so each
point goes to the 56 cells that five groups span, and only points of one cell are compared. Their Manhattan distance is
the first test, the Hamming distance the exact one. The counts 0, 1, 2 are held in unary as 00, 01, 11, so that the
Manhattan distance of all dimensions is the popcount of one exclusive or.

Only distinct fingerprints take part, so copies cost nothing. Members of a cell stream through a task in order, of which
it holds at most ``HOT``; a larger cell's members are embedded again by shorter segments, of one bit, in 64 dimensions that form 16
groups, of which a pair at distance three agrees in 13. Counts of one bit are the bits, so such a cell holds at most 2^12 fingerprints, and its
Manhattan distance is the Hamming distance. Either way each link comes through the embedding and its grid.

Texts of fewer words than a shingle have one shingle of all their words; texts without words (null, empty) have the
fingerprint zero and are linked like any other. Repeated rows each give their own row; other columns are dropped. Rows of null keys
are members like any other, but a group of null keys only has a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, durable, map_text, one_row_a_group
from .components import components

BITS = 3
HOT = 20_000
_PIECE = 200_000


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64 bits."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    for at in range(0, len(hashes), _PIECE):
        piece = hashes[at : at + _PIECE]
        total += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(piece)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key``, fp."""
    return map_text(df, [key, text], f"{key} long, fp long", lambda part: {key: part[key], "fp": [fingerprint(t, size) for t in part[text]]}, text)


def embed(x: np.ndarray, segment: int = 2) -> np.ndarray:
    """The popcounts of the segments of one or two bits, each in unary."""
    if segment == 1:
        return x
    odd = np.uint64(0x5555555555555555)
    high = x >> np.uint64(1)
    return ((x | high) & odd) | (((x & high) & odd) << np.uint64(1))


class Grid:
    """The cells that ``kept`` of ``parts`` equal groups of the dimensions span, for segments of ``segment`` bits."""

    def __init__(self, parts: int, kept: int, segment: int):
        self.segment = segment
        self.width = 64 // parts
        self.parts = parts
        chosen = list(combinations(range(parts), kept))
        self.masks = np.array([sum(((1 << self.width) - 1) << (self.width * i) for i in c) for c in chosen], np.uint64)
        self.first = np.full(1 << parts, -1, np.int64)  # by agreeing parts, the first cell that a pair shares
        for n, c in reversed(list(enumerate(chosen))):
            need = sum(1 << i for i in c)
            self.first[(np.arange(1 << parts) & need) == need] = n

    def cells(self, points: np.ndarray) -> np.ndarray:
        """points by masks; the number of the mask is in the low ten bits."""
        n = np.arange(len(self.masks), dtype=np.uint64)
        h = (points[:, None] & self.masks) + n * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((h & ~np.uint64(1023)) | n).view(np.int64)

    def shared_first(self, differ: np.ndarray) -> np.ndarray:
        """The first mask under which points that differ by these bits agree."""
        agree = np.zeros(len(differ), np.int64)
        for i in range(self.parts):
            part = (differ >> np.uint64(self.width * i)) & np.uint64((1 << self.width) - 1)
            agree |= (part == 0).astype(np.int64) << i
        return self.first[agree]


#: Groups, those in which a pair must agree, and the bits of a segment.
COARSE = (8, 5, 2)
FINE = (16, 13, 1)


def _spread(grid: tuple[int, int, int]):
    def run(batches):
        g = Grid(*grid)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                x = batch.column(0)[at : at + 1024].to_numpy(zero_copy_only=False).view(np.uint64)
                cells = g.cells(embed(x, g.segment))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(x, cells.shape[1]).view(np.int64))], names=["cell", "fp"])

    return run


def _pairs(cells: np.ndarray, x: np.ndarray, g: Grid, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of fingerprints that follow each other in cell order, each from the first cell that they share."""
    points = embed(x, g.segment)
    left = np.flatnonzero(cells[1:] == cells[:-1])
    step = 1
    while len(left):
        for at in range(0, len(left), _PIECE):
            i = left[at : at + _PIECE]
            differ = points[i] ^ points[i + step]
            near = np.bitwise_count(differ) <= bits  # Manhattan distance
            i, differ = i[near], differ[near]
            exact = np.bitwise_count(x[i] ^ x[i + step]) <= bits
            i, differ = i[exact], differ[exact]
            mine = g.shared_first(differ) == (cells[i] & 1023)
            if mine.any():
                yield x[i[mine]].view(np.int64), x[i[mine] + step].view(np.int64)
        step += 1
        left = left[left + step < len(cells)]
        left = left[cells[left + step] == cells[left]]


def _link(grid: tuple[int, int, int], bits: int, hot: int):
    """Over rows (cell, fp) in cell order: (a, b) links, and (fp, null) for members of cells beyond ``hot``."""

    def run(batches):
        g = Grid(*grid)
        cells, x = np.empty(0, np.int64), np.empty(0, np.uint64)
        over: int | None = None  # the cell beyond the limit that is passing by

        def give(a, b):
            for at in range(0, len(a), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + BATCH_ROWS], pa.int64()), b[at : at + BATCH_ROWS] if isinstance(b, pa.Array) else pa.array(b[at : at + BATCH_ROWS], pa.int64())], names=["a", "b"])

        for batch in batches:
            c, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if over is not None:
                n = int(np.argmax(c != over)) if (c != over).any() else len(c)
                yield from give(f[:n].view(np.int64), pa.nulls(n, pa.int64()))
                c, f = c[n:], f[n:]
                if not len(c):
                    continue
                over = None
            cells, x = np.concatenate([cells, c]), np.concatenate([x, f])
            changes = np.flatnonzero(cells[1:] != cells[:-1])
            last = int(changes[-1]) + 1 if len(changes) else 0
            for a, b in _pairs(cells[:last], x[:last], g, bits):
                yield from give(a, b)
            cells, x = cells[last:], x[last:]
            if len(cells) > hot:
                over = int(cells[0])
                yield from give(x.view(np.int64), pa.nulls(len(x), pa.int64()))
                cells, x = cells[:0], x[:0]
        for a, b in _pairs(cells, x, g, bits):
            yield from give(a, b)

    return run


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """a, b: the pairs of fingerprints that differ in at most ``bits`` (three or fewer) bits. distinct: fp, each once."""
    if bits > BITS:
        raise ValueError("the grids find pairs at three bits or fewer")
    order = lambda df: df.repartition("cell").sortWithinPartitions("cell")
    coarse = order(distinct.select("fp").mapInArrow(_spread(COARSE), "cell long, fp long"))
    found = durable(coarse.mapInArrow(_link(COARSE, bits, hot), "a long, b long"))
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    fine = order(crowded.mapInArrow(_spread(FINE), "cell long, fp long"))
    return found.filter("b IS NOT NULL").union(fine.mapInArrow(_link(FINE, bits, 1 << 62), "a long, b long"))


def _named(marked: DataFrame, key: str, bits: int, hot: int) -> DataFrame:
    """Of each fingerprint its least key ``first`` and the root of its group."""
    first = marked.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(links(first, bits, hot))
    return first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """``key``, fingerprint (16 hex digits), component_id: the smallest key that links reach, itself included."""
    marked = durable(fingerprints(df, key, text, size))
    named = _named(marked, key, bits, hot)
    joined = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(joined, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Of each group the row of the smallest key, nulls last, with all its columns; of rows of equal key that of the least hash of its text."""
    rows = lambda part: {key: part[key], "th": part["th"], "fp": [fingerprint(t, size) for t in part[text]]}
    marked = durable(map_text(df.withColumn("th", F.xxhash64(text)), [key, "th", text], f"{key} long, th long, fp long", rows, text))
    return one_row_a_group(df, marked.join(_named(marked, key, bits, hot), "fp").select(key, "th", "root"), key, text)
