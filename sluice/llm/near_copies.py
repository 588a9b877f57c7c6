"""Near copies by the Jaccard similarity of their sets of five-word shingles.

Texts are compared by the 64-bit hashes of their shingles. Pairs that may be similar come from op8's operator (``simhash``), its fingerprints and the links of its
grid at three bits or fewer, each judged exactly afterwards; and, as most pairs of similarity 0.8 differ in more bits, from MinHash besides: of each text the
least hash under 200 permutations, in 40 bands of five; texts that agree in a band are candidates, and a pair of similarity
0.8 is missed by all bands with a probability of (1 - 0.8^5)^40 = 1.3e-7. A bitmap of each set bounds a pair's
similarity from above and spares most of the others; what is left is judged by its true similarity.

Cells are dealt out as pairs of numbers. Members of a cell stream through a task in order and meet the next ``NEXT``. Members of larger cells meet all others of the
cell in a second pass, as far as the links of the first do not connect them already: which groups there are does not depend on such pairs.
Cells of more than ``CROWD`` members of several groups are not gone through: their members meet by their rarest shingles instead. Of two sets of
similarity 0.8 either shares at least 0.8 of its size with the other, so among the first ``n - ceil(0.8 n) + 1`` of its shingles, in one order for all sets, is one that
the other has among its own first ones. The order puts shingles first that few members have, so members that share a template alone do not meet. It loses no pair.
Rows of null or repeated keys count each for itself; of each group one row stays, whatever its key.

Only distinct sets take part, so copies cost nothing. Texts of fewer words than a shingle have one shingle of all their
words; texts without words (null, empty) are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import BATCH_ROWS, durable, map_text, one_row_a_group
from .components import components

WORDS = 5
SIMILAR = 0.8
BANDS = 40
ROWS = 5
NEXT = 2
MAP_BITS = 2048
#: Members of a cell of several groups that one task compares with each other.
CROWD = 1000
#: Counters of shingles among members of larger cells; a number of fixed size, whatever the corpus.
COUNTERS = 1 << 20
_PIECE = 100_000
_RANDOM = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One cell a band: a hash of the band's number and its least values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        h = hashes[at : at + 512, None] * _RANDOM[0]
        h = (h ^ (h >> np.uint64(32))) * _RANDOM[1]
        least = np.minimum(least, h.min(0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    out = np.zeros(MAP_BITS, np.uint8)
    out[(hashes % np.uint64(MAP_BITS)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _marks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, th: hash of the text; fp: hash of its set; n: the set's size, its bitmap and cells; sim: the text's fingerprint of op8."""

    def rows(part):
        out = {key: part[key], "th": part["th"], "fp": [], "n": [], "map": [], "cells": [], "sim": [simhash.fingerprint(t) for t in part[text]]}
        for t in part[text]:
            h = shingles(t)
            out["fp"].append(xxhash.xxh64_intdigest(h.tobytes(), 7) - (1 << 63))
            out["n"].append(len(h))
            out["map"].append(bitmap(h))
            out["cells"].append(bands(h).tolist() if len(h) else [])
        return out

    return map_text(df.withColumn("th", F.xxhash64(text)), [key, "th", text], f"{key} long, th long, fp long, n int, map binary, cells array<long>, sim long", rows, text)


def _may_be(n1: np.ndarray, m1: np.ndarray, n2: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be of similarity 0.8: nine times what they share is four times both sizes at least."""
    shared = np.minimum(n1 - np.bitwise_count(m1 & ~m2).sum(-1, dtype=np.int64), n2 - np.bitwise_count(m2 & ~m1).sum(-1, dtype=np.int64))
    return 9 * shared >= 4 * (n1 + n2)


def _close(nearest: int, cells: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Pairs of at most ``nearest`` places apart; then the members of the larger cells, without a partner."""
    left, step = np.flatnonzero(cells[1:] == cells[:-1]), 1
    while len(left) and step <= nearest:
        yield fp[left], fp[left + step]
        step += 1
        left = left[left + step < len(cells)]
        left = left[cells[left + step] == cells[left]]
    if len(left):
        yield fp[np.isin(cells, cells[left])], None


def _rest(cells: np.ndarray, fp: np.ndarray, n: np.ndarray, maps: np.ndarray, group: np.ndarray, every: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The pairs of a cell that are not of one group and that their bitmaps do not rule out, each from the first cell that both have if ``every`` has all cells."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
    for a, b in zip(starts, [*starts[1:], len(cells)]):
        _, which, sizes = np.unique(group[a:b], return_inverse=True, return_counts=True)
        order = a + np.lexsort((which, sizes[which]))  # the largest group last: only the others' members are gone through
        g = group[order]
        ends = np.r_[np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        for i in range(ends[-2] if len(ends) > 1 else 0):
            x, after = order[i], order[ends[np.searchsorted(ends, i, side="right")] :]
            for at in range(0, len(after), _PIECE):
                y = after[at : at + _PIECE]
                y = y[_may_be(n[x], maps[x], n[y], maps[y])]
                if every is not None:
                    y = y[every[x][(every[y] == every[x]).argmax(1)] == cells[x]]
                yield np.full(len(y), fp[x]), fp[y]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """cell, fp and, where they are there, n, map and root, and all cells."""
    out = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(min(2, batch.num_columns))]
    if batch.num_columns > 2:
        out += [batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), maps(batch.column(3)), batch.column(4).to_numpy(zero_copy_only=False)]
    if batch.num_columns > 5:
        out.append(batch.column(5).flatten().to_numpy().reshape(-1, BANDS))
    return out


def maps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if len(column) else np.empty((0, MAP_BITS // 64), np.uint64)


def _link(pairs):
    """``pairs`` over rows (cell, fp and what else it takes) in cell order, a < b."""

    def run(batches):
        def give(a, b):
            for at in range(0, len(a), BATCH_ROWS):
                x, y = a[at : at + BATCH_ROWS], None if b is None else b[at : at + BATCH_ROWS]
                columns = [pa.array(x), pa.nulls(len(x), pa.int64())] if y is None else [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            new = _columns(batch)
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            changes = np.flatnonzero(held[0][1:] != held[0][:-1])
            last = int(changes[-1]) + 1 if len(changes) else 0
            for a, b in pairs(*(x[:last] for x in held)):
                yield from give(a, b)
            held = [x[last:] for x in held]
        if held is not None:
            for a, b in pairs(*held):
                yield from give(a, b)

    return run


def _bounded(batches):
    """Of rows (a, b, n and map of either) the pairs that their bitmaps do not rule out."""
    for batch in batches:
        n1, n2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
        yield batch.select([0, 1]).filter(pa.array(_may_be(n1, maps(batch.column(3)), n2, maps(batch.column(5)))))


def _hashes(need: DataFrame, sets: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """fp, h: the sets themselves of those in ``need`` (fp). sets: fp, th."""
    needed = sets.join(need, "fp", "left_semi").select("fp", "th")
    texts = df.select(F.col(text).alias("t"), F.xxhash64(text).alias("th")).join(needed, "th").groupBy("fp").agg(F.min("t").alias("t"))
    return durable(map_text(texts, ["fp", "t"], "fp long, h array<long>", lambda part: {"fp": part["fp"], "h": [shingles(t).view(np.int64).tolist() for t in part["t"]]}, "t"))


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs a, b those that their bitmaps do not rule out, once each."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"map{c}"))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "mapa", "nb", "mapb")
    return durable(near.mapInArrow(_bounded, "a long, b long"))


def _similar(pairs: DataFrame, sets: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """The pairs a, b whose sets are of similarity 0.8 or more. sets: fp, th."""
    found = _hashes(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), sets, df, text)
    side = lambda c: found.select(F.col("fp").alias(c), F.col("h").alias(f"h{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def _steps(found: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are, in eighths of a power of two. found: h."""
    counts = found.select(F.explode("h").alias("c")).select(F.pmod("c", F.lit(COUNTERS)).alias("c")).groupBy("c").count().toArrow()
    out = np.zeros(COUNTERS, np.uint16)
    out[counts.column("c").to_numpy()] = np.log2(counts.column("count").to_numpy()) * 8
    return out


def _rarest(steps: np.ndarray):
    """Rows (cell: a shingle, fp, n, map, root), a row for each of the first shingles of a set (fp, n, map, root, h)."""

    def rows(batches):
        for batch in batches:
            for fp, n, bits, root, h in zip(*(batch.column(i) for i in range(5))):
                h = np.array(h.values.to_numpy())
                first = h[np.lexsort((h, steps[h % COUNTERS]))][: len(h) - -(-4 * len(h) // 5) + 1]
                for at in range(0, len(first), BATCH_ROWS):
                    part = first[at : at + BATCH_ROWS]
                    same = lambda v, kind: pa.array([v.as_py()] * len(part), kind)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), same(fp, pa.int64()), same(n, pa.int32()), same(bits, pa.binary()), same(root, pa.int64())], names=["cell", "fp", "n", "map", "root"]
                    )

    return rows


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def _crowd_pairs(crowd: DataFrame, sets: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """Pairs of different groups among ``crowd`` (fp, n, map, root) that share one of their first shingles and that their bitmaps do not rule out."""
    found = _hashes(crowd.select("fp"), sets, df, text)
    first = crowd.select("fp", "n", "map", "root").join(found, "fp").mapInArrow(_rarest(_steps(found)), "cell long, fp long, n int, map binary, root long")
    return _in_order(first).mapInArrow(_link(_rest), "a long, b long").distinct()


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs a < b of sets that op8 links: of each fingerprint the least set with its others and with those of linked fingerprints. sets: fp, sim."""
    first = durable(sets.groupBy("sim").agg(F.min("fp").alias("first")))
    equal = sets.join(first, "sim").filter("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = durable(simhash.links(first.select(F.col("sim").alias("fp"))).select("a", "b"))
    side = lambda c: first.select(F.col("sim").alias(c), F.col("first").alias(f"f{c}"))
    linked = near.join(side("a"), "a").join(side("b"), "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    return equal.union(linked)


def roots(marked: DataFrame, df: DataFrame, text: str = "text", nearest: int = NEXT, most: int = CROWD) -> DataFrame:
    """node, root: of each linked set the smallest that links reach."""
    sets = durable(marked.groupBy("fp").agg(F.min(F.struct("th", "n", "map", "cells", "sim")).alias("s")).select("fp", "s.*"))
    found = durable(_in_order(sets.select(F.explode("cells").alias("cell"), "fp")).mapInArrow(_link(partial(_close, nearest)), "a long, b long"))
    links = durable(_similar(_possible(_by_fingerprint(sets).union(found.filter("b IS NOT NULL")), sets), sets, df, text))
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return components(links)
    first = durable(components(links))
    crowd = durable(sets.join(crowded, "fp", "left_semi").join(first, F.col("fp") == F.col("node"), "left").select("fp", "n", "map", F.coalesce("root", "fp").alias("root"), "cells"))
    places = crowd.select(F.explode("cells").alias("cell"), "fp", "root")
    mixed = places.groupBy("cell").agg(F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    large = durable(mixed.filter(F.col("members") > most).select("cell"))
    small = mixed.filter(F.col("members") <= most).select("cell")
    members = crowd.select(F.explode("cells").alias("cell"), "fp", "n", "map", "root", "cells").join(small, "cell", "left_semi")
    more = durable(_in_order(members).mapInArrow(_link(_rest), "a long, b long").distinct())
    if not large.isEmpty():
        meet = places.join(large, "cell", "left_semi").select("fp").distinct()
        more = durable(more.union(_crowd_pairs(durable(crowd.join(meet, "fp", "left_semi")), sets, df, text)).distinct())
    return components(links.union(_similar(more, sets, df, text)))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", nearest: int = NEXT, most: int = CROWD) -> DataFrame:
    """Of each group of near copies the row of the smallest key, with all its columns."""
    marked = durable(_marks(df, key, text))
    found = roots(marked, df, text, nearest, most)
    named = marked.join(found, marked.fp == found.node, "left").select(key, "th", F.coalesce("root", "fp").alias("root"))
    return one_row_a_group(df, named, key, text)
