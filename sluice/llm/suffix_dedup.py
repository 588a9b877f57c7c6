"""Removal of repeated byte strings by distributed prefix doubling.

The rank of a string of 2h bytes is named by the pair of its halves' ranks. Up to half the threshold, ranks are named in the task
that holds the text (by 64-bit mixing of the pair, so equal strings have equal ranks everywhere). From there Spark
sorts (rank pair, position) rows at growing offsets: neighbours in the order of rank pairs are compared, positions
whose rank is unique leave, and the others are ranked again over more bytes until the threshold is reached.

Not every position is sorted at every length. A string of ``threshold`` bytes (a window) is represented at length h by one
position in it, that of the least rank among all its strings of h bytes: equal windows have it at the same place. Following windows with the same
position form a stretch, and one row stands for a stretch: ``a``, the rank of its position; ``b``, the rank of the whole stretch. At each length

* stretches whose ``a`` no other has are gone through: all their windows are unique;
* stretches of equal ``a`` and ``b`` (twins) are settled: all their windows are repeated;
* the others go on, with one of each group of twins as a partner for them, to a greater length, where stretches are shorter.

At the threshold itself each window is a stretch, and (a, b) are the ranks of its two halves: those found twice are repeated.

Rows are sorted over ranges of (a, b, position), so a rank that a third of all rows have is many tasks' work; a group that a
border of two ranges divides is not settled before the last length, where the ranges' first and last ranks meet in a small table.
A task holds two million bytes of text, whatever a text's length, and sorted rows stream through it. Copies of a text are taken
at most twice a task: the second shows that all is repeated. What was found of a text goes to its copies wherever they are: they do not meet in one task.

Texts are bytes of UTF-8; null and empty texts lose nothing; matches never cross texts. Repeated rows are different texts with equal windows. Overlapping
repeats count; windows are judged on the input. Texts are told apart by 79 bits of hash, windows by 128. Other columns are dropped. Keys are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_CHARS, durable, sha256

#: Bytes of text for which a task holds ranks at once.
PIECE = 2_000_000
#: Texts that a task remembers as seen.
REMEMBERED = 500_000
_PLACE = np.uint64((1 << 24) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_BYTES = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
SETTLED, OPEN, PARTNER, EDGE, EDGE_TWIN = range(5)
_ROW = "a long, b long, s long, w long"
_FOUND = "kind int, a long, b long, s long, w long"


def lengths(threshold: int) -> list[int]:
    """Half the threshold, then ever less short of it, then the threshold."""
    half = (threshold + 1) // 2
    return sorted({half, threshold - (threshold - half) // 2, threshold - (threshold - half) // 4, threshold})


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * _A + second * _B
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def ranks(data: np.ndarray, size: int) -> np.ndarray:
    """The rank of each string of ``size`` bytes, by doubling."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    have, length = _BYTES[data], 1
    while length < size:
        step = min(length, size - length)
        have = pair(have[: len(have) - step], have[step:])
        length += step
    return have


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(values)
    blocks = np.append(values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    before, after = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def stretches(pieces: list[bytes], threshold: int, length: int) -> tuple[np.ndarray, ...]:
    """number of the piece, place in it, windows besides the first, a, b: of the stretches at this length."""
    sizes = np.array([len(p) for p in pieces])
    ends, half = np.cumsum(sizes), (threshold + 1) // 2
    r = ranks(np.frombuffer(b"".join(pieces), np.uint8), half)
    second = threshold - half  # where a window's second half begins
    places = np.arange(max(0, len(r) - second))
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(places)]
    inside = places + threshold <= ends[piece]
    places, piece = places[inside], piece[inside]
    if length == threshold:
        return piece, places - (ends - sizes)[piece], np.zeros(len(places), np.int64), r[places], r[places + second]
    g = pair(r[: len(r) - (length - half)], r[length - half :]) if length > half else r
    least = least_in((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), threshold - length + 1)
    chosen = (least & _PLACE).astype(np.int64)[places]
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1]))[: len(places)]
    first = np.flatnonzero(new)
    more = np.append(first[1:], len(places))[: len(first)] - first - 1
    at, of = places[first], piece[first]
    whole = pair(pair(r[at], r[at + second]), r[at + more + second] * _C + more.astype(np.uint64))
    return of, at - (ends - sizes)[of], more, g[chosen[first]], whole


def _w(mark: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (mark.astype(np.int64) << 47) | (at.astype(np.int64) << 16) | n


def unpacked(w: Column) -> tuple[Column, Column, Column]:
    """mark, at, n."""
    return F.shiftright(w, 47).cast("int"), F.shiftright(w, 16).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"), w.bitwiseAND(F.lit(0xFFFF)).cast("int")


def _rows(a: np.ndarray, b: np.ndarray, s: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(s), pa.array(w)], names=["a", "b", "s", "w"])


def _of_texts(threshold: int):
    """Rows of texts (h, tag, text): s is h."""

    def run(batches):
        pieces, about, held, seen = [], [], 0, {}

        def give():
            of, at, n, a, b = stretches(pieces, threshold, lengths(threshold)[0])
            h, tag, base = (np.array(x, np.int64) for x in zip(*about))
            return _rows(a, b, h[of], _w(tag[of], base[of] + at, n))

        for batch in batches:
            for h, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen[h, tag] = times = seen.get((h, tag), 0) + 1
                if times > 2:
                    continue
                text = text.as_py()
                for at in range(0, len(text) - threshold + 1, PIECE):  # windows that begin in the next PIECE bytes
                    pieces.append(text[at : at + PIECE + threshold - 1])
                    about.append((h, tag, at))
                    held += len(pieces[-1])
                    if held >= PIECE:
                        yield give()
                        pieces, about, held = [], [], 0
        if pieces:
            yield give()

    return run


def _of_stretches(threshold: int, length: int):
    """Rows of stretches (s, mine, data)."""

    def run(batches):
        for batch in batches:
            data, s, mine = batch.column(2).to_pylist(), batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            size = max(1, PIECE // (2 * threshold))
            for i in range(0, len(data), size):
                of, at, n, a, b = stretches(data[i : i + size], threshold, length)
                yield _rows(a, b, s[i + of], _w(mine[i + of], at, n))

    return run


def _compare(marked: bool, last: bool):
    """Sorted rows: each with its neighbours. marked: w says which rows are to be judged; last: windows, of which none goes on."""

    def run(batches):
        held, same_class, same_group, first_group, groups, before = None, False, False, True, 0, (None, None)

        def step(rows: list[np.ndarray], end: bool):
            nonlocal same_class, same_group, first_group, groups, before
            a, b, s, w = rows
            m = len(a) if end else len(a) - 1
            if not m:
                return
            none = np.zeros(int(end), bool)  # the last row of all has no next one
            class_next = np.append(a[1:] == a[:-1], none)
            group_next = class_next & np.append(b[1:] == b[:-1], none)
            class_before, group_before = np.append(same_class, class_next[:-1]), np.append(same_group, group_next[:-1])
            a, b, s, w = (x[:m] for x in rows)
            twin, begins, ends = group_before | group_next, ~group_before, ~group_next
            since = np.maximum.accumulate(np.where(begins, np.arange(m), -1))
            first = np.where(since >= 0, (~class_before)[since], first_group)
            at_start = np.cumsum(begins) + groups <= 1
            at_end = np.zeros(m, bool)
            at_end[m - 1] = end
            mine = (w >> 47 & 1).astype(bool) if marked else np.ones(m, bool)
            again = np.append((s[0], w[0]) == before, (s[1:] == s[:-1]) & (w[1:] == w[:-1]))
            chosen = twin & mine & ~again
            yield np.full(int(chosen.sum()), SETTLED, np.int32), chosen
            if last:
                edge = ends & (at_start | at_end)
                yield np.where(twin[edge], EDGE_TWIN, EDGE).astype(np.int32), edge
            else:
                goes = (begins & class_before) | (ends & first & (class_next | at_start | at_end))
                yield np.where(mine & ~twin, OPEN, PARTNER)[goes].astype(np.int32), goes
            same_class, same_group, first_group, groups, before = bool(class_next[-1]), bool(group_next[-1]), bool(first[-1]), groups + int(begins.sum()), (s[-1], w[-1])

        def give(rows, end):
            for kinds, chosen in step(rows, end):
                if len(kinds):
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(x[: len(chosen)][chosen]) for x in rows)], names=["kind", "a", "b", "s", "w"])

        for batch in batches:
            if len(batch):
                new = [batch.column(i).to_numpy() for i in range(4)]
                rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                yield from give(rows, False)
                held = [x[-1:] for x in rows]  # its next row is not known yet
        if held is not None:
            yield from give(held, True)

    return run


def removed(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The maximal runs that the spans (begin, end) cover."""
    runs: list[list[int]] = []
    for begin, end in sorted(spans):
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    return [(a, b) for a, b in runs]


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


_RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept "


def _cut_one(text: bytes, spans: list[tuple[int, int]], as_bytes: bool) -> tuple:
    runs = removed(spans, len(text))
    rest = kept(text, runs)
    return len(text), sum(b - a for a, b in runs), len(runs), rest if as_bytes else sha256(rest)


def _split(threshold: int, as_bytes: bool):
    """Texts without open stretches are done; the others wait with their spans. Stretches that go on are cut out, of equal texts once, in the leading task."""
    stretch = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("mine", pa.bool_()), ("data", pa.binary())])
    kinds = [pa.int64()] * 4 + [pa.binary() if as_bytes else pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(stretch)]
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept", "h", "tag", "text", "spans", "stretches"]

    def run(batches):
        seen: set = set()
        for batch in batches:
            rows, held = [], 0
            for i, (key, h, tag, lead) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 2, 5)))):
                text, found = batch.column(3)[i].as_py() or b"", batch.column(4)[i].as_py() or []
                spans = [(f["at"], f["at"] + f["n"] + threshold) for f in found if f["kind"] == SETTLED]
                go_on, waits = [f for f in found if f["kind"] != SETTLED], any(f["kind"] == OPEN for f in found)
                if len(seen) > REMEMBERED:
                    seen.clear()
                cut = [] if not lead or (h, tag) in seen else [{"at": f["at"], "n": f["n"], "mine": f["kind"] == OPEN, "data": text[f["at"] : f["at"] + f["n"] + threshold]} for f in go_on]
                if cut:
                    seen.add((h, tag))
                done = (None,) * 4 if waits else _cut_one(text, spans, as_bytes)
                rows.append((key, *done, h, tag, text if waits else None, [x for ab in removed(spans, len(text)) for x in ab] if waits else None, cut))
                held += len(text)
                if held >= BATCH_CHARS or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0

    return run


def _cut(threshold: int, as_bytes: bool):
    """Rows key, text, spans settled first (begin, end, begin, …), places of later windows and their numbers."""

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for i, key in enumerate(batch.column(0).to_pylist()):
                text, early, late = batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or [], batch.column(3)[i].as_py() or []
                spans = list(zip(early[::2], early[1::2])) + [(f["at"], f["at"] + f["n"] + threshold) for f in late]
                rows.append((key, *_cut_one(text, spans, as_bytes)))
                held += len(text)
                if held >= BATCH_CHARS or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary() if as_bytes else pa.string()])], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])
                    rows, held = [], 0

    return run


def in_order(rows: DataFrame) -> DataFrame:
    """(rank pair, position) rows, sorted over ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "a", "b", "s", "w").sortWithinPartitions("a", "b", "s", "w")


def with_found(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """docs (key, h, tag, ...), in ``name`` the list of f of found (_h, _tag, f) for their text, and lead: true in one of the tasks that have the text.

    Copies of one text are dealt out by their keys over as many tasks as there are partitions; each of those gets the list."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    lists = found.groupBy("_h", "_tag").agg(F.collect_list("f").alias(name))
    where = docs.select("h", "tag", part.alias("part")).distinct().groupBy("h", "tag").agg(F.collect_list("part").alias("parts"))
    lists = lists.join(where, (F.col("h") == F.col("_h")) & (F.col("tag") == F.col("_tag"))).select("_h", "_tag", name, F.array_min("parts").alias("_least"), F.explode("parts").alias("_part"))
    joined = docs.join(lists, (F.col("h") == F.col("_h")) & (F.col("tag") == F.col("_tag")) & (part == F.col("_part")), "left")
    return joined.select(*docs.columns, name, (F.col("_part") == F.col("_least")).alias("lead"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 400, as_bytes: bool = True) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans (maximal removed runs), kept: the bytes left, or with ``as_bytes=False`` their SHA-256.

    Each byte goes that a string of ``threshold`` bytes (4 to 65 535) covers which also begins anywhere else."""
    if not 4 <= threshold < 1 << 16:
        raise ValueError("a threshold of 4 to 65535 bytes is needed")
    docs = df.select(
        F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), F.col(text)).bitwiseAND(F.lit(0x7FFF)).cast("int").alias("tag"), F.col(text).cast("binary").alias("text"),
    )
    first = durable(docs.filter(F.octet_length("text") >= threshold).select("h", "tag", "text").mapInArrow(_of_texts(threshold), _ROW))
    found = durable(in_order(first).mapInArrow(_compare(False, False), _FOUND))
    mark, at, n = unpacked(F.col("w"))
    joined = with_found(docs, found.select(F.col("s").alias("_h"), mark.alias("_tag"), F.struct("kind", at.alias("at"), n.alias("n")).alias("f")), "found")
    digest = "binary" if as_bytes else "string"
    parted = durable(joined.mapInArrow(_split(threshold, as_bytes), _RESULT + digest + ", h long, tag int, text binary, spans array<long>, stretches array<struct<at:int,n:int,mine:boolean,data:binary>>"))
    done = parted.filter("text IS NULL").select("key", "n_bytes", "n_removed", "n_spans", "kept")
    numbered = lambda rows: durable(rows.withColumn("s", F.monotonically_increasing_id()))
    going = numbered(parted.select("h", "tag", F.explode("stretches").alias("x")).select("h", "tag", "x.*"))
    late = going.select("h", "tag", "at", "n").limit(0)
    for length in lengths(threshold)[1:]:
        last = length == threshold
        rows = going.select("s", "mine", "data").mapInArrow(_of_stretches(threshold, length), _ROW)
        found = durable(in_order(rows).mapInArrow(_compare(True, last), _FOUND))
        mine, at, n = unpacked(F.col("w"))
        part = found.select("kind", "a", "b", F.col("s").alias("_s"), mine.alias("_mine"), at.alias("_at"), n.alias("_n"))
        settled = part.filter(F.col("kind") == SETTLED)
        if last:  # a rank that ends one range and begins the next
            edges = part.filter(F.col("kind") >= EDGE)
            twice = edges.groupBy("a", "b").agg(F.sum(F.col("kind") - EDGE + 1).alias("times")).filter("times > 1").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
            settled = settled.union(edges.filter(f"kind = {EDGE} AND _mine = 1").join(twice, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_semi"))
        late = late.union(settled.join(going, F.col("_s") == F.col("s")).select("h", "tag", (F.col("at") + F.col("_at")).alias("at"), F.col("_n").alias("n")))
        if not last:
            on = part.filter(F.col("kind").isin(OPEN, PARTNER)).join(going, F.col("_s") == F.col("s"))
            going = numbered(on.select("h", "tag", (F.col("at") + F.col("_at")).alias("at"), F.col("_n").alias("n"), (F.col("kind") == OPEN).alias("mine"), F.expr(f"substring(data, _at + 1, _n + {threshold})").alias("data")))
    rest = parted.filter("text IS NOT NULL").select("key", "h", "tag", "text", "spans")
    late = with_found(rest, late.select(F.col("h").alias("_h"), F.col("tag").alias("_tag"), F.struct("at", "n").alias("f")), "late")
    cut = late.select("key", "text", "spans", "late").mapInArrow(_cut(threshold, as_bytes), _RESULT + digest)
    return done.union(cut).withColumnRenamed("key", key)
