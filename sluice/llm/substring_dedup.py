"""Removal of repeated passages by fixed-block anchors.

A passage of ``window`` words that occurs twice holds, in either place, a whole block of the text's own grid of
non-overlapping blocks of ``block`` = (window + 1) // 2 words, and the other place has that block's words as a rolling window.

1. Anchors: the blocks are the index; every rolling window of ``block`` words of every text probes it. Index and
   probes meet by ranges of their hash. A block that any other place probes is a hit. The probes of a range are held, its
   blocks stream past them.
2. Extension: a hit grows into the windows of ``window`` words that hold its block. Two independent hashes of their words of 64 and 32
   bits stand for a window (among 10^13 windows a chance pair is expected with a probability of 6e-4); those found twice or more,
   anywhere, are exact repeats. Overlapping ones make up the maximal repeats, and all words under them go, judged on the input.

Hashes travel as sorted, delta-coded sets of a batch of texts, each at most once for a batch, so a passage that a third of
all texts share costs one entry a batch. Repeats come back as one bit for each entry, which the batch then maps to its
places. The anchors' hashes are as long as the corpus needs for about one chance hit in a thousand, which the extension
then turns down. There is a range of hashes for each ``bucket_bytes`` of text at most, so what a task holds does not grow with the corpus.

Null text counts as empty. Texts shorter than a window lose nothing. Repeated rows are different documents, so they lose
what they share (texts are told apart by a 64-bit hash of key and text; equal rows lose the same words). Other columns
are dropped.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sha256, words_of

#: Words that a task gathers before it hands on their hashes.
FLUSH = 2_000_000
#: Words of a batch of the extension.
BATCH = 1_000_000
#: Bytes of text for which there is a range of hashes.
BUCKET_BYTES = 64_000_000
REMEMBERED = 400_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_SECOND = 0xD6E8FEB86659FD93


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, size: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """The hash of each run of ``size`` words, from the hashes of runs half as long."""
    if len(words) < size:
        return words[:0]
    have, k, run, power = None, 0, words, multiplier
    length = 1
    while True:
        if size & length:
            if have is None:
                have, k = run, length
            else:  # run before what there is
                n = len(words) - length - k + 1
                have = run[:n] * np.uint64(pow(multiplier, k, 1 << 64)) + have[length : length + n]
                k += length
        if 2 * length > size:
            break
        run = run[:-length] * np.uint64(power) + run[length:]
        power, length = power * power % (1 << 64), 2 * length
    h = (have ^ (have >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences of as many bytes as most of them need; larger ones follow apart."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    width = min(8, max(1, (int(np.quantile(steps, 0.99)).bit_length() + 7) // 8))
    most = (1 << 8 * width) - 1
    large = steps >= np.uint64(most)
    short = np.where(large, np.uint64(most), steps)
    return struct.pack("<BII", width, len(values), int(large.sum())) + short.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + steps[large].tobytes()


def unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width, n, more = struct.unpack_from("<BII", data)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, n * width, 9).reshape(n, width)
    steps = steps.reshape(-1).view(np.uint64).copy()
    if more:
        steps[steps == np.uint64((1 << 8 * width) - 1)] = np.frombuffer(data, np.uint64, more, 9 + n * width)
    return np.cumsum(steps, dtype=np.uint64)


def cuts(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the buckets, equal ranges of hash values, begin in ascending values, and the end."""
    step = -(-(1 << bits) // buckets)
    bounds = np.array([min(i * step, (1 << bits) - 1) for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(values, bounds), len(values))


def at_least_twice(values: np.ndarray) -> np.ndarray:
    """The distinct values found twice or more."""
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def _up_to_two(values: np.ndarray) -> np.ndarray:
    """Ascending, each at most twice."""
    values = np.sort(values)
    return values[np.append([True, True], values[2:] != values[:-2])[: len(values)]]


def _inside(ends: np.ndarray, sizes: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether the run of ``size`` words at each of the first n places stays in its text."""
    return np.arange(n) + size <= np.repeat(ends, sizes)[:n]


def _anchors(window: int, block: int, bits: int, buckets: int):
    def run(batches):
        keys, parts, held = [], [], 0

        def flush():
            words = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts])
            ends = np.cumsum(sizes)
            h = rolling(words, block) >> np.uint64(64 - bits)
            inside = _inside(ends, sizes, len(h), block)
            probes = _up_to_two(h[inside])
            counts = (sizes - block) // block + 1
            number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            blocks = h[np.repeat(ends - sizes, counts) + number * block]
            owners = np.repeat(np.array(keys, np.int64), counts)
            order = np.argsort(blocks, kind="stable")
            blocks, owners, number = blocks[order], owners[order], number[order].astype(np.int32)
            p, q = cuts(probes, bits, buckets), cuts(blocks, bits, buckets)
            for k in np.flatnonzero(p[1:] > p[:-1]).tolist():
                yield k, False, pack(probes[p[k] : p[k + 1]]), None, None
            for k in np.flatnonzero(q[1:] > q[:-1]).tolist():
                c, d = q[k], q[k + 1]
                yield k, True, pack(blocks[c:d]), owners[c:d].tobytes(), number[c:d].tobytes()

        def give(rows):
            for at in range(0, len(rows), 64):
                piece = list(zip(*rows[at : at + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(piece[0], pa.int32()), pa.array(piece[1], pa.bool_()), *(pa.array(x, pa.binary()) for x in piece[2:])], names=["bucket", "index", "hashes", "owners", "numbers"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if len(words) >= window:
                    keys.append(key)
                    parts.append(hash_words(words))
                    held += len(words)
                    if held >= max(FLUSH, 16 * buckets):
                        yield from give(list(flush()))
                        keys, parts, held = [], [], 0
        if parts:
            yield from give(list(flush()))

    return run


def _hits(batches):
    """The blocks whose words are found elsewhere. Rows come by bucket, in each the probes first; the blocks stream past them."""
    bucket, probes, twice = None, [], None
    for batch in batches:
        for i, (b, index) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if b != bucket:
                bucket, probes, twice = b, [], None
            values = unpack(batch.column(2)[i].as_py())
            if not index:
                probes.append(values)
                continue
            if twice is None:
                twice, probes = at_least_twice(np.concatenate(probes)), []
            if len(twice):
                hit = twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values
                owner, number = np.frombuffer(batch.column(3)[i].as_py(), np.int64), np.frombuffer(batch.column(4)[i].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array(number[hit])], names=["owner", "number"])


def _settle(as_text: bool):
    """Texts without hits are done; the others get the number of a batch."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256).to_pydict()
                out = {c: [] for c in ("n_words", "kept", "batch")}
                for text, hits in zip(rows["text"], rows["hits"]):
                    words = words_of(text)
                    if hits is not None:
                        if held >= BATCH:
                            number, held = number + 1, 0
                        held += len(words)
                    whole = None if hits is not None else b" ".join(words)
                    out["n_words"].append(len(words))
                    out["kept"].append(None if whole is None else whole.decode() if as_text else sha256(whole))
                    out["batch"].append(None if hits is None else number)
                texts = [t if h is not None else None for t, h in zip(rows["text"], rows["hits"])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(out["n_words"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["batch"], pa.int64()), batch.column(1).slice(at, 256), pa.array(texts, pa.string()), pa.array(rows["hits"], pa.list_(pa.int32()))],
                    names=["key", "n_words", "kept", "batch", "owner", "text", "hits"],
                )

    return run


class _Batch:
    """The candidate windows of a batch's texts: their places and hashes."""

    def __init__(self, table: pa.Table, window: int, block: int):
        table = table.sort_by([("owner", "ascending")])
        self.keys = table.column("key")
        self.words = [words_of(t.as_py()) for t in table.column("text")]
        sizes = np.array([len(w) for w in self.words])
        self.starts = np.cumsum(sizes) - sizes
        each = np.concatenate([hash_words(w) for w in self.words])
        h = rolling(each, window)
        near = np.zeros(int(sizes.sum()) + 1, np.int32)
        for start, hits in zip(self.starts.tolist(), table.column("hits").to_pylist()):
            b = np.array(hits, np.int64) * block
            np.add.at(near, start + np.maximum(b + block - window, 0), 1)
            np.add.at(near, start + b + 1, -1)
        near = np.cumsum(near[:-1])[: len(h)] > 0
        self.places = np.flatnonzero(near & _inside(np.cumsum(sizes), sizes, len(h), window))
        first, second = h[self.places], (rolling(each, window, _SECOND)[self.places] >> np.uint64(32)).astype(np.uint32)
        order = by_both(first, second)
        first, second = first[order], second[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(first)]
        self.first, self.second = first[new], second[new]
        self.number = np.empty(len(order), np.int64)  # of each place the number of its window among the distinct ones
        self.number[order] = np.cumsum(new) - 1


def by_both(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order by both; the second counts only where chance made two of the first equal."""
    order = np.argsort(first, kind="stable")
    f, s = first[order], second[order]
    return np.lexsort((second, first)) if ((f[1:] == f[:-1]) & (s[1:] != s[:-1])).any() else order


def _windows(window: int, block: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        b = _Batch(table, window, block)
        counts = np.bincount(b.number, minlength=len(b.first))
        c = cuts(b.first, 64, buckets)
        full = np.flatnonzero(c[1:] > c[:-1]).tolist()
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "batch": pa.array([batch] * len(full), pa.int64()),
                "values": pa.array([pack(b.first[c[k] : c[k + 1]]) for k in full], pa.binary()),
                "second": pa.array([b.second[c[k] : c[k + 1]].tobytes() for k in full], pa.binary()),
                "twice": pa.array([np.packbits(counts[c[k] : c[k + 1]] > 1).tobytes() for k in full], pa.binary()),
            }
        )

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: for each batch, a bit for each of its windows that is found elsewhere."""
    values = [unpack(v.as_py()) for v in table.column("values")]
    first, second = np.concatenate(values), np.concatenate([np.frombuffer(v.as_py(), np.uint32) for v in table.column("second")])
    own = np.concatenate([np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(v)).astype(bool) for t, v in zip(table.column("twice"), values)])
    order = by_both(first, second)
    first, second = first[order], second[order]
    same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    own[order[1:][same]] = own[order[:-1][same]] = True
    ends = np.cumsum([len(v) for v in values])
    found = [np.packbits(own[e - len(v) : e]).tobytes() for e, v in zip(ends.tolist(), values)]
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "found": pa.array(found, pa.binary())})


def _cut(window: int, block: int, buckets: int, as_text: bool):
    def run(texts: pa.Table, bits: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"key": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        b = _Batch(texts, window, block)
        c = cuts(b.first, 64, buckets)
        repeated = np.zeros(len(b.first), bool)
        for k, found in zip(bits.column("bucket").to_pylist(), bits.column("found").to_pylist()):
            repeated[c[k] : c[k + 1]] = np.unpackbits(np.frombuffer(found, np.uint8), count=int(c[k + 1] - c[k]))
        at = b.places[repeated[b.number]]
        total = sum(map(len, b.words))
        change = np.zeros(total + window + 1, np.int32)
        change[at] += 1
        change[at + window] -= 1
        gone = np.cumsum(change[:total]) > 0
        removed, kept = [], []
        for start, words in zip(b.starts.tolist(), b.words):
            mine = gone[start : start + len(words)]
            removed.append(int(mine.sum()))
            rest = b" ".join([w for w, g in zip(words, mine.tolist()) if not g] if removed[-1] else words)
            kept.append(rest.decode() if as_text else sha256(rest))
        return pa.table({"key": b.keys, "n_words": pa.array([len(w) for w in b.words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, as_text: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``key``, n_words, n_removed and kept: the words left, joined by one space, or with ``as_text=False`` their SHA-256."""
    spark, block = df.sparkSession, (window + 1) // 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(key, text).alias("owner"), F.col(text).alias("text"))
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(64, max(32, (size // 4).bit_length() + 10))
    buckets = max(2 * parts, size // bucket_bytes)
    anchors = docs.filter("text IS NOT NULL").select("owner", "text").mapInArrow(_anchors(window, block, bits, buckets), "bucket int, index boolean, hashes binary, owners binary, numbers binary")
    hits = anchors.repartition(parts, "bucket").sortWithinPartitions("bucket", "index").mapInArrow(_hits, "owner long, number int")
    by_text = hits.groupBy("owner").agg(F.array_sort(F.collect_set("number")).alias("hits"))
    joined = docs.join(by_text, "owner", "left").select("key", "owner", "text", "hits")
    settled = durable(joined.mapInArrow(_settle(as_text), "key long, n_words long, kept string, batch long, owner long, text string, hits array<int>"))
    done = settled.filter("batch IS NULL").select("key", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    rest = settled.filter("batch IS NOT NULL").select("batch", "key", "owner", "text", "hits")
    windows = rest.select("batch", "key", "owner", "text", "hits").groupBy("batch").applyInArrow(_windows(window, block, buckets), "bucket int, batch long, values binary, second binary, twice binary")
    found = windows.groupBy("bucket").applyInArrow(_repeats, "batch long, bucket int, found binary")
    cut = rest.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_cut(window, block, buckets, as_text), "key long, n_words long, n_removed long, kept string")
    return done.union(cut).withColumnRenamed("key", key)
