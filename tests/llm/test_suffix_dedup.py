"""Repeated byte strings against a plain version."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import suffix_dedup


def plain(texts, threshold):
    """All windows counted by their bytes."""
    counts = collections.Counter(t[i : i + threshold] for t in texts for i in range(len(t) - threshold + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - threshold + 1):
            if counts[t[i : i + threshold]] > 1:
                gone[i] += 1
                gone[i + threshold - 1 + 1] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int(np.sum(gone & ~np.append(False, gone[:-1])[: len(t)]))
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def made(seed, n, letters="abcdefgh "):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


PASSAGE, LONG = made(1, 900), made(2, 4000)
TEXTS = [
    None, "", "short", PASSAGE[:400], PASSAGE[:399], "x" + PASSAGE[100:501] + "y", made(3, 700) + PASSAGE + made(4, 500), made(5, 300) + PASSAGE + made(6, 800) + PASSAGE[200:700],
    LONG, LONG, LONG, LONG[:2000] + "!" + LONG[2001:], LONG[:500] + LONG[501:3000] + made(7, 600), "a" * 1500, "ab" * 700, "é日" * 300 + PASSAGE[:450] + "😀", LONG[1000:1399], LONG[3600:], made(8, 5000), "z" * 401, "q" * 400,
]


@pytest.mark.parametrize("threshold", [400, 37])
def test_against_plain(spark, threshold):
    """Copies, near copies, periodic texts, repeats inside one text, passages at the threshold; null and repeated keys, clashing names."""
    rows = [(None if i % 7 == 0 else i // 2, t, 1, "s", "h") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s long, a string, h string").repartition(3)
    want = collections.Counter((r[0], *p) for r, p in zip(rows, plain([(t or "").encode() for t in TEXTS], threshold)))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(df, threshold=threshold).collect()]
    assert collections.Counter(got) == want
    digests = collections.Counter(map(tuple, suffix_dedup.remove_repeats(df, threshold=threshold, as_bytes=False).collect()))
    assert digests == collections.Counter((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want.elements())


def test_many_copies_over_many_ranges(spark):
    """A passage that a third of the texts share, near copies, and more ranges than rows of a rank: groups that borders of ranges divide."""
    texts = [made(100 + i, 300) + (PASSAGE[:450] if i % 3 == 0 else "") + made(500 + i, 200) for i in range(120)] + [LONG[: 30 * i] + "#" + LONG[30 * i :] for i in range(1, 60)] + [LONG] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = [(i, *p) for i, p in enumerate(plain([t.encode() for t in texts], 400))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(df).collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_do_not_meet_in_one_task(spark, monkeypatch):
    """Copies of one text get what was found of it in many tasks, each with its text."""
    tables = []
    monkeypatch.setattr(suffix_dedup, "durable", lambda df, of=suffix_dedup.durable: tables.append(of(df)) or tables[-1])
    texts = [LONG[:900]] * 400 + [made(20 + i, 500) + PASSAGE[: 300 + 20 * i] for i in range(20)] + [None, ""]
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(i, *p) for i, p in enumerate(plain([(t or "").encode() for t in texts], 400))]
    cut = next(t for t in tables if "stretches" in t.columns)
    tasks = [r[1] for r in cut.filter("key < 400").groupBy(F.input_file_name()).count().collect()]
    assert sum(tasks) == 400 and max(tasks) < 200


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    texts = [made(9, 7000) + PASSAGE, PASSAGE + made(10, 3000) + PASSAGE[:600], made(11, 50) + LONG, LONG + "."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(i, *p) for i, p in enumerate(plain([t.encode() for t in texts], 400))]


def test_edges_of_ranges():
    """The comparison of neighbours gives the same whatever batches the sorted rows come in."""
    r = np.random.default_rng(3)
    a, b = r.integers(0, 40, 400), r.integers(0, 3, 400)
    order = np.lexsort((b, a))
    rows = [x[order].astype(np.int64) for x in (a, b, np.arange(400), np.full(400, 1 << 47))]
    def found(sizes, last):
        at, out = 0, []
        batches = []
        for n in sizes:
            batches.append(pa.RecordBatch.from_arrays([pa.array(x[at : at + n]) for x in rows], names=["a", "b", "s", "w"]))
            at += n
        for batch in suffix_dedup._compare(True, last)(iter(batches)):
            out += list(zip(*(c.to_pylist() for c in batch.columns)))
        return sorted(out)
    for last in (False, True):
        assert found([400], last) == found([1] * 400, last) == found([7] * 57 + [1], last)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).collect() == []
