"""The Merkle manifest against a plain version."""

import collections
import hashlib
import zlib

from pyspark.sql import functions as F

from sluice.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, path string, at long, total long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    found = []
    for nodes in tree[:-1]:
        run = i // 16 * 16
        found.append((nodes[run:i], nodes[i + 1 : run + 16]))
        i //= 16
    return found


def plain(rows, every=5):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(r[:5]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names]
    over = levels([t[-1][0] for t in trees])
    out = []
    for j, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            steps = path(trees[j], i) + path(over, j)
            d = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0 and r[4] is not None:
                d = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in steps:
                d = H(*a, d, *b)
            out.append((r[0], own, trees[j][-1][0], over[-1][0], H(*(x for a, b in steps for x in a + b)), d, d == over[-1][0]))
    return out


def rows_of(n, sources):
    return [(i // 2 if i % 50 == 0 else i, sources(i), "en", None if i % 7 == 0 else i, None if i % 11 == 0 else "" if i % 13 == 0 else f"Text {i} ÉÄ", "x", "y", 1, 2) for i in range(n)]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = manifest.prove(df, tamper=manifest.sampled()).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))
    return got


def test_one_hot_source_over_many_blocks(spark):
    """A source of three tiers' depth beside one of a single leaf, a null and an empty source; nulls, repeated rows, clashing names."""
    rows = rows_of(5000, lambda i: "hot" if i % 3 else None if i % 2 else "" if i > 4000 else "cold" if i > 0 else "lone")
    rows += [rows[5]] * 40 + [(None, "hot", None, None, None, None, None, None, None)] * 3
    got = check(spark, rows)
    assert 0 < sum(not r.verified for r in got) < len(got) / 4


def test_exact_block_sizes(spark):
    for n in (1, 2, 16, 17, 256, 257):
        check(spark, rows_of(n, lambda i: "s"))
    check(spark, rows_of(600, lambda i: f"s{i % 300}"))  # more sources than a block


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert manifest.prove(df).collect() == []


def test_long_text_and_no_tampering(spark):
    df = spark.createDataFrame([(1, "a", "en", 9, "Ab" * 2_000_000), (2, "b", "en", 9, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    assert all(r.verified for r in manifest.prove(df).collect())
    assert [r.verified for r in manifest.prove(df, tamper=F.lit(True)).orderBy("doc_id").collect()] == [False, True]
