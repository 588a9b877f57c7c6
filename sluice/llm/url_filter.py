"""URL filter over a sorted digest array.

The rules become binary shards by ranges of their 64-bit xxhash keys: the keys in ascending order, the offsets of the rules'
strings, their verdicts and the strings. The shards are built in Spark tasks, about ``SHARD_BYTES`` each, and written to the shared folder;
each executor fetches them once (``addFile``) and its tasks map them into memory, so a list may be larger than memory, and
none of it passes the driver. A url's candidate rules (each suffix of its host at a dot and each prefix of its path that are as long as some rule's) are
hashed and looked for by a vectorised binary search; a hit counts only if the stored string is equal, so colliding digests
do no harm. The longest rule that fits wins, of equally long ones that with the longer host. A url that no rule fits is allowed.
Of rules that are listed with both verdicts, block counts.

Null urls and those without ``://`` have an empty host and path and are allowed. Repeated rows each give their own row.
Other columns are dropped. An empty rule list allows all; null rules are left out.
"""

from __future__ import annotations

import os
import struct
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, shipped, ship

SHARD_BYTES = 64_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class Shard:
    """The rules of one range of digests, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n, text_bytes, hosts, paths = struct.unpack("<QQQQ", f.read(32))
        at = 32
        sizes = np.memmap(path, np.uint64, "r", at, (hosts + paths,)).tolist() if hosts else []
        self.host_sizes, self.path_sizes = sizes[:hosts], sizes[hosts:]
        at += 8 * (hosts + paths)
        self.keys = np.memmap(path, np.uint64, "r", at, (n,)) if n else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.uint64, "r", at + 8 * n, (n + 1,))
        self.blocks = np.memmap(path, np.uint8, "r", at + 16 * n + 8, (n,)) if n else np.empty(0, np.uint8)
        self.text = np.memmap(path, np.uint8, "r", at + 17 * n + 8, (text_bytes,)) if text_bytes else np.empty(0, np.uint8)

    @staticmethod
    def build(rules: list[tuple[str, str]]) -> bytes:
        """rules: (verdict, rule), each rule once."""
        coded = sorted((xxhash.xxh64_intdigest(rule), rule.encode(), verdict == "block") for verdict, rule in rules)
        ends = np.cumsum([0, *(len(rule) for _, rule, _ in coded)]).astype(np.uint64)
        hosts, paths = (sorted({len(split_rule(rule)[part]) for _, rule in rules}) for part in (0, 1))
        head = struct.pack("<QQQQ", len(coded), int(ends[-1]), len(hosts), len(paths)) + np.array(hosts + paths, np.uint64).tobytes()
        return b"".join([head, np.array([k for k, _, _ in coded], np.uint64).tobytes(), ends.tobytes(), bytes(b for _, _, b in coded), *(rule for _, rule, _ in coded)])

    def rule(self, i: int) -> str:
        return bytes(self.text[int(self.ends[i]) : int(self.ends[i + 1])]).decode()

    def place(self, string: str, digest: np.uint64, at: int) -> int:
        """The place of a string whose digest is at ``at`` or not here, or -1."""
        while at < len(self.keys) and self.keys[at] == digest:
            if self.rule(at) == string:
                return at
            at += 1
        return -1


class DigestArray:
    """All shards of a list, by ascending ranges of digests."""

    def __init__(self, shards: list[Shard]):
        self.shards = sorted((s for s in shards if len(s.keys)), key=lambda s: int(s.keys[0]))
        self.first = np.array([s.keys[0] for s in self.shards], np.uint64)
        self.host_sizes = sorted({n for s in self.shards for n in s.host_sizes}, reverse=True)
        self.path_sizes = sorted({n for s in self.shards for n in s.path_sizes})

    def find(self, strings: list[str]) -> list[tuple[Shard, int] | None]:
        """The shard and the place in it of each string, or None."""
        digests = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        mine = np.searchsorted(self.first, digests, side="right") - 1
        found: list[tuple[Shard, int] | None] = [None] * len(strings)
        for n, shard in enumerate(self.shards):
            probed = np.flatnonzero(mine == n)
            at = np.searchsorted(shard.keys, digests[probed])
            inside = at < len(shard.keys)
            probed, at = probed[inside], at[inside]
            equal = shard.keys[at] == digests[probed]
            for i, k in zip(probed[equal].tolist(), at[equal].tolist()):
                if (k := shard.place(strings[i], digests[i], k)) >= 0:
                    found[i] = shard, k
        return found


def candidates(host: str, path: str, host_sizes: list[int], path_sizes: list[int]) -> list[str]:
    """All rules that would fit, the longest host first: as many at most as there are pairs of lengths, however long the url is. host_sizes descend."""
    hosts = [host[len(host) - n :] for n in host_sizes if n == len(host) or n < len(host) and host[len(host) - n - 1] == "."]
    return [h + path[:n] for h in hosts for n in path_sizes if n <= len(path)]


@cache
def digest_array(names: tuple[str, ...]) -> DigestArray:
    """The shards of these shipped files; each becomes a file of its own beside them, once for an executor."""
    paths = []
    for name in names:
        for i, blob in enumerate(shipped(name).column("shard")):
            path = os.path.join(SparkFiles.getRootDirectory(), f"{name}-{i}.bin")
            if not os.path.exists(path):
                with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(memoryview(blob.as_buffer()))
                os.replace(part, path)
            paths.append(path)
    return DigestArray([Shard(p) for p in paths])


def shards(rules: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard: the rules' digest arrays, one a range of digests. rules: verdict, rule."""
    size = rules.select(F.coalesce(F.sum(F.octet_length("rule") + 17), F.lit(0))).first()[0]
    n = 1 << max(0, (2 * size // shard_bytes).bit_length())
    once = rules.filter("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))

    def digests(batches):
        for batch in batches:
            of = [xxhash.xxh64_intdigest(r) * n >> 64 for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), batch.column(0), batch.column(1)], names=["range", "rule", "verdict"])

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([Shard.build(list(zip(table.column("verdict").to_pylist(), table.column("rule").to_pylist())))], pa.binary())})

    return once.select("rule", "verdict").mapInArrow(digests, "range long, rule string, verdict string").groupBy("range").applyInArrow(build, "shard binary")


def judge(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, key: str = "page_id", url: str = "url", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key``, host, path, rule, verdict. rules: (verdict, rule) pairs, or a DataFrame of these columns."""
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame(rules, "verdict string, rule string")
    names = ship(shards(rules.select("verdict", "rule"), shard_bytes))

    def rows(part):
        array = digest_array(names)
        split = [split_url(u) for u in part[url]]
        tried = [candidates(h, p, array.host_sizes, array.path_sizes) for h, p in split]
        places = iter(array.find([c for t in tried for c in t]))
        out = {key: part[key], "host": [h for h, _ in split], "path": [p for _, p in split], "rule": [], "verdict": []}
        for t in tried:
            best, longest = None, -1
            for c, place in zip(t, places):  # hosts come the longest first, so of equally long rules the first wins
                if place is not None and len(c) > longest:
                    best, longest = place, len(c)
            out["rule"].append(best[0].rule(best[1]) if best else None)
            out["verdict"].append("block" if best and best[0].blocks[best[1]] else "allow")
        return out

    return map_text(df, [key, url], f"{key} long, host string, path string, rule string, verdict string", rows, url)
