"""Merkle manifest of a table: a digest for each row, a tree of them for each source, and a tree over the sources.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text. A row's leaf is H of its columns, each ``-`` if
null, else the number of its UTF-8 bytes, ``:`` and the value. While a source has more than one node, every ``FANOUT``
consecutive ones become their H (the last run may be shorter, even one node); what remains is its subroot. The subroots, ordered
by source, become the root in the same way.

1. Leaves are hashed where the texts are read; only digests travel. They are sorted by (source, key) over ranges, so a source of a
   third of all rows is many ranges, and numbered by the counts of the ranges before.
2. Numbered nodes meet in aligned blocks of ``FANOUT ** LEVELS``. A block is one contiguous matrix of 64-byte hex digests, reshaped
   by the fanout and hashed row by row, level by level. Blocks' digests are the nodes of the next tier, until each source has one.
3. Back from the top, each block gets the siblings above it once; those within it are slices of the matrices by index
   arithmetic. A path is a list of (left, right): the run's nodes before and after one's own, as one string each.

A task holds a block at a time. Tiers are as many as the logarithm of the largest source to the base of a block.

Rows of a source are ordered by key, nulls first, then by leaf; repeated rows are leaves of their own. A null source is a
source, the first one. Empty tables give no rows. Columns besides those of the leaf are dropped. Keys are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

FANOUT = 16
#: Levels of the tree that a block holds.
LEVELS = 2
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STEPS = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def H(data: bytes | memoryview) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf(columns: list[Column]) -> Column:
    """A row's leaf: H of its columns."""
    coded = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*coded), 256)


def matrix(nodes: list[str]) -> np.ndarray:
    """Hex digests as the rows of one contiguous matrix."""
    return np.frombuffer("".join(nodes).encode(), np.uint8).reshape(len(nodes), HEX)


def climb(nodes: np.ndarray, levels: int | None) -> list[np.ndarray]:
    """The matrices of the levels from these nodes up: so many, or until one node remains."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        whole = len(below) // FANOUT
        runs = below[: whole * FANOUT].reshape(whole, FANOUT * HEX)
        above = [H(memoryview(r)) for r in runs]
        if len(below) % FANOUT:
            above.append(H(memoryview(below[whole * FANOUT :].reshape(-1))))
        out.append(np.frombuffer(b"".join(above), np.uint8).reshape(len(above), HEX))
    return out


def siblings(levels: list[np.ndarray], i: int) -> list[tuple[str, str]]:
    """Of node ``i`` of the lowest matrix the run's nodes before and after its own, on each level but the last."""
    path = []
    for nodes in levels[:-1]:
        run = i // FANOUT * FANOUT
        path.append((nodes[run:i].tobytes().decode(), nodes[i + 1 : run + FANOUT].tobytes().decode()))
        i //= FANOUT
    return path


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its path give."""
    return reduce(lambda d, s: hashlib.sha256(f"{s[0]}{d}{s[1]}".encode()).hexdigest(), path, node)


def numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``at``: each row's place in its group, and ``total``: the group's rows. A group may be many tasks' work."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = nodes.repartitionByRange(parts, *(F.col(c).asc_nulls_first() for c in [*group, *order]))
    ranges = durable(ranges.withColumn("range", F.spark_partition_id()))
    whole = Window.partitionBy(*group)
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(*group, "range").count()  # a row for each range of a source
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in group), F.col("range").alias("_range"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(whole).alias("total"))
    own = Window.partitionBy(*group, "range").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    placed = ranges.withColumn("place", F.row_number().over(own) - 1)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, "range"]])
    return placed.join(starts, same).select(*nodes.columns, (F.col("start") + F.col("place")).alias("at"), "total")


def _map(df: DataFrame, schema: str, kinds: pa.Schema, rows: Callable[[dict], dict]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):  # a block a time
                out = rows({c: v[0] for c, v in batch.slice(i, 1).to_pydict().items()})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def _levels(total: int) -> int | None:
    """A group of one block ends with one node; each block of a larger group spans all its levels."""
    return None if total <= FANOUT**LEVELS else LEVELS


def _up(block):
    return {"source": [block["source"]], "at": [block["block"]], "total": [-(-block["total"] // FANOUT**LEVELS)], "node": [climb(matrix([m["node"] for m in block["members"]]), _levels(block["total"]))[-1].tobytes().decode()]}


def _down(block):
    levels, above = climb(matrix([m["node"] for m in block["members"]]), _levels(block["total"])), [(s["left"], s["right"]) for s in block["above"] or []]
    paths = [siblings(levels, i) + above for i in range(len(block["members"]))]
    return {"source": [block["source"]] * len(paths), "at": [m["at"] for m in block["members"]], "path": [[{"left": a, "right": b} for a, b in p] for p in paths]}


def _proofs(block):
    levels, above = climb(matrix([m["node"] for m in block["members"]]), _levels(block["total"])), [(s["left"], s["right"]) for s in block["above"] or []]
    out = {"key": [], "leaf": [], "subroot": [], "root": [], "proof_sha256": [], "folded_root": [], "verified": []}
    for i, m in enumerate(block["members"]):
        path = siblings(levels, i) + above
        folded = fold(m["tampered"] or m["node"], path)
        values = m["key"], m["node"], block["subroot"], block["root"], hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest(), folded, folded == block["root"]
        for c, v in zip(out, values):
            out[c].append(v)
    return out


_NODES = pa.schema([("source", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("node", pa.string())])
_PATHS = pa.schema([("source", pa.string()), ("at", pa.int64()), ("path", _PATH)])


def blocks(nodes: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """source, block, total, members: at, node and ``more`` in order; at most FANOUT ** LEVELS a block."""
    return nodes.groupBy("source", F.floor(F.col("at") / FANOUT**LEVELS).alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("at", "node", *more))).alias("members"))


class Tree:
    """The tiers of blocks over numbered nodes (source, at, total, node and ``more``)."""

    def __init__(self, nodes: DataFrame, more: tuple[str, ...] = ()):
        self.tiers = [durable(blocks(nodes, more))]
        while True:
            self.tops = durable(_map(self.tiers[-1], "source string, at long, total long, node string", _NODES, _up))
            if self.tops.filter("total > 1").isEmpty():
                break
            self.tiers.append(durable(blocks(self.tops.filter("total > 1"))))
            self.done = self.tops.filter("total = 1") if len(self.tiers) == 2 else self.done.union(self.tops.filter("total = 1"))
        #: source, node: of each source what remains.
        self.roots = (self.tops if len(self.tiers) == 1 else self.done.union(self.tops)).select("source", "node")

    def above(self, tops: DataFrame) -> DataFrame:
        """The lowest blocks with the path above each. tops: source, and the path above its top."""
        tops = tops.select(F.col("source").alias("_source"), F.col("path").alias("top"))
        paths = None
        for tier in reversed(self.tiers):
            with_top = tier.join(tops, tier.source.eqNullSafe(tops._source), "left").drop("_source")
            if paths is None:
                given = with_top.withColumn("above", F.col("top"))
            else:
                p = paths.select(F.col("source").alias("_s"), F.col("at").alias("_at"), F.col("path").alias("below"))
                given = with_top.join(p, with_top.source.eqNullSafe(p._s) & (with_top.block == p._at), "left").withColumn("above", F.coalesce("below", "top")).drop("_s", "_at", "below")
            given = given.drop("top")
            if tier is not self.tiers[0]:
                paths = durable(_map(given, f"source string, at long, path {_STEPS}", _PATHS, _down))
        return given


def prove(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", columns: tuple[str, ...] = COLUMNS, tamper: Column | None = None) -> DataFrame:
    """``key``, leaf, subroot, root, proof_sha256 (of all siblings, level by level), folded_root, verified.

    folded_root comes from the row's leaf, where ``tamper`` holds from that of the row with A-Z of its text lower-cased, and the siblings
    of its proof; verified says whether it is the root."""
    tamper = F.lit(False) if tamper is None else tamper
    changed = leaf([F.translate(text, _UPPER, _UPPER.lower()) if c == text else F.col(c) for c in columns])
    leaves = durable(df.select(F.col(source).cast("string").alias("source"), F.col(key).cast("long").alias("key"), leaf([F.col(c) for c in columns]).alias("node"), F.when(tamper, changed).alias("tampered"), F.monotonically_increasing_id().alias("n")))
    kinds = pa.schema([("key", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    tree = Tree(numbered(leaves, ["source"], ["key", "node", "n"]), ("key", "tampered"))
    all_sources = numbered(durable(tree.roots).select(F.lit(0).alias("all"), F.col("source").alias("name"), "node"), ["all"], ["name"])
    over = Tree(all_sources.select(F.lit("").alias("source"), "at", "total", "node", "name"), ("name",))
    root = over.roots.select(F.col("node").alias("root"))  # one row
    top = over.above(over.roots.select("source", F.array().cast(_STEPS).alias("path")))
    at_top = pa.schema([("source", pa.string()), ("subroot", pa.string()), ("path", _PATH)])
    tops = durable(_map(top, f"source string, subroot string, path {_STEPS}", at_top, lambda b: {"source": [m["name"] for m in b["members"]], "subroot": [m["node"] for m in b["members"]], "path": _down(b)["path"]}).crossJoin(F.broadcast(root)))
    given = tree.above(tops)
    named = tops.select(F.col("source").alias("_source"), "subroot", "root")
    proved = _map(given.join(named, given.source.eqNullSafe(named._source)).drop("_source"), "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", kinds, _proofs)
    return proved.withColumnRenamed("key", key)


def sampled(key: str = "doc_id", every: int = 5) -> Column:
    """Where ``every`` divides the CRC-32 of the key's decimal digits; never for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % every == 0, F.lit(False))
