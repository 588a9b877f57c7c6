"""Token ids in binary shards with a minimal perfect hash index.

A store is a Parquet table of shards in key order; a shard is one row: the raw ids of its documents, one after the other
in ascending key order, as little-endian 16- or 32-bit integers, and an index over its keys. The index is a minimal
perfect hash function (levels of bit arrays: at each level the keys that meet no other key set their bit, the rest go on; a
key's slot is the rank of its bit), and for each slot a 32-bit fingerprint of the key, the document's offset and its length. So a key is
found in constant time, and one that is not there is turned down by its fingerprint.

The rows are dealt out by ranges of the key, so shards follow each other in key order. Each shard knows how many ids its own
partition holds before it; only the partitions' totals are summed up to give places in the whole.

Null text counts as empty: just the end id. Rows of equal keys follow each other by the hash of their text, and the index tells them
apart by their occurrence within the shard. Null keys come first. Other columns are dropped.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

SHARD_IDS = 1_000_000
#: Words that a Python worker remembers.
REMEMBERED = 900_000
_SCHEMA = "part int, shard int, first_key long, last_key long, n_docs int, n_ids long, ids_before long, width int, keys binary, nulls binary, levels binary, fingerprints binary, offsets binary, lengths binary, payload binary"


# The minimal perfect hash.


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """Distinct for distinct (key, null, occurrence) of less than 2**31 occurrences."""
    return _mix(keys.view(np.uint64), 1) ^ _mix(occurrence.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64), 2)


def occurrences(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """How often each key came before; equal keys must follow each other."""
    new = np.append(True, (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])) if len(keys) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.empty(0, np.int64)
    return np.arange(len(keys)) - first


class PerfectHash:
    """levels: bit arrays, one for each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, hashes: np.ndarray, room: float = 2.0, most: int = 64) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            if len(levels) == most:
                raise ValueError("keys' hashes are not distinct")
            size = max(8, int(room * len(left)))
            at = (_mix(left, 3 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where no level has the key's bit."""
        found, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for n, bits in enumerate(self.levels):
            at = (_mix(hashes[left], 3 + n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[left[hit]] = self.before[n] + self.ranks[n][at[hit]]
            left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *(len(b) for b in self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8).tolist(), 8 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 1 << 20) >> np.uint64(32)).astype(np.uint32)


# Encoding: no token crosses white space, so each distinct word is encoded once and remembered.

#: What a tokenizer's file must say for words to be encoded one by one; other files' texts go to the library whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: A run of these is one piece beside letters. The apostrophe may begin a piece of its own.
_SIGNS = string.punctuation.replace("'", "")
#: Letters below this stay as they are in NFC, and all but the second become one letter each in lower case.
_PLAIN, _DOTTED = "\u0300", "\u0130"
#: Characters of a text that are encoded at once.
_LONG = 4_000_000


def by_words(file: dict) -> bool:
    """Whether a tokenizer's file lets each word be encoded for itself."""
    model, plain = file["model"], all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in file["added_tokens"])
    split = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    return plain and file["normalizer"] == _NORMALIZER and file["pre_tokenizer"] == split and model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"]


class WordIds:
    """Texts' ids by the tokenizers library, as bytes of ``width`` each. The ids of the words that are known lie one after the other in ``arena``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in file["added_tokens"]]
        self.words = by_words(file)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        if self.words:
            normal, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {i: "".join(p for p, _ in split(normal(chr(i)))) for i in range(ord(_PLAIN)) if chr(i).isalpha()}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.arena, self.used = np.empty(1 << 16, self.kind), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, ids: list[list[int]]) -> None:
        """The ids of the words that ``known`` has got since."""
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        n, total = len(self.known), int(sizes.sum())
        while n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + total > len(self.arena):
            self.arena = np.resize(self.arena, 2 * len(self.arena))
        self.starts[n - len(ids) : n], self.lengths[n - len(ids) : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.arena[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), self.kind, total)
        self.used += total

    def learn(self, words: list[str]) -> None:
        """Letters with signs before or behind them are learnt in three pieces, all else as a text of its own."""
        known, base, new, rest, model = self.known, len(self.known), [], [], self.tokenizer.model

        def piece(p: str) -> list[int]:
            n = known.get(p)
            if n is None:
                known[p] = base + len(new)
                new.append([t.id for t in model.tokenize(p if p.isascii() else p.translate(self.letters))] if p else [])
                return new[-1]
            return new[n - base] if n >= base else self.arena[self.starts[n] : self.starts[n] + self.lengths[n]].tolist()

        for w in words:
            core = w.strip(_SIGNS)
            if not core or core.isalpha() and (core.isascii() or max(core) < _PLAIN and _DOTTED not in core):
                ids = piece(core or w)
                if core and core != w:
                    head = w[: w.find(core)]
                    ids = piece(head) + ids + piece(w[len(head) + len(core) :])
                    known[w] = base + len(new)
                    new.append(ids)
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = base + len(new)
            new.append(e.ids)
        self.add(new)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        found = list(map(self.known.get, words))
        if None in found:
            missing = [i for i, f in enumerate(found) if f is None]
            self.learn([words[i] for i in missing])
            for i in missing:
                found[i] = self.known[words[i]]
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array, most: int | None = None) -> list[bytes]:
        """Texts of more than ``most`` characters are encoded in parts."""
        texts = pc.fill_null(texts, "")
        odd = np.full(len(texts), not self.words)
        for s in self.specials:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        long = pc.greater(pc.utf8_length(texts), most or _LONG).to_numpy(zero_copy_only=False) & ~odd
        # A-Z are lower-cased here already, as the file's normalizer does
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(odd | long), "", texts)))
        coded = lists.values.dictionary_encode()
        number = self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        lengths = self.lengths[number]
        ends = np.cumsum(lengths, dtype=np.int64)
        places = np.repeat(self.starts[number] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        data, width = self.arena[places].tobytes(), self.kind.itemsize
        cut = (np.append(0, ends)[lists.offsets.to_numpy()] * width).tolist()
        out = [data[a:b] for a, b in zip(cut, cut[1:])]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole([texts[i].as_py()])[0]
        for i in np.flatnonzero(long).tolist():
            out[i] = b"".join(x for part in _parts(texts[i].as_py()) for x in self.encode(pa.array([part]), len(part)))
        return out


def _parts(text: str):
    """A long text in parts that end at spaces; one without spaces is one part."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= _LONG else text.rfind(" ", at, at + _LONG) + 1
        end = end if end > at else (text.find(" ", at) + 1 or len(text))
        yield text[at:end]
        at = end


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _shards(path: str, end_id: int, most: int):
    def run(batches):
        encoder, part, before, number = word_ids(path), TaskContext.get().partitionId(), 0, 0
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        keys, ids, held = [], [], 0

        def shard():
            nonlocal before, number
            plain = np.array([k if k is not None else 0 for k in keys], np.int64)
            nulls = np.array([k is None for k in keys], bool)
            lengths = np.array([len(i) // width for i in ids], np.int64)
            hashes = key_hashes(plain, nulls, occurrences(plain, nulls))
            index = PerfectHash.build(hashes)
            slots = index.slots(hashes)
            place = np.empty(len(keys), np.int64)
            place[slots] = np.arange(len(keys))
            row = {
                "part": part, "shard": number, "first_key": keys[0], "last_key": keys[-1], "n_docs": len(keys), "n_ids": int(lengths.sum()), "ids_before": before, "width": width,
                "keys": plain.tobytes(), "nulls": np.packbits(nulls).tobytes(), "levels": index.to_bytes(), "fingerprints": fingerprint(hashes)[place].tobytes(),
                "offsets": (np.cumsum(lengths) - lengths)[place].tobytes(), "lengths": lengths[place].tobytes(), "payload": b"".join(ids),
            }
            before, number = before + row["n_ids"], number + 1
            kinds = {"part": pa.int32(), "shard": pa.int32(), "n_docs": pa.int32(), "width": pa.int32(), "first_key": pa.int64(), "last_key": pa.int64(), "n_ids": pa.int64(), "ids_before": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

        for batch in batches:
            for piece in slices(batch, "text"):
                for key, data in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1))):
                    keys.append(key)
                    ids.append(data + end)
                    held += len(ids[-1]) // width
                    if held >= most:
                        yield shard()
                        keys, ids, held = [], [], 0
        if keys:
            yield shard()

    return run


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write the store to ``path``, a folder that driver and executors share."""
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    docs = docs.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    docs.select("key", "text").mapInArrow(_shards(tokenizer, end_id, shard_ids), _SCHEMA).write.option("compression", "zstd").parquet(path)


class Shard:
    """One row of a store."""

    def __init__(self, row: dict):
        self.index = PerfectHash.from_bytes(row["levels"])
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint32)
        self.offsets, self.lengths = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(self.keys)).astype(bool)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key hash, or -1."""
        slots = self.index.slots(hashes)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == fingerprint(hashes[known])
        return np.where(known, slots, -1)

    def get(self, slot: int) -> np.ndarray:
        at = self.offsets[slot]
        return self.ids[at : at + self.lengths[slot]]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens, ids_crc32 of every document, each fetched through the index."""
    store = spark.read.schema(_SCHEMA).parquet(path)
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range of keys
    starts = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                s = Shard(row)
                slots = s.find(key_hashes(s.keys, s.nulls, occurrences(s.keys, s.nulls)))
                if (slots < 0).any():
                    raise ValueError(f"shard {row['part']}/{row['shard']} misses keys of its own")
                n = len(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.keys, mask=s.nulls), pa.array([row["part"]] * n, pa.int32()), pa.array(s.offsets[slots] + row["ids_before"]), pa.array(s.lengths[slots]), pa.array([crc32(s.get(k)) for k in slots.tolist()], pa.int64())],
                    names=["key", "part", "start", "n_tokens", "ids_crc32"],
                )

    each = store.mapInArrow(run, "key long, part int, start long, n_tokens long, ids_crc32 long")
    return each.join(starts, "part").select(F.col("key").alias(key), (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """key, ids: a row for each document of the given keys, those of equal keys included; only shards whose key range may hold one are read."""
    store = spark.read.schema(_SCHEMA).parquet(path)
    wanted = np.array(sorted(set(keys)), np.int64)
    if not len(wanted):
        return spark.createDataFrame([], "key long, ids array<long>")
    near = store.filter((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0])))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s, left, n = Shard(row), wanted, 0
                while len(left):  # the n-th row of each key
                    slots = s.find(key_hashes(left, np.zeros(len(left), bool), np.full(len(left), n)))
                    hit = np.flatnonzero(slots >= 0)
                    left, n = left[hit], n + 1
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array([s.get(k).tolist() for k in slots[hit].tolist()], pa.list_(pa.int64()))], names=["key", "ids"])

    return near.mapInArrow(run, "key long, ids array<long>")
