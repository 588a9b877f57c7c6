"""BPE encoding and decoding by a contiguous rank array.

A short word is held as two lists: the ids of its parts, which are the part boundaries, and the merge rank of each
adjacent pair. The lowest rank is looked for again and again, its boundary deleted and the two neighbouring ranks
refreshed. Words beyond ``SHORT`` bytes take a heap of (rank, position) instead, which merges in the same order without
the quadratic scan. Words repeat, so each Python task remembers the results of the
last ``REMEMBERED`` to twice as many of them.

Null text counts as empty: no ids, empty decoded text. Repeated rows each give their own row; other columns are dropped.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cache

import regex
from pyspark.sql import DataFrame

from .common import map_text, sha256

SHORT = 96
REMEMBERED = 220_000
#: Unicode white space.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces that no token crosses: letters up to white space or ASCII marks but the apostrophe, else all up to white space.
_CHUNK = re.compile(f" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+(?=[{_WS}!-&(-/:-@[-`{{-~]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Fixed pattern of byte-level vocabularies.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Vocabulary:
    """Ids, merge ranks and bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        letters, vocab = byte_letters(), stored["model"]["vocab"]
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.data = {i: bytes(map(letters.__getitem__, token)) for token, i in vocab.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in stored["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = len(self.merged)
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.data |= {i: token.encode() for token, i in self.special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        parts = [self.of_byte[b] for b in word]
        if len(parts) > SHORT:
            return self.merge_long(parts)
        get, merged, none = self.ranks.get, self.merged, len(self.merged)
        adjacent = [get(pair, none) for pair in zip(parts, parts[1:])]
        while adjacent:
            lowest = min(adjacent)
            if lowest == none:
                break
            i = adjacent.index(lowest)
            parts[i] = merged[lowest]
            del parts[i + 1], adjacent[i]
            if i:
                adjacent[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(adjacent):
                adjacent[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        get, merged = self.ranks.get, self.merged
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j == len(parts) or get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j], after[i] = merged[rank], -1, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (r := get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [p for p in parts if p >= 0]

    def encode(self, chunk: str) -> list[int]:
        ids = []
        for piece in _PIECE.findall(chunk):
            ids += self.merge(piece.encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.data[i] for i in ids])


class Memory(dict):
    """By chunk its ids in decimal, joined by commas, and the bytes that these ids decode to."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, tuple[str, bytes]] = {}

    def __missing__(self, chunk: str) -> tuple[str, bytes]:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(chunk)
        if found is None:
            ids = [i] if (i := self.vocabulary.special.get(chunk)) is not None else self.vocabulary.encode(chunk)
            found = ",".join(map(str, ids)), self.vocabulary.decode(ids)
        if len(chunk) <= SHORT:
            self[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        v = self.vocabulary
        if v.special_at is None or not v.special_at.search(text):
            return _CHUNK.findall(text)
        return [c for part in v.special_at.split(text) for c in ([part] if part in v.special else _CHUNK.findall(part))]

    def __call__(self, text: str) -> tuple[str, bytes]:
        found = [self[c] for c in self.chunks(text)]
        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])


@cache
def memory(path: str) -> Memory:
    """One for each Python worker and file."""
    return Memory(Vocabulary(path))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids array<int>."""

    def rows(part):
        of = memory(path)
        return {key: part[key], "ids": [[int(i) for i in of(t)[0].split(",")] if t else [] for t in part[text]]}

    return map_text(df, [key, text], f"{key} long, ids array<int>", rows, text)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, text string; bytes that are no UTF-8 become U+FFFD, as the tokenizers library has it."""

    def run(batches):
        import pyarrow as pa

        vocabulary = memory(path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(x or []).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 and decoded_sha256, in one pass."""

    def rows(part):
        of, out = memory(path), {key: part[key], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in part[text]:
            ids, data = of(t or "")
            out["n_tokens"].append(ids.count(",") + bool(ids))
            out["ids_sha256"].append(sha256(ids.encode()))
            out["decoded_sha256"].append(sha256(data.decode("utf-8", "replace").encode()))
        return out

    return map_text(df, [key, text], f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, text)
