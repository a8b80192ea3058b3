"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by the vocabulary's pattern.  Within one, symbols form a doubly linked list
and a priority queue holds (merge rank, position) of adjacent pairs; entries whose symbols have changed
since they were pushed are stale and skipped.  Decoding concatenates the vocabulary's byte strings.  The
vocabulary is read once by the driver from a given path and broadcast (it doesn't grow with the data).

Edge cases: null text is empty and gives no ids; added tokens in a text (``<|endoftext|>``) are one id
each; a very long pre-token costs n log n; repeated rows are each encoded; an empty table gives an empty
result; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RESULT, map_texts

# Fixed value: the pre-token pattern of this vocabulary, with white space as Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens whose ids a worker remembers before it starts anew.
CACHE = 300_000


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.of_byte = [model["vocab"].get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbol: list[int] = [self.of_byte[b] for b in word]
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        find = self.merges.get
        queue = []
        for i in range(n - 1):
            if m := find((symbol[i], symbol[i + 1])):
                queue.append((m[0], i, symbol[i], symbol[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := find((new, symbol[k])):
                    heapq.heappush(queue, (m[0], i, new, symbol[k], m[1]))
            h = before[i]
            if h >= 0 and (m := find((symbol[h], new))):
                heapq.heappush(queue, (m[0], h, symbol[h], new, m[1]))
        return [s for s in symbol if s >= 0]


class Codec:
    """A worker's encoder: a vocabulary and a bounded memory of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True)) + ")").split if vocabulary.added else None
        outer = self

        class Memory(dict):
            def __missing__(self, piece: str) -> list[int]:
                if len(self) >= CACHE:
                    self.clear()
                ids = self[piece] = outer.v.merge(piece.encode())
                return ids

        self.memory = Memory()

    def encode(self, text: str) -> list[int]:
        memory = self.memory
        if self.split is not None and any(t in text for t in self.v.added):
            out: list[int] = []
            for i, part in enumerate(self.split(text)):
                out += [self.v.added[part]] if i % 2 else chain.from_iterable([memory[p] for p in self.find(part)])
            return out
        return list(chain.from_iterable([memory[p] for p in self.find(text)]))

    def count(self, text: str) -> int:
        """The number of ids."""
        if self.split is not None and any(t in text for t in self.v.added):
            return len(self.encode(text))
        return sum(map(len, map(self.memory.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8."""
        raw = b"".join(map(self.v.bytes.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


FIELDS = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string, ids: array<int>"


def annotate(docs: DataFrame, path: str, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The kept columns and a struct RESULT of FIELDS (ids null without with_ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def make():
        codec = Codec(shared.value)
        names = [str(i) for i in range(len(codec.v.bytes))]

        def work(data, off):
            raw = data.tobytes()
            n, ids_hash, text_hash, all_ids = [], [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                ids = codec.encode(raw[a:b].decode())
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                all_ids.append(np.array(ids, np.int32) if with_ids else None)
            return [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(all_ids, pa.list_(pa.int32()))]

        return work

    return map_texts(docs, FIELDS, make, keep)


def numbers(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The kept columns and a struct RESULT with n_tokens alone: texts are encoded, but no list of ids is made."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def make():
        codec = Codec(shared.value)

        def work(data, off):
            raw = data.tobytes()
            return [pa.array([codec.count(raw[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.int64())]

        return work

    return map_texts(docs, "n_tokens: bigint", make, keep)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of each row's array of ids (null: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    @F.pandas_udf("string")
    def decode(column):
        codec = Codec(shared.value)
        return column.map(lambda x: None if x is None else codec.decode([int(i) for i in x]).decode())

    return encoded.withColumn("decoded", decode(F.col(ids)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return annotate(d, path or default_path(), with_ids=False).select("doc_id", *[f"{RESULT}.{c}" for c in ("n_tokens", "ids_sha256", "decoded_sha256")])
