"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens
themselves. Any other pre-token is merged by a heap over its linked bytes.
Each Python worker keeps the ids of up to ``MEMO`` recent pre-tokens.

Defined cases: a null text counts as empty; an empty text has no ids, and their
digest is that of no bytes. Invalid UTF-8 is replaced before splitting. Equal
texts give equal ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm.arrowtext import text_column
from storyflow.shared import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers; it starts afresh beyond that.
MEMO = 300_000
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64


class PerfectHash:
    """Each key's own slot among ``len(keys)``: hash, then displace its bucket.

    A bucket's displacement is the first that sends all its keys to free slots;
    buckets of one key, placed last, name a free slot directly (below zero).
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.slots = [-1] * self.n
        self.shift = [0] * self.buckets
        free = set(range(self.n))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if len(groups[b]) < 2:
                break
            d = 0
            while True:
                at = {self._place(hashes[i], d) for i in groups[b]}
                if len(at) == len(groups[b]) and at <= free:
                    break
                d += 1
            self.shift[b] = d
            for i in groups[b]:
                self.slots[self._place(hashes[i], d)] = i
            free -= at
        for b, group in enumerate(groups):
            if len(group) == 1:
                self.shift[b] = -1 - (slot := free.pop())
                self.slots[slot] = group[0]

    def _place(self, h: int, d: int) -> int:
        return (((h ^ d * 0x9E3779B97F4A7C15) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def slot(self, key: bytes) -> int:
        """The only key that ``key`` can be, by its place in ``keys``; below zero if there are none."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slots[-1 - d if d < 0 else self._place(h, d)]


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.keys = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.keys)
        self.bytes_of = {i: k for k, i in ranks.items()}

    def id(self, token: bytes) -> int | None:
        at = self.hash.slot(token)
        return self.ids[at] if at >= 0 and self.keys[at] == token else None

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))})


def merge(word: bytes, rank_of: "callable") -> list[int]:
    """Ids of ``word``: the pair of lowest rank merges first, the left one on ties."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := rank_of(word[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := rank_of(word[h:end])) is not None:
            heappush(heap, (r, h, end))
    ids, i = [], 0
    while i < n:
        ids.append(rank_of(word[i : after[i]]))
        i = after[i]
    return ids


class Memo(dict):
    """Ids by pre-token, found on first use."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ranks = dict(zip(vocabulary.keys, vocabulary.ids))

    def __missing__(self, token: str) -> tuple[int, ...]:
        word = token.encode()
        whole = self.vocabulary.id(word)
        ids = (whole,) if whole is not None else tuple(merge(word, self.ranks.get))
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[token] = ids
        return ids


class Tokenizer:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.memo, self.split = Memo(vocabulary), regex.compile(pattern).findall
        top = max(vocabulary.ids, default=-1) + 1
        self.bytes_of = [vocabulary.bytes_of.get(i, b"") for i in range(top)]
        self.names = [b"%d" % i for i in range(top)]

    def encode(self, text: bytes) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text.decode("utf-8", "replace")))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_own: dict[tuple[str, str], Tokenizer] = {}


def _tokenizer(held) -> Tokenizer:
    """This worker's tokenizer for a broadcast (vocabulary, pattern, digest of the vocabulary's file)."""
    vocabulary, pattern, digest = held.value
    if (digest, pattern) not in _own:
        _own.clear()
        _own[digest, pattern] = Tokenizer(vocabulary, pattern)
    return _own[digest, pattern]


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    path = path or public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    return spark.sparkContext.broadcast((Vocabulary.load(path), pattern or public_tokenizers.PATTERN, digest))


def encoder(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> "callable":
    """Column function: text to array of ids. The vocabulary file is read on the driver."""
    held = _shared(spark, path, pattern)

    def encoded(texts: list[bytes | None]) -> pa.Array:
        return pa.array([_tokenizer(held).encode(t or b"") for t in texts], pa.list_(pa.int32()))

    return text_column(encoded, "array<int>")


def digests(spark: SparkSession, path: str | None = None, pattern: str | None = None, ids: bool = False) -> "callable":
    """Column function: text to struct<n_tokens, ids_sha256, decoded_sha256>, with the ids too if wanted."""
    held = _shared(spark, path, pattern)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids

    def digested(texts: list[bytes | None]) -> pa.Array:
        own, rows = _tokenizer(held), []
        for text in texts:
            found = own.encode(text or b"")
            row = (len(found), hashlib.sha256(b" ".join(map(own.names.__getitem__, found))).hexdigest(), hashlib.sha256(own.decode(found)).hexdigest())
            rows.append((*row, array("i", found)) if ids else row)
        columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds[:3])]
        if ids:
            ends = np.cumsum([0, *map(len, columns[3])], dtype=np.int64).astype(np.int32)
            flat = np.concatenate([np.frombuffer(c, np.int32) for c in columns[3]] or [np.zeros(0, np.int32)])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.StructArray.from_arrays(arrays, names=names)

    return text_column(digested, f"struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string{',ids:array<int>' * ids}>")


def decoder(spark: SparkSession, path: str | None = None) -> "callable":
    """Column function: array of ids to bytes; null stays null, an unknown id is an error."""
    held = _shared(spark, path, None)

    def decode(ids):
        own = _tokenizer(held)
        for batch in ids:
            yield pa.array([None if x is None else own.decode(x) for x in batch.to_pylist()], pa.binary())

    from collections.abc import Iterator

    decode.__annotations__ = {"ids": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "binary")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(spark)(F.col("text")).alias("r")).select("doc_id", "r.*")
