"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary is resolved by a minimal perfect hash (hash and displace: one digest, one
displacement, one comparison). Any other pre-token is merged with a heap over linked bytes. Pre-tokens repeat, so each
worker keeps the results of the last ones in two generations of bounded dictionaries.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows, null keys
and other columns pass through unchanged, but for one named coded, which is replaced; no ties arise; an empty table gives
an empty table. A very long text is one value of a task, as are its ids and its decoded bytes.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import slices, text_or_empty

#: Pre-tokens in each of the two generations that a worker remembers, and the longest that it does, in characters.
REMEMBERED, LONGEST = 1 << 18, 64
_MASK, _SPREAD, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class PerfectHash:
    """Minimal perfect hash of byte strings to 0..n-1. A string that isn't a key gets some slot, so callers compare."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        self.displacements = [0] * self.buckets
        grouped: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            digest = xxhash.xxh3_64_intdigest(key)
            grouped[digest % self.buckets].append(digest)
        taken, free = bytearray(self.n), self.n - 1
        for b in sorted(range(self.buckets), key=lambda b: -len(grouped[b])):
            digests = grouped[b]
            if len(digests) > 1:
                d = 0
                while True:
                    slots = {self._slot(x, d) for x in digests}
                    if len(slots) == len(digests) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.displacements[b] = d
                for s in slots:
                    taken[s] = 1
            elif digests:  # alone in its bucket: it gets any free slot by name
                while taken[free]:
                    free -= 1
                taken[free] = 1
                self.displacements[b] = -free - 1

    def _slot(self, digest: int, d: int) -> int:
        return (((digest >> 17) ^ (d * _SPREAD)) * _MIX & _MASK) * self.n >> 64

    def __getitem__(self, key: bytes) -> int:
        digest = xxhash.xxh3_64_intdigest(key)
        d = self.displacements[digest % self.buckets]
        return -d - 1 if d < 0 else self._slot(digest, d)


class Remembered(dict):
    """Packed ids by pre-token. When a generation is full it becomes the older one, which is dropped at the next turn."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, token: str) -> bytes:
        found = self.older.get(token)
        if found is None:
            found = self.find(token)
        if len(token) > LONGEST:
            return found
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[token] = found
        return found


class Codec:
    """Encoder and decoder over a rank file (base64 token and rank on each line) and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.hash = PerfectHash(list(self.ranks))
        self.keys: list[bytes] = [b""] * len(self.ranks)
        self.ids = [0] * len(self.ranks)
        for key, rank in self.ranks.items():
            slot = self.hash[key]
            self.keys[slot], self.ids[slot] = key, rank
        self.tokens = {rank: key for key, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.remembered = Remembered(self._packed)

    def _packed(self, token: str) -> bytes:
        piece = token.encode()
        slot = self.hash[piece]
        if self.keys[slot] == piece:
            return struct.pack("<I", self.ids[slot])
        ids = self.merged(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        n, rank = len(piece), self.ranks.get
        ends, following, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = following[i]
            if ends[i] == 0 or j >= n or ends[j] != end:  # one of the two has been merged meanwhile
                continue
            after = following[j]
            ends[i], ends[j], following[i] = end, 0, after
            if after < n:
                before[after] = i
                if (r := rank(piece[i : ends[after]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after]))
            p = before[i]
            if p >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : ends[i]]])
            i = following[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.remembered.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of `text` as binary, little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            yield texts.map(codec(path, pattern).encode)

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for packed in slices(batches):
            yield packed.map(codec(path, pattern).decode)

    return decode(ids)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`df` with `coded`: ids (binary, little-endian unsigned 32-bit), n_tokens and the bytes decoded from the ids."""

    @F.pandas_udf("ids binary, n_tokens long, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for texts in slices(batches):
            ids = texts.map(c.encode)
            yield pd.DataFrame({"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": ids.map(c.decode)})

    return df.withColumn("coded", both(text_or_empty(text)))
