"""Byte-level BPE encoding of a corpus with a public vocabulary.

A pre-token is merged with a rank queue: one bucket per merge rank holds the list positions at which that merge applies,
and a three-level bitmap over the ranks finds the least non-empty bucket by find-first-set. Symbols form a linked list;
an entry whose symbols were merged away or changed since is stale and skipped. Each merge adds at most two entries, so a
pre-token of n bytes takes O(n log n) however long it is. Pre-tokens repeat, so each worker remembers their ids.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies unless the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids after which a piece of a batch goes out.
PIECE_IDS = 8_000_000
REMEMBERED = 400_000


class RankQueue:
    """Positions by rank; pop() gives the leftmost position of the least rank."""

    def __init__(self, ranks: int):
        w0 = (ranks + 63) // 64
        w1 = (w0 + 63) // 64
        self.low, self.mid, self.top = [0] * w0, [0] * w1, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        w = rank >> 6
        if not self.low[w]:
            m = w >> 6
            if not self.mid[m]:
                self.top |= 1 << m
            self.mid[m] |= 1 << (w & 63)
        self.low[w] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        x = self.mid[m]
        w = (m << 6) | ((x & -x).bit_length() - 1)
        x = self.low[w]
        rank = (w << 6) | ((x & -x).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[w] &= ~(1 << (rank & 63))
            if not self.low[w]:
                self.mid[m] &= ~(1 << (w & 63))
                if not self.mid[m]:
                    self.top &= ~(1 << m)
        return rank, position


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.split = regex.compile(pattern).findall
        self.most = max(self.ranks.values()) + 1
        self.pair: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, a: int, b: int) -> int:
        """The id of a and b joined, or -1."""
        got = self.pair.get((a, b))
        if got is None:
            got = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            self.pair[a, b] = got
        return got

    def merge(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        symbol = [self.single[x] for x in data]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue(self.most)
        merged = self.merged
        for i in range(n - 1):
            r = merged(symbol[i], symbol[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, i = got
            j = after[i]
            if symbol[i] < 0 or j >= n or merged(symbol[i], symbol[j]) != rank:
                continue
            symbol[i], symbol[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = merged(rank, symbol[k])
                if r >= 0:
                    queue.push(r, i)
            h = before[i]
            if h >= 0:
                r = merged(symbol[h], rank)
                if r >= 0:
                    queue.push(r, h)
        return [s for s in symbol if s >= 0]

    def encode_into(self, text: str, out: array) -> None:
        known = self.known
        for t in self.split(text):
            ids = known.get(t)
            if ids is None:
                ids = tuple(self.merge(t.encode()))
                if len(t) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[t] = ids
            out.extend(ids)

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(vocabulary.value)

        def out(b: pa.RecordBatch, first: int, flat: array, ends: list[int]) -> pa.RecordBatch:
            values = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(values))
            return pa.RecordBatch.from_arrays([b.column("key").slice(first, len(ends)), ids], names=["key", "ids"])

        for b in batches:
            first, flat, ends = 0, array("i"), []
            for k, text in enumerate(b.column("text")):
                text = text.as_py()
                if text:
                    e.encode_into(text, flat)
                ends.append(len(flat))
                # a batch of very long texts goes out in pieces, as list offsets have 32 bits
                if len(flat) >= PIECE_IDS:
                    yield out(b, first, flat, ends)
                    first, flat, ends = k + 1, array("i"), []
            if ends:
                yield out(b, first, flat, ends)

    return run


def encoded(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens. Null and empty texts give an empty list.

    Blank texts are encoded as they are; the strings of special tokens are ordinary text; texts are taken whole. An empty
    table gives an empty result; no shuffle takes place.
    """
    with open(vocabulary, "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(rows.dtypes)[key]
    r = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return r.mapInArrow(_encode(data), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
