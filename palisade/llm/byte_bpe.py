"""Operator 3: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Each mergeable neighbour pair stands in the bucket of its rank; a
three-level bitmap over the ranks gives the lowest non-empty bucket by find-first-set. A position whose pair has
changed since it was queued is stale and skipped. All unseen pre-tokens of a slice of texts share one queue. Work
is proportional to the number of merges tried, however long a pre-token is.

Null text counts as empty: no ids, and nothing decoded. Strings of special tokens are ordinary text. Unknown ids
fail the decoding. No row is dropped; equal texts get equal ids; an empty table gives an empty result. Other columns are
kept, but for those named like the result (letter case aside), which the result replaces.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import masked, unmasked
from palisade.llm.token_counts import slices

#: Pre-tokens a worker remembers before it starts afresh, and the longest of those that it keeps.
CACHE, KEPT = 600_000, 64


class RankQueue:
    """Positions in buckets by rank; 64 x 64 x 64 ranks and more are told apart by three levels of bits."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def open(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none; further positions are appended to it."""
        self.buckets[rank] = positions
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[group] = self.middle.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def first(self) -> int:
        """The lowest rank with a bucket, or -1."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The positions in the bucket of the rank, which is empty from then on."""
        positions = self.buckets.pop(rank)
        word, group = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[group] &= ~(1 << (word & 63))
            if not self.middle[group]:
                self.top &= ~(1 << group)
        return positions


class Codec:
    """Encoder and decoder for the ranks of one vocabulary file (base64 token, space, rank on each line)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, r in self.rank.items():
            tokens[r] = token
        self.longest = max(map(len, tokens))
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.pair_ranks = np.full(1 << 16, -1, dtype=np.int64)  # of two bytes
        for token, r in self.rank.items():
            if len(token) == 2:
                self.pair_ranks[token[0] << 8 | token[1]] = r
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each (non-empty) piece as int32 bytes; all pieces share one queue, no pair spans two of them."""
        data, rank, longest = b"".join(pieces), self.rank.get, self.longest
        n = len(data)
        if not n:
            return []
        starts = [0, *accumulate(map(len, pieces))]
        head = bytearray(n + 1)  # where a piece starts, and the end
        for i in starts:
            head[i] = 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        first_byte = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        ranks = np.full(n + 1, -1, dtype=np.int64)
        ranks[: n - 1] = self.pair_ranks[first_byte[:-1] << 8 | first_byte[1:]]
        ranks[np.array(starts[1:]) - 1] = -1
        pair_rank = ranks.tolist()  # of the part that starts here with the part after it; -1: none
        queue = RankQueue()
        queued = np.flatnonzero(ranks >= 0)
        queued = queued[np.argsort(ranks[queued], kind="stable")]
        edges = np.flatnonzero(np.diff(ranks[queued], prepend=-1, append=-1)).tolist()
        for low, high in pairwise(edges):
            positions = queued[low:high].tolist()
            queue.open(pair_rank[positions[0]], positions)
        bucket_of = queue.buckets.get
        while (r := queue.first()) >= 0:
            bucket = sorted(queue.take(r))
            for done, i in enumerate(bucket, 1):
                if pair_rank[i] != r:  # stale
                    continue
                j = after[i]
                k = after[i] = after[j]
                before[k] = i
                pair_rank[i] = pair_rank[j] = -1
                lower = False
                if not head[k]:
                    end = after[k]
                    new = rank(data[i:end]) if end <= i + longest else None
                    if new is not None:
                        pair_rank[i] = new
                        if (b := bucket_of(new)) is None:
                            queue.open(new, [i])
                        else:
                            b.append(i)
                        lower = new < r
                if not head[i]:
                    p = before[i]
                    new = rank(data[p:k]) if k <= p + longest else None
                    if new is None:
                        pair_rank[p] = -1
                    elif new != pair_rank[p]:
                        pair_rank[p] = new
                        if (b := bucket_of(new)) is None:
                            queue.open(new, [p])
                        else:
                            b.append(p)
                        lower = lower or new < r
                if lower:  # not in vocabularies whose longer tokens all rank behind their parts
                    if rest := bucket[done:] + queue.buckets.get(r, []):
                        queue.open(r, rest)
                    break
        out = []
        for i, end in pairwise(starts):
            ids = array("i")
            while i < end:
                k = after[i]
                ids.append(rank(data[i:k]))
                i = k
            out.append(ids.tobytes())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        distinct = set().union(*split)
        if len(self.cache) > CACHE:  # starts afresh with those in use
            self.cache = {p: self.cache[p] for p in distinct if p in self.cache}
        known = self.cache
        unseen = list(distinct.difference(known))
        raw = [p.encode() for p in unseen]
        whole = [self.rank.get(b) for b in raw]  # a piece that is a token stays whole
        merged = iter(self.encode_pieces([b for b, r in zip(raw, whole, strict=True) if r is None]))
        known.update((p, next(merged) if r is None else array("i", [r]).tobytes()) for p, r in zip(unseen, whole, strict=True))
        of = known.__getitem__
        out = [np.frombuffer(b"".join(map(of, pieces)), dtype=np.int32) for pieces in split]
        for p in unseen:
            if len(p) > KEPT:
                del known[p]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.begins[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of a worker process, with what it remembers: it serves the tasks that the worker runs one by one."""
    return Codec(rank_file, pattern)


def _codec_source(spark: SparkSession, rank_path: str):
    """The rank file (bounded: a vocabulary), read by the driver and broadcast."""
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.array([], np.int32)))


def encoder(spark: SparkSession, rank_path: str, pattern: str):
    """A function from a text column to its ids (array of int)."""
    source = _codec_source(spark, rank_path)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(source.value, pattern)
        for batch in batches:
            yield _lists([ids for part in slices(batch) for ids in own.encode(part)])

    return lambda col: encoded(F.coalesce(col, F.lit("")))


def decoder(spark: SparkSession, rank_path: str, pattern: str):
    """A function from an id column to the bytes that the ids stand for."""
    source = _codec_source(spark, rank_path)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(source.value, pattern)
        for batch in batches:
            yield pa.array([own.decode(np.array(x.as_py() or [], dtype=np.int32)) for x in batch], pa.binary())

    return decoded


def round_trip(spark: SparkSession, rank_path: str, pattern: str):
    """A function from a text column to struct(ids, decoded): the encoding, and what its decoding gives."""
    source = _codec_source(spark, rank_path)

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(source.value, pattern)
        for batch in batches:
            ids = [ids for part in slices(batch) for ids in own.encode(part)]
            yield pa.StructArray.from_arrays([_lists(ids), pa.array([own.decode(x) for x in ids], pa.binary())], ["ids", "decoded"])

    return lambda col: both(F.coalesce(col, F.lit("")))


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def add_ids(df: DataFrame, rank_path: str, pattern: str, text: str = "text", name: str = "token_ids") -> DataFrame:
    """df with the ids of each text."""
    inner, of = masked(df)
    return unmasked(inner.withColumn(name, encoder(df.sparkSession, rank_path, pattern)(F.col(of[text]))), of, name)


def add_checked_ids(df: DataFrame, rank_path: str, pattern: str, text: str = "text", name: str = "token_ids") -> DataFrame:
    """The same, with every text decoded again; a text that doesn't come back fails the job."""
    inner, of = masked(df)
    whole = F.coalesce(F.col(of[text]), F.lit(""))
    out = inner.withColumn("trip", round_trip(df.sparkSession, rank_path, pattern)(F.col(of[text])))
    same = F.col("trip.decoded") == whole.cast("binary")
    return unmasked(out.withColumn(name, F.when(same, F.col("trip.ids")).otherwise(F.raise_error(F.lit("a text differs from its decoded ids")))), of, name)
