"""Operator 2: token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; those not seen before by the worker are laid out as one ragged numpy array
(symbol ids plus the sequence each belongs to). Every round takes each sequence's lowest-rank adjacent pair and
merges all its occurrences in all sequences at once; a sequence without a mergeable pair is finished and its
surviving symbols are counted. Counts of short pre-tokens are remembered, in a bounded cache.

Null text counts as empty (0 tokens); strings of the vocabulary's special tokens inside a text count as one token
each, as the library does by default. No row is dropped; equal texts get equal counts; an empty table gives an empty
result. Other columns are kept, but for one named like the result (letter case aside), which the result replaces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import masked, unmasked

#: Pre-tokens a worker remembers before it starts afresh, the longest of those that it keeps, and symbols merged in one ragged array.
CACHE, KEPT, SYMBOLS = 600_000, 64, 1 << 19
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """Merge rules of a byte-level BPE vocabulary, as sorted arrays."""

    def __init__(self, spec: bytes, pattern: str):
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK).astype(np.int32)

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each of the (non-empty) tokens."""
        sizes = np.array([len(t) for t in tokens])
        counts = np.zeros(len(tokens), dtype=np.int64)
        symbol = self.first[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        rank = np.full(len(symbol), NO_RANK, dtype=np.int32)  # of each symbol with its right neighbour
        inside = owner[:-1] == owner[1:]
        rank[:-1][inside] = self.ranks(symbol[:-1][inside], symbol[1:][inside])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbol)])
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_RANK
            if over.any():
                counts[owner[starts[over]]] = lengths[over]
                keep = np.repeat(~over, lengths)
                symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
                best, lengths = best[~over], lengths[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            # In a run of overlapping pairs (aaa) every other one merges, from the left.
            run = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1)])
            within = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[within % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            new_at = np.cumsum(keep)[hit] - 1
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            near = np.unique(np.r_[new_at, new_at[new_at > 0] - 1])
            rank[near] = NO_RANK
            near = near[near + 1 < len(symbol)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.ranks(symbol[near], symbol[near + 1])
        return counts

    def learn(self, tokens: set[str]) -> None:
        todo, size = [], 0
        for t in tokens:
            todo.append(t)
            size += len(t)
            if size > SYMBOLS:
                self._learn(todo)
                todo, size = [], 0
        if todo:
            self._learn(todo)

    def _learn(self, todo: list[str]) -> None:
        self.cache.update(zip(todo, self.merge([t.encode() for t in todo]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            split.append((len(parts) - 1, [t for p in parts for t in self.pieces(p)]))
        if len(self.cache) > CACHE:
            self.cache.clear()
        unseen: set[str] = set()
        for _, tokens in split:
            unseen.update(t for t in tokens if t not in self.cache)
        self.learn(unseen)
        of = self.cache.__getitem__
        out = [n + sum(map(of, tokens)) for n, tokens in split]
        for t in unseen:
            if len(t) > KEPT:
                del self.cache[t]
        return out


@lru_cache(maxsize=2)
def merger(spec: bytes, pattern: str) -> Merger:
    """The merger of a worker process, with what it remembers: it serves the tasks that the worker runs one by one."""
    return Merger(spec, pattern)


def slices(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of about so many characters, so that what is derived from them stays small."""
    out, size = [], 0
    for x in texts:
        t = x.as_py() or ""
        out.append(t)
        size += len(t)
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def add_token_counts(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each text, by the byte-level BPE vocabulary file and splitting pattern.

    The file (bounded: a vocabulary) is read by the driver and broadcast, so executors need no path to it.
    """
    with open(vocabulary, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = merger(spec.value, pattern)
        for batch in batches:
            yield pa.array([n for part in slices(batch) for n in own.count(part)], pa.int64())

    inner, of = masked(df)
    return unmasked(inner.withColumn(name, counted(F.coalesce(F.col(of[text]), F.lit("")))), of, name)
