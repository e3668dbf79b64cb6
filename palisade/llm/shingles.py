"""Sets of hashed word shingles, by arrays over many texts at once."""

from __future__ import annotations

import numpy as np

LONGEST = 15  # words in a shingle at most
PIECE = 1 << 22  # bytes hashed at a time
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, LONGEST + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z only, and turns the six white-space characters into spaces.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all (64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of each word."""
    inside = folded != 32
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(starts):
        return np.empty(0, np.uint64), starts
    ends = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    power = np.cumprod(np.full(lengths.max(), _BASE, dtype=np.uint64))
    return mixed(np.add.reduceat(_BYTE[folded[inside]] * power[at], begins)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same for any length of data, in pieces that end at white space."""
    folded = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    hashes, places, at = [], [], 0
    while at < len(folded):
        end = min(at + PIECE, len(folded))
        while end < len(folded) and folded[end] != 32:
            more = np.flatnonzero(folded[end : end + PIECE] == 32)
            end = end + int(more[0]) if len(more) else min(end + PIECE, len(folded))
        h, p = _words(folded[at:end])
        hashes.append(h)
        places.append(p + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer than `size` words the whole sequence is the shingle."""
    raw = [t.encode() for t in texts]
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    h, places = word_hashes(b" ".join(raw))
    bounds = np.searchsorted(places, np.r_[0, np.cumsum(lengths)])
    parts = [h[i : len(h) - (size - 1 - i)] * _MIX[i] if len(h) >= size else h[:0] for i in range(size)]
    joined = mixed(sum(parts[1:], parts[0]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(joined[a : b - size + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(mixed((h[a:b] * _MIX[: b - a]).sum(keepdims=True) + np.array([b - a], dtype=np.uint64) * _MIX[LONGEST]))
        else:
            out.append(h[:0])
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of the set, as two signed integers."""
    size = np.array([len(s)], dtype=np.uint64)
    halves = [mixed(mixed(s + _MIX[k]).sum(keepdims=True, dtype=np.uint64) + size * _MIX[k + 1]) for k in (LONGEST, LONGEST - 2)]
    return int(halves[0][0].astype(np.int64)), int(halves[1][0].astype(np.int64))
