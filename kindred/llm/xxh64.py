"""XXH64 over many byte ranges at once."""

from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _loads(data: np.ndarray, kind: str) -> np.ndarray:
    """Little-endian words at every byte offset; the end is padded."""
    width = np.dtype(kind).itemsize
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    return np.ndarray((len(data) + 1,), kind, padded, 0, (1,))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start : start + size] for each range."""
    u64, u32 = _loads(data, "<u8"), _loads(data, "<u4")
    s = np.uint64(seed)
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        out[:] = s + P5
        one = np.flatnonzero((size >= 32) & (size < 64))
        if len(one):
            at = start[one]
            v = [_round(np.full(len(one), seed0), u64[at + 8 * k]) for k, seed0 in enumerate((s + P1 + P2, s + P2, s, s - P1))]
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros(len(one), np.uint64), x)) * P1 + P4
            out[one] = h
        out += size.astype(np.uint64)
        at = start + np.where(size >= 32, 32, 0)
        left = np.where(size >= 32, size - 32, size)
        while len(w := np.flatnonzero((left >= 8) & (size < 64))):
            out[w] = _rotl(out[w] ^ _round(np.zeros(len(w), np.uint64), u64[at[w]]), 27) * P1 + P4
            at[w] += 8
            left[w] -= 8
        w = np.flatnonzero((left >= 4) & (size < 64))
        out[w] = _rotl(out[w] ^ u32[at[w]].astype(np.uint64) * P1, 23) * P2 + P3
        at[w] += 4
        left[w] -= 4
        while len(w := np.flatnonzero((left > 0) & (size < 64))):
            out[w] = _rotl(out[w] ^ data[at[w]].astype(np.uint64) * P5, 11) * P1
            at[w] += 1
            left[w] -= 1
        out = (out ^ out >> np.uint64(33)) * P2
        out = (out ^ out >> np.uint64(29)) * P3
        out ^= out >> np.uint64(32)
    long = np.flatnonzero(size >= 64)
    if len(long):
        body = data.tobytes()
        for k in long.tolist():
            a = int(start[k])
            out[k] = xxhash.xxh64_intdigest(body[a : a + int(size[k])], seed=seed)
    return out
