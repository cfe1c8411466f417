"""Vectorised text kernels over Arrow string arrays: words, word hashes, window hashes, minimisers, packed columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+`` on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Text bytes that one kernel call handles (longer documents are handled alone).
CHUNK = 2 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=np.uint64)


class _Powers:
    """Growing tables of powers of one base and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, int(n).bit_length())
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        return self.up[:n], self.down[:n]

    def __reduce__(self):
        return _Powers, (int(self.base),)


_BYTES = _Powers(0x9E3779B97F4A7C15)
_WORDS_A = _Powers(0xD6E8FEB86659FD93)
_WORDS_B = _Powers(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string or binary array; nulls are empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    width = np.int64 if large else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], dtype=width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = array.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that a piece has about ``most`` bytes of ``column``."""
    for batch in batches:
        at = 0
        _, offsets = raw(batch.column(column))
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start : end] for ascending ranges that don't overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, side="right")))
            low = int(start[at])
            body = data[low : int(end[to - 1])]
            up, down = _BYTES(len(body) + 1)
            sums = np.zeros(len(body) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[body] * up[: len(body)], out=sums[1:])
            s, e = start[at:to] - low, end[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
    return mix(out)


def prefix_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each byte of the ranges data[start : end] (ascending, apart), one byte of a hash of its range up to it."""
    size = end - start
    if not len(start):
        return np.zeros(0, np.uint8)
    up, down = _BYTES(len(data) + 1)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return (mix((sums[at + 1] - np.repeat(sums[start], size)) * np.repeat(down[start], size)) >> np.uint64(56)).astype(np.uint8)


class Words:
    """Words of the documents of one array: byte ``start`` and ``end``, document ``doc``, and per document ``first`` (len + 1)."""

    def __init__(self, array: pa.Array, fold: np.ndarray | None = None):
        """fold: a table of 256 bytes that each byte goes through first."""
        self.data, self.offsets = raw(array)
        if fold is not None:
            self.data = fold[self.data]
        n = len(self.data)
        self.docs = len(array)
        word = ~SPACE[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return hash_ranges(self.data, self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
        """Hash of the ``size`` words from each word on; windows over the array's end get 0, those over a document's end are meaningless."""
        out = np.zeros(len(hashes), dtype=np.uint64)
        if len(hashes) < size:
            return out
        up, down = (_WORDS_B if second else _WORDS_A)(len(hashes) + 1)
        with np.errstate(over="ignore"):
            values = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if second else hashes
            sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(values * up[: len(hashes)], out=sums[1:])
            out[: len(hashes) - size + 1] = (sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1]
        return mix(out)

    def fits(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each word on lie in its document."""
        return np.arange(len(self)) + size <= self.first[1:][self.doc]


def sliding(values: np.ndarray, size: int, how: np.ufunc) -> np.ndarray:
    """how(values[i : i + size]) for each i (shorter at the end)."""
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        if step < len(out):
            out[:-step] = how(out[:-step], out[step:])
        have += step
    return out


NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def minimisers(grams: np.ndarray, fits: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Least gram hash of each window of ``span`` grams, and which grams are the least of a window that ``fits``.

    Equal windows choose equal grams at equal places, so repeats share a chosen gram.
    """
    least = sliding(grams, span, np.minimum)
    backwards = np.where(fits, least, np.uint64(0))[::-1]
    top = sliding(backwards, span, np.maximum)[::-1]
    return least, (top == grams) & (top > 0)


_KINDS = [np.dtype(k) for k in ("u1", "<u2", "<u4", "<u8", "<i4", "<i8")]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers as one small blob: the bytes of each transposed, all in one zstandard frame."""
    head = np.array([len(columns), *[x for c in columns for x in (_KINDS.index(c.dtype), len(c))]], "<u4")
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns if len(c))
    return head.tobytes() + (zstandard.ZstdCompressor(level=1).compress(body) if body else b"")


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    head = np.frombuffer(blob, "<u4", 2 * n, 4).reshape(n, 2)
    kinds, sizes = [_KINDS[k] for k in head[:, 0].tolist()], head[:, 1].tolist()
    total, at, out = sum(k.itemsize * s for k, s in zip(kinds, sizes)), 0, []
    body = zstandard.ZstdDecompressor().decompress(blob[4 + 8 * n :], max_output_size=total) if total else b""
    for kind, size in zip(kinds, sizes):
        to = at + kind.itemsize * size
        out.append(np.frombuffer(body[at:to], np.uint8).reshape(kind.itemsize, size).T.copy().view(kind).reshape(-1) if size else np.zeros(0, kind))
        at = to
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    """First value, then differences; ascending input packs better so."""
    out = sorted_values.copy()
    with np.errstate(over="ignore"):
        out[1:] -= sorted_values[:-1]
    return out


def undeltas(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(values, dtype=values.dtype)


def slots_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    """A slot for each 64-bit hash, ascending with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def ranks(letters: np.ndarray, size: int) -> np.ndarray:
    """Rank (from 1) of the ``size`` letters from each place on among all such, in the letters' order, by prefix doubling; places after the last count as least."""
    rank, have = np.unique(letters, return_inverse=True)[1].astype(np.uint64) + np.uint64(1), 1
    while have < size and len(rank):
        step = min(have, size - have)
        pair = rank << np.uint64(32)
        pair[:-step] |= rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        have += step
    return rank


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in [s, s + size) for a start s."""
    step = np.zeros(total + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, total), -1)
    return np.cumsum(step[:-1]) > 0


def join_words(words: Words, keep: np.ndarray) -> list[bytes]:
    """Per document, its kept words joined by one space, as bytes."""
    length = (words.end - words.start)[keep] + 1
    doc = words.doc[keep]
    inside = np.zeros(len(words.data) + 1, np.int32)
    s, e = words.start[keep], words.end[keep]
    # a kept word and one byte after it; the byte after is written as a space
    inside[s] += 1
    inside[np.minimum(e, len(words.data))] -= 1
    body = words.data[np.cumsum(inside[:-1]) > 0]
    at = np.arange(len(body)) + np.repeat(np.arange(len(s)), length - 1)
    out = np.full(int(length.sum()), 0x20, np.uint8)
    out[at] = body
    ends = np.cumsum(np.bincount(doc, weights=length, minlength=words.docs).astype(np.int64))
    blob, low, result = out.tobytes(), 0, []
    for high in ends.tolist():
        result.append(blob[low : high - 1] if high > low else b"")
        low = high
    return result
