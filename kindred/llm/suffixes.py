"""Suffixes as rows of words: packing, unpacking, sorting in word order, and the tree that the sorted rows stand for.

A word is a letter: its 64-bit hash. Rows travel sorted, each without what it shares with the row before, and a letter as the
two-byte code of one of the commonest words or else as 40 bits of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.anchors import key_ranks

#: Codes from 1 on are words, 0 is no word, the last is any other word.
COMMON, OTHER = 65_534, 0xFFFF


class Alphabet:
    """Two-byte codes of the commonest letters."""

    def __init__(self, letters: np.ndarray):
        """letters: distinct ones, the commonest first."""
        by = np.argsort(letters)
        self.letters, self.code = letters[by], (by + 1).astype("<u2")

    def encode(self, letters: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.full(len(letters), OTHER, "<u2")
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        return np.where(self.letters[at] == letters, self.code[at], np.uint16(OTHER)).astype("<u2")


def commonest(counts: DataFrame) -> Alphabet:
    """Of (letter long, n long), which may hold a letter many times: the COMMON commonest letters."""
    top = counts.groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(COMMON).toArrow()
    return Alphabet(np.asarray(top["letter"]).view(np.uint64) if top.num_rows else np.zeros(0, np.uint64))


def pack_rows(words: np.ndarray, codes: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
    """Columns for ``unpack_rows``. words: (rows, width) sorted, each word a number into ``codes`` and ``letters``."""
    width = words.shape[1]
    same = words[1:] == words[:-1]
    skip = np.zeros(len(words), np.uint8)
    skip[1:] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    flat = words[np.arange(width) >= skip[:, None]]
    own = codes[flat]
    rare = letters[flat[own == OTHER]]
    return [skip, own, (rare & np.uint64(0xFFFFFFFF)).astype("<u4"), (rare >> np.uint64(32)).astype(np.uint8)]


def unpack_rows(skip: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """(width, rows) letters as numbers that are equal for equal letters everywhere."""
    value = own.astype(np.int64)
    value[own == OTHER] = (1 << 16) + (high.astype(np.int64) << 32 | low.astype(np.int64))
    given = np.arange(width) >= skip[:, None]
    out = np.zeros(given.shape, np.int64)
    out[given] = value
    out, given, at = np.ascontiguousarray(out.T), given.T, np.arange(len(skip))
    for j in range(width):
        out[j] = out[j][np.maximum.accumulate(np.where(given[j], at, 0))]
    return out


def word_order(letters: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows (given as (width, rows)) by their letters, then place; and how many letters each shares with the one before it (0 for the first)."""
    by = np.lexsort((*(() if place is None else (place,)), *letters[::-1]))
    common = np.zeros(len(by), np.int64)
    alive = np.ones(max(len(by) - 1, 0), bool)
    for column in letters:
        sorted_ = column[by]
        alive &= sorted_[1:] == sorted_[:-1]
        common[1:] += alive
    return by, common


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive), in the sorted leaves, of the topmost nodes at least ``depth`` letters deep; a leaf on its own is one as well.

    common: letters that each leaf shares with the one before it. An inner node spans the leaves between two places where fewer are shared.
    """
    starts = np.flatnonzero(common < depth)
    return starts, np.append(starts[1:], len(common))


def place_of(keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A number that orders places by their document's key, then position."""
    return key_ranks(keys) << 32 | pos.astype(np.int64)


def later_places(by: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of sorted leaves: whether each differs in place from its node's first."""
    return place[by] != np.repeat(place[by[starts]], ends - starts)


def runs_per_key(keys: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Per key, the runs of consecutive positions, as uint32 pairs of start and length."""
    if not len(pos):
        return keys, []
    rank = key_ranks(keys)
    by = np.lexsort((pos, rank))
    rank, pos, keys = rank[by], pos[by], keys[:, by]
    new = np.ones(len(by), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(by)) - 1
    pairs = np.stack((pos[at], pos[last] - pos[at] + 1), axis=1).astype("<u4")
    docs = np.flatnonzero(np.diff(rank[at], prepend=-1))
    body = pairs.tobytes()
    edges = [*(docs * 8).tolist(), len(body)]
    return keys[:, at[docs]], [body[a:b] for a, b in zip(edges, edges[1:])]


def run_pairs(blobs: list[bytes]) -> np.ndarray:
    """(runs, 2): start and length."""
    return np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)


def covered(pairs: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``size`` that starts within a run."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, np.minimum(pairs[:, 0] + pairs[:, 1] + size - 1, total), -1)
    return np.cumsum(step[:-1]) > 0


def letter_counts(chunks: Iterator[np.ndarray]) -> pa.RecordBatch:
    """(letter, n) of letters that a chunk has twice or more: the others are common nowhere."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for letters in chunks:
        value, n = np.unique(letters, return_counts=True)
        held.append((value[n > 1], n[n > 1]))
    value = np.concatenate([v for v, _ in held]) if held else np.zeros(0, np.uint64)
    n = np.concatenate([c for _, c in held]) if held else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["letter", "n"])
