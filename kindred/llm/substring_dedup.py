"""Substring dedup by prefix-partitioned suffix trees.

1. Anchors (``anchors.py``) leave only suffixes whose first ``window`` words can occur elsewhere.
2. Those suffixes are counted by their prefixes. A prefix is lengthened, by some bits of its next word (or words) at a time, until the
   suffixes that begin with it fit in memory: common beginnings get long prefixes, rare ones short.
3. All suffixes of one group of prefixes meet in one task, each with its first ``window`` words. They are sorted in word order and
   compared with their neighbours; between places where neighbours share fewer than ``window`` words lies an inner node of the suffix
   tree that is at least so deep: a maximal repeat's beginning. The node's first leaf (least id and position) stays; the window at
   every other leaf is removed. Nodes below it needn't be opened, as all its leaves but one go.

Of rows with equal texts only the one of least id is looked at: every window of the others starts earlier in it.

A map chunk sorts its own suffixes first, by prefix doubling, and sends each sequence of words once: what thousands of copies
share reaches its subtree once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.anchors import BYTES_PER_SLOT, EXCHANGE, KEY, KEYS, PLACES, aside, batch, keyed, keys_of, named, per_document, positions, repeated_anchors, survivors
from kindred.llm.suffixes import Alphabet, commonest, covered, deep_nodes, later_places, letter_counts, pack_rows, place_of, run_pairs, runs_per_key, unpack_rows, word_order
from kindred.llm.textkit import Words, cover, join_words, pack, pieces, ranks, unpack
from kindred.shared import discard, materialise, slots_for

#: Suffixes that one subtree may hold (each takes about 400 bytes while it is sorted).
SUFFIXES_PER_TREE = 300_000
#: Suffixes that a map task gathers before it sends them.
FLUSH = 1_000_000
#: Bits of a prefix key: of the first word, the second, third and fourth, of the next four together, and of the whole window.
WORD_BITS, NEXT_BITS = (14, 12, 10, 8), 8
#: Words of a text, joined by one space, by built-in functions.
KEPT = r"trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' '))"


def prefix_keys(words: Words, hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Of the suffixes at ``at``, 64 bits that begin equal where their first words are equal; equal windows have equal keys."""
    key, left = np.zeros(len(at), np.uint64), 64
    digits = [(hashes[np.minimum(at + k, len(hashes) - 1)], bits) for k, bits in enumerate(WORD_BITS[: min(len(WORD_BITS), window)])]
    if window > 8:
        digits.append((words.windows(hashes, 8)[at], NEXT_BITS))
    for value, bits in digits:
        left -= bits
        key |= (value >> np.uint64(64 - bits)) << np.uint64(left)
    return key | words.windows(hashes, window)[at] >> np.uint64(64 - left)


def _suffixes(piece: pa.RecordBatch, window: int, gram: int) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(piece.column("text"))
    hashes = words.hashes()
    return words, hashes, survivors(words, hashes, positions(piece.column("places"), words), window, gram)[0]


def _group(counts: list[tuple[int, int]], most: int) -> np.ndarray:
    """First keys of the groups but the first, from (first key, suffixes) of every prefix."""
    bounds, size = [], 0
    for start, n in sorted(counts):
        if size and size + n > most:
            bounds.append(start)
            size = 0
        size += n
    return np.array(bounds, dtype=np.uint64)


def prefix_bounds(affected: DataFrame, window: int, gram: int, most: int) -> tuple[np.ndarray, Alphabet]:
    """Ascending first keys of the groups but the first, each of at most ``most`` suffixes where 64 bits can tell them apart; and the commonest words."""
    done: list[tuple[int, int]] = []
    open_, depth, step, alphabet = np.zeros(1, np.uint64), 0, 12, None
    while len(open_) and depth < 60:
        old, depth = depth, depth + step

        def count(batches: Iterator[pa.RecordBatch], old: int = old, new: int = depth, above: np.ndarray = open_) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                words, hashes, at = _suffixes(piece, window, gram)
                key = prefix_keys(words, hashes, at, window)
                if old:
                    head = key >> np.uint64(64 - old)
                    key = key[above[np.minimum(np.searchsorted(above, head), len(above) - 1)] == head]
                value, n = np.unique(key >> np.uint64(64 - new), return_counts=True)
                yield pa.record_batch([pa.array(value.astype(np.int64)), pa.array(np.full(len(n), False)), pa.array(n.astype(np.int64))], names=["letter", "common", "n"])
                if not old:
                    own = letter_counts(iter([hashes[cover(at, window, len(hashes))]]))
                    yield pa.record_batch([own.column(0), pa.array(np.full(own.num_rows, True)), own.column(1)], names=["letter", "common", "n"])

        seen = materialise(affected.mapInArrow(count, "letter long, common boolean, n long").groupBy("letter", "common").agg(F.sum("n").alias("n")), "prefixes")
        if alphabet is None:
            alphabet = commonest(seen.filter("common"))
        table = seen.filter("not common").select("letter", "n").toArrow()
        discard(seen)
        prefix, n = np.asarray(table["letter"]).astype(np.uint64), np.asarray(table["n"])
        done += zip((prefix[n <= most] << np.uint64(64 - depth)).tolist(), n[n <= most].tolist())
        open_ = np.sort(prefix[n > most])
    done += [(p << (64 - depth), most) for p in open_.tolist()]
    return _group(done, most), alphabet


def _send(held: list[tuple], window: int, edges: np.ndarray, alphabet: Alphabet) -> Iterator[pa.RecordBatch]:
    """Of a chunk's suffixes: the later places of what it has more than once, under slots below 0; each sequence of words once, packed by group."""
    sizes = np.cumsum([0, *(len(h[0]) for h in held)])
    docs = np.cumsum([0, *(h[1].shape[1] for h in held)])
    letters, keys, prefix, pos = (np.concatenate([h[k] for h in held], axis=-1) for k in (0, 1, 4, 5))
    at = np.concatenate([h[2] + size for h, size in zip(held, sizes)])
    doc = np.concatenate([h[3] + d for h, d in zip(held, docs)])
    rank = ranks(letters, window)[at]
    place = place_of(keys, np.zeros(keys.shape[1], np.int64))[doc] | pos
    by = np.lexsort((place, rank))
    starts = np.flatnonzero(np.diff(rank[by], prepend=np.uint64(0)))
    ends = np.append(starts[1:], len(by))
    out = by[later_places(by, starts, ends, place)]
    slots = len(edges) + 1
    if len(out):
        k, blobs = runs_per_key(keys[:, doc[out]], pos[out])
        yield batch(aside(k, slots), k, blob=blobs)
    lead = by[starts]
    slot = np.searchsorted(edges, prefix[lead], side="right")
    order = np.argsort(slot, kind="stable")
    lead, slot = lead[order], slot[order]
    spelled, number = np.unique(letters, return_inverse=True)
    codes, number = alphabet.encode(spelled), number.astype(np.uint32)
    cuts, blobs = np.flatnonzero(np.diff(slot, prepend=-1)), []
    for a, b in zip(cuts, np.append(cuts[1:], len(lead))):
        own = lead[a:b]
        used, local = np.unique(doc[own], return_inverse=True)
        rows = number[at[own][:, None] + np.arange(window)]
        blobs.append(pack(*pack_rows(rows, codes, spelled), local.astype("<u4"), pos[own].astype("<u4"), *keys[:, used]))
    yield batch(slot[cuts], np.zeros((3, len(blobs)), np.int64), blob=blobs)


def subtree(table: pa.Table, window: int) -> pa.Table:
    """Later leaves of the deep nodes of one group's tree."""
    if table.column("slot")[0].as_py() < 0:
        return table.select([*KEY, "blob"])
    parts = []
    for blob in table.column("blob").to_pylist():
        skip, own, low, high, local, pos, *keys = unpack(blob)
        parts.append((unpack_rows(skip, own, low, high, window), pos, np.stack(keys)[:, local]))
    letters, pos, keys = (np.concatenate(c, axis=-1) for c in zip(*parts))
    place = place_of(keys, pos)
    by, common = word_order(letters, place)
    starts, ends = deep_nodes(common, window)
    out = by[later_places(by, starts, ends, place)]
    k, blobs = runs_per_key(keys[:, out], pos[out])
    return pa.Table.from_batches([batch(None, k, blob=blobs)])


def repeated_windows(docs: DataFrame, firsts: DataFrame, window: int = 20, gram: int = 8, suffixes_per_tree: int = SUFFIXES_PER_TREE) -> tuple[DataFrame, DataFrame]:
    """Over keyed rows, of which the keys ``firsts`` are looked at: the documents that may hold repeats, materialised, and (key, places), materialised, of their windows that start earlier elsewhere, as runs."""
    slots = slots_for(docs, BYTES_PER_SLOT)
    marked = repeated_anchors(docs, window, gram, slots).join(firsts, list(KEY), "left_semi")
    affected = materialise(docs.join(marked, list(KEY)).dropDuplicates(list(KEY)), "suffixes")
    edges, alphabet = prefix_bounds(affected, window, gram, suffixes_per_tree)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in pieces(batches, "text"):
            words, hashes, at = _suffixes(piece, window, gram)
            if not len(at):
                continue
            # only words of surviving windows are kept
            mask = cover(at, window, len(words))
            doc = words.doc[at]
            held.append((hashes[mask], keys_of(piece), np.cumsum(mask)[at] - 1, doc, prefix_keys(words, hashes, at, window), at - words.first[doc]))
            size += len(at)
            if size >= FLUSH:
                yield from _send(held, window, edges, alphabet)
                held, size = [], 0
        if size:
            yield from _send(held, window, edges, alphabet)

    def tree(table: pa.Table) -> pa.Table:
        return subtree(table, window)

    return affected, materialise(per_document(affected.mapInArrow(scan, EXCHANGE).groupBy("slot").applyInArrow(tree, PLACES)), "repeats")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, digest: bool = False, suffixes_per_tree: int = SUFFIXES_PER_TREE) -> DataFrame:
    """Removes every word covered by a ``window`` of words that also starts earlier: in a document of smaller id, or earlier in its own.

    Returns one row per row of ``docs``: the id (named as there), n_words, n_removed, spans (of removed words: start and end,
    exclusive, counted in words) and kept_text, or kept_sha256 where ``digest`` is set. Windows are judged on the input.

    A null text has no words. A null id is the least id. Rows with the same id and text are one document and get the same
    result; rows with the same id and different texts are ordered by a hash of the text. Other columns are ignored.
    An empty table gives an empty result. A document shorter than ``window`` keeps all its words.
    """
    if not 1 <= gram <= window <= 255:
        raise ValueError("gram must be between 1 and window, window at most 255")
    base = keyed(docs, id_col, text_col)
    firsts = materialise(base.groupBy("t1", "t2").agg(F.min("rid").alias("rid")), "firsts")
    affected, removed = repeated_windows(base, firsts, window, gram, suffixes_per_tree)
    name = "kept_sha256" if digest else "kept_text"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            gone = np.zeros(len(words), bool)
            spans: list[list[dict]] = []
            for d, blobs in enumerate(piece.column("places").to_pylist()):
                a, b = int(words.first[d]), int(words.first[d + 1])
                own = gone[a:b] = covered(run_pairs(blobs), window, b - a)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
            kept = join_words(words, np.flatnonzero(~gone))
            body = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode() for k in kept]
            n = np.bincount(words.doc[gone], minlength=words.docs)
            yield pa.RecordBatch.from_pydict({**{c: piece.column(c) for c in KEY}, "n_removed": pa.array(n, pa.int64()), "spans": pa.array(spans, span), name: pa.array(body, pa.string())})

    changed = affected.drop("places").join(removed, list(KEY)).mapInArrow(strip, f"{KEYS}, n_removed long, spans array<struct<start:int,end:int>>, {name} string")
    changed = materialise(changed, "stripped")
    for t in (affected, removed):
        discard(t)
    whole = F.expr(f"sha2({KEPT}, 256)" if digest else KEPT)
    n_words = F.expr(f"if({KEPT} = '', 0L, cast(length({KEPT}) - length(replace({KEPT}, ' ', '')) + 1 as long))")
    plain = base.select(*KEY, n_words.alias("n_words"), whole.alias("whole")).join(firsts.withColumnRenamed("rid", "least"), ["t1", "t2"])
    both = plain.join(changed, list(KEY), "left")
    # a copy of a text that has a window loses all its words
    copy = (F.col("rid") > F.col("least")) & (F.col("n_words") >= window)
    nothing = F.lit("")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return both.select(
        named(docs, id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(nothing, 256) if digest else nothing).otherwise(F.coalesce(name, "whole")).alias(name),
        F.when(copy, every).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
    )
