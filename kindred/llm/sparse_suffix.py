"""Suffix-array dedup with sparse suffix arrays.

1. Only suffixes at minimiser positions are retained: the least gram of every ``reach`` words (``anchors.py``). A passage of
   ``length`` words has such a position within its first ``reach - gram + 1`` words, and at least ``depth`` words follow there.
   A suffix whose first ``depth`` words occur nowhere else starts no repeat and goes.
2. What is left meets, in slots by these words, with the words on both sides that a passage may take. Each slot's suffixes are
   sorted in word order and compared with their neighbours to the right, and in reversed order to the left.
3. Matches are extended both ways: for each number of words to the left, suffixes that agree so far left and, to the right, up to
   ``length`` words in all, hold the same passage. Passages that overlap in a document grow into one span.

A map chunk settles the passages that it has more than once, by prefix doubling, and sends one of each. Suffixes with beginnings that
very many documents share don't meet in one task: there each passage goes to a slot by all its words, and is sent once per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.anchors import BYTES_PER_SLOT, KEY, KEYS, NO_ID, aside, batch, key_ranks, keyed, keys_of, positions, repeated_anchors, survivors
from kindred.llm.suffixes import Alphabet, commonest, covered, deep_nodes, letter_counts, pack_rows, place_of, run_pairs, runs_per_key, unpack_rows, word_order
from kindred.llm.textkit import Words, cover, mix, pack, pieces, ranks, slots_of, unpack
from kindred.operators.components import connected_components
from kindred.shared import discard, materialise, slots_for

#: Passages that a map task gathers before it sends them.
FLUSH = 500_000
#: Suffixes with one beginning above which their passages are told apart by all their words.
CROWD = 200_000
FOUND = f"{KEYS}, blob binary, later binary, of binary"
SPANS = "array<struct<start:int,end:int>>"


def _answer(keys: np.ndarray, pos: np.ndarray, head: np.ndarray, later: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """One row per document: runs of its repeated passages' starts, of the later ones, and the documents that hold the first of these.

    keys and head: (3, passages), of the passage and of its first occurrence.
    """
    rank = key_ranks(keys)
    repeated_keys, repeated = runs_per_key(keys[:, again], pos[again])
    later_keys, late = runs_per_key(keys[:, later], pos[later])
    tied = np.flatnonzero(later & (keys != head).any(axis=0))
    pair = np.unique(rank[tied] << 32 | key_ranks(head)[tied], return_index=True)[1] if len(tied) else np.zeros(0, np.int64)
    own: dict[tuple, list] = {tuple(k): [b, b"", b""] for k, b in zip(repeated_keys.T.tolist(), repeated)}
    for k, b in zip(later_keys.T.tolist(), late):
        own.setdefault(tuple(k), [b"", b"", b""])[1] = b
    for k, h in zip(keys[:, tied[pair]].T.tolist(), head[:, tied[pair]].T):
        own[tuple(k)][2] += h.astype("<i8").tobytes()
    k = np.array(list(own), np.int64).reshape(-1, 3).T
    return batch(None, k, **dict(zip(("blob", "later", "of"), map(list, zip(*own.values())) if own else ([], [], []))))


def _send(held: list[tuple], length: int, span: int, slots: int, bits: int, crowded: np.ndarray, alphabet: Alphabet) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([0, *(len(h[0]) for h in held)])
    docs = np.cumsum([0, *(h[1].shape[1] for h in held)])
    letters, keys, left, pos, begin, whole = (np.concatenate([h[k] for h in held], axis=-1) for k in (0, 1, 4, 5, 6, 7))
    at = np.concatenate([h[2] + size for h, size in zip(held, sizes)])
    doc = np.concatenate([h[3] + d for h, d in zip(held, docs)])
    rank = ranks(letters, length)[at]
    place = place_of(keys, np.zeros(keys.shape[1], np.int64))[doc] | pos
    by = np.lexsort((place, rank))
    starts = np.flatnonzero(np.diff(rank[by], prepend=np.uint64(0)))
    size = np.diff(np.append(starts, len(by)))
    head = np.repeat(by[starts], size)
    later = place[by] != place[head]
    if later.any():
        out = by[later]
        rows = _answer(keys[:, doc[out]], pos[out], keys[:, doc[head[later]]], np.ones(len(out), bool), np.ones(len(out), bool))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(aside(keys_of(rows), slots)), **{c: rows.column(c) for c in rows.schema.names}})
    lead, known = by[starts], np.maximum.reduceat(later, starts)
    # the passages of one suffix go together, those of a crowded one each on its own
    bucket = begin[lead] >> np.uint64(64 - bits)
    alone = crowded[np.minimum(np.searchsorted(crowded, bucket), max(len(crowded) - 1, 0))] == bucket if len(crowded) else np.zeros(len(lead), bool)
    suffix = np.stack((doc[lead], at[lead] + left[lead], np.where(alone, left[lead] + 1, 0)))
    order = np.lexsort(suffix[::-1])
    heads = np.flatnonzero(np.diff(suffix[:, order], axis=1, prepend=-1).any(axis=0))
    bit = np.uint32(1) << left[lead[order]].astype(np.uint32)
    active = np.bitwise_or.reduceat(bit, heads)
    twice = np.bitwise_or.reduceat(np.where(known[order], bit, np.uint32(0)), heads)
    least, most = np.minimum.reduceat(left[lead[order]], heads), np.maximum.reduceat(left[lead[order]], heads)
    first = lead[order[heads]]
    hashed = mix(np.where(alone[order[heads]], whole[first], begin[first]))
    slot = slots_of(hashed, slots)
    anchor, start = at[first] + left[first], pos[first] + left[first]
    order = np.lexsort((rank[first], hashed, slot))
    spelled, number = np.unique(letters, return_inverse=True)
    codes = np.concatenate((np.zeros(1, "<u2"), alphabet.encode(spelled)))
    spelled, number = np.concatenate((np.zeros(1, np.uint64), spelled)), (number + 1).astype(np.uint32)
    offset = np.concatenate((np.arange(length), -1 - np.arange(span - 1)))
    cuts, blobs = np.flatnonzero(np.diff(slot[order], prepend=-1)), []
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        own = order[a:b]
        used, local = np.unique(doc[first[own]], return_inverse=True)
        rows = number[np.clip(anchor[own][:, None] + offset, 0, len(number) - 1)]
        rows[(offset < -most[own][:, None]) | (offset >= length - least[own][:, None])] = 0
        blobs.append(pack(*pack_rows(rows, codes, spelled), active[own], twice[own], local.astype("<u4"), start[own].astype("<u4"), *keys[:, used]))
    yield batch(slot[order[cuts]], np.zeros((3, len(blobs)), np.int64), blob=blobs, later=[b""] * len(blobs), of=[b""] * len(blobs))


def matches(table: pa.Table, length: int, span: int) -> pa.Table:
    """The repeated passages among a slot's suffixes."""
    if table.column("slot")[0].as_py() < 0:
        return table.drop_columns(["slot"])
    parts = []
    for blob in table.column("blob").to_pylist():
        skip, own, low, high, active, twice, local, start, *keys = unpack(blob)
        parts.append((unpack_rows(skip, own, low, high, length + span - 1), active, twice, start.astype(np.int64), np.stack(keys)[:, local]))
    letters, active, twice, start, keys = (np.concatenate(c, axis=-1) for c in zip(*parts))
    right, right_common = word_order(letters[:length])
    left, left_common = word_order(letters[length:]) if span > 1 else (np.arange(len(start)), np.zeros(len(start), np.int64))
    place, n = place_of(keys, np.zeros(len(start), np.int64)), len(start)
    found: list[tuple] = []
    for k in range(span):
        # suffixes that agree in the k words to the left, and in those to the right that make up the passage
        same_right, same_left = np.empty(n, np.int64), np.empty(n, np.int64)
        same_right[right] = np.cumsum(right_common < length - k)
        same_left[left] = np.cumsum(left_common < k)
        own = np.flatnonzero(active >> np.uint32(k) & np.uint32(1))
        if not len(own):
            continue
        both, where = same_right[own] * (n + 1) + same_left[own], place[own] | start[own] - k
        by = np.lexsort((where, both))
        starts = np.flatnonzero(np.diff(both[by], prepend=-1))
        size = np.diff(np.append(starts, len(by)))
        head = np.repeat(by[starts], size)
        later = where[by] != where[head]
        again = np.repeat(np.maximum.reduceat(later | (twice[own[by]] >> np.uint32(k) & np.uint32(1) > 0), starts), size)
        found.append((keys[:, own[by[again]]], start[own[by[again]]] - k, keys[:, own[head[again]]], later[again]))
    keys, pos, head, later = (np.concatenate(c, axis=-1) for c in zip(*found))
    return pa.Table.from_batches([_answer(keys, pos, head, later, np.ones(len(pos), bool))])


def _crowds(affected: DataFrame, depth: int, bits: int, crowd: int) -> tuple[np.ndarray, Alphabet]:
    """Beginnings (their hash's first bits) of more than ``crowd`` suffixes; and the commonest words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            hashes = words.hashes()
            at = positions(piece.column("places"), words)
            value, n = np.unique(words.windows(hashes, depth)[at] >> np.uint64(64 - bits), return_counts=True)
            own = letter_counts(iter([hashes]))
            for name, number, many in ((False, pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))), (True, own.column(0), own.column(1))):
                yield pa.record_batch([number, pa.array(np.full(len(number), name)), many], names=["letter", "common", "n"])

    seen = materialise(affected.mapInArrow(count, "letter long, common boolean, n long").groupBy("letter", "common").agg(F.sum("n").alias("n")), "beginnings")
    alphabet = commonest(seen.filter("common"))
    crowded = np.sort(np.asarray(seen.filter(~F.col("common") & (F.col("n") > crowd)).select("letter").toArrow()["letter"]).astype(np.uint64))
    discard(seen)
    return crowded, alphabet


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, reach: int = 25, gram: int = 8, crowd: int = CROWD) -> DataFrame:
    """Finds the passages of at least ``length`` words that occur more than once, in several documents or in one.

    Returns one row per document that holds any: the id, n_words, n_repeated (words in such passages), n_later (words in
    occurrences that aren't the first, by id and position: what dedup removes), the spans of both, ``repeated`` and
    ``later`` (start and end, exclusive, in words), class_id (the least id among the documents that share passages with it, directly
    or through others, itself included) and n_linked (how many others these are).

    A null text has no words. A null id is the least id, but a class's id is null only if none of its ids is known. Rows with the same id
    and text are one document: they get one row together and don't repeat each other. Documents shorter than ``length`` hold no passage.
    Other columns are ignored. An empty table gives an empty result.
    """
    depth, span = length - (reach - gram), reach - gram + 1
    if not 1 <= gram <= reach < length or depth < gram or span > 32 or length > 200:
        raise ValueError("needs gram <= reach < length <= 200, reach at most 31 above gram, and length - reach + gram words after an anchor")
    base = keyed(docs, id_col, text_col)
    retained = repeated_anchors(base, reach, gram, slots_for(base, BYTES_PER_SLOT), depth)
    n_words = F.expr(r"size(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''))").cast("long")
    affected = materialise(base.join(retained, list(KEY)).dropDuplicates(list(KEY)).withColumn("n_words", n_words), "retained")
    slots = slots_for(affected, BYTES_PER_SLOT // 2)
    bits = min(40, max(1, math.ceil(math.log2(slots))) + 6)
    crowded, alphabet = _crowds(affected, depth, bits, crowd)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            hashes = words.hashes()
            marked = positions(piece.column("places"), words)
            at, anchor = survivors(words, hashes, marked, reach, gram)
            chosen = np.zeros(len(words) + 1, bool)
            chosen[marked] = True
            fits = words.fits(length)[at] & chosen[anchor]
            at, anchor = at[fits], anchor[fits]
            if not len(at):
                continue
            mask = cover(at, length, len(words))
            doc = words.doc[at]
            whole = words.windows(hashes, length)[at]
            held.append((hashes[mask], keys_of(piece), np.cumsum(mask)[at] - 1, doc, anchor - at, at - words.first[doc], words.windows(hashes, depth)[anchor], whole))
            size += len(at)
            if size >= FLUSH:
                yield from _send(held, length, span, slots, bits, crowded, alphabet)
                held, size = [], 0
        if size:
            yield from _send(held, length, span, slots, bits, crowded, alphabet)

    def neighbours(table: pa.Table) -> pa.Table:
        return matches(table, length, span)

    sent = affected.mapInArrow(scan, f"slot long, {FOUND}")
    found = sent.groupBy("slot").applyInArrow(neighbours, FOUND).groupBy(*KEY).agg(*[F.collect_list(c).alias(c) for c in ("blob", "later", "of")])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        of = pa.list_(pa.struct([(c, pa.int64()) for c in KEY]))
        for b in batches:
            cols: dict[str, list] = {"n_repeated": [], "n_later": [], "repeated": [], "later": [], "of": []}
            for n, again, late, tied in zip(*(b.column(c).to_pylist() for c in ("n_words", "blob", "later", "of"))):
                for name, blobs in (("repeated", again), ("later", late)):
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered(run_pairs(blobs), length, n).astype(np.int8), [0]))))
                    cols[name].append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
                    cols[f"n_{name}"].append(int((edge[1::2] - edge[::2]).sum()))
                ties = np.frombuffer(b"".join(tied), "<i8").reshape(-1, 3)
                cols["of"].append([dict(zip(KEY, t)) for t in (np.unique(ties, axis=0) if len(ties) else ties).tolist()])
            kinds = (pa.int64(), pa.int64(), spans, spans, of)
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in (*KEY, "n_words")}, **{c: pa.array(v, k) for (c, v), k in zip(cols.items(), kinds)}})

    rows = affected.select(*KEY, "n_words").join(found, list(KEY))
    rows = rows.mapInArrow(grow, f"{KEYS}, n_words long, n_repeated long, n_later long, repeated {SPANS}, later {SPANS}, of array<struct<rid:long,t1:long,t2:long>>")
    rows = materialise(rows.withColumn("node", F.concat_ws(":", *KEY)), "passages")
    discard(affected)
    edges = rows.select("node", F.explode("of").alias("o")).select("node", F.concat_ws(":", *[f"o.{c}" for c in KEY]).alias("other"))
    classes = connected_components(edges, "node", "other")
    placed = rows.select("node", "rid").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialise(placed, "classes")
    whole = placed.groupBy("component").agg(F.min(F.when(F.col("rid") != NO_ID, F.col("rid"))).alias("class_id"), (F.count("*") - 1).alias("n_linked"))
    member = placed.select("node", "component").join(whole, "component").drop("component")
    out = rows.join(member, "node")
    kind = docs.schema[id_col].dataType
    return out.select(F.when(F.col("rid") != NO_ID, F.col("rid")).cast(kind).alias(id_col), "n_words", "n_repeated", "n_later", "repeated", "later", F.col("class_id").cast(kind).alias("class_id"), "n_linked")
