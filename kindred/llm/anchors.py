"""Which places of a corpus can start a repeated window: content-selected anchors that occur more than once.

Each document's anchors are the minimisers of its windows: the least hash among the short word grams of a window. Equal
windows choose equal anchors, so a window whose anchor occurs once in the corpus is unique. Anchors travel as packed
columns, one row per (map chunk, slot), and each distinct anchor once per chunk: a gram that a third of all documents
hold reaches its slot once per chunk, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.textkit import NEVER, Words, deltas, minimisers, mix, pack, pieces, raw, sliding, slots_of, undeltas, unpack

#: A document's key: its id, and 128 bits of its text.
KEY = ("rid", "t1", "t2")
KEYS = "rid long, t1 long, t2 long"
#: The id of rows without one.
NO_ID = -(1 << 63)
#: Entries that a map task gathers before it emits them.
FLUSH = 1_500_000
BYTES_PER_SLOT = 8 << 20
EXCHANGE = f"slot long, {KEYS}, blob binary"
PLACES = f"{KEYS}, blob binary"


def key_columns(id_col: str, text_col: str) -> list[Column]:
    """rid, t1, t2 of a row: a null id is the least, a null text is empty. The second hash has another seed, so the two collide independently."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(20240229), text).alias("t2")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, t1, t2, text): rows are told apart by id and text, so that repeated rows share one fate."""
    return docs.select(*key_columns(id_col, text_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def named(docs: DataFrame, id_col: str) -> Column:
    """The id of a key, as ``docs`` has it."""
    return F.when(F.col("rid") != NO_ID, F.col("rid")).cast(docs.schema[id_col].dataType).alias(id_col)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` doesn't have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keys_of(piece: pa.RecordBatch | pa.Table) -> np.ndarray:
    """(3, rows): rid, t1, t2."""
    return np.stack([np.asarray(piece.column(c)) for c in KEY]) if piece.num_rows else np.zeros((3, 0), np.int64)


def key_ranks(keys: np.ndarray) -> np.ndarray:
    """Dense rank of each key, equal for equal keys, by id and then text."""
    by = np.lexsort(keys[::-1])
    new = np.zeros(keys.shape[1], np.int64)
    new[1:] = (keys[:, by][:, 1:] != keys[:, by][:, :-1]).any(axis=0)
    out = np.empty(keys.shape[1], np.int64)
    out[by] = np.cumsum(new)
    return out


def per_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values gathered per key, ascending."""
    rank = key_ranks(keys)
    by = np.lexsort((values, rank))
    at = np.flatnonzero(np.diff(rank[by], prepend=-1))
    return keys[:, by[at]], np.split(values[by], at[1:]) if len(at) else []


def batch(slot: np.ndarray | None, keys: np.ndarray, **more: list[bytes]) -> pa.RecordBatch:
    cols = {} if slot is None else {"slot": pa.array(slot, pa.int64())}
    cols |= {name: pa.array(k, pa.int64()) for name, k in zip(KEY, keys)} | {name: pa.array(v, pa.binary()) for name, v in more.items()}
    return pa.RecordBatch.from_pydict(cols)


def aside(keys: np.ndarray, slots: int) -> np.ndarray:
    """Slots below 0 for what needs no comparing, spread by the whole key."""
    return -1 - (mix((keys[0] ^ keys[1]).view(np.uint64)) % np.uint64(max(slots, 1))).astype(np.int64)


def repeated_anchors(docs: DataFrame, window: int, gram: int, slots: int, depth: int | None = None) -> DataFrame:
    """(rid, t1, t2, places): of each document that has any, the positions of anchors that occur again anywhere, as uint32 blobs.

    An anchor is compared by its gram, or by the ``depth`` words from it on where that is given (it then needs as many).
    """

    def emit(hashes: np.ndarray, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = key_ranks(keys)[doc] << 32 | pos
        by = np.lexsort((place, hashes))
        heads = np.flatnonzero(np.diff(hashes[by], prepend=~hashes[by[:1]]))
        # an anchor that the chunk has twice is settled here, and so is its first place: only its other places elsewhere must learn of it
        size = np.diff(np.append(heads, len(by)))
        twice = np.repeat(size > 1, size)
        if twice.any():
            out = by[twice]
            k, held = per_key(keys[:, doc[out]], pos[out].astype("<u4"))
            yield batch(aside(k, slots), k, blob=[v.tobytes() for v in held])
        lead, known = by[heads], (size > 1).astype(np.uint8)
        where = slots_of(hashes[lead], slots)
        edge = np.flatnonzero(np.diff(where, prepend=-1))
        blobs = []
        for a, b in zip(edge, np.append(edge[1:], len(lead))):
            used, local = np.unique(doc[lead[a:b]], return_inverse=True)
            blobs.append(pack(deltas(hashes[lead[a:b]]), local.astype(np.uint32), pos[lead[a:b]].astype(np.uint32), known[a:b], *keys[:, used]))
        if blobs:
            yield batch(where[edge], np.zeros((3, len(blobs)), np.int64), blob=blobs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = docs_ = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from emit(*(np.concatenate(c, axis=-1) for c in zip(*held)))

        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            hashes = words.hashes()
            grams = words.windows(hashes, gram)
            _, chosen = minimisers(grams, words.fits(window), window - gram + 1)
            if depth is not None:
                grams, chosen = words.windows(hashes, depth), chosen & words.fits(depth)
            at = np.flatnonzero(chosen)
            doc = words.doc[at]
            # the hash of a minimiser is a small one; mixed again, hashes fill all slots alike
            held.append((mix(grams[at]), keys_of(piece), doc + docs_, at - words.first[doc]))
            size, docs_ = size + len(at), docs_ + piece.num_rows
            if size >= FLUSH:
                yield from flush()
                held.clear()
                size = docs_ = 0
        if size:
            yield from flush()

    def reduce(table: pa.Table) -> pa.Table:
        if table.column("slot")[0].as_py() < 0:
            return table.select([*KEY, "blob"])
        parts = []
        for blob in table.column("blob").to_pylist():
            h, local, pos, known, *keys = unpack(blob)
            parts.append((undeltas(h), pos, known, np.stack(keys)[:, local]))
        hashes, pos, known, keys = (np.concatenate(c, axis=-1) for c in zip(*parts))
        by = np.argsort(hashes, kind="stable")
        heads = np.flatnonzero(np.diff(hashes[by], prepend=~hashes[by[:1]]))
        size = np.diff(np.append(heads, len(by)))
        out = by[np.repeat(size > 1, size) & (known[by] == 0)]
        k, held = per_key(keys[:, out], pos[out].astype("<u4"))
        return pa.Table.from_batches([batch(None, k, blob=[v.tobytes() for v in held])])

    return per_document(docs.mapInArrow(scan, EXCHANGE).groupBy("slot").applyInArrow(reduce, PLACES))


def per_document(places: DataFrame) -> DataFrame:
    return places.groupBy(*KEY).agg(F.collect_list("blob").alias("places"))


def positions(column: pa.Array, words: Words) -> np.ndarray:
    """Word indices in ``words`` of a list<binary> column of uint32 positions."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body, ends = raw(column.values.slice(offsets[0], offsets[-1] - offsets[0]))
    pos = np.frombuffer(body.tobytes(), "<u4").astype(np.int64)
    count = np.diff(ends[offsets - offsets[0]]) // 4
    return pos + np.repeat(words.first[:-1], count)


def survivors(words: Words, hashes: np.ndarray, marked: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows whose anchor is among the ``marked`` words, all that can occur elsewhere, and the first such anchor of each."""
    grams = words.windows(hashes, gram)
    span = window - gram + 1
    seen = np.full(len(grams), NEVER)
    seen[marked] = grams[marked]
    least = sliding(grams, span, np.minimum)
    at = np.flatnonzero(words.fits(window) & (sliding(seen, span, np.minimum) == least))
    anchor = np.full(len(at), -1)
    for k in range(span):  # from left to right, the first gram that is the window's least
        hit = (anchor < 0) & (grams[np.minimum(at + k, len(grams) - 1)] == least[at])
        anchor[hit] = at[hit] + k
    return at, anchor
