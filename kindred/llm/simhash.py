"""SimHash near-dedup: tiled exact comparison with numpy exclusive-or and bit counts.

Distinct fingerprints are compared, with how many rows each has. Two fingerprints that differ in at most ``radius`` bits
agree on at least ``blocks - radius`` of ``blocks`` pieces, so they share a cell of one of the tables keyed by that many
pieces. A cell is ordered by population count and cut into tiles; tile pairs whose population counts differ beyond the
radius are skipped, all others are compared in full. Cells too large for a task are split into parts, and every pair of
parts is a task of its own. A pair counts in the first table that holds it.

Only sums and spanning forests leave a task, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.textkit import CHUNK, LOWER, Words, pieces
from kindred.llm.xxh64 import xxh64
from kindred.operators.components import connected_components
from kindred.shared import discard, materialise

TILE = 1024
#: Fingerprints of one cell that one task compares with each other (about 2e9 comparisons).
CELL = 1 << 16


def fingerprints_of(array: pa.Array, shingle: int = 2, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: A-Z lower-cased, shingles of ``shingle`` words joined by one space, repeats included."""
    words = Words(array, LOWER)
    length = words.end - words.start
    at = np.cumsum(length + 1) - length - 1
    rank = np.arange(int(length.sum()))
    body = np.full(int((length + 1).sum()), 0x20, np.uint8)
    word = np.repeat(np.arange(len(words)), length)
    body[rank + word] = words.data[rank - np.repeat(np.cumsum(length) - length, length) + np.repeat(words.start, length)]
    count = np.where(words.count == 0, 0, np.maximum(words.count - shingle + 1, 1))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(words.docs), count)
    begin = words.first[:-1][doc] + np.arange(len(doc)) - first[doc]
    last = np.minimum(begin + shingle, words.first[1:][doc]) - 1
    h = xxh64(body, at[begin], at[last] + length[last] - at[begin], seed)
    # bits are summed in byte lanes of 64-bit words, at most 255 shingles at a time
    spans = (count + 254) // 255
    owner = np.repeat(np.arange(words.docs), spans)
    cut = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans))
    out = np.zeros(words.docs, np.uint64)
    if not len(cut):
        return out
    filled = np.flatnonzero(count)
    heads = (np.cumsum(spans) - spans)[filled]
    for j in range(8):
        lanes = np.add.reduceat(h >> np.uint64(j) & np.uint64(0x0101010101010101), cut)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        bits = (2 * sums > count[filled, None]).astype(np.uint64)
        for byte in range(8):
            out[filled] |= bits[:, byte] << np.uint64(8 * byte + j)
    return out


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", CHUNK // 2):
            yield pa.record_batch([piece.column("id"), pa.array(fingerprints_of(piece.column("text"), shingle).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(scan, f"id {kind}, fp long")


def plan_tables(n: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(shift, bits) of the blocks, and the tables: tuples of blocks that must agree. Chosen for the least work on ``n`` fingerprints; every choice is exact."""

    def work(blocks: int) -> float:
        tables = math.comb(blocks, radius)
        return tables * n * (200 + 3 * n / 2 ** (64 * (blocks - radius) / blocks + 1))

    blocks = min(range(radius + 1, min(radius + 5, 65)), key=work) if radius < 60 else 64
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])], list(combinations(range(blocks), max(0, blocks - radius)))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare(fp: np.ndarray, weight: np.ndarray, part: np.ndarray, p: int, q: int, table: tuple[int, ...], blocks: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Within a cell, part ``p`` against part ``q``: near rows per fingerprint, and forests as (node, root) indices."""
    near = np.zeros(len(fp), np.int64)
    forests = []
    bits = np.bitwise_count(fp).astype(np.int64)
    sides = []
    for own in (p, q):
        at = np.flatnonzero(part == own)
        at = at[np.argsort(bits[at], kind="stable")]
        sides.append([at[k : k + TILE] for k in range(0, len(at), TILE)])
    for x, a in enumerate(sides[0]):
        for y, b in enumerate(sides[1]):
            if p == q and y < x:
                continue
            if bits[b[0]] - bits[a[-1]] > radius or bits[a[0]] - bits[b[-1]] > radius:
                continue
            differ = fp[a][:, None] ^ fp[b][None, :]
            i, j = np.nonzero(np.bitwise_count(differ) <= radius)
            if p == q and x == y:
                keep = i < j
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            d = differ[i, j]
            equal = np.stack([d >> np.uint64(s) & np.uint64((1 << w) - 1) == 0 for s, w in blocks])
            # the first len(table) blocks that agree are this table's
            here = np.ones(len(i), bool)
            if table:
                here = equal[list(table)].all(axis=0) & (equal[: table[-1] + 1].sum(axis=0) == len(table))
            u, v = a[i[here]], b[j[here]]
            if len(u):
                np.add.at(near, u, weight[v])
                np.add.at(near, v, weight[u])
                nodes, local = np.unique(np.concatenate((u, v)), return_inverse=True)
                root = _labels(len(nodes), local[: len(u)], local[len(u) :])
                grown = root != np.arange(len(nodes))
                forests.append((nodes[grown], nodes[root[grown]]))
    return near, forests


def near_links(distinct: DataFrame, n: int, radius: int, cell: int = CELL) -> DataFrame:
    """Over distinct (fp, rows): (fp, near, other): near adds up to the rows linked from others, other are edges that connect what is linked."""
    blocks, tables = plan_tables(n, radius)
    keys = []
    for t, chosen in enumerate(tables):
        key = F.lit(0).cast("long")
        for b in chosen:
            shift, width = blocks[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    spread = distinct.select("fp", "rows", F.explode(F.array(*keys)).alias("k")).select("fp", "rows", "k.t", "k.key")
    sizes = spread.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1").withColumn("parts", F.ceil(F.col("size") / cell).cast("int"))
    slots = max(8, math.ceil(n * len(tables) / (4 * cell)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = (
        spread.join(sizes.select("t", "key", "parts"), ["t", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("t", "key", "fp", "rows", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .withColumn("slot", F.pmod(F.xxhash64("t", "key", "p", "q"), F.lit(slots)))
    )

    def tiles(table: pa.Table) -> pa.Table:
        t, key, fp, rows, part, p, q = (np.asarray(table.column(c)) for c in ("t", "key", "fp", "rows", "own", "p", "q"))
        fp = fp.view(np.uint64)
        by = np.lexsort((q, p, key, t))
        new = np.ones(len(by), bool)
        new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in (t, key, p, q)])
        nears, edges = [], []
        for at in np.split(by, np.flatnonzero(new)[1:]):
            near, forests = compare(fp[at], rows[at], part[at], int(p[at[0]]), int(q[at[0]]), tables[t[at[0]]], blocks, radius)
            hit = np.flatnonzero(near)
            nears.append((fp[at[hit]], near[hit]))
            edges += [(fp[at[x]], fp[at[y]]) for x, y in forests]
        f = np.concatenate([x for x, _ in nears] + [x for x, _ in edges]).view(np.int64)
        n_near = np.concatenate([x for _, x in nears] + [np.zeros(sum(len(x) for x, _ in edges), np.int64)])
        tail = np.concatenate([y for _, y in edges]).view(np.int64) if edges else np.zeros(0, np.int64)
        other = pa.concat_arrays([pa.nulls(len(f) - len(tail), pa.int64()), pa.array(tail, pa.int64())])
        return pa.table([pa.array(f, pa.int64()), pa.array(n_near, pa.int64()), other], names=["fp", "near", "other"])

    return placed.groupBy("slot").applyInArrow(tiles, "fp long, near long, other long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 6, shingle: int = 2, cell: int = CELL) -> DataFrame:
    """Links rows whose SimHash fingerprints differ in at most ``radius`` bits.

    Returns one row per row of ``docs``: the id, fingerprint (16 lower-case hex digits), n_near (other rows linked directly)
    and component_id (least id that can be reached over links, itself included).

    Texts without words, null texts among them, have fingerprint zero and are linked like any other. Repeated rows are rows:
    each counts in the others' n_near. Rows with a null id are linked and counted; component_id is null only where no id of
    the component is known. Other columns are ignored. An empty table gives an empty result.
    """
    marks = materialise(fingerprinted(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialise(marks.groupBy("fp").agg(F.count("*").alias("rows"), F.min("id").alias("least")), "classes")
    found = materialise(near_links(classes.select("fp", "rows"), classes.count(), radius, cell), "links")
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    roots = connected_components(found.filter("other is not null"), "fp", "other").withColumnRenamed("node", "fp")
    known = classes.join(near, "fp", "left").join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    known = materialise(known, "known")
    discard(found)
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("fp", (F.coalesce("near", F.lit(0)) + F.col("rows") - 1).alias("n_near"), "component_id")
    return marks.join(known, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id"
    )
