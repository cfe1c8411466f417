"""Similarity joins of 64-bit hashes by Hamming distance.

All joins work on distinct hashes: how many rows share a hash never enters a join. The hashes are cut into parts, every pair of
parts is one task (a tile), and within it hashes meet by the values of their chunks (``functions.near``), which is complete for
every distance. A pair is found in one tile, once, so nothing is sorted out afterwards, and a hash crosses the network once for
each part, as 8 bytes. Mode 'mih' gives the multi-index candidates: pairs of which one of four 16-bit chunks differs by at most
``chunk_radius`` bits, so above distance 11 it leaves some out.

``spanning_self_join`` and ``spanning_join`` give, instead of all pairs, edges that join what the pairs join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import near
from kindred.functions.hashing import CHUNK_BITS, CHUNKS, bits_of, chunk, hamming, hex_of, masks
from kindred.shared import materialise

#: Most hashes of a part; where there are fewer in all, so many parts, of so many hashes at least.
PART, LEAST_PARTS, LEAST_PART = 1 << 20, 8, 1 << 14
#: Hashes in one packed row; most tasks of a join, each of one tile or more in turn.
PACK, MOST_TASKS = 1 << 16, 20_000


def chunk_radius(threshold: int) -> int:
    return min(threshold // CHUNKS, 2)


def _keys(bits: Column, radius: int | None) -> Column:
    """(chunk number, value) structs of a hash: its own, or all within ``radius``."""
    return F.concat(*[_chunk_keys(chunk(bits, k), k, radius) for k in range(CHUNKS)])


def _chunk_keys(own: Column, k: int, radius: int | None) -> Column:
    values = F.array(own) if radius is None else F.transform(F.array(*map(F.lit, masks(radius))), lambda m: own.bitwiseXOR(m))
    return F.transform(values, lambda v: F.struct(F.lit(k).alias("k"), v.alias("v")))


def _by_index(left: DataFrame, right: DataFrame, threshold: int, same: bool) -> DataFrame:
    """The candidates of mode 'mih' by an equi-join on (chunk number, value): complete up to distance 11. The tests hold the tiles against it; it sends up to 548 rows for each hash."""
    probe = left.select(F.col("bits").alias("a"), F.explode(_keys(F.col("bits"), chunk_radius(threshold))).alias("key"))
    held = right.select(F.col("bits").alias("b"), F.explode(_keys(F.col("bits"), None)).alias("key"))
    near = hamming(F.col("a"), F.col("b"))
    pairs = probe.join(held.hint("shuffle_hash"), "key").filter(near <= threshold)
    if same:
        pairs = pairs.filter("a < b")
    return pairs.select("a", "b", near.alias("dist")).distinct()


def _parts(n: int) -> int:
    return max(1, math.ceil(n / PART), min(LEAST_PARTS, math.ceil(n / LEAST_PART)))


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """(part, bits, key): binary columns of up to PACK longs each. Hashes of one key are in one part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            part, bits, key = (np.asarray(b.column(k)) for k in range(3))
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append((bits[part == p], key[part == p]))
        for p, found in held.items():
            bits, key = (np.concatenate(c) for c in zip(*found))
            for at in range(0, len(bits), PACK):
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([bits[at : at + PACK].tobytes()]), pa.array([key[at : at + PACK].tobytes()])], names=["part", "bits", "key"])

    placed = rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "bits", "key")
    return placed.repartitionById(parts, F.col("part")).mapInArrow(pack, "part int, bits binary, key binary")


def _tiled(left: DataFrame, right: DataFrame, same: bool, n_left: int, n_right: int, work: Callable, schema: str) -> DataFrame:
    """``work(left bits, right bits, left keys, right keys, same)`` over every pair of parts, of one table with itself each pair once. It yields record batches.

    The tables are (bits, key).
    """
    spark = left.sparkSession
    if not n_left or not n_right:
        return spark.createDataFrame([], schema)
    p, q = _parts(n_left), _parts(n_right)
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    if same:
        both = _packed(left, p).select("part", "bits", "key", other(p))
        low, high = F.least("part", "other").cast("long"), F.greatest("part", "other").cast("long")
        rows, tiles = both.select((high * (high + 1) / 2 + low).cast("long").alias("tile"), (F.col("part") <= F.col("other")).alias("first"), (F.col("part") >= F.col("other")).alias("second"), "bits", "key"), p * (p + 1) // 2
    else:
        yes, no = F.lit(True), F.lit(False)
        a = _packed(left, p).select("part", "bits", "key", other(q)).select((F.col("part").cast("long") * q + F.col("other")).alias("tile"), yes.alias("first"), no.alias("second"), "bits", "key")
        b = _packed(right, q).select("part", "bits", "key", other(p)).select((F.col("other").cast("long") * q + F.col("part")).alias("tile"), no.alias("first"), yes.alias("second"), "bits", "key")
        rows, tiles = a.unionByName(b), p * q
    tasks = min(tiles, MOST_TASKS)

    def run(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        longs = lambda side, at: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(h[at], np.int64) for h in held if h[side]]])
        x, y, x_key, y_key = longs(0, 2), longs(1, 2), longs(0, 3), longs(1, 3)
        yield from work(x, y, x_key, y_key, all(h[0] and h[1] for h in held))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, tile in enumerate(b.column(0).to_pylist()):
                if tile != now and held:
                    yield from run(held)
                    held = []
                now = tile
                held.append((b.column(1)[k].as_py(), b.column(2)[k].as_py(), b.column(3)[k].as_py(), b.column(4)[k].as_py()))
        if held:
            yield from run(held)

    placed = rows.repartitionById(tasks, (F.col("tile") % tasks).cast("int"))
    return (placed if tiles == tasks else placed.sortWithinPartitions("tile")).mapInArrow(compare, schema)


def _by_tiles(left: DataFrame, right: DataFrame, threshold: int, same: bool, n_left: int, n_right: int, radius: int | None = None) -> DataFrame:
    """(a, b, dist) of all pairs; ``radius``: of those with one of four chunks within it."""
    some = _chunks(radius)

    def pairs(x: np.ndarray, y: np.ndarray, _x: np.ndarray, _y: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        own = own and same
        for i, j, dist in near.pairs(x.view(np.uint64), y.view(np.uint64), threshold, own, some):
            a, b = x[i], y[j]
            if same:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(dist.astype(np.int32))], names=["a", "b", "dist"])

    keyed = lambda df: df.select("bits", F.col("bits").alias("key"))
    return _tiled(keyed(left), keyed(right), same, n_left, n_right, pairs, "a long, b long, dist int")


def _chunks(radius: int | None) -> list[near.Chunk] | None:
    return None if radius is None else [near.Chunk(CHUNK_BITS * (CHUNKS - 1 - k), CHUNK_BITS, radius) for k in range(CHUNKS)]


def _radius(threshold: int, mode: str) -> int | None:
    if mode not in ("exact", "mih"):
        raise ValueError("mode must be 'exact' or 'mih'")
    return chunk_radius(threshold) if mode == "mih" else None


def _spanning(left: DataFrame, right: DataFrame, thresholds: Sequence[int], mode: str, same: bool, n_left: int, n_right: int) -> DataFrame:
    wanted, out = sorted({t for t in thresholds if t >= (1 if same else 0)}), "src long, dst long, dist int"
    if not wanted:
        _radius(0, mode)
        return left.sparkSession.createDataFrame([], out)
    # candidates of mode 'mih' depend on the threshold, so there each has its own join
    runs = [[t] for t in wanted] if mode == "mih" else [wanted]
    found = None
    for ts in runs:
        some = _chunks(_radius(ts[-1], mode))

        def edges(x: np.ndarray, y: np.ndarray, x_key: np.ndarray, y_key: np.ndarray, own: bool, ts: list[int] = ts, some: list | None = some) -> Iterator[pa.RecordBatch]:
            a, b, at = near.spanning(x.view(np.uint64), y.view(np.uint64), x_key, y_key, ts, own and same, some)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(at.astype(np.int32))], names=["src", "dst", "dist"])

        made = _tiled(left, right, same, n_left, n_right, edges, out)
        found = made if found is None else found.unionByName(made)
    return found


def spanning_self_join(hashes: DataFrame, thresholds: Sequence[int], mode: str = "exact") -> DataFrame:
    """(src, dst, dist) over the keys of ``hashes`` (bits, key), whose bits are distinct: the edges with dist up to a threshold of ``thresholds`` join the same keys as all pairs within it.

    Of each tile at most as many edges as keys are given, not its pairs.
    """
    n = hashes.count()
    return _spanning(hashes, hashes, thresholds, mode, True, n, n)


def spanning_join(probe: DataFrame, index: DataFrame, thresholds: Sequence[int], mode: str = "exact") -> DataFrame:
    """The same for pairs of one of ``probe`` and one of ``index``, equal hashes included; both (bits, key)."""
    return _spanning(probe, index, thresholds, mode, False, probe.count(), index.count())


def _distinct_bits(df: DataFrame, hash_col: str) -> DataFrame:
    """Distinct hashes as bits; a malformed hash is an error, a null one is left out."""
    h = F.col(hash_col)
    checked = F.when(bits_of(h).isNotNull(), bits_of(h)).otherwise(F.raise_error(F.concat(F.lit("not a 16-digit hash: "), h)).cast("long"))
    return df.filter(h.isNotNull()).select(checked.alias("bits")).distinct()


def _join(left: DataFrame, right: DataFrame, threshold: int, mode: str, same: bool) -> DataFrame:
    radius = _radius(threshold, mode)
    if threshold < same:  # different hashes differ
        return left.sparkSession.createDataFrame([], "a long, b long, dist int")
    n_left = left.count()
    return _by_tiles(left, right, threshold, same, n_left, n_left if same else right.count(), radius)


def similarity_self_join(df: DataFrame, threshold: int, hash_col: str = "hash", mode: str = "exact") -> DataFrame:
    """(hash_a, hash_b, dist) of all pairs of different hashes within ``threshold`` bits, hash_a < hash_b.

    Equal hashes aren't paired: their rows are members of one hash (``first_per_hash``).
    """
    _radius(0, mode)
    bits = materialise(_distinct_bits(df, hash_col), "bits")
    found = _join(bits, bits, threshold, mode, True)
    a, b = hex_of(F.col("a")), hex_of(F.col("b"))
    return found.select(F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b"), F.col("dist").cast("int").alias("dist"))


def similarity_join(probe: DataFrame, index: DataFrame, threshold: int, hash_col: str = "hash", mode: str = "exact") -> DataFrame:
    """(hash, match, dist): for each distinct hash of ``probe`` every distinct hash of ``index`` within ``threshold`` bits, equal ones included."""
    _radius(0, mode)
    a, b = (materialise(_distinct_bits(df, hash_col), "bits") for df in (probe, index))
    found = _join(a, b, threshold, mode, False)
    return found.select(hex_of(F.col("a")).alias("hash"), hex_of(F.col("b")).alias("match"), F.col("dist").cast("int").alias("dist"))


def nearest(probe: DataFrame, index: DataFrame, k: int, probe_id: str, index_id: str, hash_col: str = "hash") -> DataFrame:
    """(probe_id, rank, neighbour, dist): the ``k`` rows of ``index`` nearest to each row of ``probe``, its own id aside; ties by id.

    Both sides are cut into parts; each pair of parts keeps its own k best, so k times the number of parts rows meet per probe.
    """
    a = probe.select(F.col(probe_id).alias("id"), bits_of(F.col(hash_col)).alias("bits")).dropna()
    b = index.select(F.col(index_id).alias("id"), bits_of(F.col(hash_col)).alias("bits")).dropna()
    p, q = max(1, math.ceil(a.count() / 1024)), max(1, math.ceil(b.count() / PART))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    x = a.select("id", "bits", part(p).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("q"), F.lit(True).alias("asks"))
    y = b.select("id", "bits", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("p"), part(q).alias("q"), F.lit(False).alias("asks"))

    def best(table: pa.Table) -> pa.Table:
        ids, bits, asks = (np.asarray(table[c]) for c in ("id", "bits", "asks"))
        xs, ys = np.flatnonzero(asks), np.flatnonzero(~asks)
        ys = ys[np.argsort(ids[ys], kind="stable")]
        out: list[tuple] = []
        for i in xs:
            dist = np.bitwise_count(bits[ys].view(np.uint64) ^ bits[i : i + 1].view(np.uint64)).astype(np.int32)
            order = np.argsort(dist, kind="stable")[: k + 1]
            order = order[ids[ys[order]] != ids[i]][:k]
            out += [(int(ids[i]), int(ids[ys[o]]), int(dist[o])) for o in order]
        cols = list(zip(*out)) if out else ([], [], [])
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["probe", "neighbour", "dist"])

    rows = x.unionByName(y).groupBy("p", "q").applyInArrow(best, "probe long, neighbour long, dist int")
    top = rows.groupBy("probe").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "neighbour"))), 1, k).alias("best"))
    return top.select(F.col("probe").alias(probe_id), F.posexplode("best")).select(probe_id, (F.col("pos") + 1).alias("rank"), F.col("col.neighbour").alias("neighbour"), F.col("col.dist").alias("dist"))
