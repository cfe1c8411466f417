"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a target share of the mix; a target above what the source may repeat is cut there and the excess shared
out again by weight. A source's documents fall into blocks by a seeded hash, its blocks stand in a seeded permutation, and
each that still fits into the target is drawn; the first few that don't give single documents in a seeded order, and what gap is
then left is closed from all the others, by counts of sizes, until it is below the least document left out. The exact number of drawn
blocks per source is then split among the output shards: the root holds all quotas, each half of the shards gets a
multivariate-hypergeometric share of its parent's, down to single shards. A shard takes the next disjoint run of each
source's permuted blocks, and its documents are shuffled within it by a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.anchors import key_columns
from kindred.shared import materialise

#: Documents of a block, up to the point where a source has MOST_BLOCKS.
BLOCK = 64
MOST_BLOCKS = 1 << 16
#: The first blocks that don't fit, which give single documents in a seeded order, and about how many documents these hold at least.
EDGE, EDGE_DOCUMENTS = 8, 512
#: Sources that the driver plans for.
MOST_SOURCES = 100_000
WORDS = r"size(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''))"


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``total``, none above ``most`` times its size.

    The excess of sources at their limit is shared by weight among the rest until none is above; what no source can take is left out.
    """
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[k] for k in free)
        if weight <= 0:
            break
        over = {k for k in free if left * weights[k] / weight > most * sizes[k]}
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        free -= over
    return out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` draws without replacement are good. Beyond numpy's limit of 1e9 units by the same rejection from a table mountain hat (Stadlober 1990)."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    few, many, all_ = min(good, bad), max(good, bad), good + bad
    m = min(n, all_ - n)
    if not few or not m:
        z = 0
    else:
        share = few / all_
        centre, spread = m * share + 0.5, math.sqrt((all_ - m) * m * share * (1 - share) / (all_ - 1) + 0.5)
        log = lambda k: math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(m - k + 1) + math.lgamma(many - m + k + 1)
        top = log(math.floor((m + 1) * (few + 1) / (all_ + 2)))
        end = min(min(m, few) + 1, math.floor(centre + 16 * spread))
        while True:
            x, y = rng.random(), rng.random()
            w = centre + (1.7155277699214135 * spread + 0.8989161620588988) * (y - 0.5) / x if x else -1.0
            if not max(0, m - many) <= w < end:
                continue
            z = math.floor(w)
            if 2 * math.log(x) <= top - log(z):
                break
    if good > bad:
        z = m - z
    return z if m == n else good - z


def share_out(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric draw of ``n`` of the units that ``quotas`` counts."""
    out, left = np.zeros(len(quotas), np.int64), int(quotas.sum())
    if left < 1_000_000_000:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals") if left else out
    for k, own in enumerate(quotas.tolist()):
        left -= own
        out[k] = hypergeometric(own, left, n, rng)
        n -= int(out[k])
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): exact block quotas of each shard, by a tree of multivariate-hypergeometric halvings."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    share = share_out(quotas, int(quotas.sum()) * left // shards, rng)
    return np.concatenate((split_quotas(share, left, rng), split_quotas(quotas - share, shards - left, rng)))


def fill(sizes: np.ndarray, room: int) -> np.ndarray:
    """Which of ``sizes``, in order, are taken into ``room``: each that still fits."""
    out = np.zeros(len(sizes), bool)
    for k, s in enumerate(sizes.tolist()):
        if s <= room:
            out[k] = True
            room -= s
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shards: int = 16, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """Draws a mix of ``share`` times all words, sources (by code point, null last) weighing ``weights``, repeating.

    Returns one row per row of ``docs``: the id, t1 and t2 (hashes of the text), size (words), source_size, target (its source's), taken (words the mix
    takes from it: its size times copies), copies, and draws (one struct of shard and order for each copy; the order
    shuffles the rows of a shard). A document is taken whole, at most ``most`` times. Which ones depends on ids, sources,
    sizes and ``seed`` alone, so reruns agree.

    Null texts and texts without words have size 0 and are taken with their block, for 0 words. A null source is a source
    of its own, the last. Rows with null or equal ids are drawn by their sizes and texts. Other columns are ignored.
    What a source's target lacks at the end is below each of its documents that has a copy less. An empty table gives an
    empty result.
    """
    if int(most) != most or most < 1:
        raise ValueError("most must be a whole number of copies")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("id", "source", *[c.alias(n) for c, n in zip(key_columns("id", "text")[1:], ("t1", "t2"))], F.coalesce(F.when(F.col("text").isNotNull(), F.expr(WORDS)), F.lit(0)).cast("long").alias("size"))
    rows = materialise(rows, "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).toArrow().to_pylist()
    if len(per) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weight = [weights[k % len(weights)] for k in range(len(per))]
    goal = targets([r["size"] for r in per], weight, share * sum(r["size"] for r in per), most)
    plan = []
    for k, (r, t) in enumerate(zip(per, goal)):
        words = round(t)
        full = min(most, words // r["size"]) if r["size"] else 0
        plan.append((k, r["source"], r["size"], t, full, words - full * r["size"], min(MOST_BLOCKS, max(1, math.ceil(r["n"] / block)))))
    spark = docs.sparkSession
    fields = "k int, source string, source_size long, target double, full int, rest long, blocks int"
    sources = spark.createDataFrame(plan, fields) if plan else spark.createDataFrame([], fields)
    # the hash of id, size and text spreads rows of one id over the blocks
    placed = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).select(
        "id", "t1", "t2", "size", "k", "source_size", "target", "full", "rest", F.pmod(F.xxhash64("id", "size", "t1", F.lit(seed)), F.col("blocks")).alias("block")
    )
    totals = placed.groupBy("k", "block", "full", "rest").agg(F.sum("size").alias("words"), F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(0)).alias("least"))
    order = Window.partitionBy("k").orderBy(F.xxhash64("k", "block", F.lit(seed + 1)), "block")
    edges = max(EDGE, math.ceil(EDGE_DOCUMENTS / block))

    def whole(t: pa.Table) -> pa.Table:
        # of the blocks in their permuted order: each that still fits into the rest gives one copy more, the first others with a document that fits as many documents
        t = t.sort_by("rank")
        words, least, full, rest = np.asarray(t["words"]), np.asarray(t["least"]), t["full"][0].as_py(), t["rest"][0].as_py()
        take = fill(words, rest) if full < most else np.zeros(len(words), bool)
        room = rest - int(words[take].sum())
        edge = ~take & (words > 0) & (least <= room)
        edge &= np.cumsum(edge) <= edges
        # drawn blocks come first, so that the units of the extra copies have no gaps
        rank = np.empty(len(take), np.int32)
        rank[np.argsort(~take, kind="stable")] = np.arange(len(take))
        return t.select(["k", "block", "full"]).append_column("rank", pa.array(rank)).append_column("extra", pa.array(np.where(take, 2, edge), pa.int32())).append_column("room", pa.array(np.full(len(words), room), pa.int64()))

    ranked = totals.withColumn("rank", F.row_number().over(order) - 1)
    ranked = materialise(ranked.groupBy("k").applyInArrow(whole, "k int, block long, full int, rank int, extra int, room long"), "blocks")

    # units: each copy of a whole block; first all blocks' full copies, then the extra ones. Single documents go to shards by a hash
    counts = {r["k"]: r for r in ranked.groupBy("k", "full").agg(F.count("*").alias("n"), F.count_if(F.col("extra") == 2).alias("extra")).toArrow().to_pylist()}
    quotas = np.array([counts[k]["n"] * counts[k]["full"] + counts[k]["extra"] if k in counts else 0 for k in range(len(per))], dtype=np.int64)
    held = split_quotas(quotas, shards, np.random.default_rng(seed)) if len(per) else np.zeros((shards, 0), np.int64)
    bounds = spark.createDataFrame([(k, np.cumsum(held[:, k]).tolist()) for k in range(len(per))], "k int, bounds array<long>") if plan else spark.createDataFrame([], "k int, bounds array<long>")
    sizes = spark.createDataFrame([(k, counts[k]["n"]) for k in counts], "k int, n long") if counts else spark.createDataFrame([], "k int, n long")
    copies = F.expr("transform(sequence(0, full + if(extra = 2, 1, 0) - 1), c -> cast(c as long) * n + rank)")
    shard = F.expr("transform(units, u -> cast(size(filter(bounds, b -> b <= u)) as int))")
    drawn = (
        ranked.join(F.broadcast(sizes), "k")
        .join(F.broadcast(bounds), "k")
        .withColumn("units", F.when(F.expr("full + if(extra = 2, 1, 0) > 0"), copies).otherwise(F.array().cast("array<long>")))
        .select("k", "block", "rank", "extra", "room", shard.alias("shards"))
    )
    joined = placed.join(drawn, ["k", "block"])

    # at the edge, block by block in a seeded order, the first documents that fill the room
    single = joined.filter("extra <> 2").withColumn("mark", F.xxhash64("id", "size", "t1", F.lit(seed + 2)))
    fits = F.col("size") <= F.col("room")
    line = Window.partitionBy("k").orderBy("rank", "mark", "size", "id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = single.filter("extra = 1").withColumn("upto", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(line))
    at_edge = materialise(at_edge.withColumn("taken_extra", fits & ((F.col("upto") <= F.col("room")) | (F.col("size") == 0))).drop("upto"), "edge")
    gaps = at_edge.groupBy("k", "room").agg(F.sum(F.when(F.col("taken_extra"), F.col("size")).otherwise(0)).alias("held")).select("k", (F.col("room") - F.col("held")).alias("gap"))
    # all documents that are left, counted by size: the greatest that fit first, so no document that fits is out of reach
    idle = at_edge.filter(~F.col("taken_extra")).drop("taken_extra").unionByName(single.filter("extra = 0"))

    def close(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending")])
        gap, picks = t["gap"][0].as_py(), []
        for size, n in zip(t["size"].to_pylist(), t["n"].to_pylist()):
            picks.append(min(n, gap // size))
            gap -= picks[-1] * size
        return t.select(["k", "size"]).append_column("pick", pa.array(picks, pa.int64()))

    counted = idle.join(F.broadcast(gaps), "k").filter("size > 0 and size <= gap").groupBy("k", "size", "gap").agg(F.count("*").alias("n"))
    picks = materialise(counted.groupBy("k").applyInArrow(close, "k int, size long, pick long").filter("pick > 0"), "picks")
    left = idle.join(F.broadcast(picks), ["k", "size"], "left")
    alike = Window.partitionBy("k", "size").orderBy("mark", "id")
    closing = left.filter("pick is not null").withColumn("taken_extra", F.row_number().over(alike) <= F.col("pick"))
    both = joined.filter("extra = 2").withColumn("taken_extra", F.lit(True)).unionByName(at_edge.filter("taken_extra").drop("mark"))
    both = both.unionByName(left.filter("pick is null").withColumn("taken_extra", F.lit(False)).drop("mark", "pick")).unionByName(closing.drop("mark", "pick"))
    out = both.withColumn("copies", F.col("full") + F.col("taken_extra").cast("int")).select(
        F.col("id").cast(kind).alias(id_col),
        "t1",
        "t2",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        F.expr(f"transform(slice(concat(shards, array(cast(pmod(xxhash64(id, size, {seed + 4}), {shards}) as int))), 1, copies), (s, c) -> struct(s as shard, xxhash64(id, c, {seed + 3}) as order))").alias("draws"),
    )
    return out
