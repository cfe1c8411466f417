"""Connected components of an edge table: in one task where they fit, else by alternating large and small stars (Kiveris et al. 2014).

Edges of longs are first thinned to spanning forests, task by task, in memory that goes with the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.near import forest
from kindred.shared import discard, materialise

#: Edges that one task may merge at once, of strings (about 100 bytes each) and of longs (about 64); more go through the distributed rounds.
ONE_TASK, ONE_TASK_LONGS = 500_000, 1 << 24
#: Edges of longs taken in at once.
HELD = 1 << 22
MOST_ROUNDS = 64


class Forest:
    """Disjoint sets whose root is the least member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        """Root of ``x``; an unseen ``x`` becomes its own root."""
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _spanned(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes ascending, each one's component as a position among them, and the ends of edges that span all edges of longs."""
    nodes = label = x = y = np.zeros(0, np.int64)
    held: list[tuple] = []

    def settle() -> None:
        nonlocal nodes, label, x, y
        src, dst = (np.concatenate((old, *new)) for old, new in zip((x, y), zip(*held)))
        nodes, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
        kept, label = forest(len(nodes), at[: len(src)], at[len(src) :])
        x, y = src[kept], dst[kept]
        held.clear()

    for b in batches:
        held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
        if sum(len(h[0]) for h in held) >= HELD:
            settle()
    if held:
        settle()
    return nodes, label, x, y


def _merge_in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                forest.union(x, y)
        nodes = list(forest.parent)
        yield pa.record_batch([pa.array(nodes, pa.string()), pa.array([forest.find(x) for x in nodes], pa.string())], names=["node", "component"])

    def merge_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, label, _, _ = _spanned(batches)
        least = np.full(len(nodes), len(nodes))
        np.minimum.at(least, label, np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[least[label]])], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(merge if kind == "string" else merge_longs, f"node {kind}, component {kind}")


def _thinned(edges: DataFrame, one_task: int) -> DataFrame:
    """Fewer edges of longs with the same components: each task keeps a forest of its own, while that takes a quarter or more away."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, x, y = _spanned(batches)
        yield pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["src", "dst"])

    n = edges.count()
    while n > one_task:
        fewer = materialise(edges.repartition(-(-n // one_task)).mapInArrow(thin, "src bigint, dst bigint"), "thinned")
        discard(edges)
        edges, before, n = fewer, n, fewer.count()
        if n > 0.75 * before:
            break
    return edges


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node that can be reached (bytewise for strings).

    Loops and repeated edges change nothing; edges with a null end are ignored; nodes are longs or strings.
    """
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()
    kind = pairs.schema["src"].dataType.simpleString()
    if kind not in ("bigint", "string"):
        raise TypeError(f"nodes must be bigint or string, not {kind}")
    if one_task is None:
        one_task = ONE_TASK if kind == "string" else ONE_TASK_LONGS
    e = materialise(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    loops = e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    links = e.filter("src <> dst")
    if kind == "bigint" and one_task:
        links = _thinned(links, one_task)
    if links.count() <= one_task:
        found = _merge_in_one_task(links)
    else:
        before = _summary(links)
        for _ in range(MOST_ROUNDS):
            after = materialise(_small_star(_large_star(links)), "stars")
            now = _summary(after)
            if links is not e and hasattr(links, "_kindred_path"):
                discard(links)
            links = after
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not converge")
        found = links.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
            links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
        )
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("src").agg(F.min("dst").alias("m"))
    moved = e.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()
