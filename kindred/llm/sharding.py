"""Sharding by a k-d tree over metadata: nodes are cut at weighted medians along their widest dimension.

The weighted items are groups of equal texts, placed by the metadata of their first row (least id). A node that must hold k
shards is cut where floor(k / 2) / k of its bytes lie below, along the dimension of which it spans most. The cut is found on
the whole table: bytes are summed per digit of the order key for all nodes of a level at once, and the digit that holds the
cut is opened again, until it is one group or too little to matter. Nothing is sampled, and the driver sees sums only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.ordering import numbered
from kindred.shared import discard, materialise

#: Bits of a dimension's value, and of the group's hash below it that breaks ties.
VALUE, TIE = 20, 40
DIGIT = 12
#: A group above this share of a shard's target bytes may be cut, so that shards stay near equal, into pieces of this share.
WHOLE, PIECE = 0.25, 1 / 256
PIECE_BITS = 16
#: A cut is exact enough at this share of a shard's target.
CLOSE = 1e-4
#: Rows numbered by one task.
RUN = 200_000


def _position(df: DataFrame, name: str) -> Column | None:
    """An order-preserving number of a column of numbers or times, null is least; None for any other, which ``_ranked`` numbers."""
    kind = df.schema[name].dataType.typeName()
    col = F.col(f"`{name}`")
    if kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(float("-1e18")))
    if kind in ("date", "timestamp"):
        return F.coalesce(F.unix_timestamp(col.cast("timestamp")).cast("double"), F.lit(float("-1e18")))
    return None


def _ranked(rows: DataFrame, docs: DataFrame, name: str, column: str) -> DataFrame:
    """``rows`` with the string ``column``, which holds the values of ``name``, as their rank among all of them; null is least."""
    values = docs.select(F.col(f"`{name}`").cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct()
    rank = numbered(values, F.col(column), name="rank")
    return rows.join(rank, column, "left").withColumn(column, F.coalesce(F.col("rank").cast("double"), F.lit(-1.0))).drop("rank")


def _leaf(cuts: dict[int, tuple[int, int]]) -> Column:
    """The node of a row under the cuts so far: children of node v are 2v and 2v + 1."""

    def down(v: int) -> Column:
        if v not in cuts:
            return F.lit(v).cast("long")
        dim, cut = cuts[v]
        return F.when(F.col(f"k{dim}") < F.lit(cut), down(2 * v)).otherwise(down(2 * v + 1))

    return down(1)


def _cut(groups: DataFrame, node: Column, dims: dict[int, int], goal: dict[int, float], close: float) -> dict[int, int]:
    """For each node the order key before which about ``goal`` bytes lie."""
    low = dict.fromkeys(dims, 0)
    below = dict.fromkeys(dims, 0.0)
    found: dict[int, int] = {}
    shift = VALUE + TIE
    while len(found) < len(dims) and shift > 0:
        shift = max(0, shift - DIGIT)
        span = min(DIGIT, VALUE + TIE - shift)
        open_ = [v for v in dims if v not in found]
        key = reduce(lambda c, v: c.when(F.col("node") == v, F.col(f"k{dims[v]}")), open_[1:], F.when(F.col("node") == open_[0], F.col(f"k{dims[open_[0]]}")))
        start = reduce(lambda c, v: c.when(F.col("node") == v, F.lit(low[v])), open_[1:], F.when(F.col("node") == open_[0], F.lit(low[open_[0]])))
        digit = F.shiftright(F.col("key") - F.col("low"), shift)
        seen = (
            groups.withColumn("node", node)
            .filter(F.col("node").isin(open_))
            .withColumns({"key": key, "low": start})
            .filter((F.col("key") >= F.col("low")) & (digit < (1 << span)))
            .groupBy("node", digit.alias("digit"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
            .toArrow()
            .to_pylist()
        )
        by: dict[int, list] = {v: [] for v in open_}
        for r in seen:
            by[r["node"]].append((r["digit"], r["bytes"], r["n"]))
        for v in open_:
            for digit_, b, n in sorted(by[v]):
                if below[v] + b < goal[v]:
                    below[v] += b
                    continue
                start_ = low[v] + (digit_ << shift)
                if n == 1 or b <= close or shift == 0:
                    found[v] = start_ + (1 << shift) if below[v] + b - goal[v] < goal[v] - below[v] else start_
                else:
                    low[v] = start_
                break
            else:
                found[v] = 1 << (VALUE + TIE)
    return found


def kd_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), seed: int = 5) -> DataFrame:
    """Puts every row into one of ``shards`` shards of near equal bytes, rows with equal texts into one.

    Returns one row per row of ``docs``: the id, size (UTF-8 bytes of the text plus 8), text_crc32, law ('bytes'), shard
    (0 on), slot (0 on without gaps in each shard, shuffled by a seeded hash) and grown_shard (null). Dimensions are ``dims``, the size
    and the id.

    A null text is empty; all empty texts are equal. Null metadata are least; strings stand by their rank among all distinct values. A group of equal texts that alone exceeds a
    quarter of a shard's bytes is cut by a hash of its ids, as whole it would break the equal sizes. Repeated rows are rows of one
    group, each with a slot of its own. Shards may be empty where there are fewer groups than shards. An empty table gives an
    empty result. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    known = [d for d in dims if d in docs.columns]
    placed_by = {**{f"d{k}": d for k, d in enumerate(known)}, "place": id_col}
    positions = {column: _position(docs, name) for column, name in placed_by.items()}
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("body"),
        *[(F.col(f"`{placed_by[c]}`").cast("string") if p is None else p).alias(c) for c, p in positions.items()],
    )
    for column in [c for c, p in positions.items() if p is None]:
        rows = _ranked(rows, docs, placed_by[column], column)
    rows = materialise(rows, "rows")
    every = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total, n = every["bytes"] or 0, every["n"]
    most = max(1, int(WHOLE * total / shards))
    # only groups above the limit are cut, each into as many pieces as needed
    sizes = rows.groupBy("body", "crc", "size").agg(F.count("*").alias("copies"))
    heavy = sizes.filter(F.col("copies") * F.col("size") > most).filter("copies > 1")
    pieces = F.ceil(F.col("copies") * F.col("size") / max(1.0, PIECE * total / shards))
    heavy = heavy.select("body", "crc", "size", F.least(pieces, "copies", F.lit(1 << PIECE_BITS)).cast("int").alias("parts"))
    parted = rows.join(heavy, ["body", "crc", "size"], "left").withColumn("piece", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts"))).cast("int")).drop("parts")
    parted = materialise(parted, "parted")
    meta = [f"d{k}" for k in range(len(known))]
    first = F.min(F.struct("place", *meta)).alias("m")
    groups = parted.groupBy("body", "crc", "size", "piece").agg((F.count("*") * F.col("size")).alias("bytes"), first)
    groups = groups.select("body", "crc", "size", "piece", "bytes", *[F.col(f"m.{d}").alias(d) for d in meta], F.log2("size").alias(f"d{len(meta)}"), F.col("m.place").alias(f"d{len(meta) + 1}"))
    groups = materialise(groups, "groups")
    count = len(meta) + 2
    ends = groups.agg(*[f(f"d{k}").alias(f"{name}{k}") for k in range(count) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    # equal texts stay side by side in every order: the tie is the text's hash, then the piece
    tie = F.shiftrightunsigned(F.xxhash64("body", "crc", F.lit(seed)), 64 - TIE + PIECE_BITS) * (1 << PIECE_BITS) + F.col("piece")
    cols = {}
    for k in range(count):
        lo, hi = ends[f"lo{k}"] or 0.0, ends[f"hi{k}"] or 0.0
        q = F.floor((F.col(f"d{k}") - lo) / (hi - lo) * ((1 << VALUE) - 1)) if hi > lo else F.lit(0)
        cols[f"k{k}"] = q.cast("long") * (1 << TIE) + tie
    keyed = materialise(groups.select("body", "crc", "size", "piece", "bytes", *[c.alias(name) for name, c in cols.items()]), "keyed")
    discard(groups)

    cuts: dict[int, tuple[int, int]] = {}
    wanted = {1: shards}
    while open_ := [v for v, k in wanted.items() if k > 1 and v not in cuts]:
        node = _leaf(cuts)
        widths = keyed.withColumn("node", node).filter(F.col("node").isin(open_)).groupBy("node").agg(F.sum("bytes").alias("bytes"), *[(F.max(f"k{k}") - F.min(f"k{k}")).alias(f"w{k}") for k in range(count)])
        dim, goal = {}, {}
        for r in widths.toArrow().to_pylist():
            v = r["node"]
            dim[v] = max(range(count), key=lambda k: r[f"w{k}"])
            goal[v] = r["bytes"] * (wanted[v] // 2) / wanted[v]
        cut = _cut(keyed, node, dim, goal, CLOSE * total / shards) if dim else {}
        for v in open_:
            cuts[v] = (dim.get(v, 0), cut.get(v, 0))
            wanted[2 * v], wanted[2 * v + 1] = wanted[v] // 2, wanted[v] - wanted[v] // 2
    leaves = sorted((v for v in wanted if v not in cuts), key=lambda v: bin(v)[3:])
    number = {v: k for k, v in enumerate(leaves)}
    shard = reduce(lambda c, v: c.when(F.col("node") == v, F.lit(number[v])), leaves[1:], F.when(F.col("node") == leaves[0], F.lit(0)))
    placed = keyed.withColumn("node", _leaf(cuts)).select("body", "crc", "size", "piece", shard.cast("int").alias("shard"))
    out = materialise(parted.join(placed, ["body", "crc", "size", "piece"]).select("id", "size", "crc", "body", "shard"), "placed")
    for t in (rows, parted, keyed):
        discard(t)

    # slots: rows are numbered within small runs, and runs start where the ones before end
    runs = max(1, -(-n // RUN))
    ordered = out.withColumn("run", F.pmod(F.xxhash64("id", "body", F.lit(seed + 1)), F.lit(runs)))
    lengths = ordered.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy(F.xxhash64("id", "body", F.lit(seed + 2)), "id", "body")
    numbered = ordered.withColumn("place", F.row_number().over(within) - 1).join(starts, ["shard", "run"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
