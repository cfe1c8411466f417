"""Sequential operators over the events of a run: running counts, time left, throttled emission, first times, newest entries.

Runs may be as long as a third of the table: none is ordered in one task. Rows are put into time buckets; what a bucket
needs from those before it (a count, a last time) is worked out on one row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import js_round

BUCKET_SECONDS = 3600


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _bucketed(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    return events.withColumns({"_us": micros(ts), "_bucket": F.floor(micros(ts) / (seconds * 1_000_000))})


def running_count(events: DataFrame, run: str, ts: str, tie: str, name: str = "current", seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds how many events of its run came up to and with each, and ``total``, those of the whole run."""
    rows = _bucketed(events, ts, seconds)
    sizes = rows.groupBy(run, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(run).alias("_run"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(run)).alias("total"))
    within = Window.partitionBy(run, "_bucket").orderBy(ts, tie)
    placed = rows.withColumn("_place", F.row_number().over(within))
    joined = placed.join(offsets, placed[run].eqNullSafe(offsets["_run"]) & (placed["_bucket"] == offsets["_b"]))
    return joined.withColumn(name, F.col("_offset") + F.col("_place")).drop("_us", "_bucket", "_run", "_b", "_offset", "_place")


def percent_complete(current: Column, total: Column) -> Column:
    return F.when(total > 0, js_round(current * 100.0 / total)).otherwise(0).cast("long")


def time_left(elapsed_ms: Column, current: Column, total: Column) -> Column:
    """Milliseconds left at the pace so far; null before the first and after the last."""
    return F.when((current > 0) & (total > current), js_round(elapsed_ms / current * (total - current))).cast("long")


def throttled(events: DataFrame, run: str, ts: str, tie: str, gap_ms: int = 500, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The events of each run that are emitted if two emissions are at least ``gap_ms`` apart: the first, then each first one late enough.

    An event ``gap_ms`` after the one before it is emitted whatever came earlier, so runs fall apart into stretches there;
    a stretch is folded as a sorted stream and holds one number in memory.
    """
    rows = _bucketed(events, ts, seconds)
    ends = rows.groupBy(run, "_bucket").agg(F.max("_us").alias("_last"))
    prior = ends.select(F.col(run).alias("_run"), F.col("_bucket").alias("_b"), F.lag("_last").over(Window.partitionBy(run).orderBy("_bucket")).alias("_prior"))
    within = Window.partitionBy(run, "_bucket").orderBy("_us", tie)
    joined = rows.join(prior, rows[run].eqNullSafe(prior["_run"]) & (rows["_bucket"] == prior["_b"])).drop("_run", "_b")
    since = F.col("_us") - F.coalesce(F.lag("_us").over(within), F.col("_prior"))
    marked = joined.withColumn("_opens", F.when(since.isNull() | (since >= gap_ms * 1000), F.col("_us")))
    opened = marked.groupBy(run, "_bucket").agg(F.max("_opens").alias("_open"))
    carried = opened.select(F.col(run).alias("_run"), F.col("_bucket").alias("_b"), F.last("_open", ignorenulls=True).over(Window.partitionBy(run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    named = marked.join(carried, marked[run].eqNullSafe(carried["_run"]) & (marked["_bucket"] == carried["_b"])).drop("_run", "_b")
    stretch = F.coalesce(F.max("_opens").over(within.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried"))
    ready = named.withColumn("_stretch", stretch).select(*events.columns, "_us", F.xxhash64(F.col(run)).alias("_who"), "_stretch")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, 0
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (who, s, us) in enumerate(zip(b.column("_who").to_pylist(), b.column("_stretch").to_pylist(), b.column("_us").to_pylist())):
                if (who, s) != held or us - last >= gap_ms * 1000:
                    held, last, keep[k] = (who, s), us, True
            yield b.filter(pa.array(keep)).drop_columns(["_us", "_who", "_stretch"])

    return ready.repartition("_who", "_stretch").sortWithinPartitions("_who", "_stretch", "_us", tie).mapInArrow(fold, events.schema)


def first_times(events: DataFrame, run: str, ts: str, kind: str, first_file: str, first_hash: str) -> DataFrame:
    """Per run the start and the milliseconds to the first event of either kind."""
    at = lambda name: F.min(F.when(F.col(kind) == name, millis(ts)))
    start = F.min(millis(ts))
    return events.groupBy(run).agg((at(first_file) - start).alias("time_to_first_file_ms"), (at(first_hash) - start).alias("time_to_first_hash_ms"))


def recent(events: DataFrame, ts: str, tie: str, k: int = 24) -> DataFrame:
    """The ``k`` newest entries, newest first."""
    return events.orderBy(F.desc(ts), F.desc(tie)).limit(k)
