"""Row numbers in a global order, without ordering the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.shared import materialise


def numbered(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """Adds each row's place, 0 on: the table is range-partitioned and written, ranges are counted, rows numbered within their range."""
    keys = [f"_k{k}" for k in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    held = materialise(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: as many as there are shuffle partitions
    starts = held.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return held.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).select(*df.columns, name)
