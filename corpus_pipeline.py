"""Corpus preparation: quality, near duplicates, test items, mixing, shards.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns what goes on. ``run`` applies them to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.anchors import NO_ID, key_columns, unused
from kindred.llm.decontaminate import drop_contaminated
from kindred.llm.mixing import mix_sources
from kindred.llm.quality import keep_good
from kindred.llm.queries import table
from kindred.llm.sharding import kd_shards
from kindred.llm.simhash import near_duplicates
from kindred.shared import discard, materialise, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; null and empty texts are judged like any other, repeated rows alike. Without labels all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one of least id, once.

    A document is known by its id and 128 bits of its text. Those without an id come after all others, by their texts. Null and empty
    texts are linked like any other. Of rows that agree in id and text the one of least source stays. An empty table stays empty.
    """
    key, n = unused(docs, "key", "n")
    rid, *text = key_columns("doc_id", "text")
    last = F.when(F.col("doc_id").isNull(), F.lit((1 << 63) - 1)).otherwise(rid).alias("rid")
    keyed = docs.withColumn(key, F.struct(last, *text))
    near = near_duplicates(keyed, id_col=key)
    first = near.filter(F.col(key) == F.col("component_id")).select(key).distinct()
    once = Window.partitionBy(key).orderBy("source")
    return keyed.join(first, key, "left_semi").withColumn(n, F.row_number().over(once)).filter(F.col(n) == 1).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none. Repeated rows all stay or all go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Rows that agree in id and text are taken as often as the most favoured of them. Documents without words are taken with their blocks.
    An empty table stays empty.
    """
    r, a, b, copies, copy = unused(docs, "rid", "t1", "t2", "copies", "copy")
    keyed = docs.withColumns(dict(zip((r, a, b), key_columns("doc_id", "text"))))
    drawn = mix_sources(docs).filter("copies > 0").withColumn("rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    drawn = drawn.groupBy(F.col("rid").alias(r), F.col("t1").alias(a), F.col("t2").alias(b)).agg(F.max("copies").alias(copies))
    return keyed.join(drawn, [r, a, b]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix; null texts count as empty, and each repeated row has a slot of its own."""
    return kd_shards(docs, shards=24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the fingerprints can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again, and what it needed goes with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            done = materialise(stage(spark, docs, sf_dir), name)
            kept.add(done._kindred_path)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
