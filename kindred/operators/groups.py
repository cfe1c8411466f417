"""From hashed records to duplicate groups and their report.

A record is (path, ord, hashes). Records are linked where any of their hashes lie within the threshold; groups are the
connected components, named by their least path, ordered by size, then by their first record.

Components are those of the records' keys, the least of their hashes, so equal records are one node, and a hash stands for the
least key that it comes with. A null hash is left out; a malformed one is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import bits_of, evidence, first_hash
from kindred.functions.text import js_round
from kindred.operators.components import connected_components
from kindred.operators.simjoin import spanning_join, spanning_self_join
from kindred.shared import materialise


def exploded(records: DataFrame) -> DataFrame:
    """(path, ord, hash), one row per hash."""
    return records.select("path", "ord", F.explode(F.array_distinct("hashes")).alias("hash"))


def first_per_hash(records: DataFrame) -> DataFrame:
    """(hash, path, files): the first record with each hash, and how many have it."""
    return exploded(records).groupBy("hash").agg(F.min_by("path", "ord").alias("path"), F.count("*").alias("files"))


def index_size(records: DataFrame) -> DataFrame:
    return exploded(records).agg(F.count_distinct("hash").alias("hashes"))


def _all_bits(hashes: Column) -> Column:
    bits = lambda h: F.when(bits_of(h).isNotNull(), bits_of(h)).otherwise(F.raise_error(F.concat(F.lit("not a 16-digit hash: "), h)).cast("long"))
    return F.transform(F.filter(hashes, lambda h: h.isNotNull()), bits)


def record_key(hashes: Column) -> Column:
    """The node of a record: the least of its hashes as bits; null where it has none."""
    return F.array_min(_all_bits(hashes))


def hash_keys(records: DataFrame) -> DataFrame:
    """(key, bits), each once: the keys of the records that have a hash."""
    return records.select(_all_bits(F.col("hashes")).alias("all")).select(F.array_min("all").alias("key"), F.explode("all").alias("bits")).distinct()


def hash_owners(keys: DataFrame) -> DataFrame:
    """(bits, key) of distinct hashes: each with the least key that it comes with."""
    return keys.groupBy("bits").agg(F.min("key").alias("key"))


def same_hash_links(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst, dist) that connect the keys of a hash."""
    held = owners.withColumnRenamed("key", "owner")
    return keys.join(held, "bits").filter("key <> owner").select(F.col("key").alias("src"), F.col("owner").alias("dst"), F.lit(0).alias("dist")).distinct()


def links(records: DataFrame, thresholds: int | Sequence[int], mode: str = "exact") -> DataFrame:
    """(src, dst, dist) over the records' keys: those with dist up to one of the ``thresholds`` connect what matches within it.

    They span the matches; there are no more than keys of each tile of the join, however many pairs match.
    """
    keys = materialise(hash_keys(records), "keys")
    owners = materialise(hash_owners(keys), "owners")
    return same_hash_links(keys, owners).unionByName(spanning_self_join(owners, [thresholds] if isinstance(thresholds, int) else thresholds, mode))


def links_to(owners: DataFrame, index: DataFrame, threshold: int, mode: str = "exact") -> DataFrame:
    """(src, dst, dist) that connect the keys of ``owners`` with those of ``index`` that match them."""
    return spanning_join(owners, index, [threshold], mode)


def membership(records: DataFrame, found: DataFrame) -> DataFrame:
    """(path, id) of every record from the components of the keys; id is the least path of the component, a record's own path if it has no hash."""
    of_key = records.select("path", record_key(F.col("hashes")).alias("key"))
    held = materialise(of_key.join(found, F.col("key") == F.col("node"), "left").select("path", F.coalesce("component", "key").alias("component")), "labels")
    ids = held.filter("component is not null").groupBy("component").agg(F.min("path").alias("id"))
    return held.join(ids, "component", "left").select("path", F.coalesce("id", "path").alias("id"))


def components(records: DataFrame, threshold: int, mode: str = "exact") -> DataFrame:
    """(path, id) of every record; id is the least path of its group."""
    if threshold < 0:
        return records.select("path", F.col("path").alias("id"))
    return membership(records, connected_components(links(records, threshold, mode)))


def sizes_at(records: DataFrame, thresholds: Sequence[int], mode: str = "exact") -> dict[int, DataFrame]:
    """For each threshold the (size) of its groups of more than one file, all from one join."""
    held = materialise(links(records, thresholds, mode), "links")
    keys = materialise(records.groupBy(record_key(F.col("hashes")).alias("key")).agg(F.count("*").alias("n")).filter("key is not null"), "counts")
    out = {}
    for t in thresholds:
        found = keys.join(connected_components(held.filter(F.col("dist") <= t)), F.col("key") == F.col("node"), "left")
        out[t] = found.groupBy(F.coalesce("component", "key").alias("id")).agg(F.sum("n").alias("size")).filter("size > 1").select("size")
    return out


def build_groups(records: DataFrame, membership: DataFrame) -> DataFrame:
    """GROUPS rows of more than one file, largest first, then by first record."""
    rows = records.select("path", "ord", "hashes").join(membership, "path")
    made = rows.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "path"))).alias("members"),
        F.count("*").alias("size"),
        F.min("ord").alias("min_ord"),
        F.min_by(F.struct("path", "hashes"), "ord").alias("lead"),
    )
    return (
        made.filter("size > 1")
        .select(
            "id",
            F.lit("fast").alias("kind"),
            F.col("lead.path").alias("representative"),
            F.transform("members", lambda m: m["path"]).alias("files"),
            evidence(first_hash(F.col("lead.hashes"))).alias("evidence"),
            F.lit(None).cast("double").alias("score"),
            "size",
            "min_ord",
        )
        .orderBy(F.desc("size"), "min_ord")
    )


def group_sizes(membership: DataFrame) -> DataFrame:
    """(id, size) of the groups of more than one file."""
    return membership.groupBy("id").agg(F.count("*").alias("size")).filter("size > 1")


def duplicate_groups(records: DataFrame, threshold: int, mode: str = "exact") -> DataFrame:
    return build_groups(records, components(records, threshold, mode))


def summary(sizes: DataFrame, scanned: int | DataFrame, elapsed_ms: float | None = None) -> DataFrame:
    """One row: groups, grouped and removable files, unique images, largest group, duplicate rate in percent, files a second."""
    made = sizes.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("grouped"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("removable"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
    )
    total = made.crossJoin(scanned.agg(F.count("*").alias("scanned"))) if isinstance(scanned, DataFrame) else made.withColumn("scanned", F.lit(scanned).cast("long"))
    rate = F.when(F.col("scanned") > 0, F.col("grouped") * 100.0 / F.col("scanned")).otherwise(0.0)
    speed = F.lit(None).cast("double") if not elapsed_ms else F.col("scanned") / F.lit(elapsed_ms / 1000)
    return total.withColumns({"unique_images": F.col("scanned") - F.col("grouped"), "duplicate_rate": rate, "per_second": speed})


def summary_text(made: DataFrame) -> DataFrame:
    """The summary as shown: counts grouped by thousands, the rate with a decimal."""
    shown = {c: F.format_number(c, 0) for c in ("groups", "grouped", "removable", "unique_images", "largest", "scanned")}
    rate = F.when(F.col("scanned") > 0, F.concat(F.format_string("%.1f", F.round("duplicate_rate", 1)), F.lit("%"))).otherwise(F.lit("0%"))
    speed = F.when(F.col("per_second").isNull(), F.lit("—")).otherwise(F.concat(F.format_string("%.1f", F.round("per_second", 1)), F.lit(" img/s")))
    return made.select(*[c.alias(n) for n, c in shown.items()], rate.alias("duplicate_rate"), speed.alias("per_second"))


def removal_candidates(records: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, representative, path): every file of a group but the one that stands for it. Joins by id, so no group is gathered in one task."""
    rows = records.select("path", "ord").join(membership, "path")
    lead = rows.groupBy("id").agg(F.count("*").alias("size"), F.min_by("path", "ord").alias("representative")).filter("size > 1")
    return rows.join(lead, "id").filter("path <> representative").select("id", "representative", "path")


def report(groups: DataFrame) -> DataFrame:
    """One row per group as a report shows it: what can go, and how many files stay folded away."""
    return groups.select("id", "representative", "evidence", "size", (F.col("size") - 1).alias("removable"), F.greatest(F.col("size") - 4, F.lit(0)).alias("folded"), "files")


def matches(records: DataFrame, index: DataFrame, threshold: int, mode: str = "exact") -> DataFrame:
    """(path, hash, match, file_path, dist): what a query of each record's hashes against an index of other records gives."""
    from kindred.operators.simjoin import similarity_join

    probe, held = exploded(records), first_per_hash(index).select(F.col("hash").alias("match"), F.col("path").alias("file_path"))
    found = similarity_join(probe, held.select(F.col("match").alias("hash")), threshold, "hash", mode)
    return probe.select("path", "hash").join(found, "hash").join(held, "match").select("path", "hash", "match", "file_path", "dist")


def percent(part, total):  # noqa: ANN001, ANN201
    """Whole percents of two columns, half up; 0 of 0 is 0."""
    return F.when(total > 0, js_round(part * 100.0 / total)).otherwise(0).cast("long")
