"""The hash cache: which files' hashes are still good, and how the table is kept.

Files are (path, basename, size, mtime_ms); cache rows have schemas.CACHE. A row is good for its file if version, path, size
and modification time (within a millisecond) agree and its hashes are well-formed. Expired rows count as missing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions.hashing import VALID


def is_valid(path: str = "path", size: str = "size", mtime: str = "mtime_ms", row: str = "cached") -> Column:
    """Over a file joined with a struct ``row`` of its cache row."""
    c = lambda name: F.col(f"{row}.{name}")
    checks = [
        c("file_path").isNotNull(),
        c("schema_version") == schemas.SCHEMA_VERSION,
        c("algorithm_version") == schemas.ALGORITHM_VERSION,
        c("file_path") == F.col(path),
        F.size(c("hashes")) > 0,
        F.forall(c("hashes"), lambda h: F.coalesce(h.rlike(VALID), F.lit(False))),
        c("size") == F.col(size),
        F.abs(c("mtime_ms") - F.col(mtime)) < 1,
    ]
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out


def unexpired(cache: DataFrame, now: Column | None = None, ttl_days: int = schemas.CACHE_TTL_DAYS) -> DataFrame:
    moment = F.current_timestamp() if now is None else now
    return cache.filter(F.col("cached_at") > moment - F.make_interval(days=F.lit(ttl_days)))


def classify(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with status 'valid', 'stale' or 'missing', and the cached hashes where valid."""
    rows = cache.select(F.col("file_path").alias("_path"), F.struct(*cache.columns).alias("cached"))
    joined = files.join(rows, F.col("path") == F.col("_path"), "left")
    status = F.when(F.col("cached").isNull(), "missing").when(is_valid(), "valid").otherwise("stale")
    return joined.withColumn("status", status).withColumn("hashes", F.when(F.col("status") == "valid", F.col("cached.hashes"))).drop("_path", "cached")


def counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "missing").alias("missing")
    )


def stats(classified: DataFrame, force_refresh: bool = False) -> DataFrame:
    """hits, misses, stale, writes and errors of a run over classified files. A forced refresh misses every file."""
    status = F.lit("missing") if force_refresh else F.col("status")
    hit = status == "valid"
    return classified.agg(
        F.count_if(hit).alias("hits"), F.count_if(status == "missing").alias("misses"), F.count_if(status == "stale").alias("stale"), F.count_if(~hit).alias("writes"), F.lit(0).cast("long").alias("errors")
    )


def cache_rows(hashed: DataFrame, at: Column | None = None) -> DataFrame:
    """Cache rows of freshly hashed files (path, basename, hashes, size, mtime_ms)."""
    return hashed.select(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        F.lit(schemas.ALGORITHM_VERSION).alias("algorithm_version"),
        F.col("path").alias("file_path"),
        "basename",
        F.array_distinct("hashes").alias("hashes"),
        F.col("size").cast("long").alias("size"),
        F.col("mtime_ms").cast("double").alias("mtime_ms"),
        (F.current_timestamp() if at is None else at).cast("timestamp").alias("cached_at"),
    )


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows replace those of the same path."""
    return fresh.unionByName(cache.join(fresh.select("file_path"), "file_path", "left_anti").select(fresh.columns))


def prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Only rows whose file was seen."""
    return cache.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(cache.columns)


def newest(cache: DataFrame, most: int = schemas.CACHE_ROWS) -> DataFrame:
    """The ``most`` rows cached last; ties by path. A limit of the feature: the cache's size."""
    return cache.orderBy(F.desc("cached_at"), "file_path").limit(most)


def info(files: DataFrame, cache: DataFrame, folder: str = "", path: str = "", size_bytes: int = 0, updated_at: str | None = None) -> DataFrame:
    """One CACHE_INFO row."""
    made = counts(classify(files, cache)).crossJoin(cache.agg(F.count("*").alias("total_entries")))
    return made.select(
        F.lit(folder).alias("folder"), F.lit(path).alias("cache_path"), F.col("files").alias("current_image_count"), F.col("valid").alias("valid_entry_count"), F.col("stale").alias("stale_entry_count"),
        F.col("missing").alias("missing_entry_count"), "total_entries", F.lit(size_bytes).cast("long").alias("size_bytes"), F.lit(schemas.CACHE_TTL_DAYS).alias("ttl_days"), F.lit(updated_at).cast("string").alias("updated_at"),
    )


class HashCache:
    """A folder's cache as Parquet below ``root``: each save writes a new version, then points to it, so readers and failures never see half a table."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        import hashlib

        self.spark, self.folder = spark, folder
        self.path = f"{root.rstrip('/')}/folder-{hashlib.sha256(folder.lower().encode()).hexdigest()[:32]}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, str]]:
        if not self._fs.exists(self._path(self.path)):
            return []
        listed = [s.getPath() for s in self._fs.listStatus(self._path(self.path))]
        return sorted((int(p.getName()[1:].split("-")[0]), str(p.toString())) for p in listed if p.getName().startswith("v") and self._fs.exists(self._path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """Rows that haven't expired; empty where nothing was saved."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], schemas.CACHE)
        return unexpired(self.spark.read.schema(schemas.CACHE).parquet(versions[-1][1]))

    def save(self, rows: DataFrame, most: int = schemas.CACHE_ROWS) -> None:
        versions = self._versions()
        number = versions[-1][0] + 1 if versions else 1
        kept = rows.select(*schemas.CACHE.names)
        (newest(kept, most) if kept.count() > most else kept).write.parquet(f"{self.path}/v{number}-{uuid.uuid4().hex[:8]}")
        # the version before stays for readers that began with it
        for n, old in versions:
            if n < number - 1:
                self._fs.delete(self._path(old), True)

    def clear(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def size_bytes(self) -> int:
        versions = self._versions()
        return self._fs.getContentSummary(self._path(versions[-1][1])).getLength() if versions else 0

    def updated_at(self) -> str | None:
        from datetime import UTC, datetime

        versions = self._versions()
        if not versions:
            return None
        ms = self._fs.getFileStatus(self._path(versions[-1][1])).getModificationTime()
        return datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
