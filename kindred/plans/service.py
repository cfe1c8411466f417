"""What a user calls: scan a folder, match again, preview it, look into its cache, clear it, cancel."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.config import THRESHOLD_CONF, resolve_threshold
from kindred.operators import cache as hash_cache
from kindred.operators.groups import build_groups, components, summary
from kindred.shared import materialise, shared_dir
from kindred.sources import decode, discovery

TAG = "kindred-scan"


class CacheIncomplete(RuntimeError):
    """Matching again needs the hashes of all files."""


@dataclass
class DetectionResult:
    """A scan's result. ``groups`` has GROUPS rows."""

    folder: str
    threshold: int
    scanned_file_count: int
    elapsed_ms: float
    groups: DataFrame
    summary: DataFrame
    warnings: list[str] = field(default_factory=list)
    cache_stats: dict[str, int] | None = None
    mode: str = "fast"
    library: str = "spark"


def session(name: str = "kindred", **conf: str) -> SparkSession:
    """A session with the settings that image batches need; ``conf`` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


class Engine:
    """All calls over one session and one cache folder."""

    def __init__(self, spark: SparkSession, cache_root: str | None = None, hash_files: Callable[[SparkSession, DataFrame, str], DataFrame] = decode.hash_files, on_update: Callable[[dict], None] | None = None):
        self.spark, self.hash_files, self.on_update = spark, hash_files, on_update or (lambda update: None)
        self.cache_root = cache_root or f"{shared_dir(spark)}/image-hash-cache"
        self.cancelled = False

    def _threshold(self, value: object) -> int:
        return resolve_threshold(value, self.spark.conf.get(THRESHOLD_CONF, None))

    def _cache(self, folder: str) -> hash_cache.HashCache:
        return hash_cache.HashCache(self.spark, self.cache_root, folder)

    def _progress(self, phase: str, current: int, total: int, began: float) -> None:
        elapsed = (time.monotonic() - began) * 1000
        left = round(elapsed / current * (total - current)) if 0 < current < total else None
        self.on_update({"type": "progress", "phase": phase, "current_file": current, "total_files": total, "percent_complete": int(current * 100 / total + 0.5) if total else 0, "estimated_time_remaining_ms": left})

    def scan(self, folder: str, threshold: object = None, force_refresh: bool = False, mode: str = "exact", on_error: str = "fail", underscores: bool = False) -> DetectionResult | None:
        """Hashes what the cache doesn't hold and groups all images; None if cancelled.

        The cache is brought up to date, and rows of files that are gone are dropped, only when all files were hashed.
        """
        path = discovery.validate_folder(self.spark, folder)
        limit = self._threshold(threshold)
        began, self.cancelled = time.monotonic(), False
        self.spark.addTag(TAG)
        try:
            files = materialise(discovery.discover(self.spark, path, underscores), "files")
            total = files.count()
            self._progress("discovering", total, total, began)
            cache = self._cache(path)
            kept = cache.read()
            known = materialise(hash_cache.classify(files, kept), "classified")
            stats = hash_cache.stats(known, force_refresh).first().asDict()
            todo = known if force_refresh else known.filter("status <> 'valid'")
            fresh = materialise(self.hash_files(self.spark, todo, on_error), "hashes")
            warnings = [r["error"] for r in fresh.filter("error is not null").orderBy("path").toLocalIterator()]
            stats["errors"], stats["writes"] = len(warnings), stats["writes"] - len(warnings)
            self._progress("hashing", total, total, began)
            hashed = files.join(fresh.filter("error is null").select("path", "hashes"), "path")
            held = known.filter("status = 'valid'").select(*files.columns, "hashes")
            records = materialise((hashed if force_refresh else hashed.unionByName(held)).select("path", "basename", "ord", "hashes", "size", "mtime_ms"), "records")
            self._progress("comparing", 0, total, began)
            membership = materialise(components(records, limit, mode), "membership")
            groups = materialise(build_groups(records, membership), "groups").orderBy(F.desc("size"), "min_ord")
            self._progress("comparing", total, total, began)
            cache.save(hash_cache.prune(hash_cache.upsert(kept, hash_cache.cache_rows(hashed)), files))
        except PySparkException as error:
            if self.cancelled:
                self.on_update({"type": "cancelled"})
                return None
            self.on_update({"type": "error", "message": str(error)})
            raise
        finally:
            self.spark.removeTag(TAG)
        elapsed = (time.monotonic() - began) * 1000
        result = DetectionResult(path, limit, total, elapsed, groups, summary(groups.select("size"), total, elapsed), warnings, stats)
        self.on_update({"type": "complete", "result": result})
        return result

    def rematch(self, folder: str, threshold: object = None, mode: str = "exact", underscores: bool = False) -> DetectionResult:
        """Groups by another threshold from cached hashes alone."""
        path = discovery.validate_folder(self.spark, folder)
        limit = self._threshold(threshold)
        began = time.monotonic()
        known = materialise(hash_cache.classify(discovery.discover(self.spark, path, underscores), self._cache(path).read()), "classified")
        n = hash_cache.counts(known).first()
        if n["valid"] < n["files"]:
            raise CacheIncomplete(f"The cache lacks current hashes of {n['files'] - n['valid']} of {n['files']} images. Scan the folder or refresh its cache first.")
        membership = materialise(components(known, limit, mode), "membership")
        groups = materialise(build_groups(known, membership), "groups").orderBy(F.desc("size"), "min_ord")
        elapsed = (time.monotonic() - began) * 1000
        stats = {"hits": n["files"], "misses": 0, "stale": 0, "writes": 0, "errors": 0}
        return DetectionResult(path, limit, n["files"], elapsed, groups, summary(groups.select("size"), n["files"], elapsed), [], stats)

    def preview(self, folder: str, underscores: bool = False) -> dict:
        row = discovery.preview(discovery.discover(self.spark, folder, underscores)).first()
        return {"image_count": row["image_count"], "samples": list(row["samples"]), "overflow": row["overflow"]}

    def cache_info(self, folder: str, underscores: bool = False) -> dict:
        path = discovery.validate_folder(self.spark, folder)
        cache = self._cache(path)
        return hash_cache.info(discovery.list_files(self.spark, path, underscores), cache.read(), path, cache.path, cache.size_bytes(), cache.updated_at()).first().asDict()

    def clear_cache(self, folder: str) -> dict:
        self._cache(discovery.validate_folder(self.spark, folder)).clear()
        return self.cache_info(folder)

    def cancel(self) -> None:
        """Ends a scan that runs in another thread: it returns None, and the cache stays as it was."""
        self.cancelled = True
        self.spark.interruptTag(TAG)
