from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kindred import schemas
from kindred.operators import cache

NOW = datetime(2024, 6, 1)
GOOD = ["00112233445566ff"]


def row(path, version=1, algorithm=schemas.ALGORITHM_VERSION, hashes=GOOD, size=10, mtime=1000.0, at=NOW):
    return (version, algorithm, path, path, hashes, size, mtime, at)


def files(spark, paths):
    return spark.createDataFrame([(p, p, 10, 1000.0) for p in paths], "path string, basename string, size long, mtime_ms double")


CASES = {
    "good": (row("good"), "valid"),
    "upper": (row("upper", hashes=["00112233445566FF"]), "valid"),
    "half": (row("half", mtime=1000.5), "valid"),
    "whole": (row("whole", mtime=1001.0), "stale"),
    "version": (row("version", version=2), "stale"),
    "algorithm": (row("algorithm", algorithm="other"), "stale"),
    "none": (row("none", hashes=[]), "stale"),
    "null": (row("null", hashes=None), "stale"),
    "short": (row("short", hashes=["123"]), "stale"),
    "one bad": (row("one bad", hashes=[*GOOD, "zz"]), "stale"),
    "size": (row("size", size=11), "stale"),
}


def test_classify(spark):
    held = spark.createDataFrame([c for c, _ in CASES.values()], schemas.CACHE)
    got = {r.path: (r.status, r.hashes) for r in cache.classify(files(spark, [*CASES, "new"]), held).collect()}
    assert got.pop("new") == ("missing", None)
    assert {p: s for p, (s, _) in got.items()} == {p: s for p, (_, s) in CASES.items()}
    assert got["good"][1] == GOOD and got["size"][1] is None
    known = cache.classify(files(spark, [*CASES, "new"]), held)
    assert tuple(cache.counts(known).first()) == (12, 3, 8, 1)
    assert cache.stats(known).first().asDict() == {"hits": 3, "misses": 1, "stale": 8, "writes": 9, "errors": 0}
    assert cache.stats(known, True).first().asDict() == {"hits": 0, "misses": 12, "stale": 0, "writes": 12, "errors": 0}


def test_upkeep(spark):
    held = spark.createDataFrame([row("a"), row("b"), row("old", at=NOW - timedelta(days=400))], schemas.CACHE)
    assert {r.file_path for r in cache.unexpired(held, F.lit(NOW)).collect()} == {"a", "b"}
    fresh = cache.cache_rows(files(spark, ["b", "c"]).withColumn("hashes", F.array(F.lit("f" * 16), F.lit("f" * 16))), F.lit(NOW))
    merged = {r.file_path: r.hashes for r in cache.upsert(held, fresh).collect()}
    assert merged == {"a": GOOD, "b": ["f" * 16], "c": ["f" * 16], "old": GOOD}
    assert {r.file_path for r in cache.prune(held, files(spark, ["a", "x"])).collect()} == {"a"}
    assert [r.file_path for r in cache.newest(held, 2).collect()] == ["a", "b"]
    i = cache.info(files(spark, ["a", "x"]), held, "/f").first()
    assert (i.current_image_count, i.valid_entry_count, i.missing_entry_count, i.total_entries, i.ttl_days) == (2, 1, 1, 3, 365)


def test_store(spark, tmp_path):
    store = cache.HashCache(spark, f"file://{tmp_path}", "/Some/Folder")
    assert store.path.endswith(cache.HashCache(spark, f"file://{tmp_path}", "/some/folder").path.rsplit("/", 1)[1])
    assert store.read().count() == 0 and store.size_bytes() == 0 and store.updated_at() is None
    now = datetime.now()
    for k in range(4):
        store.save(cache.upsert(store.read(), spark.createDataFrame([row(f"p{k}", at=now)], schemas.CACHE)))
    assert {r.file_path for r in store.read().collect()} == {"p0", "p1", "p2", "p3"}
    assert store.size_bytes() > 0 and store.updated_at().endswith("Z") and len(store._versions()) == 2
    store.save(store.read(), most=2)
    assert store.read().count() == 2
    store.clear()
    assert store.read().count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], schemas.CACHE)
    assert cache.classify(files(spark, ["a"]), none).first().status == "missing"
    assert tuple(cache.counts(cache.classify(files(spark, []), none)).first()) == (0, 0, 0, 0)
