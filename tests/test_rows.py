"""Strings, logs, progress, ordering and streams."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions import text
from kindred.operators import progress
from kindred.operators.ordering import numbered
from kindred.sources import logs
from kindred.streaming.incremental import IncrementalGroups


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.basename, "/a/b.png", "b.png"),
        (text.file_name, "a/b\\c.png", "c.png"),
        (text.file_name, "a/b/", "b"),
        (text.file_name, "//", "//"),
        (text.directory, "C:\\x/y.png", "C:\\x"),
        (text.directory, "y.png", ""),
        (text.escape_html, "<tag>'\"&", "&lt;tag&gt;&#39;&quot;&amp;"),
        (lambda c: text.shorten_middle(c, 10), "abcdefghijkl", "abcdef…jkl"),
        (lambda c: text.shorten_middle(c, 12), "abcdefghijkl", "abcdefghijkl"),
        (text.file_url, "C:\\a b\\ä.png", "file://C:/a%20b/%C3%A4.png"),
        (text.phase_label, "comparing", "comparing matches"),
        (text.phase_label, "else", "discovering files"),
        (lambda c: text.phase_state(c, "hashing"), "hashing", "active"),
        (lambda c: text.phase_state(c, "hashing"), "complete", "completed"),
        (lambda c: text.phase_state(c, "comparing"), "hashing", "pending"),
    ],
)
def test_strings(spark, f, value, want):
    assert one(spark, value, f) == want


def test_numbers(spark):
    shown = [one(spark, ms, text.format_duration, "long") for ms in (999, 1000, 12345, 59999, 60000, 119999)]
    assert shown == ["999 ms", "1.0 s", "12.3 s", "60.0 s", "1m 0s", "1m 60s"]
    assert one(spark, 1234567, text.grouped_number, "long") == "1,234,567"
    row = spark.createDataFrame([(75, 190, "comparing", 1000, 61000), (10, 20, "hashing", 2000, 2000)], "c long, t long, p string, e long, l long")
    lines = [r.x for r in row.select(text.progress_text(*[F.col(k) for k in "ctpel"]).alias("x")).collect()]
    assert lines == ["75/190 comparisons • ~2m remaining", "10/20 images • 5.0 img/s • ~2s remaining"]
    info = spark.createDataFrame([(3, 1, 2, 0, 365), (0, 0, 0, 0, 365)], "i long, v long, m long, s long, t int")
    assert [r.x for r in info.select(text.cache_text(*[F.col(k) for k in "ivmst"]).alias("x")).collect()] == ["Cache: 1/3 image hashes ready, 2 missing. TTL 365 days.", "Cache: no images in selected folder. TTL 365 days."]


def test_logs(spark, tmp_path):
    at = datetime(2024, 1, 2, 3, 4, 5, 678000, UTC)
    entry = logs.log_entry("scan", "done", {"when": at, "big": 1 << 60, "list": [1, None], "error": ValueError("bad")}, at=at)
    assert entry["timestamp"] == "2024-01-02T03:04:05.678Z" and entry["details"]["big"] == str(1 << 60) and entry["details"]["error"]["name"] == "ValueError"
    assert "details" not in logs.log_entry("main", "start")
    with pytest.raises(ValueError):
        logs.log_entry("main", "x", level="debug")
    for _ in range(2):
        logs.append_logs(logs.log_rows(spark, [entry, logs.log_entry("main", "start", at=at)]), str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert back.count() == 4 and {r.scope for r in back.collect()} == {"main", "scan"}
    made = spark.createDataFrame([(at, "warn", None)], "t timestamp, l string, d string").select(logs.entry_column(F.col("t"), F.col("l"), F.lit("main"), F.lit("e"), F.col("d")).alias("j")).first().j
    assert json.loads(made) == {"timestamp": "2024-01-02T03:04:05.678Z", "level": "warn", "scope": "main", "event": "e"}


def events(spark, seed=1, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(i, 7 if rng.random() < 0.5 else rng.randrange(5), start + timedelta(milliseconds=rng.randrange(0, 40_000_000) if rng.random() < 0.3 else rng.randrange(0, 60_000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, run long, ts timestamp")


def test_progress(spark):
    rows, df = events(spark)
    got = {r.id: (r.current, r.total) for r in progress.running_count(df, "run", "ts", "id", seconds=30).collect()}
    kept = {r.id for r in progress.throttled(df, "run", "ts", "id", gap_ms=500, seconds=30).collect()}
    want, emitted = {}, set()
    for run in {r for _, r, _ in rows}:
        own = sorted((t, i) for i, r, t in rows if r == run)
        last = None
        for k, (t, i) in enumerate(own):
            want[i] = (k + 1, len(own))
            if last is None or t - last >= timedelta(milliseconds=500):
                last = t
                emitted.add(i)
    assert got == want and kept == emitted
    eta = spark.createDataFrame([(1000, 1, 4), (1000, 4, 4), (5, 0, 4)], "e long, c long, t long").select(progress.time_left(F.col("e"), F.col("c"), F.col("t")).alias("x")).collect()
    assert [r.x for r in eta] == [3000, None, None]
    assert [r.id for r in progress.recent(df, "ts", "id", 3).collect()] == [i for _, i in sorted(((t, i) for i, _, t in rows), reverse=True)[:3]]


def test_numbered(spark):
    rows, df = events(spark, 2)
    got = {r.id: r.ord for r in numbered(df, F.col("ts"), F.col("id")).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((t, i) for i, _, t in rows))}


def test_locale_order(spark):
    from kindred.sources.discovery import from_paths

    paths = spark.createDataFrame([(f"{p}.png",) for p in ("Z", "z", "é", "B", "a", "9", "10", "_x")], "path string")
    assert [r.basename[:-4] for r in from_paths(paths).orderBy("ord").collect()] == ["_x", "10", "9", "a", "B", "é", "z", "Z"]


RECORDS = [("a", ["0" * 16]), ("b", ["000000000000001f"]), ("c", ["00000000000003e0"]), ("d", ["f" * 16]), ("e", ["fffffffffffffff0", "00ff00ff00ff00ff"]), ("f", ["1234567812345678"])]


@pytest.mark.parametrize("seed", range(4))
def test_any_split_gives_the_same_groups(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(p, p, k, h) for k, (p, h) in enumerate(RECORDS)]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    seen = []
    engine = IncrementalGroups(spark, str(tmp_path / "state"), 5, on_snapshot=lambda groups, n: seen.append((n, groups.count())), gap=0)
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for n, part in enumerate(parts):
        engine.process(spark.createDataFrame(part, schemas.HASHED), n)
    engine.process(spark.createDataFrame(parts[-1], schemas.HASHED), len(parts) - 1)  # a batch that is run again
    assert [(r.id, r.files) for r in engine.groups().collect()] == [("a", ["a", "b", "c"]), ("d", ["d", "e"])]
    assert [n for n, _ in seen] == [0, 1, 2, 2]


def test_snapshots_are_throttled(spark, tmp_path):
    now = iter([0.0, 0.2, 0.6, 0.9])
    seen = []
    engine = IncrementalGroups(spark, str(tmp_path / "state"), 5, on_snapshot=lambda groups, n: seen.append(n), clock=lambda: next(now))
    for n, (p, h) in enumerate(RECORDS[:4]):
        engine.process(spark.createDataFrame([(p, p, n, h)], schemas.HASHED), n)
    assert seen == [0, 2]


def test_stream(spark, tmp_path):
    rows = [(p, p, k, h) for k, (p, h) in enumerate(RECORDS)]
    spark.createDataFrame(rows, schemas.HASHED).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.HASHED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    engine = IncrementalGroups(spark, str(tmp_path / "state"), 5)
    engine.start(stream, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert [r.files for r in engine.groups().collect()] == [["a", "b", "c"], ["d", "e"]]
