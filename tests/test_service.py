import struct
import zlib

import numpy as np
import pytest

from kindred.plans.service import CacheIncomplete, Engine
from kindred.sources import decode, discovery


def png(path, pixels):
    """Writes (h, w) or (h, w, 3) bytes as PNG."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    body = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))


def picture(seed, side=96):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 256, (6, 6)).astype(float)
    y, x = np.mgrid[0:side, 0:side] * 5 / (side - 1)
    i, j = np.minimum(y.astype(int), 4), np.minimum(x.astype(int), 4)
    fy, fx = y - i, x - j
    return np.rint(coarse[i, j] * (1 - fy) * (1 - fx) + coarse[i + 1, j] * fy * (1 - fx) + coarse[i, j + 1] * (1 - fy) * fx + coarse[i + 1, j + 1] * fy * fx)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "pics"
    (root / "sub dir").mkdir(parents=True)
    base = picture(1)
    png(root / "base.png", base)
    png(root / "sub dir" / "resized.PNG", picture(1, 64))
    png(root / "rotated.png", np.rot90(base))
    png(root / "rgb.png", np.repeat(base[:, :, None], 3, axis=2))
    png(root / "unique.png", picture(2))
    png(root / ".hidden.png", base)
    (root / "notes.txt").write_text("no image")
    (root / "scan.tif").write_text("no image either")
    return root


def test_discovery(spark, folder):
    png(folder / "_x.png", picture(3))
    rows = discovery.discover(spark, str(folder)).orderBy("ord").collect()
    assert [r.basename for r in rows] == ["base.png", "rgb.png", "rotated.png", "resized.PNG", "unique.png"]
    assert [r.ord for r in rows] == list(range(5)) and all(r.path.startswith(str(folder)) and r.size > 0 for r in rows)
    every = discovery.discover(spark, str(folder), underscores=True)
    assert "_x.png" in {r.basename for r in every.collect()} and every.count() == 6
    with pytest.raises(discovery.FolderError, match="Folder does not exist"):
        discovery.validate_folder(spark, str(folder / "none"))
    with pytest.raises(discovery.FolderError):
        discovery.validate_folder(spark, str(folder / "notes.txt"))


def test_scan_rematch_cache(spark, folder, tmp_path):
    updates = []
    engine = Engine(spark, f"file://{tmp_path}/cache", on_update=updates.append)
    first = engine.scan(str(folder), threshold=5)
    found = first.groups.collect()
    names = [sorted(p.rsplit("/", 1)[1] for p in r.files) for r in found]
    assert names == [["base.png", "resized.PNG", "rgb.png", "rotated.png"]] and found[0].representative.endswith("/base.png")
    assert first.scanned_file_count == 5 and first.warnings == [] and first.summary.first().removable == 3
    assert first.cache_stats == {"hits": 0, "misses": 5, "stale": 0, "writes": 5, "errors": 0}
    assert [u["type"] for u in updates][-1] == "complete" and {u.get("phase") for u in updates} >= {"discovering", "hashing", "comparing"}
    again = engine.scan(str(folder))
    assert again.cache_stats["hits"] == 5 and again.cache_stats["writes"] == 0 and again.groups.count() == 1
    assert engine.scan(str(folder), force_refresh=True).cache_stats["misses"] == 5
    loose = engine.rematch(str(folder), threshold=0)
    assert loose.threshold == 0 and loose.cache_stats["hits"] == 5
    assert engine.cache_info(str(folder))["valid_entry_count"] == 5
    (folder / "unique.png").unlink()
    png(folder / "new.png", picture(9))
    with pytest.raises(CacheIncomplete, match="1 of 5"):
        engine.rematch(str(folder))
    assert engine.scan(str(folder)).cache_stats["misses"] == 1
    assert engine.cache_info(str(folder))["total_entries"] == 5
    assert engine.preview(str(folder)) == {"image_count": 5, "samples": [r.path for r in discovery.discover(spark, str(folder)).orderBy("ord").collect()], "overflow": 0}
    assert engine.clear_cache(str(folder))["missing_entry_count"] == 5


def test_unreadable(spark, folder, tmp_path):
    (folder / "broken.png").write_bytes(b"no picture")
    engine = Engine(spark, f"file://{tmp_path}/cache")
    with pytest.raises(Exception, match="Unreadable image"):
        engine.scan(str(folder))
    result = engine.scan(str(folder), on_error="skip")
    assert len(result.warnings) == 1 and "broken.png" in result.warnings[0] and result.cache_stats["errors"] == 1
    assert engine.cache_info(str(folder))["missing_entry_count"] == 1


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    result = Engine(spark, f"file://{tmp_path}/cache").scan(str(tmp_path / "none"))
    assert result.groups.count() == 0 and result.summary.first().duplicate_rate == 0


def test_box_weights():
    for n in (5, 32, 100):
        w = decode.box_weights(n)
        assert np.allclose(w.sum(axis=1), 1) and np.allclose(w.sum(axis=0), 32 / n)
    assert np.array_equal(decode.grey_sample(bytes(range(256)) * 4, 32, 32, 1).reshape(-1), np.arange(1024) % 256)


def test_file_stream(spark, folder, tmp_path):
    query = decode.stream_hashes(spark, str(folder), 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("size(hashes) > 0").count() == 5
    assert discovery.stream_files(spark, str(folder)).isStreaming
