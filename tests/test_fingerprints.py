import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import hashing, phash
from kindred.functions.config import clamp_threshold, js_round, parse_threshold, required_text, resolve_threshold

PAIRS = [
    ("0000000000000000", "0000000000000001", 1),
    ("0000000000000000", "0000000000000008", 1),
    ("0000000000000000", "ffffffffffffffff", 64),
    ("0000000000000000", "f000000000000000", 4),
    ("0000000000000000", "00000000000003ff", 10),
    ("0000000000000000", "00000000000007ff", 11),
    ("0000000000000000", "ffffffff00000000", 32),
    ("abcdef0123456789", "abcdef0123456788", 1),
    ("ABCDEF0123456789", "abcdef0123456789", 0),
]


def test_hamming(spark):
    rows = spark.createDataFrame(PAIRS, "a string, b string, want int")
    got = rows.select("want", hashing.hamming_hex(F.col("a"), F.col("b")).alias("ab"), hashing.hamming_hex(F.col("b"), F.col("a")).alias("ba")).collect()
    assert all(r.want == r.ab == r.ba for r in got)


def test_bits_round_trip_and_chunks(spark):
    rows = spark.createDataFrame([("8000ffff12340001",), ("hash-0",), (None,), ("00112233445566778",)], "h string")
    bits = hashing.bits_of(F.col("h"))
    got = rows.select(hashing.hex_of(bits).alias("back"), *[hashing.chunk(bits, k).alias(f"c{k}") for k in range(4)], hashing.is_valid_hash(F.col("h")).alias("ok")).collect()
    assert tuple(got[0]) == ("8000ffff12340001", 0x8000, 0xFFFF, 0x1234, 1, True)
    assert [r.ok for r in got] == [True, False, False, False]
    assert all(r.back is None for r in got[1:])


def test_masks():
    assert [len(hashing.masks(r)) for r in (0, 1, 2)] == [1, 17, 137]
    assert len(set(hashing.masks(2))) == 137 and all(m.bit_count() <= 2 for m in hashing.masks(2))


def plain_hash(pixels):
    """The DCT hash, one term after the other."""
    p = [[int(v) for v in row] for row in pixels]
    cos = [[math.cos((2 * x + 1) * u * math.pi / 64) for x in range(32)] for u in range(8)]
    rows = [[sum((p[x][y] * cos[v][y] for y in range(32)), 0.0) for v in range(8)] for x in range(32)]
    d = []
    for u in range(8):
        for v in range(8):
            s = sum((cos[u][x] * rows[x][v] for x in range(32)), 0.0)
            d.append((1 / math.sqrt(2) if u == 0 else 1) * (1 / math.sqrt(2) if v == 0 else 1) * s / 32)
    mean = sum(d[1:]) / 63
    return f"{int(''.join('1' if c >= mean else '0' for c in d), 2):016x}"


def test_phash_against_plain_sums():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (20, 32, 32)).astype(np.uint8)
    assert phash.to_hex(phash.phash(samples)) == [plain_hash(s) for s in samples]


def test_phash_cases():
    one = lambda p: phash.to_hex(phash.phash(np.array(p, np.uint8).reshape(1, 32, 32)))[0]
    assert one([0] * 1024) == "f" * 16
    assert one([255] * 1024) != one([0] * 1024)
    ramp = [(i * 3) % 200 + 20 for i in range(1024)]
    a, b = one(ramp), one([v + 8 for v in ramp])
    assert (int(a, 16) ^ int(b, 16)).bit_count() <= 8
    assert one([i % 256 for i in range(1024)]) == one([i % 256 for i in range(1024)])


def test_rotations():
    s = np.arange(1024).reshape(1, 32, 32) % 251
    r = phash.rotated(s, 90)[0]
    assert all(r[c, 31 - q] == s[0, q, c] for q in range(32) for c in range(32))
    assert np.array_equal(phash.rotated(phash.rotated(s, 90), 270), s)
    four = phash.rotation_hashes(s.astype(np.uint8))[0]
    turned = phash.rotation_hashes(phash.rotated(s, 90).astype(np.uint8))[0]
    assert set(four) == set(turned) and four[1] == turned[0]
    assert phash.rotation_hashes(np.zeros((1, 32, 32), np.uint8)) == [["f" * 16]]
    with pytest.raises(ValueError):
        phash.rotated(s, 45)


def test_udfs(spark):
    rng = np.random.default_rng(2)
    body = [bytearray(rng.integers(0, 256, 1024).astype(np.uint8).tobytes()) for _ in range(5)] + [None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(body)], "id int, pixels binary")
    got = rows.select("id", phash.phash_udf("pixels").alias("h"), phash.rotation_hashes_udf("pixels").alias("four")).orderBy("id").collect()
    assert got[5].h is None and got[5].four is None
    assert all(r.four[0] == r.h == plain_hash(np.frombuffer(bytes(body[r.id]), np.uint8).reshape(32, 32)) for r in got[:5])


def test_shrink():
    bodies = [b"", b"a", bytes(range(256)) * 8, bytes(range(200))]
    offsets = np.cumsum([0, *map(len, bodies)])
    got = phash.shrink(np.frombuffer(b"".join(bodies), np.uint8), offsets).reshape(4, 1024)
    for b, g in zip(bodies, got):
        n = len(b)
        want = [0] * 1024 if not n else [sum(b[k * n // 1024 : max(k * n // 1024 + 1, (k + 1) * n // 1024)]) // max(1, (k + 1) * n // 1024 - k * n // 1024) for k in range(1024)]
        assert g.tolist() == want


def test_binarised(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(6, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id int, v array<double>")
    got = [r.h for r in rows.select("id", phash.binarised(F.col("v")).alias("h")).orderBy("id").collect()]
    assert got == phash.to_hex(phash.binarise(values))


def test_thresholds():
    assert [clamp_threshold(v) for v in (4.5, -3, 99, "x", None, True, float("nan"))] == [5, 0, 16, 5, 5, 5, 5]
    assert [parse_threshold(v) for v in ("7abc", "x", None, "40", "-2", " 3")] == [7, 5, 5, 16, 0, 3]
    assert resolve_threshold(3, "9") == 3 and resolve_threshold(None, "9") == 9 and resolve_threshold(None, None) == 5
    assert [js_round(x) for x in (0.5, 1.5, -0.5, 2.4)] == [1, 2, 0, 2]
    assert required_text("  a ", "folder") == "a"
    with pytest.raises(ValueError):
        required_text("  ", "folder")
