import numpy as np
import pytest

from kindred.operators import groups, simjoin
from kindred.operators.components import Forest, connected_components


def corpus(ns):
    return [f"{(n * 0x9E3779B9) & 0xFFFFFFFF:08x}{(n * 0x6C62272E) & 0xFFFFFFFF:08x}" for n in ns]


def dist(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def near_chunk(a, b):
    x = int(a, 16) ^ int(b, 16)
    return min((x >> s & 0xFFFF).bit_count() for s in (0, 16, 32, 48))


def frame(spark, hashes):
    return spark.createDataFrame([(h,) for h in hashes], "hash string")


@pytest.fixture(scope="module")
def hashes():
    rng = np.random.default_rng(4)
    out = corpus(range(120))
    # near ones of every kind, some with all chunks three bits away
    for h in out[:40]:
        bits = int(h, 16)
        for k in rng.integers(1, 18, 2):
            flip = sum(1 << int(b) for b in rng.choice(64, int(k), replace=False))
            out.append(f"{bits ^ flip:016x}")
    out.append(f"{int(out[0], 16) ^ 0x0007000700070007:016x}")
    return out


@pytest.mark.parametrize("threshold", [0, 4, 5, 10, 12, 16])
@pytest.mark.parametrize("mode", ["exact", "mih"])
def test_self_join(spark, hashes, threshold, mode):
    got = {tuple(r) for r in simjoin.similarity_self_join(frame(spark, hashes + hashes[:5] + [None]), threshold, mode=mode).collect()}
    radius = min(threshold // 4, 2) if mode == "mih" else 64
    every = sorted(set(hashes))
    want = {(a, b, dist(a, b)) for i, a in enumerate(every) for b in every[i + 1 :] if dist(a, b) <= threshold and near_chunk(a, b) <= radius}
    assert got == want
    if mode == "exact" and threshold == 12:
        assert any(near_chunk(a, b) > 2 for a, b, _ in got)


@pytest.mark.parametrize("threshold", [5, 10])
def test_plans_agree(spark, hashes, threshold, monkeypatch):
    bits = simjoin._distinct_bits(frame(spark, hashes), "hash")
    index = simjoin._by_index(bits, bits, threshold, True)
    monkeypatch.setattr(simjoin, "PART", 50)
    tiles = simjoin._by_tiles(bits, bits, threshold, True, 200, 200)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, tiles.collect()))
    other = simjoin._distinct_bits(frame(spark, hashes[:30]), "hash")
    index, tiles = simjoin._by_index(other, bits, threshold, False), simjoin._by_tiles(other, bits, threshold, False, 30, 200)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, tiles.collect()))


def test_probe_join(spark):
    base, probes = corpus(range(200)), corpus(200 + 7 * k for k in range(20))
    got = {tuple(r) for r in simjoin.similarity_join(frame(spark, probes), frame(spark, base), 24).collect()}
    assert got == {(p, b, dist(p, b)) for p in probes for b in base if dist(p, b) <= 24}


def test_join_edges(spark):
    two = frame(spark, ["0" * 16, "f" * 16])
    assert simjoin.similarity_self_join(two, -1).count() == 0
    assert simjoin.similarity_self_join(two, 64).count() == 1
    assert simjoin.similarity_self_join(frame(spark, []), 5).count() == 0
    assert simjoin.similarity_self_join(frame(spark, ["00000000000003ff", "0" * 16, "00000000000007ff"]), 10).count() == 2
    with pytest.raises(Exception, match="not a 16-digit hash"):
        simjoin.similarity_self_join(frame(spark, ["hash-0"]), 5).collect()
    with pytest.raises(ValueError):
        simjoin.similarity_self_join(two, 5, mode="fast")


def test_nearest(spark, hashes):
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, hash string")
    got = simjoin.nearest(rows.filter("id % 20 = 0"), rows, 4, "id", "id").collect()
    for i in range(0, len(hashes), 20):
        want = sorted((dist(hashes[i], h), j) for j, h in enumerate(hashes) if j != i)[:4]
        assert [(r.dist, r.neighbour) for r in sorted(got, key=lambda r: r["rank"]) if r.id == i] == want


def records(spark, rows):
    return spark.createDataFrame([(p, p.split("/")[-1], i, h) for i, (p, h) in enumerate(rows)], "path string, basename string, ord long, hashes array<string>")


Z = "0" * 16
CASES = [
    ("shared", [("a", ["aabbccdd00112233"]), ("b", ["aabbccdd00112233"]), ("c", ["0011223344556677"])], 5, [["a", "b"]]),
    ("near", [("base", [Z]), ("near", ["000000000000001f"]), ("far", ["f" * 16])], 5, [["base", "near"]]),
    ("beyond", [("a", [Z]), ("b", ["00000000000007ff"])], 5, []),
    ("transitive", [("a", [Z]), ("b", ["000000000000001f"]), ("c", ["000000000000007f"])], 5, [["a", "b", "c"]]),
    ("rematch 4", [("a", [Z]), ("b", ["000000000000001f"]), ("c", ["00000000000007ff"])], 4, []),
    ("rematch 5", [("a", [Z]), ("b", ["000000000000001f"]), ("c", ["00000000000007ff"])], 5, [["a", "b"]]),
    ("any rotation", [("a", [Z, "f" * 16]), ("b", ["00ff00ff00ff00ff", "fffffffffffffff0"])], 5, [["a", "b"]]),
    ("no hashes", [("a", []), ("b", [Z])], 5, []),
]


@pytest.mark.parametrize(("name", "rows", "threshold", "want"), CASES, ids=[c[0] for c in CASES])
def test_groups(spark, name, rows, threshold, want):
    found = groups.duplicate_groups(records(spark, rows), threshold).collect()
    assert [r.files for r in found] == want


def test_group_fields_and_order(spark):
    # the one that stands for a group is its first record, its id the least path; larger groups first, then earlier ones
    rows = [("z", [Z]), ("y", ["f" * 16]), ("a", [Z]), ("x", ["f" * 16]), ("m", ["00000000ffffffff"]), ("k", ["00000000ffffffff"]), ("b", ["00000000ffffffff"])]
    recs = records(spark, rows)
    members = groups.components(recs, 5)
    got = groups.build_groups(recs, members).collect()
    assert [(r.id, r.representative, r.files, r.evidence, r.size, r.score) for r in got] == [
        ("b", "m", ["m", "k", "b"], "Perceptual hash · 00000000ffffffff", 3, None),
        ("a", "z", ["z", "a"], f"Perceptual hash · {Z}", 2, None),
        ("x", "y", ["y", "x"], "Perceptual hash · ffffffffffffffff", 2, None),
    ]
    s = groups.summary(groups.group_sizes(members), recs, 2000).first()
    assert (s.groups, s.grouped, s.removable, s.largest, s.unique_images, s.duplicate_rate, s.per_second) == (3, 7, 4, 3, 0, 100.0, 3.5)
    gone = {(r.id, r.path) for r in groups.removal_candidates(recs, members).collect()}
    assert gone == {("b", "k"), ("b", "b"), ("a", "a"), ("x", "x")}
    assert groups.summary(groups.group_sizes(members).filter("false"), 0).first().duplicate_rate == 0
    text = groups.summary_text(groups.summary(groups.group_sizes(members), 1234, 0)).first()
    assert (text.scanned, text.duplicate_rate, text.per_second) == ("1,234", "0.6%", "—")
    assert [r.folded for r in groups.report(groups.build_groups(recs, members)).collect()] == [0, 0, 0]


def test_first_per_hash(spark):
    recs = records(spark, [("b", [Z]), ("a", [Z, "f" * 16])])
    assert {(r.hash, r.path, r.files) for r in groups.first_per_hash(recs).collect()} == {(Z, "b", 2), ("f" * 16, "a", 1)}
    assert groups.index_size(recs).first().hashes == 2
    assert {(r.path, r.file_path, r.dist) for r in groups.matches(records(spark, [("q", ["0000000000000001"])]), recs, 1).collect()} == {("q", "b", 1)}


def test_forest():
    f = Forest()
    f.union("delta", "beta")
    f.union("gamma", "beta")
    assert f.find("gamma") == f.find("delta") == "beta" and f.find("new") == "new"


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, kind, one_task):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(7, 7), (400, 400)]
    make = (lambda x: x) if kind == "long" else (lambda x: f"n{x:04d}")
    forest = Forest()
    for a, b in edges:
        forest.union(a, b)
    rows = spark.createDataFrame([(make(a), make(b)) for a, b in edges] + [(None, make(1))], f"src {kind}, dst {kind}")
    got = {r.node: r.component for r in connected_components(rows, one_task=one_task).collect()}
    assert got == {make(x): make(forest.find(x)) for x in list(forest.parent)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    with pytest.raises(TypeError):
        connected_components(spark.createDataFrame([(1.0, 2.0)], "src double, dst double"))


def test_index_plan_has_no_nested_loop(spark, hashes):
    bits = simjoin._distinct_bits(frame(spark, hashes), "hash")
    plan = simjoin._by_index(bits, bits, 10, True)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
