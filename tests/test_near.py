"""Cells of chunk values, tiles and spanning edges against all pairs."""

import numpy as np
import pytest

from kindred import schemas
from kindred.functions import near
from kindred.operators import groups, simjoin
from kindred.operators.components import connected_components
from kindred.streaming.incremental import IncrementalGroups


def bunches(seed, n=160):
    """Different hashes around a few, up to 14 bits away, in no order."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 15)), replace=False)) for _ in range(n)], np.uint64)
    return rng.permutation(np.unique(base[rng.integers(0, 6, n)] ^ flips))


def every_pair(x, y, t, same):
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= t)
    return {(min(a, b), max(a, b)) if same else (a, b) for a, b in zip(i.tolist(), j.tolist()) if not same or a != b}


def partition(n, x, y):
    label = near.forest(n, x, y)[1]
    return {frozenset(np.flatnonzero(label == v).tolist()) for v in np.unique(label)}


WAYS = [(t, m, way) for t in (0, 5, 10, 12, 16) for m in (0, 4, 6) for way in (0, 1) if m <= t + 1 and (m or not way)]


@pytest.mark.parametrize(("threshold", "m", "way"), WAYS)
@pytest.mark.parametrize("same", [True, False])
def test_all_ways_find_each_pair_once(monkeypatch, threshold, m, way, same):
    monkeypatch.setattr(near, "plan_for", lambda *a: near.chunks(m, threshold) if m else [])
    monkeypatch.setattr(near, "_costs", lambda *a: (way, 1 - way))
    monkeypatch.setattr(near, "BLOCK", 300)
    x = bunches(1)
    y = x if same else bunches(1)[:70]
    got = [(min(p), max(p)) if same else p for i, j, _ in near.pairs(x, y, threshold, same) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == every_pair(x, y, threshold, same)


@pytest.mark.parametrize("thresholds", [[5], [12], [16], [4, 5, 10, 12]])
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("some", [None, 4])
def test_spanning_edges_join_what_the_pairs_join(monkeypatch, thresholds, same, some):
    monkeypatch.setattr(near, "plan_for", lambda t, *a: near.chunks(4, t))
    monkeypatch.setattr(near, "cost", lambda plan, *a: 0 if plan else 1)
    monkeypatch.setattr(near, "HELD", 50)
    x = bunches(2)
    y, n = x if same else bunches(3), len(x)
    key, key_y = np.arange(n), np.arange(n) if same else np.arange(len(y)) + n
    chunk = near.chunks(4, thresholds[-1]) if some else None
    a, b, at = near.spanning(x, y, key, key_y, thresholds, same, chunk)
    total = n if same else n + len(y)
    assert len(a) < total
    for t in thresholds:
        pairs = np.array(sorted(every_pair(x, y, t, same)), int).reshape(-1, 2)
        assert partition(total, a[at <= t], b[at <= t]) == partition(total, pairs[:, 0], key_y[pairs[:, 1]])


def test_one_bunch_is_joined_at_once():
    """What is joined already isn't looked at: one bunch costs few comparisons at 16 bits."""
    rng = np.random.default_rng(4)
    x = np.unique(np.uint64(1 << 60) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(30_000)], np.uint64))
    a, b, _ = near.spanning(x, x, np.arange(len(x)), np.arange(len(x)), [16], True)
    assert len(a) == len(x) - 1


def frame(spark, bits):
    return spark.createDataFrame([(f"{b:016x}",) for b in bits.tolist()], "hash string")


def test_a_pair_is_found_in_one_tile(spark, monkeypatch):
    """So nothing is grouped again after the tiles, and each hash is sent once for each part, packed."""
    monkeypatch.setattr(simjoin, "PART", 40)
    monkeypatch.setattr(simjoin, "MOST_TASKS", 3)
    x = bunches(5)
    bits = simjoin._distinct_bits(frame(spark, x), "hash").cache()
    found = simjoin._by_tiles(bits, bits, 16, True, len(x), len(x))
    got = found.count()
    assert got == len(every_pair(x, x, 16, True)) == found.distinct().count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("InMemoryRelation")[0]


def records(spark, hashes):
    return spark.createDataFrame([(f"p{k:05d}", f"p{k:05d}", k, h) for k, h in enumerate(hashes)], schemas.HASHED)


@pytest.fixture
def many():
    return [[f"{b:016x}" for b in bunches(6, 300)[k : k + 2]] for k in range(0, 250, 2)] + [["0" * 16], []]


def test_links_span_and_do_not_list(spark, many):
    dense = [[f"{(1 << 20) + k:016x}"] for k in range(400)]
    assert groups.links(records(spark, dense), 16).count() < 400
    members = {r.path: r.id for r in groups.components(records(spark, many), 5).collect()}
    bits = [[int(h, 16) for h in hs] for hs in many]
    n = len(bits)
    near_ = [(i, j) for i in range(n) for j in range(n) if any((a ^ b).bit_count() <= 5 for a in bits[i] for b in bits[j])]
    want = partition(n, *np.array(near_).T)
    assert {frozenset(int(p[1:]) for p, i in members.items() if i == of) for of in set(members.values())} == want
    assert all(i == min(p for p, j in members.items() if j == i) for i in members.values())


def test_several_thresholds_from_one_join(spark, many, monkeypatch):
    calls = []
    real = groups.spanning_self_join
    monkeypatch.setattr(groups, "spanning_self_join", lambda *a: calls.append(a) or real(*a))
    recs = records(spark, many)
    got = {t: sorted(r["size"] for r in s.collect()) for t, s in groups.sizes_at(recs, (4, 12)).items()}
    assert len(calls) == 1
    for t in (4, 12):
        assert got[t] == sorted(r[0] for r in groups.group_sizes(groups.components(recs, t)).select("size").collect())


def test_longs_are_thinned(spark):
    rng = np.random.default_rng(7)
    ends = rng.integers(0, 90, (900, 2)).tolist() + [[200 + k, 201 + k] for k in range(0, 60, 2)]
    rows = spark.createDataFrame(ends, "src long, dst long")
    ends_ = np.array(ends)
    want = {frozenset(g) for g in partition(300, ends_[:, 0], ends_[:, 1]) if len(g) > 1}
    for one_task in (150, 60):
        got = {}
        for r in connected_components(rows, one_task=one_task).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert {frozenset(g) for g in got.values() if len(g) > 1} == want and all(min(g) == c for c, g in got.items())


def test_stream_keeps_spanning_links(spark, tmp_path):
    dense = [[f"{(1 << 20) + k:016x}"] for k in range(200)]
    engine = IncrementalGroups(spark, str(tmp_path / "state"), 12)
    rows = records(spark, dense)
    engine.process(rows.filter("ord < 90"), 0)
    engine.process(rows.filter("ord >= 90"), 1)
    assert spark.read.parquet(str(tmp_path / "state/links")).count() < 400
    assert [r["size"] for r in engine.groups().collect()] == [200]
