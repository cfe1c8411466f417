"""Operator 9 against all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import simhash
from kindred.llm.xxh64 import xxh64


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=6):
    f = np.array([fingerprint(t) for _, t in rows], np.uint64)
    links = [np.flatnonzero(np.bitwise_count(f ^ x) <= radius) for x in f]
    ids = [d for d, _ in rows]
    label = list(range(len(rows)))
    while (new := [min(label[j] for j in m) for m in links]) != label:
        label = new
    least = {}
    for d, root in zip(ids, label):
        if d is not None:
            least[root] = min(d, least.get(root, d))
    return Counter((d, f"{int(x):016x}", len(m) - 1, least.get(root)) for d, x, m, root in zip(ids, f, links, label))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé \n\t日x"), max_size=90), max_size=6))
def test_fingerprints(texts):
    assert simhash.fingerprints_of(pa.array(texts, pa.string())).tolist() == [fingerprint(t) for t in texts]


def test_xxh64_of_all_lengths():
    data = np.random.default_rng(1).integers(0, 256, 400).astype(np.uint8)
    sizes = np.arange(150)
    start = np.full(150, 7)
    assert xxh64(data, start, sizes).tolist() == [xxhash.xxh64_intdigest(data[7 : 7 + k].tobytes(), 42) for k in sizes]


@pytest.mark.parametrize("cell", [7, 1 << 16])
def test_near_duplicates(spark, random_docs, cell, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rows = [(d, t) for d, t, _, _ in random_docs]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cell=cell).collect()
    assert Counter(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_every_plan_of_tables_finds_all(spark, n):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [np.uint64(int(x) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False))) for x in base for _ in range(3)]
    fps = np.unique(np.concatenate((base, np.array(near, np.uint64), [np.uint64(0), np.uint64(63)])))
    weight = rng.integers(1, 5, len(fps))
    rows = spark.createDataFrame([(int(f), int(w)) for f, w in zip(fps.view(np.int64), weight)], "fp long, rows long")
    found = simhash.near_links(rows, n, 6, cell=9).groupBy("fp").agg({"near": "sum"}).collect()
    got = {r.fp: r[1] for r in found}
    for i, f in enumerate(fps):
        want = int(weight[(np.bitwise_count(fps ^ f) <= 6)].sum() - weight[i])
        assert got.get(int(fps.view(np.int64)[i]), 0) == want


def test_odd(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = simhash.near_duplicates(odd_docs).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert simhash.near_duplicates(no_docs).count() == 0
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0} and {r.n_near for r in zero} >= {len([r for r in rows if not (r[1] or "").split()]) - 1}
