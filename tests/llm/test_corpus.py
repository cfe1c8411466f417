"""Operators 2, 6 and 8, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm.decontaminate import Index, Item, contaminated, drop_contaminated, edits, hashed_words, split_item
from kindred.llm.mixing import hypergeometric, mix_sources, share_out, split_quotas, targets
from kindred.llm.sharding import kd_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# operator 2


def test_targets():
    assert targets([100, 100, 100], [3, 1, 2], 300, 2) == [pytest.approx(150), pytest.approx(50), pytest.approx(100)]
    # the first is cut at twice its size, the rest shared 1 to 2, then the last is cut as well
    assert targets([10, 1000, 20], [3, 1, 2], 120, 2) == [20, 60, 40]
    assert targets([10, 10], [3, 1], 100, 2) == [20, 20] and targets([], [], 0, 2) == [] and targets([0, 5], [1, 1], 7.5, 2) == [0, 7.5]


def test_splitting_tree():
    quotas = np.array([100, 7, 0, 1000])
    parts = split_quotas(quotas, 13, np.random.default_rng(1))
    assert parts.shape == (13, 4) and (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
    assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 4
    assert np.array_equal(parts, split_quotas(quotas, 13, np.random.default_rng(1)))


def test_draws_beyond_numpys_limit():
    rng = np.random.default_rng(5)
    quotas = np.full(8000, 131_072, np.int64)
    part = share_out(quotas, int(quotas.sum()) // 2, rng)
    assert part.sum() == quotas.sum() // 2 and (part >= 0).all() and (part <= quotas).all()
    # mean and spread as the distribution has them, for more and for fewer good units than bad, and for many draws
    for good, bad, n in ((3_000_000_000, 1_000_000_000, 10_000), (500_000_000, 5_000_000_000, 1_000_000), (10**12, 10**12, 2 * 10**12 - 1000)):
        draws = np.array([hypergeometric(good, bad, n, rng) for _ in range(3000)], float)
        all_, m = good + bad, n
        mean, sd = m * good / all_, (m * good * bad / all_ / all_ * (all_ - m) / (all_ - 1)) ** 0.5
        assert abs(draws.mean() - mean) < 5 * sd / 3000**0.5 and abs(draws.std() / sd - 1) < 0.08


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(2)
    rows = [(d, " ".join(["w"] * (rng.randrange(1, 60) if rng.random() < 0.95 else 900)), rng.choice(["s0"] * 6 + ["s1", "s10", "s2", None])) for d in range(1500)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


@pytest.mark.parametrize("block", [1, 16, 10_000])
def test_mix(sized, block):
    rows, df = sized
    got = mix_sources(df, block=block).collect()
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    by = defaultdict(list)
    for d, _, s in rows:
        by[s].append(d)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    totals = [sum(size[d] for d in by[s]) for s in order]
    goal = dict(zip(order, targets(totals, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(totals), 2)))
    source = {d: s for d, _, s in rows}
    taken = Counter()
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sum(size[d] for d in by[s]) and r.target == pytest.approx(goal[s])
        assert r.taken == r.size * r.copies and r.copies in (0, 1, 2) and len(r.draws) == r.copies and all(0 <= d.shard < 16 for d in r.draws)
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= min(60, goal[s] * 0.05 + 1)
    again = {r.doc_id: (r.taken, tuple(r.draws)) for r in mix_sources(df.repartition(7), block=block).collect()}
    assert again == {r.doc_id: (r.taken, tuple(r.draws)) for r in got}
    if block == 1:
        shards = Counter(d.shard for r in got for d in r.draws)
        assert max(shards.values()) < 1.3 * min(shards.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_reaches_every_block(spark, seed):
    """Two fifths of the words in one document, and rows without an id: the gap still ends below the least document left out."""
    rng = random.Random(seed)
    sizes = [rng.randrange(5, 40) for _ in range(4000)]
    rows = [(None if k % 50 == 0 else k, " ".join([f"w{k}"] * n)) for k, n in enumerate(sizes)] + [(9000, "w " * (sum(sizes) * 2 // 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(4)
    got = mix_sources(df, share=0.5, seed=seed).collect()
    gap = got[0].target - sum(r.taken for r in got)
    assert len(got) == len(rows) and -1 < gap < min(r.size for r in got if not r.copies) + 1


def test_mix_odd(odd_docs, no_docs):
    got = mix_sources(odd_docs)
    assert got.count() == odd_docs.count() and mix_sources(no_docs).count() == 0
    assert {r.taken for r in got.filter("doc_id in (0, 1, 10, 14)").collect()} == {0}


# operator 6


def words(rng, n, common=("the", "of", "and", "to"), share=0.3, vocabulary=3000):
    return " ".join(rng.choice(common) if rng.random() < share else f"v{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(4)
    items = [(k, words(rng, rng.randrange(8, 60)).capitalize() + ". " + words(rng, rng.randrange(3, 10)).capitalize() + ".") for k in range(40)]
    items += [(90, "Short item"), (91, ""), (92, None), (93, words(rng, 300) + ". " + words(rng, 20))]
    rows, want = [], set()
    for d in range(400):
        parts = [words(rng, rng.randrange(1, 400))]
        if d % 5 == 0:
            k, t = rng.choice([i for i in items if i[1]])
            want.add((d, k))
            t = t.upper() if d % 2 else t.replace(" ", "\n  ")
            parts.insert(rng.randrange(2), t)
        if d % 5 == 1:  # half an item is none
            t = rng.choice(items[:40])[1]
            parts.append(t[: len(t) // 3])
        rows.append((d, " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "item short"), (1003, "short item")]
    want.add((1003, 90))
    return rows, want, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("postings", [10**9, 300])
def test_decontaminate(leaks, postings):
    rows, want, docs, items = leaks
    found = contaminated(docs, items, postings=postings)
    assert {(r.doc_id, r.item) for r in found.collect()} == want and found.count() == len(want)
    clean = {r.doc_id for r in drop_contaminated(docs, items, postings=postings).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}


@pytest.mark.parametrize("block", [1, 8, 1000])
def test_search_is_exhaustive(monkeypatch, block):
    """Block-max WAND against BM25 written out: every passage with every segment."""
    import math

    from kindred.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(5, 60), vocabulary=150).split() for _ in range(67)]
    known = decontaminate.Statistics.of((len(t), np.unique(h)) for t, h in zip(texts, hashed_words([" ".join(t) for t in texts])))
    parts = [(Item(k, h, h[:0]), h) for k, h in enumerate(hashed_words([" ".join(t) for t in texts]))]
    queries = [words(rng, 80, vocabulary=150).split() for _ in range(120)]
    df, n, mean = Counter(w for t in texts for w in set(t)), len(texts), sum(map(len, texts)) / len(texts)

    def weight(w, t):
        f = t.count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean))

    exact = {(q, s): sum(weight(w, t) for w in set(t) & set(queries[q])) / sum(weight(w, t) for w in set(t)) for q in range(len(queries)) for s, t in enumerate(texts)}
    ends = np.cumsum([len(q) for q in queries])
    hashes = np.concatenate(hashed_words([" ".join(q) for q in queries]))
    for threshold in (0.15, 0.3):
        got = {}
        for some in (parts[:30], parts[30:]):  # two indexes with the statistics of both
            index = Index(some, known)
            found = index.search(index.terms(hashes), ends - [len(q) for q in queries], ends, threshold)
            got |= {(p, index.items[index.owner[s]].id): x for p, s, x in zip(*(c.tolist() for c in found))}
        want = {k for k, x in exact.items() if x >= threshold}
        assert want <= set(got) and all(exact[k] >= threshold - 1e-4 and abs(exact[k] - x) < 1e-4 for k, x in got.items()) and want


def test_lightly_edited_items(spark):
    rng = random.Random(14)
    distinct = lambda name, n: [f"{name}{k}" for k in range(n)]
    items, rows, want = [], [], set()
    for k, answer in enumerate((1, 2, 3, 4, 5, 8, 13)):
        q, a = distinct(f"q{k}x", 50 - answer), distinct(f"a{k}x", answer)
        items.append((None if k == 3 else k, " ".join(q) + ". " + " ".join(a) + "."))
        a[answer // 2] = "changed"
        rows.append((k, words(rng, 90) + " " + " ".join(q + a) + " " + words(rng, 90)))
        want.add((k, items[-1][0]))
        # without its answer, or with a third of all words changed, an item isn't there
        rows.append((100 + k, words(rng, 90) + " " + " ".join(q) + " " + words(rng, 90)) if answer > 1 else (100, ""))
        rows.append((200 + k, " ".join("changed" if j % 3 == 0 else w for j, w in enumerate(q + a))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item) for r in contaminated(docs, bench).collect()} == want
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_edits():
    rng = random.Random(15)
    for _ in range(300):
        part, region = ([rng.randrange(5) for _ in range(rng.randrange(n))] for n in (7, 14))
        row = [0] * (len(region) + 1)
        for w in part:
            new = [row[0] + 1]
            for j, r in enumerate(region):
                new.append(min(row[j] + (w != r), row[j + 1] + 1, new[j] + 1))
            row = new
        for most in range(len(part) + 1):
            assert edits(np.array(part, np.uint64), np.array(region, np.uint64), most) == min(min(row), most + 1)


def test_items():
    assert split_item("What is it? A cat.") == ("What is it?", " A cat.") and split_item("one two three four") == ("one two three", "four")
    assert split_item("") == ("", "") and split_item("word") == ("word", "")


def test_decontaminate_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two words"), (2, None), (1, "two words")], "item_id long, text string")
    assert {(r.doc_id, r.item) for r in contaminated(odd_docs, items).collect()} == {(8, 1)}
    assert contaminated(no_docs, items).count() == 0 and contaminated(odd_docs, items.filter("false")).count() == 0
    assert drop_contaminated(odd_docs, items).count() == odd_docs.count() - 1 and drop_contaminated(odd_docs, items).columns == odd_docs.columns


# operator 8


def test_shards(spark, random_docs):
    rng = random.Random(3)
    rows = [(k, " ".join(["x"] * rng.randrange(1, 200)) + str(k if rng.random() < 0.8 else k % 7), s, rng.choice(["en", "de", None])) for k in range(20) for _, _, s, _ in random_docs]
    rows = [(i, t, s, lang) for i, (_, t, s, lang) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    got = kd_shards(df, shards=24).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    size = Counter()
    slots, homes = defaultdict(list), defaultdict(set)
    text = {d: t for d, t, _, _ in rows}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[text[r.doc_id]].add(r.shard)
    assert set(size) == set(range(24)) and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert sorted(map(tuple, kd_shards(df.repartition(3), shards=24).collect())) == sorted(map(tuple, got))


def test_names_with_a_common_prefix_are_told_apart(spark):
    rows = [(f"document-{k:05}", f"text {k:05}", f"https://www.site-{k % 16:02}.example") for k in range(4800)]
    rows[0] = (None, "text 00000", None)
    homes, ids = defaultdict(set), defaultdict(set)
    for r in kd_shards(spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(3), shards=16).collect():
        k = int((r.doc_id or "document-00000")[9:])
        homes[k % 16].add(r.shard)
        ids[r.shard].add(k // 1200)
    # some of the four cuts go through sources, others through ids
    assert max(map(len, homes.values())) <= 8 and max(map(len, ids.values())) < 4


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(d, "copy " * 20 if d % 3 == 0 else f"text {d} " * (d % 17), "s", "en") for d in range(3000)]
    size = Counter()
    for r in kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect():
        size[r.shard] += r.size
    assert len(size) == 24 and max(size.values()) < 1.15 * min(size.values())


def test_shards_odd(spark, odd_docs, no_docs):
    got = kd_shards(odd_docs, shards=3).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.shard < 3 for r in got)
    assert kd_shards(no_docs).count() == 0 and kd_shards(odd_docs, shards=1).filter("shard <> 0").count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r.slot for r in kd_shards(same, shards=1).collect()) == [0, 1, 2, 3]
    assert kd_shards(same, shards=24).count() == 4


# pipeline


def test_pipeline(spark):
    import os

    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    from kindred.shared import materialise

    held = docs
    for name, stage in pipeline.STAGES:
        before = held
        held = materialise(stage(spark, before, sf), name)
        if name != "sharding":
            assert held.schema.names == docs.schema.names
        if name == "near_dedup":
            from test_simhash import brute

            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in held.collect()} == {c for _, _, _, c in brute(rows)} and held.count() == held.select("doc_id").distinct().count()
        if name == "mixing":
            copies = Counter(r.doc_id for r in held.select("doc_id").collect())
            assert max(copies.values()) <= 2
            mixed = {r.doc_id: r.copies for r in mix_sources(before).collect()}
            assert copies == Counter({d: c for d, c in mixed.items() if c})
    assert held.count() == before.count() and pipeline.run(spark, sf).count() == held.count()


def test_pipeline_odd(spark, odd_docs, tmp_path):
    import corpus_pipeline as pipeline

    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "two words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    docs.filter(F.lit(False)).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
