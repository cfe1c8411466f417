"""Operators 1 and 7 against every window compared with every other."""

import hashlib
import re
from collections import defaultdict

import pytest

from kindred.llm.sparse_suffix import repeated_passages
from kindred.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(rows, size):
    """Places of every window: by its words, (id, text, position); equal rows are one document."""
    places = defaultdict(set)
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            places[tuple(w[i : i + size])].add((d, t, i))
    return places


def brute_removed(rows, size):
    """Ids differ here, so order is by id and position."""
    gone = defaultdict(set)
    for held in windows(rows, size).values():
        for d, _, i in sorted(held, key=lambda p: (p[0], p[2]))[1:]:
            gone[d].update(range(i, i + size))
    out = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        out[d] = (len(w), len(gone[d]), " ".join(x for k, x in enumerate(w) if k not in gone[d]))
    return out


@pytest.mark.parametrize(("size", "gram"), [(20, 8), (5, 3), (4, 4)])
def test_dedup(spark, random_docs, size, gram):
    df = spark.createDataFrame(random_docs, "doc_id long, text string, source string, lang string").repartition(5)
    got = dedup_substrings(df, window=size, gram=gram, suffixes_per_tree=500).collect()
    want = brute_removed([(d, t) for d, t, _, _ in random_docs], size)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    if size == 20:
        hashed = {r.doc_id: r.kept_sha256 for r in dedup_substrings(df, digest=True).collect()}
        assert hashed == {d: hashlib.sha256(k.encode()).hexdigest() for d, (_, _, k) in want.items()}


def test_dedup_odd(odd_docs, no_docs):
    got = dedup_substrings(odd_docs)
    assert got.count() == odd_docs.count()
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    # a null id is the least: the null row with the shared words keeps them, every later one loses them
    assert sorted(r.n_removed for r in by[None]) == [0, 0]
    assert by[2][0].n_removed == 70 and by[2][0].kept_text == "" and by[2][0].spans[0].end == 70
    assert [(r.n_words, r.n_removed) for r in by[4]] == [(70, 70), (70, 70)]
    assert by[3][0].kept_text == "Ünï end" and by[5][0].n_removed == 70 and by[5][0].n_words == 100
    assert (by[0][0].n_words, by[0][0].kept_text) == (0, "") and (by[1][0].n_words, by[1][0].kept_text) == (0, "")
    assert by[6][0].n_removed == 0 and by[7][0].n_removed == 30_000 and by[7][0].kept_text == "more"
    # all windows of a repeated word but the first are repeats, in the document itself
    assert (by[9][0].n_words, by[9][0].n_removed) == (30, 29)
    assert dedup_substrings(no_docs).count() == 0
    with pytest.raises(ValueError):
        dedup_substrings(no_docs, window=5, gram=9)


@pytest.mark.parametrize(("length", "reach", "gram"), [(50, 25, 8), (12, 6, 3)])
def test_passages(spark, random_docs, length, reach, gram):
    df = spark.createDataFrame(random_docs, "doc_id long, text string, source string, lang string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_repeated, r.n_later) for r in repeated_passages(df, length=length, reach=reach, gram=gram).collect()}
    again, later = defaultdict(set), defaultdict(set)
    for held in windows([(d, t) for d, t, _, _ in random_docs], length).values():
        order = sorted(held, key=lambda p: (p[0], p[2]))
        for k, (d, _, i) in enumerate(order if len(order) > 1 else []):
            again[d].update(range(i, i + length))
            if k:
                later[d].update(range(i, i + length))
    want = {d: (len(WORD.findall(t)), len(again[d]), len(later[d])) for d, t, _, _ in random_docs if again.get(d)}
    assert got == want


def test_passages_odd(odd_docs, no_docs):
    got = {r.doc_id: r for r in repeated_passages(odd_docs).collect()}
    # the repeated row counts once, and doesn't repeat itself; 9 is too short, 12 and 13 hold nothing
    assert set(got) == {None, 2, 3, 4, 5, 6, 7}
    assert (got[None].n_repeated, got[None].n_later) == (70, 0) and (got[2].n_repeated, got[2].n_later) == (70, 70)
    assert [(s.start, s.end) for s in got[3].repeated] == [(1, 71)] and got[6].n_later == 0 and got[7].n_later == 30_000
    assert repeated_passages(no_docs).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(no_docs, length=10, reach=10)


def test_passage_of_many_documents(spark):
    # one passage in a third of all rows, surroundings of its own in each
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(d, (" ".join(f"d{d}x{k}" for k in range(30)) + " " + passage if d % 3 == 0 else " ".join(f"d{d}y{k}" for k in range(90)))) for d in range(300)]
    got = {r.doc_id: r.n_later for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 60 * (d > 0) for d in range(0, 300, 3)}


def test_crowded_beginnings(spark, random_docs):
    """Passages of crowded suffixes go each on its own; the result is the same."""
    df = spark.createDataFrame(random_docs, "doc_id long, text string, source string, lang string").repartition(5)
    plain, crowded = ({r.doc_id: r for r in repeated_passages(df, length=12, reach=6, gram=3, crowd=c).collect()} for c in (10**9, 1))
    assert plain == crowded and plain


def test_classes(spark):
    """Documents that share passages, directly or through others, are one class."""
    passage = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(7, passage("a")), (8, passage("a") + " x " + passage("b")), (3, passage("b")), (20, passage("c") + " y " + passage("c")), (21, passage("d")), (30, passage("e")), (31, passage("e")), (None, passage("e"))]
    got = {r.doc_id: (r.class_id, r.n_linked) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7: (3, 2), 8: (3, 2), 3: (3, 2), 20: (20, 0), 30: (30, 2), 31: (30, 2), None: (30, 2)}


def test_suffix_trees():
    """Sorted rows, shared letters and deep nodes against a sort of tuples; packing is exact."""
    import random

    import numpy as np

    from kindred.llm.suffixes import Alphabet, deep_nodes, pack_rows, unpack_rows, word_order
    from kindred.llm.textkit import pack, ranks, unpack

    rng = random.Random(12)
    for _ in range(30):
        three = [rng.getrandbits(64) for _ in range(3)]
        letters = np.array([rng.choice(three) for _ in range(200)], np.uint64)
        size = rng.randrange(1, 9)
        rows = [tuple(letters[k : k + size].tolist()) for k in range(200 - size)]
        rank = ranks(letters, size)
        assert all((rows[a] < rows[b]) == (rank[a] < rank[b]) and (rows[a] == rows[b]) == (rank[a] == rank[b]) for a in range(0, 190, 7) for b in range(0, 190, 11))
        spelled, number = np.unique(letters, return_inverse=True)
        by = np.argsort(rank[: len(rows)], kind="stable")
        codes = Alphabet(spelled[:1]).encode(spelled)
        packed = unpack(pack(*pack_rows(number[by[:, None] + np.arange(size)].astype(np.uint32), codes, spelled)))
        back = unpack_rows(*packed, size)
        own = [rows[k] for k in by]
        assert all((tuple(back[:, a]) == tuple(back[:, b])) == (own[a] == own[b]) for a in range(0, len(own), 5) for b in range(0, len(own), 3))
        order, common = word_order(back)
        starts, ends = deep_nodes(common, size)
        groups = [sorted(int(by[k]) for k in order[a:b]) for a, b in zip(starts, ends)]
        want = {}
        for k, r in enumerate(rows):
            want.setdefault(r, []).append(k)
        assert sorted(groups) == sorted(want.values())


def same_hash_texts(spark, prefix, n=150_000):
    """Two texts with equal 32-bit hash."""
    from pyspark.sql import functions as F

    found = spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("t")).groupBy(F.hash("t").alias("h")).agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").first()
    return found.a, found.b


def test_rows_of_one_id_with_equal_short_hashes(spark):
    """Identity is the id and 128 bits of the text: neither one id nor a null one mixes two texts up."""
    from kindred.llm.decontaminate import contaminated
    from kindred.llm.line_rules import judge_lines
    from kindred.llm.pii import personal_data

    words = " ".join(f"w{k}" for k in range(60))
    a, b = same_hash_texts(spark, words + " a@b.example.com ")
    rows = [(7, a), (7, b), (None, a), (None, b), (9, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("s")).repartition(3)
    kept = sorted((r.doc_id or -1, r.kept_text, r.n_removed) for r in dedup_substrings(df).collect())
    last = {a.split()[-1], b.split()[-1]}
    # one of the null rows comes first and stays whole, the other keeps what differs; the rows of 7 and 9 repeat them
    assert [k[0] for k in kept] == [-1, -1, 7, 7, 9] and sorted(k[2] for k in kept[:2]) == [0, 61]
    assert {k[1].split()[-1] for k in kept[:2]} == last and all(k[1] == "" or k[1] in last for k in kept[2:])
    assert repeated_passages(df).count() == 5 and {r.class_id for r in repeated_passages(df).collect()} == {7}
    assert sorted((r.doc_id or -1, len(r.spans)) for r in personal_data(df, support=9).collect()) == [(-1, 1), (-1, 1), (7, 1), (7, 1), (9, 1)]
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    assert contaminated(df, items).count() == 5 and judge_lines(df).count() == 5
