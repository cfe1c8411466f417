import random

import pytest

WORDS = [f"w{k}" for k in range(60)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with all that is awkward: nulls, empty and long texts, repeated rows, one id on two texts, and columns whose names clash with inner ones."""
    rng = random.Random(3)
    shared = sentence(rng, 70)
    long = sentence(rng, 30_000)
    rows = [
        (0, "", "src0", "en"),
        (1, None, "src1", None),
        (2, shared, None, "en"),
        (3, "Ünï \t\n" + shared + "\x0b\x0cend", "src0", "de"),
        (4, shared, "src2", "en"),
        (4, shared, "src2", "en"),
        (5, sentence(rng, 15) + " " + shared + " " + sentence(rng, 15), "src0", "fr"),
        (None, shared + " tail", "src1", "en"),
        (None, None, None, None),
        (6, long, "src0", "en"),
        (7, long + " more", "src0", "en"),
        (8, "one", "src0", "en"),
        (8, "two words", "src3", "en"),
        (9, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "src0", "en"),
        (10, "\n\n \t", "src1", "es"),
        (11, "x" * 5000 + " " + "日本語 " * 40, "src1", "ja"),
        (12, sentence(rng, 300), "src0", "en"),
        (13, sentence(rng, 25), "src0", "en"),
        (14, None, "src0", "en"),
    ]
    full = [(*r, len(r[1]) if r[1] else None, 1, "t", 2, "s", 7, 8, "k") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, rid long, tag string, slot int, id string, size int, fp long, k string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def random_docs(spark):
    """Documents with shared passages, copies and near copies."""
    rng = random.Random(11)
    pool = [sentence(rng, rng.randrange(20, 90)) for _ in range(12)]
    rows = []
    for k in range(150):
        parts = [sentence(rng, rng.randrange(0, 80))]
        if rng.random() < 0.5:
            parts.append(rng.choice(pool))
        if rng.random() < 0.3:
            parts.append(sentence(rng, rng.randrange(1, 40)))
        text = rng.choice([" ", "\n", "  \n"]).join(parts)
        if rows and rng.random() < 0.25:
            text = rng.choice(rows)[1]
            if rng.random() < 0.6:
                words = text.split(" ")
                words[rng.randrange(len(words))] = "changed"
                text = " ".join(words)
        rows.append((k * 3 + 1, text, f"src{rng.choice([0, 0, 0, 1, 2, 10])}", "en"))
    return rows


def pairs(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]
