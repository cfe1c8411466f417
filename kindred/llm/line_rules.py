"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits to 0, ASCII punctuation and white space to one space) and hashed; for each host
the documents that hold a line are counted; lines in more documents than the host's limit are removed, and a document of which
too little is left is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.anchors import KEY, KEYS, key_columns, named
from kindred.llm.textkit import LOWER, SPACE, Words, cover, hash_ranges, mix, pieces
from kindred.shared import materialise

_NORMAL = LOWER.copy()
_NORMAL[48:58] = 48
_NORMAL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0x20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SALTS = 16
PROFILE = f"{KEYS}, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs more than once, and whether it did before."""
    by = np.argsort(keys, kind="stable")
    s = keys[by]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    before, twice = np.empty(len(s), bool), np.empty(len(s), bool)
    before[by] = same
    either = same.copy()
    either[:-1] |= same[1:]
    twice[by] = either
    return twice, before


def profile(piece: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(piece.column("text"))
    data, offsets, docs = words.data, words.offsets, words.docs
    salt = mix(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    letters = ~SPACE[data] & ((data & 0xC0) != 0x80)
    # words in three-word windows that the text has again
    windows, fits = words.windows(words.hashes(), 3), words.fits(3)
    at = np.flatnonzero(fits)
    twice, _ = _again(windows[at] ^ salt[words.doc[at]])
    near = cover(at[twice], 3, len(words))
    # lines: a document of k line feeds has k + 1
    feeds = np.flatnonzero(data == 0x0A)
    inner = np.searchsorted(offsets, feeds, side="right") - 1
    start = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    owner = np.sort(np.concatenate((np.arange(docs), inner)), kind="stable")
    end = np.append(start[1:] - 1, len(data))
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = offsets[owner[last] + 1]
    first_word = np.searchsorted(words.start, start)
    n_in = np.searchsorted(words.start, end) - first_word
    filled = np.flatnonzero(n_in > 0)
    _, before = _again(hash_ranges(data, start[filled], end[filled]) ^ salt[owner[filled]])
    dup = np.bincount(owner[filled[before]], minlength=docs)
    # normalised lines, each once per document with the words of all its occurrences
    plain = Words(piece.column("text"), _NORMAL)
    hashes = plain.hashes()
    low, high = np.searchsorted(plain.start, start[filled]), np.searchsorted(plain.start, end[filled])
    has = np.flatnonzero(high > low)
    line = hash_sequences(hashes, low[has], high[has])
    who, count = owner[filled[has]], n_in[filled[has]]
    by = np.lexsort((line, who))
    new = np.ones(len(by), bool)
    new[1:] = (who[by][1:] != who[by][:-1]) | (line[by][1:] != line[by][:-1])
    heads = np.flatnonzero(new)
    total = np.add.reduceat(count[by], heads) if len(heads) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(np.bincount(who[by][heads], minlength=docs))))
    lines = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()),
        pa.StructArray.from_arrays([pa.array(line[by][heads].view(np.int64)), pa.array(total, pa.int32())], names=["line", "words"]),
    )
    columns = [words.count, _per_doc(letters, offsets), _per_doc(_SYMBOL[data], offsets), dup, np.bincount(words.doc[near], minlength=docs)]
    return pa.record_batch(
        [*[piece.column(c) for c in KEY], piece.column("host"), *[pa.array(c, pa.int64()) for c in columns], lines],
        names=[*KEY, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
    )


def hash_sequences(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the word hashes low .. high of each range."""
    out = np.zeros(len(low), np.uint64)
    if not len(low):
        return out
    from_, size = low, high - low
    with np.errstate(over="ignore"):
        place = np.arange(int(size.sum()))
        inside = place - np.repeat(np.cumsum(size) - size, size)
        values = mix(hashes[np.repeat(from_, size) + inside] + (inside + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = np.add.reduceat(values, np.cumsum(size) - size)
        return mix(out ^ size.astype(np.uint64))


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_limit: int = 20, share_limit: float = 0.001, least_words: int = 50, most_repeat: int = 50, least_left: int = 30) -> DataFrame:
    """Judges every document by base rules and by the lines it shares with many documents of its host.

    A line's limit is the greater of ``least_limit`` documents and ``share_limit`` of the host's documents. Returns one row per row of
    ``docs``: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words (of lines above the limit),
    base_failed (fewer than ``least_words`` words, or more than ``most_repeat`` percent of them in repeated three-word windows) and kept
    (not base_failed, and at least ``least_left`` percent of the words are left).

    A null text is empty; texts without words fail the base rules. A null host is a host of its own. Lines without letters
    or digits are never removed. Repeated rows (same id and text) count as one document and get the same result each. Other
    columns are ignored. An empty table gives an empty result.
    """
    host = F.xxhash64(F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("\x01none")))
    base = docs.select(
        *key_columns(id_col, text_col),
        host.alias("host"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield profile(piece)

    seen = materialise(base.mapInArrow(scan, PROFILE), "profiles")
    once = seen.select(*KEY, "host", "lines").dropDuplicates([*KEY, "host"])
    limits = once.groupBy("host").agg(F.greatest(F.lit(float(least_limit)), F.count("*") * share_limit).alias("most"))
    lines = once.select(*KEY, "host", F.explode("lines").alias("l")).select(*KEY, "host", "l.line", "l.words")
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > least_limit)
    hot = counts.join(limits, "host").filter("n > most").select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.hash(*KEY), F.lit(SALTS)))
    removed = salted.join(hot, ["host", "line", "salt"]).groupBy(*KEY, "host").agg(F.sum("words").alias("n_removed_words"))
    out = seen.drop("lines").join(removed, [*KEY, "host"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed_words")) >= least_left * F.col("n_words")
    return out.select(
        named(docs, id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", failed.alias("base_failed"), (~failed & left).alias("kept"),
    )
