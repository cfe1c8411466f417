"""Toxicity by compression distance.

Pairs of zstandard dictionaries are trained on labelled texts. The ordinary one is trained on the rows without toxicity. The toxic one is
trained on the toxic rows, on what of them the ordinary dictionary leaves dear: words that cost more than a few bytes with it. In use
the toxic dictionary stands before the ordinary one, so that ordinary text costs the same with both. A document is cut into
windows of several words; a window's distance is its compressed length with the ordinary dictionary minus that with the toxic one, summed
over a few pairs that were trained with other sizes, as which segments a small dictionary holds is partly chance. Where no match with
the toxic dictionary is longer than with the ordinary one alone, both lengths are equal, and the window isn't compressed for that pair. A
document's features are how many of its windows lie at or beyond each of a few distances, and its length; their weights
are calibrated on labelled rows that no dictionary was trained on.

Text is compressed in a spelling that makes matches begin where words do: letters in lower case, ASCII punctuation as spaces, and after
each byte a mark of the word up to there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.textkit import LOWER, Words, pieces, prefix_marks
from kindred.shared import discard, materialise

_FOLD = LOWER.copy()
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0x20
#: Labelled rows to learn from, least hash of the id first, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 5000, 64 << 20
#: Bytes of text that are looked at together; so many that what is made of them fits the caches.
PIECE = 1 << 18
#: Of ten rows, how many the dictionaries are trained on; the others calibrate.
TRAINED = 7
#: Of each pair of dictionaries: bytes of the ordinary one and of the toxic one, and the training's segment and match lengths, in bytes of the spelling.
PAIRS = ((9_000, 2_500, 20, 8), (12_000, 1_500, 24, 8), (12_000, 2_000, 20, 6), (6_000, 2_500, 24, 8))
#: Bytes above which a word is dear to the ordinary dictionary.
DEAR = 6
#: Bytes of the shortest match.
MATCH = 4
#: Bytes at the end of its input and of a dictionary at which zstandard begins no match.
LAST, UNSEEN = 7, 8
#: In the place of the toxic content, so that zstandard makes equal tables for both; text in UTF-8 holds no two of it in a row, nor the spelling four.
FILLER = b"\xff"
#: Words of a window, and the distances that count.
SPAN = 6
CUTS = (2, 4, 6, 8, 10, 12, 15, 18, 22, 27, 33)


def spelled(words: Words) -> tuple[bytes, np.ndarray]:
    """The spelling of all words, one after another, and where each begins (len + 1): each byte and a mark of the bytes up to it, then a space and the last mark again."""
    size = words.end - words.start
    n = int(size.sum())
    inner = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    mark = prefix_marks(words.data, words.start, words.end)
    begin = np.concatenate(([0], np.cumsum(2 * size + 2)))
    at = np.repeat(begin[:-1], size) + 2 * inner
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    out[at], out[at + 1] = words.data[inner + np.repeat(words.start, size)], mark
    out[begin[1:] - 1] = mark[np.cumsum(size) - 1]
    return out.tobytes(), begin


def windows(words: Words, span: int = SPAN) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The document of each window, the spelling of all words, and where in it each window begins and ends: ``span`` words, fewer at a document's end."""
    body, begin = spelled(words)
    count = -(-words.count // span)
    doc = np.repeat(np.arange(words.docs), count)
    a = words.first[:-1][doc] + span * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    b = np.minimum(a + span, words.first[1:][doc])
    return doc, body, begin[a], begin[b]


class Lengths:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, content: bytes):
        kind = zstandard.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=MATCH, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=kind)
        self.compress = zstandard.ZstdCompressor(compression_params=kind, dict_data=held).compress

    def __call__(self, bodies: list[bytes]) -> np.ndarray:
        compress = self.compress
        return np.fromiter((len(compress(b)) for b in bodies), np.int64, len(bodies))


def inputs(docs: int, count: np.ndarray, doc: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """(documents, 2 + cuts): one, log of words, and logs of windows at or beyond each cut."""
    beyond = [np.log1p(np.bincount(doc[distance >= c], minlength=docs)) for c in CUTS]
    return np.stack((np.ones(docs), np.log1p(count), *beyond), axis=1)


def ahead(ordinary: bytes, toxic: bytes) -> set[bytes]:
    """From each place of the toxic content on, the shortest run of at least MATCH bytes that the ordinary one doesn't hold at a place where zstandard looks.

    Text has a longer match in toxic + ordinary than in ordinary alone just where one of these begins.
    """
    both, out, places = toxic + ordinary, set(), len(ordinary) - UNSEEN
    for at in range(len(toxic)):
        size = MATCH
        while size <= len(both) - at and 0 <= ordinary.find(both[at : at + size]) < places:
            size += 1
        out.add(both[at : at + size])
    return out


class Runs:
    """Finds the runs of up to seven sets in bytes, all sets at once, by hashes of their beginnings in one table, and whole ones again among all hashes. Misses none; where hashes of 32 bits are equal it finds one too many."""

    #: In the table: that longer runs begin so.
    ON = 1 << 7

    def __init__(self, sets: list[set[bytes]]):
        which: dict[bytes, int] = {}
        for k, runs in enumerate(sets):
            for r in runs:
                which[r] = which.get(r, 0) | 1 << k
        self.longest = max(map(len, which), default=0)
        self.table, found = np.zeros(1 << 20, np.uint8), {}
        hashes = {r[:MATCH]: self.four(int.from_bytes(r[:MATCH], "little")) for r in which}
        for size in range(MATCH, self.longest + 1):
            for r, h in hashes.items():
                if r in which:
                    self.table[h >> 12] |= which[r]
                    found[h] = found.get(h, 0) | which[r]
            further = {r[: size + 1]: r for r in which if len(r) > size}
            for r in further:
                self.table[hashes[r[:size]] >> 12] |= self.ON
            hashes = {r: self.longer(hashes[r[:size]], r[size]) for r in further}
        self.hashes = np.array(sorted(found), np.uint32)
        self.sets = np.array([found[h] for h in sorted(found)], np.uint8)

    @staticmethod
    def four(value):
        return value * 0x9E3779B1 & 0xFFFFFFFF

    @staticmethod
    def longer(h, byte):
        return ((h ^ h >> 15) ^ byte) * 0x9E3779B1 & 0xFFFFFFFF

    def __call__(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows body[begin : end], which follow each other: those in which a run lies, as often as they are found, and the sets (bits)."""
        first = np.zeros(len(body), np.uint32)
        for a in range(MATCH):
            n = (len(body) - a) // MATCH
            if n > 0:
                first[a : a + MATCH * n : MATCH] = self.four(body[a : a + MATCH * n].view("<u4"))
        told = self.table[first >> np.uint32(12)]
        # zstandard looks for no match in a window's last bytes
        for k in range(1, LAST + 1):
            told[np.maximum(end - k, begin)] = 0
        at = np.flatnonzero(told)
        h, told, window = first[at], told[at], np.searchsorted(begin, at, side="right") - 1
        to = at + MATCH
        last, out = end[window], [(window[:0], told[:0])]
        for _ in range(MATCH, self.longest + 1):
            whole = np.flatnonzero((told % self.ON > 0) & (to <= last))
            place = np.minimum(np.searchsorted(self.hashes, h[whole]), len(self.hashes) - 1)
            out.append((window[whole], np.where(self.hashes[place] == h[whole], self.sets[place], 0)))
            on = np.flatnonzero((told >= self.ON) & (to < last))
            h, to, window, last = h[on], to[on], window[on], last[on]
            h = self.longer(h, body[to])
            to += 1
            told = self.table[h >> np.uint32(12)]
        return tuple(np.concatenate(c) for c in zip(*out))


class Distances:
    """Distance of windows: the sum over all pairs of dictionaries (ordinary, toxic).

    A window in which no match in toxic + ordinary is longer than in ordinary alone is compressed to the same length with both, so it isn't compressed for that pair.
    """

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = [(Lengths(FILLER * len(toxic) + ordinary), Lengths(toxic + ordinary)) for ordinary, toxic in pairs]
        self.runs = Runs([ahead(*p) for p in pairs])

    def __call__(self, body: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the windows body[begin : end], which follow each other."""
        out = np.zeros(len(begin), np.int64)
        window, sets = self.runs(np.frombuffer(body, np.uint8), begin, end)
        for k, (before, after) in enumerate(self.pairs):
            differs = np.zeros(len(begin), bool)
            differs[window[sets >> k & 1 == 1]] = True
            differ = np.flatnonzero(differs)
            bodies = [body[x:y] for x, y in zip(begin[differ].tolist(), end[differ].tolist())]
            out[differ] += before(bodies) - after(bodies)
        return out


@dataclass
class Model:
    """The contents of all pairs of dictionaries (none where nothing was learnt) and the weights of ``inputs``."""

    pairs: list[tuple[bytes, bytes]]
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.weights, self.distances = model.weights, Distances(model.pairs)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts, _FOLD)
        doc, *spans = windows(words) if self.distances.pairs else (np.zeros(0, np.int64), b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
        return chances(inputs(words.docs, words.count, doc, self.distances(*spans)) @ self.weights)


def chances(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _chunks(texts: list[str], most: int = PIECE) -> Iterator[tuple[int, Words]]:
    """Words of consecutive texts, about ``most`` bytes at a time, with the first one's number."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, Words(pa.array(texts[at:to], pa.large_string()), _FOLD)
        at = to


def first_copies(texts: list[str], shingle: int = 8) -> np.ndarray:
    """Which texts share neither of their two least shingles with one before: of near copies mostly one."""
    keep, seen = np.ones(len(texts), bool), set()
    for at, words in _chunks(texts):
        hashes = words.hashes()
        for d in range(words.docs):
            a, b = int(words.first[d]), int(words.first[d + 1])
            own = words.windows(hashes[a:b], min(shingle, max(1, b - a)))[: max(1, b - a - shingle + 1)]
            marks = np.unique(own)[:2].tolist()
            keep[at + d] = not any(m in seen for m in marks)
            seen.update(marks)
    return keep


def trained(size: int, samples: list[bytes], segment: int, match: int) -> bytes:
    """A dictionary's content trained on samples: segments whose parts stand in the most samples. Too few to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=match).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _spellings(texts: list[str]) -> Iterator[list[bytes]]:
    """Of each text, its words' spellings, each once."""
    for _, words in _chunks(texts):
        body, begin = spelled(words)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield list(dict.fromkeys(body[x:y] for x, y in zip(begin[a:b].tolist(), begin[a + 1 : b + 1].tolist())))


def dictionaries(plain: list[bytes], toxic: list[list[bytes]]) -> list[tuple[bytes, bytes]]:
    """Contents of the ordinary and the toxic dictionary of each pair. plain: spellings of texts; toxic: of their words."""
    out = []
    for size, most, segment, match in PAIRS:
        ordinary = trained(size, [p for p in plain if p] or [b" "], segment, match)
        compress = Lengths(ordinary).compress
        bare = len(compress(b""))
        cost = {w: len(compress(w)) - bare for w in {w for own in toxic for w in own}}
        dear = [d for d in (b"".join(w for w in own if cost[w] > DEAR) for own in toxic) if d]
        out.append((ordinary, trained(most, dear or [b" "], segment, match)))
    return out


def learn(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries and weights from labelled texts. Without rows of both labels to train on and to calibrate on every score is the share of toxic rows.

    The weights are those that fit best the rows that the dictionaries weren't trained on; the dictionaries are then trained on all rows.
    """
    texts = [t or "" for t in texts]
    y = np.array(labels, dtype=np.int64)
    use = np.arange(len(y)) % 10 < TRAINED
    if len(set(y[use])) < 2 or len(set(y[~use])) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model([], np.array([math.log((share + 1e-9) / (1 - share + 1e-9)), *[0.0] * (1 + len(CUTS))]))
    first = first_copies(texts)
    side = lambda label, among: _spellings([t for t, one, u, own in zip(texts, first, among, y) if one and u and own == label])
    train = lambda among: dictionaries([b"".join(w) for w in side(0, among)], list(side(1, among)))
    distances, x = Distances(train(use)), []
    for _, words in _chunks([t for t, u in zip(texts, use) if not u]):
        doc, *spans = windows(words)
        x.append(inputs(words.docs, words.count, doc, distances(*spans)))
    return Model(train(np.ones(len(y), bool)), _logistic(np.concatenate(x), y[~use]))


def fold(id_col: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, most: int, held_out: int | None, folds: int) -> tuple[list[str], list[int]]:
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    if held_out is not None:
        rows = rows.filter(fold(F.col("id"), folds) != held_out)
    # an id that is labelled twice counts as toxic if any label says so; of rows with one id the one of least text is learnt from
    rows = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = materialise(texts.join(F.broadcast(rows), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
    # at most ``sample`` rows are left, so one task may add them up
    line = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    fits = found.select("id", F.sum(F.octet_length("text")).over(line).alias("upto")).filter(F.col("upto") <= most).select("id")
    got = found.join(fits, "id").orderBy(F.xxhash64("id"), "id").select("text", "label").toArrow()
    discard(found)
    return got["text"].to_pylist(), got["label"].to_pylist()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Scores every document for toxicity.

    Learns from at most ``sample`` labelled rows, of at most ``sample_bytes`` in all, outside fold ``held_out`` (crc32 of the id as text, modulo ``folds``). Returns
    one row per row of ``docs``: the id, held_out, score (0 to 1, higher: toxic likelier) and predicted (1 if score is at least ``threshold``).
    A score depends on the text alone.

    Null and empty texts score as texts without any toxic window. A null id is not held out and never trained on. Repeated rows get equal scores; of
    rows that share a labelled id the one of least text is learnt from. Labels
    without a document, and documents without a label, are fine; without labels of both kinds every score is the share of toxic
    labels (0 for none). Other columns are ignored. An empty table gives an empty result.
    """
    model = learn(*training_rows(docs, labels, id_col, text_col, label_col, sample, sample_bytes, held_out, folds))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for piece in pieces(batches, "text", PIECE):
            yield pa.record_batch([piece.column("id"), pa.array(scorer(piece.column("text")), pa.float64())], names=["id", "score"])

    scored = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(scan, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
